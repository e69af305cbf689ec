"""Snapshots of a feed, the analysis base, coverage of label sets, and differences between runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelscope.functions.columns import count_if, shortened


def content_digest(df: DataFrame) -> DataFrame:
    """One row: rows and an order-free hash of all of them; equal for equal content however it is partitioned."""
    return df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*(F.col(f"`{c}`") for c in df.columns)).cast("decimal(38,0)")).cast("string").alias("hash"))


def snapshot_decisions(pulls: DataFrame, time: str, columns: Sequence[str], least: int = 1000) -> DataFrame:
    """(time, n, decision): each pull is new, a repeat of the content of an earlier one, or refused as too small."""
    by = pulls.groupBy(time).agg(F.count("*").alias("n"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("_h"))
    first = by.groupBy("n", "_h").agg(F.min(time).alias("_first"))
    return by.join(first, ["n", "_h"]).select(time, "n", F.when(F.col("n") < least, "refused").when(F.col(time) > F.col("_first"), "same content").otherwise("new").alias("decision"))


def latest_version(snapshots: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The newest row of each key over all snapshots; keys that left the feed stay. One hash aggregate, no window."""
    others = [c for c in snapshots.columns if c != key]
    best = F.max_by(F.struct(*others), F.struct(*order))
    return snapshots.groupBy(key).agg(best.alias("_b")).select(key, *(F.col(f"_b.{c}").alias(c) for c in others))


def cut_through(df: DataFrame, time: str, day: str) -> DataFrame:
    """Rows before the end of a day; the end is exclusive."""
    return df.where(F.col(time) < F.date_add(F.lit(day).cast("date"), 1))


def snapshot_stats(snapshots: DataFrame, key: str, time: str, day: str) -> DataFrame:
    """One row: keys in the newest pull, kept from earlier ones, and cut off behind a day."""
    pull = F.col(time).cast("date")
    last = snapshots.agg(F.max(pull).alias("_last"))
    by = snapshots.crossJoin(F.broadcast(last)).groupBy(key).agg(F.max((pull == F.col("_last")).cast("int")).alias("_in"), F.max(time).alias("_t"))
    kept = F.col("_t") < F.date_add(F.lit(day).cast("date"), 1)
    return by.agg(F.count("*").alias("keys"), count_if(F.col("_in") == 1).alias("in_latest"), count_if(F.col("_in") == 0).alias("from_earlier"), count_if(~kept).alias("cut"))


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, columns: Sequence[str], measure: str) -> DataFrame:
    """(change, n, delta): new, gone, changed and unchanged keys and the sum of a measure's change. Null equals null."""
    a = before.select(F.col(key), F.struct(*columns).alias("_a"), F.col(measure).alias("_ma"), F.lit(True).alias("_ia"))
    b = after.select(F.col(key), F.struct(*columns).alias("_b"), F.col(measure).alias("_mb"), F.lit(True).alias("_ib"))
    met = a.join(b, key, "full")
    kind = F.when(F.col("_ia").isNull(), "new").when(F.col("_ib").isNull(), "gone").when(F.col("_a").eqNullSafe(F.col("_b")), "unchanged").otherwise("changed")
    return met.withColumn("change", kind).groupBy("change").agg(F.count("*").alias("n"), F.sum(F.coalesce("_mb", F.lit(0)) - F.coalesce("_ma", F.lit(0))).alias("delta"))


def metric_diff(before: DataFrame, after: DataFrame, move: float = 0.005) -> DataFrame:
    """(key, before, after, delta, moved) of two tables of metrics; a metric on one side only has moved."""
    met = before.select("key", F.col("value").alias("before")).join(after.select("key", F.col("value").alias("after")), "key", "full")
    delta = F.col("after") - F.col("before")
    return met.select("key", "before", "after", delta.alias("delta"), F.coalesce(F.abs(delta) > move, F.lit(True)).alias("moved"))


def missing_ids(items: DataFrame, labels: DataFrame, refused: DataFrame, id_col: str = "id") -> DataFrame:
    """Items without a label that were not refused."""
    return items.select(id_col).join(labels.select(id_col), id_col, "left_anti").join(refused.select(id_col), id_col, "left_anti")


def coverage(items: DataFrame, sets: DataFrame, refused: DataFrame, set_col: str, id_col: str = "id") -> DataFrame:
    """(set, labelled, refused, missing) of each label set over the items, in one pass over the tagged sets.

    Refused are the refused items less those that the set labels all the same; a set without a label of an item counts too.
    """
    ids = items.select(id_col)
    n = ids.agg(F.count("*").alias("_n"))
    labelled = sets.select(set_col, id_col).distinct().join(ids, id_col, "left_semi")
    known = labelled.groupBy(set_col).agg(F.count("*").alias("labelled"))
    open_ = refused.select(id_col).distinct().join(ids, id_col, "left_semi")
    names = sets.select(set_col).distinct()
    both = labelled.join(open_, id_col, "left_semi").groupBy(set_col).agg(F.count("*").alias("_both"))
    declined = open_.agg(F.count("*").alias("_open"))
    met = names.join(known, set_col, "left").join(both, set_col, "left").na.fill(0, ["labelled", "_both"]).crossJoin(F.broadcast(n)).crossJoin(F.broadcast(declined))
    met = met.withColumn("refused", F.col("_open") - F.col("_both"))
    return met.select(set_col, "labelled", "refused", (F.col("_n") - F.col("labelled") - F.col("refused")).alias("missing"))


def one_label_per_id(labels: DataFrame, id_col: str, order: str, keep: str = "first") -> DataFrame:
    """One row per id, the first or the last of an explicit order."""
    others = [c for c in labels.columns if c != id_col]
    pick = (F.min_by if keep == "first" else F.max_by)(F.struct(*others), F.col(order))
    return labels.groupBy(id_col).agg(pick.alias("_b")).select(id_col, *(F.col(f"_b.{c}").alias(c) for c in others))


def analysis_base(items: DataFrame, labels: DataFrame, merged: DataFrame, exclude: Column, id_col: str = "id") -> DataFrame:
    """Items that are labelled, not merged into another, and not excluded."""
    return items.join(labels, id_col).join(merged.select(id_col), id_col, "left_anti").where(~F.coalesce(exclude, F.lit(False)))


def base_steps(items: DataFrame, labels: DataFrame, merged: DataFrame, exclude: Column, id_col: str = "id") -> DataFrame:
    """One row: the counts at each step to the base, from one joined pass."""
    met = items.join(labels.withColumn("_l", F.lit(True)), id_col, "left").join(merged.select(id_col, F.lit(True).alias("_m")), id_col, "left")
    label, twin, out = F.col("_l").isNotNull(), F.col("_m").isNotNull(), F.coalesce(exclude, F.lit(False))
    return met.agg(F.count("*").alias("items"), count_if(label).alias("labelled"), count_if(label & twin).alias("merged"), count_if(label & ~twin & out).alias("excluded"), count_if(label & ~twin & ~out).alias("base"))


def apply_overrides(df: DataFrame, rules: DataFrame, field: str, id_col: str = "id") -> DataFrame:
    """``df`` with a field set for the listed ids; the former value stays as raw_<field>, ``applied`` tells where it changed."""
    met = df.join(rules.select(id_col, F.col("value").alias("_new")), id_col, "left")
    return met.withColumn(f"raw_{field}", F.col(field)).withColumn(field, F.coalesce("_new", field)).withColumn("applied", F.coalesce(F.col("_new") != F.col(f"raw_{field}"), F.lit(False))).drop("_new")


def data_quality(items: DataFrame, labels: DataFrame, id_col: str, url: str, text: str, views: str, cap: int) -> DataFrame:
    """One row: rows, distinct ids and URLs, capped texts, unseen items and items without label."""
    met = items.join(labels.select(F.col(id_col), F.lit(1).alias("_l")), id_col, "left")
    return met.agg(F.count("*").alias("rows"), F.count_distinct(id_col).alias("ids"), (F.count("*") - F.count_distinct(url)).alias("repeated_urls"), count_if(F.length(text) >= cap).alias("capped"), count_if(F.col(views) == 0).alias("unseen"), count_if(F.col("_l").isNull()).alias("unlabelled"))


def intake_quality(usage: DataFrame, labels: DataFrame, items: DataFrame, id_col: str, day: str, time: str) -> DataFrame:
    """One row on a labelling run: its batches, those of a retry round, ids missing and stray in answers, labels twice or of no item, and whether days agree with times.

    ``usage`` has a row a batch with round, missing and stray, null for 1, 0 and 0.
    """
    runs = usage.agg(F.count("*").alias("batches"), count_if(F.coalesce("round", F.lit(1)) > 1).alias("retry_batches"), F.coalesce(F.sum("missing"), F.lit(0)).alias("missing_in_answers"), F.coalesce(F.sum("stray"), F.lit(0)).alias("stray_in_answers"))
    known = items.select(F.col(id_col).alias("_id")).distinct().withColumn("_known", F.lit(True))
    by = labels.groupBy(F.col(id_col).alias("_id")).agg(F.count("*").alias("_n")).join(known, "_id", "left")
    twice = by.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("repeated_labels"), count_if(F.col("_known").isNull()).alias("stray_labels"))
    days = items.agg(F.coalesce(F.bool_and(F.col(day).cast("date").eqNullSafe(F.col(time).cast("date"))), F.lit(True)).alias("days_match"))
    return runs.crossJoin(F.broadcast(twice)).crossJoin(F.broadcast(days))  # one row each


def shown_post(items: DataFrame, full: DataFrame, id_col: str, feed_cap: int = 400, full_cap: int = 6000, thumbs: int = 4) -> DataFrame:
    """(id, text, text_source, truncated, media_type, media_in, thumbs) of each item (id, text, media).

    The full text (id, ok, text, media, quote_media) counts where it was fetched and is ok, cut at its cap;
    the feed's own text is called truncated when it comes within five characters of the feed's cap. Media
    are those of the full post, else of the post it quotes, else the feed's; entries without a kind or a
    thumbnail do not count. The type is video if any is one, else image, else none; the first four thumbnails stay.
    """
    kind = lambda m: F.when(m["kind"].isin("photo", "image"), "image").when(m["kind"].isin("video", "gif"), "video")

    def usable(name: str) -> Column:
        found = F.transform(F.coalesce(F.col(name), F.array().cast("array<struct<kind:string,thumb:string>>")), lambda m: F.struct(kind(m).alias("kind"), m["thumb"].alias("thumb")))
        return F.filter(found, lambda m: m["kind"].isNotNull() & (m["thumb"] != ""))

    own = items.select(F.col(id_col).alias("id"), F.coalesce("text", F.lit("")).alias("_feed"), usable("media").alias("_m"))
    other = full.where("ok").select(F.col(id_col).alias("_id"), F.coalesce("text", F.lit("")).alias("_full"), usable("media").alias("_f"), usable("quote_media").alias("_q"))
    met = own.join(other, own["id"] == other["_id"], "left")
    fetched, some = F.col("_id").isNotNull(), lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    media = F.when(some("_f"), F.col("_f")).when(some("_q"), F.col("_q")).otherwise(F.col("_m"))
    place = F.when(some("_f"), "post").when(some("_q"), "quoted post").when(some("_m"), "post")
    met = met.select("id", fetched.alias("_ok"), "_feed", "_full", media.alias("_media"), place.alias("media_in"))
    return met.select(
        "id", F.when(F.col("_ok"), F.substring("_full", 1, full_cap)).otherwise(F.col("_feed")).alias("text"), F.when(F.col("_ok"), "full").otherwise("feed").alias("text_source"),
        F.when(F.col("_ok"), F.length("_full") > full_cap).otherwise(F.length("_feed") >= feed_cap - 5).alias("truncated"),
        F.when(F.exists("_media", lambda m: m["kind"] == "video"), "video").when(F.size("_media") > 0, "image").otherwise("none").alias("media_type"), "media_in",
        F.transform(F.slice("_media", 1, thumbs), lambda m: m["thumb"]).alias("thumbs"),
    )


def prompt_view(items: DataFrame, id_col: str, title: str, text: str, chips: str, hints: tuple[str, str], chars: int = 700) -> DataFrame:
    """(id, t, x, chips, hint) of each item as a reader gets it: the text cut with a mark, an array for no claims, two fields in one hint."""
    hint = F.concat_ws(" / ", *(F.coalesce(F.col(h).cast("string"), F.lit("")) for h in hints))
    none = F.array().cast("array<string>")
    return items.select(F.col(id_col).alias("id"), F.col(title).alias("t"), shortened(text, chars).alias("x"), F.coalesce(F.col(chips), none).alias("chips"), hint.alias("hint"))


def window_stats(items: DataFrame, time: str, author: str) -> DataFrame:
    """One row: first and last time, authors, the most posts of an author, and whether the last day is partial."""
    by = items.groupBy(author).agg(F.count("*").alias("n"), F.min(time).alias("a"), F.max(time).alias("z"))
    return by.agg(F.min("a").alias("first"), F.max("z").alias("last"), F.count("*").alias("authors"), F.max("n").alias("most"), F.sum("n").alias("items")).withColumn("partial_day", F.hour("last") < 23)


def best_text(items: DataFrame, full: DataFrame, id_col: str, text: str) -> DataFrame:
    """The fetched text where it is there and not shorter, else the feed's; with the source of each."""
    met = items.join(full.select(F.col(id_col), F.col("text").alias("_full")), id_col, "left")
    better = F.coalesce(F.length("_full") >= F.length(text), F.lit(False))
    return met.select(id_col, F.when(better, F.col("_full")).otherwise(F.col(text)).alias("text"), F.when(better, "full").otherwise("feed").alias("text_source"))
