"""Distributions, cross-tables, shares, profiles and their total rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelscope.functions.columns import bin_label, col, count_if, ratio
from labelscope.operators.rank import grouped_percentiles, with_percentiles


def _totals(df: DataFrame, measures: Sequence[str]) -> DataFrame:
    """One row: n_all and the sum of each measure; small enough to broadcast whatever ``df`` is."""
    return df.agg(F.count("*").alias("n_all"), *(F.sum(m).alias(f"{m}_all") for m in measures))


def with_shares(table: DataFrame, totals: DataFrame, measures: Sequence[str], count: str = "n", prefix: str = "share_") -> DataFrame:
    """Adds the share of the count and of each summed measure in the totals."""
    met = table.crossJoin(F.broadcast(totals))
    out = met.withColumn(f"{prefix}n", ratio(count, "n_all"))
    for m in measures:
        out = out.withColumn(f"{prefix}{m}", ratio(f"sum_{m}", f"{m}_all"))
    return out.drop("n_all", *(f"{m}_all" for m in measures))


def distribution(df: DataFrame, key: str, measures: Sequence[str], domain: DataFrame | None = None) -> DataFrame:
    """Count, sums, medians and shares by key; keys of the domain without rows get zeros, medians too."""
    by = df.groupBy(key).agg(F.count("*").alias("n"), *(F.sum(m).alias(f"sum_{m}") for m in measures))
    by = with_percentiles(by, df, [key], {f"median_{m}": (m, 0.5) for m in measures})
    if domain is not None:
        by = domain.select(key).distinct().join(by, key, "left").na.fill(0)
    return with_shares(by, _totals(df, measures), measures)


def family_table(df: DataFrame, key: str, views: str, likes: str, flags: Sequence[str]) -> DataFrame:
    """The distribution with the 90th percentile of views, flag counts and the index share of views / share of posts."""
    by = df.groupBy(key).agg(
        F.count("*").alias("n"), F.sum(views).alias(f"sum_{views}"), F.sum(likes).alias(f"sum_{likes}"), *(count_if(F.col(f)).alias(f"n_{f}") for f in flags)
    )
    by = with_percentiles(by, df, [key], {f"median_{views}": (views, 0.5), f"median_{likes}": (likes, 0.5), f"p90_{views}": (views, 0.9)})
    return with_shares(by, _totals(df, [views, likes]), [views, likes]).withColumn("index", ratio(f"share_{views}", "share_n"))


def with_total_row(df: DataFrame, key: str, aggregates: Sequence[Column], total: str = "total", medians: Sequence[str] = ()) -> DataFrame:
    """Aggregates by key and over all rows in one pass, with the medians of some values; those of the total row are its own."""
    grouped = df.rollup(key).agg(*aggregates, F.grouping(key).alias("_total"))
    if medians:
        kind = F.col(key).alias("k")
        both = F.explode(F.array(F.struct(F.lit(0).cast("tinyint").alias("_total"), kind), F.struct(F.lit(1).cast("tinyint").alias("_total"), F.lit(None).cast(df.schema[key].dataType).alias("k"))))
        each = df.select(*medians, both.alias("_b")).select(*medians, "_b._total", F.col("_b.k").alias(key))
        grouped = with_percentiles(grouped, each, ["_total", key], {f"median_{m}": (m, 0.5) for m in medians})
    return grouped.withColumn(key, F.when(F.col("_total") == 1, F.lit(total)).otherwise(F.col(key))).drop("_total")


def crosstab(df: DataFrame, row: str, column: str, columns: Sequence[str]) -> DataFrame:
    """Counts, dense in the named columns."""
    return df.groupBy(row).pivot(column, list(columns)).agg(F.count(F.lit(1))).na.fill(0)


def row_share(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each column over the row's sum; null where the sum is zero."""
    whole = sum((F.col(c) for c in columns[1:]), F.col(columns[0]))
    return table.select(*(c for c in table.columns if c not in columns), *(ratio(F.col(c), whole).alias(c) for c in columns))


def pivot_median(df: DataFrame, row: str, column: str, value: str, columns: Sequence) -> DataFrame:
    """By row: the median in each of the named columns; null without values."""
    found = grouped_percentiles(df.where(F.col(column).isin(*columns)), [row, column], {"_median": (value, 0.5)}).withColumnRenamed(row, "_row")
    table = found.groupBy("_row").pivot(column, list(columns)).agg(F.max("_median"))
    return df.select(row).distinct().join(table, F.col(row).eqNullSafe(F.col("_row")), "left").drop("_row")


def slice_stats(df: DataFrame, condition: Column, measures: Sequence[str], outside: Column | None = None) -> DataFrame:
    """One row: the slice's count, its shares of rows and measures, and its count outside a class with two denominators."""
    out = df.agg(
        count_if(condition).alias("n"), F.count("*").alias("n_all"), ratio(count_if(condition), F.count("*")).alias("share_n"),
        *(ratio(F.coalesce(F.sum(F.when(condition, F.col(m))), F.lit(0)), F.sum(m)).alias(f"share_{m}") for m in measures),
        *([] if outside is None else [count_if(condition & outside).alias("n_outside"), ratio(count_if(condition & outside), F.count("*")).alias("outside_of_all"), ratio(count_if(condition & outside), count_if(outside)).alias("outside_of_outside")]),
    )
    return out


def slice_by_key(df: DataFrame, key: str, condition: Column) -> DataFrame:
    """By key: rows in the slice, their share of the slice and of the key."""
    by = df.groupBy(key).agg(count_if(condition).alias("n"), F.count("*").alias("n_key"))
    whole = df.agg(count_if(condition).alias("_all"))
    return by.crossJoin(F.broadcast(whole)).select(key, "n", ratio("n", "_all").alias("share_of_slice"), ratio("n", "n_key").alias("share_of_key"))


def group_rows(df: DataFrame, key: str, value: str, id_col: str, within: Column | None = None) -> DataFrame:
    """By key: count, shares of the group and of all, sum, median and the item with the largest value, ties to the smallest id."""
    inside = df if within is None else df.where(within)
    by = inside.groupBy(key).agg(F.count("*").alias("n"), F.sum(value).alias(f"sum_{value}"), F.max_by(F.col(id_col), F.struct(F.col(value), -F.col(id_col))).alias("top_id"))
    by = with_percentiles(by, inside, [key], {f"median_{value}": (value, 0.5)})
    sizes = inside.agg(F.count("*").alias("_group")).crossJoin(df.agg(F.count("*").alias("_all")))
    return by.crossJoin(F.broadcast(sizes)).withColumn("share_of_group", ratio("n", "_group")).withColumn("share_of_all", ratio("n", "_all")).drop("_group", "_all")


def label_shift(a: DataFrame, b: DataFrame, id_col: str, fields: Sequence[str]) -> DataFrame:
    """(field, value): the share of items with the value in each of two label versions."""
    def long(df: DataFrame, name: str) -> DataFrame:
        each = df.unpivot([id_col], list(fields), "field", "value").where(F.col("value").isNotNull())
        n = each.groupBy("field").agg(F.count("*").alias("_n"))
        return each.groupBy("field", "value").agg(F.count("*").alias("k")).join(F.broadcast(n), "field").select("field", "value", ratio("k", "_n").alias(name))

    return long(a, "share_a").join(long(b, "share_b"), ["field", "value"], "full").na.fill(0.0, ["share_a", "share_b"])


def unchanged_share(a: DataFrame, b: DataFrame, id_col: str, fields: Sequence[str]) -> DataFrame:
    """(field, n, unchanged): share of common items with the same value, null equal to null."""
    first = a.unpivot([id_col], list(fields), "field", "x")
    second = b.unpivot([id_col], list(fields), "field", "y")
    return first.join(second, [id_col, "field"]).groupBy("field").agg(F.count("*").alias("n"), F.avg(F.col("x").eqNullSafe(F.col("y")).cast("double")).alias("unchanged"))


def crosswalk_top(df: DataFrame, key: str, other: str, k: int = 3) -> DataFrame:
    """The k most frequent other values of each key with their share; ranked on the counted table."""
    counts = df.groupBy(key, other).agg(F.count("*").alias("n"))
    whole = counts.groupBy(key).agg(F.sum("n").alias("_n"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), other))
    return counts.withColumn("rank", rank).where(F.col("rank") <= k).join(whole, key).select(key, other, "n", "rank", ratio("n", "_n").alias("share"))


def claim_long(df: DataFrame, id_col: str, chips: str, pattern: str = r"^([0-9][0-9,]*(?:\.[0-9]+)?)") -> DataFrame:
    """(id, claim, value): one row per claim that starts with a number."""
    each = df.select(F.col(id_col).alias("id"), F.explode(F.col(chips)).alias("claim"))
    number = F.regexp_extract(F.trim("claim"), pattern, 1)
    return each.select("id", "claim", F.when(number != "", F.regexp_replace(number, ",", "").cast("double")).alias("value")).where("value is not null")


_QUARTILES = {"p25": ("value", 0.25), "median": ("value", 0.5), "p75": ("value", 0.75)}


def claim_multiples(long: DataFrame) -> DataFrame:
    """One row: claims, items, quartiles, and the median without values of exactly one."""
    whole = long.agg(F.count("*").alias("claims"), F.count_distinct("id").alias("items"), F.min("value").alias("least"), F.max("value").alias("most"))
    other = F.when(F.col("value") != 1.0, F.col("value"))
    return with_percentiles(whole, long, [], {**_QUARTILES, "median_without_one": (other, 0.5)})


def claim_kinds(long: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """The same by kind; a claim may be of several kinds, each given by a regular expression."""
    tags = F.filter(F.array(*(F.when(F.col("claim").rlike(p), F.lit(k)) for k, p in kinds.items())), lambda t: t.isNotNull())
    each = long.withColumn("kind", F.explode(tags))
    by = each.groupBy("kind").agg(F.count("*").alias("claims"), F.count_distinct("id").alias("items"), F.min("value").alias("least"), F.max("value").alias("most"))
    return with_percentiles(by, each, ["kind"], _QUARTILES)


def log_edges(low: int = 0, high: int = 6) -> list[float]:
    """Bin edges 1, 2, 5 in each decade."""
    return [m * 10.0**e for e in range(low, high) for m in (1, 2, 5)] + [10.0**high]


def log_histogram(df: DataFrame, value: str, edges: Sequence[float]) -> DataFrame:
    """(bin, is_one, n): rows by left-closed bin, values of exactly one apart."""
    return df.select(bin_label(value, list(edges)).alias("bin"), (F.col(value) == 1).alias("is_one")).where("bin is not null").groupBy("bin", "is_one").agg(F.count("*").alias("n"))


def grid(df: DataFrame, group: str, band: str) -> DataFrame:
    """(group, band, n, row_share, column_share): all cells and both margins, from one cube; margins have null keys."""
    cells = df.cube(group, band).agg(F.count("*").alias("n"), F.grouping_id().alias("level"))
    rows = cells.where("level = 1").select(F.col(group).alias("_g"), F.col("n").alias("_row"))
    columns = cells.where("level = 2").select(F.col(band).alias("_b"), F.col("n").alias("_column"))
    inner = cells.where("level = 0").join(rows, F.col(group).eqNullSafe(F.col("_g"))).join(columns, F.col(band).eqNullSafe(F.col("_b")))
    return inner.select(group, band, "n", ratio("n", "_row").alias("row_share"), ratio("n", "_column").alias("column_share"))


def grid_cuts(df: DataFrame, group: str, band: str, item: str, cuts: dict[str, Column], top: int = 2) -> DataFrame:
    """(cut, group, band, n, row_share, column_share, top): the grid under several cuts, with the most frequent items of each cell.

    A row is exploded to the cuts that it belongs to and counted once, by grouping sets over cells, margins and
    items. ``top`` is an array of (item, n), by number and then by name; it is taken from a cell's counts,
    one for each of the item's values. Cells without rows are left out; a null condition does not hold.
    """
    tags = F.filter(F.array(*(F.when(c, F.lit(k)) for k, c in cuts.items())), lambda t: t.isNotNull())
    each = df.select(F.explode(tags).alias("cut"), F.col(group).alias("_g"), F.col(band).alias("_b"), F.col(item).alias("_i"))
    cut, g, b, i = (F.col(c) for c in ("cut", "_g", "_b", "_i"))
    counts = each.groupingSets([(cut, g, b, i), (cut, g, b), (cut, g), (cut, b)], cut, g, b, i).agg(F.count("*").alias("n"), F.grouping_id().alias("_l"))
    level = lambda bits, n: counts.where(F.col("_l") == bits).withColumnRenamed("n", n)
    items = level(0, "n").groupBy("cut", "_g", "_b").agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), F.col("_i").alias("i")))), 1, top), lambda x: F.struct(x["i"].alias("item"), (-x["k"]).alias("n"))).alias("top"))
    named = lambda part, *keys: part.withColumnsRenamed({k: f"{k}_" for k in keys})
    same = lambda *keys: [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys]
    rows, columns = named(level(3, "_row").select("cut", "_g", "_row"), "cut", "_g"), named(level(5, "_column").select("cut", "_b", "_column"), "cut", "_b")
    met = level(1, "n").select("cut", "_g", "_b", "n").join(rows, same("cut", "_g")).drop("cut_", "_g_").join(columns, same("cut", "_b")).drop("cut_", "_b_")
    met = met.join(named(items, "cut", "_g", "_b"), same("cut", "_g", "_b"))
    return met.select("cut", g.alias(group), b.alias(band), "n", ratio("n", "_row").alias("row_share"), ratio("n", "_column").alias("column_share"), "top")


def usage_cost(usage: DataFrame, prices: DataFrame, model: str, kinds: Sequence[str]) -> DataFrame:
    """By model: tokens of each kind and their list price per million, and the reported cost, null if none was reported."""
    sums = usage.groupBy(model).agg(F.count("*").alias("calls"), *(F.sum(k).alias(k) for k in kinds), F.sum(F.expr("try_cast(reported as decimal(38,9))")).alias("reported"))
    cost = sum((F.coalesce(F.col(k), F.lit(0)) * F.col(f"{k}_price") for k in kinds[1:]), F.coalesce(F.col(kinds[0]), F.lit(0)) * F.col(f"{kinds[0]}_price"))
    return sums.join(prices, model, "left").select(model, "calls", *kinds, (cost / 1e6).alias("list_cost"), F.col("reported").cast("double").alias("reported"))


def what_if_price(series: DataFrame, prices: DataFrame, prompt: str, requests: str, out_tokens: int = 10) -> DataFrame:
    """The same prompts on every model of a small price table."""
    return series.crossJoin(F.broadcast(prices)).withColumn("usd", (F.col(prompt) * F.col("prompt_price") + F.col(requests) * out_tokens * F.col("completion_price")) / 1e6)


def series_ratio(series: DataFrame, day: str, key: str, value: str, peer: str, first: str, last: str) -> DataFrame:
    """Days of a closed range, each key's value and its ratio to the peer's on that day."""
    kept = series.where(F.col(day).cast("date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    base = kept.where(F.col(key) == peer).select(day, F.col(value).alias("_peer"))
    return kept.join(base, day, "left").select(day, key, value, ratio(value, "_peer").alias("ratio"))


def ratio_summary(pairs: DataFrame, kind: str, own: str, other: str, drop: Column | None = None) -> DataFrame:
    """By kind: median, least and most of other / own."""
    kept = pairs if drop is None else pairs.where(~drop)
    each = kept.withColumn("_r", ratio(other, own)).where("_r is not null")
    by = each.groupBy(kind).agg(F.count("*").alias("n"), F.min("_r").alias("least"), F.max("_r").alias("most"))
    return with_percentiles(by, each, [kind], {"median": ("_r", 0.5)})


def mean_vs_median(df: DataFrame, grade: str, value: str, top: str, base: str) -> DataFrame:
    """One row: mean and median of two grades and the ratios between the grades."""
    two = df.where(F.col(grade).isin(top, base))
    by = with_percentiles(two.groupBy(grade).agg(F.avg(value).alias("mean")), two, [grade], {"median": (value, 0.5)})
    two = by.groupBy(F.lit(1).alias("one")).pivot(grade, [top, base]).agg(F.max("mean").alias("mean"), F.max("median").alias("median"))
    return two.select(*(F.col(f"`{g}_{s}`").alias(f"{s}_{n}") for n, g in (("top", top), ("base", base)) for s in ("mean", "median")), ratio(F.col(f"`{top}_mean`"), F.col(f"`{base}_mean`")).alias("mean_ratio"), ratio(F.col(f"`{top}_median`"), F.col(f"`{base}_median`")).alias("median_ratio"))


def bucket_table(df: DataFrame, bucket: Column, measures: Sequence[str], second: Column) -> DataFrame:
    """By bucket of a cascade: count, shares of rows and measures, and the share in a second base."""
    tagged = df.withColumn("bucket", bucket)
    by = tagged.groupBy("bucket").agg(F.count("*").alias("n"), *(F.sum(m).alias(f"sum_{m}") for m in measures), count_if(second).alias("n_second"))
    base = df.agg(count_if(second).alias("_second"))
    return with_shares(by, _totals(df, measures), measures).crossJoin(F.broadcast(base)).withColumn("share_second", ratio("n_second", "_second")).drop("_second")


def bucket_explain(df: DataFrame, bucket: Column, name: str, clauses: dict[str, Column]) -> DataFrame:
    """One row: rows of a bucket, and for each clause those that only this clause put there."""
    only = {k: c & ~F.coalesce(_any([o for j, o in clauses.items() if j != k]), F.lit(False)) for k, c in clauses.items()}
    return df.withColumn("_bucket", bucket).where(F.col("_bucket") == name).agg(F.count("*").alias("n"), *(count_if(c).alias(f"only_{k}") for k, c in only.items()))


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | F.coalesce(c, F.lit(False))
    return out


def tally(df: DataFrame, key: str, unit: str) -> DataFrame:
    """By key: rows and distinct units, the largest first."""
    return df.groupBy(key).agg(F.count("*").alias("n"), F.count_distinct(unit).alias("units"))


def share_before(df: DataFrame, day: str, cut: str, measures: Sequence[str]) -> DataFrame:
    """One row: share of rows and of each measure up to and with a day."""
    early = F.col(day) <= F.lit(cut).cast("date")
    return df.agg(ratio(count_if(early), F.count("*")).alias("share_n"), *(ratio(F.coalesce(F.sum(F.when(early, F.col(m))), F.lit(0)), F.sum(m)).alias(f"share_{m}") for m in measures))


def set_shares(df: DataFrame, sets: dict[str, Column]) -> DataFrame:
    """One row: share of rows in each named set."""
    return df.agg(*(F.avg(F.coalesce(c, F.lit(False)).cast("double")).alias(k) for k, c in sets.items()))


def group_profile(df: DataFrame, key: str, conditions: dict[str, Column]) -> DataFrame:
    """By key: count, count of each condition and its share of the key."""
    return df.groupBy(key).agg(F.count("*").alias("n"), *(count_if(c).alias(f"n_{k}") for k, c in conditions.items()), *(ratio(count_if(c), F.count("*")).alias(f"share_{k}") for k, c in conditions.items()))


def stats_by(df: DataFrame, key: str | Column, name: str, measures: Sequence[str]) -> DataFrame:
    """By key: count, sums, medians and shares of the whole; for days, languages and other values."""
    return distribution(df.withColumn(name, col(key)), name, measures)
