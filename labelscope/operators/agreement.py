"""Agreement of raters: rates, kappa, confusion, precision and recall, calibration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelscope.functions.columns import bin_label, count_if, ratio, wilson
from labelscope.operators.rank import equal_count_bins, with_percentiles


def unpivoted(df: DataFrame, id_col: str, fields: Sequence[str], name: str = "field", value: str = "value") -> DataFrame:
    """(id, field, value) of the fields that have a value."""
    return df.unpivot([id_col], list(fields), name, value).where(F.col(value).isNotNull())


def confusion_long(pairs: DataFrame, a: str, b: str, by: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    """(by, a, b, w): the (weighted) number of items with each pair of labels; both labels must be there."""
    both = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return both.groupBy(*by, F.col(a).alias("a"), F.col(b).alias("b")).agg((F.count("*").cast("double") if weight is None else F.sum(weight)).alias("w"), F.count("*").alias("n"))


def kappa(confusion: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, agree, rate, kappa) from the long confusion; kappa is null where chance agreement is one.

    Works on counted tables, whose size is the number of classes squared, not of items.
    """
    keys = list(by) or ["_k"]
    long = confusion if by else confusion.withColumn("_k", F.lit(1))
    whole = long.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("w").alias("_w"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("agree"), F.sum(F.when(F.col("a") == F.col("b"), F.col("w")).otherwise(0.0)).alias("_same"))
    rows = long.groupBy(*keys, F.col("a").alias("c")).agg(F.sum("w").alias("_ra"))
    columns = long.groupBy(*keys, F.col("b").alias("c")).agg(F.sum("w").alias("_rb"))
    chance = rows.join(columns, [*keys, "c"]).groupBy(*keys).agg(F.sum(F.col("_ra") * F.col("_rb")).alias("_chance"))
    met = whole.join(chance, keys, "left").withColumn("_po", ratio("_same", "_w")).withColumn("_pe", F.coalesce(ratio("_chance", F.col("_w") * F.col("_w")), F.lit(0.0)))
    value = F.when(F.col("_pe") < 1, (F.col("_po") - F.col("_pe")) / (1 - F.col("_pe")))
    return met.select(*by, "n", "agree", F.col("_po").alias("rate"), value.alias("kappa"))


def pairwise(long: DataFrame, set_col: str, id_col: str, field: str, value: str) -> DataFrame:
    """(set_a, set_b, field, n, agree, rate, kappa) of all pairs of label sets on their common items."""
    a = long.select(F.col(set_col).alias("set_a"), id_col, field, F.col(value).alias("_a"))
    b = long.select(F.col(set_col).alias("set_b"), id_col, field, F.col(value).alias("_b"))
    met = a.join(b, [id_col, field]).where("set_a < set_b")
    keys = ["set_a", "set_b", field]
    return kappa(confusion_long(met, "_a", "_b", keys), keys)


def prf(confusion: DataFrame) -> DataFrame:
    """(value, support, predicted, hits, precision, recall, f1, top_other): a is the reference, b the answer.

    ``top_other`` is the most frequent wrong answer of the class, ties to the first in order.
    """
    rows = confusion.groupBy(F.col("a").alias("value")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("hits"))
    columns = confusion.groupBy(F.col("b").alias("value")).agg(F.sum("n").alias("predicted"))
    order = Window.partitionBy("a").orderBy(F.desc("n"), "b")
    others = confusion.where("a <> b").withColumn("_r", F.row_number().over(order)).where("_r = 1").select(F.col("a").alias("value"), F.col("b").alias("top_other"))
    met = rows.join(columns, "value", "full").join(others, "value", "left").na.fill(0, ["support", "hits", "predicted"])
    p, r = ratio("hits", "predicted"), ratio("hits", "support")
    return met.select("value", "support", "predicted", "hits", p.alias("precision"), r.alias("recall"), ratio(F.col("hits") * 2, F.col("support") + F.col("predicted")).alias("f1"), "top_other")


def class_jaccard(confusion: DataFrame) -> DataFrame:
    """(value, both, either, jaccard) of each class over two raters."""
    by = prf(confusion)
    return by.select("value", F.col("hits").alias("both"), (F.col("support") + F.col("predicted") - F.col("hits")).alias("either"), ratio("hits", F.col("support") + F.col("predicted") - F.col("hits")).alias("jaccard"))


def accuracy(long: DataFrame, reference: DataFrame, keys: Sequence[str], id_col: str, field: str, value: str) -> DataFrame:
    """(keys, field, n, agree, rate, lo, hi, kappa): label sets against a reference with a Wilson interval."""
    met = long.join(reference.select(id_col, field, F.col(value).alias("_ref")), [id_col, field])
    by = kappa(confusion_long(met, "_ref", value, [*keys, field]), [*keys, field])
    bounds = wilson("agree", "n")
    return by.select(*keys, field, "n", "agree", "rate", bounds["lo"].alias("lo"), bounds["hi"].alias("hi"), "kappa")


def calibration_fixed(df: DataFrame, prob: str, correct: Column, edges: Sequence[float]) -> DataFrame:
    """(bin, lo, hi, n, mean_prob, rate, share): left-closed bins, empty ones kept; null answers are not in the rate."""
    spark = df.sparkSession
    bins = spark.createDataFrame([(i, float(lo), float(hi)) for i, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False))], "bin int, lo double, hi double")
    by = df.select(bin_label(prob, list(edges)).alias("bin"), F.col(prob).alias("_p"), correct.cast("double").alias("_c")).groupBy("bin").agg(F.count("*").alias("n"), F.avg("_p").alias("mean_prob"), F.avg("_c").alias("rate"))
    whole = df.agg(F.count("*").alias("_n"))
    return bins.join(by, "bin", "left").na.fill(0, ["n"]).crossJoin(whole).select("bin", "lo", "hi", "n", "mean_prob", "rate", ratio("n", "_n").alias("share"))


def calibration_equal_count(df: DataFrame, prob: str, id_col: str, correct: Column, bins: int = 10) -> DataFrame:
    """(bin, n, least, most, mean_prob, rate) over bins of equally many items."""
    binned = equal_count_bins(df.withColumn("_c", correct.cast("double")), prob, id_col, bins)
    return binned.groupBy("bin").agg(F.count("*").alias("n"), F.min(prob).alias("least"), F.max(prob).alias("most"), F.avg(prob).alias("mean_prob"), F.avg("_c").alias("rate"))


def agreement_slices(df: DataFrame, a: str, b: str, slices: dict[str, Column]) -> DataFrame:
    """(slice, n, rate): agreement of two raters in each named slice."""
    tags = F.filter(F.array(*(F.when(c, F.lit(k)) for k, c in slices.items())), lambda t: t.isNotNull())
    each = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumn("slice", F.explode(tags))
    return each.groupBy("slice").agg(F.count("*").alias("n"), F.avg((F.col(a) == F.col(b)).cast("double")).alias("rate"))


def prevalence_corrected(df: DataFrame, label: str, hand: str, positive: str) -> DataFrame:
    """One row: share * PPV + (1 - share) * FOR, where the hand labels give PPV and FOR, and the hand share with its interval."""
    said, true = F.col(label) == positive, F.col(hand) == positive
    known = F.col(hand).isNotNull()
    one = df.agg(
        F.avg(said.cast("double")).alias("share"), ratio(count_if(said & true), count_if(said & known)).alias("ppv"), ratio(count_if(~said & true), count_if(~said & known)).alias("miss"),
        count_if(true).alias("k"), count_if(known).alias("n"),
    )
    bounds = wilson("k", "n")
    return one.select("share", "ppv", "miss", (F.col("share") * F.col("ppv") + (1 - F.col("share")) * F.col("miss")).alias("corrected"), bounds["p"].alias("hand"), bounds["lo"].alias("hand_lo"), bounds["hi"].alias("hand_hi"))


def overgrading(df: DataFrame, raters: Sequence[str], hand: str, positive: str) -> DataFrame:
    """(rater, positives, unconfirmed): positives that the hand label does not confirm, where there is one."""
    each = df.where(F.col(hand).isNotNull()).unpivot([hand], list(raters), "rater", "value").where(F.col("value") == positive)
    return each.groupBy("rater").agg(F.count("*").alias("positives"), count_if(F.col(hand) != positive).alias("unconfirmed"))


def against_two(df: DataFrame, human: str, a: str, b: str) -> DataFrame:
    """One row: items all three rated, where the human differs from both, and where both agree on something else."""
    all_ = F.col(human).isNotNull() & F.col(a).isNotNull() & F.col(b).isNotNull()
    return df.where(all_).agg(F.count("*").alias("n"), count_if((F.col(human) != F.col(a)) & (F.col(human) != F.col(b))).alias("differs_from_both"), count_if((F.col(a) == F.col(b)) & (F.col(a) != F.col(human))).alias("both_other"))


def recount_by_value(df: DataFrame, label: str, reference: str, weight: Column) -> DataFrame:
    """(value, base, audited, precision, lo, hi, weighted_precision, recall, weighted_recall)."""
    t = df.withColumn("_w", weight)
    base = t.groupBy(F.col(label).alias("value")).agg(F.count("*").alias("base"))
    audited = t.where(F.col(reference).isNotNull())
    same = F.col(label) == F.col(reference)
    said = audited.groupBy(F.col(label).alias("value")).agg(F.count("*").alias("audited"), count_if(same).alias("k"), ratio(F.sum(F.when(same, F.col("_w")).otherwise(0.0)), F.sum("_w")).alias("weighted_precision"))
    true = audited.groupBy(F.col(reference).alias("value")).agg(ratio(count_if(same), F.count("*")).alias("recall"), ratio(F.sum(F.when(same, F.col("_w")).otherwise(0.0)), F.sum("_w")).alias("weighted_recall"))
    bounds = wilson("k", "audited")
    return base.join(said, "value", "left").join(true, "value", "left").select("value", "base", "audited", bounds["p"].alias("precision"), bounds["lo"].alias("lo"), bounds["hi"].alias("hi"), "weighted_precision", "recall", "weighted_recall")


def recount_by_group(df: DataFrame, groups: dict[str, Column], positive: Column, reference_positive: Column, weight: Column) -> DataFrame:
    """(group, positives, confirmed, precision, weighted_precision, negatives, missed, miss_rate) of named predicates."""
    tags = F.filter(F.array(*(F.when(c, F.lit(k)) for k, c in groups.items())), lambda t: t.isNotNull())
    each = df.where(reference_positive.isNotNull()).withColumns({"group": F.explode(tags), "_p": positive, "_t": reference_positive, "_w": weight})
    said, hit, missed = F.col("_p"), F.col("_p") & F.col("_t"), ~F.col("_p") & F.col("_t")
    return each.groupBy("group").agg(
        count_if(said).alias("positives"), count_if(hit).alias("confirmed"), ratio(count_if(hit), count_if(said)).alias("precision"),
        ratio(F.sum(F.when(hit, F.col("_w")).otherwise(0.0)), F.sum(F.when(said, F.col("_w")).otherwise(0.0))).alias("weighted_precision"),
        count_if(~said).alias("negatives"), count_if(missed).alias("missed"), ratio(count_if(missed), count_if(~said)).alias("miss_rate"),
    )


def call_stats(calls: DataFrame, ok: Column, latency: str, kind: Column) -> DataFrame:
    """One row: calls, failures, error rate and latency percentiles of those that succeeded."""
    table = calls.agg(
        F.count("*").alias("calls"), count_if(ok).alias("ok"), count_if(~ok).alias("failed"), ratio(count_if(~ok), F.count("*")).alias("error_rate"),
        F.count_distinct(F.when(~ok, kind)).alias("kinds"),
    )
    good = calls.select(F.when(ok, F.col(latency)).alias("_good"))
    return with_percentiles(table, good, [], {f"p{int(p * 100)}": ("_good", p) for p in (0.5, 0.95, 0.99)})


def top_confusions(confusion: DataFrame, by: Sequence[str], k: int = 4) -> DataFrame:
    """(by, a, b, n, rank): the k most frequent unequal pairs of each key; ranks run over the counted table."""
    order = Window.partitionBy(*by).orderBy(F.desc("n"), "a", "b")
    return confusion.where("a <> b").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(*by, "a", "b", "n", "rank")


def reread_profile(first: DataFrame, second: DataFrame, id_col: str, code: str) -> DataFrame:
    """(code, n, same, moved, unread): items by their first code, and what a second reading made of them."""
    met = first.select(id_col, F.col(code).alias("code")).join(second.select(id_col, F.col(code).alias("_second")), id_col, "left")
    return met.groupBy("code").agg(F.count("*").alias("n"), count_if(F.col("_second") == F.col("code")).alias("same"), count_if(F.col("_second") != F.col("code")).alias("moved"), count_if(F.col("_second").isNull()).alias("unread"))
