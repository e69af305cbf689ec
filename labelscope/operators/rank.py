"""Ranks, top-k and concentration without a global sort in one task.

Order-dependent sums go over a table that is range-partitioned by its order: each partition is
summed by itself and moved by the totals of the partitions before it, a table of one row per
partition. The partitioned table is written first, as range bounds are sampled and would differ
between two runs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelscope.functions.columns import col, ratio
from labelscope.sources.shared import shared_table


def top_k(df: DataFrame, by: str, id_col: str, k: int) -> DataFrame:
    """The k largest rows, ties to the smallest id, with their rank; only k rows are ranked."""
    first = df.orderBy(F.desc(by), id_col).limit(k)
    return first.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(by), id_col)))


def most_common(df: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """The k most frequent combinations, ties by the keys in order."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *keys).limit(k)


def prefix_sums(df: DataFrame, order: Sequence[Column], sums: dict[str, str | Column]) -> DataFrame:
    """``df`` with, for each named column, its sum over all rows before and with this one in the order.

    The order must be total. No task holds more than a range of it.
    """
    parts = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    parts = shared_table(parts, "ranges")
    totals = parts.groupBy("_part").agg(*(F.sum(c).alias(f"_{n}") for n, c in sums.items()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    moved = totals.select("_part", *(F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in sums))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = parts.join(F.broadcast(moved), "_part")  # one row per partition
    return met.select(*df.columns, *((F.sum(c).over(inside) + F.col(f"_{n}")).alias(n) for n, c in sums.items()))


def global_rank(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """``df`` with each row's place in a total order, from 1."""
    return prefix_sums(df, order, {name: F.lit(1).cast("bigint")})


def value_histogram(df: DataFrame, value: str, variant: Sequence[str] = ()) -> DataFrame:
    """(variant, value, n, mass): rows by value; a heavy tie is one row from here on."""
    return df.where(F.col(value).isNotNull()).groupBy(*variant, F.col(value).alias("value")).agg(F.count("*").alias("n"), F.sum(value).alias("mass"))


def cumulated(histogram: DataFrame) -> DataFrame:
    """The histogram from the largest value down with rows and mass before (c0, m0) and with (c1, m1) each value."""
    out = prefix_sums(histogram, [F.desc("value")], {"c1": "n", "m1": "mass"})
    return out.withColumns({"c0": F.col("c1") - F.col("n"), "m0": F.col("m1") - F.col("mass")})


def concentration(df: DataFrame, value: str, percents: Sequence[float]) -> DataFrame:
    """(percent, k, mass, share, least): the largest percent of rows, at least one, with their mass and smallest value."""
    hist = shared_table(cumulated(value_histogram(df, value)), "cumulated")
    whole = hist.agg(F.sum("n").alias("_n"), F.sum("mass").alias("_m"))
    wanted = whole.select("_n", "_m", F.explode(F.array(*(F.lit(float(p)) for p in percents))).alias("percent")).withColumn("k", F.greatest(F.lit(1).cast("bigint"), F.ceil(F.col("_n") * F.col("percent") / 100)))
    met = hist.join(F.broadcast(wanted), (F.col("c0") < F.col("k")) & (F.col("k") <= F.col("c1")))  # a few rows
    mass = F.col("m0") + (F.col("k") - F.col("c0")) * F.col("value")
    return met.select("percent", "k", mass.alias("mass"), ratio(mass, "_m").alias("share"), F.col("value").alias("least"))


def top_share(df: DataFrame, value: str, percent: float) -> DataFrame:
    return concentration(df, value, [percent]).select("share")


def gini(df: DataFrame, value: str, variant: Sequence[str] = ()) -> DataFrame:
    """One row (per variant): rows, mass and the Gini index; null for no mass.

    A value with c rows above it, n of its own and N in all adds value * n * (N - 2c - n).
    Variants are summed in one order, each by its own counters.
    """
    hist = value_histogram(df, value, variant)
    if not variant:
        hist = hist.withColumn("_v", F.lit(1))
    keys = list(variant) or ["_v"]
    out = prefix_sums(hist, [*(F.col(k) for k in keys), F.desc("value")], {"c": "n"})
    by = out.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("mass").alias("mass"), F.min(F.col("c") - F.col("n")).alias("_base"), F.sum(F.col("value").cast("double") * F.col("n") * (F.lit(0) - 2.0 * (F.col("c") - F.col("n")) - F.col("n"))).alias("_sum"))
    top = F.col("_sum") + F.col("mass").cast("double") * F.col("n") + 2.0 * F.col("_base") * F.col("mass").cast("double")
    return by.select(*variant, "n", "mass", ratio(top, F.col("n") * F.col("mass").cast("double")).alias("gini"))


def lorenz(df: DataFrame, value: str, id_col: str, points: int = 500) -> DataFrame:
    """(rank, value, share): the cumulated share by rank, thinned to about ``points`` rows."""
    ranked = shared_table(prefix_sums(df.where(F.col(value).isNotNull()).select(id_col, value), [F.desc(value), F.col(id_col)], {"rank": F.lit(1).cast("bigint"), "_m": value}), "lorenz")
    whole = ranked.agg(F.count("*").alias("_n"), F.sum(value).alias("_all"))
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / points))
    return ranked.crossJoin(F.broadcast(whole)).where((F.col("rank") - 1) % step == 0).select("rank", value, ratio("_m", "_all").alias("share"))


def items_holding(df: DataFrame, value: str, part: float = 0.5) -> DataFrame:
    """One row: the fewest items that hold a part of the mass."""
    hist = shared_table(cumulated(value_histogram(df, value)), "cumulated")
    goal = hist.agg((F.sum("mass") * part).alias("_goal"))
    met = hist.crossJoin(F.broadcast(goal)).where((F.col("m0") < F.col("_goal")) & (F.col("_goal") <= F.col("m1")))
    return met.select((F.col("c0") + F.ceil((F.col("_goal") - F.col("m0")) / F.col("value"))).cast("bigint").alias("items"))


def equal_count_bins(df: DataFrame, value: str, id_col: str, bins: int = 10) -> DataFrame:
    """``df`` with a bin of 1 to ``bins`` that cuts the ranks at linear quantiles; ties are ranked by id.

    The bin of rank r among n is max(1, ceil((r - 1) * bins / (n - 1))), which is not ``ntile``.
    """
    ranked = shared_table(global_rank(df.where(F.col(value).isNotNull()), [F.col(value), F.col(id_col)], "_r"), "ranked")
    n = ranked.agg(F.count("*").alias("_n"))
    place = F.ceil(F.try_divide((F.col("_r") - 1) * F.lit(float(bins)), F.col("_n") - 1))
    return ranked.crossJoin(F.broadcast(n)).withColumn("bin", F.greatest(F.lit(1).cast("bigint"), F.coalesce(place, F.lit(1)))).drop("_r", "_n")


def percentiles(df: DataFrame, value: str, ps: Sequence[float]) -> DataFrame:
    """(p, linear, nearest): exact percentiles of a whole column by both rules, from one range-partitioned histogram.

    Unlike the ``percentile`` aggregate, no task holds all distinct values.
    """
    hist = shared_table(prefix_sums(value_histogram(df, value).select("value", "n"), [F.col("value")], {"c1": "n"}), "cumulated").withColumn("c0", F.col("c1") - F.col("n"))
    n = hist.agg(F.sum("n").alias("_n")).where("_n > 0")
    wanted = n.select("_n", F.explode(F.array(*(F.lit(float(p)) for p in ps))).alias("p"))
    spot = (F.col("_n") - 1) * F.col("p")
    places = wanted.select("p", (spot - F.floor(spot)).alias("_w"), F.explode(F.array(F.struct(F.lit("lo").alias("k"), F.floor(spot).alias("i")), F.struct(F.lit("hi").alias("k"), F.ceil(spot).alias("i")), F.struct(F.lit("near").alias("k"), F.greatest(F.ceil(F.col("_n") * F.col("p")) - 1, F.lit(0)).alias("i")))).alias("_s"))
    met = hist.join(F.broadcast(places), (F.col("c0") <= F.col("_s.i")) & (F.col("_s.i") < F.col("c1")))  # three rows a percentile
    by = met.groupBy("p").agg(F.max("_w").alias("_w"), *(F.max(F.when(F.col("_s.k") == k, F.col("value"))).alias(k) for k in ("lo", "hi", "near")))
    return by.select("p", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("_w")).cast("double").alias("linear"), F.col("near").cast("double").alias("nearest"))


def grouped_percentiles(df: DataFrame, keys: Sequence[str], wanted: dict[str, tuple[str | Column, float] | tuple[str | Column, float, str]]) -> DataFrame:
    """(keys, one column for each name): exact percentiles by group, as (value, p) by the linear rule or as (value, p, "nearest").

    All values share one histogram over (group, value), range-partitioned by both, so that a group of
    very many values lies in many tasks: places are counted inside each range and moved by the totals of
    the group's earlier ranges. Unlike the ``percentile`` aggregates, no task holds a group's values.
    Null values do not count; a group without others is left out. Null keys are a group. Without keys
    the whole table is one group, a row of nulls if it has no values.
    """
    values = {v if isinstance(v, str) else name: v for name, (v, *_) in wanted.items()}
    number = {k: i for i, k in enumerate(values)}
    own = [f"_k{i}" for i in range(len(keys))]
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("m"), col(v).cast("double").alias("v")) for i, v in enumerate(values.values()))))
    long = df.select(*(F.col(f"`{k}`").alias(o) for k, o in zip(keys, own, strict=True)), each.alias("_e")).select(*own, F.col("_e.m").alias("_m"), F.col("_e.v").alias("_v")).where("_v is not null")
    hist = long.groupBy(*own, "_m", "_v").agg(F.count("*").alias("_n"))
    parts = shared_table(hist.repartitionByRange(*own, "_m", "_v").withColumn("_part", F.spark_partition_id()), "ranges")
    group = [*own, "_m"]
    totals = parts.groupBy(*group, "_part").agg(F.sum("_n").alias("_sum"))  # a row for each group and each range that it spans
    before = F.sum("_sum").over(Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    moved = totals.select(*(F.col(c).alias(f"{c}_") for c in (*group, "_part")), F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_sum").over(Window.partitionBy(*group)).alias("_all"))
    same = [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in (*group, "_part")]
    met = parts.join(moved, same)
    to = F.sum("_n").over(Window.partitionBy(*group, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("_before")
    placed = met.withColumn("_to", to).withColumn("_from", F.col("_to") - F.col("_n"))

    def at(m: int, place: Column) -> Column:
        return F.max(F.when((F.col("_m") == m) & (F.col("_from") <= place) & (place < F.col("_to")), F.col("_v")))

    picks, found = [], []
    for i, (name, (v, p, *rule)) in enumerate(wanted.items()):
        m = number[v if isinstance(v, str) else name]
        if rule == ["nearest"]:
            picks.append(at(m, F.greatest(F.ceil(F.col("_all") * F.lit(float(p))) - 1, F.lit(0))).alias(f"_lo{i}"))
            found.append(F.col(f"_lo{i}").alias(name))
        else:
            spot = (F.col("_all") - 1) * F.lit(float(p))
            part = F.max(F.when(F.col("_m") == m, spot - F.floor(spot)))
            picks += [at(m, F.floor(spot)).alias(f"_lo{i}"), at(m, F.ceil(spot)).alias(f"_hi{i}"), part.alias(f"_w{i}")]
            found.append((F.col(f"_lo{i}") * (1 - F.col(f"_w{i}")) + F.col(f"_hi{i}") * F.col(f"_w{i}")).alias(name))
    return placed.groupBy(*own).agg(*picks).select(*(F.col(o).alias(k) for k, o in zip(keys, own, strict=True)), *found)


def with_percentiles(table: DataFrame, df: DataFrame, keys: Sequence[str], wanted: dict[str, tuple]) -> DataFrame:
    """``table``, one row a group of ``df``, with the groups' percentiles; null for groups without values."""
    found = grouped_percentiles(df, keys, wanted).withColumnsRenamed({k: f"_of_{k}" for k in keys})
    if not keys:
        found, table = found.withColumn("_of_all", F.lit(1)), table.withColumn("_all_rows", F.lit(1))
    same = [F.col(f"`{k}`").eqNullSafe(F.col(f"`_of_{k}`")) for k in keys] or [F.col("_all_rows") == F.col("_of_all")]
    return table.join(found, same, "left").drop(*(f"_of_{k}" for k in keys), "_of_all", "_all_rows")
