"""Exact percentiles by group without the percentile aggregates, for groups that span many ranges."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from labelscope.operators import rank as R
from labelscope.operators import tables as T
from labelscope.plans.registry import queries


def linear(values, p):
    values = sorted(values)
    spot = (len(values) - 1) * p
    lo, hi = values[math.floor(spot)], values[math.ceil(spot)]
    return lo + (hi - lo) * (spot - math.floor(spot))


def nearest(values, p):
    return sorted(values)[max(0, math.ceil(p * len(values)) - 1)]


def rows_of(seed):
    """One group of very many distinct values, ties, single rows, nulls, negative values and a null key."""
    rng = random.Random(seed)
    rows = [("hot", rng.randrange(10**6), rng.random()) for _ in range(4000)]
    rows += [("ties", 5, 1.0)] * 50 + [("ties", 7, -2.0)] * 49 + [("one", 3, None), (None, 1, 2.0), (None, 4, 8.0), ("none", None, None)]
    rows += [(f"g{i % 40}", rng.randrange(-9, 9), rng.random()) for i in range(700)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("partitions", ["1", "16"])
def test_against_plain_python(spark, partitions):
    rows = rows_of(1)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "k string, a long, b double").repartition(3)
        wanted = {"a25": ("a", 0.25), "a50": ("a", 0.5), "a100": ("a", 1.0), "b90": ("b", 0.9), "near": ("a", 0.95, "nearest"), "low": ("a", 0.0, "nearest"), "even": (F.when(F.col("a") % 2 == 0, F.col("a")), 0.5)}
        got = {r.k: r for r in R.grouped_percentiles(df, ["k"], wanted).collect()}
        whole = R.grouped_percentiles(df, [], wanted).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    groups = {}
    for k, a, b in rows:
        g = groups.setdefault(k, ([], [], []))
        for column, v in zip(g, (a, b, a if a is not None and a % 2 == 0 else None), strict=True):
            if v is not None:
                column.append(v)
    everything = tuple(sum((g[i] for g in groups.values()), []) for i in range(3))
    assert set(got) == {k for k, g in groups.items() if any(g)} and len(whole) == 1
    for r, (a, b, e) in [(got[k], groups[k]) for k in got] + [(whole[0], everything)]:
        want = {"a25": linear(a, 0.25), "a50": linear(a, 0.5), "a100": max(a), "b90": linear(b, 0.9) if b else None, "near": nearest(a, 0.95), "low": min(a), "even": linear(e, 0.5) if e else None}
        for name, value in want.items():
            assert r[name] == value or abs(r[name] - value) < 1e-9, (r, name, value)


def test_a_group_lies_in_many_ranges(spark, monkeypatch):
    seen = []
    write = R.shared_table
    monkeypatch.setattr(R, "shared_table", lambda df, name: seen.append(write(df, name)) or seen[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame([("hot", i) for i in range(5000)], "k string, a long")
        assert R.grouped_percentiles(df, ["k"], {"m": ("a", 0.5)}).first().m == 2499.5
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    per_range = [r["count"] for r in seen[0].groupBy("_part").count().collect()]
    assert len(per_range) == 4 and max(per_range) < 2500


def test_no_rows_and_tables_without_values(spark):
    df = spark.createDataFrame([], "k string, a long")
    assert R.grouped_percentiles(df, ["k"], {"m": ("a", 0.5)}).count() == 0
    assert R.grouped_percentiles(df, [], {"m": ("a", 0.5)}).collect()[0].m is None
    assert T.claim_multiples(df.select(F.col("k").alias("id"), F.col("a").cast("double").alias("value"))).collect()[0].asDict() == {"claims": 0, "items": 0, "least": None, "most": None, "p25": None, "median": None, "p75": None, "median_without_one": None}


@pytest.mark.parametrize("name", ["e1_distribution", "e2_family_table", "e3_total_row", "e7_pivot_median", "e16_e17_group_rows", "e22_claim_multiples", "f11_f13_percentiles", "h23_call_stats"])
def test_no_percentile_aggregate_in_the_plan(spark, name):
    plan = queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "percentile(" not in plan and "median(" not in plan and "percentile_" not in plan
