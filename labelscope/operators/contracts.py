"""Checks that hold between tables, as tables of violations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def contracts(df: DataFrame, checks: dict[str, tuple[Column, Column]], tolerance: float = 1e-9) -> DataFrame:
    """(name, lhs, rhs, ok): pairs of aggregates over one table that must be equal; null is not ok."""
    one = df.agg(*(c.cast("double").alias(f"{n}_{s}") for n, two in checks.items() for s, c in zip("lr", two, strict=True)))
    rows = F.array(*(F.struct(F.lit(n).alias("name"), F.col(f"{n}_l").alias("lhs"), F.col(f"{n}_r").alias("rhs")) for n in checks))
    return one.select(F.explode(rows).alias("r")).select("r.*").withColumn("ok", F.coalesce(F.abs(F.col("lhs") - F.col("rhs")) <= tolerance, F.lit(False)))


def near(a: DataFrame, b: DataFrame, key: Sequence[str], value: str, tolerance: float = 1e-9) -> DataFrame:
    """Keys where two derivations differ, or that only one of them has."""
    met = a.select(*key, F.col(value).alias("a")).join(b.select(*key, F.col(value).alias("b")), list(key), "full")
    return met.where(~(F.coalesce(F.abs(F.col("a") - F.col("b")) <= tolerance, F.col("a").isNull() & F.col("b").isNull())))


def interval_violations(df: DataFrame, value: str, lo: str, hi: str, share: bool = False) -> DataFrame:
    """Rows whose value lies outside its interval, or whose interval leaves [0, 1] where it is a share's."""
    bad = (F.col(value) < F.col(lo)) | (F.col(value) > F.col(hi))
    if share:
        bad = bad | (F.col(lo) < 0) | (F.col(hi) > 1)
    return df.where(F.coalesce(bad, F.lit(False)))


def claims(values: DataFrame, bands: DataFrame) -> DataFrame:
    """(key, value, low, high, ok): stated numbers against their bands; a missing number is not ok."""
    return bands.join(values, "key", "left").select("key", "value", "low", "high", F.coalesce(F.col("value").between(F.col("low"), F.col("high")), F.lit(False)).alias("ok"))


def tables_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: rows only in each table, repeated rows counted, and whether the schemas agree."""
    same = [(f.name, f.dataType) for f in a.schema] == [(f.name, f.dataType) for f in b.schema]
    only_a = a.exceptAll(b.select(*a.columns)).agg(F.count("*").alias("only_a"))
    only_b = b.select(*a.columns).exceptAll(a).agg(F.count("*").alias("only_b"))
    return only_a.crossJoin(only_b).withColumn("same_schema", F.lit(same))


def unaccounted(files: DataFrame, shipped: DataFrame, excluded: DataFrame, path: str = "path") -> DataFrame:
    """(path, problem): files neither shipped nor excluded, both, or shipped without being there."""
    f, s, x = (t.select(path).distinct() for t in (files, shipped, excluded))
    return (
        f.join(s, path, "left_anti").join(x, path, "left_anti").withColumn("problem", F.lit("unaccounted"))
        .unionByName(s.join(x, path, "left_semi").withColumn("problem", F.lit("both")))
        .unionByName(s.join(f, path, "left_anti").withColumn("problem", F.lit("missing")))
    )


def invalid_values(df: DataFrame, id_col: str, domains: dict[str, Sequence[str]]) -> DataFrame:
    """(id, field, value): values outside their field's domain; null is no value."""
    spark = df.sparkSession
    allowed = spark.createDataFrame([(f, v) for f, vs in domains.items() for v in vs], "field string, value string")
    return df.unpivot([id_col], list(domains), "field", "value").where("value IS NOT NULL").join(F.broadcast(allowed), ["field", "value"], "left_anti").select(id_col, "field", "value")


def key_violations(df: DataFrame, allowed: Sequence[str], empty: Sequence[str]) -> DataFrame:
    """(field, problem, n): columns that should not be there, and texts that should be empty."""
    fields = [c for c in empty if c in df.columns]
    counts = df.agg(*(F.count(F.when(F.coalesce(F.col(c), F.lit("")) != "", 1)).alias(c) for c in fields), F.count("*").alias("_n"))
    rows = [F.struct(F.lit(c).alias("field"), F.lit("not empty").alias("problem"), F.col(c).alias("n")) for c in fields]
    rows += [F.struct(F.lit(c).alias("field"), F.lit("unexpected").alias("problem"), F.col("_n").alias("n")) for c in df.columns if c not in allowed]
    return counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*").where("n > 0") if rows else counts.select(F.lit("").alias("field"), F.lit("").alias("problem"), F.col("_n").alias("n")).limit(0)
