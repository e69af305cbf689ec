"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from labelscope.sources.shared import shared_table


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on edges (u, v) with u > v.

    The minimum of a node's neighbourhood is an aggregate with map-side combine, and the
    edges are joined back to it, so a node with very many neighbours is never gathered.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("m"))
    met = both.join(low, "u")
    if large:
        moved = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges as a table of the shared folder, with their number and a digest counted while they are written."""
    seen = Observation()
    out = shared_table(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("digest")), "edges")
    return out, (seen.get["n"], seen.get["digest"])


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): every node of an edge and the smallest node it can reach.

    Null ends and loops are ignored, repeated edges count once; no edges give an empty table.
    Each step is written to the shared folder, so the lineage stays short.
    """
    now = (
        edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst)))
        .select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
        .distinct()
    )
    now, before = _written(now)
    while before[0]:
        now, after = _written(_star(_star(now, large=True), large=False))
        if after == before:
            break
        before = after
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
