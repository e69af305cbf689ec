"""Label intake: answers are accepted once, strays and missing ones are told apart, spend is guarded.

The split is one plan over (responses, requests). As a stream it is ``stateful.intake``, which keeps what it
has to know of earlier batches as state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def split(responses: DataFrame, requests: DataFrame, valid: Column | None = None, id_col: str = "id", order: str = "at") -> DataFrame:
    """``responses`` with a status: accepted (the first valid answer to a request), duplicate, stray or invalid."""
    asked = responses.join(requests.select(F.col(id_col), F.lit(True).alias("_asked")), id_col, "left")
    ok = F.lit(True) if valid is None else F.coalesce(valid, F.lit(False))
    first = asked.where(F.col("_asked") & ok).groupBy(id_col).agg(F.min(F.struct(order, "response_id")).alias("_first"))
    met = asked.join(first, id_col, "left")
    status = F.when(F.col("_asked").isNull(), "stray").when(~ok, "invalid").when(F.struct(order, "response_id") == F.col("_first"), "accepted").otherwise("duplicate")
    return met.withColumn("status", status).drop("_asked", "_first")


def missing(requests: DataFrame, accepted: DataFrame, id_col: str = "id") -> DataFrame:
    """Requests without an accepted answer."""
    return requests.join(accepted.select(id_col), id_col, "left_anti")


def pending(items: DataFrame, labels: DataFrame, only: DataFrame | None = None, limit: int | None = None, id_col: str = "id") -> DataFrame:
    """Items not labelled yet, of a list if there is one, the smallest ids first up to a limit."""
    left = items.join(labels.select(id_col), id_col, "left_anti")
    left = left if only is None else left.join(only.select(id_col), id_col, "left_semi")
    return left if limit is None else left.orderBy(id_col).limit(limit)


def requeue(attempts: DataFrame, accepted: DataFrame, refused: DataFrame, rounds: int = 3, id_col: str = "id") -> DataFrame:
    """(id, attempt, next): open requests go to the next round, or to the errors after the last; refused ones never return."""
    open_ = attempts.join(accepted.select(id_col), id_col, "left_anti").join(refused.select(id_col), id_col, "left_anti")
    last = open_.groupBy(id_col).agg(F.max("attempt").alias("attempt"))
    return last.withColumn("next", F.when(F.col("attempt") < rounds, "retry").otherwise("error"))


def refusals(errors: DataFrame, mark: str = "content-filter", id_col: str = "id") -> DataFrame:
    """Ids whose error text holds the mark."""
    return errors.where(F.col("error").contains(mark)).select(id_col).distinct()


def dependent_field(df: DataFrame, kind: str, needs: str, field: str) -> DataFrame:
    """``df`` with the dependent field cleared where its kind takes none, and a flag where it is needed and absent."""
    of = F.col(kind).eqNullSafe(F.lit(needs))
    return df.withColumn("requeue", of & F.col(field).isNull()).withColumn(field, F.when(of, F.col(field)))


def budget_guard(usage: DataFrame, cap: float, cost: str = "usd") -> DataFrame:
    """One row: the spend so far and whether it has reached the cap."""
    return usage.agg(F.coalesce(F.sum(cost), F.lit(0.0)).alias("spent")).withColumn("stop", F.col("spent") >= cap)


def usage_ledger(usage: DataFrame, time: str, model: str, cost: str, latency: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, model, calls, failed, cost, p50, p95) by time window; the same plan in batch and as a stream.

    As a stream, the watermark decides which rows are too late for their window.
    """
    rows = usage.withColumn("_at", F.col(time).cast("timestamp")).withWatermark("_at", late)
    by = rows.groupBy(F.window("_at", window).alias("w"), F.col(model).alias("model"))
    return by.agg(
        F.count("*").alias("calls"), F.count(F.when(F.col("failed"), 1)).alias("failed"), F.sum(cost).alias("cost"),
        F.approx_percentile(latency, F.lit(0.5), F.lit(10000)).alias("p50"), F.approx_percentile(latency, F.lit(0.95), F.lit(10000)).alias("p95"),
    ).select(F.col("w.start").alias("start"), "model", "calls", "failed", "cost", "p50", "p95")


#: Columns of the stored answers.
STORED = "id long, response_id long, at timestamp, value string, usd double, status string, batch long"


def stored(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the intake; empty before its first batch."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(STORED).parquet(f"{root}/{name}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], STORED)
