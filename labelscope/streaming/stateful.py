"""State of the label intake: first answers, rounds of requests, the budget's cut and late rows.

What has to be known of earlier batches is kept by the stream itself: in the state store by key, bounded by
the watermark, or as one small row a batch. No batch reads what earlier ones have stored.
Every outcome follows from the rows' own times, so it does not depend on where batches are cut as long as rows
come in the order of their times.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from labelscope.operators.rank import prefix_sums


def accepted_once(responses: DataFrame, horizon_s: int = 30 * 86400, late: str = "1 day", id_col: str = "id", order: str = "at") -> DataFrame:
    """A stream of valid answers with a status: the first of each id, by time and response, is accepted, others are duplicates.

    The state of an id is that it has been answered; it is dropped when the watermark is ``horizon_s``
    seconds past the id's last answer, so the state holds the ids of that time and no others. Of a
    batch's answers to one id a task holds the earliest row alone. Rows later than the watermark allows are
    dropped by the stream: split them off first (``split_late``).
    """
    names, place = responses.columns, [order, "response_id"]

    def first(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        known, last, best = state.exists, (state.get[0] if state.exists else 0), None
        for part in parts:
            last = max(last, int(part[order].max().timestamp() * 1000))
            if not known:
                part = part if best is None else pd.concat([best, part])
                part = part.sort_values(place, kind="stable")
                best, part = part.iloc[:1], part.iloc[1:]
            yield part[names].assign(status="duplicate")
        if best is not None:
            yield best[names].assign(status="accepted")
        state.update((last,))
        state.setTimeoutTimestamp(max(last + horizon_s * 1000, state.getCurrentWatermarkMs() + 1))

    schema = ", ".join(f"`{c}` {t}" for c, t in responses.dtypes)
    return responses.withWatermark(order, late).groupBy(id_col).applyInPandasWithState(first, f"{schema}, status string", "last long", "append", GroupStateTimeout.EventTimeTimeout)


class _Request:
    """One request's attempt, deadline in microseconds and outcome, moved by its events in the order of time."""

    def __init__(self, patience: int, rounds: int, attempt: int = 0, deadline: int = 0, over: bool = False) -> None:
        self.patience, self.rounds, self.attempt, self.deadline, self.over = patience, rounds, attempt, deadline, over
        self.out: list[tuple[int, str, int]] = []

    def pass_time(self, to: int, inclusive: bool) -> None:
        """The deadlines up to ``to`` go by: a retry for each, an error after the last round."""
        while self.attempt and not self.over and (self.deadline <= to if inclusive else self.deadline < to):
            if self.attempt >= self.rounds:
                self.over = True
                self.out.append((self.deadline, "error", self.attempt))
            else:
                self.attempt += 1
                self.out.append((self.deadline, "retry", self.attempt))
                self.deadline += self.patience

    def take(self, kind: str, at: int) -> None:
        self.pass_time(at, True)
        if kind == "request" and not self.attempt and not self.over:
            self.attempt, self.deadline = 1, at + self.patience
        elif kind in ("answered", "refused") and self.attempt and not self.over:
            self.over = True
            self.out.append((at, kind, self.attempt))


_ORDER = {"request": 0, "refused": 1, "answered": 2}


def request_rounds(events: DataFrame, patience_s: int, rounds: int = 3, late: str = "1 hour", id_col: str = "id") -> DataFrame:
    """(id, at, outcome, attempt): what becomes of each request in a stream of (id, kind, at).

    Kinds are ``request``, ``answered`` and ``refused``; other rows only move the time. A request that is not
    answered within ``patience_s`` seconds is sent again (``retry``), and after the last of its rounds it is an
    ``error``. A refused one never returns, nor does one that has ended. Answers to what nobody
    asked for and second requests do nothing. The attempt and its timer are state; timers fire when the
    watermark passes them, and before any later event of the request, so outcomes do not depend on batches.
    """
    patience = patience_s * 1_000_000

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        request = _Request(patience, rounds, *(state.get if state.exists else ()))
        if not state.hasTimedOut:
            rows = [r for part in parts for r in zip(part["at_us"].astype("int64"), part["kind"], strict=True) if r[1] in _ORDER]
            for at, kind in sorted(rows, key=lambda r: (r[0], _ORDER[r[1]])):
                request.take(kind, int(at))
        now = state.getCurrentWatermarkMs() * 1000
        request.pass_time(now, False)
        if request.over:
            state.update((request.attempt, 0, True))  # an ended request never returns
        elif request.attempt:
            state.update((request.attempt, request.deadline, False))
            state.setTimeoutTimestamp(max(-(-request.deadline // 1000), state.getCurrentWatermarkMs() + 1))
        if request.out:
            at, outcome, attempt = zip(*request.out, strict=True)
            yield pd.DataFrame({"id": [key[0]] * len(at), "at_us": at, "outcome": outcome, "attempt": attempt})

    rows = events.select(F.col(id_col).cast("long").alias("id"), "kind", F.col("at").cast("timestamp").alias("at")).withColumn("at_us", F.unix_micros("at")).withWatermark("at", late)
    out = rows.groupBy("id").applyInPandasWithState(step, "id long, at_us long, outcome string, attempt int", "attempt int, deadline long, over boolean", "append", GroupStateTimeout.EventTimeTimeout)
    return out.select("id", F.timestamp_micros("at_us").alias("at"), "outcome", "attempt")


def within_budget(answers: DataFrame, spent: float, cap: float, cost: str = "usd", order: tuple[str, ...] = ("at", "response_id")) -> DataFrame:
    """``answers`` with ``within``: whether the spend before an answer, in the order of time, is below the cap.

    So the cap is passed by one answer at most. The running sum goes over ranges of the order and no
    task holds more than one. Null costs are 0. ``spent`` is what earlier batches have spent.
    """
    summed = prefix_sums(answers.withColumn("_cost", F.coalesce(F.col(cost).cast("double"), F.lit(0.0))), [F.col(c) for c in order], {"_spent": "_cost"})
    return summed.withColumn("within", F.col("_spent") - F.col("_cost") + F.lit(float(spent)) < F.lit(float(cap))).drop("_cost", "_spent")


def _batch_rows(spark: SparkSession, path: str, schema: str, number: int) -> DataFrame:
    """The small rows that batches before ``number`` have left."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).parquet(path).where(F.col("batch") < number)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def write_batch(df: DataFrame, path: str, number: int) -> None:
    """Write a micro batch as its own partition; one that runs again replaces it."""
    df.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def intake(responses: DataFrame, requests: DataFrame, root: str, checkpoint: str, cap: float | None = None, cost: str = "usd", valid: Column | None = None, horizon_s: int = 30 * 86400, late: str = "1 day", id_col: str = "id") -> StreamingQuery:
    """Accepted answers to ``root``/labels, all others to ``root``/quarantine, each batch as a partition of its own.

    Strays (asked by nobody) and invalid answers need no state; first answers and duplicates come from the
    state store; what lies beyond the cap is ``over budget``. ``root``/spent has a row for each batch.
    """
    asked = requests.select(id_col).distinct().withColumn("_asked", F.lit(True))
    met = responses.join(asked, id_col, "left").select(*responses.columns, "_asked")
    ok = F.lit(True) if valid is None else F.coalesce(valid, F.lit(False))
    plain = met.where(F.col("_asked").isNull() | ~ok).select(*responses.columns, F.when(F.col("_asked").isNull(), "stray").otherwise("invalid").alias("status"))
    both = plain.unionByName(accepted_once(met.where(F.col("_asked") & ok).select(*responses.columns), horizon_s, late, id_col))

    def take(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        out = batch
        if cap is not None:
            spent = _batch_rows(spark, f"{root}/spent", "usd double, batch long", number).agg(F.coalesce(F.sum("usd"), F.lit(0.0))).first()[0]
            out = within_budget(batch, spent, cap, cost).withColumn("status", F.when(F.col("within"), F.col("status")).otherwise("over budget")).drop("within")
        out = out.persist()
        if cap is not None:
            write_batch(out.agg(F.coalesce(F.sum(F.when(F.col("status") != "over budget", F.col(cost).cast("double"))), F.lit(0.0)).alias("usd")), f"{root}/spent", number)
        write_batch(out.where("status = 'accepted'"), f"{root}/labels", number)
        write_batch(out.where("status <> 'accepted'"), f"{root}/quarantine", number)
        out.unpersist()

    return both.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def split_late(rows: DataFrame, root: str, checkpoint: str, time: str, window_s: int = 3600, late_s: int = 600) -> StreamingQuery:
    """Rows in time to ``root``/on_time, rows whose window had closed to ``root``/late, counts of both to ``root``/counts.

    A window is closed when its end is not after the watermark: the largest time of earlier batches less
    ``late_s`` seconds. The split comes before any aggregate, so nothing is dropped: on time and late are all
    rows. Counts are observed while the rows are written. Rows without a time are late.
    """

    def take(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        seen = _batch_rows(spark, f"{root}/counts", "on_time long, late long, latest timestamp, batch long", number)
        latest = seen.agg(F.unix_micros(F.max("latest"))).first()[0]
        at, step = F.col(time).cast("timestamp"), window_s * 1_000_000
        ends = F.floor(F.unix_micros(at) / step) * step + step  # window() would leave rows without a time out
        closed = F.coalesce(ends <= F.lit(latest - late_s * 1_000_000), F.lit(True)) if latest is not None else at.isNull()
        told = batch.withColumn("_late", closed).persist()
        observed = Observation()
        counted = told.observe(observed, F.count(F.when(~F.col("_late"), 1)).alias("on_time"), F.count(F.when(F.col("_late"), 1)).alias("late"), F.max(at).alias("latest"))
        write_batch(counted.where("NOT _late").drop("_late"), f"{root}/on_time", number)
        write_batch(told.where("_late").drop("_late"), f"{root}/late", number)
        told.unpersist()
        found = observed.get
        write_batch(spark.createDataFrame([(found["on_time"], found["late"], found["latest"])], "on_time long, late long, latest timestamp"), f"{root}/counts", number)

    return rows.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
