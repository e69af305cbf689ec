"""Helpers that several corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one piece of an Arrow batch; one longer text is a piece of its own.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20
_ROWS_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keep the Arrow batches that reach Python workers small, as texts can be long; a setting of the caller's own stays."""
    if spark.conf.get(_ROWS_KEY, "10000") == "10000":
        spark.conf.set(_ROWS_KEY, str(rows))


def pieces_of(batch: pa.RecordBatch, rows: int = BATCH_ROWS, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of at most ``rows`` rows and about ``most`` bytes."""
    for start in range(0, batch.num_rows, rows):
        todo = [batch.slice(start, rows)]
        while todo:
            piece = todo.pop()
            if piece.num_rows > 1 and piece.nbytes > most:
                half = piece.num_rows // 2
                todo += [piece.slice(half), piece.slice(0, half)]
            else:
                yield piece


def map_batches(df: DataFrame, make: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, rows: int = BATCH_ROWS) -> DataFrame:
    """``make`` applied to pieces of ``df`` of bounded rows and bytes where they lie: no shuffle, one piece in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces_of(batch, rows):
                out = make(piece)
                if out is not None and out.num_rows:
                    yield out

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def bucket_of(column: str, n: int):
    """The remainder of crc32 of the value as text."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


#: Rows of a balanced sample in all; many classes share it.
SAMPLE_TOTAL = 20_000
#: A table of classes up to this many rows is broadcast; a larger one is joined by a shuffle.
BROADCAST_CLASSES = 10_000


def bounded_sample(df: DataFrame, by: str, per_class: int, id_col: str, total: int = SAMPLE_TOTAL) -> DataFrame:
    """About ``per_class`` rows of each value of ``by``, fewer if there are very many values; about ``total`` rows and four a value at most.

    Rows are taken by the hash of their id, so the sample does not depend on how rows are dealt
    out, and a frequent class costs no sort: the share to keep follows from a count.
    """
    counts = df.groupBy(F.col(by).alias("_by")).agg(F.count("*").alias("_n"))
    classes = counts.count()
    if not classes:
        return df.limit(0)
    each = max(1, min(per_class, total // classes)) + 4  # so few that a value gets none by chance is rare
    counts = F.broadcast(counts) if classes <= BROADCAST_CLASSES else counts
    draw = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 30))
    # a row's draw as a part of its value's share, so that a limit takes from all values alike
    met = df.join(counts, F.col(by) == F.col("_by")).withColumn("_draw", draw / (F.lit(float(1 << 30)) * F.least(F.lit(1.0), F.lit(float(each)) / F.col("_n"))))
    return met.where("_draw < 1").orderBy("_draw", id_col, F.xxhash64(*df.columns)).limit(each * classes).select(*df.columns)
