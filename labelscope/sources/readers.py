"""Readers and writers with explicit schemas; nothing is inferred."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from labelscope.functions.columns import as_flag


def read_feed(spark: SparkSession, path: str, meta: StructType, card: StructType, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """(meta, posts) of feed documents with an object ``meta`` and a list ``cards``, one a file or, with ``lines``, one a line; a document without either is an error."""
    schema = StructType([StructField("meta", meta), StructField("cards", ArrayType(card))])
    raw = spark.read.schema(schema).json(path, multiLine=not lines)
    if raw.where("meta IS NULL OR cards IS NULL").limit(1).count():
        raise ValueError(f"{path}: a feed document lacks meta or a list of cards")
    return raw.select("meta.*"), raw.select(F.explode("cards").alias("c")).select("c.*")


def read_labels(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """JSON lines; blank lines are skipped and an absent path is an empty table."""
    try:
        return spark.read.schema(schema).json(path).dropna("all")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_labels_tolerant(spark: SparkSession, path: str, schema: StructType, id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """(rows, bad): lines that do not parse, and rows without an id, go to ``bad``."""
    whole = StructType([*schema.fields, StructField("_bad", StringType())])
    raw = spark.read.schema(whole).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    ok = F.col("_bad").isNull() & F.col(id_col).isNotNull()
    rows = raw.select("*").where(ok).drop("_bad")
    bad = raw.where(~ok).select(F.coalesce("_bad", F.to_json(F.struct(*(f.name for f in schema.fields)))).alias("line"))
    return rows, bad


def read_table_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """CSV with a header, doubled quotes and line ends inside quotes."""
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, quote='"', escape='"')


def read_label_csv(spark: SparkSession, path: str, schema: StructType, required: str, flags: Sequence[str] = ()) -> DataFrame:
    """A filled label sheet: values trimmed, empty ones null, flags as booleans, rows without the required field skipped."""
    raw = read_table_csv(spark, path, StructType([StructField(f.name, StringType()) for f in schema.fields]))
    clean = raw.select(*(F.when(F.trim(c) != "", F.trim(c)).alias(c) for c in raw.columns)).where(F.col(required).isNotNull())
    return clean.select(*(as_flag(c).alias(c) if c in flags else F.col(c) for c in clean.columns))


def read_label_batches(spark: SparkSession, paths: str | list[str], schema: StructType, overrides: DataFrame | None = None, id_col: str = "id") -> DataFrame:
    """Batch files as one table: of an id's rows the last line of the last file counts, and an override replaces the whole row.

    A line's place is the start of its file's block and its number within the task that reads the block.
    """
    place = F.struct(F.lit(0).alias("p"), F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("n"))
    rows = spark.read.schema(schema).json(paths).select("*", place.alias("_at")).where(F.col(id_col).isNotNull())
    if overrides is not None:
        over = F.struct(F.lit(1).alias("p"), F.lit("").alias("f"), F.lit(0).cast("long").alias("b"), F.monotonically_increasing_id().alias("n"))
        rows = rows.unionByName(overrides.withColumn("_at", over))
    others = [f.name for f in schema.fields if f.name != id_col]
    return rows.groupBy(id_col).agg(F.max_by(F.struct(*others), "_at").alias("_b")).select(id_col, *(F.col(f"_b.{c}").alias(c) for c in others))


def write_table(df: DataFrame, path: str, digits: int = 6, format: str = "parquet", order: Sequence[str] = ()) -> None:
    """A table with doubles rounded; in CSV null is empty.

    With an order, a CSV is one sorted file, for tables that are published to be read: totals,
    estimates and the like, of a few rows by class. Without one each task writes its own part.
    """
    out = df.select(*(F.round(c, digits).alias(c) if kind in ("double", "float") else F.col(f"`{c}`") for c, kind in df.dtypes))
    if format == "csv":
        out = out.coalesce(1).sortWithinPartitions(*order) if order else out
        out.write.csv(path, header=True, nullValue="", quote='"', escape='"')
    else:
        out.write.parquet(path)


def metrics(df: DataFrame, prefix: str = "") -> DataFrame:
    """A table of one row as (key, value)."""
    return df.select(*(F.col(c).cast("double").alias(f"{prefix}{c}") for c in df.columns)).withColumn("_k", F.lit(1)).unpivot(["_k"], [f"{prefix}{c}" for c in df.columns], "key", "value").drop("_k")


def publish(df: DataFrame, root: str, name: str, version: str) -> str:
    """Write a new version beside the others, then point to it; readers never see a half-written table.

    A version is written once: to write one that exists is an error, so a retry after a lost
    driver takes a new version.
    """
    path = f"{root}/{name}/version={version}"
    df.write.mode("error").parquet(path)
    point_to(df.sparkSession, root, name, version)
    return path


def point_to(spark: SparkSession, root: str, name: str, version: str) -> None:
    """Make a written version, new or old, the one that readers get: the latest pointer counts, whatever the version is called."""
    spark.range(1, numPartitions=1).select(F.lit(name).alias("name"), F.lit(version).alias("version"), F.unix_micros(F.current_timestamp()).alias("at")).write.mode("append").parquet(f"{root}/_current")


def published(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The version of a table that was pointed to last."""
    newest = spark.read.schema("name string, version string, at long").parquet(f"{root}/_current").where(F.col("name") == name).agg(F.max_by("version", F.struct("at", "version"))).first()[0]
    if newest is None:
        raise ValueError(f"{name} was never published")
    return spark.read.parquet(f"{root}/{name}/version={newest}")


def manifest(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, bytes, sha256) of files, hashed where they lie."""
    files = spark.read.format("binaryFile").load(paths)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


#: Bytes of a range that a file's hash is built from.
RANGE_BYTES = 64 << 20


def tree_hashes(spark: SparkSession, paths: str | list[str], size: int = RANGE_BYTES) -> DataFrame:
    """(path, bytes, ranges, sha256) of files of any size: the hash of the hashes of their ranges of ``size`` bytes, in order.

    Ranges are read by many tasks and each holds one range; only 32 bytes a range are gathered by
    file. An empty file has one empty range. Read through Arrow's file systems, which have to know the paths.
    """
    found = spark.read.format("binaryFile").load(paths)
    listed = spark.createDataFrame([(re.sub(r"^file:/+", "file:/", unquote(p)),) for p in found.inputFiles()], "path string")  # with the empty ones, which a scan leaves out
    files = listed.join(found.select(F.regexp_replace("path", "^file:/+", "file:/").alias("path"), "length"), "path", "left").select("path", F.coalesce("length", F.lit(0)).alias("bytes"))  # contents are not read
    number = F.greatest(F.ceil(F.col("bytes") / size), F.lit(1)).cast("long")
    each = files.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), number - 1)).alias("at"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path, length, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, place = fs.FileSystem.from_uri(quote(path, safe="/:"))
                with store.open_input_file(place) as f:
                    found.append(hashlib.sha256(f.read_at(max(0, min(size, length - at * size)), at * size)).digest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], names=["path", "bytes", "at", "digest"])

    hashed = each.repartition("path", "at").mapInArrow(digests, "path string, bytes long, at long, digest binary")
    parts = F.array_sort(F.collect_list(F.struct("at", F.hex("digest").alias("d"))))
    return hashed.groupBy("path", "bytes").agg(F.count("*").alias("ranges"), F.sha2(F.unhex(F.array_join(F.transform(parts, lambda p: p["d"]), "")), 256).alias("sha256"))


def table_manifest(df: DataFrame, group: str, emptied: Sequence[str]) -> DataFrame:
    """(group, rows, empty_<field>): rows and emptied fields of each part of a table."""
    return df.groupBy(group).agg(F.count("*").alias("rows"), *(F.count(F.when(F.coalesce(F.col(f), F.lit("")) == "", 1)).alias(f"empty_{f}") for f in emptied))
