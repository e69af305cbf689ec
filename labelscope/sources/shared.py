"""Tables in the folder that the driver and all executors share, used to cut lineage.

A table written here is read back by any executor, so a lost executor costs one
re-read and not a recomputation of everything upstream.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder where it is unset (local tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="labelscope-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def shared_table(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back with the same schema."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of any store that Spark can write to; a missing one is no error."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A writer of tables that one computation needs; they are deleted at its end, and each write's shuffle files with that write.

    What is written under a name twice is appended. What the computation returns has to be written elsewhere.
    """
    folder, option = f"{shared_dir(spark)}/tables/passing-{uuid.uuid4().hex}", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(option)
    spark.conf.set(option, "true")

    def write(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("append").parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    try:
        yield write
    finally:
        spark.conf.set(option, before)
        remove_path(spark, folder)


def clear_tables(spark: SparkSession) -> None:
    """Delete all intermediate tables in the shared folder. For the owner of the session, once results are written: tables that were not yet read are gone."""
    remove_path(spark, f"{shared_dir(spark)}/tables")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
