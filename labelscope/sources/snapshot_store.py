"""A store of feed snapshots with a commit log: content is written first, and one entry that nobody else has makes it count.

``root``/data holds the content of each pull under a name of its own, ``root``/log one small entry a
commit, numbered without gaps. An entry is put under the next number only if that is free; a writer that finds
it taken reads the log again and decides anew, so of two writers one is first and none is lost.
Readers go by the log alone: content without an entry, of a writer that broke off, is never read.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import asdict, dataclass
from urllib.parse import unquote, urlparse

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelscope.operators.snapshots import content_digest
from labelscope.sources.shared import remove_path

LEAST_ROWS = 1000
ENTRY = "number long, name string, version string, digest string, rows long, path string"


@dataclass(frozen=True)
class Commit:
    """A snapshot that was kept: its place in the log, feed name, version, content digest, rows and path."""

    number: int
    name: str
    version: str
    digest: str
    rows: int
    path: str


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file whole, or not at all if its name is taken; whether it was written.

    On a local or mounted folder a hard link is made to a file that is complete; elsewhere Hadoop's
    rename without overwriting is used, which stores with atomic renames do in one step.
    """
    part = urlparse(path)
    if part.scheme in ("", "file"):
        place = unquote(part.path)
        os.makedirs(os.path.dirname(place), exist_ok=True)
        held = f"{os.path.dirname(place)}/.{uuid.uuid4().hex}"
        with open(held, "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(held, place)
        except FileExistsError:
            return False
        finally:
            os.unlink(held)
        return True
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    held = jvm.org.apache.hadoop.fs.Path(where.getParent(), f".{uuid.uuid4().hex}")
    fs = where.getFileSystem(conf)
    out = fs.create(held, False)
    out.write(bytearray(text, "utf-8"))
    out.close()
    none = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), conf).rename(held, where, none)
    except Exception as e:
        if "FileAlreadyExists" not in str(e):
            raise
        fs.delete(held, False)
        return False
    return True


class SnapshotStore:
    def __init__(self, spark: SparkSession, root: str, least: int = LEAST_ROWS) -> None:
        self.spark, self.root, self.least = spark, root.rstrip("/"), least

    def log(self) -> list[Commit]:
        """The commits in their order; a store without any is empty. One small row a snapshot."""
        try:
            rows = self.spark.read.schema(ENTRY).json(f"{self.root}/log/*.json").orderBy("number").collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        return [Commit(**r.asDict()) for r in rows]

    def keep(self, pull: DataFrame, name: str) -> tuple[str, Commit | None]:
        """(decision, commit) for a pull under its feed time.

        ``refused``: fewer than ``least`` rows. ``same content``: the name has this content already, whatever
        the order of its rows; nothing is written. Else ``new``: kept as version ``name``, or with a
        suffix where the name has other content. Content that another name has is not written again.
        """
        found = content_digest(pull).first()
        if found["n"] < self.least:
            return "refused", None
        digest, own = f"{found['n']}-{found['hash']}-{pull.schema.simpleString()}", None
        while True:
            log = self.log()
            same = [c for c in log if c.name == name and c.digest == digest]
            if same:
                if own is not None:
                    remove_path(self.spark, own)
                return "same content", same[0]
            path = own or next((c.path for c in log if c.digest == digest), None)
            if path is None:
                path = own = f"{self.root}/data/{uuid.uuid4().hex}"
                pull.write.parquet(path)
                continue  # the log may have grown meanwhile
            others = sum(c.name == name for c in log)
            commit = Commit(len(log), name, name if not others else f"{name}~{others + 1}", digest, found["n"], path)
            if put_if_absent(self.spark, f"{self.root}/log/{commit.number:012d}.json", json.dumps(asdict(commit))):
                if own is not None and path != own:
                    remove_path(self.spark, own)
                return "new", commit

    def read(self, version: str) -> DataFrame:
        """The content of a version."""
        for c in self.log():
            if c.version == version:
                return self.spark.read.parquet(c.path)
        raise KeyError(version)

    def snapshots(self) -> DataFrame:
        """All kept snapshots as one table, with their name, version and place in the log."""
        log = self.log()
        if not log:
            raise KeyError("the store is empty")
        out = None
        for c in log:
            part = self.spark.read.parquet(c.path).withColumns({"snapshot": F.lit(c.name), "version": F.lit(c.version), "number": F.lit(c.number)})
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        return out
