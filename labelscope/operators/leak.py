"""Publication safety: redaction, secret and probe searches, normal forms and readings of texts."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructField, StructType

from labelscope.functions.columns import col, windows
from labelscope.operators.leak_scan import INVISIBLE, MARKS, readings
from labelscope.sources.shared import shared_table


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility normal form, which Spark has no function for."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def normalised(text: str | Column, compatibility: bool = True) -> Column:
    """Lower-cased text with plain quotes and dashes, no zero-width characters and single spaces.

    Only texts with other than ASCII characters go through the compatibility form.
    """
    t = F.coalesce(col(text), F.lit(""))
    if compatibility:
        t = F.when(t.rlike(r"[^\x00-\x7F]"), nfkc(t)).otherwise(t)
    t = F.translate(t, "".join(MARKS), "".join(MARKS.values()))
    t = F.regexp_replace(t, INVISIBLE.pattern, "")
    return F.lower(F.trim(F.regexp_replace(t, r"(?U)\s+", " ")))


def shingles(text: Column, length: int, step: int) -> Column:
    """Windows of ``length`` characters every ``step``, the last one at the end; shorter texts have none."""
    return F.array_distinct(windows(text, length, lambda last: F.concat(F.sequence(F.lit(1), last, F.lit(step)), F.array(last))))


def window_hashes(text: str | None, length: int) -> np.ndarray:
    """A 64-bit hash of each window of ``length`` characters, computed for all windows at once."""
    chars = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(chars) - length + 1
    if n < 1:
        return np.empty(0, np.int64)
    h = np.full(n, 0xCBF29CE484222325, np.uint64)
    for k in range(length):
        h = (h ^ chars[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return h.view(np.int64)


#: Distinct hashes of an index that are sent to every task, 16 MB; windows of a larger index are exchanged.
SENT_HASHES = 2_000_000


def _holding(plain: DataFrame, index: DataFrame, length: int) -> DataFrame:
    """(hay, owner, shingle): texts ``_t`` that contain a shingle, found by the hash of its first ``length`` characters."""

    def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [int(window_hashes(t, length)[0]) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int64())], names=["owner", "shingle", "_h"])

    keyed = shared_table(index.mapInArrow(keys_of, f"owner {index.schema['owner'].dataType.simpleString()}, shingle string, _h long"), "index")
    hashes = keyed.select("_h").distinct()
    known = np.sort(np.array([r[0] for r in hashes.collect()], np.int64)) if hashes.count() <= SENT_HASHES else None
    sent = plain.sparkSession.sparkContext.broadcast(known)

    def windows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [np.unique(window_hashes(t, length)) for t in batch.column(1).to_pylist()]
            if sent.value is not None:
                each = [h[np.isin(h, sent.value, assume_unique=True, kind="sort")] if len(h) > len(sent.value) else h[_held(h, sent.value)] for h in each]
            if each:
                rows = pa.array(np.repeat(np.arange(len(each)), [len(h) for h in each]))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), pa.array(np.concatenate(each))], names=["hay", "_h"])

    met = plain.mapInArrow(windows_of, f"hay {plain.schema['hay'].dataType.simpleString()}, _h long")
    found = met.join(keyed, "_h").select("hay", "owner", "shingle").distinct()
    return found.join(plain, "hay").where(F.col("_t").contains(F.col("shingle"))).select("hay", "owner", "shingle")


def _held(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which hashes are among the sorted known ones."""
    at = np.searchsorted(known, hashes)
    return (at < len(known)) & (known[np.minimum(at, len(known) - 1)] == hashes) if len(known) else np.zeros(len(hashes), bool)


@F.pandas_udf(ArrayType(StructType([StructField("view", StringType()), StructField("text", StringType())])))
def _readings(text: pd.Series) -> pd.Series:
    return text.map(lambda raw: [{"view": k, "text": t.encode("utf-8", "replace").decode()} for k, t in readings(raw)])


def views(raw: str | Column) -> Column:
    """The readings of a raw text that a leak could hide in, as ``leak_scan.readings`` has them; null is empty."""
    return _readings(col(raw))


def redact(df: DataFrame, rules: dict[str, str], marker: str = "[removed]") -> DataFrame:
    """``df`` with text fields rewritten by name: empty, mark (non-empty texts only) or drop; numbers and flags stay.

    Works through structs and arrays of structs from the schema alone.
    """

    def rewrite(value: Column, kind: DataType, name: str) -> Column:
        rule = rules.get(name)
        if isinstance(kind, StructType):
            parts = [rewrite(value[f.name], f.dataType, f.name).alias(f.name) for f in kind.fields if rules.get(f.name) != "drop"]
            return F.when(value.isNotNull(), F.struct(*parts)) if parts else value
        if isinstance(kind, ArrayType) and (isinstance(kind.elementType, StructType) or rule):
            return F.transform(value, lambda x: rewrite(x, kind.elementType, name))
        if isinstance(kind, StringType) and rule == "empty":
            return F.when(value.isNotNull(), F.lit(""))
        if isinstance(kind, StringType) and rule == "mark":
            return F.when(value != "", F.lit(marker)).otherwise(value)
        return value

    return df.select(*(rewrite(F.col(f"`{f.name}`"), f.dataType, f.name).alias(f.name) for f in df.schema.fields if rules.get(f.name) != "drop"))


def redaction_report(before: DataFrame, rules: dict[str, str], group: str) -> DataFrame:
    """(group, field, emptied): non-empty texts that the rules take away, by dotted field, through structs and arrays.

    Follows the schema as ``redact`` does; what a dropped field holds counts under its own fields. Elements of
    arrays count each. Fields that no rule reaches are left out.
    """

    def counted(kind: DataType, name: str, path: str, dropped: bool) -> dict[str, Callable[[Column], Column]]:
        rule = rules.get(name)
        dropped = dropped or rule == "drop"
        if isinstance(kind, StructType):
            found = {}
            for f in kind.fields:
                for at, of in counted(f.dataType, f.name, f"{path}.{f.name}" if path else f.name, dropped).items():
                    found[at] = lambda v, f=f, of=of: F.when(v.isNotNull(), of(v[f.name])).otherwise(F.lit(0))
            return found
        if isinstance(kind, ArrayType):
            inner = counted(kind.elementType, name, path, dropped)
            return {at: lambda v, of=of: F.when(v.isNotNull(), F.aggregate(v, F.lit(0).cast("long"), lambda n, x: n + of(x))).otherwise(F.lit(0)) for at, of in inner.items()}
        if isinstance(kind, StringType) and (dropped or rule):
            return {path: lambda v: F.when(v != "", F.lit(1)).otherwise(F.lit(0)).cast("long")}
        return {}

    each = [F.struct(F.lit(at).alias("field"), of(F.col(f"`{f.name}`")).cast("long").alias("n")) for f in before.schema.fields if f.name != group for at, of in counted(f.dataType, f.name, f.name, False).items()]
    if not each:
        return before.select(group, F.lit("").alias("field"), F.lit(0).cast("long").alias("emptied")).limit(0)
    return before.select(group, F.explode(F.array(*each)).alias("e")).groupBy(group, F.col("e.field").alias("field")).agg(F.sum("e.n").alias("emptied"))


#: Patterns of secrets and personal data by kind.
SECRETS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "ip": r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b",
    "key": r"\b(?:sk|pk|ghp|AKIA)[-_A-Za-z0-9]{12,}\b",
}


def secret_scan(df: DataFrame, id_col: str, text: str, kinds: dict[str, str] = SECRETS) -> DataFrame:
    """(id, kind, n): matches of each kind in each text that has any."""
    found = F.array(*(F.struct(F.lit(k).alias("kind"), F.regexp_count(F.col(text), F.lit(p)).cast("bigint").alias("n")) for k, p in kinds.items()))
    return df.select(F.col(id_col).alias("id"), F.explode(found).alias("f")).where("f.n > 0").select("id", "f.kind", "f.n")


#: Probes are looked up by the hash of their first characters, as many as the largest of these that they have.
PROBE_LENGTHS = (32, 16, 8, 4, 2, 1)


def probe_search(files: DataFrame, file_id: str, text: str, probes: DataFrame, probe: str, allowed: DataFrame) -> DataFrame:
    """(file, probe): literal probes found in files that are not allowed to hold them, at any number of probes.

    ``allowed`` lists files, as (file), or single finds, as (file, probe). Each class of probe
    lengths is one pass of hashed windows; short probes meet more windows, but every find is verified.
    Null and empty probes and null texts find nothing; rows that
    repeat a file or a probe count once; a file without an id is not searched.
    """
    plain = files.where(F.col(text).isNotNull()).select(F.col(file_id).alias("hay"), F.col(text).alias("_t"))
    whole = "probe" not in allowed.columns
    if whole:
        plain = plain.join(allowed.select(F.col("file").alias("hay")), "hay", "left_anti")
    wanted = probes.select(F.col(probe).alias("shingle")).where(F.length("shingle") > 0).distinct()
    size = F.coalesce(*(F.when(F.length("shingle") >= n, n) for n in PROBE_LENGTHS))
    wanted = shared_table(wanted.select(size.alias("owner"), "shingle"), "probes")
    found = [_holding(plain, wanted.where(F.col("owner") == r[0]), r[0]) for r in wanted.select("owner").distinct().collect()]  # as many as PROBE_LENGTHS
    if not found:
        return plain.select(F.col("hay").alias("file"), F.lit("").alias("probe")).limit(0)
    met = found[0]
    for other in found[1:]:
        met = met.unionByName(other)
    met = met.select(F.col("hay").alias("file"), F.col("shingle").alias("probe")).distinct()
    return met if whole else met.join(allowed, ["file", "probe"], "left_anti")
