"""Near-duplicate documents: MinHash signatures and a multi-index Hamming join.

A document's shingle set gets a signature of ``CHUNKS * WIDTH`` symbols of 8 bits. Two
signatures that differ in at most ``LIMIT`` symbols differ in at most ``ERRORS`` symbols of at
least one chunk (pigeonhole), so they share one of the keys that a chunk gives when each
allowed error position is left out in turn. No pair within ``LIMIT`` is missed. Every pair
found is confirmed on the full shingle sets.

Groups of copies never become all their pairs. Equal sets are one class. Members of a key are
compared with one hub of the key; members that end in the hub's component need no further
comparison. What is left, members of one key in different components, is compared
completely, in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelscope.llm.common import map_batches
from labelscope.operators.components import connected_components
from labelscope.sources.shared import shared_table

CHUNKS, WIDTH, ERRORS = 21, 6, 1
SYMBOLS = CHUNKS * WIDTH
#: Largest number of differing symbols that the join guarantees to find. At a similarity of
#: 0.8 the expected number is 25.2 with a deviation of 4.5.
LIMIT = CHUNKS * (ERRORS + 1) - 1
#: Rows of one block of the complete comparison, and rows that one of its groups gathers.
BLOCK, BIN_ROWS = 1024, 8192
HUB_ROUNDS = 2
#: Keys that one task makes, about.
KEYS_OF_A_TASK = 2_000_000
#: Bits of a set's bitmap. A bit that only one of two sets has stands for an element that the
#: other lacks, which bounds their intersection from above; pairs under the bound are no links.
BITMAP = 1024


@lru_cache(1)
def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(1, 1 << 32, SYMBOLS, dtype=np.uint64).astype(np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, SYMBOLS, dtype=np.uint64).astype(np.uint32)


def shingle_hashes(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles; with fewer words, of the whole sequence.

    A-Z is lower-cased and words are separated by ASCII white space. Null or wordless: empty.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.int64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(n, len(words))
    mixed = np.full(len(words) - size + 1, size, np.uint64)
    for i in range(size):
        mixed = (mixed ^ each[i : len(each) - size + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed.view(np.int64))


def signature(hashes: np.ndarray) -> bytes:
    """The low 8 bits of a mix of each MinHash value."""
    a, b = _multipliers()
    x = hashes.view(np.uint64)
    x = ((x ^ (x >> np.uint64(32))) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    low = np.full(SYMBOLS, 0xFFFFFFFF, np.uint32)
    for start in range(0, len(x), 2048):
        low = np.minimum(low, (x[start : start + 2048, None] * a + b).min(0))
    low = (low ^ (low >> np.uint32(15))) * np.uint32(2654435761)
    return (low >> np.uint32(24)).astype(np.uint8).tobytes()


def bitmap(hashes: np.ndarray) -> bytes:
    """One bit for each element, chosen by the element's hash."""
    bits = np.zeros(BITMAP, np.uint8)
    bits[hashes & (BITMAP - 1)] = 1
    return np.packbits(bits).tobytes()


def signatures(docs: DataFrame, n: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, digest, signature, bits) of each row; the last three are null for empty sets."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, digests, sigs, bits = [], [], [], []
        for text in batch.column(1).to_pylist():
            h = shingle_hashes(text, n)
            sizes.append(len(h))
            digests.append(xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None)
            sigs.append(signature(h) if len(h) else None)
            bits.append(bitmap(h) if len(h) else None)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary()), pa.array(bits, pa.binary())], names=["doc_id", "n_shingles", "digest", "signature", "bits"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(picked, make, "doc_id long, n_shingles long, digest binary, signature binary, bits binary")


def set_digests(docs: DataFrame, n: int, text_col: str, name: str) -> DataFrame:
    """``docs`` with the digest of each row's shingle set, null for empty ones."""
    names = docs.columns

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = (shingle_hashes(t, n) for t in batch.column(names.index(text_col)).to_pylist())
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array([xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None for h in sets], pa.binary())], names=[*names, name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return map_batches(docs, make, f"{fields}, `{name}` binary")


def _keys(classes: DataFrame) -> DataFrame:
    """(key, id): for each chunk and each left-out position, the other symbols."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(len(ids), CHUNKS, WIDTH).astype(np.int64)
        out = np.empty((len(ids), CHUNKS, WIDTH), np.int64)
        for left in range(WIDTH):
            packed = np.zeros((len(ids), CHUNKS), np.int64)
            for i in range(WIDTH):
                if i != left:
                    packed = packed << 8 | sig[:, :, i]
            out[:, :, left] = packed | (np.arange(CHUNKS) * WIDTH + left) << 40
        return pa.RecordBatch.from_arrays([pa.array(out.reshape(-1)), pa.array(np.repeat(ids, CHUNKS * WIDTH))], names=["key", "id"])

    return map_batches(classes.select("id", "signature"), make, "key long, id long")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets have a similarity of ``percent`` / 100 or more."""
    a, b = (sets.select(F.col("id").alias(x), F.col("shingles").alias(f"s{x}")) for x in "ab")
    met = pairs.join(a, "a").join(b, "b").withColumn("both", F.size(F.array_intersect("sa", "sb")))
    return met.where(F.col("both") * 100 >= percent * (F.size("sa") + F.size("sb") - F.col("both"))).select("a", "b")


def _near(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with their signature distance, where it and the set sizes allow a link."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, SYMBOLS) for i in (2, 3))
        d = (x != y).sum(1).astype(np.int32)
        out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(d)], names=["a", "b", "d"])
        return out.filter(pa.array(d <= LIMIT))

    a, b = (classes.select(F.col("id").alias(x), F.col("signature").alias(f"g{x}"), F.col("n_shingles").alias(f"n{x}")) for x in "ab")
    met = pairs.join(a, "a").join(b, "b").where(F.least("na", "nb") * 100 >= percent * F.greatest("na", "nb"))
    return map_batches(met.select("a", "b", "ga", "gb"), make, "a long, b long, d int")


def _compare_blocks(groups: Iterator[pd.DataFrame], percent: int) -> Iterator[pd.DataFrame]:
    """All members of a key against each other, for each pair of blocks; each pair is given for its first key only."""
    for frame in groups:
        frame = frame.sort_values(["key", "i", "j", "id"], kind="stable")
        sig = np.frombuffer(b"".join(frame["signature"]), np.uint8).reshape(-1, SYMBOLS)
        bits = np.frombuffer(b"".join(frame["bits"]), np.uint64).reshape(-1, BITMAP // 64)
        ids, comp, size, block = (frame[c].to_numpy() for c in ("id", "comp", "n_shingles", "block"))
        key, i, j = (frame[c].to_numpy() for c in ("key", "i", "j"))
        edge = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
        for lo, hi in zip(np.r_[0, edge], np.r_[edge, len(key)], strict=True):
            left, right = np.flatnonzero(block[lo:hi] == i[lo]) + lo, np.flatnonzero(block[lo:hi] == j[lo]) + lo
            chunk, missing = divmod(int(key[lo]) >> 40, WIDTH)
            for x in left:
                other = right[(comp[right] != comp[x]) & ((ids[right] > ids[x]) | (i[lo] != j[lo])) & (np.minimum(size[right], size[x]) * 100 >= percent * np.maximum(size[right], size[x]))]
                if not len(other):
                    continue
                differ = sig[other] != sig[x]
                errors = differ.reshape(len(other), CHUNKS, WIDTH).sum(2)
                first = (errors[:, :chunk] > ERRORS).all(1) & ((errors[:, chunk] > 0) | (missing == 0))
                other = other[first & (errors.sum(1) <= LIMIT)]
                lacking = size[x] - np.bitwise_count(bits[x] & ~bits[other]).sum(1, dtype=np.int64)
                both = np.minimum(lacking, size[other] - np.bitwise_count(bits[other] & ~bits[x]).sum(1, dtype=np.int64))
                other = other[both * 100 >= percent * (size[other] + size[x] - both)]
                if len(other):
                    yield pd.DataFrame({"a": ids[x], "b": ids[other]})


def _remaining_pairs(members: DataFrame, classes: DataFrame, counts: DataFrame, percent: int) -> DataFrame:
    """Pairs within the limit of members of one key that lie in different components."""
    blocks = members.join(counts.select("key", F.ceil(F.col("n") / BLOCK).alias("blocks")), "key")
    blocks = blocks.join(classes.select("id", "signature", "n_shingles", "bits"), "id")
    blocks = blocks.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    blocks = blocks.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    blocks = blocks.select("key", "id", "comp", "signature", "n_shingles", "bits", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    rows = counts.agg(F.sum(F.col("n") * F.ceil(F.col("n") / BLOCK))).first()[0] or 0
    blocks = blocks.withColumn("bin", F.pmod(F.xxhash64("key", "i", "j"), F.lit(max(1, rows // BIN_ROWS))))

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)}), *_compare_blocks(iter([frame]), percent)])

    return blocks.groupBy("bin").applyInPandas(compare, "a long, b long").distinct()


def near_duplicate_links(docs: DataFrame, signed: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(classes, links): one numbered row per distinct shingle set, with its smallest document ``low``, and confirmed links (a, b) that connect the classes.

    Classes that belong to one component are connected by the links, though not every pair
    of them is listed.
    """
    # rows that repeat an id and a text would give a class its set more than once
    repeated = signed.where("digest is not null").groupBy("doc_id", "digest").count().where("count > 1").limit(1).count() > 0
    found = signed.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("low"), F.min("signature").alias("signature"), F.min("n_shingles").alias("n_shingles"), F.min("bits").alias("bits"))
    classes = shared_table(found.withColumn("id", F.monotonically_increasing_id()), "classes")
    spread = classes.select("id", "signature").repartition(max(1, -(-classes.count() * SYMBOLS // KEYS_OF_A_TASK)), "id")
    keys = shared_table(_keys(spread), "keys")
    several = keys.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("key")
    members = shared_table(keys.join(several, "key"), "members")
    wanted = members.select("id").distinct().join(classes.select("id", "digest", "low"), "id")

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, sets = [], []
        for i, digest, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            h = shingle_hashes(text, n)
            if xxhash.xxh3_128_digest(h.tobytes()) == digest:
                ids.append(i)
                sets.append(h)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["id", "shingles"])

    texts = docs.select(F.col(id_col).cast("long").alias("low"), F.col(text_col).cast("string").alias("text"))
    sets = map_batches(texts.join(wanted, "low").select("id", "digest", "text"), make, "id long, shingles array<long>")
    sets = shared_table(sets.groupBy("id").agg(F.first("shingles").alias("shingles")) if repeated else sets, "sets")

    links = None
    state = members.withColumn("comp", F.col("id"))
    for turn in range(HUB_ROUNDS):
        order = F.col("id") if turn == 0 else F.xxhash64("id", F.lit(turn))
        hubs = state.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min_by(F.struct("id", "comp"), order).alias("hub")).where("lo < hi")
        pairs = state.join(hubs, "key").where("comp <> hub.comp").select(F.col("id").alias("a"), F.col("hub.id").alias("b")).distinct()
        near = _near(pairs, classes, percent).groupBy("a").agg(F.min_by("b", F.struct("d", "b")).alias("b"))
        found = shared_table(_confirmed(near, sets, percent), "links")
        links = found if links is None else links.unionByName(found)
        comps = connected_components(links, "a", "b")
        state = shared_table(members.join(comps.select(F.col("node").alias("id"), "component"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("comp")), "state")
    counts = shared_table(state.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("key", "n"), "counts")
    rest = shared_table(_confirmed(_remaining_pairs(state, classes, counts, percent), sets, percent), "links")
    return classes, links.unionByName(rest)


def _grouped(docs: DataFrame, n: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(signed, groups): signatures of all rows, and for each digest the smallest (document, digest) of its component."""
    signed = shared_table(signatures(docs, n, id_col, text_col), "signatures")
    classes, links = near_duplicate_links(docs, signed, n, percent, id_col, text_col)
    comps = connected_components(links, "a", "b")
    named = classes.select("id", "low", "digest").join(comps.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    first = named.groupBy("component").agg(F.min(F.struct("low", "digest")).alias("first"))
    return signed, named.join(first, "component").select("digest", F.col("first.low").alias("component_id"), F.col("first.digest").alias("first_digest"))


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs``.

    Documents are linked when the similarity of their n-word shingle sets is ``percent`` / 100 or
    more; ``component_id`` is the smallest id reachable over links. Null or wordless texts have an
    empty set and stay alone. Rows without an id are returned with null component_id and kept.
    Repeated rows are all returned; rows that repeat an id with another text each follow their
    own text. Other columns of ``docs`` are not read. An empty table gives an empty table.
    """
    signed, groups = _grouped(docs, n, percent, id_col, text_col)
    component = F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("component_id")), F.col("doc_id"))
    return signed.join(groups, "digest", "left").select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: the smallest id, and of its texts the one of the smallest digest.

    Rows are told apart by id and digest of their shingle set, so a row that shares its id with a
    copy of something else stays. Rows of one id and one set are one document, of which one row
    stays. Rows without an id, null and wordless texts are in no group and all stay. An empty table
    gives an empty table.
    """
    signed, groups = _grouped(docs, n, percent, id_col, text_col)
    met = signed.where("doc_id is not null").join(groups, "digest")
    gone = met.where((F.col("doc_id") != F.col("component_id")) | (F.col("digest") != F.col("first_digest"))).select(F.col("doc_id").alias("_gone"), F.col("digest").alias("_of")).distinct()
    left = set_digests(docs, n, text_col, "_digest").join(gone.hint("merge"), (F.col(id_col).cast("long") == F.col("_gone")) & (F.col("_digest") == F.col("_of")), "left_anti")
    if met.groupBy("doc_id", "digest").count().where("count > 1").limit(1).count():
        named = F.col(id_col).isNotNull() & F.col("_digest").isNotNull()
        left = left.where(named).dropDuplicates([id_col, "_digest"]).unionByName(left.where(~named | named.isNull()))
    return left.select(*(F.col(f"`{c}`") for c in docs.columns))
