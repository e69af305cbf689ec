"""Near-duplicate embeddings: a subspace pigeonhole join.

Unit vectors with a cosine of ``c`` or more have a squared distance of at most 2 - 2c. Rotated
and split into ``blocks`` of coordinates, at least one block of such a pair has at most the
block's proportional share of it. Each block is range-joined on a grid over its first
coordinates: a vector lies in one cell and is looked up in the cells behind its own that its range
touches, so two near vectors meet in one cell of a block. Everything is kept apart by label and
by vector size, as both the shares and the grid follow from the size.

Rotated coordinates are whole numbers, so that their distances are exact wherever they are
computed. A pair is judged in the first block that is within its share, on the original vectors
in double precision; all other meetings leave it out. So links are counted where they are
found and only counts, and for each vector the smallest one that it is connected to there, leave
a task: rows grow with the vectors and not with their pairs. A cell of many vectors is
compared in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelscope.llm.common import map_batches
from labelscope.operators.components import connected_components
from labelscope.sources.shared import shared_table

BLOCKS, GRID_DIMS, SEED = 4, 3, 5
#: Whole-number steps of a rotated coordinate between 0 and 1.
STEPS = 16384
#: Rows of a cell that are compared at once, rows that a task gathers, and hot cells that are broadcast at most.
CHUNK, BIN_ROWS, BROADCAST_CELLS = 2048, 8192, 100_000


def usable(vector: list | None) -> np.ndarray | None:
    """The vector in double precision; None where it is null, empty, zero or not finite."""
    if not vector or any(x is None for x in vector):
        return None
    v = np.array(vector, np.float64)
    return v if np.isfinite(v).all() and v.any() else None


def by_size(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, rows, matrix) of the usable vectors of a column of lists, for each size."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    begin = np.cumsum(lengths) - lengths
    for size in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == size)
        x = values[begin[rows][:, None] + np.arange(size)]
        ok = np.isfinite(x).all(1) & x.any(1)
        if ok.any():
            yield int(size), rows[ok], x[ok]


def packed(x: np.ndarray) -> list[bytes]:
    """Rows as bytes: four for a number that single precision holds, or else eight."""
    short = x.astype(np.float32)
    exact = (short == x).all(1)
    return [s.tobytes() if e else r.tobytes() for s, r, e in zip(short, x, exact, strict=True)]


def unpacked(raw: list[bytes], size: int) -> np.ndarray:
    if all(len(r) == 4 * size for r in raw):
        return np.frombuffer(b"".join(raw), np.float32).reshape(len(raw), size).astype(np.float64)
    return np.stack([np.frombuffer(r, np.float32 if len(r) == 4 * size else np.float64).astype(np.float64) for r in raw])


def rotation(size: int, seed: int = SEED) -> np.ndarray:
    """A seeded orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, size)))
    return q * np.sign(np.diag(r))


def shares(size: int, blocks: int, threshold: float) -> list[tuple[slice, float]]:
    """Each block's coordinates and its share of the squared distance, in squared steps, with room for rounding."""
    cuts = np.array_split(np.arange(size), min(blocks, size))
    # rounding moves a block's difference by at most one step in each coordinate
    return [(slice(c[0], c[-1] + 1), float(np.floor((STEPS * np.sqrt(max(2 - 2 * threshold, 0) * len(c) / size) + np.sqrt(len(c)) + 1) ** 2))) for c in cuts]


def turned(x: np.ndarray) -> np.ndarray:
    """Unit vectors rotated, in whole steps."""
    return np.rint(STEPS * (x / np.linalg.norm(x / np.abs(x).max(1, keepdims=True), axis=1, keepdims=True) / np.abs(x).max(1, keepdims=True)) @ rotation(x.shape[1])).astype(np.int16)


def _digests(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, whole: bool) -> DataFrame:
    """(id, label, digest) of each row, and the vector's size and bytes if asked; the digest is null for rows that cannot be linked."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        digests: list = [None] * batch.num_rows
        raws, sizes = [None] * batch.num_rows, [None] * batch.num_rows
        labelled = batch.column(1).is_valid().to_numpy(zero_copy_only=False) & batch.column(0).is_valid().to_numpy(zero_copy_only=False)
        for size, rows, x in by_size(batch.column(2)):
            for i, r, v in zip(rows.tolist(), packed(x), x + 0.0, strict=True):  # -0 is 0
                if labelled[i]:
                    digests[i], raws[i], sizes[i] = xxhash.xxh3_128_digest(v.tobytes()), r, size
        out = [batch.column(0), batch.column(1), pa.array(digests, pa.binary())]
        if not whole:
            return pa.RecordBatch.from_arrays(out, names=["id", "label", "digest"])
        found = pa.RecordBatch.from_arrays([*out, pa.array(sizes, pa.int32()), pa.array(raws, pa.binary())], names=["id", "label", "digest", "size", "raw"])
        return found.filter(found.column(2).is_valid())

    picked = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    return map_batches(picked, make, "id long, label string, digest binary" + (", size int, raw binary" if whole else ""))


def _cells(classes: DataFrame, threshold: float, blocks: int, dims: int, whole: bool) -> DataFrame:
    """(key, own, ...): for each block the vector's own cell, and the cells behind it that its range touches."""
    names = ["key", "own", *(["cid", "n", "size", "part", "raw", "steps"] if whole else [])]

    def make(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        label, raw = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        sizes = batch.column(3).to_numpy(zero_copy_only=False)
        keys, owns, rows, parts, steps = [], [], [], [], np.empty(batch.num_rows, object)
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            q = turned(unpacked([raw[i] for i in at], size))
            steps[at] = [v.tobytes() for v in q]
            seeds = np.array([xxhash.xxh3_64_intdigest(f"{size}|{label[i]}") for i in at], np.uint64)
            for b, (part, limit) in enumerate(shares(size, blocks, threshold)):
                radius = np.sqrt(limit)
                x = q[:, part][:, :dims].astype(np.float64)
                own = np.floor(x / (2 * radius)).astype(np.int64)
                low, high = np.floor((x - radius) / (2 * radius)).astype(np.int64), np.floor((x + radius) / (2 * radius)).astype(np.int64)
                for shift in product((0, 1, 2), repeat=x.shape[1]):  # a range of twice the radius touches three cells at most, two but for ties
                    cell = low + np.array(shift)
                    ahead = cell - own
                    first = np.take_along_axis(ahead, (ahead != 0).argmax(1)[:, None], 1)[:, 0]
                    go = np.flatnonzero((cell <= high).all(1) & (first >= 0))
                    h = seeds[go]
                    for number in (np.uint64(b), *cell[go].T.astype(np.uint64)):
                        h = (h ^ number) * np.uint64(0x9E3779B97F4A7C15)
                        h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
                        h ^= h >> np.uint64(29)
                    keys.append(h.view(np.int64))
                    owns.append(first[go] == 0)
                    rows.append(at[go])
                    parts.append(np.full(len(go), b, np.int32))
        if not keys:
            return None
        out = [pa.array(np.concatenate(keys)), pa.array(np.concatenate(owns))]
        if whole:
            where = pa.array(np.concatenate(rows))
            out += [batch.column(0).take(where), batch.column(4).take(where), batch.column(3).take(where), pa.array(np.concatenate(parts)), batch.column(2).take(where), pa.array(steps.tolist(), pa.binary()).take(where)]
        return pa.RecordBatch.from_arrays(out, names=names)

    schema = "key long, own boolean" + (", cid long, n long, size int, part int, raw binary, steps binary" if whole else "")
    return map_batches(classes.select("cid", "label", "raw", "size", "n"), make, schema, rows=256)


def _group_links(frame: pd.DataFrame, threshold: float, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of one cell, or pair of its chunks: the vectors linked to it, and the place of the first row that it is connected to."""
    size, part = int(frame["size"].iloc[0]), int(frame["part"].iloc[0])
    x, q = unpacked(frame["raw"].tolist(), size), np.frombuffer(b"".join(frame["steps"]), np.int16).reshape(len(frame), size).astype(np.float64)
    norm, n, own = np.sqrt((x * x).sum(1)), frame["n"].to_numpy(), frame["own"].to_numpy(bool)
    cuts = shares(size, blocks, threshold)[: part + 1]
    square = [(q[:, c] ** 2).sum(1) for c, _ in cuts]
    others, ends = np.zeros(len(frame), np.int64), []

    def compare(left: np.ndarray, right: np.ndarray, once: bool) -> None:
        for s in range(0, len(left), 256):
            a = left[s : s + 256]
            near = np.ones((len(a), len(right)), bool)
            for k in (part, *range(part)):
                c, limit = cuts[k]
                within = square[k][a][:, None] + square[k][right] - 2 * (q[a][:, c] @ q[right][:, c].T) <= limit
                near &= within if k == part else ~within
                if not near.any():
                    break
            else:
                if once:
                    near &= right > a[:, None]
                cos = (x[a] @ x[right].T) / (norm[a][:, None] * norm[right])
                unsure = near & (np.abs(cos - threshold) < 1e-9)
                near &= cos >= threshold
                for i, j in zip(*np.nonzero(unsure), strict=True):
                    u, v = x[a[i]], x[right[j]]
                    near[i, j] = u @ v / (np.sqrt(u @ u) * np.sqrt(v @ v)) >= threshold
                others[a] += near @ n[right]
                others[right] += n[a] @ near
                i, j = np.nonzero(near)
                ends.append(np.stack([a[i], right[j]]).astype(np.int32))

    side = frame["chunk"].to_numpy() == frame["i"].to_numpy()
    if (frame["i"] == frame["j"]).all():
        compare(np.flatnonzero(own), np.flatnonzero(own), True)
        compare(np.flatnonzero(own), np.flatnonzero(~own), False)
    else:
        compare(np.flatnonzero(side & own), np.flatnonzero(~side), False)
        compare(np.flatnonzero(side & ~own), np.flatnonzero(~side & own), False)
    first = np.arange(len(frame))
    if ends:
        a, b = np.concatenate(ends, 1)
        while True:
            before = first.copy()
            np.minimum.at(first, a, before[b])
            np.minimum.at(first, b, before[a])
            first = first[first]
            if (first == before).all():
                break
    return others, first


def _links(classes: DataFrame, threshold: float, blocks: int, dims: int) -> DataFrame:
    """(cid, others, root): for each class and cell the vectors linked to it there, and a class it is connected to there."""
    counts = shared_table(_cells(classes, threshold, blocks, dims, False).groupBy("key").agg(F.count("*").alias("rows")).groupBy(F.ceil(F.col("rows") / CHUNK).alias("chunks"), F.when(F.col("rows") > CHUNK, F.col("key")).alias("key")).agg(F.sum("rows").alias("rows")), "cells")
    total = counts.agg(F.sum(F.col("rows") * F.col("chunks"))).first()[0] or 0
    hot = counts.where("key is not null").select("key", "chunks")
    hot = F.broadcast(hot) if hot.count() <= BROADCAST_CELLS else hot
    met = _cells(classes, threshold, blocks, dims, True).join(hot, "key", "left")
    last = F.coalesce("chunks", F.lit(1).cast("long")) - 1
    met = met.withColumn("chunk", F.pmod(F.xxhash64("cid"), last + 1)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    met = met.select("key", "own", "cid", "n", "size", "part", "raw", "steps", "chunk", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))
    met = met.withColumn("bin", F.pmod(F.xxhash64("key", "i", "j"), F.lit(max(1, total // BIN_ROWS))))

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["key", "i", "j", "cid"], kind="stable", ignore_index=True)
        key, i, j = (frame[c].to_numpy() for c in ("key", "i", "j"))
        edge = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
        out = [pd.DataFrame({"cid": np.empty(0, np.int64), "others": np.empty(0, np.int64), "root": np.empty(0, np.int64)})]
        for lo, hi in zip(np.r_[0, edge], np.r_[edge, len(key)], strict=True):
            if hi - lo > 1:
                cid = frame["cid"].to_numpy()[lo:hi]
                others, first = _group_links(frame.iloc[lo:hi], threshold, blocks)
                some = others > 0
                out.append(pd.DataFrame({"cid": cid[some], "others": others[some], "root": cid[first[some]]}))
        return pd.concat(out)

    return met.groupBy("bin").applyInPandas(compare, "cid long, others long, root long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, blocks: int = BLOCKS, dims: int = GRID_DIMS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors``.

    Rows are linked when their labels are equal and not null and their vectors, of one size, have
    a cosine of the threshold or more. Null, empty and zero vectors and those with null or
    non-finite components link with nothing, as do rows with a null label. Equal vectors are one
    class: it is joined once and its size counts. Rows without an id link with nothing and have
    null component_id and kept. Repeated rows are vectors of their own and are linked; rows that
    repeat an id with other vectors each follow their own vector. Other columns are not read. An
    empty table gives an empty table.
    """
    rows = _digests(vectors, id_col, vector_col, label_col, True)
    classes = rows.groupBy("label", "digest").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.min("size").alias("size"), F.min("raw").alias("raw"))
    classes = shared_table(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    links = shared_table(_links(classes, threshold, blocks, dims).groupBy("cid", "root").agg(F.sum("others").alias("others")), "links")
    comps = connected_components(links, "cid", "root").withColumnsRenamed({"node": "cid"})
    counted = links.groupBy("cid").agg(F.sum("others").alias("others"))
    found = classes.select("cid", "label", "digest", "id", "n").join(counted, "cid", "left").join(comps, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    found = shared_table(found.select("label", "digest", "id", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component"), "found")
    lowest = found.groupBy("component").agg(F.min("id").alias("component_id"))
    known = found.join(lowest, "component").select("label", "digest", "n_links", "component_id")
    met = _digests(vectors, id_col, vector_col, label_col, False).join(known, ["label", "digest"], "left")
    component = F.coalesce("component_id", "id")
    return met.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))
