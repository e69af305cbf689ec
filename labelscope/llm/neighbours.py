"""Nearest neighbours by inner product: inverted file, product quantisation, exact reranking under bounds.

Coarse centroids and the codebooks of the residuals are fitted on a bounded sample; every
vector is indexed with its list, its code and the length of what its code leaves out. A query first
looks into the lists with the largest inner products to their centroids. What it finds there is
a floor, and it looks into every other list that may hold a larger inner product: that of the
centroid, and the query's length times the list's radius. In a list, vectors are scored from a table
of the query's inner products with all codewords, and all that may reach the floor, by the length
that their codes leave out, are ranked by the exact inner product of the original vectors. So the
sample, the lists and the codes settle how much is read, and never which rows are found.

Lists lie in bins of bounded size, near lists together; a list with more vectors than a bin holds
is dealt over several by the hash of the id. A query is sent to the bins of its lists and to
no other, and the queries of a bin are taken in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelscope.llm.common import map_batches
from labelscope.llm.vectors import by_size, packed, unpacked
from labelscope.sources.shared import shared_table

#: Bound of the sample that centroids and codebooks are fitted on.
SAMPLE = 20_000
#: Lists at most, one for each ``LIST_ROWS`` vectors of the sample; subspaces at least, coordinates of one at most, and codewords of each.
LISTS, LIST_ROWS, SUBSPACES, SUBSPACE_WIDTH, CODEWORDS = 256, 16, 16, 2, 256
#: Share of the lists that a query looks into first, and vectors of a bin that are ranked exactly first.
PROBED, RERANK = 0.0625, 200
#: Index rows of a bin, query rows of a block and rows that are multiplied at once.
INDEX_BLOCK, QUERY_BLOCK, PRODUCT_ROWS = 16384, 4096, 2048


def _kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        counts = np.bincount(near, minlength=len(centres))
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres * centres).sum(1) / 2
    return np.concatenate([(half - x[i : i + 4096] @ centres.T).argmin(1) for i in range(0, len(x), 4096)])


class Index:
    """Coarse centroids and, for each subspace, codewords of the residuals.

    Vectors are moved by the sample's medians and scaled by its largest coordinate, so that single precision
    holds their differences; what it loses is part of the bounds.
    """

    def __init__(self, sample: np.ndarray, lists: int, subspaces: int, codewords: int, seed: int = 9) -> None:
        self.size = sample.shape[1]
        with np.errstate(all="ignore"):
            self.middle = np.median(sample, 0)
            self.scale = 1 / np.abs(sample - self.middle).max()
        self.middle, self.scale = np.where(np.isfinite(self.middle), self.middle, 0.0), float(self.scale) if np.isfinite(self.scale) else 1.0
        placed = self._placed(sample).astype(np.float32)
        self.centres = _kmeans(placed, lists, seed)
        residual = placed - self.centres[_nearest(placed, self.centres)]
        self.cuts = np.array_split(np.arange(self.size), min(subspaces, self.size))
        books = [_kmeans(residual[:, c], codewords, seed + 1 + i, 6) for i, c in enumerate(self.cuts)]
        width = max(map(len, self.cuts))
        #: Codewords of each subspace and the coordinates they lie in; narrower subspaces are filled up with a coordinate of zeros.
        self.books = np.stack([np.pad(b, ((0, 0), (0, width - b.shape[1]))) for b in books])
        self.places = np.stack([np.pad(c, (0, width - len(c)), constant_values=self.size) for c in self.cuts])
        self.rows, self.base, self.chunks = (np.zeros(len(self.centres), np.int64) for _ in range(3))
        self.radius = np.zeros(len(self.centres))

    def _placed(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            return (x - self.middle) * self.scale

    def deal(self, rows: dict[int, int], block: int) -> None:
        """Give each list of so many rows its bins: its first one and how many; near lists follow one another."""
        self.rows[list(rows)] = list(rows.values())
        spread = np.nan_to_num(self.centres - self.centres.mean(0), posinf=0, neginf=0)
        order = np.argsort(spread @ np.linalg.svd(spread, full_matrices=False)[2][0], kind="stable")
        bin_, held = 0, 0
        for n in order:
            if held and held + self.rows[n] > block:
                bin_, held = bin_ + 1, 0
            self.base[n], self.chunks[n] = bin_, max(1, -(-int(self.rows[n]) // block))
            held += int(self.rows[n])
            if self.chunks[n] > 1:
                bin_, held = bin_ + int(self.chunks[n]), 0

    def bins(self, lists: np.ndarray) -> dict[int, np.ndarray]:
        """The bins of lists, each with those of the lists that it has rows of."""
        found: dict[int, list[int]] = {}
        for n in lists:
            for b in range(self.base[n], self.base[n] + self.chunks[n]):
                found.setdefault(int(b), []).append(n)
        return {b: np.array(each, np.uint16) for b, each in found.items()}

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(list, code, length outside the code, distance from the centroid) of each row; lengths are rounded up and infinite where they cannot be told."""
        with np.errstate(all="ignore"):
            y = self._placed(x)
            near = y.astype(np.float32)
            lists = _nearest(near, self.centres)
            residual = near - self.centres[lists]
            codes = np.stack([_nearest(residual[:, c], book[:, : len(c)]) for c, book in zip(self.cuts, self.books, strict=True)], 1).astype(np.uint8)
            words = np.concatenate([book[codes[:, m], : len(c)] for m, (c, book) in enumerate(zip(self.cuts, self.books, strict=True))], 1).astype(np.float64)
            centre = self.centres[lists].astype(np.float64)
            # rounding: scores are sums in single precision, original vectors and their products in double
            loss = (self.size + len(self.cuts) + 8) * 1.2e-7 * (_length(centre) + _length(words)) + self.size * 1e-15 * (_length(x * self.scale) + _length(self.middle[None] * self.scale)) + 1e-30
            outside, distance = _length(y - centre - words) * (1 + 1e-12) + loss, _length(y - centre) * (1 + 1e-12) + loss
        return lists, codes, np.where(np.isfinite(outside), outside, np.inf), np.where(np.isfinite(distance), distance, np.inf)

    def unit(self, query: np.ndarray) -> tuple[np.ndarray, float]:
        """The query's direction and length."""
        top = np.abs(query).max()
        length = float(np.sqrt((query / top) @ (query / top)))
        return query / top / length, length * float(top)

    def floor(self, query: np.ndarray, score: float) -> float:
        """An inner product with the query on the scale of the index, rounded down; minus infinity where it cannot be told."""
        unit, length = self.unit(query)
        with np.errstate(all="ignore"):
            at = np.float64(score) / length * self.scale
            loss = self.size * (1e-15 * (abs(at) + _length(self.middle[None] * self.scale)[0]) + np.float64(1e-320) / length * self.scale)
            at = float(at - unit @ (self.middle * self.scale) - loss)
        return at if math.isfinite(at) else -math.inf

    def first(self, query: np.ndarray, probed: float, keep: int) -> np.ndarray:
        """The lists to look into first: a share of the lists, and more where they hold fewer than ``keep`` rows."""
        order = np.argsort(-(self.centres @ self.unit(query)[0].astype(np.float32)), kind="stable")
        order = order[self.rows[order] > 0]
        return order[: max(math.ceil(probed * len(order)), int(np.searchsorted(np.cumsum(self.rows[order]), keep)) + 1)]

    def others(self, query: np.ndarray, first: np.ndarray, floor: float) -> np.ndarray:
        """All other lists that may hold a row which reaches the floor."""
        open_ = ~((self.centres @ self.unit(query)[0].astype(np.float32)) + self.radius < floor)  # what cannot be told stays
        open_[first] = False
        return np.flatnonzero(open_ & (self.rows > 0))

    def scores(self, query: np.ndarray, rows: np.ndarray, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The coded score of some rows, from tables of inner products; ``codes`` has a line for each subspace."""
        unit = self.unit(query)[0].astype(np.float32)
        table = (self.books @ np.append(unit, np.float32(0))[self.places][:, :, None])[:, :, 0]
        most = 2 * len(rows) >= len(lists)
        score = (self.centres @ unit)[lists if most else lists[rows]]
        part = np.empty_like(score)
        for words, code in zip(table, codes, strict=True):
            score += words.take(code if most else code[rows], out=part, mode="clip")  # codes lie in the table; clip spares a copy
        return score[rows] if most else score


def _length(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(1))


def _products(x: np.ndarray, rows: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact scores, each row by itself: a matrix product adds rows up in other orders by their place."""
    with np.errstate(all="ignore"):
        return np.concatenate([np.empty(0), *((x[rows[i : i + PRODUCT_ROWS]] * v).sum(1) for i in range(0, len(rows), PRODUCT_ROWS))]) + 0.0  # -0 is 0


def _top(ids: np.ndarray, score: np.ndarray, k: int, unique: bool) -> np.ndarray:
    """Places of the k largest scores of different ids, equal ones by id."""
    at = np.arange(len(ids))
    if unique and len(at) > 4 * k:
        at = np.flatnonzero(~(score < -np.partition(-score, k - 1)[k - 1]))
    order = at[np.lexsort((ids[at], -score[at]))]
    if not unique:
        order = order[np.sort(np.unique(ids[order], return_index=True)[1])]
    return order[:k]


def _valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, size, v) of the rows that take part, vectors as bytes."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        out = []
        for size, rows, x in by_size(batch.column(1)):
            out.append(pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(np.full(len(rows), size, np.int32)), pa.array(packed(x), pa.binary())], names=["vec_id", "size", "v"]))
        return pa.Table.from_batches(out).combine_chunks().to_batches()[0] if out else None

    picked = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    return map_batches(picked, make, "vec_id long, size int, v binary")


def _meet(coded: DataFrame, plan: DataFrame, sent: DataFrame, best: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """(query_id, vec_id, score): ``best`` of the rows of each bin and each block of the queries that were sent there."""
    blocks = sent.groupBy("bin").agg(F.ceil(F.count("*") / QUERY_BLOCK).alias("turns"))
    index_rows = coded.join(F.broadcast(plan), "list").withColumn("bin", F.col("base") + F.pmod(F.xxhash64("vec_id"), F.col("chunks"))).drop("base", "chunks")
    index_rows = index_rows.join(blocks, "bin").withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1))).drop("turns")
    query_rows = sent.join(blocks, "bin").withColumn("turn", F.pmod(F.xxhash64("vec_id", F.lit(2)), F.col("turns"))).drop("turns")
    return index_rows.groupBy("bin", "turn").cogroup(query_rows.groupBy("bin", "turn")).applyInPandas(best, "query_id long, vec_id long, score double")


def _ranked(near: DataFrame, k: int) -> DataFrame:
    near = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k)


def _search_size(every: DataFrame, asked: DataFrame, size: int, rows: int, k: int, lists: int, probed: float, rerank: int | None) -> DataFrame:
    """(query_id, vec_id, score): for each query its best rows of each bin, for vectors of one size."""
    spark = every.sparkSession
    draw = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(1 << 30))
    near = every if rows <= SAMPLE else every.where(draw < int((1 << 30) * min(1.0, 1.1 * SAMPLE / rows)))
    sample = unpacked(near.orderBy(draw, "vec_id").limit(SAMPLE).toPandas()["v"].tolist(), size)
    index = Index(sample, max(1, min(lists, len(sample) // LIST_ROWS)), max(SUBSPACES, -(-size // SUBSPACE_WIDTH)), CODEWORDS)
    fitted = spark.sparkContext.broadcast(index)  # bounded: lists and codewords
    rerank = None if rerank is None else max(rerank, k)
    keep = (rerank or k) + 1

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        which, codes, outside, distance = fitted.value.encode(unpacked(batch.column(1).to_pylist(), size))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(which.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(outside), pa.array(distance)], names=["vec_id", "v", "list", "code", "outside", "distance"])

    coded = shared_table(map_batches(every.select("vec_id", "v"), encode, "vec_id long, v binary, list int, code binary, outside double, distance double"), "index")
    held = coded.groupBy("list").agg(F.count("*"), F.max("distance")).collect()  # a row for each list
    coded = coded.drop("distance")
    index.radius[[r[0] for r in held]] = [r[2] for r in held]
    index.deal({r[0]: r[1] for r in held}, INDEX_BLOCK)
    shared = spark.sparkContext.broadcast(index)
    plan = spark.createDataFrame([(i, int(b), int(c)) for i, (b, c) in enumerate(zip(index.base, index.chunks, strict=True))], "list int, base long, chunks long")

    def begin(batch: pa.RecordBatch) -> pa.RecordBatch:
        first = [shared.value.first(v, probed, keep).astype(np.uint16).tobytes() for v in unpacked(batch.column(1).to_pylist(), size)]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(first, pa.binary())], names=["vec_id", "v", "first"])

    def route(batch: pa.RecordBatch) -> pa.RecordBatch:
        """A row for each bin to look into: of the first lists without a floor, of the others with one."""
        at, out = [], ([], [])
        for i, (v, first, again, floor) in enumerate(zip(unpacked(batch.column(1).to_pylist(), size), *(c.to_pylist() for c in batch.columns[2:]), strict=True)):
            todo = np.frombuffer(first, np.uint16)
            if again:
                todo = shared.value.others(v, todo, -math.inf if floor is None else shared.value.floor(v, floor))
            for b, each in shared.value.bins(todo).items():
                at.append(i)
                out[0].append(b)
                out[1].append(each.tobytes())
        return pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(at, pa.int64())) for c in (0, 1, 4)), pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary())], names=["vec_id", "v", "floor", "bin", "lists"])

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        if len(left) and len(right):
            ids, which, outside = (left[c].to_numpy() for c in ("vec_id", "list", "outside"))
            x, unique = unpacked(left["v"].tolist(), size), left["vec_id"].is_unique
            codes = np.ascontiguousarray(np.frombuffer(b"".join(left["code"]), np.uint8).reshape(len(left), -1).T).astype(np.intp)
            for q, v, some, floor in zip(right["vec_id"].to_numpy(), unpacked(right["v"].tolist(), size), right["lists"], right["floor"].to_numpy(np.float64), strict=True):
                open_ = np.zeros(len(shared.value.rows), bool)
                open_[np.frombuffer(some, np.uint16)] = True
                rows = np.flatnonzero(open_[which] & (ids != q))
                if rerank is not None and len(rows) > rerank:
                    score = shared.value.scores(v, rows, which, codes)
                    most, least = score + outside[rows], -math.inf if math.isnan(floor) else shared.value.floor(v, floor)
                    if np.count_nonzero(~(most < least)) > rerank:
                        some = rows[np.argpartition(-score, rerank)[:rerank]]
                        exact = _products(x, some, v)
                        top = _top(ids[some], exact, k, unique)
                        if len(top) == k:
                            least = max(least, shared.value.floor(v, exact[top[-1]]))
                    rows = rows[~(most < least)]  # what cannot be told stays
                exact = _products(x, rows, v)
                top = _top(ids[rows], exact, k, unique)
                out[0].append(np.full(len(top), q))
                out[1].append(ids[rows[top]])
                out[2].append(exact[top])
        return pd.DataFrame({"query_id": np.concatenate(out[0]), "vec_id": np.concatenate(out[1]), "score": np.concatenate(out[2])})

    def sent(queries: DataFrame, again: bool, floor) -> DataFrame:
        routed = map_batches(queries.select("vec_id", "v", "first", F.lit(again).alias("again"), floor.alias("floor")), route, "vec_id long, v binary, floor double, bin long, lists binary")
        return shared_table(routed, "asked")

    queries = shared_table(map_batches(asked.select("vec_id", "v"), begin, "vec_id long, v binary, first binary"), "first")
    found = shared_table(_meet(coded, plan, sent(queries, False, F.lit(None).cast("double")), best), "found")
    floors = _ranked(found, k).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
    return found.unionByName(_meet(coded, plan, sent(queries.join(floors, "vec_id", "left"), True, F.col("floor")), best))


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, lists: int = LISTS, probed: float = PROBED, rerank: int | None = RERANK, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest rows of ``vectors`` by inner product.

    A query's own id is no candidate. Equal scores rank the smaller id first. Vectors that are
    null, empty or zero or that hold null or non-finite components, and rows without an id, take
    no part; a query is compared with the vectors of its own size, each size with an index of its
    own. Rows that repeat an id count once, with their best score, and a repeated query is searched
    once, with one of its vectors. Other columns are not read. No usable vectors give an empty table.

    ``probed`` is the share of the lists to look into before any bound is known, ``rerank`` the rows
    of a bin that are ranked exactly before the others' bounds are read. Both settle the cost only.
    ``probed`` = 1 with ``rerank`` None is a plain search: all lists, and all their rows ranked exactly.
    """
    spark = vectors.sparkSession
    every = shared_table(_valid(vectors, id_col, vector_col), "vectors")
    asked = shared_table(_valid(queries, id_col, vector_col).groupBy("vec_id").agg(F.min(F.struct("size", "v")).alias("q")).select("vec_id", "q.size", "q.v"), "queries")
    near = spark.createDataFrame([], "query_id long, vec_id long, score double")
    wanted = every.join(F.broadcast(asked.select("size").distinct()), "size", "left_semi").groupBy("size").count().collect()  # vector sizes are few
    for size, rows in sorted(wanted):
        near = near.unionByName(_search_size(every.where(F.col("size") == size), asked.where(F.col("size") == size), size, rows, k, lists, probed, rerank))
    return _ranked(near, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
