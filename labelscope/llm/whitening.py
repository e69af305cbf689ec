"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

The matrix X holds the centred rows. Starting from a seeded unit vector v, each step takes the
products X v and X'u over the rows where they lie and makes the next pair of left and right
vectors orthogonal to all earlier ones, so that X V = U B with B upper bidiagonal. The left vectors have one
entry a row and are never stored: each is X w for a short vector w, so a row's entries follow from the row. One
pass over the rows gives X'Xv together with the inner products that orthogonalise Xv; a pass is
repeated on the remainder where that took away most of the vector. The singular values of B are the deviations
times the square root of the number of rows, its right vectors turned by V are the components.

Entries are whole numbers, so sums, means' remainders and squared deviations are exact. Driver and
tasks hold matrices of the vectors' size only; what tasks send is added up by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelscope.llm.common import map_batches, pieces_of
from labelscope.sources.shared import shared_table

SCALE, SHIFT, COMPONENTS, SEED = 1024, 100_000, 8, 12
#: Entries of a larger absolute value cannot be counted exactly.
LARGEST = 2.0**40
#: Part of the largest variance up to which a component counts as none.
RANK_TOLERANCE = 1e-12


def whole(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, places, rows as whole numbers) of the usable vectors of a column of lists, for each size."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    begin = np.cumsum(lengths) - lengths
    for size in np.unique(lengths[lengths > 0]):
        places = np.flatnonzero(lengths == size)
        x = values[begin[places][:, None] + np.arange(size)]
        ok = (np.abs(x) <= LARGEST).all(1)  # false for NaN and infinities
        if ok.any():
            yield int(size), places[ok], np.floor(SCALE * x[ok]).astype(np.int64) + SHIFT


def _rows(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, size, x) of the rows that take part."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        out = []
        for size, places, x in whole(batch.column(1)):
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * size), pa.array(x.reshape(-1)))
            out.append(pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(places)), pa.array(np.full(len(x), size, np.int32)), lists], names=["id", "size", "x"]))
        return pa.Table.from_batches(out).combine_chunks().to_batches()[0] if out else None

    return map_batches(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")), make, "id long, size int, x array<long>")


def _centred(x: np.ndarray, base: np.ndarray, fraction: np.ndarray) -> np.ndarray:
    """Rows less their mean: whole numbers until the one rounded subtraction of the mean's fraction."""
    return (x - base) - fraction


class Fit:
    """Components of the rows of one size; ``vectors`` has one a column, ``variances`` its eigenvalues."""

    def __init__(self, rows: DataFrame, n: int, sums: list[int], k: int, seed: int) -> None:
        self.rows, self.n, self.size = rows, n, len(sums)
        self.base, self.rest = np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64)
        self.identity_error: float | None = None
        self._bidiagonalise(k, seed)
        if self.vectors.shape[1]:
            y = self.vectors / np.sqrt(self.variances)
            second = self._sums(lambda c: ((c @ y).T @ (c @ y)).ravel())
            mean = self._sums(lambda c: (c @ y).sum(0)) / n
            self.identity_error = float(np.abs(second.reshape(y.shape[1], -1) / n - np.outer(mean, mean) - np.eye(y.shape[1])).max())

    def centred(self, x: np.ndarray) -> np.ndarray:
        return _centred(x, self.base, self.rest / self.n)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - S)^2 of each row; None where a long cannot hold it."""
        d = x - self.base
        if float(np.abs(d).max(initial=0) + 1) * self.n < (2.0**62 / self.size) ** 0.5:
            return (((d * self.n - self.rest) ** 2).sum(1)).tolist()
        exact = [sum((v * self.n - r) ** 2 for v, r in zip(row, self.rest.tolist(), strict=True)) for row in d.tolist()]
        return [v if v < 1 << 63 else None for v in exact]

    def _sums(self, of) -> np.ndarray:
        """``of`` the centred rows of a batch, a vector, summed over all rows."""
        base, fraction = self.base, self.rest / self.n

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for piece in pieces_of(batch):
                    x = piece.column(0).flatten().to_numpy(zero_copy_only=False).reshape(piece.num_rows, -1)
                    found = of(_centred(x, base, fraction))
                    total = found if total is None else total + found
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["at", "value"])

        # a row for each entry of the vector, however many rows and tasks there are
        found = self.rows.select("x").mapInArrow(part, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).orderBy("at").collect()
        return np.array([r["value"] for r in found])

    def _bidiagonalise(self, k: int, seed: int) -> None:
        size, n, rng = self.size, self.n, np.random.default_rng(seed)
        right, left, back = np.zeros((size, 0)), np.zeros((size, 0)), np.zeros((size, 0))  # columns v, w with u = X w, and X'u
        alphas: list[float] = []
        betas: list[float] = []
        self.trace, wanted = 0.0, min(k, size)

        def fresh() -> np.ndarray:
            r = rng.normal(size=size)
            for _ in range(2):
                r -= right @ (right.T @ r)
            return r / np.linalg.norm(r)

        v = fresh()
        while True:
            w = v.copy()
            for _ in range(3):
                # one pass: X'(Xw), the inner products of Xw with all earlier u, its square, and the squares of all entries
                found = self._sums(lambda c, w=w: np.concatenate([c.T @ (t := c @ w), (c @ left).T @ t, [t @ t, (c * c).sum()]]))
                product, inner, square = found[:size], found[size:-2], found[-2]
                self.trace = found[-1]
                w, product, remainder = w - left @ inner, product - back @ inner, square - inner @ inner
                if remainder >= 0.25 * square or remainder <= RANK_TOLERANCE * self.trace / size:
                    break
            right = np.column_stack([right, v])
            if remainder <= RANK_TOLERANCE * self.trace / size:  # v adds no direction to the rows
                alphas.append(0.0)
                left, back, ahead = np.column_stack([left, np.zeros(size)]), np.column_stack([back, np.zeros(size)]), np.zeros(size)
            else:
                alpha = float(np.sqrt(remainder))
                alphas.append(alpha)
                left, back, ahead = np.column_stack([left, w / alpha]), np.column_stack([back, product / alpha]), product / alpha
            done = len(alphas)
            for _ in range(2):
                ahead = ahead - right @ (right.T @ ahead)
            beta = float(np.linalg.norm(ahead))
            small = beta <= 1e-14 * np.sqrt(self.trace)
            b = np.diag(alphas) + np.diag(betas[: done - 1], 1)
            p, sigma, q = np.linalg.svd(b)
            # Left are at most the directions outside V. None of them can be one of the components wanted
            # once all the variance outside V is less than that of the last one and those found have converged.
            outside = self.trace - float((sigma**2).sum())
            settled = done >= wanted and outside < sigma[wanted - 1] ** 2 and (small or (np.abs(p[-1, :wanted]) * beta <= 1e-15 * sigma[0]).all())
            if done == size or settled or not self.trace:
                break
            betas.append(0.0 if small else beta)
            v = fresh() if small else ahead / beta
        keep = int((sigma[:wanted] ** 2 > RANK_TOLERANCE * max(self.trace, 1e-300)).sum())
        self.vectors = (right @ q.T)[:, :keep]
        self.variances = sigma[:keep] ** 2 / n


def fit(rows: DataFrame, k: int = COMPONENTS, seed: int = SEED) -> list[Fit]:
    """A fit for each vector size among ``rows`` (id, size, x), with exact sums."""
    sums = rows.select("size", F.posexplode("x").alias("at", "x")).groupBy("size", "at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n"))
    by_size: dict[int, list] = {}
    for r in sums.orderBy("size", "at").collect():  # a row for each coordinate
        by_size.setdefault(r["size"], []).append(r)
    return [Fit(rows.where(F.col("size") == size), found[0]["n"], [int(r["s"]) for r in found], k, seed) for size, found in by_size.items()]


def whiten(vectors: DataFrame, k: int = COMPONENTS, seed: int = SEED, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each usable vector and component.

    Vectors that are null or empty or hold null, non-finite or uncountably large entries (over 2^40)
    are left out; zero vectors take part. Vectors of each size are a list of their own with its own
    components. Components have positive variance: equal vectors, or a single one, have none and give
    no rows, and there are fewer than ``k`` where the vectors span less. Equal variances give some
    orthonormal basis of their space. A deviation that a long cannot hold is null. Repeated rows
    and rows without an id count and come out like any other. Other columns are not read. An empty
    table gives an empty table.
    """
    rows = shared_table(_rows(vectors, id_col, vector_col), "whole")
    fits = {f.size: f for f in fit(rows, k, seed)}
    for f in fits.values():
        f.rows = None  # tasks get the numbers only

    def make(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        out = []
        sizes = batch.column(1).to_numpy(zero_copy_only=False)
        for size in np.unique(sizes):
            f, places = fits[int(size)], np.flatnonzero(sizes == size)
            m = f.vectors.shape[1]
            if not m:
                continue
            x = batch.column(2).take(pa.array(places)).flatten().to_numpy(zero_copy_only=False).reshape(len(places), -1)
            y = f.centred(x) @ f.vectors / np.sqrt(f.variances)
            repeated = pa.array(np.repeat(np.arange(len(places)), m))
            columns = [
                batch.column(0).take(pa.array(places)).take(repeated),
                pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(places))),
                pa.array(np.full(len(places) * m, f.n)),
                pa.array(f.deviation(x), pa.int64()).take(repeated),
                pa.array(y.reshape(-1)),
                pa.array(np.tile(f.variances * f.n / f.trace, len(places))),
                pa.array(np.full(len(places) * m, f.identity_error)),
            ]
            out.append(pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]))
        return pa.Table.from_batches(out).combine_chunks().to_batches()[0] if out else None

    return map_batches(rows, make, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
