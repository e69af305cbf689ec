"""Quality classifier: random-indexing word vectors, pooled per document, and a small network.

Every token has a sparse random index vector that follows from its hash. The context vector of
a vocabulary token is the sum of its neighbours' index vectors over the sample; tokens outside
the vocabulary use the index vector itself. A document is the mean and the spread of its
tokens' vectors and how often tokens repeat, which tells repeated from varied text. A two-layer network scores it and
a temperature, fitted on documents kept from training, calibrates the probability.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelscope.llm.common import bounded_sample, bucket_of, map_batches
from labelscope.sources.shared import shared_table

#: Dimensions of the vectors, non-zero ones of an index vector, hashed rows for unknown tokens.
DIM, NONZERO, ROWS = 32, 4, 4096
#: Bounds of the fit: labelled documents of each class, tokens with a context vector, context width.
SAMPLE_PER_CLASS, VOCABULARY, CONTEXT = 1500, 20_000, 2
#: Tokens of a sampled document that context vectors are learnt from: a run from a seeded place. Features are those of whole texts.
LEARN_TOKENS = 1000
HIDDEN = 24
#: Tokens that one worker remembers.
_REMEMBER = 400_000

_TOKEN = re.compile(r"\w+|[^\w\s]+")


def tokens(text: str | None) -> list[str]:
    """Words and runs of punctuation; a word in capitals is itself lower-cased and a mark."""
    out = []
    for t in _TOKEN.findall(text or ""):
        if len(t) > 1 and t.isupper():
            out += ("<caps>", t.lower())
        else:
            out.append(t.lower())
    return out


def token_hash(token: str) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass"))


def index_vectors() -> np.ndarray:
    """ROWS sparse vectors with entries of +1 and -1."""
    rng = np.random.default_rng(11)
    out = np.zeros((ROWS, DIM), np.float32)
    for row in out:
        row[rng.choice(DIM, NONZERO, replace=False)] = rng.choice([-1.0, 1.0], NONZERO)
    return out


class QualityModel:
    """Vectors of tokens, by their 32-bit hashes, and the network over pooled documents."""

    def __init__(self) -> None:
        self.known: dict[int, int] = {}
        self.vectors = index_vectors() / np.sqrt(NONZERO)
        self.ids: dict[str, int] = {}
        self.mean = self.scale = self.w1 = self.b1 = self.w2 = None
        self.b2, self.temperature = 0.0, 1.0

    def __getstate__(self) -> dict:
        return self.__dict__ | {"ids": {}}

    def _row(self, token: str) -> int:
        h = token_hash(token)
        row = self.known.get(h)
        if row is None:
            row = h % ROWS
        if len(self.ids) < _REMEMBER:
            self.ids[token] = row
        return row

    def rows(self, text: str | None) -> np.ndarray:
        found = tokens(text)
        ids = self.ids
        return np.fromiter((ids[t] if t in ids else self._row(t) for t in found), np.int64, len(found))

    def pooled(self, text: str | None) -> np.ndarray:
        """Mean and spread of the token vectors, the shares of distinct tokens and of tokens that repeat the one or two before, and the log of their number; zeros for no tokens."""
        rows = self.rows(text)
        if not len(rows):
            return np.zeros(2 * DIM + 4)
        each, times = np.unique(rows, return_counts=True)
        share = times / len(rows)
        v = self.vectors[each].astype(np.float64)
        mean = share @ v
        again = [(rows[k:] == rows[:-k]).mean() if len(rows) > k else 0.0 for k in (1, 2)]
        return np.r_[mean, np.sqrt(np.maximum(share @ (v * v) - mean * mean, 0)), len(each) / len(rows), again, np.log1p(len(rows)) / 10]

    def learn_vectors(self, runs: list[np.ndarray]) -> None:
        """Context vectors of the most frequent tokens of runs of token hashes."""
        each, counts = np.unique(np.concatenate(runs), return_counts=True)
        order = np.lexsort((each, -counts))[:VOCABULARY]
        chosen = np.sort(each[order[counts[order] > 1]])
        index, context = index_vectors(), np.zeros((len(chosen), DIM))
        for run in runs if len(chosen) else ():
            hashed = run % ROWS
            own = np.searchsorted(chosen, run)
            own = np.where(chosen[np.minimum(own, len(chosen) - 1)] == run, own, -1)
            for shift in range(1, CONTEXT + 1):
                for a, b in ((own[shift:], hashed[:-shift]), (own[:-shift], hashed[shift:])):
                    np.add.at(context, a[a >= 0], index[b[a >= 0]])
        norm = np.linalg.norm(context, axis=1, keepdims=True)
        self.known = {int(h): ROWS + i for i, h in enumerate(chosen)}
        self.ids = {}
        self.vectors = np.concatenate([self.vectors, context / np.maximum(norm, 1e-9)]).astype(np.float32)

    def _hidden(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probability of label 1 for pooled documents; one half before any fit."""
        if self.w1 is None:
            return np.full(len(x), 0.5)
        return 1 / (1 + np.exp(-np.clip((self._hidden(x) @ self.w2 + self.b2) / self.temperature, -30, 30)))

    def fit(self, x: np.ndarray, labels: np.ndarray, prior: float, epochs: int = 200, rate: float = 5e-3) -> QualityModel:
        """Adam on the cross-entropy of three pooled documents in four, weighted to the classes' true shares; the rest fit the temperature."""
        y = labels.astype(np.float64)
        held = np.arange(len(x)) % 4 == 0
        train = ~held if len({*y[~held]}) > 1 and held.any() else np.ones(len(x), bool)
        self.mean, self.scale = x[train].mean(0), x[train].std(0) + 1e-6
        rng = np.random.default_rng(3)
        self.w1, self.b1 = rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN)
        self.w2 = rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN)
        p = min(max(prior, 0.01), 0.99)
        weight = np.where(y == 1, p / max(y.mean(), 1e-6), (1 - p) / max(1 - y.mean(), 1e-6))
        names = ("w1", "b1", "w2", "b2")
        moment = {n: [np.zeros_like(getattr(self, n)), np.zeros_like(getattr(self, n))] for n in names}
        where, step = np.flatnonzero(train), 0
        for _ in range(epochs):
            rng.shuffle(where)
            for at in range(0, len(where), 256):
                part = where[at : at + 256]
                z, h = (x[part] - self.mean) / self.scale, self._hidden(x[part])
                d = (1 / (1 + np.exp(-np.clip(h @ self.w2 + self.b2, -30, 30))) - y[part]) * weight[part] / len(part)
                d_h = np.outer(d, self.w2) * (1 - h * h)
                step += 1
                for name, g in zip(names, (z.T @ d_h + 1e-4 * self.w1, d_h.sum(0), h.T @ d + 1e-4 * self.w2, d.sum()), strict=True):
                    m, v = moment[name]
                    m = moment[name][0] = m + 0.1 * (g - m)
                    v = moment[name][1] = v + 0.001 * (g * g - v)
                    setattr(self, name, getattr(self, name) - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8))
        check = held if held.any() else train
        logit = np.clip(self._hidden(x[check]) @ self.w2 + self.b2, -30, 30)
        choices = np.geomspace(0.5, 8, 41)
        loss = [(weight[check] * (np.logaddexp(0, logit / t) - y[check] * logit / t)).sum() for t in choices]
        self.temperature = float(choices[int(np.argmin(loss))])
        return self


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel:
    """A model fitted on at most ``per_class`` labelled documents of each class.

    The few sampled ids are broadcast to the documents, so no text is shuffled for the others, and no
    text reaches the driver: hashes of at most LEARN_TOKENS tokens of each sampled document do, and then
    its features. An id that comes with several texts counts once, with the smallest. Without rows
    of both classes the model scores one half everywhere.
    """
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.min(label_col).alias("_label"))
    shares = {r[0]: r[1] for r in usable.groupBy("_label").count().collect()}
    picked = bounded_sample(usable, "_label", per_class, "_id")
    found = docs.join(F.broadcast(picked), F.col(id_col).cast("long") == F.col("_id")).where(F.col(text_col).isNotNull())
    sample = shared_table(found.groupBy("_id", "_label").agg(F.min(F.col(text_col).cast("string")).alias("_text")), "sample")
    model = QualityModel()

    def hashes(batch: pa.RecordBatch) -> pa.RecordBatch:
        runs = []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            found = tokens(text)
            at = zlib.crc32(str(key).encode()) % max(1, len(found) - LEARN_TOKENS + 1)
            runs.append(np.array([token_hash(t) for t in found[at : at + LEARN_TOKENS]], np.uint32).tobytes())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(runs, pa.binary())], names=["_id", "run"])

    runs = sorted(map(tuple, map_batches(sample, hashes, "_id long, run binary").collect()))
    if len(shares) < 2 or not runs:
        return model
    model.learn_vectors([np.frombuffer(bytes(r), np.uint32).astype(np.int64) for _, r in runs])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by VOCABULARY and ROWS

    def features(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.int32()), pa.array([shared.value.pooled(t).tobytes() for t in batch.column(2).to_pylist()], pa.binary())], names=["_id", "_label", "x"])

    rows = map_batches(sample, features, "_id long, _label int, x binary").collect()
    rows = sorted(map(tuple, rows), key=lambda r: (zlib.crc32(str(r[0]).encode()), r[0]))
    y = np.array([r[1] for r in rows])
    if len({*y.tolist()}) < 2:
        return model
    return model.fit(np.stack([np.frombuffer(bytes(r[2])) for r in rows]), y, shares[1] / sum(shares.values()))


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with quality_score: the model's probability of good quality for the whole text, null and empty ones too."""
    names = [c for c in docs.columns if c != "quality_score"]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by VOCABULARY and ROWS

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = shared.value
        x = np.array([model.pooled(t) for t in batch.column(names.index(text_col)).to_pylist()])
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(x), pa.float64())], names=[*names, "quality_score"])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return map_batches(docs.select(*(F.col(f"`{c}`") for c in names)), make, f"{fields}, quality_score double")


def classify(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row, learnt from labels outside the held-out fold.

    Null and empty texts are scored as documents without tokens. A null id belongs to no fold:
    its row is scored and held_out is null. Labels other than 0 and 1 are ignored; an id labelled
    twice counts once, with its lower label. Without labels of both classes all scores are 0.5.
    A very long text is pooled as a whole. A score of exactly 0.5 predicts 1.
    Repeated rows are all returned; other columns are not read. An empty table gives an empty table.
    """
    model = train(docs, labels.where(bucket_of(id_col, folds) != held_out), id_col=id_col, text_col=text_col)
    scored = score(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), model, "doc_id", "text")
    return scored.select("doc_id", (bucket_of("doc_id", folds) == held_out).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))
