"""Language identification by a convolutional network over bytes, written in numpy.

Windows of ``WINDOW`` bytes are embedded, filters of several widths run over them, each filter's
maximum over the window is kept, and a softmax layer gives a probability per language. The
network is trained on a bounded sample of windows; a document's whole text is cut into windows
and their log probabilities are averaged.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelscope.llm.common import bounded_sample, bucket_of, map_batches

WINDOW, EMBED, WIDTHS, FILTERS = 128, 8, (2, 3, 4), 8
#: Bounds of the training sample: documents of each language, and windows of a document.
SAMPLE_PER_LANGUAGE, WINDOWS_PER_DOCUMENT = 800, 3
_LETTER = re.compile(r"[^\W\d_]")
#: Windows that go through the network at once.
_AT_ONCE = 256


class ByteNet:
    """Embedding, convolutions of several widths, maximum over the window, softmax."""

    def __init__(self, languages: list[str], seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.languages, wide = languages, max(WIDTHS)
        self.embed = rng.normal(0, 0.3, (256, EMBED)).astype(np.float32)
        self.filters = np.zeros((wide * EMBED, FILTERS * len(WIDTHS)), np.float32)
        self.mask = np.zeros_like(self.filters)
        for i, w in enumerate(WIDTHS):
            self.mask[: w * EMBED, i * FILTERS : (i + 1) * FILTERS] = 1
        self.filters += self.mask * rng.normal(0, 0.3, self.filters.shape).astype(np.float32)
        self.bias = np.zeros(FILTERS * len(WIDTHS), np.float32)
        self.out = rng.normal(0, 0.3, (FILTERS * len(WIDTHS), len(languages))).astype(np.float32)
        self.out_bias = np.zeros(len(languages), np.float32)

    def _patches(self, windows: np.ndarray) -> np.ndarray:
        wide = max(WIDTHS)
        embedded = self.embed[windows].reshape(len(windows), WINDOW * EMBED)
        steps = WINDOW - wide + 1
        return np.lib.stride_tricks.as_strided(embedded, (len(windows), steps, wide * EMBED), (embedded.strides[0], EMBED * 4, 4))

    def _forward(self, windows: np.ndarray) -> tuple:
        patches = np.ascontiguousarray(self._patches(windows))
        response = patches.reshape(-1, patches.shape[2]) @ self.filters
        response = response.reshape(len(windows), patches.shape[1], -1)
        peak = response.max(1) + self.bias
        pooled = np.maximum(peak, 0)
        score = pooled @ self.out + self.out_bias
        score -= score.max(1, keepdims=True)
        return patches, response, pooled, score - np.log(np.exp(score).sum(1, keepdims=True))

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(windows[i : i + _AT_ONCE])[3] for i in range(0, len(windows), _AT_ONCE)])

    def fit(self, windows: np.ndarray, labels: np.ndarray, epochs: int = 12, rate: float = 3e-3, seed: int = 7) -> ByteNet:
        """Adam on the cross-entropy, in a seeded order."""
        rng, names = np.random.default_rng(seed), ("embed", "filters", "bias", "out", "out_bias")
        moment = {n: [np.zeros_like(getattr(self, n)), np.zeros_like(getattr(self, n))] for n in names}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for at in range(0, len(order), 64):
                x, y = windows[order[at : at + 64]], labels[order[at : at + 64]]
                patches, response, pooled, logp = self._forward(x)
                d = np.exp(logp)
                d[np.arange(len(y)), y] -= 1
                d /= len(y)
                d_pooled = (d @ self.out.T) * (pooled > 0)
                best = response.argmax(1)
                picked = np.take_along_axis(patches, best[:, :, None], 1)  # sample, filter, patch
                d_filters = np.einsum("nfp,nf->pf", picked, d_pooled, optimize=True) * self.mask
                d_patch = d_pooled[:, :, None] * self.filters.T[None]
                d_embed = np.zeros_like(self.embed)
                for k in range(max(WIDTHS)):
                    np.add.at(d_embed, np.take_along_axis(x, best + k, 1), d_patch[:, :, k * EMBED : (k + 1) * EMBED])
                step += 1
                for name, g in zip(names, (d_embed, d_filters, d_pooled.sum(0), pooled.T @ d, d.sum(0)), strict=True):
                    m, v = moment[name]
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    getattr(self, name)[...] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return self


def windows_of(text: str) -> np.ndarray:
    """The lower-cased UTF-8 bytes of the whole text in windows; the last is padded with zeros."""
    raw = text.lower().encode("utf-8", "surrogatepass")
    padded = np.zeros(-(-max(len(raw), 1) // WINDOW) * WINDOW, np.uint8)
    padded[: len(raw)] = np.frombuffer(raw, np.uint8)
    return padded.reshape(-1, WINDOW)


def train(labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> ByteNet | None:
    """A network fitted on at most ``per_language`` documents of each language; none without labelled text.

    The sample depends on the ids alone and is drawn from ids, languages and hashes of the texts, so that no
    text leaves its place. Seeded windows are drawn where the sampled documents lie, and only they reach
    the driver. Rows without an id are not learnt from.
    """
    usable = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    usable = usable.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).withColumn("_text", F.xxhash64("text"))
    sampled = bounded_sample(usable.select("id", "lang", "_text"), "lang", per_language, "id").distinct()  # at most SAMPLE_TOTAL rows, four a language more
    picked = usable.join(sampled, ["id", "lang", "_text"], "left_semi").select("id", "text", "lang")

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, langs = [], []
        for key, text, lang in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if _LETTER.search(text):
                all_windows = windows_of(text)
                picked = np.random.default_rng(abs(key or 0)).choice(len(all_windows), min(len(all_windows), WINDOWS_PER_DOCUMENT), replace=False)
                found += [all_windows[i].tobytes() for i in picked]
                langs += [lang] * len(picked)
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(found, pa.binary())], names=["lang", "window"])

    rows = sorted(map(tuple, map_batches(picked, make, "lang string, window binary").collect()))
    languages = sorted({r[0] for r in rows})
    if not languages:
        return None
    windows = np.frombuffer(b"".join(bytes(r[1]) for r in rows), np.uint8).reshape(-1, WINDOW)
    return ByteNet(languages).fit(windows, np.array([languages.index(r[0]) for r in rows]))


def predict(docs: DataFrame, net: ByteNet | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for each row; ``und`` with score 0 for texts that are null or have no letter.

    The score is the geometric mean, over the windows, of the language's probability.
    """

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).to_pylist()
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        cut = [(i, windows_of(t)) for i, t in enumerate(texts) if net and t and _LETTER.search(t)]
        if cut:
            logp = net.log_probabilities(np.concatenate([w for _, w in cut]))
            starts = np.r_[0, np.cumsum([len(w) for _, w in cut])]
            means = np.add.reduceat(logp.astype(np.float64), starts[:-1]) / np.diff(starts)[:, None]
            for (i, _), row in zip(cut, means, strict=True):
                best = int(row.argmax())
                names[i], scores[i] = net.languages[best], float(min(1.0, np.exp(row[best])))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(names), pa.array(scores, pa.float64())], names=["id", "lang_pred", "score"])

    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(picked, make, "id long, lang_pred string, score double", rows=200)


def identify(docs: DataFrame, folds: int = 5, held_out: int = 0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row, learnt from text and language outside the held-out fold.

    Null and letterless texts are ``und`` with score 0, as is every text when nothing is labelled.
    A null id belongs to no fold: its row is predicted, not learnt from, and held_out is null.
    A very long text is a batch of its own and goes through the network in blocks of windows.
    Repeated rows are all returned; other columns are not read. An empty table gives an empty table.
    """
    net = train(docs.where(bucket_of(id_col, folds) != held_out), id_col=id_col, text_col=text_col, lang_col=lang_col)
    return predict(docs, net, id_col, text_col).select(F.col("id").alias("doc_id"), (bucket_of("id", folds) == held_out).alias("held_out"), "lang_pred", "score")
