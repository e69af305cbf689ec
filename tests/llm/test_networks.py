"""The two trained networks against plain loops and finite differences, exact ties of nearest neighbours, and the plan of the sample."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from labelscope.llm import language, neighbours, quality
from labelscope.sources.shared import read_table

SF = "/root/testdata/sf0.001"


def plain_forward(net, window):
    """Log probabilities of one window, letter by letter."""
    wide = max(language.WIDTHS)
    embedded = [[float(v) for v in net.embed[b]] for b in window]
    pooled = []
    for f in range(net.filters.shape[1]):
        peak = -math.inf
        for at in range(language.WINDOW - wide + 1):
            total = 0.0
            for k in range(language.WIDTHS[f // language.FILTERS]):
                for e in range(language.EMBED):
                    total += embedded[at + k][e] * float(net.filters[k * language.EMBED + e, f])
            peak = max(peak, total)
        pooled.append(max(0.0, peak + float(net.bias[f])))
    scores = [sum(p * float(net.out[f, c]) for f, p in enumerate(pooled)) + float(net.out_bias[c]) for c in range(net.out.shape[1])]
    total = math.log(sum(math.exp(s - max(scores)) for s in scores)) + max(scores)
    return [s - total for s in scores]


def test_byte_network_forward_against_plain_loops():
    net = language.ByteNet(["a", "b", "c"], seed=3)
    windows = np.random.default_rng(1).integers(0, 256, (5, language.WINDOW)).astype(np.uint8)
    windows[4, 20:] = 0
    got = net.log_probabilities(windows)
    assert np.abs(got - np.array([plain_forward(net, w.tolist()) for w in windows])).max() < 1e-4


def test_byte_network_gradients_against_differences(monkeypatch):
    """The first step of Adam moves each weight against its gradient's sign; the gradient is that of the loss."""
    rng = np.random.default_rng(2)
    windows, labels = rng.integers(97, 123, (24, language.WINDOW)).astype(np.uint8), rng.integers(0, 2, 24)
    net, moved = language.ByteNet(["a", "b"], seed=4), language.ByteNet(["a", "b"], seed=4)
    moved.fit(windows, labels, epochs=1, rate=1e-3)
    loss = lambda: -net._forward(windows)[3].astype(np.float64)[np.arange(24), labels].mean()
    checked = 0
    for name in ("embed", "filters", "bias", "out", "out_bias"):
        weights = getattr(net, name)
        step = (getattr(moved, name) - weights).ravel()
        flat = weights.reshape(-1)
        for i in np.argsort(-np.abs(step))[:200:10]:
            kept, h = flat[i], np.float32(2e-2)
            flat[i] = kept + h
            up = loss()
            flat[i] = kept - h
            down = loss()
            flat[i] = kept
            slope = (up - down) / (2 * h)
            if abs(slope) > 2e-3:
                assert np.sign(slope) == -np.sign(step[i]), (name, i, slope, step[i])
                checked += 1
    assert checked > 20


def test_language_score_is_the_windows_geometric_mean(spark):
    docs = read_table(spark, SF, "documents")
    net = language.train(docs)
    rows = docs.limit(12).collect()
    got = {r.id: (r.lang_pred, r.score) for r in language.predict(docs, net).collect()}
    for r in rows:
        raw = r.text.lower().encode()
        cut = [raw[i : i + language.WINDOW].ljust(language.WINDOW, b"\0") for i in range(0, max(1, len(raw)), language.WINDOW)][:40]
        if len(raw) > 40 * language.WINDOW:
            continue
        means = np.mean([plain_forward(net, list(w)) for w in cut], axis=0)
        assert got[r.doc_id][0] == net.languages[int(means.argmax())] and abs(got[r.doc_id][1] - math.exp(means.max())) < 1e-3


def test_language_sample_moves_no_texts(spark):
    docs = read_table(spark, SF, "documents")
    usable = docs.selectExpr("doc_id AS id", "lang", "xxhash64(text) AS _text")
    plan = language.bounded_sample(usable, "lang", 50, "id")._jdf.queryExecution().executedPlan().toString()
    limits = [line for line in plan.split("\n") if "TakeOrdered" in line]
    assert limits and not any("text#" in line.replace("_text#", "") for line in limits)


def test_quality_vectors_against_plain_counts():
    rng = random.Random(4)
    runs = [np.array([rng.choice([5, 9, 70, 811, 4096, 12345]) for _ in range(rng.randint(0, 30))], np.int64) for _ in range(12)]
    model = quality.QualityModel()
    model.learn_vectors(runs)
    index, want = quality.index_vectors(), {}
    for run in runs:
        for i, token in enumerate(run.tolist()):
            for j in range(max(0, i - quality.CONTEXT), min(len(run), i + quality.CONTEXT + 1)):
                if j != i:
                    want.setdefault(token, np.zeros(quality.DIM))
                    want[token] += index[int(run[j]) % quality.ROWS]
    for token, row in model.known.items():
        assert np.abs(model.vectors[row] - want[token] / max(np.linalg.norm(want[token]), 1e-9)).max() < 1e-5


def test_quality_score_against_plain_loops():
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(80, 5)), (rng.random(80) < 0.7).astype(int)
    model = quality.QualityModel().fit(x, y, 0.7, epochs=3)
    for row, got in zip(x, model.score(x), strict=True):
        z = [(a - m) / s for a, m, s in zip(row, model.mean, model.scale, strict=True)]
        hidden = [math.tanh(sum(z[i] * model.w1[i, j] for i in range(5)) + model.b1[j]) for j in range(quality.HIDDEN)]
        logit = (sum(h * w for h, w in zip(hidden, model.w2, strict=True)) + model.b2) / model.temperature
        assert abs(got - 1 / (1 + math.exp(-logit))) < 1e-9


def test_quality_gradients_against_differences():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(120, 4))
    y = (x[:, 0] + 0.3 * rng.normal(size=120) > 0).astype(int)
    before, after = quality.QualityModel().fit(x, y, y.mean(), epochs=0), quality.QualityModel().fit(x, y, y.mean(), epochs=1, rate=1e-4)
    part = np.flatnonzero(np.arange(120) % 4 != 0)  # one batch
    p = min(max(y.mean(), 0.01), 0.99)
    weight = np.where(y == 1, p / y.mean(), (1 - p) / (1 - y.mean()))

    def loss():
        logit = before._hidden(x[part]) @ before.w2 + before.b2
        return (weight[part] * (np.logaddexp(0, logit) - y[part] * logit)).mean() + 5e-5 * ((before.w1**2).sum() + (before.w2**2).sum())

    for name in ("w1", "b1", "w2"):
        weights = getattr(before, name)
        step = getattr(after, name) - weights
        for i in range(0, weights.size, 3):
            kept = weights.flat[i]
            weights.flat[i] = kept + 1e-5
            up = loss()
            weights.flat[i] = kept - 1e-5
            down = loss()
            weights.flat[i] = kept
            slope = (up - down) / 2e-5
            if abs(slope) > 1e-5:
                assert np.sign(slope) == -np.sign(step.flat[i]), (name, i)


@pytest.mark.parametrize("width", [32, 64, 128])
def test_scores_do_not_depend_on_place_or_number(spark, width):
    """Equal vectors score alike wherever they stand, so ties rank by id, and a pair's score is the same beside any others."""
    rng = np.random.default_rng(width)
    same, query = ([float(v) for v in np.float32(rng.normal(size=width))] for _ in range(2))
    others = [[float(v) for v in np.float32(rng.normal(size=width) * 0.01)] for _ in range(40)]
    seen = set()
    for n in (1, 2, 7, 51, 130):
        rows = [(0, query)] + [(i + 1, same) for i in range(n)] + [(1000 + i, v) for i, v in enumerate(others[: n % 41])]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(2)
        found = sorted((r.rank, r.vec_id, r.score) for r in neighbours.search(df, df.where("vec_id = 0"), k=20, probed=1, rerank=None).collect())
        alike = [(i, s) for _, i, s in found if 1 <= i <= n]
        assert [i for i, _ in alike] == list(range(1, min(n, 20) + 1))
        seen |= {s for _, s in alike}
    x, v = np.array(same), np.array(query)
    assert seen == {float((x * v).sum())}
