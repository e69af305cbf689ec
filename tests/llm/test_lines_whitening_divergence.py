"""Line removal, whitening and source divergence against plain Python and numpy on small tables."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from labelscope.llm import divergence, lines, registry, whitening
from labelscope.sources.shared import read_table

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_lines string, key string"
SPACE = " \t\n\x0b\x0c\r"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def documents(spark, rows):
    return spark.createDataFrame([(i, t, g, s, "x", "y") for i, t, g, s in rows], DOCS).repartition(3)


def shared_rows(seed=1, n=60):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice(["Ärger", "line", "ONE", "two", "zwei", "x"]) for _ in range(rng.randint(1, 9))) for _ in range(40)]
    rows = []
    for i in range(n):
        some = [rng.choice(pool) if rng.random() < 0.8 else f"only in document {i} {k}" for k in range(rng.randint(0, 12))]
        text = "\n".join(rng.choice(["", "\t", " \r"]) + (s.upper() if rng.random() < 0.3 and "Ä" not in s and "r" not in s[:1] else s) + rng.choice(["", " ", "\x0b"]) for s in some)
        rows.append((i, text, "de", "a"))
    rows += [(100, None, None, None), (101, "", "de", "a"), (102, "\n\n", "de", None), (3, rows[3][1], "de", "a"), (3, rows[4][1], "de", "b"), (None, rows[5][1], "de", "a"), (None, rows[5][1], "de", "a")]
    hot = "this very line stands in a third of all documents"
    return [(i, t if i is None or t is None or i % 3 else f"{t}\n{hot}\n{hot}", g, s) for i, t, g, s in rows]


def brute_lines(rows, min_chars=20, min_docs=3):
    key = lambda line: lowered(line.strip(SPACE))
    held = defaultdict(set)
    for i, text, *_ in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                held[key(line)].add(-1 if i is None else i)
    out = []
    for i, text, *_ in rows:
        every = (text or "").split("\n")
        kept = [x for x in every if len(held[key(x)]) < min_docs or max(held[key(x)]) == (-1 if i is None else i)]
        out.append((i, len(every), len(every) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("batches", [1, 3, 7])
def test_lines_against_brute_force(spark, batches):
    rows = shared_rows()
    cut = lines.drop_repeated_lines(documents(spark, rows), batches=batches)
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in cut.collect()) == Counter(brute_lines(rows))
    assert sorted(cut.columns) == sorted(["doc_id", "text", "lang", "source", "key", "n_lines", "n_dropped"])


def test_runs_are_disjoint_and_compacted(spark):
    rows = shared_rows(2, 80)
    docs = documents(spark, rows)
    store = lines.LineRuns(spark, fanout=2)
    for batch in lines._batches(docs, "doc_id", 6):
        store.add(lines.line_counts(batch))
    assert max(map(len, store.levels)) <= 2 and len(store.levels) > 1
    keys = [(r.h1, r.h2) for name in store.runs() for r in spark.table(name).collect()]
    assert len(keys) == len(set(keys)) == lines.line_counts(docs).count()
    whole = {(r.h1, r.h2): r["last"] for r in lines.line_counts(docs).collect() if r.docs >= 3}
    assert {(r.h1, r.h2): r["last"] for r in store.frequent(3).collect()} == whole
    names = store.runs()
    store.close()
    assert not any(spark.catalog.tableExists(n) for n in names)


def test_batches_take_every_row_once(spark):
    docs = documents(spark, shared_rows())
    found = [b.collect() for b in lines._batches(docs, "doc_id", 5)]
    assert sum(map(len, found)) == docs.count()
    tops = [max((r.doc_id for r in f if r.doc_id is not None), default=-1) for f in found]
    assert tops == sorted(tops, reverse=True)


def test_lines_of_long_texts_ties_and_no_rows(spark):
    long = "\n".join(f"a line of a long text, number {k % 4000}" for k in range(12000)) + "\n" + "x" * 300_000
    rows = [(1, long, "", ""), (2, long, "", ""), (3, long, "", ""), (4, "a line of a long text, number 7", "", "")]
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in lines.drop_repeated_lines(documents(spark, rows)).collect()}
    assert got == {i: (n, d, t) for i, n, d, t in brute_lines(rows)}
    assert lines.drop_repeated_lines(documents(spark, rows).limit(0)).count() == 0


def test_lines_use_no_python(spark):
    plan = lines.drop_repeated_lines(documents(spark, shared_rows()))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_op11_digest(spark):
    docs = read_table(spark, SF, "documents")
    got = {(r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in registry.op11_line_dedup(spark, SF).collect()}
    assert got == {(i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in brute_lines([(r.doc_id, r.text) for r in docs.collect()])}


VECTORS = "vec_id long, embedding array<double>, label int, component string, n string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "c", "n") for i, v in rows], VECTORS).repartition(3)


def eigen(x, k=8):
    """Whitened rows, explained shares and variances of whole-number rows, by the covariance matrix."""
    centred = x - x.sum(0) / len(x)
    e, v = np.linalg.eigh(centred.T @ centred / len(x))
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    return centred @ v, e, e / np.trace(centred.T @ centred / len(x))


def check_whitened(rows, found, k=8, tolerance=1e-7):
    x = np.array([np.floor(1024 * np.array(v)) for _, v in rows]) + 100_000
    y, e, part = eigen(x, k)
    m = int((e > 1e-12 * e.sum() / max(part.sum(), 1e-300)).sum())
    by = defaultdict(dict)
    for r in found:
        by[r.vec_id][r.component] = r
    assert sorted(by) == sorted(i for i, _ in rows) and all(sorted(c) == list(range(1, m + 1)) for c in by.values())
    n, total = len(rows), [int(s) for s in x.sum(0)]
    for at, (i, _) in enumerate(rows):
        deviation = sum((n * int(a) - s) ** 2 for a, s in zip(x[at], total, strict=True))
        assert all(r.n == n and r.deviation == deviation and r.identity_error <= 1e-4 for r in by[i].values())
    for c in range(m):
        got = np.array([by[i][c + 1].whitened for i, _ in rows])
        want = y[:, c] / np.sqrt(e[c])
        sign = np.sign(got @ want)
        assert np.abs(sign * got - want).max() <= tolerance * max(1, np.abs(want).max())
        assert abs(by[rows[0][0]][c + 1].explained - part[c]) <= 1e-8


@pytest.mark.parametrize("size, n, scales", [(12, 90, 1.0), (20, 300, "steep"), (5, 40, "steep"), (16, 9, 1.0), (3, 2, 1.0)])
def test_whitening_against_eigenvectors(spark, size, n, scales):
    rng = np.random.default_rng(size)
    spread = np.ones(size) if scales == 1.0 else 10.0 ** -np.linspace(0, 3, size)
    turn = np.linalg.qr(rng.normal(size=(size, size)))[0]
    rows = [(i, [float(v) for v in (rng.normal(size=size) * spread) @ turn + 3]) for i in range(n)]
    check_whitened(rows, whitening.whiten(vectors(spark, rows)).collect())


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) for v in rng.normal(size=6)]) for i in range(30)]
    rows += [(30, [0.0] * 6), (31, rows[0][1]), (32, [-1e3, *rows[1][1][1:]])]
    bad = [(40, None), (41, []), (42, [float("nan"), *rows[0][1][1:]]), (43, [None, *rows[0][1][1:]]), (44, [float("inf")] * 6), (45, [1e300] * 6)]
    check_whitened(rows, whitening.whiten(vectors(spark, rows + bad)).collect())
    # repeated rows count each; another size is a list of its own
    again = [*rows, (7, rows[7][1])]
    found = whitening.whiten(vectors(spark, [*again, (90, [1.0, 2.0]), (91, [2.0, 5.0])])).collect()
    assert {r.n for r in found if r.vec_id < 90} == {len(again)} and sum(r.vec_id == 7 for r in found) == 12
    assert {(r.vec_id, r.component, r.n) for r in found if r.vec_id >= 90} == {(90, 1, 2), (91, 1, 2)}
    assert whitening.whiten(vectors(spark, rows).limit(0)).count() == 0
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0


def test_whitening_with_equal_variances_and_huge_deviations(spark):
    axes = [(2 * i + s, [float((1 - 2 * s) * (i == j)) for j in range(4)]) for i in range(4) for s in (0, 1)]
    found = whitening.whiten(vectors(spark, axes), k=3).collect()
    y = np.array([[r.whitened for r in sorted(found, key=lambda r: (r.vec_id, r.component)) if r.vec_id == i] for i, _ in axes])
    assert y.shape == (8, 3) and np.abs(y.T @ y / 8 - np.eye(3)).max() < 1e-9
    assert {round(r.explained, 9) for r in found} == {0.25} and max(r.identity_error for r in found) < 1e-9
    far = [(i, [float(i), float(2**33 * i)]) for i in range(4)]
    assert {r.deviation for r in whitening.whiten(vectors(spark, far)).collect()} == {None}


def test_op12_on_the_table(spark):
    rows = [(r.vec_id, r.embedding) for r in read_table(spark, SF, "embeddings").collect()]
    check_whitened(rows, registry.op12_whitening(spark, SF).collect())


def corpus(seed=3, n=50):
    rng = random.Random(seed)
    words = ["the", "The", "of", "éa", "ée", "é", "wörd", "word", "words", "wo", "w", "x" * 90, "x" * 90 + "y", "日本", "日本語", "a"]
    rows = []
    for i in range(n):
        text = rng.choice([" ", "3", "_", "\n"]).join(rng.choice(words) if rng.random() < 0.9 else f"rare{rng.choice('abcdefgh')}{rng.choice('abc')}" for _ in range(rng.randint(0, 25)))
        rows.append((i, text, rng.choice(["de", "en", None, ""]), rng.choice(["s1", "s2", "ß", None])))
    rows += [(60, None, "de", "s1"), (61, "", "xx", "s1"), (62, "only", "yy", "a"), (62, "only", "yy", "b"), (63, "only", "yy", "b"), (None, "none here", "zz", "a"), (None, "none here", "zz", "b"), (64, "none", "zz", "a"), (65, "none", "zz", "a"), (5, rows[5][1], rows[5][2], "s9"), (66, "...", "qq", "a"), (66, "!", "qq", "b")]
    return rows


def brute_divergence(rows, top=200):
    docs, counts, groups = defaultdict(set), Counter(), set()
    for i, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        word = ""
        for c in lowered(text or "") + " ":
            if "a" <= c <= "z" or ord(c) > 127:
                word += c
            elif word:
                docs[lang, word].add(i)
                counts[lang, source, word] += 1
                word = ""
    out = set()
    for lang in {g[0] for g in groups}:
        kept = sorted((t for g, t in docs if g == lang and len(docs[g, t]) >= 3), key=str.encode)
        own, v = sorted(s for g, s in groups if g == lang), len(kept)
        n = {s: sum(counts[lang, s, t] for t in kept) for s in own}
        p = {(s, t): 1 + 10**9 * (counts[lang, s, t] + 1) // (n[s] + v) for s in own for t in kept}
        q = {t: 1 + 10**9 * (sum(counts[lang, s, t] for s in own) + 1) // (sum(n.values()) + v) for t in kept}
        for s in own:
            pairs = sorted(((-sum((p[s, t] - p[o, t]) ** 2 // p[o, t] for t in kept), o.encode(), o) for o in own if o != s))
            out |= {(lang, s, "pair", o, -value, k + 1) for k, (value, _, o) in enumerate(pairs)}
            terms = sorted((-((p[s, t] - q[t]) ** 2 // q[t]), t.encode(), t) for t in kept if counts[lang, s, t] and p[s, t] > q[t])
            out |= {(lang, s, "term", t, -value, k + 1) for k, (value, _, t) in enumerate(terms[:top])}
    return out


@pytest.mark.parametrize("held, chunk, block, top", [(300_000, 50_000, 1 << 18, 200), (5, 7, 12, 200), (1, 1, 1, 2)])
def test_divergence_against_brute_force(spark, monkeypatch, held, chunk, block, top):
    for name, value in (("HELD_TERMS", held), ("CHUNK_ROWS", chunk), ("BLOCK_ENTRIES", block)):
        monkeypatch.setattr(divergence, name, value)
    rows = corpus()
    found = divergence.audit(documents(spark, rows), top=top).collect()
    assert len(found) == len(set(found))
    assert {tuple(r) for r in found} == brute_divergence(rows, top)


def test_divergence_of_no_rows_and_long_texts(spark):
    assert divergence.audit(documents(spark, corpus()).limit(0)).count() == 0
    long = " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}" for k in range(60_000)) + " " + "z" * 200_000
    rows = [(1, long, "en", "a"), (2, long, "en", "b"), (3, long, "en", "b"), (4, "wordaa wordaa", "en", "c")]
    assert {tuple(r) for r in divergence.audit(documents(spark, rows)).collect()} == brute_divergence(rows)


def test_refinement_discards_by_level():
    """Prefixes go as soon as their documents are too few, and only then."""
    words = {b"aa": [1, 2, 3], b"abc": [1], b"abd": [2], b"abe": [3], b"acxxxx": [1], b"b": [1], b"longer": [1, 2], b"longest": [2, 3], b"zz": [4, 5, None]}
    rows = [("en", t, d, ["s"], [1]) for t, d in sorted(words.items())]
    table = pa.table([pa.array(c) for c in zip(*rows, strict=True)], schema=divergence._SCHEMA)
    kept, left = divergence.refine(table, 3)
    assert kept.column("term").to_pylist() == [b"aa", b"zz"]
    # by two bytes ac and b go; by four, each of abc, abd, abe; by eight, whole terms, longer and longest
    assert left == [9, 7, 4, 2]


def test_shares_are_exact():
    counts, n = np.array([0, 1, 10**10, 4 * 10**17], np.int64), 10**18
    assert divergence.shares(counts, n, 4).tolist() == [1 + 10**9 * (int(c) + 1) // (n + 4) for c in counts]
    assert divergence.shares(counts[:2], 7, 4).tolist() == [1 + 10**9 // 11, 1 + 2 * 10**9 // 11]
