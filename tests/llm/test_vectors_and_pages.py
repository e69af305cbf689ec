"""Vector and page operators against brute force on small fixtures, and the registered queries as a whole."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest

from labelscope.llm import neighbours, pages, registry, vectors
from labelscope.sources.shared import read_table

SCHEMA = "vec_id long, embedding array<float>, label int, digest string, n_links string, list string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, "d", "n", "l") for i, v, label in rows], SCHEMA).repartition(3)


def near_rows(size=16, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for label in (0, 1):
        for _ in range(8):
            base = rng.normal(size=size)
            for _ in range(6):
                rows.append((len(rows), [float(np.float32(x)) for x in base * rng.uniform(0.5, 2) + rng.normal(size=size) * 0.07 * rng.integers(0, 3)], label))
    v = rows[0][1]
    rows += [(len(rows) + k, x, y) for k, (x, y) in enumerate([(v, 0), (v, 1), (v, None), (None, 0), ([], 0), ([0.0] * size, 0), ([float("nan"), *v[1:]], 0), ([float("inf"), *v[1:]], 0), ([None, *v[1:]], 0), (v[:5], 0), ([-x for x in v], 0)])]
    return rows


def pairs_of_sizes():
    """Near pairs of 15 coordinates, spread unevenly over the blocks, beside longer and shorter vectors."""
    rng = np.random.default_rng(9)
    rows = []
    for size, pairs in ((15, 120), (64, 4), (3, 10), (1, 2), (17, 30)):
        for _ in range(pairs):
            x = rng.normal(size=size) * rng.choice([0.05, 1, 4], size)
            step = np.zeros(size)
            step[rng.integers(size) if rng.random() < 0.7 else slice(None)] = 1
            y = x + step * np.linalg.norm(x) * rng.uniform(0, 0.2) / np.linalg.norm(step)
            rows += [(len(rows), [float(v) for v in np.float32(x)], 1), (len(rows) + 1, [float(v) for v in np.float32(y)], 1)]
    return rows


def crowd(size=8, n=700):
    """One cell of many vectors, some of them equal, in a chain of near ones."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=size)
    return [(i, [float(v) for v in np.float32(base + rng.normal(size=size) * 0.13 * (i % 5))], i % 2) for i in range(n)]


@pytest.mark.parametrize("rows, chunk", [(near_rows(), 2048), (pairs_of_sizes(), 2048), (crowd(), 64)])
def test_embedding_links_against_brute_force(spark, monkeypatch, rows, chunk):
    monkeypatch.setattr(vectors, "CHUNK", chunk)
    good = {i: (np.array(v, np.float64), label) for i, v, label in rows if label is not None and vectors.usable(v) is not None}
    linked = defaultdict(set)
    for a, (x, p) in good.items():
        for b, (y, q) in good.items():
            if a != b and p == q and len(x) == len(y) and x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= 0.98:
                linked[a].add(b)
    low = {i: i for i, *_ in rows}
    for _ in rows:
        low = {i: min([low[i], *(low[j] for j in linked[i])]) for i in low}
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(frame(spark, rows)).collect()}
    assert got == {i: (len(linked[i]), low[i], low[i] == i) for i in low}
    assert sum(map(len, linked.values())) > 50


def test_embedding_repeats_null_ids_and_no_rows(spark):
    v = [1.0, 2.0, 3.0]
    df = frame(spark, [(5, v, 1), (5, v, 1), (None, v, 1), (8, v, 1)])
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(df).collect()), key=str)
    assert got == sorted([(5, 2, 5, True), (5, 2, 5, True), (8, 2, 5, False), (None, 0, None, None)], key=str)
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_a_close_pair_is_close_in_some_block():
    rng = np.random.default_rng(1)
    turn = vectors.rotation(64)
    assert np.allclose(turn @ turn.T, np.eye(64))
    for _ in range(50):
        x = rng.normal(size=64)
        x /= np.linalg.norm(x)
        y = x + rng.normal(size=64) * 0.02
        y /= np.linalg.norm(y)
        if x @ y >= 0.98:
            steps = vectors.turned(np.stack([x, y])).astype(float)
            assert any(((steps[0, c] - steps[1, c]) ** 2).sum() <= limit for c, limit in vectors.shares(64, 4, 0.98))


def crowded(n=1500):
    """Half of the vectors near one another, so that one list is hot, and some of another size."""
    rng = np.random.default_rng(6)
    base = rng.normal(size=24)
    rows = [(i, [float(v) for v in np.float32(base + 0.2 * rng.normal(size=24) if i % 2 else rng.normal(size=24))], 0) for i in range(n)]
    return rows + [(n + i, [float(v) for v in np.float32(rng.normal(size=9))], 0) for i in range(200)]


@pytest.mark.parametrize("data, exact_search", [("sf0.1", False), ("sf0.01", False), ("crowded", False), ("crowded", True)])
def test_neighbours_recall_scores_and_order(spark, monkeypatch, data, exact_search):
    if data == "crowded":
        monkeypatch.setattr(neighbours, "INDEX_BLOCK", 128)
        monkeypatch.setattr(neighbours, "QUERY_BLOCK", 32)
        df = frame(spark, crowded())
    else:
        df = read_table(spark, f"/root/testdata/{data}", "embeddings")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    more = {"probed": 1.0, "rerank": None} if exact_search else {"rerank": 40} if data == "crowded" else {}
    found = neighbours.search(df, df.where("vec_id % 20 = 0"), k=20, **more).collect()
    by = defaultdict(list)
    for r in found:
        by[r.query_id].append((r.rank, r.vec_id, r.score))
    original = {i: np.array(v, np.float64) for i, v in rows if vectors.usable(v) is not None}
    hits = asked = 0
    assert set(by) == {i for i in original if i % 20 == 0}
    for q, got in by.items():
        got.sort()
        want = sorted((-float(original[q] @ v), i) for i, v in original.items() if i != q and len(v) == len(original[q]))[:20]
        assert [r for r, *_ in got] == list(range(1, 21))
        assert all(s == pytest.approx(float(original[q] @ original[i]), abs=1e-12) for _, i, s in got)
        assert [(-s, i) for _, i, s in got] == sorted((-s, i) for _, i, s in got)
        hits += len({i for _, i, _ in got} & {i for _, i in want})
        asked += 20
    assert hits / asked >= (1.0 if exact_search else 0.9)


def test_neighbours_of_few_tied_and_odd_vectors(spark):
    v = [1.0, 0.0, 0.0]
    rows = [(0, v, 0), (20, v, 0), (7, v, 0), (3, v, 0), (4, [0.5, 0.0, 0.0], 0), (5, None, 0), (6, [0.0] * 3, 0), (9, [float("nan")] * 3, 0), (11, [1.0], 0), (None, v, 0), (7, v, 1)]
    df = frame(spark, rows)
    got = neighbours.search(df, df.where("vec_id % 20 = 0"), k=20).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == [(0, 1, 3, 1.0), (0, 2, 7, 1.0), (0, 3, 20, 1.0), (0, 4, 4, 0.5), (20, 1, 0, 1.0), (20, 2, 3, 1.0), (20, 3, 7, 1.0), (20, 4, 4, 0.5)]
    assert neighbours.search(df.limit(0), df.limit(0)).count() == 0


def odd_vectors(kind):
    """Rows on which shares of lists and coded scores alone say little about the nearest."""
    rng = np.random.default_rng(8)
    n = 1200
    if kind == "wide":
        x = rng.normal(size=(n, 256))
    elif kind == "tight":
        x = rng.normal(size=64) + 1e-3 * rng.normal(size=(n, 64))
    elif kind == "tiny":
        x = 1e-25 * rng.normal(size=(n, 24))
    elif kind == "lengths":
        x = rng.normal(size=(n, 24)) * rng.pareto(1.2, (n, 1))
    else:  # copies: equal scores beyond the rows that are ranked first, and outliers
        x = np.repeat(rng.normal(size=(4, 24)), n // 4, 0)
        x[::7] *= 1e6
    return [(i, [float(v) for v in r], 0) for i, r in enumerate(np.float32(x))]


@pytest.mark.parametrize("kind", ["wide", "tight", "tiny", "lengths", "copies"])
def test_neighbours_are_the_nearest_on_any_rows(spark, monkeypatch, kind):
    monkeypatch.setattr(neighbours, "INDEX_BLOCK", 500)
    rows = odd_vectors(kind)
    df = frame(spark, rows)
    found = defaultdict(list)
    for r in neighbours.search(df, df.where("vec_id % 20 = 0"), k=20).orderBy("query_id", "rank").collect():
        found[r.query_id].append(r.vec_id)
    x = np.array([v for _, v, _ in rows])
    assert set(found) == set(range(0, len(rows), 20))
    for q, got in found.items():
        score = (x * x[q]).sum(1)
        assert got == [int(i) for i in np.lexsort((np.arange(len(x)), -score)) if i != q][:20]


def test_neighbours_of_rows_that_repeat_an_id(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(v) for v in np.float32(rng.normal(size=8))], 0) for i in range(60)]
    rows += [(7, [float(v) for v in np.float32(50 + rng.normal(size=8))], 0) for _ in range(40)]
    df = frame(spark, rows)
    got = [r.vec_id for r in neighbours.search(df, df.where("vec_id = 0"), k=20).orderBy("rank").collect()]
    best = {i: max(float(np.dot(v, rows[0][1])) for j, v, _ in rows if j == i) for i in range(1, 60)}
    assert got == sorted(best, key=lambda i: (-best[i], i))[:20]


ARTICLE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href="/">Home</a></li><li><a href="/x">More</a></li></ul></nav><!-- note --><div class="ad">Buy now, a long sentence of advertising text.</div>
<div id="cookie-banner"><p>We use cookies and so on, please agree to all of it.</p></div>
<article><h1>Head &lt;1&gt;</h1><p>First   paragraph,
with <b>bold</b> text &amp; more of it to count.<p>Short.<ul><li>one</li><li>two</li></ul><form><input>Search here</form><blockquote>Quoted words, rather long as well, really.</blockquote>
<section class="comments"><p>A reader writes a very long comment about nothing at all.</p></section></article>
<aside>Related things</aside><footer>&copy; foot</footer></body></html>"""


def test_main_text():
    want = ["Head <1>", "First paragraph, with bold text & more of it to count.", "Short.", "one", "two", "Quoted words, rather long as well, really."]
    assert pages.main_text(ARTICLE) == "\n\n".join(want)
    assert pages.main_text(ARTICLE.split("<section")[0]) == "\n\n".join(want)


def test_main_text_without_an_article_element():
    html = "<body><div class='menu'><a>x</a></div><div><div><p>Long enough text of the page, first part.</p><p>And the second part, long as well.</p></div></div><div class='footer'>foot</div></body>"
    assert pages.main_text(html) == "Long enough text of the page, first part.\n\nAnd the second part, long as well."


def test_main_text_keeps_a_body_that_is_split():
    long, rest = "Most of the text of the page stands here. " * 12, "The rest of the text stands in a second element. " * 6
    for name in ("div", "section", "pre", "table"):
        inner = f"<tr><td>{long}</td></tr>" if name == "table" else long if name == "pre" else f"<p>{long}</p>"
        html = f"<body><div id=post><h1>Title</h1><{name}>{inner}</{name}><div><p>{rest}</p></div></div><div class='site-footer'>{rest}</div></body>"
        assert pages.main_text(html) == f"Title\n\n{long.strip()}\n\n{rest.strip()}", name


def test_marks_are_whole_tokens_or_known_compounds():
    text = "A text of the page that is long enough to count. " * 5
    for name in ("content with-sidebar", "post no-comments", "layout search-results", "sidebar-left", "skip-none"):
        assert pages.main_text(f"<body><div class='{name}'><p>{text}</p></div></body>") == text.strip(), name
    for name in ("x sidebar", "site-footer", "ad-slot-3", "main_menu", "cookie-banner", "comments-area", "related-posts"):
        assert pages.main_text(f"<body><div><p>{text}</p></div><div class='{name}'><p>{text}</p></div></body>") == text.strip(), name


LONG = "A text of the page that is long enough to count, and more of it. " * 6


@pytest.mark.parametrize(
    "html, want",
    [
        (f'<article><p>{LONG}<span class="ad">buy now</span> on</p></article>', [LONG.strip() + " on"]),
        (f'<article><h1>T</h1><h2 id="search">Search</h2><p>{LONG}</p></article>', ["T", "Search", LONG.strip()]),
        (f'<div id="social-history"><article><p>{LONG}</p></article></div>', [LONG.strip()]),
        (f'<div class="banner"><article><p>{LONG}</p></article></div>', [LONG.strip()]),
        (f'<body><div id="popup"><p>{LONG}</p></div><div class="footer">x</div></body>', [LONG.strip()]),
        (f"<header>Site</header><article><header><h1>Title</h1></header><p>{LONG}</p></article>", ["Title", LONG.strip()]),
        (f"<article><p>{LONG}<button>Go</button> end</p></article>", [LONG.strip() + " end"]),
        (f'<article><p>{LONG}</p></article><section class="comments"><article class="comment"><p>{LONG * 9}</p></article></section>', [LONG.strip()]),
        (f"<div><p>{LONG}</p></div><div><p>{LONG}</p></div>", [LONG.strip()] * 2),
    ],
)
def test_main_text_of_odd_pages(html, want):
    assert pages.main_text(html) == "\n\n".join(want)


@pytest.mark.parametrize("unit", ["<div>x", "<p><b>x", "<li><i class=ad>x", "<table><tr><td>x", "</div>x", "<span>"])
def test_a_page_of_unclosed_tags_takes_time_in_proportion(unit):
    import time

    begun = time.time()
    pages.main_text(unit * ((1 << 20) // len(unit)))
    assert time.time() - begun < 30


def plain_text(html):
    """What a plain walk over well-formed articles gives: block texts outside barred elements."""
    import re as r
    from html import unescape

    body = r.sub(r"(?s)<!--.*?-->|<(script|style|nav|aside|footer|form)\b.*?</\1>|<div class=.ad.>.*?</div>", "", html)
    body = r.search(r"(?s)<article>(.*?)</article>", body)
    cut = r.split(r"</?(?:p|h[1-6]|ul|ol|li|blockquote|div|section|pre|table|tr|td|th)\b[^>]*>", body[1] if body else "")
    found = [" ".join(unescape(r.sub(r"<[^>]*>", "", r.sub(r"<br\s*/?>", " ", c))).split()) for c in cut]
    return "\n\n".join(t for t in found if t)


def test_all_pages_against_a_plain_walk(spark):
    rows = read_table(spark, "/root/testdata/sf0.1", "pages").collect()
    got = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows)).collect()}
    wrong = [r.page_id for r in rows if got[r.page_id] != plain_text(r.html)]
    assert len(rows) == len(got) and not wrong, (len(wrong), wrong[:5])


def test_pages_edges(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>x"), (4, "u", "plain &amp text"), (5, "u", "<div>" * 2000 + "deep"), (5, "u", ARTICLE), (5, "u", ARTICLE), (6, "u", "<article></article>"), (7, "u", "<p>" + "word " * 20000)]
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = pages.extract(df).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    by = {(r.page_id, r.url): r.text for r in got if r.page_id != 5}
    assert by == {(1, "u"): "", (2, None): "", (None, "u"): "x", (4, "u"): "plain & text", (6, "u"): "", (7, "u"): ("word " * 20000).strip()}
    assert pages.extract(df.limit(0)).count() == 0


def test_smoothing_keeps_a_constant():
    assert pages.smoothed([3.0] * 7) == pytest.approx([3.0] * 7)
    assert pages.smoothed([]) == []


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, name):
    import os

    import duckdb

    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    df = registry.queries()[name](spark, sf)
    relation = c.execute(registry.oracle_sql()[name])
    names = [x[0] for x in relation.description]
    plain = lambda v: round(v, 5) if isinstance(v, float) else v
    want = sorted(([plain(v) for _, v in sorted(zip(names, r, strict=True))] for r in relation.fetchall()), key=repr)
    got = sorted(([plain(v) for _, v in sorted(zip(df.columns, r, strict=True))] for r in df.collect()), key=repr)
    assert got == want
