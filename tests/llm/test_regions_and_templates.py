"""Pages with several articles or text around one, and tables of very many licence templates."""

from __future__ import annotations

import pytest

from labelscope.llm import licenses, pages

ONE, TWO, THREE = (" ".join([w] * n) for w, n in (("one", 80), ("two", 40), ("three", 60)))


@pytest.mark.parametrize("html, want", [
    (f"<nav><a>Home</a></nav><article><p>{ONE}</p></article><article><p>{TWO}</p></article><footer>f</footer>", [ONE, TWO]),
    (f"<main><article><p>{ONE}</p></article></main><div><p>{THREE}</p></div>", [ONE, THREE]),
    (f"<div><p>{THREE}</p></div><article><h1>Title of it</h1><p>{ONE}</p></article>", [THREE, "Title of it", ONE]),
    (f"<article><p>{ONE}</p></article><div class='sidebar'><p>{THREE}</p></div><aside><p>{THREE}</p></aside>", [ONE]),
    (f"<article><header><h1>Title of it</h1></header><p>{ONE}</p></article><header><p>{THREE}</p></header>", ["Title of it", ONE]),
    (f"<div><div><h1>Title of it all</h1><p>{ONE}</p></div><div><p>{TWO}</p></div></div><ul class='menu'><li>a</li></ul>", ["Title of it all", ONE, TWO]),
    ("<article></article><p>" + ONE + "</p>", [ONE]),
])
def test_all_of_the_article_stays(html, want):
    assert pages.main_text(f"<html><body>{html}</body></html>") == "\n\n".join(want)


def test_tables_of_more_templates_than_a_task_holds(spark, monkeypatch):
    rows = [(f"l{i:03d}", f"licence number {i} of [the very] many {{0,2}} kinds") for i in range(57)] + [("any", "{1,1}"), (None, "x"), ("null", None)]
    table = spark.createDataFrame(rows, "label string, template string")
    texts = [(i, f"Here is licence number {i} of {'the very ' * (i % 2)}many {'a b ' * (i % 3 == 0)}kinds, and cc by.") for i in range(0, 60, 4)] + [(98, ""), (99, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(2)
    found = []
    for most in (10_000, 10):
        monkeypatch.setattr(licenses, "MOST_TEMPLATES", most)
        found.append(sorted(map(tuple, licenses.scan(docs, templates=table).collect()), key=repr))
    assert found[0] == found[1]
    labels = {r[0]: r[6] for r in found[0]}
    assert labels == {i: ",".join(sorted(["any", "cc-by", *([f"l{i:03d}"] if i < 57 else [])])) for i in range(0, 60, 4)} | {98: "", 99: ""}


def test_only_templates_of_words_that_a_text_has_are_tried(monkeypatch):
    tried = []
    real = licenses.accepts
    monkeypatch.setattr(licenses, "accepts", lambda moves, found: tried.append(1) or real(moves, found))
    matcher = licenses.Matcher([(f"l{i}", f"special{i} words here") for i in range(500)])
    found = licenses.words("some special7 words here and special8 only")
    assert matcher.labels(found, b" " + b" ".join(found) + b" ") == {"l7"} and len(tried) == 1
