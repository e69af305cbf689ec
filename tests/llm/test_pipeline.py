"""The pipeline, stage by stage, against plain Python over what the stage before kept."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline as P
from labelscope.llm import pieces, quality, substring
from labelscope.sources.shared import read_table, shared_table
from tests.llm.test_documents import WORDS, brute_repeats, components, shingle_set, water_filling

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark):
    docs = read_table(spark, SF, "documents")
    stage = dict(P.STAGES)
    assert list(stage) == ["quality", "minhash_near_dedup", "substring_dedup", "mixing", "sentencepiece"]

    kept = shared_table(stage["quality"](spark, docs, SF))
    scores = {r.doc_id: r.predicted for r in quality.classify(docs, read_table(spark, SF, "labels")).collect()}
    assert {r.doc_id for r in kept.collect()} == {i for i, p in scores.items() if p}
    assert kept.columns == COLUMNS

    single = shared_table(stage["minhash_near_dedup"](spark, kept, SF))
    texts = {r.doc_id: r.text for r in kept.collect()}
    sets = {i: shingle_set(t, 5) for i, t in texts.items()}
    linked = {i: {j for j in sets if j != i and sets[i] and sets[j] and 100 * (x := len(sets[i] & sets[j])) >= 80 * (len(sets[i]) + len(sets[j]) - x)} for i in sets}
    low = components(sorted(sets), linked)
    assert {r.doc_id for r in single.collect()} == {i for i in low if low[i] == i}

    cut = shared_table(stage["substring_dedup"](spark, single, SF))
    want = brute_repeats(sorted((r.doc_id, r.text) for r in single.collect()), substring.SPAN, substring.MIN_WORDS)
    got = {r.doc_id: r.text for r in cut.collect()}
    assert got == {i: t for i, t in want.items() if t.strip() or t == texts[i]}
    assert all(r.n_chars == len(r.text) for r in cut.collect()) and cut.columns == COLUMNS

    mixed = shared_table(stage["mixing"](spark, cut, SF))
    sizes, taken = Counter(), Counter()
    for r in cut.collect():
        sizes[r.source] += len(WORDS.findall(r.text))
    for r in mixed.collect():
        taken[r.source] += len(WORDS.findall(r.text))
        assert r.text in got[r.doc_id]
    target = water_filling(dict(sizes), {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(sizes))}, 1.5 * sum(sizes.values()), 2)
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes) and mixed.columns == COLUMNS

    rows = pieces.decode(stage["sentencepiece"](spark, mixed, SF)).collect()
    assert Counter(r.text for r in rows if r["sample"] == 1) == Counter(r.text.replace("▁", " ") for r in mixed.collect())
    assert P.run(spark, SF).count() == len(rows)


def test_stages_on_no_rows_and_nulls(spark):
    docs = read_table(spark, SF, "documents")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, None, "en", "src1", 0), (2, "", "en", None, 0)], docs.schema)
    for name, stage in P.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name
        stage(spark, odd, SF).collect()


CLASHING = ["quality_score", "size", "target", "whole", "part", "n_removed", "removed_words", "component_id", "kept", "sample", "ids"]


def test_stages_on_repeated_rows_long_texts_ties_and_clashing_columns(spark):
    """Each stage on the same odd documents: what is equal is treated alike, and columns called like its own do not matter."""
    docs = read_table(spark, SF, "documents")
    some = [tuple(r) for r in docs.limit(12).collect()]
    long = " ".join(f"word{k % 977} of a very long text." for k in range(4_000))
    rows = [*some, some[3], some[3], (some[4][0], some[5][1], "en", "src1", 5), (900_001, long, "en", "src2", len(long)), (900_002, long, "en", "src2", len(long)), (900_003, "tie", "en", "src3", 3), (900_003, "tie", "en", "src3", 3)]
    plain = spark.createDataFrame(rows, docs.schema).repartition(3)
    wide = plain.selectExpr("*", *(f"'x' AS {c}" for c in CLASHING))
    stage = dict(P.STAGES)

    good = stage["quality"](spark, plain, SF).collect()
    by = Counter(map(tuple, good))
    assert all(n == Counter(rows)[r] for r, n in by.items())  # equal rows stay or go together
    assert sum(r.text == long for r in good) in (0, 2)

    single = stage["minhash_near_dedup"](spark, plain, SF).collect()
    assert sum(r.text == long for r in single) == 1 and min(r.doc_id for r in single if r.text == long) == 900_001
    assert sum(tuple(r) == some[3] for r in single) == 1 and all(isinstance(r.doc_id, int) for r in single)

    cut = stage["substring_dedup"](spark, plain, SF).collect()
    assert sum(r.text == long for r in cut) <= 1 and all(r.n_chars == len(r.text) for r in cut if r.text is not None and tuple(r) not in Counter(rows))

    mixed = stage["mixing"](spark, plain, SF).collect()
    assert {r.doc_id for r in mixed} <= {r[0] for r in rows} and max(Counter(r.doc_id for r in mixed if r.text == long).values(), default=0) <= 2

    pieces_of = stage["sentencepiece"](spark, plain, SF).collect()
    assert Counter(r.doc_id for r in pieces_of if r["sample"] == 1) == Counter(r[0] for r in rows)
    assert {r.text for r in pieces_of if r.doc_id == 900_001} == {long}

    for name, own in stage.items():
        base, more = own(spark, plain, SF), own(spark, wide, SF)
        keys = [c for c in base.columns if c != "perturbed"]
        a, b = (Counter(repr([r[c] for c in keys]) for r in df.select(*keys).collect()) for df in (base, more))
        assert a == b, name
