"""Document operators against brute force on small fixtures, with nulls, empties, ties and repeats."""

from __future__ import annotations

import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelscope.llm import language, licenses, minhash, mixing, pieces, quality, substring
from labelscope.llm.common import bounded_sample
from labelscope.llm.license_texts import TEMPLATES
from labelscope.sources.shared import read_table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id string, kept string, size string, digest string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, texts, ids=None):
    """Documents with extra columns whose names clash with the operators' own."""
    rows = [(i if ids is None else ids[i], t, "xx", f"s{i % 3}" if i % 7 else None, len(t or ""), "c", "k", "z", "d") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def shingle_set(text, n):
    w = WORDS.findall(lower(text))
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def near_texts(seed=5):
    rng = random.Random(seed)
    out = []
    for _ in range(6):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(20, 90))]
        out += [" ".join(base)] * 2
        for _ in range(8):
            copy = list(base)
            for _ in range(rng.randrange(0, 5)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            out.append(" ".join(copy).upper() if rng.random() < 0.3 else "  ".join(copy))
    return out + [None, "", " \n\t", "one", "ONE", "one one", "one one one", "é" * 50, "a b " * 4000, "a b " * 4001]


def components(ids, linked):
    low = {i: i for i in ids}
    while True:
        new = {i: min([low[i], *(low[j] for j in linked[i])]) for i in ids}
        if new == low:
            return low
        low = new


@pytest.mark.parametrize("n", [2, 5])
def test_minhash_links_exactly_what_brute_force_links(spark, n):
    texts = near_texts()
    sets = [shingle_set(t, n) for t in texts]
    linked = defaultdict(set)
    for a in range(len(texts)):
        for b in range(len(texts)):
            x = len(sets[a] & sets[b])
            if a != b and sets[a] and sets[b] and 100 * x >= 80 * (len(sets[a]) + len(sets[b]) - x):
                linked[a].add(b)
    want = components(range(len(texts)), linked)
    got = minhash.near_duplicates(frame(spark, texts), n=n).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(sets[i]), want[i], want[i] == i) for i in want}


def test_minhash_with_repeated_rows_null_ids_and_no_rows(spark):
    df = frame(spark, ["a b c d e f"] * 3 + ["q r s t u v"], ids=[4, 4, None, 9])
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(4, 4, True), (4, 4, True), (9, 9, True), (None, None, None)], key=str)
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_keep_one_tells_rows_of_one_id_apart(spark):
    a, b, c = ("".join(f"{x}{i} " for i in range(40)) for x in "abc")
    near = a + "tail "
    texts, ids = [a, near, b, a, c, c, c, None, None, "", near], [5, 9, 9, 2, 3, 3, None, 1, 1, 1, None]
    df = frame(spark, texts, ids)
    got = Counter((r.doc_id, r.text) for r in minhash.keep_one(df).collect())
    assert got == Counter([(9, b), (2, a), (3, c), (None, c), (1, None), (1, None), (1, ""), (None, near)])
    assert minhash.keep_one(df).columns == df.columns and minhash.keep_one(df.limit(0)).count() == 0


def test_minhash_keys_meet_within_the_limit():
    rng = np.random.default_rng(2)
    for _ in range(30):
        a = rng.integers(0, 256, minhash.SYMBOLS, dtype=np.uint8)
        b = a.copy()
        where = rng.choice(minhash.SYMBOLS, minhash.LIMIT, replace=False)
        b[where] ^= 1
        errors = (a != b).reshape(minhash.CHUNKS, minhash.WIDTH).sum(1)
        assert errors.min() <= minhash.ERRORS


def test_bitmap_bounds_the_intersection_from_above():
    rng = random.Random(4)
    for _ in range(50):
        a = minhash.shingle_hashes(" ".join(f"w{rng.randrange(60)}" for _ in range(80)), 1)
        b = minhash.shingle_hashes(" ".join(f"w{rng.randrange(60)}" for _ in range(80)), 1)
        x, y = (np.frombuffer(minhash.bitmap(h), np.uint64) for h in (a, b))
        assert len(np.intersect1d(a, b)) <= min(len(a) - np.bitwise_count(x & ~y).sum(), len(b) - np.bitwise_count(y & ~x).sum())


def brute_repeats(docs, span, least):
    """First places by (id, position); units of later runs go."""
    spans = defaultdict(list)
    parts = {i: substring.sentences(t) for i, t in docs}
    real = {i: [k for k, s in enumerate(p) if s.split()] for i, p in parts.items()}
    for i, _ in docs:
        for at in range(len(real[i])):
            end = at + span
            while end <= len(real[i]) and sum(len(parts[i][k].split()) for k in real[i][at:end]) < least:
                end += 1
            if end <= len(real[i]):
                spans[tuple(w for k in real[i][at:end] for w in parts[i][k].lower().split())].append((i, at, end))
    gone = defaultdict(set)
    for places in spans.values():
        for i, at, end in sorted(places)[1:]:
            gone[i] |= set(real[i][at:end])
    return {i: "".join(s for k, s in enumerate(parts[i]) if k not in gone[i]) for i, _ in docs}


def test_substring_against_brute_force(spark):
    rng = random.Random(8)
    sentence = lambda: " ".join(f"w{rng.randrange(3000)}" for _ in range(rng.randrange(1, 12))) + rng.choice([". ", "! ", "?\n", ".\n\n"])
    passage = "".join(sentence() for _ in range(6))
    texts = ["".join(sentence() for _ in range(rng.randrange(1, 15))) for _ in range(20)]
    texts = [t + passage + t[::-1] if i % 3 == 0 else t for i, t in enumerate(texts)] + [texts[1], "", "no end", passage + passage]
    df = frame(spark, texts)
    got = {r.doc_id: (r.text, r.size) for r in substring.drop_repeats(df).collect()}
    want = brute_repeats(list(enumerate(texts)), substring.SPAN, substring.MIN_WORDS)
    assert {i: t for i, (t, _) in got.items()} == want
    assert {s for _, s in got.values()} == {"z"}
    assert want[20] == "" and sum(passage in t for t in want.values()) == 1


def test_substring_nulls_and_no_rows(spark):
    text = "a b c d e f g h. i j k l m n o p. q r s. "
    df = frame(spark, [None, "", text, text, text, text, "few words. again. few words. again."], ids=[1, 2, None, 3, 4, 4, 5])
    got = {r.doc_id: (r.text, r.n_removed) for r in substring.drop_repeats(df).collect()}
    assert got[1] == (None, 0) and got[2] == ("", 0) and got[None][1] == 0 and got[3][1] == 0
    assert got[4] == ("", 3) and got[5][1] == 0
    assert substring.drop_repeats(df.limit(0)).count() == 0


def test_substring_leaves_long_texts_without_repeats_alone(spark):
    rng = random.Random(21)
    long = " ".join(f"w{rng.randrange(10**6)}{'.' if k % 9 == 0 else ''}" for k in range(60000))
    got = {r.doc_id: (len(r.text), r.n_removed) for r in substring.drop_repeats(frame(spark, [long, long[:200000]])).collect()}
    assert got[0] == (len(long), 0) and got[1][0] < 200


def test_run_hashes_follow_the_words_alone():
    rng = random.Random(3)
    words = [f"w{rng.randrange(50)}" for _ in range(400)]
    text, shifted = " ".join(words), "Other words before it.  " + "\n".join(words).upper()
    a, b = (dict(zip(h.tolist(), p.tolist(), strict=True)) for p, _, h in map(substring.span_hashes, (text, shifted)))
    assert len(set(a)) == len(a)
    plain, _, h = substring.span_hashes("x y z. " + text)
    assert len(set(h.tolist()) & set(a)) > 0.9 * len(a)


def test_sentences_join_to_the_text():
    for t in ("A 3.5 cat.  Sat!\n\nOn?", "", "...", "a\n\n\nb.\tc", 'He said "no." Then left'):
        assert "".join(substring.sentences(t)) == t


def water_filling(sizes, weights, mass, epochs):
    """Clamp, share the excess again by weight, until none is above its cap."""
    cap = {s: epochs * n for s, n in sizes.items()}
    fixed = {}
    while True:
        free = [s for s in sizes if s not in fixed]
        if not free:
            return fixed
        left, total = mass - sum(fixed.values()), sum(weights[s] for s in free)
        asked = {s: left * weights[s] / total for s in free}
        over = [s for s in free if asked[s] > cap[s]]
        if not over:
            return fixed | asked
        fixed |= {s: cap[s] for s in over}


def test_mixing(spark):
    rng = random.Random(2)
    texts = [" ".join("w" * rng.randrange(1, 5) for _ in range(rng.randrange(1, 60))) for _ in range(300)] + [None, "", " "]
    df = frame(spark, texts)
    source = {i: f"s{i % 3}" if i % 7 else None for i in range(len(texts))}
    sizes = Counter()
    for i, t in enumerate(texts):
        sizes[source[i]] += len(WORDS.findall(t or ""))
    order = sorted(s for s in sizes if s is not None) + [None]
    want = water_filling(dict(sizes), {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, 1.5 * sum(sizes.values()), 2)
    mixed = mixing.mix(df).persist()
    rows = mixed.collect()
    taken = Counter()
    for r in rows:
        assert r.target == pytest.approx(want[source[r.doc_id]]) and r.source_size == sizes[source[r.doc_id]]
        assert r.size == len(WORDS.findall(texts[r.doc_id] or "")) and 0 <= r.whole * r.size + r.part <= 2 * r.size
        taken[r.source] += r.whole * r.size + r.part
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    # a fraction is a choice of documents: all but one of each source are taken whole or not at all
    cut = Counter(r.source for r in rows if 0 < r.part < r.size)
    assert all(n <= 1 for n in cut.values()) and any(r.part == r.size > 0 for r in rows) and any(r.part == 0 < r.size for r in rows)
    copies = Counter()
    for r in mixing.repetitions(mixed).collect():
        copies[r.doc_id] += len(WORDS.findall(r.text))
        assert r.text in texts[r.doc_id]
    assert copies == Counter({r.doc_id: r.whole * r.size + r.part for r in rows if r.whole * r.size + r.part})
    again = {(r.doc_id, r.whole, r.part) for r in mixing.mix(df.repartition(7)).collect()}
    assert again == {(r.doc_id, r.whole, r.part) for r in rows}
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mix(df.where("text is null")).first().target == 0


def test_mixing_repeated_rows_null_ids_and_long_texts(spark):
    texts = ["one two three"] * 40 + [None, "x " * 200_000, "a b c d e", "a b c d e"]
    ids = [1] * 30 + [None] * 10 + [50, 51, 52, 52]
    df = frame(spark, texts, ids).withColumn("source", F.lit(None).cast("string")).withColumnRenamed("lang", "target")
    rows = mixing.mix(df).collect()
    whole = sum(r["size"] for r in rows)
    assert len(rows) == len(texts) and all(r.target == pytest.approx(1.5 * whole) for r in rows)
    assert abs(sum(r.whole * r["size"] + r.part for r in rows) - 1.5 * whole) <= 1
    key = lambda rows: Counter((r.doc_id, r["size"], r.whole, r.part) for r in rows)
    assert key(rows) == key(mixing.mix(df.repartition(1)).collect())
    mixed = mixing.repetitions(mixing.mix(df)).collect()
    assert sum(len(WORDS.findall(r.text)) for r in mixed) == sum(r.whole * r["size"] + r.part for r in rows)


def test_license_automata():
    m = licenses.compile_template("under [the] license {1,2} end")
    for text, ok in (("under the license x end", True), ("under license x y end now", True), ("under license end", False), ("under license a b c end", False), ("under the the license x end", False), ("zz under license q end", True)):
        assert licenses.accepts(m, licenses.words(text)) is ok, text
    assert licenses.words("Été CC-BY 4.0 x") == ["Été".encode().replace(b"\xc3\x89", "É".encode()).lower() if False else "Été".encode(), b"cc", b"by", b"4", "0 x".encode()]


def test_license_scan(spark):
    texts = ["Licensed under CC BY-NC 4.0.", "all rights reserved cc by cc BY general public license", "This work is licensed under the GNU General Public License, version 3.", None, "", "cc  by", "ccby", "x Licensed under the Apache License, Version 2.0. " * 500]
    got = {r.doc_id: r for r in licenses.scan(frame(spark, texts)).collect()}
    assert (got[0].n_base, got[0].first_word, got[0].base_labels, got[0].labels, got[0].score) == (1, 2, "cc-by", "cc-by,cc-by-nc-4.0", 1.0)
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels, got[1].score) == (4, 0, 7, "cc-by,gpl,reserved", 0.5)
    assert got[2].labels == "gpl,gpl-3.0"
    for i in (3, 4, 6):
        assert (got[i].n_base, got[i].first_word, got[i].labels, got[i].score) == (0, None, "", 0.0)
    assert got[5].n_base == 1 and got[7].labels == "apache-2.0"
    assert licenses.scan(frame(spark, texts).limit(0)).count() == 0


def filled(template, optional):
    """A text of the template: replaceable regions filled, optional ones all there or all left out."""
    t = re.sub(r"\{(\d+),\d+\}", lambda m: " ".join(["Someone"] * int(m[1])), template)
    return re.sub(r"\[([^\]]*)\]", r" \1 " if optional else " ", t)


@pytest.mark.parametrize("label", sorted(TEMPLATES))
def test_license_texts_are_accepted_and_one_changed_word_rejects(label):
    moves, must = licenses.compile_template(TEMPLATES[label]), licenses.mandatory_words(TEMPLATES[label])
    for optional in (True, False):
        found = licenses.words(f"Before it. {filled(TEMPLATES[label], optional)} And after.")
        assert licenses.accepts(moves, found) and must in b" " + b" ".join(found) + b" "
    mandatory = licenses.words(filled(TEMPLATES[label], False))
    free = {i for i, w in enumerate(mandatory) if w == b"someone"}
    for i in range(0, len(mandatory), max(1, len(mandatory) // 40)):
        if i not in free:
            assert not licenses.accepts(moves, [*mandatory[:i], b"changed", *mandatory[i + 1 :]]), mandatory[i]
            assert i == 0 or i == len(mandatory) - 1 or mandatory[i] in (mandatory[i - 1], mandatory[i + 1]) or free & {i - 1, i + 1} or not licenses.accepts(moves, mandatory[:i] + mandatory[i + 1 :]), mandatory[i]


def test_license_templates_from_a_table_and_without_words(spark):
    table = spark.createDataFrame([("a", "x [y] z"), ("b", "[q] {1,3}"), ("c", "{1,2} only here"), (None, "x"), ("d", None)], "label string, template string")
    texts = ["X, y: z!", "x z", "x q z", "it is only here", "only here", None]
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(frame(spark, texts), templates=table).collect()}
    assert got == {0: ("a,b", 1.0), 1: ("a,b", 1.0), 2: ("b", 1.0), 3: ("b,c", 1.0), 4: ("b", 1.0), 5: ("", 0.0)}
    assert licenses.scan(frame(spark, texts), templates={"e": "{0,2}"}).where("labels <> ''").count() == 5


def test_license_scan_of_repeated_rows_null_ids_and_long_texts(spark):
    long = "word " * 200_000 + filled(TEMPLATES["mit-text"], True)
    rows = [(r.doc_id, r.n_words, r.labels) for r in licenses.scan(frame(spark, ["cc by", "cc by", "cc by", long], ids=[7, 7, None, 8])).collect()]
    assert Counter(rows[:]) == Counter([(7, 2, "cc-by"), (7, 2, "cc-by"), (None, 2, "cc-by"), (8, 200_000 + len(licenses.words(filled(TEMPLATES["mit-text"], True))), "mit,mit-text")])


def test_language_accuracy_on_held_out(spark):
    docs = read_table(spark, "/root/testdata/sf0.01", "documents")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = language.identify(docs).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_nothing(spark):
    df = frame(spark, [None, "", "123 !!", "abc"])
    got = {r.doc_id: r.lang_pred for r in language.identify(df).collect()}
    assert got[0] == got[1] == got[2] == "und" and got[3] in ("xx", "und")
    assert {r.lang_pred for r in language.identify(df.withColumn("lang", df["text"].substr(0, 0)).where("false")).collect()} == set()


def test_quality_held_out(spark):
    docs, labels = (read_table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    truth = {r.doc_id: r.quality for r in labels.collect()}
    rows = quality.classify(docs, labels).collect()
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert len(rows) == 1000 and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    brier = np.mean([(r.score - truth[r.doc_id]) ** 2 for r in held])
    assert brier < 0.05


def test_quality_of_nothing(spark):
    df = frame(spark, [None, "", "abc def"])
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    assert [(r.score, r.predicted) for r in quality.classify(df, none).collect()] == [(0.5, 1)] * 3
    assert quality.classify(df.limit(0), none).count() == 0


def test_classifiers_with_repeated_rows_null_ids_long_texts_and_clashing_columns(spark):
    rng = random.Random(9)
    good = lambda: " ".join(rng.choice(["river", "stone", "meadow", "cloud"]) for _ in range(30))
    bad = lambda: "BUY " * rng.randrange(20, 40)
    texts = [good() if i % 2 else bad() for i in range(300)] + [good() * 3000, None, "", good(), good()]
    ids = [*range(300), 300, 301, 302, None, 5]
    df = frame(spark, texts, ids).withColumnsRenamed({"component_id": "score", "kept": "held_out", "size": "predicted", "digest": "lang_pred"})
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(300)] + [(5, 0, "y"), (None, 1, "z"), (7, None, "z")], "doc_id long, quality int, text string")
    got = quality.classify(df, labels).collect()
    assert len(got) == len(texts) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    of = {r.doc_id: r.predicted for r in got if r.doc_id not in (None, 5)}
    assert sum(of[i] == i % 2 for i in range(300) if i != 5) >= 295 and of[300] == 1
    assert [r.held_out for r in got if r.doc_id is None] == [None]
    key = lambda rows: sorted(((r.doc_id is None, r.doc_id, round(r.score, 9)) for r in rows), key=str)
    assert key(got) == key(quality.classify(df.repartition(1), labels).collect())
    langs = df.withColumn("lang", F.when(F.col("doc_id") % 2 == 1, "xx").otherwise("yy"))
    rows = language.identify(langs).collect()
    assert len(rows) == len(texts) and sum(r.lang_pred == ("xx" if r.doc_id % 2 else "yy") for r in rows if r.doc_id is not None and r.doc_id < 300) >= 290
    assert {r.held_out for r in rows if r.doc_id is None} == {None}


def test_every_class_is_sampled_however_many_there_are(spark):
    df = spark.range(3000).withColumn("c", F.when(F.col("id") < 2000, F.lit("big")).otherwise(F.col("id").cast("string")))
    got = {r.c: r["count"] for r in bounded_sample(df, "c", 50, "id", total=4000).groupBy("c").count().collect()}
    assert len(got) == 1001 and 1 <= got["big"] <= 54


TEXTS = ["ab", "the cat\n x①", "Zweiunddreißig Würste.", "  two  spaces ", None, "", "a▁b", "x" * 3000, "word " * 2000]


def test_pieces_decode_to_the_text(spark):
    encoded = pieces.encode(frame(spark, TEXTS), k=3)
    rows = pieces.decode(encoded).collect()
    for r in rows:
        assert r.text == (TEXTS[r.doc_id] or "").replace("▁", " ")
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    for found in by.values():
        found.sort(key=lambda r: r["sample"])
        assert len({tuple(r.ids) for r in found}) == len(found)
        assert all(a.perturbed >= b.perturbed for a, b in zip(found, found[1:], strict=False))
        assert all(r.log_inclusion <= 0 for r in found)
    assert len(by[4]) == len(by[5]) == 1 and len(by[0]) == 3
    again = {(r.doc_id, r["sample"], tuple(r.ids)) for r in pieces.encode(frame(spark, TEXTS).repartition(1), k=3).collect()}
    assert again == {(r.doc_id, r["sample"], tuple(r.ids)) for r in rows}
    assert pieces.encode(frame(spark, TEXTS).limit(0)).count() == 0


def test_pieces_of_repeated_rows_null_ids_and_ids_that_give_no_text(spark):
    df = frame(spark, ["a cat"] * 4, ids=[3, 3, None, None])
    rows = [(r.doc_id, r["sample"], tuple(r.ids), r.text) for r in pieces.encode(df, k=2, decode_too=True).collect()]
    assert sorted(Counter(rows).values()) == [2] * 4 and {r[3] for r in rows} == {"a cat"}
    v = pieces.vocabulary()
    odd = spark.createDataFrame([(1, None), (2, []), (3, [v.byte[0xC3]]), (4, [v.byte[0x20], v.byte[0xC3], v.byte[0xA9]])], "k int, ids array<int>")
    assert {r.k: r.text for r in pieces.decode(odd).collect()} == {1: None, 2: "", 3: "", 4: "é"}


def test_pieces_draws_of_many_samples_do_not_repeat():
    found = pieces.sample_texts(["an extraordinary understanding of it"], [5], k=900)[0]
    assert len({tuple(ids.tolist()) for ids, *_ in found}) == 900
    values = [value for _, _, value, _ in found]
    assert values == sorted(values, reverse=True) and len(set(values)) == 900


def all_segmentations(text):
    """Every segmentation of a short text and its probability, without any lattice."""
    v = pieces.vocabulary()
    known = {v.text[i].decode(): i for i in range(len(v.text)) if v.text[i] and i not in v.byte}

    def walk(rest):
        if not rest:
            yield (), 0.0
        for n in range(1, len(rest) + 1):
            if rest[:n] in known:
                for tail, w in walk(rest[n:]):
                    yield (known[rest[:n]], *tail), w + v.weight[known[rest[:n]]]

    found = list(walk(pieces.MARK + text.replace(" ", pieces.MARK)))
    total = np.logaddexp.reduce([w for _, w in found])
    return {ids: w - total for ids, w in found}


def test_pieces_give_every_segmentation_of_a_short_text():
    want = all_segmentations("on a")
    got = pieces.sample_texts(["on a"], [1], k=len(want) + 5)[0]
    assert {tuple(ids.tolist()): round(logp, 9) for ids, logp, *_ in got} == {k: round(w, 9) for k, w in want.items()}
    assert all(s[3] == 0.0 for s in got)


def test_pieces_samples_follow_the_weights_and_inclusion_is_unbiased():
    want = all_segmentations("then")
    n, k = 4000, 2
    first, estimate = Counter(), Counter()
    for i in range(0, n, 500):
        for found in pieces.sample_texts(["then"] * 500, list(range(i, i + 500)), k=k, sharpness=pieces.SHARPNESS):
            first[tuple(found[0][0].tolist())] += 1
            for ids, logp, _, inclusion in found:
                estimate[tuple(ids.tolist())] += np.exp(logp - inclusion) / n
    for ids, logp in sorted(want.items(), key=lambda x: -x[1])[:4]:
        p = np.exp(logp)
        assert abs(first[ids] / n - p) < 5 * np.sqrt(p * (1 - p) / n) + 2e-3
        assert abs(estimate[ids] - p) < 0.15 * p + 5e-3


def windows_of(text, n=50):
    w = re.findall("[\u3400-\u9fff]|[^\\s\u3400-\u9fff]+", lower(text))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def test_substring_finds_passages_in_mid_sentence_without_stops_and_in_dense_scripts(spark):
    rng = random.Random(12)
    words = lambda n: [f"w{rng.randrange(9000)}" for _ in range(n)]
    dense = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(n))
    three = "".join(" ".join(words(18)) + end for end in (". ", "! ", "? "))
    passages = [
        " ".join(words(60)), three, ", ".join(" ".join(words(6)) for _ in range(9)), "***".join(" ".join(words(17)) + "." for _ in range(3)),
        dense(60), "".join(dense(12) + "。" for _ in range(6)), "".join(" ".join("कखगघङ"[rng.randrange(5)] + f"{rng.randrange(9000)}" for _ in range(7)) + "।" for _ in range(8)),
    ]
    texts = []
    for p in passages:
        for _ in range(3):
            glue = "" if ord(p[0]) > 0x4000 else " "
            texts.append((" ".join(words(rng.randrange(3, 30))) if glue else dense(20)) + glue + p + glue + (" ".join(words(rng.randrange(3, 30))) if glue else dense(20)))
    alone = " ".join(words(20)) + "."
    texts += [alone, alone, f"{three}\n{alone}"]
    got = [r.text for r in sorted(substring.drop_repeats(frame(spark, texts)).collect(), key=lambda r: r.doc_id)]
    seen = set()
    for k, text in enumerate(got):
        assert not windows_of(text) & seen, (k, text)
        seen |= windows_of(text)
    assert got[-3] == alone and got[-2] == "" and len(got[-1].split()) <= substring.LONG
    assert got[: len(passages) * 3 : 3] == texts[: len(passages) * 3 : 3]


def test_units_join_to_the_text_in_any_script():
    for t in ("a" * 40, "x y " * 60, "İI ß Σ. " * 9, "一二。三，四" * 30, "क ख।ग", "end.*** Next end.###Next 3.5 www.a.b/c?", "\ud800 a\n\n b", ", , ,\n***\n"):
        assert "".join(substring.sentences(t)) == t


def test_segmentations_of_many_texts_are_drawn_together(monkeypatch):
    texts = ["the cat sat on the mat\nand so on"] * 300 + [None, "", "é😀 \n x"]
    calls, uniform = [], pieces._uniform
    monkeypatch.setattr(pieces, "_uniform", lambda *a: calls.append(1) or uniform(*a))
    together = pieces.sample_texts(texts, list(range(len(texts))), k=2)
    assert len(calls) < 3 * len(texts)  # one draw of a branch for each text, the rest side by side
    monkeypatch.setattr(pieces, "TURN_WORDS", 7)
    alone = pieces.sample_texts(texts, list(range(len(texts))), k=2)
    assert [[(s[0].tolist(), *s[1:]) for s in t] for t in together] == [[(s[0].tolist(), *s[1:]) for s in t] for t in alone]


def test_words_with_equal_ends_share_lattice_nodes(monkeypatch):
    heads = ["".join(p) for p in itertools.product("abcdefgh", repeat=3)]
    texts = [" ".join(f"{h}nationalisation" for h in heads[i::4]) for i in range(4)]
    steps, step = [], pieces.Vocabulary.step
    monkeypatch.setattr(pieces.Vocabulary, "step", lambda self, states, chars: steps.append(len(states)) or step(self, states, chars))
    together = pieces.sample_texts(texts, list(range(4)), k=3)
    assert sum(steps) < 4 * 4 * len(heads)  # what the heads add; 15 equal characters behind each would be ten times that
    alone = [pieces.sample_texts([t], [i], k=3)[0] for i, t in enumerate(texts)]
    assert [[(s[0].tolist(), *s[1:]) for s in t] for t in together] == [[(s[0].tolist(), *s[1:]) for s in t] for t in alone]


def test_words_are_cut_at_marks_and_line_ends():
    texts = ["", None, "a  b\n\n c", "▁▁x▁", " ", "\n", "é中😀 \ud800\t\x00", "x▂ y", "▖▁\n▁", "a" * 99 + "\r\n b"]
    words, ends = pieces._words(texts)
    got = [w.decode("utf-8", "surrogatepass") for w in words.to_pylist()]
    want = [re.findall("\n|▁+[^▁\n]*|[^▁\n]+", "▁" + t.replace(" ", "▁")) if t else [] for t in texts]
    assert [got[lo:hi] for lo, hi in zip([0, *ends[:-1]], ends, strict=True)] == want


def test_pieces_keep_null_characters(spark):
    texts = ["a\x00b", "\x00", "\x00\x00 é\x00\n\x7f\x80", "plain"]
    rows = pieces.encode(frame(spark, texts), decode_too=True).collect()
    assert {r.doc_id for r in rows} == {0, 1, 2, 3} and all(r.text == texts[r.doc_id] for r in rows)
