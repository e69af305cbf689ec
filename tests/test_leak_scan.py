"""The leak scan over all readings: leaks planted behind markup and escapes, the rolling hash, the filter, verdicts."""

from __future__ import annotations

import json
import random

import numpy as np
import pytest

from labelscope.operators import leak_scan as S

SECRET = "The quiet river turned north before the old mill — and nobody in the valley saw it go."
OTHER = "A second text about copper, tin and the price of bread in a long forgotten winter town."


def owners(spark):
    rows = [(1, SECRET, "The quiet river turned north before the old mill"), (2, OTHER, "Copper, tin and the price of bread"), (3, "short", None), (4, None, "short too"), (5, None, None)]
    # three owners share a text: its windows are common
    rows += [(i, "shared by three owners and therefore no evidence of anything at all", None) for i in (10, 11, 12)]
    return spark.createDataFrame(rows, "o long, x string, t string")


def referenced(text):
    return "".join(f"&#{ord(c)};" if c.isalpha() else c for c in text)


def planted():
    part = SECRET[10:70]
    return {
        "plain": ("raw", f"before {part} after"),
        "curly": ("raw", part.replace(" ", "  ").upper()),
        "references": ("unescaped", f"<p>{referenced(part)}</p>"),
        "tags": ("untagged", " ".join(f"<i class='w'>{w}</i>" for w in part.split(" "))),
        "quotes": ("quotes", None),
        "strings": ("strings", '{"k": ' + json.dumps("".join(chr(0) if False else c for c in part) + " tail").replace("river", "\\u0072iver") + "}"),
        "strings_untagged": ("strings_untagged", '{"html": ' + json.dumps(" ".join(f"<b>{w}</b>" for w in part.split(" "))).replace("river", "\\u0072iver") + "}"),
    }


def test_leaks_are_found_behind_markup_and_escapes(spark):
    rows = planted()
    rows["quotes"] = ("quotes", 'say ""Copper, tin and the ""price"" of bread in a long forgotten winter town."" end')
    corpus = owners(spark)
    own = spark.createDataFrame([(6, 'about copper, tin and the "price" of bread in a long forgotten winter', None)], "o long, x string, t string")
    index = S.build_index(corpus.unionByName(own), "o", "x", "t")
    files = spark.createDataFrame([(k, v[1]) for k, v in rows.items()] + [("none", "nothing to find"), ("null", None), ("common", "shared by three owners and therefore no evidence of anything at all")], "f string, raw string")
    found = S.scan(files.unionByName(files.where("f = 'plain'")).repartition(3), "f", "raw", index).collect()
    by = {(r.file, r.owner, r.kind): r for r in found}
    assert len(by) == len(found)
    for name, (reading, _) in rows.items():
        owner = 6 if name == "quotes" else 1
        assert by[name, owner, "text"].reading == reading, (name, by.get((name, owner, "text")))
    assert not {r.file for r in found} & {"none", "null", "common"}
    for r in found:
        raw = dict(files.collect())[r.file]
        text = S.normal_form(dict(S.readings(raw))[r.reading])
        assert text[r.offset : r.offset + len(r.shingle)] == r.shingle and len(r.shingle) == S.WINDOWS[r.kind][0]


def plain_hits(corpus, files):
    """All findings by sets of substrings."""
    index = {"text": {}, "title": {}}
    for owner, text, title in corpus:
        for kind, value in (("text", text), ("title", title)):
            own, (length, step) = S.normal_form(value), S.WINDOWS[kind]
            for s in range(0, len(own) - length + 1):
                if s % step == 0 or s == len(own) - length:
                    index[kind].setdefault(own[s : s + length], set()).add(owner)
    out = {}
    for file, raw in files:
        for number, (name, text) in enumerate(S.readings(raw)):
            text = S.normal_form(text)
            for kind, known in index.items():
                length = S.WINDOWS[kind][0]
                for s in range(len(text) - length + 1):
                    for owner in known.get(text[s : s + length], ()) if len(known.get(text[s : s + length], ())) < S.COMMON else ():
                        new = (number, s, text[s : s + length], name)
                        out[file, kind, owner] = min(out.get((file, kind, owner), new), new)
    return {(f, k, o, name, s, x) for (f, k, o), (_, s, x, name) in out.items()}


@pytest.mark.parametrize("power", [27, 6])
def test_scan_against_plain_sets(spark, monkeypatch, power):
    """With a filter of 64 bits all windows are exchanged."""
    monkeypatch.setattr(S, "LEAST_POWER", 6)
    monkeypatch.setattr(S, "MOST_POWER", power)
    rng = random.Random(7)
    words = ["alpha", "beta", "gämma", "“delta”", "ﬁn", "日本語", "e", "of", "the", "​zero"]
    corpus = [(i, " ".join(rng.choices(words, k=rng.randint(0, 30))), " ".join(rng.choices(words, k=rng.randint(0, 9)))) for i in range(25)]
    files = []
    for i in range(40):
        parts = [rng.choice(corpus)[1][a : a + rng.randint(0, 120)] if rng.random() < 0.6 else " ".join(rng.choices(words, k=8)) for a in rng.choices(range(60), k=4)]
        files.append((i, rng.choice(["", "<p>", '"', "&lt;"]).join(parts)))
    df = spark.createDataFrame(corpus, "o long, x string, t string")
    got = S.scan(spark.createDataFrame(files, "f long, raw string").repartition(3), "f", "raw", S.build_index(df, "o", "x", "t")).collect()
    assert {tuple(r) for r in got} == plain_hits(corpus, files) and len(got) == len(set(got))


def test_rolling_hash_is_that_of_the_window(monkeypatch):
    rng = random.Random(1)
    text = "".join(rng.choice("ab é日\U0001f600") for _ in range(500))
    whole = {}
    for length, start, h in S.rolling_hashes(text, (40, 24, 1)):
        whole.update({(length, start + i): int(v) for i, v in enumerate(h)})
    assert set(whole) == {(n, i) for n in (40, 24, 1) for i in range(500 - n + 1)}
    assert all(v == S.window_hash(text[i : i + n]) for (n, i), v in whole.items())
    assert len({(n, text[i : i + n]) for n, i in whole}) == len(set(whole.values()))
    monkeypatch.setattr(S, "HASHED_CHARS", 61)
    parts = {}
    for length, start, h in S.rolling_hashes(text, (40, 24, 1)):
        parts.update({(length, start + i): int(v) for i, v in enumerate(h)})
    assert parts == whole
    assert list(S.rolling_hashes("", (40,))) == []


def test_filter_holds_what_was_put_in(spark):
    rng = np.random.default_rng(3)
    texts = ["".join(map(chr, rng.integers(97, 123, 40))) for _ in range(3000)]
    words = S.build_filter(spark.createDataFrame([(t,) for t in texts], "shingle string").repartition(5))
    known = np.array([S.window_hash(t) for t in texts], np.uint64)
    assert len(S.held(words, known)) == len(known) and len(words) * 64 == 1 << 16
    others = rng.integers(0, 1 << 63, 20_000, dtype=np.uint64)
    assert len(S.held(words, others)) < 200
    assert len(S.held(S.build_filter(spark.createDataFrame([], "shingle string")), known)) == 0


def test_windows_of_an_indexed_text_cover_its_end():
    assert S.starts(39, 40, 8) == [] and S.starts(40, 40, 8) == [0] and S.starts(50, 40, 8) == [0, 8, 10] and S.starts(56, 40, 8) == [0, 8, 16]


def test_verdicts_by_title_and_caps(spark):
    title = "the quiet river turned north before the old mill of the north"
    titles = spark.createDataFrame([(1, title), (2, title), (3, None)], "owner long, title string")
    quoted, leaked = title[:40], "not in any title at all but in its own text"[:40]
    hits = [("a/1", "text", 1, quoted), ("a/1", "title", 1, title[:24]), ("a/2", "text", 1, leaked), ("a/2", "title", 2, "x"), ("b/1", "title", 1, "x"), ("b/2", "title", 1, "x"), ("b/2", "title", 2, "x"), ("c/1", "title", 3, "x")]
    hits += [("d/1", "text", 3, quoted), ("e/1", "text", 1, leaked), ("e/1", "text", 2, leaked), ("f/1", "text", 1, leaked)]
    df = spark.createDataFrame([(f, k, o, "raw", 0, s) for f, k, o, s in hits], "file string, kind string, owner long, reading string, offset int, shingle string")
    rules = [(5, "title", "%", 9), (1, "title", "a/%", 0), (2, "title", "b/%", 1), (3, "text", "e/%", 1), (4, "text", "f/_", 1), (0, "title", "c/1x", 0), (6, "title", "c/%", 0)]
    got = {r.file: (r.verdict, r.n_text, r.n_title) for r in S.verdicts(df, titles, spark.createDataFrame(rules, "position int, kind string, pattern string, cap int")).collect()}
    assert got == {
        "a/1": ("titles allowed", 0, 1), "a/2": ("text", 1, 1), "b/1": ("titles allowed", 0, 1), "b/2": ("titles over cap", 0, 2),
        "c/1": ("titles allowed", 0, 1), "d/1": ("text", 1, 0), "e/1": ("text", 2, 0), "f/1": ("text allowed", 1, 0),
    }
    none = S.verdicts(df, titles, spark.createDataFrame([], "position int, kind string, pattern string, cap int"))
    assert {r.file: r.verdict for r in none.collect()} == {"a/1": "titles", "a/2": "text", "b/1": "titles", "b/2": "titles", "c/1": "titles", "d/1": "text", "e/1": "text", "f/1": "text"}
    assert S.verdicts(df.limit(0), titles, none.selectExpr("1 AS position", "file AS kind", "file AS pattern", "1 AS cap").limit(0)).count() == 0


def test_titles_and_scan_of_no_rows(spark):
    corpus = owners(spark)
    index = S.build_index(corpus.limit(0), "o", "x", "t")
    assert index.count() == 0
    files = spark.createDataFrame([("f", SECRET)], "f string, raw string")
    assert S.scan(files, "f", "raw", index).count() == 0
    assert S.scan(files.limit(0), "f", "raw", S.build_index(corpus, "o", "x", "t")).count() == 0
    assert {r.owner: r.title for r in S.normal_titles(corpus, "o", "t").collect()}[5] == ""


def test_normal_forms_agree(spark):
    from labelscope.operators.leak import normalised

    texts = ["‚a‛ „b‟ ‘c’ “d”", "x⁠y​z﻿", "Ａ—–−  ﬁ", " \t\n a  b ", None, "", "日本語 É"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(normalised("t")).collect()] == [S.normal_form(t) for t in texts]
