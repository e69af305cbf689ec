"""The snapshot store and its commits, hashes of files by ranges, grids under cuts, nested redaction reports."""

from __future__ import annotations

import hashlib
import os
import random
import threading
from collections import Counter

import pytest
from pyspark.sql import functions as F

from labelscope.operators import leak as L
from labelscope.operators import tables as T
from labelscope.sources import readers as R
from labelscope.sources import snapshot_store as SS


def pull(spark, n, shift=0):
    return spark.createDataFrame([(i, f"row {i + shift}") for i in range(n)], "id long, t string")


def test_store_decides_by_name_and_content(spark, tmp_path):
    store = SS.SnapshotStore(spark, str(tmp_path / "s"), least=10)
    assert store.log() == [] and store.keep(pull(spark, 9), "mon") == ("refused", None) and store.log() == []
    first = store.keep(pull(spark, 20), "mon")
    assert first[0] == "new" and first[1].version == "mon" and first[1].number == 0
    again = store.keep(pull(spark, 20).orderBy(F.desc("id")).repartition(4), "mon")
    assert again == ("same content", first[1]) and len(os.listdir(tmp_path / "s" / "data")) == 1
    other = store.keep(pull(spark, 20, 5), "mon")
    assert other[0] == "new" and other[1].version == "mon~2"
    assert store.keep(pull(spark, 20, 5), "mon")[0] == "same content"
    third = store.keep(pull(spark, 21), "mon")
    assert third[1].version == "mon~3"
    # the content of another name is a snapshot of its own, written once
    shared = store.keep(pull(spark, 20), "tue")
    assert shared[0] == "new" and shared[1].version == "tue" and shared[1].path == first[1].path
    assert [c.version for c in store.log()] == ["mon", "mon~2", "mon~3", "tue"] and [c.number for c in store.log()] == [0, 1, 2, 3]
    assert store.read("mon~2").orderBy("id").first().t == "row 5"
    by = {r.version: r["count"] for r in store.snapshots().groupBy("version").count().collect()}
    assert by == {"mon": 20, "mon~2": 20, "mon~3": 21, "tue": 20}
    with pytest.raises(KeyError):
        store.read("wed")
    # a repeated row is other content
    assert store.keep(pull(spark, 20).unionByName(pull(spark, 1)), "tue")[1].version == "tue~2"


def test_content_without_an_entry_is_never_read(spark, tmp_path, monkeypatch):
    store = SS.SnapshotStore(spark, str(tmp_path / "s"), least=1)
    store.keep(pull(spark, 5), "a")
    monkeypatch.setattr(SS, "put_if_absent", lambda *x: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        store.keep(pull(spark, 6), "b")
    monkeypatch.undo()
    assert len(os.listdir(tmp_path / "s" / "data")) == 2  # the broken-off writer's content lies there
    assert [c.version for c in store.log()] == ["a"] and store.snapshots().count() == 5
    assert store.keep(pull(spark, 6), "b")[0] == "new" and store.snapshots().count() == 11


def test_two_writers_at_once(spark, tmp_path):
    """Both start from the same log: one is first, the other goes on from there, and nothing is lost."""
    ready, put, results = threading.Barrier(2), SS.put_if_absent, {}

    def waiting(*x):
        try:
            ready.wait(timeout=60)
        except threading.BrokenBarrierError:
            pass
        return put(*x)

    SS.put_if_absent = waiting
    try:
        stores = [SS.SnapshotStore(spark, str(tmp_path / "s"), least=1) for _ in range(2)]
        work = [threading.Thread(target=lambda k=k: results.update({k: stores[k].keep(pull(spark, 5 + k), "day")})) for k in range(2)]
        for w in work:
            w.start()
        work[0].join(90)
        ready.abort()
        work[1].join(90)
    finally:
        SS.put_if_absent = put
    log = stores[0].log()
    assert sorted(c.version for c in log) == ["day", "day~2"] and [c.number for c in log] == [0, 1]
    assert {r[0] for r in results.values()} == {"new"} and sorted(c.rows for c in log) == [5, 6]
    # the same content by two writers is kept once
    results.clear()
    work = [threading.Thread(target=lambda k=k: results.update({k: stores[k].keep(pull(spark, 9), "night")})) for k in range(2)]
    for w in work:
        w.start()
    for w in work:
        w.join(90)
    assert sorted(r[0] for r in results.values()) == ["new", "same content"] and [c.version for c in stores[1].log()].count("night") == 1
    assert len(os.listdir(tmp_path / "s" / "data")) == 3


def test_put_if_absent_has_one_winner(spark, tmp_path):
    path, won = str(tmp_path / "log" / "0.json"), []
    work = [threading.Thread(target=lambda k=k: won.append(k) if SS.put_if_absent(spark, path, f"text {k}") else None) for k in range(12)]
    for w in work:
        w.start()
    for w in work:
        w.join()
    assert len(won) == 1 and open(path).read() == f"text {won[0]}" and os.listdir(tmp_path / "log") == ["0.json"]


@pytest.mark.parametrize("size", [1, 7, 100, 1 << 20])
def test_hashes_of_files_by_ranges(spark, tmp_path, size):
    rng = random.Random(size)
    contents = {f"f{n}.bin": bytes(rng.randrange(256) for _ in range(n)) for n in (0, 1, 7, 14, 99, 100, 101)} | {"a b%é.bin": b"name"}
    for name, body in contents.items():
        (tmp_path / name).write_bytes(body)
    got = {os.path.basename(r.path): (r.bytes, r.ranges, r.sha256) for r in R.tree_hashes(spark, str(tmp_path), size).collect()}
    for name, body in contents.items():
        parts = [body[i : i + size] for i in range(0, max(len(body), 1), size)]
        assert got[name] == (len(body), len(parts), hashlib.sha256(b"".join(hashlib.sha256(p).digest() for p in parts)).hexdigest())


def test_grid_under_cuts_against_plain_counts(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.choice([1, 2]), rng.choice("xyz"), rng.choice([None, 0, 1, 2])) for _ in range(300)]
    df = spark.createDataFrame(rows, "g string, b int, f string, v int")
    got = T.grid_cuts(df, "g", "b", "f", {"all": F.lit(True), "some": F.col("v") > 0, "none": F.col("v") > 9}).collect()
    want = {}
    for name, keep in (("all", lambda v: True), ("some", lambda v: v is not None and v > 0)):
        kept = [(g, b, f) for g, b, f, v in rows if keep(v)]
        cells, rows_, columns = Counter((g, b) for g, b, _ in kept), Counter(g for g, *_ in kept), Counter(b for _, b, _ in kept)
        for (g, b), n in cells.items():
            items = sorted(Counter(f for x, y, f in kept if (x, y) == (g, b)).items(), key=lambda i: (-i[1], i[0]))[:2]
            want[name, g, b] = (n, round(n / rows_[g], 9), round(n / columns[b], 9), items)
    assert {(r.cut, r.g, r.b): (r.n, round(r.row_share, 9), round(r.column_share, 9), [tuple(t) for t in r.top]) for r in got} == want and len(got) == len(want)
    assert T.grid_cuts(df.limit(0), "g", "b", "f", {"all": F.lit(True)}).count() == 0


def test_nested_redaction_report_against_plain_python(spark):
    schema = "k string, text string, a struct<text: string, n: int, gone: struct<x: string, y: array<string>>>, b array<struct<text: string, inner: array<struct<note: string, z: string>>>>, text2 string, gone array<string>"
    rows = [
        ("p", "t", ("u", 1, ("x", ["", "y", None])), [("v", [("n", "z"), ("", "z")]), (None, None), None], "keep", ["q", "", "r"]),
        ("p", "", (None, 2, None), [], None, None),
        ("q", None, None, None, "", []),
        (None, "w", ("", 3, ("", None)), [("", [("m", None)])], "x", ["s"]),
    ]
    rules = {"text": "mark", "note": "empty", "gone": "drop"}
    df = spark.createDataFrame(rows, schema)
    want = Counter()
    fields = ["text", "a.text", "a.gone.x", "a.gone.y", "b.text", "b.inner.note", "gone"]
    for r in df.collect():
        for f in fields:
            want[r.k, f] += 0
        want[r.k, "text"] += bool(r.text)
        if r.a is not None:
            want[r.k, "a.text"] += bool(r.a.text)
            if r.a.gone is not None:
                want[r.k, "a.gone.x"] += bool(r.a.gone.x)
                want[r.k, "a.gone.y"] += sum(map(bool, r.a.gone.y or []))
        for part in r.b or []:
            if part is not None:
                want[r.k, "b.text"] += bool(part.text)
                want[r.k, "b.inner.note"] += sum(bool(i.note) for i in part.inner or [])
        want[r.k, "gone"] += sum(map(bool, r.gone or []))
    assert {(r.k, r.field): r.emptied for r in L.redaction_report(df, rules, "k").collect()} == dict(want)
    # what the report counts is what redact changes
    clean = L.redact(df, {**rules, "text": "empty"})
    assert sum(r.emptied for r in L.redaction_report(clean, rules, "k").collect()) == 0
    assert L.redaction_report(df, {}, "k").count() == 0
