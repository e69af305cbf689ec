"""Unit cases for the traps of the operators: empty and tied input, nulls, bounds, partitioning."""

from __future__ import annotations

import json
import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from labelscope.functions import columns as C
from labelscope.operators import agreement as A
from labelscope.operators import contracts as K
from labelscope.operators import dedupe as D
from labelscope.operators import leak as L
from labelscope.operators import rank as R
from labelscope.operators import sampling as S
from labelscope.operators import snapshots as SN
from labelscope.operators.components import connected_components
from labelscope.sources import readers
from labelscope.streaming import intake, stateful


def test_wilson(spark):
    df = spark.createDataFrame([(0, 0), (0, 10), (10, 10), (3, 12)], "k long, n long")
    got = df.select(*(c.alias(n) for n, c in C.wilson("k", "n").items())).collect()
    assert tuple(got[0]) == (None, None, None)
    assert got[1].lo == 0.0 and 0 < got[1].hi < 0.35
    assert got[2].hi == 1.0
    p, n, z = 0.25, 12, 1.96
    mid, half = p + z * z / 2 / n, z * math.sqrt(p * 0.75 / n + z * z / 4 / n / n)
    assert got[3].lo == pytest.approx((mid - half) / (1 + z * z / n))
    assert got[3].hi == pytest.approx((mid + half) / (1 + z * z / n))


def test_kappa_is_null_when_chance_is_certain(spark):
    df = spark.createDataFrame([("x", "x")] * 4, "a string, b string")
    r = A.kappa(A.confusion_long(df, "a", "b")).first()
    assert (r.n, r.agree, r.rate, r.kappa) == (4, 4, 1.0, None)


def test_rule_cascade_takes_the_first_rule_and_null_does_not_hold(spark):
    df = spark.createDataFrame([(None,), (1,), (5,)], "v int")
    got = [r[0] for r in df.select(C.rule_cascade([(F.col("v") > 3, "big"), (F.col("v") > 0, "some")], "none")).collect()]
    assert got == ["none", "some", "big"]


@pytest.mark.parametrize("n", [1, 2, 10, 11, 59])
def test_equal_count_bins(spark, n):
    df = spark.createDataFrame([(i, 7 if i % 2 else i) for i in range(n)], "id long, v long").repartition(3)
    got = {r.id: r.bin for r in R.equal_count_bins(df, "v", "id").collect()}
    order = sorted(range(n), key=lambda i: (7 if i % 2 else i, i))
    want = {i: max(1, math.ceil(r * 10.0 / (n - 1))) if n > 1 else 1 for r, i in enumerate(order)}
    assert got == want


def test_prefix_sums_do_not_depend_on_partitions(spark):
    rng = random.Random(1)
    data = [(i, rng.randrange(5)) for i in range(300)]
    for parts in (1, 7):
        df = spark.createDataFrame(data, "id long, v long").repartition(parts)
        got = {r.id: r.c for r in R.prefix_sums(df, [F.desc("v"), F.col("id")], {"c": "v"}).collect()}
        total, want = 0, {}
        for i, v in sorted(data, key=lambda x: (-x[1], x[0])):
            total += v
            want[i] = total
        assert got == want


def test_concentration_of_ties_and_nothing(spark):
    df = spark.createDataFrame([(4,)] * 8, "v long")
    r = R.concentration(df, "v", [0.1, 50.0]).orderBy("percent").collect()
    assert [(x.k, x.mass, x.share, x.least) for x in r] == [(1, 4, 0.125, 4), (4, 16, 0.5, 4)]
    assert R.gini(df, "v").first().gini == pytest.approx(0)
    assert R.gini(df.limit(0), "v").count() == 0
    assert R.gini(spark.createDataFrame([(0,), (0,)], "v long"), "v").first().gini is None


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 102), (200, 200), (None, 3), (7, 5)] + [(500, i) for i in range(501, 560)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert {got[i] for i in range(1, 61)} == {1}
    assert {got[i] for i in (100, 101, 102)} == {100}
    assert {got[i] for i in range(500, 560)} == {500}
    assert 200 not in got
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_grams_of_short_texts_and_combining_marks(spark):
    df = spark.createDataFrame([("ab",), (None,), ("ABC",), ("see http://x.y/z  abc",), ("\u00e1b\u0301c",)], "t string")
    got = [r[0] for r in df.select(D.text_grams("t")).collect()]
    assert got[0] == [] and got[1] == [] and got[2] == ["abc"]
    assert got[3] == ["see", "ee ", "e a", " ab", "abc"]
    assert got[4] == ["\u00e1b\u0301", "b\u0301c"]
    assert [r[0] for r in df.select(F.array_join(D.title_tokens("t"), "|")).collect()][4] == "\u00e1b\u0301c"


def test_shingles_cover_the_tail(spark):
    df = spark.createDataFrame([("abcdefghij",), ("abc",), ("",)], "t string")
    got = [r[0] for r in df.select(L.shingles(F.col("t"), 4, 4)).collect()]
    assert got == [["abcd", "efgh", "ghij"], [], []]


def test_normalise(spark):
    df = spark.createDataFrame([("“Ａ​  b”— C",), (None,)], "t string")
    assert [r[0] for r in df.select(L.normalised("t")).collect()] == ['"a b"- c', ""]


def test_views_of_a_raw_text(spark):
    raw = 'x &lt;b&gt;bold&lt;/b&gt; <i>it</i> ""q"" {"a": "caf\\u00e9 &amp; <p>\\n\\"t\\"", "b": "bad \\q"}'
    df = spark.createDataFrame([(raw,), (None,)], "t string")
    got = [{v.view: v.text for v in r[0]} for r in df.select(L.views("t")).collect()]
    assert got[0]["raw"] == raw and got[0]["unescaped"].startswith("x <b>bold</b> <i>it</i>") and got[0]["untagged"].startswith("x  bold   it ")
    assert 'café &amp; <p>\n"t"' in got[0]["strings"].split("\n", 3)[-1] or 'café &amp; <p>' in got[0]["strings"]
    assert "bad" not in got[0]["strings"] and "café &  " in got[0]["strings_untagged"]
    assert set(got[1].values()) == {""}


def test_probes_of_any_number_and_length_are_found(spark, monkeypatch):
    rng = random.Random(5)
    texts = ["".join(rng.choices("abc é", k=rng.choice([0, 3, 60, 400]))) for _ in range(60)] + [None, "x" * 50_000 + "needle"]
    probes = [None, "", "é", "ab", "needle", "needle", "zzz"] + [t[a : a + n] for t in texts[:60] if t and len(t) > 50 for a, n in [(7, 5), (3, 33), (10, 16)]]
    files = spark.createDataFrame([*enumerate(texts), (2, texts[2])], "file long, body string")
    asked = spark.createDataFrame([(p,) for p in probes], "p string")
    want = {(i, p) for i, t in enumerate(texts) for p in probes if t and p and p in t}
    assert len({p for _, p in want}) > 20
    none = spark.createDataFrame([], "file long, probe string")
    listed = spark.createDataFrame([(i,) for i in range(0, 70, 3)], "file long")
    pairs = spark.createDataFrame(sorted(want)[::2], "file long, probe string")
    for sent in (L.SENT_HASHES, 1):  # the second time all windows are exchanged
        monkeypatch.setattr(L, "SENT_HASHES", sent)
        got = L.probe_search(files, "file", "body", asked, "p", none).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert {tuple(r) for r in L.probe_search(files, "file", "body", asked, "p", listed).collect()} == {(i, p) for i, p in want if i % 3}
    assert {tuple(r) for r in L.probe_search(files, "file", "body", asked, "p", pairs).collect()} == set(sorted(want)[1::2])
    assert L.probe_search(files, "file", "body", asked.where("p = ''"), "p", none).count() == 0
    assert L.probe_search(files.limit(0), "file", "body", asked, "p", listed).count() == 0


def test_coverage_counts_refused_items_by_set(spark):
    items = spark.createDataFrame([(i,) for i in range(10)], "id long")
    sets = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("b", 3), ("b", 99), ("c", 99)], "set string, id long")
    refused = spark.createDataFrame([(2,), (2,), (4,), (77,)], "id long")
    got = {r["set"]: (r.labelled, r.refused, r.missing) for r in SN.coverage(items, sets, refused, "set").collect()}
    assert got == {"a": (2, 1, 7), "b": (1, 2, 7), "c": (0, 2, 8)}
    assert SN.coverage(items, sets.limit(0), refused, "set").count() == 0


def test_batches_and_blocks_do_not_depend_on_partitions(spark):
    census = spark.createDataFrame([(i,) for i in range(0, 90, 2)], "id long")
    drawn = spark.createDataFrame([(i,) for i in range(60, 100)], "id long")
    order = sorted(range(0, 90, 2)) + [i for i in range(60, 100) if i % 2 or i >= 90]
    for parts in (1, 7):
        got = {r.id: r.batch for r in S.label_batches(census.repartition(parts), drawn.repartition(parts), 40).collect()}
        assert got == {i: k // 40 for k, i in enumerate(order)}
    blocks = [{r.id: r.position for r in S.shuffled_blocks(drawn.repartition(n), F.col("id") % 3, "s").collect()} for n in (1, 7)]
    assert blocks[0] == blocks[1] and sorted(blocks[0].values()) == list(range(1, 41))
    assert [i % 3 for i, _ in sorted(blocks[0].items(), key=lambda x: x[1])] == sorted(i % 3 for i in range(60, 100))
    assert S.label_batches(census.limit(0), drawn.limit(0)).count() == 0


def test_compatibility_form_is_taken(spark):
    df = spark.createDataFrame([("ﬁn ① Ａ",)], "t string")
    assert df.select(L.normalised("t")).first()[0] == "fin 1 a"


def test_redaction_goes_into_structs_and_arrays(spark):
    df = spark.sql("SELECT 1 AS id, 'secret' AS text, named_struct('text', 'x', 'n', 2, 'gone', 'y') AS a, array(named_struct('text', '', 'n', 3), named_struct('text', 'z', 'n', 4)) AS b")
    got = L.redact(df, {"text": "mark", "gone": "drop"}).first().asDict(True)
    assert got == {"id": 1, "text": "[removed]", "a": {"text": "[removed]", "n": 2}, "b": [{"text": "", "n": 3}, {"text": "[removed]", "n": 4}]}


def test_sampling_does_not_depend_on_partitions_and_takes_all_of_small_strata(spark):
    base = spark.range(500).withColumn("kind", F.col("id") % 2)
    predicates = {"even": F.col("kind") == 0, "few": F.col("id") < 3, "none": F.col("id") < 0}
    draws = []
    for parts in (1, 5):
        members = S.strata(base.repartition(parts), "id", predicates)
        draws.append(sorted(map(tuple, S.sample_per_stratum(members, {"even": 20, "few": 10, "none": 5}, "s").collect())))
    assert draws[0] == draws[1]
    assert sum(r[0] == "even" for r in draws[0]) == 20 and sum(r[0] == "few" for r in draws[0]) == 3


def test_inclusion_probability(spark):
    members = spark.createDataFrame([("a", i) for i in range(10)] + [("b", i) for i in range(4)] + [("c", 0)], "stratum string, id long")
    got = {r.id: r.pi for r in S.inclusion_probability(members, {"a": 5, "b": 1}, ["c"]).collect()}
    assert got[0] == 1.0 and got[1] == pytest.approx(1 - 0.5 * 0.75) and got[9] == pytest.approx(0.5)


def test_one_label_per_id(spark):
    df = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (2, 3, None)], "id long, seq long, v string")
    assert {r.id: r.v for r in SN.one_label_per_id(df, "id", "seq", "first").collect()} == {1: "x", 2: None}
    assert {r.id: r.v for r in SN.one_label_per_id(df, "id", "seq", "last").collect()} == {1: "y", 2: None}


def test_digest_does_not_depend_on_order(spark):
    df = spark.range(100).withColumn("v", F.col("id") * 3)
    assert SN.content_digest(df).first() == SN.content_digest(df.orderBy(F.desc("id")).repartition(7)).first()
    assert SN.content_digest(df).first() != SN.content_digest(df.withColumn("v", F.col("v") + 1)).first()


def test_contracts(spark):
    df = spark.createDataFrame([(1.0, 0.0, 2.0), (3.0, 0.0, 2.0), (None, 0.0, 1.0)], "v double, lo double, hi double")
    assert K.interval_violations(df, "v", "lo", "hi").count() == 1
    assert [r.ok for r in K.contracts(df, {"a": (F.count("*"), F.lit(3)), "b": (F.sum("v"), F.lit(5))}).orderBy("name").collect()] == [True, False]
    r = K.tables_equal(df, df.unionByName(df.limit(1))).first()
    assert (r.only_a, r.only_b, r.same_schema) == (0, 1, True)


LABEL = StructType([StructField("id", LongType()), StructField("family", StringType())])


def test_readers(spark, tmp_path):
    (tmp_path / "feed.json").write_text(json.dumps({"meta": {"at": "x"}, "cards": [{"id": 1, "family": "a"}, {"id": 2, "family": None}]}))
    meta, cards = readers.read_feed(spark, str(tmp_path / "feed.json"), StructType([StructField("at", StringType())]), LABEL)
    assert meta.first().at == "x" and cards.count() == 2
    (tmp_path / "bad.json").write_text('{"cards": []}')
    with pytest.raises(ValueError):
        readers.read_feed(spark, str(tmp_path / "bad.json"), StructType([StructField("at", StringType())]), LABEL)
    (tmp_path / "labels.jsonl").write_text('{"id": 1, "family": "a"}\n\n{"id": "oops"\n{"family": "b"}\n')
    assert readers.read_labels(spark, str(tmp_path / "nothing"), LABEL).count() == 0
    rows, bad = readers.read_labels_tolerant(spark, str(tmp_path / "labels.jsonl"), LABEL)
    assert [r.id for r in rows.collect()] == [1] and bad.count() == 2
    (tmp_path / "sheet.csv").write_text('id,family,ok\n1," a ",TRUE\n2,,yes\n3,"b ""q""\nline",no\n')
    schema = StructType([StructField("id", StringType()), StructField("family", StringType()), StructField("ok", BooleanType())])
    got = readers.read_label_csv(spark, str(tmp_path / "sheet.csv"), schema, "family", ["ok"]).orderBy("id").collect()
    assert [(r.id, r.family, r.ok) for r in got] == [("1", "a", True), ("3", 'b "q"\nline', False)]
    assert readers.manifest(spark, str(tmp_path / "sheet.csv")).first().bytes == (tmp_path / "sheet.csv").stat().st_size
    table = spark.createDataFrame([(2, 0.5, "x"), (1, 0.123456789, None)], "a int, b double, c string").repartition(5)
    readers.write_table(table, str(tmp_path / "t"), format="csv", order=["a"])
    (only,) = (tmp_path / "t").glob("part*")
    assert only.read_text() == "a,b,c\n1,0.123457,\n2,0.5,x\n"
    readers.write_table(table, str(tmp_path / "parts"), format="csv")
    lines = [x for f in (tmp_path / "parts").glob("part*") for x in f.read_text().splitlines() if x != "a,b,c"]
    assert sorted(lines) == ["1,0.123457,", "2,0.5,x"]


def test_label_batches_take_the_last_line_of_the_last_file(spark, tmp_path):
    (tmp_path / "b0.jsonl").write_text('{"id": 1, "family": "a"}\n{"id": 2, "family": "x"}\n')
    (tmp_path / "b1.jsonl").write_text('{"id": 1, "family": "b"}\n{"id": 1, "family": "c"}\n{"id": 1, "family": "a"}\n{"id": 3, "family": "y"}\n')
    over = spark.createDataFrame([(3, "z")], LABEL)
    got = {r.id: r.family for r in readers.read_label_batches(spark, str(tmp_path / "b*.jsonl"), LABEL, over).collect()}
    assert got == {1: "a", 2: "x", 3: "z"}


def test_the_latest_pointer_counts_and_may_go_back(spark, tmp_path):
    for version in ("9", "10"):
        readers.publish(spark.createDataFrame([(version,)], "v string"), str(tmp_path), "t", version)
    assert readers.published(spark, str(tmp_path), "t").first().v == "10"
    readers.point_to(spark, str(tmp_path), "t", "9")
    assert readers.published(spark, str(tmp_path), "t").first().v == "9"


def test_intake_stream_equals_batch_and_is_idempotent(spark, tmp_path):
    rows = [(i, i % 7 if i % 11 else 99, f"2024-01-01 00:{i % 60:02d}:00", "v" if i % 5 else None, 1.0) for i in range(60)]
    df = spark.createDataFrame(rows, "response_id long, id long, at string, value string, usd double").withColumn("at", F.col("at").cast("timestamp"))
    for k in range(3):
        df.where(f"response_id % 3 = {k}").write.mode("append").parquet(str(tmp_path / "in"))
    requests = spark.range(9)
    valid = F.col("value").isNotNull()
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    for _ in range(2):
        stateful.intake(source, requests, str(tmp_path / "out"), str(tmp_path / "cp"), valid=valid).awaitTermination()
    labels, others = intake.stored(spark, str(tmp_path / "out"), "labels"), intake.stored(spark, str(tmp_path / "out"), "quarantine")
    assert labels.count() + others.count() == 60
    assert sorted(r.id for r in labels.collect()) == [0, 1, 2, 3, 4, 5, 6]
    assert {r.id for r in intake.missing(requests, labels).collect()} == {7, 8}
    batch = {r.status: r["count"] for r in intake.split(df, requests, valid).groupBy("status").count().collect()}
    stream = {r.status: r["count"] for r in labels.unionByName(others).groupBy("status").count().collect()}
    assert batch == stream
    capped = stateful.intake(source, requests, str(tmp_path / "out2"), str(tmp_path / "cp2"), cap=1.0, valid=valid)
    capped.awaitTermination()
    assert {r.status for r in intake.stored(spark, str(tmp_path / "out2"), "quarantine").collect()} >= {"over budget"}


def test_usage_ledger_as_a_stream(spark, tmp_path):
    df = spark.createDataFrame([("2024-01-01 00:10:00", "m", 1.0, False), ("2024-01-01 00:50:00", "m", 3.0, True), ("2024-01-01 05:00:00", "m", 9.0, False)], "at string, model string, usd double, failed boolean").withColumn("at", F.col("at").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    stream = intake.usage_ledger(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "at", "model", "usd", "usd")
    stream.writeStream.format("memory").queryName("ledger").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    want = sorted(map(tuple, intake.usage_ledger(df, "at", "model", "usd", "usd").collect()))
    assert sorted(map(tuple, spark.table("ledger").collect())) == want and len(want) == 2
