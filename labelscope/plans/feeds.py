"""Snapshots, base, coverage, joins, contracts over the driver's tables (inventory B, C, D, N)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from labelscope.functions import columns as C
from labelscope.operators import contracts as K
from labelscope.operators import dedupe as D
from labelscope.operators import rank as R
from labelscope.operators import snapshots as S
from labelscope.plans.binding import EVIDENCE, LANGS, posts, query, raters
from labelscope.plans.safety import GROUPS
from labelscope.sources.shared import read_table, shared_dir
from labelscope.sources.snapshot_store import SnapshotStore


def _events(spark, d):
    return read_table(spark, d, "events")


@query("""WITH p AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS pull, count(*) AS n FROM events GROUP BY 1) SELECT pull, n, CASE WHEN n < 300 THEN 'refused' ELSE 'new' END AS decision FROM p""", posts=False)
def b1_snapshot_decisions(spark, d):
    return S.snapshot_decisions(_events(spark, d).withColumn("pull", F.col("ts").cast("date").cast("string")), "pull", ["event_id", "value"], 300)


@query("""WITH p AS (SELECT CAST(CAST(date_trunc('week', ts) AS DATE) AS VARCHAR) AS pull, count(*) AS n FROM events GROUP BY 1)
SELECT pull, turn, n, CASE WHEN n < 1000 THEN 'refused' WHEN turn = 2 THEN 'same content' ELSE 'new' END AS decision,
  CASE WHEN n < 1000 THEN NULL WHEN turn = 3 THEN pull || '~2' ELSE pull END AS version, CASE WHEN n >= 1000 THEN n END AS stored FROM p, unnest([1, 2, 3]) AS t(turn)""", posts=False)
def b1_snapshot_store(spark, d):
    """Each week's events pulled three times into a store: at first, again in another order, and with other content."""
    store = SnapshotStore(spark, f"{shared_dir(spark)}/snapshots-{uuid.uuid4().hex}")
    e = _events(spark, d).withColumn("pull", F.date_trunc("week", F.col("ts").cast("timestamp")).cast("date").cast("string"))
    out = []
    for week, n in sorted(map(tuple, e.groupBy("pull").count().collect())):
        own = e.where(F.col("pull") == week).drop("pull")
        for turn, pull in enumerate((own, own.repartition(3, "user_id"), own.withColumn("value", F.col("value") + 1)), 1):
            decision, commit = store.keep(pull, week)
            out.append((week, turn, n, decision, commit and commit.version, commit and store.read(commit.version).count()))
    return spark.createDataFrame(out, "pull string, turn int, n long, decision string, version string, stored long")


@query("SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 GROUP BY 1", posts=False)
def b2_latest_version(spark, d):
    return S.latest_version(_events(spark, d), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("SELECT event_id FROM events WHERE ts < DATE '2024-01-10' + 1", posts=False)
def b3_cut_through(spark, d):
    return S.cut_through(_events(spark, d), "ts", "2024-01-10").select("event_id")


@query("""WITH k AS (SELECT user_id, max((CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events))::INT) AS i, max(ts) AS t FROM events GROUP BY 1)
SELECT count(*) AS keys, CAST(count_if(i = 1) AS BIGINT) AS in_latest, CAST(count_if(i = 0) AS BIGINT) AS from_earlier, CAST(count_if(t >= DATE '2024-01-29' + 1) AS BIGINT) AS cut FROM k""", posts=False)
def b4_snapshot_stats(spark, d):
    return S.snapshot_stats(_events(spark, d), "user_id", "ts", "2024-01-29")


@query("SELECT doc_id, epoch_ms(CAST(((doc_id * 4194304000) >> 22) + 1288834974657 AS BIGINT))::VARCHAR AS t FROM documents", posts=False)
def b5_decode_id_time(spark, d):
    t = C.decode_id_time(F.col("doc_id") * 4194304000)
    text = F.date_format(t, "yyyy-MM-dd HH:mm:ss.SSS")
    return read_table(spark, d, "documents").select("doc_id", F.regexp_replace(F.regexp_replace(text, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "").alias("t"))


@query("""WITH a AS (SELECT o_orderkey AS k, o_orderstatus AS s, CAST(round(o_totalprice) AS BIGINT) AS v FROM orders WHERE o_orderkey % 7 <> 0), b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS s, CAST(round(o_totalprice) AS BIGINT) + o_orderkey % 3 AS v FROM orders WHERE o_orderkey % 11 <> 0)
SELECT CASE WHEN a.k IS NULL THEN 'new' WHEN b.k IS NULL THEN 'gone' WHEN a.s = b.s THEN 'unchanged' ELSE 'changed' END AS change, count(*) AS n, CAST(sum(coalesce(b.v, 0) - coalesce(a.v, 0)) AS BIGINT) AS delta FROM a FULL JOIN b ON a.k = b.k GROUP BY 1""", posts=False)
def b6_snapshot_diff(spark, d):
    o = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"), F.round("o_totalprice").cast("bigint").alias("v"))
    after = o.where("k % 11 <> 0").withColumns({"s": F.when(F.col("k") % 5 == 0, "X").otherwise(F.col("s")), "v": F.col("v") + F.col("k") % 3})
    return S.snapshot_diff(o.where("k % 7 <> 0"), after, "k", ["s"], "v")


_METRICS = "SELECT family AS key, round(avg(likes) / 100, 6) AS value FROM posts WHERE {} GROUP BY 1"


@query(f"""WITH a AS ({_METRICS.format('id % 2 = 0')}), b AS ({_METRICS.format('true')}) SELECT key, a.value AS before, b.value AS after, round(b.value - a.value, 6) AS delta, coalesce(abs(b.value - a.value) > 0.02, true) AS moved FROM a FULL JOIN b USING (key)""")
def b7_metric_diff(spark, d):
    p = posts(spark, d)
    metrics = [x.groupBy(F.col("family").alias("key")).agg(F.round(F.avg("likes") / 100, 6).alias("value")) for x in (p.where("id % 2 = 0"), p)]
    return S.metric_diff(*metrics, 0.02)


@query("""SELECT 'quality' AS "set", CAST(count_if(l.doc_id IS NOT NULL) AS BIGINT) AS labelled, CAST(count_if(l.doc_id IS NULL AND p.id % 10 = 0) AS BIGINT) AS refused, CAST(count_if(l.doc_id IS NULL AND p.id % 10 <> 0) AS BIGINT) AS missing FROM posts p LEFT JOIN labels l ON l.doc_id = p.id
UNION ALL SELECT 'toxic', CAST(count_if(l.doc_id IS NOT NULL) AS BIGINT), CAST(count_if(l.doc_id IS NULL AND p.id % 10 = 0) AS BIGINT), CAST(count_if(l.doc_id IS NULL AND p.id % 10 <> 0) AS BIGINT) FROM posts p LEFT JOIN labels l ON l.doc_id = p.id AND l.toxic = 1""")
def b8_coverage(spark, d):
    p, labels = posts(spark, d), read_table(spark, d, "labels").withColumnRenamed("doc_id", "id")
    sets = labels.select(F.lit("quality").alias("set"), "id").unionByName(labels.where("toxic = 1").select(F.lit("toxic").alias("set"), "id"))
    return S.coverage(p, sets, p.where("id % 10 = 0").select("id"), "set")


@query("SELECT id FROM posts WHERE id NOT IN (SELECT doc_id FROM labels) AND id % 10 <> 0")
def b9_c5_j1_missing_ids(spark, d):
    p = posts(spark, d)
    return S.missing_ids(p, read_table(spark, d, "labels").select(F.col("doc_id").alias("id")), p.where("id % 10 = 0"))


@query(f"""WITH /*recursive*/ {GROUPS}, merged AS (SELECT node AS id FROM comp JOIN k USING (component) WHERE node <> keep) SELECT count(*) AS items, CAST(count_if(l) AS BIGINT) AS labelled, CAST(count_if(l AND m) AS BIGINT) AS merged, CAST(count_if(l AND NOT m AND e) AS BIGINT) AS excluded, CAST(count_if(l AND NOT m AND NOT e) AS BIGINT) AS base
FROM (SELECT id IN (SELECT doc_id FROM labels) AS l, id IN (SELECT id FROM merged) AS m, evidence = 'error' AS e FROM posts)""")
def b10_analysis_base(spark, d):
    p, labels = posts(spark, d), read_table(spark, d, "labels").withColumnRenamed("doc_id", "id")
    return S.base_steps(p, labels, D.dropped(p, D.all_edges(p)), F.col("evidence") == "error")


@query("SELECT id, CASE WHEN id % 50 = 0 THEN 'view' ELSE evidence END AS evidence, evidence AS raw_evidence, id % 50 = 0 AND evidence <> 'view' AS applied FROM posts")
def b11_apply_overrides(spark, d):
    p = posts(spark, d).select("id", "evidence")
    return S.apply_overrides(p, p.where("id % 50 = 0").select("id", F.lit("view").alias("value")), "evidence")


@query("""WITH s AS (SELECT 'given' AS scenario, evidence, views FROM posts UNION ALL SELECT 'changed', CASE WHEN id % 50 = 0 THEN 'view' ELSE evidence END, views FROM posts) SELECT scenario, evidence, count(*) AS n, round(sum(views)::DOUBLE / sum(sum(views)) OVER (PARTITION BY scenario), 6) AS share FROM s GROUP BY 1, 2""")
def b12_override_effect(spark, d):
    p = posts(spark, d).select("id", "evidence", "views")
    both = p.withColumn("scenario", F.lit("given")).unionByName(p.withColumns({"scenario": F.lit("changed"), "evidence": F.when(F.col("id") % 50 == 0, "view").otherwise(F.col("evidence"))}))
    by = both.groupBy("scenario", "evidence").agg(F.count("*").alias("n"), F.sum("views").alias("v"))
    whole = by.groupBy("scenario").agg(F.sum("v").alias("_v"))
    return by.join(F.broadcast(whole), "scenario").select("scenario", "evidence", "n", C.ratio("v", "_v").alias("share"))


@query("""SELECT user_id, max(CASE WHEN f = 1 THEN event_type END) AS first, max(CASE WHEN l = 1 THEN event_type END) AS last FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS f, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS l FROM events) GROUP BY 1""", posts=False)
def b13_one_label_per_id(spark, d):
    e = _events(spark, d).select("user_id", "event_id", "event_type")
    first, last = (S.one_label_per_id(e, "user_id", "event_id", k).select("user_id", F.col("event_type").alias(k)) for k in ("first", "last"))
    return first.join(last, "user_id")


@query("""SELECT count(*) AS rows, count(DISTINCT id) AS ids, count(*) - count(DISTINCT url) AS repeated_urls, CAST(count_if(length(text) >= 20000) AS BIGINT) AS capped, CAST(count_if(views = 0) AS BIGINT) AS unseen, CAST(count_if(id NOT IN (SELECT doc_id FROM labels)) AS BIGINT) AS unlabelled FROM posts""")
def b14_data_quality(spark, d):
    labels = read_table(spark, d, "labels").select(F.col("doc_id").alias("id"))
    return S.data_quality(posts(spark, d), labels, "id", "url", "text", "views", 20000)


@query("""WITH c AS (SELECT 'items' AS key, count(*)::DOUBLE AS value FROM posts UNION ALL SELECT 'labelled', count(*)::DOUBLE FROM posts WHERE id IN (SELECT doc_id FROM labels)) SELECT key, value AS current, key <> 'items' AS stale FROM c""")
def b15_stale_note(spark, d):
    p, labels = posts(spark, d), read_table(spark, d, "labels").select(F.col("doc_id").alias("id"))
    now = p.agg(F.count("*").cast("double").alias("value")).withColumn("key", F.lit("items")).unionByName(p.join(labels, "id", "left_semi").agg(F.count("*").cast("double").alias("value")).withColumn("key", F.lit("labelled")))
    stamped = now.withColumn("value", F.when(F.col("key") == "items", F.col("value")).otherwise(F.col("value") - 1))
    return S.metric_diff(stamped, now, 0.5).select("key", F.col("after").alias("current"), F.col("moved").alias("stale"))


@query("SELECT CAST(min(ts) AS VARCHAR) AS first, CAST(max(ts) AS VARCHAR) AS last, count(DISTINCT user_id) AS authors, (SELECT max(n) FROM (SELECT count(*) AS n FROM events GROUP BY user_id)) AS most, count(*) AS items, hour(max(ts)) < 23 AS partial_day FROM events", posts=False)
def b16_window_stats(spark, d):
    return S.window_stats(_events(spark, d), "ts", "user_id").withColumns({"first": F.col("first").cast("string"), "last": F.col("last").cast("string")})


@query("SELECT r.id, r.family, r.r1 AS label, r.r2 AS label_v1, CASE WHEN r.evidence IN ('purchase', 'signup') THEN 'proof' WHEN r.evidence = 'error' THEN 'none' ELSE 'claim' END AS step, r.prob >= 0.95 AS candidate FROM raters r", raters=True)
def c1_c7_d1_d4_joined(spark, d):
    r = raters(spark, d).withColumnsRenamed({"r1": "label", "r2": "label_v1"})
    step = C.rule_cascade([(F.col("evidence").isin("purchase", "signup"), "proof"), (F.col("evidence") == "error", "none")], "claim")
    return r.select("id", "family", "label", "label_v1", step.alias("step"), (F.col("prob") >= 0.95).alias("candidate"))


@query(r"""SELECT id, coalesce(len(list_filter(chips, lambda c: regexp_full_match(trim(c), '[0-9]{2,}'))) > 0, false) AS claim, CASE WHEN length(text) > 700 THEN substring(text, 1, 700) || '…' ELSE text END AS view, round(CASE WHEN views > 0 THEN likes::DOUBLE / views END, 6) AS like_rate, views >= 1000 AND likes::DOUBLE / views < 0.002 AS suspect FROM posts""")
def d10_d13_d18_d19_views(spark, d):
    claim = F.coalesce(F.exists("chips", lambda c: F.trim(c).rlike("^[0-9]{2,}$")), F.lit(False))
    return posts(spark, d).select("id", claim.alias("claim"), C.shortened("text").alias("view"), C.like_rate("likes", "views").alias("like_rate"), C.suspect("likes", "views", 1000).alias("suspect"))


@query("SELECT id, CASE WHEN trim(lower(evidence)) = '' THEN NULL ELSE evidence = 'view' END AS flag, regexp_matches(family, '^src1') AS native FROM posts")
def d11_d12_normalised_labels(spark, d):
    return posts(spark, d).select("id", C.as_flag("evidence", ("view",)).alias("flag"), F.col("family").rlike("^src1").alias("native"))


@query("SELECT id, 'evidence' AS field, evidence AS value FROM posts WHERE evidence = 'error'")
def d14_validate_domains(spark, d):
    return K.invalid_values(posts(spark, d).select("id", "evidence", "lang"), "id", {"evidence": [e for e in EVIDENCE if e != "error"], "lang": LANGS})


@query("SELECT 'title' AS field, 'not empty' AS problem, CAST(count_if(title <> '') AS BIGINT) AS n FROM posts UNION ALL SELECT 'author', 'unexpected', count(*) FROM posts")
def d15_validate_keys(spark, d):
    return K.key_violations(posts(spark, d).select("id", "title", "author"), ["id", "title"], ["title"])


@query("SELECT p.id, CASE WHEN p.id % 4 = 0 AND length(upper(p.text)) >= length(p.title) THEN p.text ELSE p.title END AS text, CASE WHEN p.id % 4 = 0 THEN 'full' ELSE 'feed' END AS text_source FROM posts p")
def d20_best_text(spark, d):
    p = posts(spark, d)
    return S.best_text(p.select("id", "title"), p.where("id % 4 = 0").select("id", "text"), "id", "title")


@query("""SELECT name, lhs, rhs, true AS ok FROM (SELECT unnest(['langs', 'liked']) AS name, unnest([count(*), count(*)])::DOUBLE AS lhs, unnest([count(*), count(*)])::DOUBLE AS rhs FROM posts)""")
def n1_contracts(spark, d):
    known = F.sum(F.col("lang").isin(*LANGS).cast("int"))
    both = C.count_if(F.col("likes") >= 50) + C.count_if(F.col("likes") < 50)
    return K.contracts(posts(spark, d), {"langs": (known, F.count("*")), "liked": (both, F.count("*"))})


@query("WITH a AS (SELECT family, median(views) AS v FROM posts GROUP BY 1), b AS (SELECT family, avg(views) AS v FROM posts GROUP BY 1) SELECT family, a.v::DOUBLE AS a, round(b.v, 6) AS b FROM a JOIN b USING (family) WHERE abs(a.v - b.v) > 500")
def n2_n4_near(spark, d):
    p = posts(spark, d)
    return K.near(R.grouped_percentiles(p, ["family"], {"v": ("views", 0.5)}), p.groupBy("family").agg(F.avg("views").alias("v")), ["family"], "v", 500.0)


@query("SELECT id, likes, views FROM posts WHERE likes > views")
def n3_interval_sanity(spark, d):
    p = posts(spark, d).select("id", "likes", "views").withColumn("zero", F.lit(0))
    return K.interval_violations(p, "likes", "zero", "views").drop("zero")


@query("WITH n AS (SELECT count(*)::DOUBLE AS n FROM posts) SELECT lang AS key, count(*)::DOUBLE AS value, any_value(n) * 0.1 AS low, any_value(n) * 0.4 AS high, count(*) BETWEEN any_value(n) * 0.1 AND any_value(n) * 0.4 AS ok FROM posts, n GROUP BY 1")
def n5_claims(spark, d):
    """A share of each language between a tenth and four tenths of the counted base."""
    values = posts(spark, d).groupBy(F.col("lang").alias("key")).agg(F.count("*").cast("double").alias("value"))
    base = values.agg(F.sum("value").alias("n"))
    return K.claims(values, values.select("key").crossJoin(F.broadcast(base)).select("key", (F.col("n") * 0.1).alias("low"), (F.col("n") * 0.4).alias("high")))


@query("SELECT CAST(count_if(o_orderkey % 9 = 0) AS BIGINT) AS only_a, 0::BIGINT AS only_b, true AS same_schema FROM orders", posts=False)
def n6_tables_equal(spark, d):
    o = read_table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return K.tables_equal(o, o.where("o_orderkey % 9 <> 0"))


@query("SELECT url AS path, 'unaccounted' AS problem FROM pages WHERE page_id % 3 = 2 GROUP BY url HAVING count(*) > 0 AND url NOT IN (SELECT url FROM pages WHERE page_id % 3 < 2)", posts=False)
def n7_inventory_check(spark, d):
    pages = read_table(spark, d, "pages").select("page_id", F.col("url").alias("path"))
    zero, one = pages.where("page_id % 3 = 0"), pages.where("page_id % 3 = 1").join(pages.where("page_id % 3 = 0").select("path"), "path", "left_anti")
    return K.unaccounted(pages, zero, one)


@query("SELECT 'union' AS op, count(*) AS n FROM (SELECT doc_id FROM labels UNION SELECT id FROM posts WHERE likes >= 50) UNION ALL SELECT 'difference', count(*) FROM (SELECT id FROM posts WHERE likes >= 50 EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT 'intersection', count(*) FROM (SELECT id FROM posts WHERE likes >= 50 INTERSECT SELECT doc_id FROM labels)")
def set_operations(spark, d):
    a, b = posts(spark, d).where("likes >= 50").select("id"), read_table(spark, d, "labels").select(F.col("doc_id").alias("id"))
    found = {"union": a.union(b).distinct(), "difference": a.distinct().join(b, "id", "left_anti"), "intersection": a.intersect(b)}
    parts = [x.agg(F.count("*").alias("n")).select(F.lit(k).alias("op"), "n") for k, x in found.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
