"""Audit checks of classes, regions, claims and limits, and views of posts and labelling runs (parts of inventory B, D and I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelscope.functions import columns as C
from labelscope.operators import sampling as S
from labelscope.operators import snapshots as N
from labelscope.plans.audits import _HIGH, _LOW, DRAW, _drawn, _members
from labelscope.plans.binding import posts, query, raters
from labelscope.sources.shared import read_table


@query(f"""WITH {DRAW}, a AS (SELECT r1, evidence FROM dr JOIN raters USING (id) WHERE stratum = 'positive' AND r1 IS NOT NULL), t AS (SELECT count(*) AS n FROM a), c AS (SELECT count(*) AS population FROM raters WHERE r2 = 'good'),
p AS (SELECT 'stays' AS part, 'good' AS key, CAST(count_if(r1 = 'good') AS BIGINT) AS k FROM a UNION ALL SELECT 'moved', r1, count(*) FROM a WHERE r1 <> 'good' GROUP BY 2 UNION ALL SELECT 'subtype', evidence, count(*) FROM a WHERE r1 = 'good' GROUP BY 2)
SELECT part, key, n, k, round(k::DOUBLE / n * population, 6) AS value, round({_LOW} * population, 6) AS lo, round({_HIGH} * population, 6) AS hi FROM p, t, c""", raters=True)
def i23_still_in_class(spark, d):
    r = raters(spark, d)
    audited = _drawn(spark, d).where("stratum = 'positive'").join(r, "id")
    return S.still_in_class(audited, r.where("r2 = 'good'").agg(F.count("*").alias("population")), "r2", "r1", "good", "evidence")


@query(f"""WITH {DRAW}, g AS (SELECT id, lang AS region, coalesce(r2 = 'good', false) AS mo, coalesce(r1 = 'good', false) AS au FROM raters WHERE lang IN ('en', 'de') UNION ALL SELECT id, 'seen', coalesce(r2 = 'good', false), coalesce(r1 = 'good', false) FROM raters WHERE evidence IN ('view', 'click')),
two AS (SELECT * FROM m WHERE stratum IN ('positive', 'negative')), dt AS (SELECT * FROM dr WHERE stratum IN ('positive', 'negative')),
sz AS (SELECT region, stratum, count(*) AS population FROM two JOIN g USING (id) GROUP BY 1, 2), sm AS (SELECT region, stratum, count(*) AS n, count_if(au) AS k FROM dt JOIN g USING (id) GROUP BY 1, 2),
e AS (SELECT region, sum(k::DOUBLE / n * population) AS v, sum({_LOW} * population) AS l, sum({_HIGH} * population) AS h FROM sz JOIN sm USING (region, stratum) GROUP BY 1),
c AS (SELECT region, count(*) AS region_n, CAST(count_if(mo) AS BIGINT) AS model_n FROM g GROUP BY 1),
s AS (SELECT region, count(*) AS audited_n, CAST(count_if(mo) AS BIGINT) AS model_pos, CAST(count_if(mo AND au) AS BIGINT) AS both_pos, CAST(count_if(au) AS BIGINT) AS audit_pos FROM g WHERE id IN (SELECT id FROM dt) GROUP BY 1)
SELECT c.region, region_n, model_n, round(v, 6) AS value, round(l, 6) AS lo, round(h, 6) AS hi, audited_n, model_pos, both_pos, audit_pos, model_n >= l - 1e-9 AND model_n <= h + 1e-9 AS inside FROM c JOIN e USING (region) JOIN s USING (region)""", raters=True)
def i15_region_check(spark, d):
    r = raters(spark, d)
    two = "stratum IN ('positive', 'negative')"
    regions = {"en": F.col("lang") == "en", "de": F.col("lang") == "de", "seen": F.col("evidence").isin("view", "click")}
    return S.region_check(_members(spark, d).where(two), _drawn(spark, d).where(two), r, r, F.col("r2") == "good", F.col("r1") == "good", regions)


@query(f"""WITH {DRAW}, a AS (SELECT * FROM raters WHERE id IN (SELECT id FROM dr)), b AS (SELECT 'quality' AS claim, r2 AS label, r1 AS reference FROM a UNION ALL SELECT 'clean', r3, r1 FROM a WHERE lang = 'en' UNION ALL SELECT 'stated', CASE WHEN prob >= 0.5 THEN 'likely' ELSE 'unlikely' END, r1 FROM a)
SELECT claim, label, reference, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY claim, label), 6) AS share FROM b WHERE label IS NOT NULL AND reference IS NOT NULL GROUP BY 1, 2, 3""", raters=True)
def i30_sanity_tables(spark, d):
    audited = raters(spark, d).join(_drawn(spark, d).select("id").distinct(), "id", "left_semi")
    stated = F.when(F.col("prob") >= 0.5, "likely").otherwise("unlikely")
    return S.sanity_tables(audited, {"quality": (F.lit(True), F.col("r2"), F.col("r1")), "clean": (F.col("lang") == "en", F.col("r3"), F.col("r1")), "stated": (F.lit(True), stated, F.col("r1"))})


@query(f"""WITH {DRAW}, x AS (SELECT raters.id, r1, r2, chips FROM raters JOIN posts USING (id)), a AS (SELECT * FROM x WHERE id IN (SELECT id FROM dr))
SELECT 'unsampled' AS "limit", r2 AS key, CAST((SELECT count(*) FROM a WHERE a.r2 = x.r2 AND a.r1 = x.r2) AS BIGINT) AS k, count(*) AS n FROM x GROUP BY r2
UNION ALL SELECT 'numeric_chip', '', CAST(count_if(chips IS NOT NULL) AS BIGINT), count(*) FROM a WHERE r1 = 'bad'""", raters=True)
def i33_design_limits(spark, d):
    items = raters(spark, d).join(posts(spark, d).select("id", "chips"), "id")
    return S.design_limits(items, _drawn(spark, d), "r2", "r1", F.col("r1") == "bad")


_MEDIA = "list_transform(chips, lambda c: {'kind': CASE WHEN contains(c, '.') THEN 'gif' WHEN len(c) > 3 THEN 'audio' ELSE 'photo' END, 'thumb': CASE WHEN c = '7' THEN '' ELSE 't/' || c END})"
_USABLE = "list_filter({x}, lambda m: m.kind <> 'audio' AND m.thumb <> '')"


@query(f"""WITH p AS (SELECT id, title, text, {_MEDIA} AS media FROM posts), f AS (SELECT id, text, id % 5 <> 0 AS ok, CASE WHEN id % 2 = 0 THEN media END AS media, CASE WHEN id % 3 = 0 THEN [{{'kind': 'photo', 'thumb': 'q'}}] END AS quote_media FROM p WHERE id % 4 = 0),
x AS (SELECT p.id, f.ok IS NOT NULL AND f.ok AS fetched, p.title, f.text, coalesce({_USABLE.format(x='f.media')}, []) AS fm, coalesce(f.quote_media, []) AS qm, coalesce({_USABLE.format(x='p.media')}, []) AS pm FROM p LEFT JOIN f ON f.id = p.id),
y AS (SELECT *, CASE WHEN fetched AND len(fm) > 0 THEN fm WHEN fetched AND len(qm) > 0 THEN qm ELSE pm END AS m, CASE WHEN fetched AND len(fm) > 0 THEN 'post' WHEN fetched AND len(qm) > 0 THEN 'quoted post' WHEN len(pm) > 0 THEN 'post' END AS media_in FROM x)
SELECT id, CASE WHEN fetched THEN substring(text, 1, 2000) ELSE title END AS text, CASE WHEN fetched THEN 'full' ELSE 'feed' END AS text_source, CASE WHEN fetched THEN length(text) > 2000 ELSE length(title) >= 55 END AS truncated,
 CASE WHEN len(list_filter(m, lambda z: z.kind = 'gif')) > 0 THEN 'video' WHEN len(m) > 0 THEN 'image' ELSE 'none' END AS media_type, media_in, array_to_string(list_transform(m[1:4], lambda z: z.thumb), '|') AS thumbs FROM y""")
def d20_shown_post(spark, d):
    """Items with their titles as the feed's text and their claims as media, some fetched in full, some of those not ok."""
    kind = lambda c: F.when(c.contains("."), "gif").when(F.length(c) > 3, "audio").otherwise("photo")
    media = F.transform("chips", lambda c: F.struct(kind(c).alias("kind"), F.when(c == "7", "").otherwise(F.concat(F.lit("t/"), c)).alias("thumb")))
    p = posts(spark, d).select("id", "title", "text", media.alias("media"))
    quoted = F.array(F.struct(F.lit("photo").alias("kind"), F.lit("q").alias("thumb")))
    full = p.where("id % 4 = 0").select("id", "text", (F.col("id") % 5 != 0).alias("ok"), F.when(F.col("id") % 2 == 0, F.col("media")).alias("media"), F.when(F.col("id") % 3 == 0, quoted).alias("quote_media"))
    out = N.shown_post(p.select("id", F.col("title").alias("text"), "media"), full, "id", feed_cap=60, full_cap=2000)
    return out.withColumn("thumbs", F.array_join("thumbs", "|"))


@query("SELECT id, title AS t, CASE WHEN length(text) > 700 THEN substring(text, 1, 700) || '…' ELSE text END AS x, coalesce(array_to_string(chips, '|'), '') AS chips, family || ' / ' || lang AS hint FROM posts")
def d18_prompt_view(spark, d):
    return N.prompt_view(posts(spark, d), "id", "title", "text", "chips", ("family", "lang")).withColumn("chips", F.array_join("chips", "|"))


@query("SELECT id, CASE WHEN evidence = 'error' THEN NULL WHEN evidence IN ('signup') THEN 'other' ELSE evidence END AS label, CASE WHEN evidence = 'error' THEN NULL ELSE evidence END AS plain FROM posts")
def d11_label_values(spark, d):
    raw = F.when(F.col("evidence") == "error", "  ").otherwise(F.concat(F.lit(" "), F.col("evidence"), F.lit(" ")))
    return posts(spark, d).select("id", C.label_value(raw, ["signup"]).alias("label"), C.label_value(raw).alias("plain"))


@query("""WITH u AS (SELECT CAST(floor(event_id / 40) AS BIGINT) AS batch, max(CASE WHEN event_type = 'error' AND user_id % 10 = 0 THEN 2 ELSE 1 END) AS round, count_if(event_type = 'error') AS missing, count_if(user_id % 7 = 0) AS stray FROM events GROUP BY 1),
l AS (SELECT doc_id AS id FROM labels UNION ALL SELECT doc_id FROM labels WHERE doc_id % 5 = 0 UNION ALL SELECT -doc_id - 1 FROM labels WHERE doc_id % 9 = 0)
SELECT (SELECT count(*) FROM u) AS batches, (SELECT count(*) FROM u WHERE round > 1) AS retry_batches, CAST((SELECT sum(missing) FROM u) AS BIGINT) AS missing_in_answers, CAST((SELECT sum(stray) FROM u) AS BIGINT) AS stray_in_answers,
 (SELECT count(*) - count(DISTINCT id) FROM l) AS repeated_labels, (SELECT count(DISTINCT id) FROM l WHERE id NOT IN (SELECT id FROM posts)) AS stray_labels, bool_and(day = CAST(ts AS DATE)) AS days_match FROM posts""")
def b14_intake_quality(spark, d):
    e, labels = read_table(spark, d, "events"), read_table(spark, d, "labels").select(F.col("doc_id").alias("id"))
    again = (F.col("event_type") == "error") & (F.col("user_id") % 10 == 0)
    usage = e.groupBy(F.floor(F.col("event_id") / 40)).agg(F.max(F.when(again, 2).otherwise(1)).alias("round"), C.count_if(F.col("event_type") == "error").alias("missing"), C.count_if(F.col("user_id") % 7 == 0).alias("stray"))
    more = labels.unionByName(labels.where("id % 5 = 0")).unionByName(labels.where("id % 9 = 0").select((-F.col("id") - 1).alias("id")))
    return N.intake_quality(usage, more, posts(spark, d), "id", "day", "ts")
