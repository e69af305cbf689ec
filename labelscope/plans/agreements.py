"""Agreement, confusion and calibration of raters (inventory H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelscope.operators import agreement as A
from labelscope.plans.binding import query, raters
from labelscope.sources.shared import read_table


def _wilson(k: str, n: str) -> tuple[str, str]:
    k, n, z = f"({k})::DOUBLE", f"({n})::DOUBLE", 1.96
    p = f"({k} / {n})"
    mid, half, under = f"({p} + {z * z} / (2 * {n}))", f"({z} * sqrt({p} * (1 - {p}) / {n} + {z * z} / (4 * {n} * {n})))", f"(1 + {z * z} / {n})"
    return f"round(greatest(({mid} - {half}) / {under}, 0), 6)", f"round(least(({mid} + {half}) / {under}, 1), 6)"


_KAPPA = """
conf AS (SELECT {by}, a, b, count(*)::DOUBLE AS w FROM pairs WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ALL),
tot AS (SELECT {by}, sum(w) AS n, sum(CASE WHEN a = b THEN w ELSE 0 END) AS agree FROM conf GROUP BY ALL),
ra AS (SELECT {by}, a AS c, sum(w) AS x FROM conf GROUP BY ALL), rb AS (SELECT {by}, b AS c, sum(w) AS y FROM conf GROUP BY ALL),
pe AS (SELECT {by}, sum(x * y) AS s FROM ra JOIN rb USING ({by}, c) GROUP BY ALL),
kap AS (SELECT {by}, CAST(n AS BIGINT) AS n, CAST(agree AS BIGINT) AS agree, round(agree / n, 6) AS rate,
  CASE WHEN coalesce(s, 0) / (n * n) < 1 THEN round((agree / n - coalesce(s, 0) / (n * n)) / (1 - coalesce(s, 0) / (n * n)), 6) END AS kappa FROM tot LEFT JOIN pe USING ({by}))"""

_LONG = "ll AS (SELECT 'r1' AS rater, id, 'grade' AS field, r1 AS value FROM raters UNION ALL SELECT 'r2', id, 'grade', r2 FROM raters UNION ALL SELECT 'r3', id, 'grade', r3 FROM raters), long AS (SELECT * FROM ll WHERE value IS NOT NULL)"


def long(spark, d):
    return A.unpivoted(raters(spark, d), "id", ["r1", "r2", "r3"], "rater").withColumn("field", F.lit("grade"))


@query(f"WITH {_LONG}, pairs AS (SELECT x.rater AS set_a, y.rater AS set_b, x.field, x.value AS a, y.value AS b FROM long x JOIN long y USING (id, field) WHERE x.rater < y.rater), {_KAPPA.format(by='set_a, set_b, field')} SELECT * FROM kap", raters=True)
def h2_h5_c8_pairwise_agreement(spark, d):
    return A.pairwise(long(spark, d), "rater", "id", "field", "value")


@query(f"WITH pairs AS (SELECT 'grade' AS field, r1 AS a, r2 AS b FROM raters UNION ALL SELECT 'grade_and_kind', r1 || evidence, r2 || evidence FROM raters), {_KAPPA.format(by='field')} SELECT * FROM kap", raters=True)
def h4_field_agreement(spark, d):
    r = raters(spark, d)
    pairs = r.select(F.lit("grade").alias("field"), F.col("r1").alias("a"), F.col("r2").alias("b")).unionByName(r.select(F.lit("grade_and_kind").alias("field"), F.concat("r1", "evidence").alias("a"), F.concat("r2", "evidence").alias("b")))
    return A.kappa(A.confusion_long(pairs, "a", "b", ["field"]), ["field"])


@query("""WITH x AS (SELECT r1 AS a, r2 AS b, sum(1.0 / prob)::DOUBLE AS w, count(*) AS n FROM raters WHERE r1 IS NOT NULL GROUP BY 1, 2), t AS (SELECT sum(w) AS t, sum(n) AS n, sum(CASE WHEN a = b THEN n ELSE 0 END) AS agree, sum(CASE WHEN a = b THEN w ELSE 0 END) AS s FROM x),
e AS (SELECT sum(x * y) AS e FROM (SELECT a AS c, sum(w) AS x FROM x GROUP BY 1) JOIN (SELECT b AS c, sum(w) AS y FROM x GROUP BY 1) USING (c))
SELECT CAST(n AS BIGINT) AS n, CAST(agree AS BIGINT) AS agree, round(s / t, 6) AS rate, round((s / t - e / (t * t)) / (1 - e / (t * t)), 6) AS kappa FROM t, e""", raters=True)
def h3_h7_weighted_kappa(spark, d):
    return A.kappa(A.confusion_long(raters(spark, d), "r1", "r2", weight=1 / F.col("prob")))


@query(f"WITH s AS (SELECT id, unnest(['all', lang, evidence]) AS stratum FROM raters), pairs AS (SELECT stratum, r1 AS a, r3 AS b FROM raters JOIN s USING (id)), {_KAPPA.format(by='stratum')} SELECT * FROM kap", raters=True)
def h6_agreement_by_stratum(spark, d):
    each = raters(spark, d).withColumn("stratum", F.explode(F.array(F.lit("all"), "lang", "evidence")))
    return A.kappa(A.confusion_long(each, "r1", "r3", ["stratum"]), ["stratum"])


_CONF = "conf AS (SELECT r1 AS a, r2 AS b, count(*) AS n FROM raters WHERE r1 IS NOT NULL AND r2 IS NOT NULL GROUP BY 1, 2)"


@query(f"WITH {_CONF} SELECT a, b, n, n::DOUBLE AS w FROM conf", raters=True)
def h8_confusion(spark, d):
    return A.confusion_long(raters(spark, d), "r1", "r2")


_PRF = f"""WITH {_CONF}, v AS (SELECT a AS value FROM conf UNION SELECT b FROM conf), p AS (
SELECT value, CAST(coalesce((SELECT sum(n) FROM conf WHERE a = value), 0) AS BIGINT) AS support, CAST(coalesce((SELECT sum(n) FROM conf WHERE b = value), 0) AS BIGINT) AS predicted, CAST(coalesce((SELECT sum(n) FROM conf WHERE a = value AND b = value), 0) AS BIGINT) AS hits,
 (SELECT arg_max(b, n) FROM conf WHERE a = value AND b <> value) AS top_other FROM v)"""


@query(f"{_PRF} SELECT value, support, predicted, hits, round(hits::DOUBLE / nullif(predicted, 0), 6) AS precision, round(hits::DOUBLE / nullif(support, 0), 6) AS recall, round(2 * hits::DOUBLE / (support + predicted), 6) AS f1, top_other FROM p", raters=True)
def h9_f10_prf(spark, d):
    return A.prf(A.confusion_long(raters(spark, d), "r1", "r2"))


@query(f"{_PRF} SELECT value, hits AS both, support + predicted - hits AS either, round(hits::DOUBLE / (support + predicted - hits), 6) AS jaccard FROM p", raters=True)
def h10_class_jaccard(spark, d):
    return A.class_jaccard(A.confusion_long(raters(spark, d), "r1", "r2"))


_LO, _HI = _wilson("agree", "n")


@query(f"""WITH {_LONG}, ref AS (SELECT id, field, value AS ref FROM long WHERE rater = 'r1'), blocks AS (SELECT id, unnest(CASE WHEN id % 2 = 0 THEN ['all', 'random'] ELSE ['all', 'rare'] END) AS block FROM raters),
pairs AS (SELECT rater, block, field, ref AS a, value AS b FROM long JOIN ref USING (id, field) JOIN blocks USING (id) WHERE rater <> 'r1'), {_KAPPA.format(by='rater, block, field')}
SELECT rater, block, field, n, agree, rate, {_LO} AS lo, {_HI} AS hi, kappa FROM kap""", raters=True)
def h1_h11_h12_accuracy(spark, d):
    each = long(spark, d).withColumn("block", F.explode(F.array(F.lit("all"), F.when(F.col("id") % 2 == 0, "random").otherwise("rare"))))
    reference = long(spark, d).where("rater = 'r1'")
    return A.accuracy(each.where("rater <> 'r1'"), reference, ["rater", "block"], "id", "field", "value")


_EDGES = [0.0, 0.1, 0.25, 0.3, 0.5, 0.75, 0.9, 0.99, 1.0001, 1.5]


@query("WITH b AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {lo}::DOUBLE, {hi}::DOUBLE)" for i, (lo, hi) in enumerate(zip(_EDGES, _EDGES[1:], strict=False))) + """) b(bin, lo, hi))
SELECT CAST(bin AS INT) AS bin, round(lo, 6) AS lo, round(hi, 6) AS hi, count(r.id) AS n, round(avg(prob), 6) AS mean_prob, round(avg((r1 = r2)::INT), 6) AS rate, round(count(r.id)::DOUBLE / (SELECT count(*) FROM raters), 6) AS share
FROM b LEFT JOIN raters r ON r.prob >= b.lo AND r.prob < b.hi GROUP BY bin, lo, hi""", raters=True)
def h13_c9_calibration_fixed(spark, d):
    return A.calibration_fixed(raters(spark, d), "prob", F.col("r1") == F.col("r2"), _EDGES)


@query("""WITH q AS (SELECT *, row_number() OVER (ORDER BY prob, id) AS r, count(*) OVER () AS c FROM raters)
SELECT CAST(greatest(1, ceil((r - 1) * 10.0::DOUBLE / (c - 1))) AS BIGINT) AS bin, count(*) AS n, min(prob) AS least, max(prob) AS most, round(avg(prob), 6) AS mean_prob, round(avg((r1 = r2)::INT), 6) AS rate FROM q GROUP BY 1""", raters=True)
def h14_calibration_equal_count(spark, d):
    return A.calibration_equal_count(raters(spark, d).select("id", "prob", "r1", "r2"), "prob", "id", F.col("r1") == F.col("r2"))


@query("""WITH s AS (SELECT *, unnest(list_filter(['without_error', 'neither_bad', 'sure'], lambda z: CASE z WHEN 'without_error' THEN evidence <> 'error' WHEN 'neither_bad' THEN r1 <> 'bad' AND r2 <> 'bad' ELSE prob >= 0.99 END)) AS slice FROM raters WHERE r1 IS NOT NULL AND r2 IS NOT NULL)
SELECT slice, count(*) AS n, round(avg((r1 = r2)::INT), 6) AS rate FROM s GROUP BY 1""", raters=True)
def h15_agreement_slices(spark, d):
    return A.agreement_slices(raters(spark, d), "r1", "r2", {"without_error": F.col("evidence") != "error", "neither_bad": (F.col("r1") != "bad") & (F.col("r2") != "bad"), "sure": F.col("prob") >= 0.99})


_PLO, _PHI = _wilson("k", "n")


@query(f"""WITH o AS (SELECT avg((r2 = 'good')::INT) AS share, count_if(r2 = 'good' AND r1 = 'good')::DOUBLE / count_if(r2 = 'good' AND r1 IS NOT NULL) AS ppv, count_if(r2 <> 'good' AND r1 = 'good')::DOUBLE / nullif(count_if(r2 <> 'good' AND r1 IS NOT NULL), 0) AS miss, count_if(r1 = 'good') AS k, count_if(r1 IS NOT NULL) AS n FROM raters)
SELECT round(share, 6) AS share, round(ppv, 6) AS ppv, round(miss, 6) AS miss, round(share * ppv + (1 - share) * miss, 6) AS corrected, round(k::DOUBLE / n, 6) AS hand, {_PLO} AS hand_lo, {_PHI} AS hand_hi FROM o""", raters=True)
def h16_prevalence_corrected(spark, d):
    return A.prevalence_corrected(raters(spark, d), "r2", "r1", "good")


@query("""SELECT rater, count(*) AS positives, CAST(count_if(r1 <> 'good') AS BIGINT) AS unconfirmed FROM (SELECT r1, unnest(['r2', 'r3']) AS rater, unnest([r2, r3]) AS value FROM raters WHERE r1 IS NOT NULL) WHERE value = 'good' GROUP BY 1""", raters=True)
def h17_overgrading(spark, d):
    return A.overgrading(raters(spark, d), ["r2", "r3"], "r1", "good")


@query("SELECT count(*) AS n, CAST(count_if(r1 <> r2 AND r1 <> r3) AS BIGINT) AS differs_from_both, CAST(count_if(r2 = r3 AND r1 <> r2) AS BIGINT) AS both_other FROM raters WHERE r1 IS NOT NULL AND r2 IS NOT NULL AND r3 IS NOT NULL", raters=True)
def h18_against_two(spark, d):
    return A.against_two(raters(spark, d), "r1", "r2", "r3")


@query(f"""WITH x AS (SELECT *, 1.0 / prob AS w FROM raters), b AS (SELECT r2 AS value, count(*) AS base FROM x GROUP BY 1),
s AS (SELECT r2 AS value, count(*) AS n, count_if(r1 = r2) AS k, sum(CASE WHEN r1 = r2 THEN w ELSE 0 END) / sum(w) AS wp FROM x WHERE r1 IS NOT NULL GROUP BY 1),
t AS (SELECT r1 AS value, count_if(r1 = r2)::DOUBLE / count(*) AS r, sum(CASE WHEN r1 = r2 THEN w ELSE 0 END) / sum(w) AS wr FROM x WHERE r1 IS NOT NULL GROUP BY 1)
SELECT value, base, n AS audited, round(k::DOUBLE / n, 6) AS precision, {_PLO} AS lo, {_PHI} AS hi, round(wp, 6)::DOUBLE AS weighted_precision, round(r, 6) AS recall, round(wr, 6)::DOUBLE AS weighted_recall FROM b LEFT JOIN s USING (value) LEFT JOIN t USING (value)""", raters=True)
def h20_recount_by_value(spark, d):
    return A.recount_by_value(raters(spark, d), "r2", "r1", 1 / F.col("prob"))


@query("""WITH x AS (SELECT *, 1.0 / prob AS w, unnest(list_filter(['english', 'bought', 'seen'], lambda z: CASE z WHEN 'english' THEN lang = 'en' WHEN 'bought' THEN evidence = 'purchase' ELSE views > 1000 END)) AS "group" FROM raters WHERE r1 IS NOT NULL)
SELECT "group", CAST(count_if(r3 = 'good') AS BIGINT) AS positives, CAST(count_if(r3 = 'good' AND r1 = 'good') AS BIGINT) AS confirmed, round(count_if(r3 = 'good' AND r1 = 'good')::DOUBLE / nullif(count_if(r3 = 'good'), 0), 6) AS precision,
 round(sum(CASE WHEN r3 = 'good' AND r1 = 'good' THEN w ELSE 0 END) / sum(CASE WHEN r3 = 'good' THEN w ELSE 0 END), 6)::DOUBLE AS weighted_precision, CAST(count_if(r3 <> 'good') AS BIGINT) AS negatives,
 CAST(count_if(r3 <> 'good' AND r1 = 'good') AS BIGINT) AS missed, round(count_if(r3 <> 'good' AND r1 = 'good')::DOUBLE / nullif(count_if(r3 <> 'good'), 0), 6) AS miss_rate FROM x GROUP BY 1""", raters=True)
def h21_d16_recount_by_group(spark, d):
    groups = {"english": F.col("lang") == "en", "bought": F.col("evidence") == "purchase", "seen": F.col("views") > 1000}
    return A.recount_by_group(raters(spark, d), groups, F.col("r3") == "good", F.col("r1") == "good", 1 / F.col("prob"))


@query("SELECT count(*) AS n, round(avg((r1 = r3)::INT), 6) AS rate, round(avg(CASE WHEN prob >= 0.99 THEN (r1 = r3)::INT END), 6) AS rate_when_sure FROM raters WHERE r1 IS NOT NULL AND r3 IS NOT NULL", raters=True)
def h22_overlap_with_prior(spark, d):
    same = (F.col("r1") == F.col("r3")).cast("double")
    return raters(spark, d).where("r1 IS NOT NULL AND r3 IS NOT NULL").agg(F.count("*").alias("n"), F.avg(same).alias("rate"), F.avg(F.when(F.col("prob") >= 0.99, same)).alias("rate_when_sure"))


@query("""SELECT count(*) AS calls, CAST(count_if(event_type <> 'error') AS BIGINT) AS ok, CAST(count_if(event_type = 'error') AS BIGINT) AS failed, round(count_if(event_type = 'error')::DOUBLE / count(*), 6) AS error_rate,
 round(quantile_cont(CASE WHEN event_type <> 'error' THEN value END, 0.5), 6) AS p50, round(quantile_cont(CASE WHEN event_type <> 'error' THEN value END, 0.95), 6) AS p95, round(quantile_cont(CASE WHEN event_type <> 'error' THEN value END, 0.99), 6) AS p99,
 count(DISTINCT CASE WHEN event_type = 'error' THEN user_id % 5 END) AS kinds FROM events""", posts=False)
def h23_call_stats(spark, d):
    return A.call_stats(read_table(spark, d, "events"), F.col("event_type") != "error", "value", F.col("user_id") % 5)


@query("SELECT regexp_extract(props, '([0-9])[}]', 1) AS kind, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1", posts=False)
def h24_error_kinds(spark, d):
    return read_table(spark, d, "events").where("event_type = 'error'").groupBy(F.regexp_extract("props", "([0-9])[}]", 1).alias("kind")).agg(F.count("*").alias("n"))


@query("""SELECT rater, round(avg((value = 'good')::INT), 6) AS rate, round(avg(CASE WHEN evidence <> 'error' THEN (value = 'good')::INT END), 6) AS rate_without FROM (SELECT evidence, unnest(['r1', 'r2', 'r3']) AS rater, unnest([r1, r2, r3]) AS value FROM raters WHERE r1 IS NOT NULL) GROUP BY 1""", raters=True)
def h25_positive_rates(spark, d):
    each = raters(spark, d).where("r1 IS NOT NULL").unpivot(["evidence"], ["r1", "r2", "r3"], "rater", "value")
    good = (F.col("value") == "good").cast("double")
    return each.groupBy("rater").agg(F.avg(good).alias("rate"), F.avg(F.when(F.col("evidence") != "error", good)).alias("rate_without"))
