"""Further bindings: joins of label versions, prose predicates, second readings, ladders of estimates."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelscope.functions import columns as C
from labelscope.operators import agreement as A
from labelscope.operators import sampling as S
from labelscope.plans.audits import DRAW, SIZES, _HIGH, _LOW
from labelscope.plans.binding import EVIDENCE, posts, query, raters
from labelscope.sources.shared import read_table

GROUPS = {"view": "reach", "click": "reach", "signup": "growth", "purchase": "growth"}


@query("""WITH a AS (SELECT id, family, evidence FROM posts WHERE id % 3 <> 0), b AS (SELECT id, family AS family_v1, evidence AS evidence_v1 FROM posts WHERE id % 2 = 0)
SELECT a.id, family, evidence, family_v1, evidence_v1, CASE WHEN evidence IN ('view', 'click') THEN 'reach' WHEN evidence IN ('signup', 'purchase') THEN 'growth' END AS "group" FROM a JOIN b USING (id) WHERE a.id IN (SELECT doc_id FROM labels)""")
def c2_c3_c4_c6_label_versions(spark, d):
    p = posts(spark, d).select("id", "family", "evidence")
    second = p.where("id % 2 = 0").withColumnsRenamed({"family": "family_v1", "evidence": "evidence_v1"})
    sampled = read_table(spark, d, "labels").select(F.col("doc_id").alias("id"))
    return p.where("id % 3 <> 0").join(second, "id").join(sampled, "id", "left_semi").withColumn("group", C.looked_up("evidence", GROUPS))


@query("""SELECT id, coalesce(CASE WHEN likes > 90 THEN 'repo' END = 'repo', false) OR contains(url, 'ab') AS repo, evidence = 'purchase' AND likes >= 50 AND views < 1000 AS narrow_proof, evidence IN ('view', 'click') AND chips IS NULL AS narrow_talk, chips IS NOT NULL AND evidence <> 'purchase' AS claim_only FROM posts""")
def d2_d3_d9_predicates(spark, d):
    e = F.col("evidence")
    return posts(spark, d).select(
        "id", C.has_repo(F.when(F.col("likes") > 90, "repo"), "url", "ab").alias("repo"), ((e == "purchase") & (F.col("likes") >= 50) & (F.col("views") < 1000)).alias("narrow_proof"),
        (e.isin("view", "click") & F.col("chips").isNull()).alias("narrow_talk"), (F.col("chips").isNotNull() & (e != "purchase")).alias("claim_only"),
    )


@query("""WITH a AS (SELECT id, evidence AS code FROM posts WHERE id % 2 = 0), b AS (SELECT id, CASE WHEN likes >= 80 THEN 'view' ELSE evidence END AS code FROM posts WHERE id % 3 = 0)
SELECT a.code, count(*) AS n, CAST(count_if(b.code = a.code) AS BIGINT) AS same, CAST(count_if(b.code <> a.code) AS BIGINT) AS moved, CAST(count_if(b.code IS NULL) AS BIGINT) AS unread FROM a LEFT JOIN b USING (id) GROUP BY 1""")
def e18_reread_profile(spark, d):
    p = posts(spark, d).select("id", "likes", F.col("evidence").alias("code"))
    second = p.where("id % 3 = 0").withColumn("code", F.when(F.col("likes") >= 80, "view").otherwise(F.col("code")))
    return A.reread_profile(p.where("id % 2 = 0"), second, "id", "code")


@query("""WITH x AS (SELECT unnest(['grade', 'kind']) AS field, unnest([r1, r1 || evidence]) AS a, unnest([r2, r3 || evidence]) AS b FROM raters), c AS (SELECT field, a, b, count(*) AS n FROM x WHERE a <> b GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY field ORDER BY n DESC, a, b) AS INT) AS rank FROM c) SELECT field, a, b, n, rank FROM r WHERE rank <= 4""", raters=True)
def h12_top_confusions(spark, d):
    r = raters(spark, d)
    pairs = r.select(F.lit("grade").alias("field"), F.col("r1").alias("a"), F.col("r2").alias("b")).unionByName(r.select(F.lit("kind").alias("field"), F.concat("r1", "evidence").alias("a"), F.concat("r3", "evidence").alias("b")))
    return A.top_confusions(A.confusion_long(pairs, "a", "b", ["field"]), ["field"])


_STEPS = ", ".join(f"'{e}'" for e in EVIDENCE)


@query(f"""WITH {DRAW}, pop AS (SELECT stratum, count(*) AS population FROM m WHERE stratum IN ('positive', 'negative') GROUP BY 1), q AS (SELECT stratum, unnest([{_STEPS}]) AS question FROM pop),
aud AS (SELECT dr.stratum, count(*) AS n FROM dr GROUP BY 1), hit AS (SELECT dr.stratum, evidence AS question, count(*) AS k FROM dr JOIN raters USING (id) WHERE coalesce(r1 = 'good', false) GROUP BY 1, 2),
p AS (SELECT question, stratum, population, n, coalesce(k, 0) AS k FROM q JOIN pop USING (stratum) JOIN aud USING (stratum) LEFT JOIN hit USING (stratum, question))
SELECT question, round(sum(k::DOUBLE / n * population), 6) AS value, round(sum({_LOW} * population), 6) AS lo, round(sum({_HIGH} * population), 6) AS hi, CAST(sum(k) AS BIGINT) AS k, CAST(sum(n) AS BIGINT) AS n, 0::BIGINT AS plug, round(sum(k::DOUBLE / n * population) / (SELECT count(*) FROM raters), 6) AS share FROM p GROUP BY 1""", raters=True)
def i17_i20_i24_ladder(spark, d):
    """Each step of the ladder from two samples: kept positives of one and misses of the other."""
    r = raters(spark, d)
    members = S.strata(r, "id", {"positive": F.col("r2") == "good", "negative": F.col("r2") == "bad"})
    drawn = S.sample_per_stratum(members, {k: v for k, v in SIZES.items() if k != "english"}, "s1")
    steps = {e: (F.col("r1") == "good") & (F.col("evidence") == e) for e in EVIDENCE}
    return S.stratified_estimate(S.parts_table(members, drawn, r, steps), r.count())


@query("""SELECT id, CASE WHEN evidence IN ('purchase', 'signup') THEN 'claim' WHEN likes >= 50 THEN 'proof' WHEN lang = 'en' THEN 'talk' ELSE 'not_covered' END AS applied,
 CASE WHEN likes >= 50 AND evidence <> 'error' THEN 'proof' WHEN evidence IN ('purchase', 'signup') THEN 'claim' WHEN lang = 'en' THEN 'talk' ELSE 'not_covered' END AS corrected FROM posts""")
def d6_d7_bucket_cascades(spark, d):
    """The cascade as it was applied and as it was corrected: the same rules in another order, and one of them tighter."""
    claim, talk = (F.col("evidence").isin("purchase", "signup"), "claim"), (F.col("lang") == "en", "talk")
    applied = C.rule_cascade([claim, (F.col("likes") >= 50, "proof"), talk], "not_covered")
    corrected = C.rule_cascade([((F.col("likes") >= 50) & (F.col("evidence") != "error"), "proof"), claim, talk], "not_covered")
    return posts(spark, d).select("id", applied.alias("applied"), corrected.alias("corrected"))


_BUCKETS = ("proof", "claim", "talk", "not_covered")
_BUCKET = "CASE WHEN evidence = 'purchase' AND prob >= 0.5 THEN 'proof' WHEN evidence IN ('purchase', 'signup') THEN 'claim' WHEN lang = 'en' THEN 'talk' ELSE 'not_covered' END"


def _sampled(strata: str, sizes: dict[str, int], seed: str) -> str:
    """Members, seeded samples and, for strata without a size, the census."""
    cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in sizes.items())
    return f"""mm AS (SELECT id, {strata} AS stratum FROM raters), rk AS (SELECT stratum, id, row_number() OVER (PARTITION BY stratum ORDER BY md5('{seed}:' || stratum || ':' || id), id) AS place FROM mm),
    drawn AS (SELECT stratum, id FROM rk WHERE place <= CASE stratum {cases} ELSE 0 END UNION ALL SELECT stratum, id FROM mm WHERE stratum = 'census'), pop AS (SELECT stratum, count(*) AS population FROM mm GROUP BY 1)"""


_ADDED = f"""SELECT question, round(sum(CASE WHEN stratum = 'census' THEN k WHEN n = 0 THEN plugged ELSE k::DOUBLE / n * population END), 6) AS value,
 round(sum(CASE WHEN stratum = 'census' THEN k WHEN n = 0 THEN plugged ELSE {_LOW} * population END), 6) AS lo, round(sum(CASE WHEN stratum = 'census' THEN k WHEN n = 0 THEN plugged ELSE {_HIGH} * population END), 6) AS hi,
 CAST(sum(k) AS BIGINT) AS k, CAST(sum(n) AS BIGINT) AS n, CAST(sum(CASE WHEN n = 0 AND stratum <> 'census' THEN plugged ELSE 0 END) AS BIGINT) AS plug,
 round(sum(CASE WHEN stratum = 'census' THEN k WHEN n = 0 THEN plugged ELSE k::DOUBLE / n * population END) / (SELECT count(*) FROM raters), 6) AS share FROM p GROUP BY 1"""
_FOUR = "CASE WHEN prob >= 0.95 THEN 'census' WHEN lang = 'fr' THEN 'remainder' WHEN r2 = 'good' THEN 'positive' ELSE 'negative' END"


@query(f"""WITH {_sampled(_FOUR, {"positive": 60, "negative": 20}, "s4")}, b AS (SELECT id, {_BUCKET} AS bucket, coalesce(r1 = 'good', false) AS holds, r2 = 'good' AS model FROM raters),
q AS (SELECT stratum, population, unnest([{', '.join(f"'{x}'" for x in _BUCKETS)}]) AS question FROM pop), aud AS (SELECT stratum, count(*) AS n FROM drawn GROUP BY 1),
hit AS (SELECT stratum, bucket AS question, count_if(holds) AS k FROM drawn JOIN b USING (id) GROUP BY 1, 2), plug AS (SELECT stratum, bucket AS question, count_if(model) AS plugged FROM mm JOIN b USING (id) GROUP BY 1, 2),
p AS (SELECT question, stratum, population, coalesce(n, 0) AS n, coalesce(k, 0) AS k, coalesce(plugged, 0) AS plugged FROM q LEFT JOIN aud USING (stratum) LEFT JOIN hit USING (stratum, question) LEFT JOIN plug USING (stratum, question)) {_ADDED}""", raters=True)
def i18_bucket_estimates(spark, d):
    """Each bucket from a census, two samples and, for the rest that was not audited, the labels' own count."""
    r = raters(spark, d)
    e = F.col("evidence")
    bucket = C.rule_cascade([((e == "purchase") & (F.col("prob") >= 0.5), "proof"), (e.isin("purchase", "signup"), "claim"), (F.col("lang") == "en", "talk")], "not_covered")
    stratum = C.rule_cascade([(F.col("prob") >= 0.95, "census"), (F.col("lang") == "fr", "remainder"), (F.col("r2") == "good", "positive")], "negative")
    members = r.select(stratum.alias("stratum"), "id")
    drawn = S.sample_per_stratum(members, {"positive": 60, "negative": 20}, "s4").select("stratum", "id").unionByName(members.where("stratum = 'census'"))
    parts = S.parts_table(members, drawn, r, {b: (bucket == b) & (F.col("r1") == "good") for b in _BUCKETS}, ["census"])
    return S.stratified_estimate(parts, r.count(), S.plugged_counts(members, r, {b: (bucket == b) & (F.col("r2") == "good") for b in _BUCKETS}))


_RARE = "CASE WHEN family = 'src3' THEN 'census' WHEN r2 = 'bad' THEN 'negative' ELSE 'other' END"


@query(f"""WITH {_sampled(_RARE, {"negative": 20}, "s5")}, b AS (SELECT id, coalesce(CASE WHEN family = 'src3' THEN r1 = 'good' ELSE r3 = 'bad' END, false) AS holds FROM raters),
aud AS (SELECT stratum, count(*) AS n, count_if(holds) AS k FROM drawn JOIN b USING (id) GROUP BY 1),
p AS (SELECT 'rare' AS question, stratum, population, coalesce(n, 0) AS n, coalesce(k, 0) AS k, 0 AS plugged FROM pop LEFT JOIN aud USING (stratum) WHERE stratum <> 'other') {_ADDED}""", raters=True)
def i19_rare_family_estimate(spark, d):
    """A rare family: those of its census that hold, and the misses that a sample of the negatives shows."""
    r = raters(spark, d)
    stratum = C.rule_cascade([(F.col("family") == "src3", "census"), (F.col("r2") == "bad", "negative")], "other")
    members = r.select(stratum.alias("stratum"), "id").where("stratum <> 'other'")
    drawn = S.sample_per_stratum(members, {"negative": 20}, "s5").select("stratum", "id").unionByName(members.where("stratum = 'census'"))
    holds = F.when(F.col("family") == "src3", F.col("r1") == "good").otherwise(F.col("r3") == "bad")
    return S.stratified_estimate(S.parts_table(members, drawn, r, {"rare": holds}, ["census"]), r.count())
