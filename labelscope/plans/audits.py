"""Audit design and estimates over raters (inventory I): R2 is under test, R1 and R3 are the reference."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelscope.operators import sampling as S
from labelscope.plans.agreements import _wilson
from labelscope.plans.binding import query, raters

STRATA = "m AS (SELECT id, unnest(list_filter(['positive', 'negative', 'rare', 'english'], lambda z: CASE z WHEN 'positive' THEN r2 = 'good' WHEN 'negative' THEN r2 = 'bad' WHEN 'rare' THEN prob >= 0.95 ELSE lang = 'en' END)) AS stratum FROM raters)"
SIZES = {"positive": 60, "negative": 20, "english": 40}
DRAW = f"""{STRATA}, ranked AS (SELECT stratum, id, row_number() OVER (PARTITION BY stratum ORDER BY md5('s1:' || stratum || ':' || id), id) AS place FROM m),
dr AS (SELECT stratum, id, CAST(place AS INT) AS place FROM ranked WHERE place <= CASE stratum {' '.join(f"WHEN '{k}' THEN {v}" for k, v in SIZES.items())} ELSE 0 END)"""


def _members(spark, d):
    r = raters(spark, d)
    return S.strata(r, "id", {"positive": F.col("r2") == "good", "negative": F.col("r2") == "bad", "rare": F.col("prob") >= 0.95, "english": F.col("lang") == "en"})


def _drawn(spark, d):
    return S.sample_per_stratum(_members(spark, d), SIZES, "s1")


@query(f"WITH {STRATA} SELECT stratum, count(*) AS population FROM m GROUP BY 1", raters=True)
def i1_strata(spark, d):
    return S.populations(_members(spark, d))


@query(f"WITH {STRATA} SELECT id FROM m WHERE stratum = 'rare'", raters=True)
def i2_census(spark, d):
    return _members(spark, d).where("stratum = 'rare'").select("id")


@query(f"WITH {DRAW} SELECT * FROM dr", raters=True)
def i3_sample_per_stratum(spark, d):
    return _drawn(spark, d)


@query(f"""WITH {STRATA}, a AS (SELECT id, row_number() OVER (ORDER BY md5('s2:positive:' || id), id) AS place FROM m WHERE stratum = 'positive'), a1 AS (SELECT * FROM a WHERE place <= 50),
b AS (SELECT id, row_number() OVER (ORDER BY md5('s2:rare:' || id), id) AS place FROM m WHERE stratum = 'rare' AND id NOT IN (SELECT id FROM a1)), b1 AS (SELECT * FROM b WHERE place <= 15)
SELECT 'positive' AS stratum, id, CAST(place AS INT) AS place FROM a1 UNION ALL SELECT 'rare', id, CAST(place AS INT) FROM b1""", raters=True)
def i4_sequential_draws(spark, d):
    return S.sequential_draws(_members(spark, d), [("positive", 50), ("rare", 15)], "s2")


@query(f"WITH {DRAW} SELECT id, array_to_string(list_sort(list(stratum)), '|') AS strata FROM m WHERE id IN (SELECT id FROM dr) GROUP BY 1", raters=True)
def i5_membership(spark, d):
    return S.membership(_members(spark, d), _drawn(spark, d)).withColumn("strata", F.concat_ws("|", "strata"))


@query(f"""WITH {DRAW}, u AS (SELECT id, min(b) AS b FROM (SELECT id, 0 AS b FROM m WHERE stratum = 'rare' UNION ALL SELECT id, 1 FROM dr) GROUP BY 1)
SELECT id, CAST(floor((row_number() OVER (ORDER BY b, id) - 1) / 40) AS BIGINT) AS batch FROM u""", raters=True)
def i6_label_batches(spark, d):
    return S.label_batches(_members(spark, d).where("stratum = 'rare'"), _drawn(spark, d), 40)


@query(f"WITH {DRAW} SELECT id, CAST(row_number() OVER (ORDER BY b, md5('s3:order:' || id)) AS INT) AS position FROM (SELECT id, min(CASE WHEN stratum = 'positive' THEN 0 ELSE 1 END) AS b FROM dr GROUP BY 1)", raters=True)
def i7_shuffle_blocks(spark, d):
    drawn = _drawn(spark, d).groupBy("id").agg(F.min(F.when(F.col("stratum") == "positive", 0).otherwise(1)).alias("b"))
    return S.shuffled_blocks(drawn, F.col("b"), "s3")


@query(f"""WITH {DRAW}, e AS (SELECT stratum, count(*) + (stratum = 'rare')::INT AS expected FROM m GROUP BY 1)
SELECT stratum, expected::BIGINT AS expected, expected::BIGINT - 1 AS population, 0::BIGINT AS outside FROM e WHERE stratum = 'rare'""", raters=True)
def i8_design_check(spark, d):
    members = _members(spark, d)
    expected = S.populations(members).select("stratum", (F.col("population") + F.when(F.col("stratum") == "rare", 1).otherwise(0)).alias("expected"))
    return S.design_check(expected, members, _drawn(spark, d))


@query(f"""WITH {STRATA}, z AS (SELECT stratum, count(*) AS n FROM m GROUP BY 1), f AS (SELECT id, CASE WHEN stratum = 'rare' THEN 1.0 ELSE least(1.0, CASE stratum {' '.join(f"WHEN '{k}' THEN {v}.0" for k, v in SIZES.items())} END / z.n) END::DOUBLE AS f FROM m JOIN z USING (stratum))
SELECT id, round(1 - product(1 - f), 6) AS pi FROM f GROUP BY 1""", raters=True)
def i9_inclusion_probability(spark, d):
    return S.inclusion_probability(_members(spark, d), SIZES, ["rare"])


_LO, _HI = _wilson("k", "n")
_LOW, _HIGH = _LO.replace("round(", "", 1).rsplit(", 6)", 1)[0], _HI.replace("round(", "", 1).rsplit(", 6)", 1)[0]
#: Parts of two questions over the two disjoint strata of R2.
PARTS = f"""{DRAW}, q AS (SELECT id, unnest(['good', 'clean']) AS question, unnest([coalesce(r1 = 'good', false), coalesce(r3 = 'good', false)]) AS holds FROM raters),
two AS (SELECT * FROM m WHERE stratum IN ('positive', 'negative')), pop AS (SELECT stratum, count(*) AS population FROM two GROUP BY 1),
aud AS (SELECT question, stratum, count(*) AS n, count_if(holds) AS k FROM dr JOIN q USING (id) WHERE stratum IN ('positive', 'negative') GROUP BY 1, 2),
parts AS (SELECT question, stratum, population, coalesce(n, 0) AS n, CAST(coalesce(k, 0) AS BIGINT) AS k FROM pop CROSS JOIN (SELECT unnest(['good', 'clean']) AS question) LEFT JOIN aud USING (question, stratum)),
bounds AS (SELECT *, k::DOUBLE / n * population AS v, {_LOW} * population AS l, {_HIGH} * population AS h FROM parts),
est AS (SELECT question, round(sum(v), 6) AS value, round(sum(l), 6) AS lo, round(sum(h), 6) AS hi, CAST(sum(k) AS BIGINT) AS k, CAST(sum(n) AS BIGINT) AS n FROM bounds GROUP BY 1)"""


def _parts(spark, d):
    r = raters(spark, d)
    two = _members(spark, d).where("stratum IN ('positive', 'negative')")
    drawn = _drawn(spark, d).where("stratum IN ('positive', 'negative')")
    return S.parts_table(two, drawn, r, {"good": F.col("r1") == "good", "clean": F.col("r3") == "good"})


@query(f"WITH {PARTS} SELECT question, stratum, population, n, k, false AS is_census FROM parts", raters=True)
def i10_i14_parts(spark, d):
    return _parts(spark, d)


@query(f"WITH {PARTS} SELECT *, 0::BIGINT AS plug, round(value / (SELECT count(*) FROM raters), 6) AS share FROM est", raters=True)
def i11_i16_i25_i32_stratified_estimate(spark, d):
    return S.stratified_estimate(_parts(spark, d), raters(spark, d).count())


@query(f"""WITH {STRATA}, three AS (SELECT * FROM m WHERE stratum IN ('rare', 'negative') AND id IN (SELECT id FROM raters WHERE lang = 'en')), ans AS (SELECT three.stratum, coalesce(r1 = 'good', false) AS g, coalesce(r2 = 'good', false) AS p FROM three JOIN raters USING (id))
SELECT 'good' AS question, round((count_if(stratum = 'rare' AND g) + count_if(stratum = 'negative' AND p))::DOUBLE, 6) AS value, round((count_if(stratum = 'rare' AND g) + count_if(stratum = 'negative' AND p))::DOUBLE, 6) AS lo, round((count_if(stratum = 'rare' AND g) + count_if(stratum = 'negative' AND p))::DOUBLE, 6) AS hi,
 CAST(count_if(stratum = 'rare' AND g) AS BIGINT) AS k, CAST(count_if(stratum = 'rare') AS BIGINT) AS n, CAST(count_if(stratum = 'negative' AND p) AS BIGINT) AS plug, round((count_if(stratum = 'rare' AND g) + count_if(stratum = 'negative' AND p))::DOUBLE / (SELECT count(*) FROM raters), 6) AS share FROM ans""", raters=True)
def i12_i13_i15_census_and_plug_in(spark, d):
    r, members = raters(spark, d), _members(spark, d).where("stratum IN ('rare', 'negative')")
    domain = r.where("lang = 'en'")
    census = members.where("stratum = 'rare'")
    parts = S.parts_table(members, census, r, {"good": F.col("r1") == "good"}, ["rare"], domain)
    inside = members.join(domain.select("id"), "id", "left_semi")
    return S.stratified_estimate(parts, r.count(), S.plugged_counts(inside, r, {"good": F.col("r2") == "good"}))


@query(f"WITH {DRAW}, k AS (SELECT count_if(r1 = 'good') AS k, count(*) AS n FROM dr JOIN raters USING (id) WHERE stratum = 'english'), c AS (SELECT count_if(lang = 'en') AS c FROM raters) SELECT round(k::DOUBLE / n * c, 6) AS value, round({_LOW} * c, 6) AS lo, round({_HIGH} * c, 6) AS hi FROM k, c", raters=True)
def i21_rate_times_count(spark, d):
    r = raters(spark, d)
    rate = _drawn(spark, d).where("stratum = 'english'").join(r, "id").agg(F.count(F.when(F.col("r1") == "good", 1)).alias("k"), F.count("*").alias("n"))
    return S.rate_times_count(rate, r.agg(F.count(F.when(F.col("lang") == "en", 1)).alias("count")))


@query(f"WITH {DRAW}, k AS (SELECT count_if(r1 = 'good') AS n, count_if(r1 = 'good' AND r3 = 'good') AS k FROM dr JOIN raters USING (id) WHERE stratum = 'positive') SELECT CAST(n AS BIGINT) AS n, CAST(k AS BIGINT) AS k, round(k::DOUBLE / n, 6) AS value, {_LO} AS lo, {_HI} AS hi FROM k", raters=True)
def i22_conditional_share(spark, d):
    return S.conditional_share(_drawn(spark, d).where("stratum = 'positive'").join(raters(spark, d), "id"), F.col("r1") == "good", F.col("r3") == "good")


@query("SELECT r1 AS reference, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM raters WHERE r3 = 'good' AND r1 IS NOT NULL GROUP BY 1", raters=True)
def i23_i26_movers(spark, d):
    return S.movers(raters(spark, d), "r3", "r1", "good")


_MODEL = "mo AS (SELECT 'good' AS question, count_if(r2 = 'good')::DOUBLE AS model FROM raters UNION ALL SELECT 'clean', count_if(r3 = 'good')::DOUBLE FROM raters)"
_SIDE = f"{PARTS}, {_MODEL}, side AS (SELECT question, model, value, lo, hi, model >= lo - 1e-9 AND model <= hi + 1e-9 AS inside FROM mo JOIN est USING (question))"


def _side(spark, d):
    r = raters(spark, d)
    model = r.agg(F.count(F.when(F.col("r2") == "good", 1)).cast("double").alias("good"), F.count(F.when(F.col("r3") == "good", 1)).cast("double").alias("clean"))
    model = model.withColumn("k", F.lit(1)).unpivot(["k"], ["good", "clean"], "question", "model").drop("k")
    return S.side_by_side(model, S.stratified_estimate(_parts(spark, d), 1))


@query(f"WITH {_SIDE} SELECT * FROM side", raters=True)
def i27_i28_side_by_side(spark, d):
    return _side(spark, d)


@query(f"""WITH {_SIDE}, v AS (SELECT 'quality' AS claim, count_if(inside) AS i, count(*) AS o FROM side) SELECT claim, CAST(i AS BIGINT) AS inside, o AS "of", CASE WHEN i = o THEN 'holds' WHEN i >= 1 THEN 'with correction' ELSE 'fails' END AS verdict FROM v""", raters=True)
def i29_verdicts(spark, d):
    return S.verdict(_side(spark, d).withColumn("claim", F.lit("quality")), enough=1)


@query("SELECT id, r1, r2, r3, coalesce(r1 = 'good', false) AS holds FROM raters WHERE prob >= 0.95", raters=True)
def i30_i31_census_cards(spark, d):
    return raters(spark, d).where("prob >= 0.95").select("id", "r1", "r2", "r3", F.coalesce(F.col("r1") == "good", F.lit(False)).alias("holds"))


@query("SELECT CAST(count_if(r1 IS NULL) AS BIGINT) AS unaudited, CAST(count_if(r1 = 'good' AND r2 = 'bad') AS BIGINT) AS contradicted FROM raters", raters=True)
def i33_limits(spark, d):
    return raters(spark, d).agg(F.count(F.when(F.col("r1").isNull(), 1)).alias("unaudited"), F.count(F.when((F.col("r1") == "good") & (F.col("r2") == "bad"), 1)).alias("contradicted"))
