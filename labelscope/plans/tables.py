"""Tables over items: distributions, cross-tables, slices, profiles (inventory E, parts of D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelscope.functions import columns as C
from labelscope.operators import rank as R
from labelscope.operators import tables as T
from labelscope.plans.binding import EVIDENCE, LANGS, posts, query
from labelscope.sources.shared import read_table


def _r(x: str) -> str:
    return f"round({x}, 6)"


@query(f"""
, x AS (SELECT evidence, count(*) AS n, sum(views) AS sv, sum(likes) AS sl, median(views) AS mv, median(likes) AS ml FROM posts WHERE lang = 'en' GROUP BY 1),
t AS (SELECT count(*) AS n, sum(views) AS v, sum(likes) AS l FROM posts WHERE lang = 'en'),
dom AS (SELECT DISTINCT event_type AS evidence FROM events UNION SELECT 'none')
SELECT dom.evidence, coalesce(x.n, 0) AS n, CAST(coalesce(sv, 0) AS BIGINT) AS sum_views, CAST(coalesce(sl, 0) AS BIGINT) AS sum_likes, coalesce(mv, 0)::DOUBLE AS median_views, coalesce(ml, 0)::DOUBLE AS median_likes,
 {_r('coalesce(x.n, 0)::DOUBLE / t.n')} AS share_n, {_r('coalesce(sv, 0)::DOUBLE / t.v')} AS share_views, {_r('coalesce(sl, 0)::DOUBLE / t.l')} AS share_likes
FROM dom LEFT JOIN x USING (evidence) CROSS JOIN t""".replace("\n, x", "WITH x", 1))
def e1_distribution(spark, d):
    domain = read_table(spark, d, "events").select(F.col("event_type").alias("evidence")).distinct().unionByName(spark.range(1).select(F.lit("none").alias("evidence")))
    return T.distribution(posts(spark, d).where("lang = 'en'"), "evidence", ["views", "likes"], domain)


@query(f"""
WITH x AS (SELECT family, count(*) AS n, CAST(sum(views) AS BIGINT) AS sum_views, CAST(sum(likes) AS BIGINT) AS sum_likes, median(views)::DOUBLE AS median_views, median(likes)::DOUBLE AS median_likes,
 {_r('quantile_cont(views, 0.9)')}::DOUBLE AS p90_views, CAST(count_if(evidence = 'purchase') AS BIGINT) AS n_bought, CAST(count_if(n_chars >= 200) AS BIGINT) AS n_long FROM posts GROUP BY 1),
t AS (SELECT count(*) AS n, sum(views) AS v, sum(likes) AS l FROM posts)
SELECT x.*, {_r('x.n::DOUBLE / t.n')} AS share_n, {_r('sum_views::DOUBLE / t.v')} AS share_views, {_r('sum_likes::DOUBLE / t.l')} AS share_likes,
 {_r('(sum_views::DOUBLE / t.v) / (x.n::DOUBLE / t.n)')} AS index FROM x CROSS JOIN t""")
def e2_family_table(spark, d):
    p = posts(spark, d).withColumns({"bought": F.col("evidence") == "purchase", "long": F.col("n_chars") >= 200})
    return T.family_table(p, "family", "views", "likes", ["bought", "long"])


@query("""
SELECT CASE WHEN grouping(evidence) = 1 THEN 'total' ELSE evidence END AS evidence, count(*) AS n, CAST(sum(views) AS BIGINT) AS sum_views, median(views)::DOUBLE AS median_views FROM posts GROUP BY ROLLUP (evidence)""")
def e3_total_row(spark, d):
    return T.with_total_row(posts(spark, d), "evidence", [F.count("*").alias("n"), F.sum("views").alias("sum_views")], medians=["views"])


@query("SELECT family, " + ", ".join(f"CAST(count_if(evidence = '{e}') AS BIGINT) AS {e}" for e in EVIDENCE) + " FROM posts GROUP BY 1")
def e4_crosstab(spark, d):
    return T.crosstab(posts(spark, d), "family", "evidence", EVIDENCE)


@query("SELECT evidence, " + ", ".join(f"CAST(count_if(lang = '{x}' AND {c}) AS BIGINT) AS {x}_{n}" for x in LANGS for c, n in (("likes >= 50", "liked"), ("likes < 50", "other"))) + ", count(*) AS total FROM posts GROUP BY 1")
def e5_crosstab_multi(spark, d):
    p = posts(spark, d).withColumn("cell", F.concat_ws("_", "lang", F.when(F.col("likes") >= 50, "liked").otherwise("other")))
    names = [f"{x}_{n}" for x in LANGS for n in ("liked", "other")]
    return T.crosstab(p, "evidence", "cell", names).withColumn("total", sum((F.col(n) for n in names[1:]), F.col(names[0])))


@query("SELECT family, " + ", ".join(_r(f"count_if(evidence = '{e}')::DOUBLE / count(*)") + f" AS {e}" for e in EVIDENCE) + " FROM posts GROUP BY 1")
def e6_row_share(spark, d):
    return T.row_share(T.crosstab(posts(spark, d), "family", "evidence", EVIDENCE), EVIDENCE)


@query("SELECT family, " + ", ".join(f"median(CASE WHEN lang = '{x}' THEN views END)::DOUBLE AS {x}" for x in LANGS) + " FROM posts GROUP BY 1")
def e7_pivot_median(spark, d):
    return T.pivot_median(posts(spark, d), "family", "lang", "views", LANGS)


_STATS = "count(*) AS n, CAST(sum(views) AS BIGINT) AS sum_views, CAST(sum(likes) AS BIGINT) AS sum_likes, median(views)::DOUBLE AS median_views, median(likes)::DOUBLE AS median_likes, " + f"{_r('count(*)::DOUBLE / (SELECT count(*) FROM posts)')} AS share_n, {_r('sum(views)::DOUBLE / (SELECT sum(views) FROM posts)')} AS share_views, {_r('sum(likes)::DOUBLE / (SELECT sum(likes) FROM posts)')} AS share_likes"


@query(f"SELECT CAST(day AS VARCHAR) AS day, {_STATS} FROM posts GROUP BY 1")
def e8_by_day(spark, d):
    return T.stats_by(posts(spark, d), F.col("day").cast("string"), "day", ["views", "likes"])


@query("SELECT CASE WHEN grouping(day) = 1 THEN 'total' ELSE CAST(day AS VARCHAR) END AS day, " + ", ".join(f"CAST(count_if(lang = '{x}') AS BIGINT) AS {x}" for x in LANGS) + " FROM posts GROUP BY ROLLUP (day)")
def e9_counts_by_day(spark, d):
    p = posts(spark, d).withColumn("day", F.col("day").cast("string"))
    return T.with_total_row(p, "day", [C.count_if(F.col("lang") == x).alias(x) for x in LANGS])


@query(f"""SELECT CAST(count_if(likes >= 50) AS BIGINT) AS n, count(*) AS n_all, {_r('count_if(likes >= 50)::DOUBLE / count(*)')} AS share_n,
 {_r('sum(CASE WHEN likes >= 50 THEN views ELSE 0 END)::DOUBLE / sum(views)')} AS share_views, {_r('sum(CASE WHEN likes >= 50 THEN likes ELSE 0 END)::DOUBLE / sum(likes)')} AS share_likes,
 CAST(count_if(likes >= 50 AND lang <> 'en') AS BIGINT) AS n_outside, {_r("count_if(likes >= 50 AND lang <> 'en')::DOUBLE / count(*)")} AS outside_of_all,
 {_r("count_if(likes >= 50 AND lang <> 'en')::DOUBLE / count_if(lang <> 'en')")} AS outside_of_outside FROM posts""")
def e10_slice_stats(spark, d):
    return T.slice_stats(posts(spark, d), F.col("likes") >= 50, ["views", "likes"], F.col("lang") != "en")


@query(f"""SELECT family, CAST(count_if(likes >= 50) AS BIGINT) AS n, {_r('count_if(likes >= 50)::DOUBLE / (SELECT count_if(likes >= 50) FROM posts)')} AS share_of_slice, {_r('count_if(likes >= 50)::DOUBLE / count(*)')} AS share_of_key FROM posts GROUP BY 1""")
def e11_slice_by_key(spark, d):
    return T.slice_by_key(posts(spark, d), "family", F.col("likes") >= 50)


@query(f"""SELECT {_r("avg((views < 1000)::INT)")} AS fast, {_r("avg((views < 1000 AND lang = 'en')::INT)")} AS fast_en, {_r("avg((evidence IN ('view', 'click'))::INT)")} AS seen FROM posts""")
def e12_e13_set_shares(spark, d):
    return T.set_shares(posts(spark, d), {"fast": F.col("views") < 1000, "fast_en": (F.col("views") < 1000) & (F.col("lang") == "en"), "seen": F.col("evidence").isin("view", "click")})


@query(f"""SELECT family, count(*) AS n, CAST(count_if(lang = 'en') AS BIGINT) AS n_en, CAST(count_if(likes >= 50) AS BIGINT) AS n_liked, {_r("count_if(lang = 'en')::DOUBLE / count(*)")} AS share_en, {_r('count_if(likes >= 50)::DOUBLE / count(*)')} AS share_liked FROM posts GROUP BY 1""")
def e14_e31_group_profile(spark, d):
    return T.group_profile(posts(spark, d), "family", {"en": F.col("lang") == "en", "liked": F.col("likes") >= 50})


@query(f"SELECT CASE WHEN lang IN ('en', 'de') THEN lang ELSE 'other' END AS language, {_STATS} FROM posts GROUP BY 1")
def e15_d17_value_profile(spark, d):
    return T.stats_by(posts(spark, d), C.top_or_other("lang", ["en", "de"]), "language", ["views", "likes"])


@query(f"""WITH g AS (SELECT * FROM posts WHERE lang <> 'en')
SELECT evidence, count(*) AS n, CAST(sum(views) AS BIGINT) AS sum_views, median(views)::DOUBLE AS median_views, arg_max(id, views * 1000000 - id) AS top_id,
 {_r('count(*)::DOUBLE / (SELECT count(*) FROM g)')} AS share_of_group, {_r('count(*)::DOUBLE / (SELECT count(*) FROM posts)')} AS share_of_all FROM g GROUP BY 1""")
def e16_e17_group_rows(spark, d):
    return T.group_rows(posts(spark, d), "evidence", "views", "id", F.col("lang") != "en")


_VERSIONS = "a AS (SELECT id, lang, evidence FROM posts WHERE id % 3 <> 0), b AS (SELECT id, CASE WHEN likes >= 90 THEN 'en' ELSE lang END AS lang, evidence FROM posts WHERE id % 4 <> 0)"


def _versions(spark, d):
    p = posts(spark, d)
    second = p.where("id % 4 <> 0").withColumn("lang", F.when(F.col("likes") >= 90, "en").otherwise(F.col("lang")))
    return p.where("id % 3 <> 0").select("id", "lang", "evidence"), second.select("id", "lang", "evidence")


@query(f"""WITH {_VERSIONS}, la AS (SELECT 'lang' AS field, lang AS value FROM a UNION ALL SELECT 'evidence', evidence FROM a), lb AS (SELECT 'lang' AS field, lang AS value FROM b UNION ALL SELECT 'evidence', evidence FROM b),
sa AS (SELECT field, value, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY field) AS s FROM la GROUP BY 1, 2), sb AS (SELECT field, value, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY field) AS s FROM lb GROUP BY 1, 2)
SELECT field, value, {_r('coalesce(sa.s, 0)')} AS share_a, {_r('coalesce(sb.s, 0)')} AS share_b FROM sa FULL JOIN sb USING (field, value)""")
def e19_label_shift(spark, d):
    return T.label_shift(*_versions(spark, d), "id", ["lang", "evidence"])


@query(f"""WITH {_VERSIONS} SELECT unnest(['lang', 'evidence']) AS field, unnest([count(*), count(*)]) AS n, unnest([{_r('avg((a.lang = b.lang)::INT)')}, {_r('avg((a.evidence = b.evidence)::INT)')}]) AS unchanged FROM a JOIN b USING (id)""")
def e20_h19_unchanged_share(spark, d):
    return T.unchanged_share(*_versions(spark, d), "id", ["lang", "evidence"])


@query(f"""WITH c AS (SELECT family, lang, count(*) AS n FROM posts GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY n DESC, lang) AS rank, sum(n) OVER (PARTITION BY family) AS t FROM c)
SELECT family, lang, n, CAST(rank AS INT) AS rank, {_r('n::DOUBLE / t')} AS share FROM r WHERE rank <= 3""")
def e21_crosswalk_top(spark, d):
    return T.crosswalk_top(posts(spark, d), "family", "lang", 3)


_LONG = "l AS (SELECT id, claim, CAST(claim AS DOUBLE) AS value FROM (SELECT id, unnest(chips) AS claim FROM posts))"


@query(f"WITH {_LONG} SELECT id, claim, value FROM l")
def e23_claim_long(spark, d):
    return T.claim_long(posts(spark, d), "id", "chips")


@query(f"""WITH {_LONG} SELECT count(*) AS claims, count(DISTINCT id) AS items, {_r('quantile_cont(value, 0.25)')} AS p25, {_r('median(value)')} AS median, {_r('quantile_cont(value, 0.75)')} AS p75,
 {_r('median(CASE WHEN value <> 1 THEN value END)')} AS median_without_one, min(value) AS least, max(value) AS most FROM l""")
def e22_claim_multiples(spark, d):
    return T.claim_multiples(T.claim_long(posts(spark, d), "id", "chips"))


@query(f"""WITH {_LONG}, k AS (SELECT *, unnest(list_filter(['whole', 'long'], lambda z: CASE z WHEN 'whole' THEN NOT contains(claim, '.') ELSE len(claim) >= 4 END)) AS kind FROM l)
SELECT kind, count(*) AS claims, count(DISTINCT id) AS items, {_r('quantile_cont(value, 0.25)')} AS p25, {_r('median(value)')} AS median, {_r('quantile_cont(value, 0.75)')} AS p75, min(value) AS least, max(value) AS most FROM k GROUP BY 1""")
def e25_claim_kinds(spark, d):
    return T.claim_kinds(T.claim_long(posts(spark, d), "id", "chips"), {"whole": r"^[0-9]+$", "long": r"^.{4,}$"})


_EDGES = T.log_edges(0, 5)


@query("WITH e AS (SELECT views, CASE " + " ".join(f"WHEN views >= {a} AND views < {b} THEN {i}" for i, (a, b) in enumerate(zip(_EDGES, _EDGES[1:], strict=False))) + " END AS bin FROM posts) SELECT bin, views = 1 AS is_one, count(*) AS n FROM e WHERE bin IS NOT NULL GROUP BY 1, 2")
def e24_log_histogram(spark, d):
    return T.log_histogram(posts(spark, d), "views", _EDGES)


@query(f"""SELECT event_type AS model, count(*) AS calls, CAST(sum(event_id % 1000) AS BIGINT) AS input, CAST(sum(user_id) AS BIGINT) AS output,
 {_r("(sum(event_id % 1000) * CASE event_type WHEN 'view' THEN 3.0 ELSE 1.5 END + sum(user_id) * CASE event_type WHEN 'view' THEN 15.0 ELSE 6.0 END)::DOUBLE / 1e6")} AS list_cost, {_r('sum(CASE WHEN event_id % 7 <> 0 THEN CAST(round(value, 2) AS DECIMAL(18, 2)) END)::DOUBLE')} AS reported FROM events GROUP BY 1""", posts=False)
def e26_usage_cost(spark, d):
    usage = read_table(spark, d, "events").select(F.col("event_type").alias("model"), (F.col("event_id") % 1000).alias("input"), F.col("user_id").alias("output"), F.when(F.col("event_id") % 7 != 0, F.round("value", 2).cast("decimal(18,2)").cast("string")).otherwise("free").alias("reported"))
    prices = usage.select("model").distinct().withColumns({"input_price": F.when(F.col("model") == "view", 3.0).otherwise(1.5), "output_price": F.when(F.col("model") == "view", 15.0).otherwise(6.0)})
    return T.usage_cost(usage, prices, "model", ["input", "output"])


_DAILY = "s AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type AS key, count(*) AS requests, CAST(sum(user_id) AS BIGINT) AS prompt FROM events GROUP BY 1, 2)"


def _daily(spark, d):
    return read_table(spark, d, "events").groupBy(F.col("ts").cast("date").cast("string").alias("day"), F.col("event_type").alias("key")).agg(F.count("*").alias("requests"), F.sum("user_id").alias("prompt"))


@query(f"""WITH {_DAILY}, p AS (SELECT * FROM (VALUES ('small', 1.0, 3.0), ('large', 5.0, 15.0)) p(model, prompt_price, completion_price))
SELECT day, key, requests, prompt, model, prompt_price::DOUBLE AS prompt_price, completion_price::DOUBLE AS completion_price, {_r('(prompt * prompt_price + requests * 10 * completion_price)::DOUBLE / 1e6')} AS usd FROM s CROSS JOIN p""", posts=False)
def e27_c12_what_if_price(spark, d):
    prices = spark.createDataFrame([("small", 1.0, 3.0), ("large", 5.0, 15.0)], "model string, prompt_price double, completion_price double")
    return T.what_if_price(_daily(spark, d), prices, "prompt", "requests")


@query(f"""WITH {_DAILY} SELECT s.day, s.key, s.prompt, {_r('s.prompt::DOUBLE / b.prompt')} AS ratio FROM s LEFT JOIN s b ON b.day = s.day AND b.key = 'view' WHERE s.day BETWEEN '2024-01-02' AND '2024-01-09'""", posts=False)
def e28_series_ratio(spark, d):
    return T.series_ratio(_daily(spark, d), "day", "key", "prompt", "view", "2024-01-02", "2024-01-09")


@query(f"""SELECT evidence AS evidence, count(*) AS n, {_r('median(views::DOUBLE / likes)')} AS median, {_r('min(views::DOUBLE / likes)')} AS least, {_r('max(views::DOUBLE / likes)')} AS most FROM posts WHERE likes > 0 AND lang <> 'fr' GROUP BY 1""")
def e29_ratio_summary(spark, d):
    return T.ratio_summary(posts(spark, d), "evidence", "likes", "views", F.col("lang") == "fr")


@query(f"""SELECT family, lang, count(*) AS n, {_r('count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY family)')} AS row_share, {_r('count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY lang)')} AS column_share FROM posts GROUP BY 1, 2""")
def e30_grid(spark, d):
    return T.grid(posts(spark, d), "family", "lang")


_BAND = "CASE WHEN views < 500 THEN 'low' WHEN views < 1500 THEN 'middle' WHEN views < 5000 THEN 'high' ELSE 'top' END"


@query(f"""WITH p AS (SELECT *, {_BAND} AS band FROM posts), c AS (SELECT 'all' AS cut, * FROM p UNION ALL SELECT 'liked', * FROM p WHERE likes >= 50 UNION ALL SELECT 'en', * FROM p WHERE lang = 'en' UNION ALL SELECT 'claims', * FROM p WHERE chips IS NOT NULL),
f AS (SELECT cut, evidence, band, family, count(*) AS n FROM c GROUP BY 1, 2, 3, 4), r AS (SELECT *, row_number() OVER (PARTITION BY cut, evidence, band ORDER BY n DESC, family) AS k FROM f),
x AS (SELECT cut, evidence, band, sum(n) AS n, max(CASE WHEN k = 1 THEN family END) AS first, max(CASE WHEN k = 1 THEN n END) AS n_first, max(CASE WHEN k = 2 THEN family END) AS second, max(CASE WHEN k = 2 THEN n END) AS n_second FROM r GROUP BY 1, 2, 3)
SELECT cut, evidence, band, CAST(n AS BIGINT) AS n, {_r('n::DOUBLE / sum(n) OVER (PARTITION BY cut, evidence)')} AS row_share, {_r('n::DOUBLE / sum(n) OVER (PARTITION BY cut, band)')} AS column_share, first, n_first, second, n_second FROM x""")
def e30_grid_cuts(spark, d):
    v = F.col("views")
    p = posts(spark, d).withColumn("band", F.when(v < 500, "low").when(v < 1500, "middle").when(v < 5000, "high").otherwise("top"))
    cuts = {"all": F.lit(True), "liked": F.col("likes") >= 50, "en": F.col("lang") == "en", "claims": F.col("chips").isNotNull()}
    out = T.grid_cuts(p, "evidence", "band", "family", cuts)
    of = lambda i, name: F.get("top", F.lit(i))[name]
    return out.select("cut", "evidence", "band", "n", "row_share", "column_share", of(0, "item").alias("first"), of(0, "n").alias("n_first"), of(1, "item").alias("second"), of(1, "n").alias("n_second"))


@query(f"""WITH x AS (SELECT evidence, avg(views) AS a, median(views) AS m FROM posts WHERE evidence IN ('view', 'click') GROUP BY 1)
SELECT {_r('t.a')} AS mean_top, t.m::DOUBLE AS median_top, {_r('b.a')} AS mean_base, b.m::DOUBLE AS median_base, {_r('t.a / b.a')} AS mean_ratio, {_r('t.m / b.m')} AS median_ratio FROM x t, x b WHERE t.evidence = 'view' AND b.evidence = 'click'""")
def e32_mean_vs_median(spark, d):
    return T.mean_vs_median(posts(spark, d), "evidence", "views", "view", "click")


_BUCKET = "CASE WHEN evidence = 'purchase' AND likes >= 50 THEN 'proof' WHEN evidence IN ('purchase', 'signup') THEN 'claim' WHEN lang = 'en' THEN 'talk' ELSE 'not_covered' END"


def _bucket():
    e = F.col("evidence")
    return C.rule_cascade([((e == "purchase") & (F.col("likes") >= 50), "proof"), (e.isin("purchase", "signup"), "claim"), (F.col("lang") == "en", "talk")], "not_covered")


@query(f"""SELECT {_BUCKET} AS bucket, count(*) AS n, CAST(sum(views) AS BIGINT) AS sum_views, CAST(sum(likes) AS BIGINT) AS sum_likes, CAST(count_if(n_chars >= 200) AS BIGINT) AS n_second,
 {_r('count(*)::DOUBLE / (SELECT count(*) FROM posts)')} AS share_n, {_r('sum(views)::DOUBLE / (SELECT sum(views) FROM posts)')} AS share_views, {_r('sum(likes)::DOUBLE / (SELECT sum(likes) FROM posts)')} AS share_likes,
 {_r('count_if(n_chars >= 200)::DOUBLE / (SELECT count_if(n_chars >= 200) FROM posts)')} AS share_second FROM posts GROUP BY 1""")
def e33_d5_d8_bucket_table(spark, d):
    return T.bucket_table(posts(spark, d), _bucket(), ["views", "likes"], F.col("n_chars") >= 200)


@query(f"""SELECT count(*) AS n, CAST(count_if(evidence = 'purchase' AND NOT (likes >= 80)) AS BIGINT) AS only_bought, CAST(count_if(likes >= 80 AND NOT (evidence = 'purchase')) AS BIGINT) AS only_liked FROM posts WHERE {_BUCKET} = 'claim'""")
def e34_bucket_explain(spark, d):
    return T.bucket_explain(posts(spark, d), _bucket(), "claim", {"bought": F.col("evidence") == "purchase", "liked": F.col("likes") >= 80})


@query("SELECT evidence, count(*) AS n, count(DISTINCT url) AS units FROM posts GROUP BY 1")
def e35_tally(spark, d):
    return T.tally(posts(spark, d), "evidence", "url")


@query(f"""SELECT role, median(len)::DOUBLE AS median_length, {_r('sum(len)::DOUBLE / 60')} AS minutes, count(*) AS n FROM (SELECT role, length(text) AS len FROM conversations) GROUP BY 1""", posts=False)
def e36_time_by_group(spark, d):
    c = read_table(spark, d, "conversations").withColumn("len", F.length("text"))
    return R.with_percentiles(c.groupBy("role").agg((F.sum("len") / 60.0).alias("minutes"), F.count("*").alias("n")), c, ["role"], {"median_length": ("len", 0.5)})


@query(f"""SELECT {_r("count_if(day <= DATE '2024-01-03')::DOUBLE / count(*)")} AS share_n, {_r("sum(CASE WHEN day <= DATE '2024-01-03' THEN views ELSE 0 END)::DOUBLE / sum(views)")} AS share_views, {_r("sum(CASE WHEN day <= DATE '2024-01-03' THEN likes ELSE 0 END)::DOUBLE / sum(likes)")} AS share_likes FROM posts""")
def e37_share_before(spark, d):
    return T.share_before(posts(spark, d), "day", "2024-01-03", ["views", "likes"])


@query(f"SELECT {_BUCKET} AS bucket, " + ", ".join(f"CAST(count_if(lang = '{x}') AS BIGINT) AS {x}" for x in LANGS) + " FROM posts WHERE likes >= 20 AND evidence <> 'error' GROUP BY 1")
def e39_e40_slice_segments(spark, d):
    flagged = posts(spark, d).where((F.col("likes") >= 20) & (F.col("evidence") != "error")).withColumn("bucket", _bucket())
    return T.crosstab(flagged, "bucket", "lang", LANGS)
