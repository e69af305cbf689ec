"""Ranking and concentration over items (inventory F), and orders' prices as a larger value column."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelscope.functions import columns as C
from labelscope.operators import rank as R
from labelscope.plans.binding import posts, query
from labelscope.sources.shared import read_table


@query("SELECT id, views, CAST(row_number() OVER (ORDER BY views DESC, id) AS INT) AS rank FROM posts ORDER BY views DESC, id LIMIT 25")
def f1_top_k(spark, d):
    return R.top_k(posts(spark, d).select("id", "views"), "views", "id", 25)


_RANKED = "r AS (SELECT id, views, row_number() OVER (ORDER BY views DESC, id) AS rank, sum(views) OVER (ORDER BY views DESC, id ROWS UNBOUNDED PRECEDING) AS cum, count(*) OVER () AS n, sum(views) OVER () AS t FROM posts)"


@query(f"""WITH {_RANKED}, p AS (SELECT unnest([0.1, 1.0, 5.0, 10.0, 25.0, 50.0])::DOUBLE AS percent), k AS (SELECT percent, greatest(1, CAST(ceil((SELECT any_value(n) FROM r) * percent / 100) AS BIGINT)) AS k FROM p)
SELECT percent, k, CAST(cum AS BIGINT) AS mass, round(cum::DOUBLE / t, 6) AS share, views AS least FROM k JOIN r ON r.rank = k.k""")
def f2_concentration(spark, d):
    return R.concentration(posts(spark, d), "views", [0.1, 1.0, 5.0, 10.0, 25.0, 50.0])


@query("""WITH r AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank, count(*) OVER () AS n FROM orders)
SELECT n, round(sum(v), 2) AS mass, round((sum((2 * (n + 1 - rank) - n - 1) * v)) / (n * sum(v)), 6) AS gini FROM r GROUP BY n""", posts=False)
def f3_gini(spark, d):
    return R.gini(read_table(spark, d, "orders"), "o_totalprice").withColumn("mass", F.round("mass", 2))


@query(f"WITH {_RANKED} SELECT round(cum::DOUBLE / t, 6) AS share FROM r WHERE rank = CAST(ceil(n * 10.0 / 100) AS BIGINT)")
def f4_top_share(spark, d):
    return R.top_share(posts(spark, d), "views", 10.0)


@query(f"WITH {_RANKED} SELECT rank, views, round(cum::DOUBLE / t, 6) AS share FROM r WHERE (rank - 1) % greatest(1, n // 100) = 0")
def f5_lorenz(spark, d):
    return R.lorenz(posts(spark, d), "views", "id", 100)


@query(f"WITH {_RANKED} SELECT min(rank) AS items FROM r WHERE cum >= t * 0.5")
def f6_items_holding(spark, d):
    return R.items_holding(posts(spark, d), "views", 0.5)


@query("""WITH v AS (SELECT 'all' AS variant, id, views FROM posts UNION ALL SELECT 'without_top', id, views FROM posts WHERE id <> (SELECT arg_max(id, views * 1000000 - id) FROM posts)
  UNION ALL SELECT 'without_suspects', id, views FROM posts WHERE NOT (views >= 5000 AND likes::DOUBLE / views < 0.002)),
r AS (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY views DESC, id) AS rank, count(*) OVER (PARTITION BY variant) AS n FROM v)
SELECT variant, n, CAST(sum(views) AS BIGINT) AS mass, round(sum((2 * (n + 1 - rank) - n - 1) * views)::DOUBLE / (n * sum(views)), 6) AS gini FROM r GROUP BY variant, n""")
def f7_d13_concentration_sensitivity(spark, d):
    p = posts(spark, d).select("id", "views", "likes")
    top = R.top_k(p, "views", "id", 1).select(F.col("id").alias("_top"))
    tagged = p.crossJoin(F.broadcast(top)).withColumn("variant", F.explode(F.filter(F.array(F.lit("all"), F.when(F.col("id") != F.col("_top"), "without_top"), F.when(~C.suspect("likes", "views", 5000), "without_suspects")), lambda x: x.isNotNull())))
    return R.gini(tagged, "views", ["variant"])


@query("""WITH r AS (SELECT id, likes, row_number() OVER (ORDER BY likes, id) AS r, count(*) OVER () AS n FROM posts)
SELECT id, likes, CAST(greatest(1, ceil((r - 1) * 10.0::DOUBLE / (n - 1))) AS BIGINT) AS bin FROM r""")
def f8_equal_count_bins(spark, d):
    return R.equal_count_bins(posts(spark, d).select("id", "likes"), "likes", "id", 10)


@query("SELECT family, evidence, count(*) AS n FROM posts GROUP BY 1, 2 ORDER BY n DESC, family, evidence LIMIT 5")
def f9_most_common(spark, d):
    return R.most_common(posts(spark, d), ["family", "evidence"], 5)


@query("SELECT evidence, round(quantile_cont(views, 0.25), 6)::DOUBLE AS p25, round(quantile_cont(views, 0.95), 6)::DOUBLE AS p95, quantile_disc(views, 0.5)::DOUBLE AS near50, quantile_disc(views, 0.95)::DOUBLE AS near95, median(views)::DOUBLE AS median FROM posts GROUP BY 1")
def f11_f13_percentiles(spark, d):
    wanted = {"p25": ("views", 0.25), "p95": ("views", 0.95), "near50": ("views", 0.5, "nearest"), "near95": ("views", 0.95, "nearest"), "median": ("views", 0.5)}
    return R.grouped_percentiles(posts(spark, d), ["evidence"], wanted)


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem)
SELECT rank, l_orderkey, l_linenumber FROM r""", posts=False)
def f_global_rank_lineitem(spark, d):
    ranked = R.global_rank(read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")])
    return ranked.select("rank", "l_orderkey", "l_linenumber")


@query("""SELECT p::DOUBLE AS p, round(CASE p WHEN 0.25 THEN quantile_cont(l_extendedprice, 0.25) WHEN 0.5 THEN quantile_cont(l_extendedprice, 0.5) ELSE quantile_cont(l_extendedprice, 0.99) END, 6) AS linear,
 round(CASE p WHEN 0.25 THEN quantile_disc(l_extendedprice, 0.25) WHEN 0.5 THEN quantile_disc(l_extendedprice, 0.5) ELSE quantile_disc(l_extendedprice, 0.99) END, 6) AS nearest FROM lineitem, (SELECT unnest([0.25, 0.5, 0.99]) AS p) GROUP BY p""", posts=False)
def f11_f12_percentiles_lineitem(spark, d):
    return R.percentiles(read_table(spark, d, "lineitem"), "l_extendedprice", [0.25, 0.5, 0.99])
