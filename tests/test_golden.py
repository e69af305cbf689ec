"""Operators against published tables: inputs and answers that were computed elsewhere (fixed values)."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelscope.operators import agreement as A
from labelscope.operators import tables as T

# A published confusion of 14 classes, the reference by rows and the answers by columns.
CONFUSION = """
251 21 19 6 1 4 2 0 0 7 2 6 1 46
4 671 5 24 1 9 9 0 14 2 2 4 3 33
5 14 202 4 2 0 6 0 14 0 2 2 0 6
4 13 6 209 0 2 4 0 0 1 2 1 2 18
1 7 0 8 65 2 0 0 1 0 0 0 0 3
17 40 2 3 3 346 14 1 3 4 5 11 3 66
1 1 0 1 0 1 246 0 0 1 2 0 0 3
3 7 0 3 0 4 13 31 1 2 3 0 0 5
3 5 12 3 0 0 1 1 33 4 3 0 3 0
2 2 2 0 0 4 3 0 0 50 0 1 0 2
8 4 4 7 0 1 5 1 2 0 974 0 2 64
10 63 2 0 0 8 2 0 3 1 1 146 2 33
3 8 0 1 0 1 0 0 1 0 2 0 246 8
31 87 16 66 2 14 37 9 7 16 95 11 16 1196
"""
# For each class its rows, answers, hits, precision, recall and F1.
MEASURES = {
    14: (1603, 1483, 1196, 0.8064733648010789, 0.7461010605115409, 0.7751134154244979),
    11: (1072, 1093, 974, 0.8911253430924062, 0.9085820895522388, 0.8997690531177829),
    2: (781, 943, 671, 0.711558854718982, 0.8591549295774648, 0.7784222737819025),
    6: (518, 396, 346, 0.8737373737373737, 0.667953667953668, 0.7571115973741794),
    1: (366, 343, 251, 0.7317784256559767, 0.6857923497267759, 0.7080394922425952),
    12: (271, 182, 146, 0.8021978021978022, 0.5387453874538746, 0.6445916114790288),
    13: (270, 278, 246, 0.8848920863309353, 0.9111111111111111, 0.8978102189781022),
    4: (262, 335, 209, 0.6238805970149254, 0.7977099236641222, 0.7001675041876047),
    3: (257, 270, 202, 0.7481481481481481, 0.7859922178988327, 0.7666034155597723),
    7: (256, 342, 246, 0.7192982456140351, 0.9609375, 0.822742474916388),
    5: (87, 74, 65, 0.8783783783783784, 0.7471264367816092, 0.8074534161490683),
    8: (72, 43, 31, 0.7209302325581395, 0.4305555555555556, 0.5391304347826087),
    9: (68, 79, 33, 0.4177215189873418, 0.4852941176470588, 0.4489795918367347),
    10: (66, 88, 50, 0.5681818181818182, 0.7575757575757576, 0.6493506493506495),
}
# By class posts, views and likes, and the published shares of each and the index of views.
SHARES = [
    (1254, 6315106, 43277, 0.22412868632707775, 0.14167364535067092, 0.1431780586250248, 0.632108489423448),
    (1071, 5456819, 38147, 0.19142091152815013, 0.12241875904360161, 0.12620591543704096, 0.6395265703538291),
    (781, 7970126, 40030, 0.13958891867739054, 0.17880251009629317, 0.1324356514259247, 1.2809219513300387),
    (518, 3612523, 25932, 0.09258266309204646, 0.08104365980921648, 0.08579368755376167, 0.875365398904568),
    (366, 1819649, 13304, 0.06541554959785523, 0.04082216626113687, 0.04401508634950043, 0.6240437711231169),
    (271, 1782461, 13250, 0.0484361036639857, 0.039987887387068766, 0.043836432210679545, 0.82558018424594),
    (268, 3312164, 25505, 0.047899910634495085, 0.07430537949470042, 0.08438099649308542, 1.551263426391227),
    (262, 2293282, 15474, 0.046827524575513854, 0.0514476907841416, 0.05119433600211738, 1.0986634730430238),
    (257, 998073, 12694, 0.045933869526362824, 0.022390857768037495, 0.04199695626282009, 0.48745855724579684),
    (254, 5902564, 39867, 0.04539767649687221, 0.13241864171332005, 0.1318963805994839, 2.9168594503386838),
    (87, 1595954, 12570, 0.015549597855227882, 0.03580377288868701, 0.041586713425527694, 2.302552980600044),
    (72, 1629760, 10197, 0.012868632707774798, 0.03656217967627297, 0.033735856547343346, 2.8411860456770452),
    (68, 502332, 3625, 0.012153708668453977, 0.011269360421866749, 0.01199298617084629, 0.9272363464756538),
    (66, 1384210, 8388, 0.011796246648793566, 0.031053489304985887, 0.027750942896843777, 2.6324889797181217),
]


def test_published_precision_and_recall(spark):
    cells = [(i, j, int(n)) for i, row in enumerate(CONFUSION.split("\n")[1:-1], 1) for j, n in enumerate(row.split(), 1)]
    found = {r.value: r for r in A.prf(spark.createDataFrame(cells, "a long, b long, n long")).collect()}
    assert set(found) == set(MEASURES)
    for value, (support, predicted, hits, precision, recall, f1) in MEASURES.items():
        r = found[value]
        assert (r.support, r.predicted, r.hits) == (support, predicted, hits)
        assert abs(r.precision - precision) < 1e-12 and abs(r.recall - recall) < 1e-12 and abs(r.f1 - f1) < 1e-12
    assert found[14].top_other == 11 and found[11].top_other == 14 and found[2].top_other == 14  # as published


def test_published_shares_and_index(spark):
    table = spark.createDataFrame([(i, *row[:3]) for i, row in enumerate(SHARES)], "k long, n long, sum_views long, sum_likes long")
    totals = table.agg(F.sum("n").alias("n_all"), F.sum("sum_views").alias("views_all"), F.sum("sum_likes").alias("likes_all"))
    out = T.with_shares(table, totals, ["views", "likes"]).withColumn("index", T.ratio("share_views", "share_n"))
    for r in out.collect():
        want = SHARES[r.k]
        assert all(abs(a - b) < 1e-12 for a, b in zip((r.share_n, r.share_views, r.share_likes, r["index"]), want[3:], strict=True))
