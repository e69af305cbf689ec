"""Audit design: strata, seeded draws that do not depend on partitioning, and estimates from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelscope.functions.columns import count_if, ratio, wilson
from labelscope.operators.rank import global_rank


def strata(base: DataFrame, id_col: str, predicates: dict[str, Column]) -> DataFrame:
    """(stratum, id): overlapping strata; an item is in every stratum whose predicate holds."""
    tags = F.filter(F.array(*(F.when(c, F.lit(k)) for k, c in predicates.items())), lambda t: t.isNotNull())
    return base.select(F.explode(tags).alias("stratum"), F.col(id_col).alias("id"))


def populations(members: DataFrame) -> DataFrame:
    return members.groupBy("stratum").agg(F.count("*").alias("population"))


def draw_order(seed: str, stratum: Column, id_: Column) -> Column:
    """The md5 of seed, stratum and id; the smallest are drawn."""
    return F.md5(F.concat_ws(":", F.lit(seed), stratum, id_.cast("string")))


#: A stratum's rows whose md5 lies under this multiple of the wanted share are ranked.
MARGIN = 4.0


def sample_per_stratum(members: DataFrame, n: dict[str, int], seed: str) -> DataFrame:
    """(stratum, id, place): the n items of each named stratum with the smallest md5; all, if there are fewer.

    Only rows under a threshold of the md5 are ranked, a few times n whatever the population.
    The threshold is lifted for small strata, where nothing needs to be saved.
    """
    wanted = F.create_map(*(x for k, v in n.items() for x in (F.lit(k), F.lit(v))))
    asked = members.where(F.col("stratum").isin(*n)).withColumn("_md5", draw_order(seed, F.col("stratum"), F.col("id")))
    sizes = populations(asked).withColumn("_share", F.least(F.lit(1.0), (wanted[F.col("stratum")] + 50) * MARGIN / F.col("population")))
    near = asked.join(F.broadcast(sizes), "stratum").where(F.conv(F.substring("_md5", 1, 8), 16, 10).cast("bigint") < F.col("_share") * 4294967296.0)
    place = F.row_number().over(Window.partitionBy("stratum").orderBy("_md5", "id"))
    return near.withColumn("place", place).where(F.col("place") <= wanted[F.col("stratum")]).select("stratum", "id", "place")


def sequential_draws(members: DataFrame, plan: Sequence[tuple[str, int]], seed: str) -> DataFrame:
    """(stratum, id, place): strata drawn in order, each from what the earlier ones left, so no id comes twice."""
    drawn: DataFrame | None = None
    for stratum, n in plan:
        left = members.where(F.col("stratum") == stratum)
        if drawn is not None:
            left = left.join(drawn.select("id"), "id", "left_anti")
        step = sample_per_stratum(left.select("stratum", "id"), {stratum: n}, seed)
        drawn = step if drawn is None else drawn.unionByName(step)
    return drawn


def membership(members: DataFrame, drawn: DataFrame) -> DataFrame:
    """(id, strata): all strata of each drawn item, in order."""
    return members.join(drawn.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.sort_array(F.collect_set("stratum")).alias("strata"))


def label_batches(census: DataFrame, sampled: DataFrame, size: int = 40) -> DataFrame:
    """(id, batch): census items first, then the sampled, each by id, in batches. A census of any size is ranked by ranges."""
    both = census.select("id", F.lit(0).alias("_b")).unionByName(sampled.select("id", F.lit(1).alias("_b"))).groupBy("id").agg(F.min("_b").alias("_b"))
    return global_rank(both, [F.col("_b"), F.col("id")], "_r").select("id", F.floor((F.col("_r") - 1) / size).alias("batch"))


def shuffled_blocks(drawn: DataFrame, block: Column, seed: str) -> DataFrame:
    """(id, position): blocks in order, each shuffled by md5, then by id; ranked by ranges."""
    keyed = drawn.select("id", block.alias("_b"), draw_order(seed, F.lit("order"), F.col("id")).alias("_o"))
    return global_rank(keyed, [F.col("_b"), F.col("_o"), F.col("id")], "position").select("id", F.col("position").cast("int").alias("position"))


def design_check(expected: DataFrame, members: DataFrame, drawn: DataFrame) -> DataFrame:
    """(stratum, expected, population, outside): strata whose population moved or whose sample left it."""
    now = populations(members)
    outside = drawn.join(members, ["stratum", "id"], "left_anti").groupBy("stratum").agg(F.count("*").alias("outside"))
    met = expected.join(now, "stratum", "full").join(outside, "stratum", "left").na.fill(0, ["population", "outside"])
    return met.where((F.coalesce("expected", F.lit(-1)) != F.col("population")) | (F.col("outside") > 0)).select("stratum", "expected", "population", "outside")


def inclusion_probability(members: DataFrame, n: dict[str, int], census: Sequence[str] = ()) -> DataFrame:
    """(id, pi): 1 in a census stratum, else 1 - prod(1 - n_h / N_h) over the sampled strata that hold the item."""
    wanted = F.create_map(*(x for k, v in n.items() for x in (F.lit(k), F.lit(float(v)))))
    sizes = populations(members)
    each = members.join(sizes, "stratum")
    rate = F.when(F.col("stratum").isin(*census), F.lit(1.0)).otherwise(F.coalesce(F.least(F.lit(1.0), F.try_divide(wanted[F.col("stratum")], F.col("population").cast("double"))), F.lit(0.0)))
    by = each.groupBy("id").agg(F.collect_list(rate).alias("_f"))
    return by.select("id", (1.0 - F.aggregate(F.sort_array("_f"), F.lit(1.0), lambda m, f: m * (1.0 - f))).alias("pi"))


def scaled(k: str, n: str, population: str) -> dict[str, Column]:
    """A sampled count with its Wilson interval, scaled to the population."""
    w = wilson(k, n)
    return {"value": w["p"] * F.col(population), "lo": w["lo"] * F.col(population), "hi": w["hi"] * F.col(population)}


def parts_table(members: DataFrame, drawn: DataFrame, reference: DataFrame, questions: dict[str, Column], census: Sequence[str] = (), domain: DataFrame | None = None) -> DataFrame:
    """(question, stratum, population, n, k, is_census): for each question the audited items of a stratum that hold it.

    ``reference`` has one row per item with the audited labels; ``domain`` cuts strata and
    samples to a base. This is the one table that all estimates are sums of.
    """
    if domain is not None:
        members, drawn = (x.join(domain.select("id"), "id", "left_semi") for x in (members, drawn))
    names = [F.struct(F.lit(q).alias("question"), F.coalesce(c, F.lit(False)).alias("holds")) for q, c in questions.items()]
    answers = reference.select("id", F.explode(F.array(*names)).alias("a")).select("id", "a.question", "a.holds")
    audited = drawn.join(answers, "id").groupBy("question", "stratum").agg(F.count("*").alias("n"), count_if(F.col("holds")).alias("k"))
    all_ = populations(members).crossJoin(members.sparkSession.createDataFrame([(q,) for q in questions], "question string"))
    return all_.join(audited, ["question", "stratum"], "left").na.fill(0, ["n", "k"]).withColumn("is_census", F.col("stratum").isin(*census))


def stratified_estimate(parts: DataFrame, base: int | Column, plug: DataFrame | None = None) -> DataFrame:
    """(question, value, lo, hi, k, n, plug, share): sums over disjoint parts.

    A census part adds its count; a sampled one its scaled share and bounds, which are added up
    and so are wider than a joint interval. A part without audited items falls back to the
    plugged-in count of the labels under test, if there is one.
    """
    each = parts if plug is None else parts.join(plug, ["question", "stratum"], "left")
    each = each if plug is not None else each.withColumn("plugged", F.lit(None).cast("bigint"))
    s = scaled("k", "n", "population")
    fallback = F.coalesce("plugged", F.lit(0)).cast("double")
    value = {x: F.when(F.col("is_census"), F.col("k").cast("double")).when(F.col("n") == 0, fallback).otherwise(c) for x, c in s.items()}
    by = each.groupBy("question").agg(*(F.sum(c).alias(x) for x, c in value.items()), F.sum("k").alias("k"), F.sum("n").alias("n"), F.sum(F.when((F.col("n") == 0) & ~F.col("is_census"), F.coalesce("plugged", F.lit(0))).otherwise(0)).alias("plug"))
    return by.withColumn("share", ratio("value", base if isinstance(base, Column) else F.lit(base)))


def plugged_counts(members: DataFrame, labels: DataFrame, questions: dict[str, Column]) -> DataFrame:
    """(question, stratum, plugged): what the labels under test say of each stratum."""
    names = [F.struct(F.lit(q).alias("question"), F.coalesce(c, F.lit(False)).alias("holds")) for q, c in questions.items()]
    answers = labels.select("id", F.explode(F.array(*names)).alias("a")).select("id", "a.question", "a.holds")
    return members.join(answers, "id").groupBy("question", "stratum").agg(count_if(F.col("holds")).alias("plugged"))


def rate_times_count(rate: DataFrame, count: DataFrame) -> DataFrame:
    """One row: a sampled rate with its interval times a count known from the labels."""
    w = wilson("k", "n")
    return rate.crossJoin(F.broadcast(count)).select((w["p"] * F.col("count")).alias("value"), (w["lo"] * F.col("count")).alias("lo"), (w["hi"] * F.col("count")).alias("hi"))


def conditional_share(audited: DataFrame, given: Column, holds: Column) -> DataFrame:
    """One row: among audited items where ``given`` holds, the share that holds, with its interval."""
    w = wilson("k", "n")
    return audited.agg(count_if(given).alias("n"), count_if(given & holds).alias("k")).select("n", "k", w["p"].alias("value"), w["lo"].alias("lo"), w["hi"].alias("hi"))


def movers(audited: DataFrame, label: str, reference: str, value: str) -> DataFrame:
    """(reference, n, share): where audited items of one label went."""
    of = audited.where((F.col(label) == value) & F.col(reference).isNotNull())
    return of.groupBy(F.col(reference).alias("reference")).agg(F.count("*").alias("n")).crossJoin(F.broadcast(of.agg(F.count("*").alias("_n")))).select("reference", "n", ratio("n", "_n").alias("share"))


def side_by_side(model: DataFrame, estimates: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """(question, model, value, lo, hi, inside): the labels' own figures against the intervals."""
    inside = (F.col("model") >= F.col("lo") - tolerance) & (F.col("model") <= F.col("hi") + tolerance)
    return model.join(estimates.select("question", "value", "lo", "hi"), "question").withColumn("inside", inside)


def verdict(compared: DataFrame, claim: str = "claim", enough: int = 2) -> DataFrame:
    """(claim, inside, of, verdict): all inside holds, enough inside holds with a correction, else it fails."""
    by = compared.groupBy(claim).agg(count_if(F.col("inside")).alias("inside"), F.count("*").alias("of"))
    return by.withColumn("verdict", F.when(F.col("inside") == F.col("of"), "holds").when(F.col("inside") >= enough, "with correction").otherwise("fails"))


def still_in_class(audited: DataFrame, population: DataFrame, label: str, reference: str, value: str, subtype: str) -> DataFrame:
    """(part, key, n, k, value, lo, hi) of a class that was sampled inside: who stays, where the others went, and the stayers' sub-types.

    ``audited`` are the sampled items that the labels put in the class, with the reference labels; ``population`` has
    the class' size as one row ``population``. Part ``stays`` is the audited share that stays, scaled to the
    class; ``moved`` has a row for each other reference label, ``subtype`` one for each sub-type of those that stay, both
    scaled in the same way, as shares of all audited. Items without a reference label are not audited.
    """
    of = audited.where((F.col(label) == value) & F.col(reference).isNotNull())
    stays = F.col(reference) == value
    part = F.explode(F.filter(F.array(
        F.when(stays, F.struct(F.lit("stays").alias("part"), F.lit(value).alias("key"))),
        F.when(~stays, F.struct(F.lit("moved").alias("part"), F.col(reference).cast("string").alias("key"))),
        F.when(stays, F.struct(F.lit("subtype").alias("part"), F.coalesce(F.col(subtype).cast("string"), F.lit("none")).alias("key"))),
    ), lambda x: x.isNotNull()))
    by = of.select(part.alias("p")).groupBy("p.part", "p.key").agg(F.count("*").alias("k"))
    every = of.sparkSession.createDataFrame([("stays", value)], "part string, key string").join(by, ["part", "key"], "full").na.fill(0, ["k"])
    met = every.crossJoin(F.broadcast(of.agg(F.count("*").alias("n")).crossJoin(population)))
    return met.select("part", "key", "n", "k", *(c.alias(x) for x, c in scaled("k", "n", "population").items()))


def region_check(members: DataFrame, drawn: DataFrame, labels: DataFrame, reference: DataFrame, model: Column, audit: Column, regions: dict[str, Column]) -> DataFrame:
    """(region, region_n, model_n, value, lo, hi, audited_n, model_pos, both_pos, audit_pos, inside) for each region.

    What the labels under test count in a region, against the estimate of the audit alone, with strata and
    samples cut to the region. ``model`` and ``audit`` are the same question asked of ``labels`` and of
    ``reference``, each with one row an item; regions are conditions on ``labels`` and may overlap.
    """
    tags = F.filter(F.array(*(F.when(c, F.lit(k)) for k, c in regions.items())), lambda t: t.isNotNull())
    inside = labels.select("id", F.coalesce(model, F.lit(False)).alias("_m"), F.explode(tags).alias("region"))
    asked = reference.select("id", F.coalesce(audit, F.lit(False)).alias("_a"))
    counts = inside.groupBy("region").agg(F.count("*").alias("region_n"), count_if(F.col("_m")).alias("model_n"))
    seen = inside.join(drawn.select("id").distinct(), "id", "left_semi").join(asked, "id")
    audited = seen.groupBy("region").agg(F.count("*").alias("audited_n"), count_if(F.col("_m")).alias("model_pos"), count_if(F.col("_m") & F.col("_a")).alias("both_pos"), count_if(F.col("_a")).alias("audit_pos"))
    sizes = members.join(inside, "id").groupBy("region", "stratum").agg(F.count("*").alias("population"))
    sampled = drawn.join(inside, "id").join(asked, "id").groupBy("region", "stratum").agg(F.count("*").alias("n"), count_if(F.col("_a")).alias("k"))
    parts = sizes.join(sampled, ["region", "stratum"], "left").na.fill(0, ["n", "k"]).withColumnRenamed("region", "question").withColumn("is_census", F.lit(False))
    found = stratified_estimate(parts, 1).select(F.col("question").alias("region"), "value", "lo", "hi")
    out = counts.join(found, "region", "left").join(audited, "region", "left").na.fill(0, ["audited_n", "model_pos", "both_pos", "audit_pos"])
    return out.withColumn("inside", (F.col("model_n") >= F.col("lo") - 1e-9) & (F.col("model_n") <= F.col("hi") + 1e-9))


def sanity_tables(audited: DataFrame, claims: dict[str, tuple[Column, Column, Column]]) -> DataFrame:
    """(claim, label, reference, n, share): for each claim (filter, label, reference) the labels beside the audit's answers.

    All claims are counted in one pass; the share is of the label's audited items. An item without either is left out.
    """
    each = F.array(*(F.when(keep, F.struct(F.lit(k).alias("claim"), a.cast("string").alias("label"), b.cast("string").alias("reference"))) for k, (keep, a, b) in claims.items()))
    rows = audited.select(F.explode(each).alias("c")).where("c.label IS NOT NULL AND c.reference IS NOT NULL")
    by = rows.groupBy("c.claim", "c.label", "c.reference").agg(F.count("*").alias("n"))
    whole = by.groupBy("claim", "label").agg(F.sum("n").alias("_n"))
    return by.join(whole, ["claim", "label"]).select("claim", "label", "reference", "n", ratio("n", "_n").alias("share"))


def design_limits(items: DataFrame, drawn: DataFrame, label: str, reference: str, unmeasured: Column, chips: str = "chips") -> DataFrame:
    """(limit, key, k, n): what a design cannot check.

    ``unsampled``: for each class of the label its n items, k of them audited all the same with that label confirmed.
    ``numeric_chip``: of the n audited items that the reference calls unmeasured, the k with a digit in a claim.
    """
    audited = items.join(drawn.select("id").distinct(), "id", "left_semi")
    confirmed = audited.where(F.col(label) == F.col(reference)).groupBy(label).agg(F.count("*").alias("k"))
    classes = items.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n")).join(confirmed, label, "left")
    first = classes.select(F.lit("unsampled").alias("limit"), F.col(label).cast("string").alias("key"), F.coalesce("k", F.lit(0)).alias("k"), "n")
    digit = F.coalesce(F.exists(F.col(chips), lambda c: c.rlike("[0-9]")), F.lit(False))
    second = audited.where(unmeasured).agg(count_if(digit).alias("k"), F.count("*").alias("n")).select(F.lit("numeric_chip").alias("limit"), F.lit("").alias("key"), "k", "n")
    return first.unionByName(second)
