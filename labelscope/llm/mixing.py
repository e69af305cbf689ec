"""Mixing sources to target weights by capped water-filling.

Each source asks for its weight's share of the mix. A source cannot give more than ``max_epochs``
times its size; what it cannot give is shared again by weight among the others, until none is
above its cap. The fixed point is min(cap, level * weight) for one level, found over the
sources in the order of cap / weight, so the whole of it is a few windows over the table of sources,
one row each.

With the rate target / source size, every document of a source is repeated as often as the rate's
whole part says, and a seeded choice of documents once more: they stand in the order of a hash of
seed, id and text, and are taken until they have as many words as the rate's fraction asks. The
last one gives a run of its words, so a source's words come to its target exactly. Where the choice
ends is found on sums over buckets of the hash; only the rows of that bucket are ranked.
"""

from __future__ import annotations

import re
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelscope.llm.common import map_batches
from labelscope.sources.shared import shared_table

WEIGHTS, SHARE, MAX_EPOCHS, SEED = (3, 1, 2), 1.5, 2, "mix-1"
WORDS = r"[^\x20\x09-\x0D]+"
_WORD = re.compile(WORDS)
#: Hex digits of the hash that make a bucket: 65,536 buckets of a source.
BUCKET_DIGITS = 4
#: A table of sources up to this many rows is broadcast; a larger one is joined by a shuffle.
BROADCAST_SOURCES = 10_000


def word_count(text: str) -> Column:
    """Number of runs of other than ASCII white space; null counts 0."""
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORDS)), F.lit(0)).cast("long")


def draw_order(id_col: str, text_col: str, seed: str = SEED) -> Column:
    """The md5 of seed, id and text, the same in every run and engine; null counts as empty."""
    parts = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (id_col, text_col))
    return F.md5(F.concat_ws(":", F.lit(seed), *parts))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, source_col: str = "source") -> DataFrame:
    """(source, source_size, target): one row per source, from (source, size) rows.

    Weights go to the sources in code point order, null last, and repeat. The windows without a
    key run over one row per source.
    """
    by = sizes.groupBy(F.col(source_col).alias("source")).agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    ranked = by.withColumn("weight", F.get(cycle, F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs))).withColumn("ratio", F.col("cap") / F.col("weight"))
    filled = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    after = filled.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = ranked.withColumn("mass", F.sum("source_size").over(whole) * F.lit(float(share)))
    # the level if all sources before this one are at their caps and no other is
    level = (F.col("mass") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    ranked = ranked.withColumn("try", level)
    fits = ranked.withColumn("level", F.max(F.when(F.col("try") <= F.col("ratio"), F.col("try"))).over(whole))
    return fits.select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with size, source_size, target, whole and part.

    A document is taken ``whole`` times and once more in ``part`` words: all of them where the
    seeded choice of its source takes it, none where not, and some for the last one it takes. A
    source's words come to its target, rounded, and no document passes ``max_epochs``.
    Null and wordless texts have size 0 and are never taken; sources without words have target 0.
    A null source is a source of its own. Repeated rows count each time and stand side by side in the
    order; null ids and texts are hashed as empty ones. A very long text is counted as a whole and may be the one
    that is taken in part. Columns called like a new one are replaced. An empty table gives an empty table.
    """
    new = ("size", "source_size", "target", "whole", "part")
    sized = docs.drop(*(c for c in new if c not in (id_col, text_col, source_col)))
    sized = sized.withColumn("size", word_count(text_col)).withColumn("_u", draw_order(id_col, text_col, seed)).withColumn("_bucket", F.conv(F.substring("_u", 1, BUCKET_DIGITS), 16, 10).cast("long"))
    buckets = shared_table(sized.groupBy(F.col(source_col).alias("source"), F.col("_bucket").alias("bucket")).agg(F.sum("size").alias("size")), "buckets")
    by = targets(buckets, weights, share, max_epochs)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    by = by.withColumn("rate", rate).withColumn("goal", F.floor((F.col("rate") - F.floor("rate")) * F.col("source_size") + 0.5).cast("long"))
    # the bucket in which the choice ends, and the words before it: first among 256 wide ones of a source, then among 256 in that one
    goals = by.select(F.col("source").alias("_s"), "goal", F.lit(0).cast("long").alias("before"), F.lit(None).cast("long").alias("wide"))
    buckets = buckets.withColumn("_wide", F.shiftright("bucket", 8))
    for column in ("_wide", "bucket"):
        met = buckets.join(goals, F.col("source").eqNullSafe(F.col("_s")) & (F.col("wide").isNull() | (F.col("_wide") == F.col("wide"))))
        met = met.groupBy("source", "goal", "before", column).agg(F.sum("size").alias("size"))
        met = met.withColumn("upto", F.col("before") + F.sum("size").over(Window.partitionBy("source").orderBy(column)))
        met = met.where((F.col("upto") - F.col("size") < F.col("goal")) & (F.col("goal") <= F.col("upto")))
        goals = met.select(F.col("source").alias("_s"), "goal", (F.col("upto") - F.col("size")).alias("before"), F.col(column).alias("wide"))
    ends = goals.select("_s", F.col("wide").alias("bucket"), "before")
    by = by.join(ends, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    by = shared_table(by.select(F.col("source").alias("_source"), "source_size", "target", F.floor("rate").cast("long").alias("_whole"), "goal", F.coalesce("bucket", F.lit(-1).cast("long")).alias("_end"), F.coalesce("before", F.lit(0).cast("long")).alias("_before")), "targets")
    by = F.broadcast(by) if by.count() <= BROADCAST_SOURCES else by
    met = sized.join(by, F.col(source_col).eqNullSafe(F.col("_source"))).withColumn("whole", F.when(F.col("size") > 0, F.col("_whole")).otherwise(F.lit(0).cast("long")))
    zero = F.lit(0).cast("long")
    sure = met.where(F.col("_bucket") != F.col("_end")).withColumn("part", F.when(F.col("_bucket") < F.col("_end"), F.col("size")).otherwise(zero))
    order = Window.partitionBy("_source").orderBy("_u", F.col(id_col)).rowsBetween(Window.unboundedPreceding, -1)
    last = met.where(F.col("_bucket") == F.col("_end")).withColumn("_rank", F.col("_before") + F.coalesce(F.sum("size").over(order), zero))
    last = last.withColumn("part", F.greatest(zero, F.least("size", F.col("goal") - F.col("_rank")))).drop("_rank")
    return sure.unionByName(last).select(*(c for c in docs.columns if c not in new or c in (id_col, text_col, source_col)), *new)


def repetitions(mixed: DataFrame, seed: int = 1, text_col: str = "text") -> DataFrame:
    """The rows of the mix: each document's whole copies and, for a part, a run of its words.

    The run takes ``part`` consecutive words from a seeded word on, with the white space between
    them as it is; all of them give the whole text. The columns that ``mix`` added are dropped again.
    Rows with a null or wordless text are taken nowhere; repeated rows each give their own copies. An
    empty table gives an empty table.
    """
    added = ("size", "source_size", "target", "whole", "part")
    names = [c for c in mixed.columns if c not in added]

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        size, whole, part = (batch.column(len(names) + k).to_pylist() for k in range(3))
        rows, texts = [], []
        for i, text in enumerate(batch.column(names.index(text_col)).to_pylist()):
            rows += [i] * (whole[i] + (part[i] > 0))
            texts += [text] * whole[i]
            if part[i] == size[i] and part[i]:
                texts.append(text)
            elif part[i]:
                spots = [m.span() for m in _WORD.finditer(text)]
                start = zlib.crc32(text.encode("utf-8", "surrogatepass"), seed) % (size[i] - part[i] + 1)
                texts.append(text[spots[start][0] : spots[start + part[i] - 1][1]])
        out = pa.RecordBatch.from_arrays([batch.column(k) for k in range(len(names))], names=names).take(pa.array(rows, pa.int64()))
        return out.set_column(names.index(text_col), text_col, pa.array(texts, pa.string()))

    fields = ", ".join(f"`{c}` {'string' if c == text_col else mixed.schema[c].dataType.simpleString()}" for c in names)
    return map_batches(mixed.select(*names, "size", "whole", "part"), make, fields)
