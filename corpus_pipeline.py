"""Document pipeline: stages applied one after another, each written as Parquet and read again.

A stage takes (spark, docs, sf_dir) and works on all rows of ``docs``. All but the last return
the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelscope.llm import minhash, mixing, pieces, quality, substring
from labelscope.llm.common import bucket_of
from labelscope.sources.shared import read_table, shared_table


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; null and empty texts are scored like any other.

    Rows that repeat an id are each scored by their own text, a very long one as a whole; a score of exactly 0.5
    stays. Columns called like the score are replaced on the way. Without rows of both labels all stay; an empty table gives an empty table.
    """
    labels = read_table(spark, sf_dir, "labels")
    model = quality.train(docs, labels.where(bucket_of("doc_id", 3) != 1))
    return quality.score(docs, model).where("quality_score >= 0.5").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group stays, that of the smallest id, by five-word shingles and a similarity of 0.8.

    Rows are told apart by id and text, so a clean row stays where its id is also a copy's. Rows
    without words or without an id are in no group and stay. A very long text counts by all its shingles. Columns
    called like the operator's are kept. An empty table gives an empty table.
    """
    return minhash.keep_one(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Units of repeated passages go, but for their first place; a document left without text goes too.

    Null and empty texts stay, and a very long one is cut like any other. Rows that repeat an id are one document; columns called like a new one
    are no columns of documents. An empty table gives an empty table.
    """
    cut = substring.drop_repeats(docs).where((F.col("n_removed") == 0) | (F.trim("text") != ""))
    return cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: whole copies of documents, a seeded choice of them once more, and a part of one of each source.

    Null and wordless texts are never taken; a null source is one of its own; repeated rows count
    each; a very long text may be the one that is taken in part, and ties of the order go by the id. An empty table gives an empty table.
    """
    clash = {c: f"_own_{c}" for c in ("size", "source_size", "target", "whole", "part") if c in docs.columns}
    mixed = mixing.repetitions(mixing.mix(docs.withColumnsRenamed(clash))).withColumn("n_chars", F.length("text").cast("long"))
    return mixed.withColumnsRenamed({own: c for c, own in clash.items()}).select(*docs.columns)


def segment(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, sample, ids, log_prob, perturbed, log_inclusion, text): sampled segmentations of every row, decoded again.

    Null and empty texts give one empty segmentation; rows of one id and text give the same ones; a very long text
    is drawn word by word. An
    empty table gives an empty table.
    """
    return pieces.encode(docs, decode_too=True)


STAGES = [
    ("quality", keep_good_quality),
    ("minhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("mixing", mix_sources),
    ("sentencepiece", segment),
]

#: The stages train a model, hash texts and draw samples in ways that SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = shared_table(docs, name)
    return docs
