"""Removal of repeated lines against levelled sorted runs of line hashes.

The store holds every line key once, in runs: tables of 128-bit hashes dealt into buckets by the
hash and sorted within them. Documents are added in batches from the largest id down. The keys
of a batch are merge-anti-joined with the runs, bucket by bucket and without a shuffle: those
that no run holds become the batch's own run, with the id that keeps the line, and those that
some run holds only add to that key's number of documents. When a level has ``FANOUT`` runs they
are merged into one of the next level, so a batch meets few runs.

A last pass over the texts looks their lines up among the frequent keys and cuts those that
another document keeps. Everything is built of DataFrame functions.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelscope.sources.shared import remove_path, shared_dir, shared_table

#: Code points of a key that counts, documents that make it frequent, batches of a table, runs of a level.
MIN_CHARS, MIN_DOCS, BATCHES, FANOUT = 20, 3, 4, 2
SPACE, UPPER, LOWER = " \t\n\x0b\x0c\r", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends and with A-Z lower-cased."""
    bare = F.btrim(line, F.lit(SPACE))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2")]


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def line_counts(docs: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(h1, h2, docs, last): for each key of at least ``min_chars`` code points its documents and the largest of their ids."""
    lines = docs.select(F.col(id_col).cast("long").alias("id"), F.explode(F.split(_text(text_col), "\n")).alias("line"))
    lines = lines.select("id", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars).select("id", *_hashes(F.col("key")))
    # rows without an id are one document, before all others
    return lines.groupBy(*KEY).agg((F.count_distinct("id") + F.max(F.col("id").isNull().cast("int"))).alias("docs"), F.max("id").alias("last"))


class LineRuns:
    """Levelled sorted runs of line keys, as bucketed tables in the shared folder.

    The runs are disjoint: a key is in the run of the batch that brought it first. Batches have to
    come from the largest document ids down, and no document may be in two of them. ``close`` removes
    all runs.
    """

    def __init__(self, spark: SparkSession, fanout: int = FANOUT) -> None:
        self.spark, self.fanout = spark, fanout
        # as many buckets as a shuffle has partitions, so that a batch's aggregate already lies in them
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.met: list[str] = []
        self._paths: dict[str, str] = {}

    def _write(self, df: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        self._paths[name] = f"{shared_dir(self.spark)}/tables/{name}"
        df.write.format("parquet").option("path", self._paths[name]).bucketBy(self.buckets, *KEY).sortBy(*KEY).saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove_path(self.spark, self._paths.pop(name))

    def _merged(self, names: list[str]) -> DataFrame:
        """The rows of several runs, dealt anew. Read as plain files: a union of bucketed scans claims buckets that it does not keep."""
        return self.spark.read.schema(self.spark.table(names[0]).schema).parquet(*[self._paths[n] for n in names]).repartition(self.buckets, *KEY)

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def _compact(self) -> None:
        """Merge each full level into one run of the next."""
        for i in range(len(self.levels)):
            if len(self.levels[i]) >= self.fanout:
                names, self.levels[i] = self.levels[i], []
                if i + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[i + 1].append(self._write(self._merged(names)))
                for name in names:
                    self._drop(name)

    def add(self, counts: DataFrame) -> None:
        """Take in the ``line_counts`` of a batch."""
        self._compact()
        self.levels = self.levels or [[]]
        keys = self._write(counts)
        if not self.runs():
            self.levels[0].append(keys)
            return
        new = self.spark.table(keys)
        for name in self.runs():
            new = new.join(self.spark.table(name).select(*KEY).hint("merge"), KEY, "left_anti")
        own = self._write(new)
        self.met.append(self._write(self.spark.table(keys).join(self.spark.table(own).select(*KEY).hint("merge"), KEY, "left_anti")))
        self.levels[0].append(own)
        self._drop(keys)

    def frequent(self, at_least: int = MIN_DOCS) -> DataFrame:
        """(h1, h2, last): the keys of at least so many documents, written; ``last`` is null where no document has an id."""
        found = [self.spark.table(n) for n in self.runs()]
        if self.met:
            more = self._write(self._merged(self.met).groupBy(*KEY).agg(F.sum("docs").alias("more")))
            found = [run.join(self.spark.table(more).hint("merge"), KEY, "left").withColumn("docs", F.col("docs") + F.coalesce("more", F.lit(0))) for run in found]
        out = shared_table(reduce(DataFrame.unionByName, [run.where(F.col("docs") >= at_least).select(*KEY, "last") for run in found]), "lines")
        if self.met:
            self._drop(more)
        return out

    def close(self) -> None:
        for name in list(self._paths):
            self._drop(name)


def _batches(docs: DataFrame, id_col: str, n: int) -> list[DataFrame]:
    """The rows in up to ``n`` batches by ranges of the id, the largest ids first, rows without an id last."""
    id_ = F.col(id_col).cast("long")
    cuts = docs.agg(F.percentile_approx(id_, [k / n for k in range(n - 1, 0, -1)], 1000)).first()[0] or []
    cuts = sorted(set(cuts), reverse=True)
    above = [id_ > c for c in cuts]
    return [docs.where(a & (id_ <= before) if before is not None else a) for a, before in zip(above, [None, *cuts], strict=False)] + [docs.where((id_ <= cuts[-1]) | id_.isNull()) if cuts else docs]


def drop_repeated_lines(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` without the lines that at least ``min_docs`` documents share, but for those of the largest id; with n_lines and n_dropped.

    A line's key is the line without ASCII white space at its ends and with A-Z lower-cased; keys of
    fewer than ``min_chars`` code points never go. All lines of a document with a key that it keeps
    stay, so the largest id is the tie's rule. Null and empty texts are one empty line and come out as
    the empty text. Rows that repeat an id are one document: they count once and keep or lose a line
    together. Rows without an id are one document before all others. A very long text is one row of
    the last join and its lines are rows of their own before. Columns called n_lines and n_dropped are
    replaced, other columns stay. An empty table gives an empty table.
    """
    spark, store = docs.sparkSession, LineRuns(docs.sparkSession)
    for batch in _batches(docs, id_col, batches):
        store.add(line_counts(batch, min_chars, id_col, text_col))
    frequent = store.frequent(min_docs)
    store.close()
    # a row is known by hashes of its id and text: equal rows have equal lines to lose
    id_, row = F.col(id_col).cast("long"), [F.xxhash64(F.col(id_col).cast("long"), _text(text_col)).alias("_row1"), F.xxhash64(F.lit("row"), F.col(id_col).cast("long"), _text(text_col)).alias("_row2")]
    lines = docs.select(*row, id_.alias("id"), F.posexplode(F.split(_text(text_col), "\n")).alias("at", "line"))
    lines = lines.withColumn("key", line_key(F.col("line"))).where(F.length("key") >= min_chars).select("_row1", "_row2", "id", "at", *_hashes(F.col("key")))
    lost = lines.join(frequent, KEY).where(~F.col("id").eqNullSafe(F.col("last"))).groupBy("_row1", "_row2").agg(F.array_sort(F.collect_set("at")).alias("_lost"))
    met = docs.select("*", *row).join(lost, ["_row1", "_row2"], "left")
    kept = _without(F.split(_text(text_col), "\n"), F.col("_lost"))
    return met.select(
        *[F.when(F.col("_lost").isNull(), _text(text_col)).otherwise(kept).alias(c) if c == text_col else F.col(c) for c in docs.columns if c not in ("n_lines", "n_dropped")],
        (F.length(_text(text_col)) - F.length(F.replace(_text(text_col), F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.coalesce(F.size("_lost"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def _without(lines: Column, lost: Column) -> Column:
    """The lines but those at the sorted places ``lost``, joined: the runs between two places, so work follows the number of lines."""
    ends = F.concat(F.array(F.lit(-1)), lost, F.array(F.lit(2147483646)))

    def runs(pair: Column) -> Column:
        return F.flatten(
            F.transform(
                F.sequence(F.lit(1), F.size(pair["ends"]) - 1),
                lambda i: F.slice(pair["lines"], F.element_at(pair["ends"], i) + 2, F.element_at(pair["ends"], i + 1) - F.element_at(pair["ends"], i) - 1),
            )
        )

    # as the variable of an outer function the split is made once a row and not once a run
    return F.array_join(F.element_at(F.transform(F.array(F.struct(lines.alias("lines"), ends.alias("ends"))), runs), 1), "\n")
