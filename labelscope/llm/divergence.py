"""How far the sources of a language differ in their words: smoothed term shares over an iceberg of kept terms.

Which terms enough documents of a language hold is found by iceberg prefix refinement. Texts are
read once into postings: for each language and term the occurrences by source and a few of its
documents, as many as the threshold, so that the number of distinct documents of any group of terms
is known up to the threshold. Postings are dealt out and sorted by language and term, so terms of one prefix lie
together. Prefixes are then extended level by level: a prefix whose distinct documents stay below
the threshold goes with all its terms, until the complete terms that remain are those kept.

The measures between sources are sums over blocks of kept terms; a block is a small matrix of
terms by sources, and only its sums and its best terms leave it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelscope.llm.common import BROADCAST_CLASSES, pieces_of
from labelscope.sources.shared import shared_table

MIN_DOCS, TOP, UNIT = 3, 200, 1_000_000_000
#: Bytes of the first prefix; each level's is so many times as long.
FIRST_LEVEL, LEVEL_FACTOR = 2, 2
#: Terms, and entries by source, that a task holds before it writes postings; rows that are refined at once; entries of a block's matrix.
HELD_TERMS, HELD_ENTRIES, CHUNK_ROWS, BLOCK_ENTRIES = 300_000, 1_000_000, 50_000, 1 << 18
#: A-Z become a-z, other ASCII characters blanks.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))

_POSTINGS = "lang string, term binary, docs array<long>, sources array<string>, counts array<long>"
_SCHEMA = pa.schema([("lang", pa.string()), ("term", pa.binary()), ("docs", pa.list_(pa.int64())), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])


def terms_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and other than ASCII characters, with A-Z lower-cased."""
    return text.translate(_FOLD).split()


class _Held:
    """Postings of the texts that a task has read since it last wrote some."""

    def __init__(self, min_docs: int) -> None:
        self.min_docs = min_docs
        self.clear()

    def clear(self) -> None:
        self.counts: dict[tuple[str, str], Counter] = {}
        self.docs: dict[str, dict[bytes, tuple]] = {}
        self.full: dict[str, set[bytes]] = {}
        self.size = self.entries = 0

    def add(self, lang: str, source: str, doc: int | None, text: bytes) -> None:
        words = terms_of(text)
        if not words:
            return
        counts = self.counts.setdefault((lang, source), Counter())
        self.entries -= len(counts)
        counts.update(words)
        self.entries += len(counts)
        docs, full = self.docs.setdefault(lang, {}), self.full.setdefault(lang, set())
        for term in set(words) - full:
            known = docs.get(term, ())
            if doc not in known:
                docs[term] = known = (*known, doc)
                if len(known) == 1:
                    self.size += 1
                if len(known) == self.min_docs:
                    full.add(term)

    def batches(self) -> Iterator[pa.RecordBatch]:
        for lang, docs in self.docs.items():
            terms = sorted(docs)
            slot = {t: i for i, t in enumerate(terms)}
            own = sorted(s for x, s in self.counts if x == lang)
            at = [np.fromiter(map(slot.__getitem__, self.counts[lang, s]), np.int64) for s in own]
            n = [np.fromiter(self.counts[lang, s].values(), np.int64) for s in own]
            which = np.concatenate([np.full(len(a), i) for i, a in enumerate(at)])
            at, n = np.concatenate(at), np.concatenate(n)
            order = np.argsort(at, kind="stable")
            ends = np.searchsorted(at[order], np.arange(len(terms) + 1))
            found = [docs[t] for t in terms]
            first = np.cumsum([0, *map(len, found)])
            table = pa.RecordBatch.from_arrays(
                [
                    pa.array([lang]).take(pa.array(np.zeros(len(terms), np.int64))),
                    pa.array(terms, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(list(chain.from_iterable(found)), pa.int64())),
                    pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(own, pa.string()).take(pa.array(which[order]))),
                    pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(n[order])),
                ],
                schema=_SCHEMA,
            )
            yield from (pa.RecordBatch.from_arrays(list(table.slice(i, 20_000).columns), schema=_SCHEMA) for i in range(0, len(terms), 20_000))
        self.clear()


def postings(docs: DataFrame, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, term, docs, sources, counts): occurrences by source, and up to ``min_docs`` documents, of each term of a part of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(min_docs)
        for batch in batches:
            for piece in pieces_of(batch):
                for doc, text, lang, source in zip(*(c.to_pylist() for c in piece.columns), strict=True):
                    held.add(lang, source, doc, text)
                    if held.size > HELD_TERMS or held.entries > HELD_ENTRIES:
                        yield from held.batches()
        yield from held.batches()

    blank = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"))]
    return docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"), *blank).mapInArrow(run, _POSTINGS)


def _groups(lang: np.ndarray, term: pa.Array, length: np.ndarray, size: int | None) -> np.ndarray:
    """For sorted rows, the number of each row's group by language and prefix of ``size`` bytes; None for whole terms.

    A term that is shorter than the prefix ends in it and is a group of its own.
    """
    prefix = term if size is None else pc.binary_slice(term, 0, size)
    same = pc.equal(prefix.slice(1), prefix.slice(0, len(prefix) - 1)).to_numpy(zero_copy_only=False)
    ends = length < size if size is not None else np.zeros(len(length), bool)
    new = ~same | (lang[1:] != lang[:-1]) | (ends[1:] != ends[:-1])
    return np.cumsum(np.r_[0, new])


def refine(table: pa.Table, min_docs: int, first: int = FIRST_LEVEL, factor: int = LEVEL_FACTOR) -> tuple[pa.Table, list[int]]:
    """Postings sorted by language and term, without those of rare prefixes; the rows before and after each level.

    Prefixes at either edge of the table may go on beyond it and stay until the last level, that of
    whole terms, for which the table has to hold all rows of its terms.
    """
    left, size = [table.num_rows], first
    while table.num_rows:
        table = table.combine_chunks()
        term = table.column("term").chunk(0)
        length = pc.binary_length(term).to_numpy(zero_copy_only=False)
        last = bool((length < size).all())
        lang = table.column("lang").dictionary_encode().combine_chunks()
        lang = (lang.chunk(0) if isinstance(lang, pa.ChunkedArray) else lang).indices.to_numpy(zero_copy_only=False)
        group = _groups(lang, term, length, None if last else size)
        docs = table.column("docs").chunk(0)
        lengths = pc.list_value_length(docs).to_numpy(zero_copy_only=False)
        held = docs.flatten()
        number = pc.fill_null(held.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1  # no id is one document
        pairs = np.unique(np.repeat(group, lengths) * (number.max() + 1) + number)
        count = np.bincount(pairs // (number.max() + 1), minlength=group[-1] + 1)
        keep = count >= min_docs
        if not last:
            keep[[0, -1]] = True
        table = table.filter(pa.array(keep[group]))
        left.append(table.num_rows)
        if last:
            break
        size *= factor
    return table, left


def _merged(table: pa.Table, min_docs: int) -> pa.Table:
    """Sorted postings with one row a language and term."""
    table = table.combine_chunks()
    if not table.num_rows:
        return table
    lang, term, docs, sources, counts = (table.column(c).chunk(0) for c in range(5))
    codes = lang.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    group = _groups(codes, term, np.zeros(len(term), np.int64), None)
    if group[-1] + 1 == len(group):
        return table
    heads = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    n = group[-1] + 1
    of = _pairs(np.repeat(group, pc.list_value_length(docs).to_numpy(zero_copy_only=False)), docs.flatten(), None)
    rank = np.arange(len(of[0])) - np.searchsorted(of[0], of[0])
    some = rank < min_docs
    by = _pairs(np.repeat(group, pc.list_value_length(sources).to_numpy(zero_copy_only=False)), sources.flatten(), counts.flatten().to_numpy(zero_copy_only=False))
    ends = pa.array(np.searchsorted(by[0], np.arange(n + 1)).astype(np.int32))
    return pa.table(
        [
            lang.take(pa.array(heads)),
            term.take(pa.array(heads)),
            pa.ListArray.from_arrays(pa.array(np.searchsorted(of[0][some], np.arange(n + 1)).astype(np.int32)), of[1].filter(pa.array(some))),
            pa.ListArray.from_arrays(ends, by[1]),
            pa.ListArray.from_arrays(ends, pa.array(by[2])),
        ],
        schema=_SCHEMA,
    )


def _pairs(group: np.ndarray, value: pa.Array, weight: np.ndarray | None) -> tuple[np.ndarray, pa.Array, np.ndarray | None]:
    """The distinct (group, value), sorted by group, with the sum of their weights."""
    coded = value.dictionary_encode()
    code = pc.fill_null(coded.indices, len(coded.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
    keys, where = np.unique(group * (len(coded.dictionary) + 1) + code, return_inverse=True)
    total = None
    if weight is not None:
        total = np.zeros(len(keys), np.int64)
        np.add.at(total, where, weight)
    dictionary = pa.concat_arrays([coded.dictionary, pa.nulls(1, coded.dictionary.type)])
    return keys // (len(coded.dictionary) + 1), dictionary.take(pa.array(keys % (len(coded.dictionary) + 1))), total


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS, **columns: str) -> DataFrame:
    """(lang, term, sources, counts): the terms in at least ``min_docs`` documents of a language with their occurrences by source, one row each."""
    found = shared_table(postings(docs, min_docs, **columns), "postings")
    dealt = found.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        rows = 0

        def settled(table: pa.Table) -> Iterator[pa.RecordBatch]:
            kept, _ = refine(table, min_docs)
            yield from _merged(kept, min_docs).select(["lang", "term", "sources", "counts"]).to_batches()

        for batch in batches:
            waiting.append(batch)
            rows += batch.num_rows
            if rows < CHUNK_ROWS:
                continue
            table = pa.Table.from_batches(waiting, _SCHEMA)
            last = len(table) - 1
            same = pc.and_(pc.equal(table.column("term"), table.column("term")[last]), pc.equal(table.column("lang"), table.column("lang")[last]))
            cut = pc.index(same, True).as_py()  # all rows of a term are settled together
            if cut:
                yield from settled(table.slice(0, cut))
            waiting = _merged(table.slice(cut), min_docs).to_batches()
            rows = sum(b.num_rows for b in waiting)
        if waiting:
            yield from settled(pa.Table.from_batches(waiting, _SCHEMA))

    return dealt.mapInArrow(run, "lang string, term binary, sources array<string>, counts array<long>")


def shares(counts: np.ndarray, n: np.ndarray | int, v: int, unit: int = UNIT) -> np.ndarray:
    """1 + floor(unit * (count + 1) / (n + v)), exact."""
    if int(counts.max(initial=0)) + 1 < (1 << 62) // unit:
        return 1 + unit * (counts + 1) // (n + v)
    total = np.array(n, object) + v
    return (1 + unit * (counts.astype(object) + 1) // total).astype(np.int64)


def _block(terms: pa.Table, groups: pa.Table, top: int) -> pa.Table:
    """Sums over a block of terms for each pair of sources, in two halves, and each source's best terms."""
    names = groups.column("source").combine_chunks()
    names = names.chunk(0) if isinstance(names, pa.ChunkedArray) else names
    order = np.argsort(np.array(names.to_pylist(), object), kind="stable")
    names, n = names.take(pa.array(order)), groups.column("n").to_numpy()[order]
    lang, v, n_lang = groups.column("lang")[0].as_py(), groups.column("v")[0].as_py(), groups.column("n_lang")[0].as_py()
    text = np.array(terms.column("term").to_pylist(), object)
    by_term = np.argsort(text, kind="stable")
    sources, counts = terms.column("sources").combine_chunks(), terms.column("counts").combine_chunks()
    sources, counts = (c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in (sources, counts))
    m = np.zeros((len(text), len(names)), np.int64)
    row = np.repeat(np.arange(len(text)), pc.list_value_length(sources).to_numpy(zero_copy_only=False))
    m[row, pc.index_in(sources.flatten(), names).to_numpy(zero_copy_only=False)] = counts.flatten().to_numpy(zero_copy_only=False)
    m, text = m[by_term], text[by_term]
    p, q = shares(m, n, v), shares(m.sum(1), n_lang, v)
    out = {k: [] for k in ("source", "item", "term", "hi", "lo")}
    for g in range(len(names)):
        f = (p[:, g, None] - p) ** 2 // p
        others = np.flatnonzero(np.arange(len(names)) != g)
        out["source"].append(np.full(len(others), g))
        out["item"].append(others)
        out["term"].append(np.full(len(others), -1))
        out["hi"].append((f >> 32).sum(0)[others])
        out["lo"].append((f & 0xFFFFFFFF).sum(0)[others])
        high = np.flatnonzero((m[:, g] > 0) & (p[:, g] > q))
        value = (p[high, g] - q[high]) ** 2 // q[high]
        best = np.argsort(-value, kind="stable")[:top]  # terms are in order, so ties are too
        out["source"].append(np.full(len(best), g))
        out["item"].append(np.full(len(best), -1))
        out["term"].append(high[best])
        out["hi"].append(value[best] >> 32)
        out["lo"].append(value[best] & 0xFFFFFFFF)
    flat = {k: np.concatenate(x) for k, x in out.items()}
    is_term = pa.array(flat["term"] >= 0)
    items = pc.if_else(is_term, pa.array(text, pa.binary()).cast(pa.string()).take(pa.array(np.maximum(flat["term"], 0))), names.take(pa.array(np.maximum(flat["item"], 0))))
    return pa.table({"lang": pa.array([lang] * len(items), pa.string()), "source": names.take(pa.array(flat["source"])), "is_term": is_term, "item": items, "hi": flat["hi"], "lo": flat["lo"]})


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): for each source of a language its divergence from the other sources and its most particular terms.

    The kept terms of a language are those in at least ``min_docs`` of its documents. Part ``pair`` has
    a row for each other source of the language, part ``term`` the ``top`` kept terms whose smoothed share
    in the source is above the language's. Ties rank by the item's bytes.

    Null texts, languages and sources are the empty string. Rows of one language that repeat an id are
    one document; their occurrences all count. Rows without an id are one document. A language without
    kept terms has pairs of value 0, one with a single source none. A long text is split into words by itself;
    a long term is a term. Other columns are not read. An empty table gives an empty table. A value
    that a long cannot hold is null.
    """
    kept = shared_table(kept_terms(docs, min_docs, id_col=id_col, text_col=text_col, lang_col=lang_col, source_col=source_col), "kept")
    blank = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"))]
    groups = docs.select(*blank).distinct()
    totals = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("e")).groupBy("lang", F.col("e.sources").alias("source")).agg(F.sum("e.counts").alias("n"))
    groups = shared_table(groups.join(totals, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n")), "groups")
    langs = groups.groupBy("lang").agg(F.sum("n").alias("n_lang"), F.count("*").alias("s")).join(kept.groupBy("lang").agg(F.count("*").alias("v")), "lang")
    langs = shared_table(langs.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("v") * F.col("s") / BLOCK_ENTRIES)).cast("long")), "langs")
    langs = F.broadcast(langs) if langs.count() <= BROADCAST_CLASSES else langs  # one language may hold most terms: their join has no shuffle
    terms = kept.join(langs.select("lang", "blocks"), "lang").withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks"))).drop("blocks")
    sent = groups.join(langs, "lang").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select("lang", "source", "n", "v", "n_lang", "block")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("is_term", pa.bool_()), ("item", pa.string()), ("hi", pa.int64()), ("lo", pa.int64())])
        return _block(left, right, top) if left.num_rows else schema.empty_table()

    found = terms.groupBy("lang", "block").cogroup(sent.groupBy("lang", "block")).applyInArrow(compare, "lang string, source string, is_term boolean, item string, hi long, lo long")
    found = shared_table(found, "divergences")
    value = (F.sum(F.col("hi").cast("decimal(28,0)")) * F.lit(1 << 32).cast("decimal(10,0)") + F.sum(F.col("lo").cast("decimal(28,0)"))).try_cast("long")
    sums = found.where(~F.col("is_term")).groupBy("lang", "source", "item").agg(value.alias("value"), F.lit(1).alias("has"))
    other = groups.select("lang", F.col("source").alias("item"))
    # the result's own rows: every source beside each other source of its language
    pairs = groups.select("lang", "source").join(other, "lang").where("source <> item").join(sums, ["lang", "source", "item"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.when(F.col("has").isNull(), F.lit(0).cast("long")).otherwise(F.col("value")).alias("value"))
    best = found.where("is_term").select("lang", "source", F.lit("term").alias("part"), "item", ((F.col("hi") * (1 << 32)) + F.col("lo")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = [pairs.withColumn("rank", rank), best.withColumn("rank", rank).where(F.col("rank") <= top)]
    return ranked[0].unionByName(ranked[1]).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))
