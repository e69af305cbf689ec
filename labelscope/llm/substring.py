"""Substring de-duplication over sliding sentence spans.

Texts are cut into units at stops and clause marks of any script and at line ends; a unit of more
than ``LONG`` words is cut further at word boundaries that its own words choose, so that a passage
put into another sentence finds its cuts again. From every unit a run goes on over ``SPAN`` units
and further until it has ``MIN_WORDS`` words; every run is hashed. The first place of each hash, by
(document, position), stays, and units covered by a run at any later place are removed. A passage
that two documents share loses at most its first and last units to the text around it, so
what stays of it in the later one is far below 50 words. Runs of fewer words repeat by chance and in
stock phrases; a text that has fewer has no run.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelscope.llm.common import map_batches
from labelscope.sources.shared import shared_table

#: Units and words of a run, at least.
SPAN, MIN_WORDS = 3, 16
#: A unit of more words is cut before the word of the smallest hash in each window of so many words.
LONG, WINDOW = 12, 12

#: Scripts without spaces between words: each character counts as a word.
_DENSE = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
_IS_DENSE = re.compile(f"[{_DENSE}]")
_WORD, _PLAIN = re.compile(f"[{_DENSE}]|[^\\s{_DENSE}]+"), re.compile(r"\S+")
_MARK = "!-/:-@\\[-`{-~\u00a1-\u00bf\u060c\u061b\u061f\u06d4\u2010-\u205e\u3001-\u3003\u3008-\u3020\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65"
#: Stops that end a unit with no white space behind.
_STOP = "\u0589\u0964\u0965\u0f0d\u104a\u104b\u1362\u17d4\u2026\u3001\u3002\uff01\uff0c\uff0e\uff1a\uff1b\uff1f\uff61"
#: A unit ends after marks with white space behind, after a stop of those above or one of . ! ? with more marks behind, or at a line end.
_END = re.compile(f"[{_STOP}][{_MARK}{_STOP}]*\\s*|[.!?]+(?![.!?])[{_MARK}]+\\s*|[{_MARK}]+\\s+|\\n\\s*")


class _Hashes(dict):
    """64-bit hashes of words, some of them remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


_HASHES = _Hashes()
#: Multiplier of the hash of a word sequence, and its inverse modulo 2^64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


@lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the multiplier and of its inverse."""
    out = np.ones((2, n), np.uint64)
    with np.errstate(over="ignore"):
        for row, base in zip(out, (_BASE, _INVERSE), strict=True):
            row[1:] = np.uint64(base)
            np.multiply.accumulate(row, out=row)
    return out[0], out[1]


def _marked(text: str) -> tuple[list[int], list[int], list[str]]:
    """The ends of the stretches between marks, each stretch's number of words, and all words in lower case."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
    split = str.split if low.isascii() or not _IS_DENSE.search(low) else _WORD.findall
    ends, counts, words, a = [m.end() for m in _END.finditer(low)], [], [], 0
    if not ends or ends[-1] < len(low):
        ends.append(len(low))
    for b in ends:
        found = split(low[a:b])
        counts.append(len(found))
        words += found
        a = b
    return ends, counts, words


def _begins(counts: list[int], hashes: np.ndarray) -> np.ndarray:
    """The first word of each unit: of each stretch, and in a long one before the least pair of each window of its words."""
    sizes, n = np.array(counts), len(hashes)
    of = np.repeat(np.arange(len(sizes)), sizes)
    first = (np.cumsum(sizes) - sizes)[sizes > 0]
    if n <= max(LONG, WINDOW) or sizes.max() <= LONG:
        return first
    pairs = (hashes[:-1] * np.uint64(_BASE)) ^ hashes[1:]
    pairs ^= pairs >> np.uint64(32)
    keys = (pairs * np.uint64(_BASE) >> np.uint64(33)).astype(np.int64) * (1 << 32) - np.arange(n - 1)
    width = 1
    while width < WINDOW:  # the least key of each window, the last one of equal hashes
        step = min(width, WINDOW - width)
        keys, width = np.minimum(keys[:-step], keys[step:]), width + step
    inside = (of[: len(keys)] == of[WINDOW:]) & (sizes[of[: len(keys)]] > LONG)
    return np.union1d(first, -keys[inside] % (1 << 32) + 1)


def _units(text: str) -> list[tuple[int, int, int]]:
    """(start, end, words) of each unit; together they cover the text."""
    ends, counts, words = _marked(text)
    begins = _begins(counts, np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))) if words else []
    inner, out, a, at, k = [int(b) for b in begins], [], 0, 0, 0
    for b, n in zip(ends, counts, strict=True):
        cuts = []
        while k < len(inner) and inner[k] < at + n:
            cuts.append(inner[k] - at)
            k += 1
        spots = [a]
        if len(cuts) > 1:
            starts = [m.start() for m in _WORD.finditer(text, a, b)] if _IS_DENSE.search(text, a, b) else [m.start() for m in _PLAIN.finditer(text, a, b)]
            spots += [starts[c] for c in cuts[1:]]
        out += [(x, y, w) for x, y, w in zip(spots, [*spots[1:], b], np.diff([*cuts, n]).tolist() if cuts else [0], strict=True)]
        a, at = b, at + n
    return [u for u in out if u[1] > u[0]]


def sentences(text: str | None) -> list[str]:
    """The units of a text with the white space that follows each; joined they give the text."""
    return [text[a:b] for a, b, _ in _units(text)] if text else []


def span_hashes(text: str | None, span: int = SPAN, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, units, hash) of each run of units with words; case and white space do not count.

    Units without a word belong to no run of their own and are stepped over.
    """
    _, counts, words = _marked(text or "")
    n = len(words)
    if n < max(1, min_words):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    hashes = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, n)
    begins = _begins(counts, hashes)
    edges = np.r_[begins, n]
    starts = np.arange(len(begins))
    ends = np.maximum(starts + span, np.searchsorted(edges, begins + min_words))
    starts, ends = starts[ends < len(edges)], ends[ends < len(edges)]
    power, inverse = _powers(1 << int(n).bit_length())
    sums = np.r_[np.uint64(0), np.cumsum(hashes * power[:n], dtype=np.uint64)]
    a, b = edges[starts], edges[ends]
    mixed = (sums[b] - sums[a]) * inverse[a] ^ (b - a).astype(np.uint64)
    mixed = (mixed ^ mixed >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return starts, ends - starts, (mixed ^ mixed >> np.uint64(32)).view(np.int64)


def _covered(text: str, spans: list[int]) -> tuple[str, int, int]:
    """The text without the units of spans (position * 256 + units); removed units and removed words."""
    parts = _units(text)
    real = [i for i, (*_, w) in enumerate(parts) if w]
    gone = {k for p in spans for k in real[p >> 8 : (p >> 8) + (p & 255)]}
    return "".join(text[a:b] for i, (a, b, _) in enumerate(parts) if i not in gone), len(gone), sum(parts[i][2] for i in gone)


def repeated_spans(docs: DataFrame, span: int = SPAN, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, starts): for each document, the spans that are not the first of their hash, in order, as position * 256 + units.

    A span that comes again in its own document is known where the document lies. A hash's first
    document comes from an aggregate of numbers with map-side combine; joining it back to the
    spans needs no gathering of a hash's places, however many share it. The join is a merge at
    every size, so that the plan does not change as the corpus grows.
    """

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, counts, starts, hashes, again = batch.column(0).to_numpy(zero_copy_only=False), [], [], [], []
        for text in batch.column(1).to_pylist():
            p, n, h = span_hashes(text, span, min_words)
            counts.append(len(p))
            starts.append(p * 256 + n)
            hashes.append(h)
            seen = np.ones(len(p), bool)
            seen[np.unique(h, return_index=True)[1]] = False
            again.append(seen)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes)), pa.array(np.repeat(ids, counts)), pa.array(np.concatenate(starts)), pa.array(np.concatenate(again))], names=["hash", "id", "start", "again"])

    picked = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    spans = shared_table(map_batches(picked, make, "hash long, id long, start long, again boolean"), "spans")
    once = spans.where("not again").select("hash", "id", "start")
    first = once.groupBy("hash").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("hash", "first")
    later = once.join(first.hint("merge"), "hash").where("id > first").select("id", "start")
    return later.unionByName(spans.where("again").select("id", "start")).groupBy("id").agg(F.sort_array(F.collect_set("start")).alias("starts"))


def drop_repeats(docs: DataFrame, span: int = SPAN, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the text rewritten, and n_removed and removed_words, its removed units and their words.

    Units covered by a non-first span are cut out; all else of the text stays as it is.
    Null texts stay null and empty ones empty, with zero counts. Rows without an id are not
    compared and stay as they are. Rows that repeat an id are one document and are not compared with
    each other; spans found repeated in one are removed in all. Columns of ``docs`` that are called like a new column are replaced. A very long
    text is cut into units in one go and only its hashes are exchanged. An empty table gives an empty table.
    """
    repeats = shared_table(repeated_spans(docs, span, min_words, id_col, text_col), "repeats").withColumnsRenamed({"id": "_repeat_id", "starts": "_starts"})
    names = [c for c in docs.columns if c not in ("n_removed", "removed_words")]
    met = docs.select(*names).join(repeats.hint("merge"), F.col(id_col).cast("long") == F.col("_repeat_id"), "left").drop("_repeat_id")

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, found = batch.column(names.index(text_col)).to_pylist(), batch.column(len(names)).to_pylist()
        rows = [_covered(t, s) if t and s else (t, 0, 0) for t, s in zip(texts, found, strict=True)]
        new = {text_col: pa.array([r[0] for r in rows], pa.string())}
        columns = [new.get(c, batch.column(k)) for k, c in enumerate(names)]
        return pa.RecordBatch.from_arrays([*columns, *(pa.array([r[k] for r in rows], pa.int64()) for k in (1, 2))], names=[*names, "n_removed", "removed_words"])

    fields = ", ".join(f"`{c}` {'string' if c == text_col else docs.schema[c].dataType.simpleString()}" for c in names)
    return map_batches(met, make, f"{fields}, n_removed long, removed_words long")
