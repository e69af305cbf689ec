"""Leak scan over all readings of raw files: windows of two lengths by one rolling hash, looked up in a filter.

An index holds windows of a corpus' texts and titles that few owners share. Files are read in
every way that could hide a text, and all windows of all readings are hashed where the file
lies: prefix sums of powers give the hash of a window of any length, so one pass serves texts and
titles. A Bloom filter of the index, put together on the executors and of bounded size, says which windows may
be in it; only those are exchanged and met with the index by their characters. Findings
become verdicts on files by the owners' own titles and a table of caps.
"""

from __future__ import annotations

import html
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelscope.sources.shared import shared_table

# Lengths and steps of the windows, owners that make a window common, and the marks that are read alike.
WINDOWS = {"text": (40, 8), "title": (24, 4)}
COMMON = 3
MARKS = {"‘": "'", "’": "'", "‚": "'", "‛": "'", "“": '"', "”": '"', "„": '"', "‟": '"', "–": "-", "—": "-", "−": "-"}
INVISIBLE = re.compile("[​‌‍⁠﻿]")
TAG = re.compile(r"<[^>]{0,2000}>")
STRING = re.compile(r'"((?:[^"\\\n]|\\.){8,})"')

READINGS = ("raw", "unescaped", "untagged", "quotes", "strings", "strings_untagged")
#: Bits of the filter for each window of the index, the least and the most bits as powers of two (16 MB), and hash functions.
FILTER_BITS, LEAST_POWER, MOST_POWER, FILTER_HASHES = 16, 15, 27, 4
#: Words of a filter's block, and characters that are hashed at once.
BLOCK_WORDS, HASHED_CHARS = 4096, 1 << 16
#: Rules on files at most, as they become one expression.
MOST_RULES = 1000

_MARKS = str.maketrans(MARKS)
_BASE = 0x9E3779B97F4A7C15
_POWERS = np.multiply.accumulate(np.full(HASHED_CHARS, _BASE, np.uint64))
_INVERSES = np.multiply.accumulate(np.full(HASHED_CHARS, pow(_BASE, -1, 1 << 64), np.uint64))


def normal_form(text: str | None) -> str:
    """Compatibility form with plain quotes and dashes, no invisible characters, single spaces and lower case; null is empty."""
    text = text or ""
    if not text.isascii():
        text = INVISIBLE.sub("", unicodedata.normalize("NFKC", text).translate(_MARKS))
    return " ".join(text.split()).lower()


def readings(raw: str | None) -> list[tuple[str, str]]:
    """(name, text) of the ways to read a raw file.

    As it is, with references decoded, that without tags, with doubled quotes single, its JSON strings of
    eight characters or more decoded and joined by line ends, and those with references decoded and
    without tags. What looks like a JSON string and is none is left out of the strings.
    """
    raw = raw or ""
    plain, found = html.unescape(raw), []
    for literal in STRING.findall(raw):
        try:
            found.append(json.loads(f'"{literal}"'))
        except ValueError:
            continue
    strings = "\n".join(found)
    return list(zip(READINGS, (raw, plain, TAG.sub(" ", plain), raw.replace('""', '"'), strings, TAG.sub(" ", html.unescape(strings))), strict=True))


def rolling_hashes(text: str, lengths: tuple[int, ...]) -> Iterator[tuple[int, int, np.ndarray]]:
    """(length, offset, hashes) of all windows of each length, for one stretch of the text after another."""
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    step = HASHED_CHARS - max(lengths) + 1
    for start in range(0, max(len(chars), 1), step):
        part = chars[start : start + HASHED_CHARS]
        sums = np.r_[np.uint64(0), np.cumsum(part * _POWERS[: len(part)], dtype=np.uint64)]
        for length in lengths:
            n = min(len(part) - length + 1, step)
            if n > 0:
                h = (sums[length : length + n] - sums[:n]) * _INVERSES[:n] + np.uint64(length)
                h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
                yield length, start, h ^ h >> np.uint64(32)


def window_hash(window: str) -> int:
    """The hash that ``rolling_hashes`` has for the window."""
    return int(next(rolling_hashes(window, (len(window),)))[2][0])


def starts(size: int, length: int, step: int) -> list[int]:
    """Places of the windows of an indexed text: every ``step``, and the last one that fits."""
    last = size - length
    return [] if last < 0 else sorted({*range(0, last + 1, step), last})


def build_index(corpus: DataFrame, id_col: str, text: str, title: str, common: int = COMMON) -> DataFrame:
    """(kind, shingle, owner): windows of texts and of titles that fewer than ``common`` owners share, written.

    Null texts and titles, and those shorter than a window, have none; rows that repeat an id are one owner.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                owner, kinds, found = batch.column(0)[i].as_py(), [], set()
                for column, (kind, (length, step)) in enumerate(WINDOWS.items(), 1):
                    own = normal_form(batch.column(column)[i].as_py())
                    found |= {(kind, own[s : s + length]) for s in starts(len(own), length, step)}
                kinds, texts = ([f[k] for f in found] for k in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(texts, pa.string()), pa.array([owner] * len(found), batch.schema.types[0])], names=["kind", "shingle", "owner"])

    each = corpus.select(F.col(id_col).alias("owner"), F.col(text).alias("text"), F.col(title).alias("title"))
    each = each.mapInArrow(run, f"kind string, shingle string, owner {each.schema['owner'].dataType.simpleString()}").distinct()
    shared = each.groupBy("kind", "shingle").agg(F.count("*").alias("_n"), F.slice(F.sort_array(F.collect_set("owner")), 1, common - 1).alias("_owners"))
    return shared_table(shared.where(F.col("_n") < common).select("kind", "shingle", F.explode("_owners").alias("owner")), "leak_index")


def _positions(h: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """Places of the hashes in a filter of so many bits, a power of two."""
    step = (h >> np.uint64(33)) | np.uint64(1)
    for i in range(FILTER_HASHES):
        yield (h + np.uint64(i) * step) & np.uint64(bits - 1)


def build_filter(index: DataFrame) -> np.ndarray:
    """The words of a Bloom filter of the index's windows.

    Tasks set bits, an aggregate joins them word by word, and the driver gets blocks of words. The
    filter has at most 2 ** MOST_POWER bits: a larger index only lets more windows through.
    """
    rows = index.count()
    power = int(np.clip(np.ceil(np.log2(max(1, rows) * FILTER_BITS)), LEAST_POWER, MOST_POWER))

    def bits_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = np.array([window_hash(s) for s in batch.column(0).to_pylist()], np.uint64)
            at = np.concatenate([*_positions(h, 1 << power)]) if len(h) else np.empty(0, np.uint64)
            words, where = np.unique(at >> np.uint64(6), return_inverse=True)
            bits = np.zeros(len(words), np.uint64)
            np.bitwise_or.at(bits, where, np.uint64(1) << (at & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(words.astype(np.int64)), pa.array(bits.view(np.int64))], names=["word", "bits"])

    words = index.select("shingle").mapInArrow(bits_of, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))

    def block_of(table: pa.Table) -> pa.Table:
        out = np.zeros(BLOCK_WORDS, np.int64)
        word = table.column("word").to_numpy()
        out[word % BLOCK_WORDS] = table.column("bits").to_numpy()
        return pa.table({"block": [int(word[0]) // BLOCK_WORDS], "words": pa.array([out.tobytes()], pa.binary())})

    blocks = words.withColumn("block", F.floor(F.col("word") / BLOCK_WORDS)).groupBy("block").applyInArrow(block_of, "block long, words binary")
    out = np.zeros(max(1, (1 << power) >> 6), np.uint64)
    for block, part in ((r["block"], r["words"]) for r in blocks.collect()):  # at most 512 blocks of 32 KB
        part = np.frombuffer(bytes(part), np.uint64)
        out[block * BLOCK_WORDS : (block + 1) * BLOCK_WORDS] = part[: len(out) - block * BLOCK_WORDS]
    return out


def held(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places of the hashes that the filter may hold."""
    left = np.arange(len(h))
    for i in range(FILTER_HASHES):
        step = (h[left] >> np.uint64(33)) | np.uint64(1)
        at = (h[left] + np.uint64(i) * step) & np.uint64(len(words) * 64 - 1)
        left = left[(words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)]
    return left


def scan(files: DataFrame, file_id: str, raw: str, index: DataFrame) -> DataFrame:
    """(file, kind, owner, reading, offset, shingle): for each file, kind and owner the first finding, by reading and then by place.

    The offset counts characters of the reading's normal form. Equal readings of a file are searched once,
    as the first of them. Rows that repeat a file are one file. Null files hold nothing. A file is read
    whole and by itself; its windows are hashed stretch by stretch.
    """
    words = files.sparkSession.sparkContext.broadcast(build_filter(index))  # at most 2 ** MOST_POWER bits
    kinds = {length: kind for kind, (length, _) in WINDOWS.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                seen, found = set(), []
                for number, (_, text) in enumerate(readings(batch.column(1)[i].as_py())):
                    text = normal_form(text)
                    if text in seen:
                        continue
                    seen.add(text)
                    for length, start, h in rolling_hashes(text, tuple(kinds)):
                        at = held(words.value, h)
                        at = at[np.sort(np.unique(h[at], return_index=True)[1])] + start
                        found += [(kinds[length], number, int(a), text[a : a + length]) for a in at]
                if found:
                    columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.string(), pa.int32(), pa.int32(), pa.string()))]
                    own = batch.column(0).slice(i, 1).take(pa.array(np.zeros(len(found), np.int64)))
                    yield pa.RecordBatch.from_arrays([own, *columns], names=["file", "kind", "reading", "offset", "shingle"])

    hay = files.select(F.col(file_id).alias("file"), F.col(raw).cast("string").alias("raw"))
    met = hay.mapInArrow(run, f"file {hay.schema['file'].dataType.simpleString()}, kind string, reading int, offset int, shingle string").join(index, ["kind", "shingle"])
    first = met.groupBy("file", "kind", "owner").agg(F.min(F.struct("reading", "offset", "shingle")).alias("f"))
    return first.select("file", "kind", "owner", F.element_at(F.array(*map(F.lit, READINGS)), F.col("f.reading") + 1).alias("reading"), "f.offset", "f.shingle")


def normal_titles(corpus: DataFrame, id_col: str, title: str) -> DataFrame:
    """(owner, title): each owner's title in normal form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([normal_form(t) for t in batch.column(1).to_pylist()], pa.string())], names=["owner", "title"])

    picked = corpus.select(F.col(id_col).alias("owner"), F.col(title).cast("string").alias("title"))
    return picked.mapInArrow(run, f"owner {picked.schema['owner'].dataType.simpleString()}, title string")


def _first_cap(rules: list, kind: str, file: Column) -> Column:
    """The cap of the first rule of the kind whose pattern the file is like; null for none."""
    out = F.lit(None).cast("long")
    for r in reversed([r for r in rules if r["kind"] == kind]):
        out = F.when(file.like(r["pattern"]), F.lit(r["cap"]).cast("long")).otherwise(out)
    return out


def verdicts(hits: DataFrame, titles: DataFrame, rules: DataFrame) -> DataFrame:
    """(file, verdict, n_text, n_title) of each file with a finding.

    A finding of a text inside its owner's title (owner, title) is the title quoted. ``rules`` (position, kind,
    pattern, cap) say which files may quote: of those of a kind that a file's name is like, the one with
    the smallest position holds; a cap of 0 is none. A file with texts is ``text allowed`` within
    its cap, else ``text``. One with titles only is ``titles`` without a rule, ``titles over cap`` beyond it,
    else ``titles allowed``. An owner whose text is found counts as text alone.
    """
    given = rules.orderBy("position").limit(MOST_RULES + 1).collect()
    if len(given) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules on files")
    met = hits.join(titles, "owner", "left")
    quoted = (F.col("kind") == "title") | F.coalesce(F.col("title").contains(F.col("shingle")), F.lit(False))
    owners = met.groupBy("file", "owner").agg(F.bool_and(quoted).alias("title_only"))
    by = owners.groupBy("file").agg(F.count(F.when(~F.col("title_only"), 1)).alias("n_text"), F.count(F.when(F.col("title_only"), 1)).alias("n_title"))
    text_cap, title_cap = _first_cap(given, "text", F.col("file")), _first_cap(given, "title", F.col("file"))
    within = lambda cap, n: (cap == 0) | (F.col(n) <= cap)
    verdict = (
        F.when((F.col("n_text") > 0) & F.coalesce(within(text_cap, "n_text"), F.lit(False)), "text allowed")
        .when(F.col("n_text") > 0, "text")
        .when(title_cap.isNull(), "titles")
        .when(within(title_cap, "n_title"), "titles allowed")
        .otherwise("titles over cap")
    )
    return by.select("file", verdict.alias("verdict"), "n_text", "n_title")
