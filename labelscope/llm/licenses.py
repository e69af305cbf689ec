"""License scans: phrases, and templates whose mandatory wording must match exactly.

A template is a text with ``[optional words]`` and ``{low,high}`` for a replaceable region of so
many words, a whole licence or a notice. It compiles to an automaton over tokens; a text is accepted
when some run of its words takes the automaton from its start to its end, so that every mandatory
word stands where it must.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelscope.llm.common import map_batches
from labelscope.llm.license_texts import TEMPLATES

#: Phrases found as consecutive words, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Templates that a task holds at once; those of a larger table are matched by so many in one pass of stages.
MOST_TEMPLATES = 10_000

_TOKEN = re.compile(r"\{(\d+),(\d+)\}|\[|\]|[^\s\[\]{}]+")
#: ASCII bytes that are no digit or lower-case letter after lower-casing separate words.
_SPACE = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in bytes(range(256)).lower())


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_SPACE).split()


def compile_template(template: str) -> list[list[tuple[bytes | None, int]]]:
    """For each state its moves (word, next state); a null word takes any, b"" takes none.

    The last state accepts.
    """
    moves: list[list[tuple[bytes | None, int]]] = [[]]
    opened: list[int] = []

    def step(word: bytes | None) -> None:
        moves[-1].append((word, len(moves)))
        moves.append([])

    for m in _TOKEN.finditer(template.lower()):
        if m[0] == "[":
            opened.append(len(moves) - 1)
        elif m[0] == "]":
            moves[opened.pop()].append((b"", len(moves) - 1))
        elif m[1]:
            skips = []
            for i in range(int(m[2])):
                if i >= int(m[1]):
                    skips.append(len(moves) - 1)
                step(None)
            for state in skips:
                moves[state].append((b"", len(moves) - 1))
        else:
            for word in words(m[0]):
                step(word)
    return moves


def _closed(moves: list, states: set[int]) -> set[int]:
    todo = list(states)
    while todo:
        for word, to in moves[todo.pop()]:
            if word == b"" and to not in states:
                states.add(to)
                todo.append(to)
    return states


def accepts(moves: list, found: list[bytes]) -> bool:
    """Whether a run of the words leads from the first state to the last."""
    start = _closed(moves, {0})
    begins = {word for s in start for word, _ in moves[s] if word is None or word}
    live: set[int] = set()
    for w in found:
        if not live and None not in begins and w not in begins:
            continue
        live = _closed(moves, {to for s in live | start for word, to in moves[s] if word is None or (word and word == w)})
        if len(moves) - 1 in live:
            return True
    return False


def mandatory_words(template: str, most: int = 6) -> bytes:
    """Words that stand together in every text that the template accepts; a space where it has no such words."""
    depth, run, runs = 0, [], []
    for m in _TOKEN.finditer(template.lower()):
        if m[0] in "[]" or m[1]:
            depth += {"[": 1, "]": -1}.get(m[0], 0)
            runs.append(run)
            run = []
        elif not depth:
            run += words(m[0])
    best = b" ".join(max([*runs, run], key=len)[:most])
    return b" " + best + b" " if best else b" "


def as_templates(templates: dict[str, str] | DataFrame) -> list[tuple[str, str]]:
    """(label, template) rows of a mapping or of a table with these columns; rows with a null do not count."""
    if isinstance(templates, dict):
        return list(templates.items())
    return sorted(map(tuple, templates.where("label IS NOT NULL AND template IS NOT NULL").select("label", "template").distinct().collect()))


class Matcher:
    """Compiled templates by the longest of their mandatory words, so that a text meets those whose word it has."""

    def __init__(self, templates: list[tuple[str, str]]) -> None:
        self.by_word: dict[bytes, list[tuple[str, bytes, list]]] = {}
        self.any: list[tuple[str, bytes, list]] = []
        for label, template in templates:
            run = mandatory_words(template)
            entry = (label, run, compile_template(template))
            if run.split():
                self.by_word.setdefault(max(run.split(), key=len), []).append(entry)
            else:
                self.any.append(entry)

    def labels(self, found: list[bytes], line: bytes) -> set[str]:
        near = [e for w in self.by_word.keys() & set(found) for e in self.by_word[w]]
        return {label for label, run, moves in [*self.any, *near] if run in line and accepts(moves, found)}


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str] | DataFrame = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for each row.

    ``templates`` maps labels to templates, or is a table of (label, template); the default holds
    notices and whole texts of common licences. A template without mandatory words accepts any text with a word.
    More than MOST_TEMPLATES are matched part after part, each by a stage of the same pass over the rows.
    ``n_base`` counts all places of phrases and first_word and last_word are the smallest and
    largest start of one, null without any. ``base_labels`` are the phrases' labels, ``labels``
    also those of accepted templates; both distinct, sorted and comma-joined, empty without any.
    ``score`` is 1 with an accepted template, else 0.5 with a phrase, else 0. Null texts count as
    empty; a null id is returned as null; repeated rows are all returned; other columns are not
    read. An empty table gives an empty table.
    """
    split = [(p.encode().split(), label) for p, label in phrases.items()]
    given = as_templates(templates)
    matchers = [Matcher(given[i : i + MOST_TEMPLATES]) for i in range(0, max(len(given), 1), MOST_TEMPLATES)]

    def part(matcher: Matcher):
        def more(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for text, before in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                found = words(text)
                out.append(sorted({*before, *matcher.labels(found, b" " + b" ".join(found) + b" ")}))
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.string()))], names=["doc_id", "text", "more"])

        return more

    def one(text: str | None, before: list[str], matcher: Matcher = matchers[-1]) -> tuple:
        found = words(text)
        line = b" " + b" ".join(found) + b" "
        starts, base = [], set()
        for phrase, label in split:
            whole, at, seen, place = b" " + b" ".join(phrase) + b" ", -1, 0, 0
            while (at := line.find(whole, at + 1)) >= 0:
                place += line.count(b" ", seen, at)
                seen = at
                starts.append(place)
                base.add(label)
        more = {*before, *matcher.labels(found, line)}
        return len(found), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), 1.0 if more else 0.5 if base else 0.0

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = zip(*map(one, batch.column(1).to_pylist(), batch.column(2).to_pylist()), strict=True)
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.array().cast("array<string>").alias("more"))
    for matcher in matchers[:-1]:
        picked = map_batches(picked, part(matcher), "doc_id long, text string, more array<string>")
    return map_batches(picked, make, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
