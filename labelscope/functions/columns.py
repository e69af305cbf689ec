"""Column expressions that the operators share; all stay inside whole-stage code generation."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / b in double precision; null where b is zero or null."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def count_if(condition: Column) -> Column:
    """Rows where the condition is true; null counts as false."""
    return F.count(F.when(condition, F.lit(1)))


def share_if(condition: Column) -> Column:
    """Share of rows where the condition is true, null counted as false; null without rows."""
    return F.avg(F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0)))


def sum_if(value: str | Column, condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, col(value))), F.lit(0))


def wilson(k: str | Column, n: str | Column, z: float = 1.96, clamp: bool = True) -> dict[str, Column]:
    """Share and Wilson interval as columns p, lo and hi; null for n = 0."""
    k, n = col(k).cast("double"), col(n).cast("double")
    p = F.try_divide(k, n)
    under = F.lit(1.0) + F.try_divide(F.lit(z * z), n)
    mid = p + F.try_divide(F.lit(z * z), n * 2)
    half = F.lit(z) * F.sqrt(F.try_divide(p * (F.lit(1.0) - p), n) + F.try_divide(F.lit(z * z), n * n * 4))
    lo, hi = F.try_divide(mid - half, under), F.try_divide(mid + half, under)
    if clamp:
        some = p.isNotNull()
        lo, hi = F.when(some, F.greatest(lo, F.lit(0.0))), F.when(some, F.least(hi, F.lit(1.0)))
    return {"p": p, "lo": lo, "hi": hi}


def rule_cascade(rules: Iterable[tuple[Column, str]], default: str) -> Column:
    """The label of the first rule that holds; a null condition does not hold."""
    out: Column | None = None
    for condition, label in rules:
        out = F.when(condition, F.lit(label)) if out is None else out.when(condition, F.lit(label))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def bin_label(value: str | Column, edges: list[float]) -> Column:
    """Number of the left-closed bin [edges[i], edges[i + 1]) that holds the value; null outside."""
    v, out = col(value), None
    for i, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
        condition = (v >= lo) & (v < hi)
        out = F.when(condition, F.lit(i)) if out is None else out.when(condition, F.lit(i))
    return out


def top_or_other(value: str | Column, keep: Iterable[str], other: str = "other") -> Column:
    return F.when(col(value).isin(*keep), col(value)).otherwise(F.lit(other))


def as_flag(value: str | Column, true: Iterable[str] = ("true", "1", "yes", "y")) -> Column:
    """Text as a boolean; empty and null stay null."""
    text = F.lower(F.trim(col(value)))
    return F.when(text != "", text.isin(*true))


def label_value(value: str | Column, excluded: Iterable[str] = (), other: str = "other") -> Column:
    """A label without white space at its ends, empty as null, and an excluded class counted as other."""
    text = F.trim(col(value))
    return F.when(text == "", None).when(text.isin(*excluded), F.lit(other)).otherwise(text) if list(excluded) else F.when(text != "", text)


def decode_id_time(value: str | Column, shift: int = 22, epoch_ms: int = 1288834974657) -> Column:
    """The time inside a time-ordered id: its upper bits are milliseconds after an epoch (fixed values)."""
    return F.timestamp_millis(F.shiftright(col(value).cast("bigint"), shift) + F.lit(epoch_ms))


def like_rate(likes: str, views: str) -> Column:
    return F.when(F.col(views) > 0, ratio(likes, views))


def suspect(likes: str, views: str, min_views: int = 100_000, max_rate: float = 0.002) -> Column:
    """Much seen and hardly liked; false where views are zero or null."""
    return F.coalesce((F.col(views) >= min_views) & (like_rate(likes, views) < max_rate), F.lit(False))


def shortened(text: str | Column, chars: int = 700, mark: str = "…") -> Column:
    """At most ``chars`` characters, with a mark where the text went on; null is empty."""
    t = F.coalesce(col(text), F.lit(""))
    return F.when(F.length(t) > chars, F.concat(F.substring(t, 1, chars), F.lit(mark))).otherwise(t)


def bound(value: Column, body) -> Column:
    """``body`` of the value, computed once; a lambda over an expression would compute it again for every element."""
    return F.transform(F.array(value), body)[0]


def windows(text: Column, length: int, starts) -> Column:
    """The windows of ``length`` characters at the places that ``starts`` gives for the last one's; shorter texts have none.

    The text is split into characters once, so that a window costs its own length wherever it lies.
    """

    def cut(chars: Column) -> Column:
        last = F.size(chars) - (length - 1)
        return F.when(last >= 1, F.transform(starts(F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(chars, i, F.lit(length)), ""))).otherwise(F.array().cast("array<string>"))

    return bound(F.filter(F.split(text, ""), lambda c: c != ""), cut)


def has_repo(kind: str | Column, url: str | Column, host: str = "github.com") -> Column:
    """Whether an attachment is a repository by its kind or its URL; null is false."""
    return F.coalesce(col(kind) == "repo", F.lit(False)) | F.coalesce(col(url).contains(host), F.lit(False))


def looked_up(value: str | Column, table: dict[str, str]) -> Column:
    """The table's entry for the value; null where it has none. For small fixed dimensions."""
    return F.create_map(*(F.lit(x) for two in table.items() for x in two))[col(value)]
