"""Null-safe column helpers.

One rule governs all of them: a missing input gives a missing result, never a zero.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """``a / b``; null if either is null or ``b`` is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def mean2(a: Column, b: Column) -> Column:
    return (a + b) / F.lit(2.0)


def nonzero(a: Column) -> Column:
    """``a``, or null where it is 0."""
    return F.when(a != 0, a)


def clamp(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    """``x`` held between bounds; null stays null, which ``least`` and ``greatest`` alone would not keep."""
    return F.when(x.isNotNull(), F.least(F.lit(hi), F.greatest(F.lit(lo), x)))


def sum_present(*parts: Column) -> Column:
    """Sum of those parts that are there; null if none is."""
    gone = parts[0].isNull()
    total = F.coalesce(parts[0], F.lit(0.0))
    for p in parts[1:]:
        gone, total = gone & p.isNull(), total + F.coalesce(p, F.lit(0.0))
    return F.when(~gone, total)


def count_true(*tests: Column) -> Column:
    """How many tests hold; null if any of them is undecided."""
    out = F.lit(0)
    for t in tests:
        out = out + t.cast("int")
    return out


def listed(*pairs: tuple[Column, str]) -> Column:
    """The names whose condition holds, in the given order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for c, n in pairs]))


def absent(values: Iterable[tuple[str, Column]]) -> Column:
    """The names whose value is missing, in the given order."""
    return F.array_compact(F.array(*[F.when(v.isNull(), F.lit(n)) for n, v in values]))


def iso_date(text: Column) -> Column:
    """A date from ISO text; null if it is not exactly that."""
    return F.when((F.length(text) == 10) & text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text.try_cast("date"))


def age_days(as_of: Column, text: Column) -> Column:
    return F.datediff(as_of, iso_date(text))


def recent(as_of: Column, text: Column, days: int) -> Column:
    """Whether a date is at most ``days`` old. A date that cannot be read counts as recent, and so does one ahead."""
    return F.coalesce(age_days(as_of, text) <= days, F.lit(True))


def recent_between(as_of: Column, text: Column, days: int) -> Column:
    """Like ``recent``, but a date ahead is not recent."""
    return F.coalesce(age_days(as_of, F.substring(text, 1, 10)).between(0, days), F.lit(True))


def number(text: Column) -> Column:
    """A number from text with thousands separators and a currency sign; null if it is none."""
    plain = F.trim(F.regexp_replace(text, r"[,$]", ""))
    return F.when(plain.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), plain.try_cast("double"))


def severity(score: Column) -> Column:
    """Ladder of a 0 to 100 score."""
    return F.when(score >= 40, "high").when(score >= 15, "medium").when(score > 0, "low").otherwise("none")
