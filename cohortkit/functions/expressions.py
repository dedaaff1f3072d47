"""Column expressions used by more than one operator."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

from cohortkit.sources.lookups import DROP, ORIGIN_MONTH


def flag(condition: Column) -> Column:
    """1 where the condition holds, else 0 (NULL counts as not holding)."""
    return F.when(condition, 1).otherwise(0)


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def contains_any(text: Column, parts: Sequence[str]) -> Column:
    """Case-insensitive "contains at least one of these fragments"."""
    return any_of([F.lower(text).contains(p) for p in parts])


def month_start(date: Column) -> Column:
    """First day of the month, as a DATE."""
    return F.trunc(date, "month")


def month_index(month: Column, origin: tuple[int, int] = ORIGIN_MONTH) -> Column:
    """Whole months since the origin (year, month)."""
    return F.year(month) * 12 + F.month(month) - (origin[0] * 12 + origin[1])


def first_match(text: Column, labels: Sequence[str], drops: Sequence[str] = ()) -> Column:
    """First label contained in the text, else the drop marker, else NULL.

    A literal array filtered in the JVM: no Python worker, and NULL text gives
    NULL.  Order matters where one label is a substring of another.
    """
    hay = F.lower(text)
    hits = F.filter(F.array(*map(F.lit, dict.fromkeys(labels))), lambda label: hay.contains(label))
    found = F.get(hits, F.lit(0))
    return F.coalesce(found, F.when(contains_any(text, drops), F.lit(DROP))) if drops else found


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def within_days(date: Column, start: Column, lo, hi) -> Column:
    """``date`` in [start+lo, start+hi].

    ``lo`` / ``hi`` are whole days, or columns holding the bound itself; None
    leaves that side open.
    """
    bounds = []
    for bound, op in ((lo, "ge"), (hi, "le")):
        if bound is None:
            continue
        limit = bound if isinstance(bound, Column) else F.date_add(start, bound)
        bounds.append(date >= limit if op == "ge" else date <= limit)
    return reduce(lambda a, b: a & b, bounds, F.lit(True))
