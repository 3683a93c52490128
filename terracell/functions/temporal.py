"""Interval algebra on the time of spatio-temporal values. Intervals are closed; a null end leaves them open.

Every predicate gives true or false, never null; a value without a time is false here (see predicates.py for the rule of
space and time together).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terracell.functions.types import INTERVAL


def has_time(st: Column) -> Column:
    return st["t_kind"].isNotNull()


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _open(st: Column) -> Column:
    return st["t_end"].isNull()


def t_intersects(a: Column, b: Column) -> Column:
    return _true((_open(b) | (a["t_start"] <= b["t_end"])) & (_open(a) | (b["t_start"] <= a["t_end"]))) & has_time(a) & has_time(b)


def t_contains(a: Column, b: Column) -> Column:
    """An open interval is never contained, not even in itself."""
    return _true(~_open(b) & (b["t_start"] >= a["t_start"]) & (_open(a) | (b["t_end"] <= a["t_end"]))) & has_time(a) & has_time(b)


def t_containedby(a: Column, b: Column) -> Column:
    return t_contains(b, a)


def _before(a: Column, b: Column, strict: bool) -> Column:
    """An instant before a value's start; an interval, which must end, whose start and end both come before the other's."""
    less = (lambda p, q: p < q) if strict else (lambda p, q: p <= q)
    both = less(a["t_start"], b["t_start"])
    interval = ~_open(a) & both & (_open(b) | less(a["t_end"], b["t_end"]))
    return _true(F.when(a["t_kind"] == INTERVAL, interval).otherwise(both)) & has_time(a) & has_time(b)


def t_lt(a: Column, b: Column) -> Column:
    return _before(a, b, True)


def t_le(a: Column, b: Column) -> Column:
    return _before(a, b, False)


def t_gt(a: Column, b: Column) -> Column:
    return t_lt(b, a)


def t_ge(a: Column, b: Column) -> Column:
    return t_le(b, a)


def t_length(a: Column) -> Column:
    """0 for an instant, null for an open interval or no time."""
    return a["t_end"] - a["t_start"]


def t_center(a: Column) -> Column:
    """Middle by whole-number division; null for an open interval or no time."""
    return a["t_start"] + F.floor(t_length(a) / 2).cast("bigint")


def t_gap(a: Column, b: Column) -> Column:
    """Absolute difference of the starts; null without a time."""
    return F.abs(a["t_start"] - b["t_start"]).cast("double")


def t_min(*times: Column) -> Column:
    """Least of several instants; nulls don't count."""
    return F.least(*times)


def t_max(*times: Column) -> Column:
    return F.greatest(*times)
