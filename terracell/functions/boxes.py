"""Points and boxes of any number of dimensions, as expressions: a point is array<double>, a box struct<lo, hi> of two points.

Boxes are right-open, as cells are: a box holds its lower corner and not its upper one.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Differences that don't count.
EPS = 1e-6


def point(*values: Column | float) -> Column:
    return F.array(*[(v if isinstance(v, Column) else F.lit(v)).cast("double") for v in values])


def box(lo: Column, hi: Column) -> Column:
    """From two corners, in any order on each axis."""
    return F.struct(merge_min(lo, hi).alias("lo"), merge_max(lo, hi).alias("hi"))


def everything(dims: int) -> Column:
    """The box around all points."""
    return F.struct(point(*[float("-inf")] * dims).alias("lo"), point(*[float("inf")] * dims).alias("hi"))


def nothing(dims: int) -> Column:
    """The box that extending by any point gives that point: a zero of `extend`."""
    return F.struct(point(*[float("inf")] * dims).alias("lo"), point(*[float("-inf")] * dims).alias("hi"))


def _each(a: Column, b: Column, f) -> Column:
    return F.zip_with(a, b, f)


def _all(a: Column, b: Column, f) -> Column:
    """False, too, of points with different numbers of dimensions."""
    return (F.size(a) == F.size(b)) & F.forall(_each(a, b, f), lambda v: F.coalesce(v, F.lit(False)))


def merge_min(a: Column, b: Column) -> Column:
    return _each(a, b, lambda p, q: F.least(p, q))


def merge_max(a: Column, b: Column) -> Column:
    return _each(a, b, lambda p, q: F.greatest(p, q))


def with_value(p: Column, axis: int, v: Column | float) -> Column:
    """The point with another value on one axis, counted from 0."""
    new = v if isinstance(v, Column) else F.lit(v)
    return F.transform(p, lambda old, i: F.when(i == axis, new.cast("double")).otherwise(old))


def near(a: Column, b: Column, eps: float = EPS) -> Column:
    """Points that differ by less than eps on every axis."""
    return _all(a, b, lambda p, q: F.abs(p - q) < eps)


def contains_point(b: Column, p: Column) -> Column:
    return _all(b["lo"], p, lambda lo, v: v >= lo) & _all(b["hi"], p, lambda hi, v: v < hi)


def contains(a: Column, b: Column) -> Column:
    return _all(a["lo"], b["lo"], lambda p, q: q >= p) & _all(a["hi"], b["hi"], lambda p, q: q <= p)


def intersects(a: Column, b: Column) -> Column:
    """Borders count."""
    return _all(a["lo"], b["hi"], lambda p, q: p <= q) & _all(a["hi"], b["lo"], lambda p, q: p >= q)


def near_box(a: Column, b: Column, eps: float = EPS) -> Column:
    return near(a["lo"], b["lo"], eps) & near(a["hi"], b["hi"], eps)


def extend(a: Column, b: Column) -> Column:
    """The least box around two."""
    return F.struct(merge_min(a["lo"], b["lo"]).alias("lo"), merge_max(a["hi"], b["hi"]).alias("hi"))


def extend_point(b: Column, p: Column, eps: float = 0.0) -> Column:
    """The least box around a box and a point; eps more at the upper ends that the point moves, so that it lies inside."""
    hi = _each(b["hi"], p, lambda h, v: F.when(v >= h, v + eps).otherwise(h))
    return F.struct(merge_min(b["lo"], p).alias("lo"), hi.alias("hi"))


def grown(b: Column, eps: float) -> Column:
    """Larger by eps on every side."""
    return F.struct(F.transform(b["lo"], lambda v: v - eps).alias("lo"), F.transform(b["hi"], lambda v: v + eps).alias("hi"))


def overlap(a: Column, b: Column) -> Column:
    """What two boxes share; null if nothing."""
    made = F.struct(merge_max(a["lo"], b["lo"]).alias("lo"), merge_min(a["hi"], b["hi"]).alias("hi"))
    return F.when(_all(made["lo"], made["hi"], lambda p, q: p < q), made)


def _slab(a: Column, b: Column, i: int, lower: bool) -> Column:
    """The part of box a below (or above) box b on axis i, cut to b on the axes before; null if there is none."""
    lo = F.transform(a["lo"], lambda v, j: F.when(j < i, F.greatest(v, b["lo"][j])).when((j == i) & F.lit(not lower), F.greatest(v, b["hi"][j])).otherwise(v))
    hi = F.transform(a["hi"], lambda v, j: F.when(j < i, F.least(v, b["hi"][j])).when((j == i) & F.lit(lower), F.least(v, b["lo"][j])).otherwise(v))
    return F.when(_all(lo, hi, lambda p, q: p < q), F.struct(lo.alias("lo"), hi.alias("hi")))


def difference(a: Column, b: Column, dims: int) -> Column:
    """Boxes that make up what of a is outside of b: a itself where they share nothing, and none where a holds nothing."""
    parts = F.filter(F.array(*[_slab(a, b, i, lower) for i in range(dims) for lower in (True, False)]), lambda x: x.isNotNull())
    whole = F.array(F.struct(a["lo"].alias("lo"), a["hi"].alias("hi")))
    return F.when(~_all(a["lo"], a["hi"], lambda p, q: p < q), F.slice(whole, 1, 0)).when(overlap(a, b).isNull(), whole).otherwise(parts)


def lengths(b: Column) -> Column:
    return _each(b["lo"], b["hi"], lambda p, q: q - p)


def center(b: Column) -> Column:
    return _each(b["lo"], b["hi"], lambda p, q: p + (q - p) / 2)


def volume(b: Column) -> Column:
    return F.aggregate(lengths(b), F.lit(1.0), lambda a, v: a * v)


def corners(b: Column, dims: int) -> Column:
    """All corners, the last axis changing first."""
    return F.array(*[F.array(*[(b["hi"] if up else b["lo"])[i] for i, up in enumerate(c)]) for c in product((False, True), repeat=dims)])
