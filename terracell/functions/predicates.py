"""Predicates of space and time together.

`pred(a, b)` holds where the geometries' predicate does and either neither value has a time, or both have one and the
times' predicate holds too. It is never null; a null value gives false.

Points, rectangles and point-in-polygon are column expressions. `kinds="any"` brings in the exact kernel, an Arrow
function, which runs after the envelopes' test.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from terracell.functions import kernel, temporal
from terracell.functions.types import MULTIPOLYGON, POINT, POLYGON, is_box, is_null

TIMES = {"intersects": temporal.t_intersects, "contains": temporal.t_contains, "containedby": temporal.t_containedby, "covers": temporal.t_contains, "coveredby": temporal.t_containedby}
FLIPPED = {"intersects": "intersects", "contains": "containedby", "containedby": "contains", "covers": "coveredby", "coveredby": "covers"}


def envelopes_meet(a: Column, b: Column) -> Column:
    return (a["xmin"] <= b["xmax"]) & (a["xmax"] >= b["xmin"]) & (a["ymin"] <= b["ymax"]) & (a["ymax"] >= b["ymin"])


def envelope_covers(a: Column, b: Column) -> Column:
    return (a["xmin"] <= b["xmin"]) & (a["xmax"] >= b["xmax"]) & (a["ymin"] <= b["ymin"]) & (a["ymax"] >= b["ymax"])


def envelope_test(name: str, a: Column, b: Column) -> Column:
    """What must hold of the envelopes: plain comparisons, which reach the scan."""
    return {"intersects": envelopes_meet, "contains": envelope_covers, "covers": envelope_covers, "containedby": lambda p, q: envelope_covers(q, p), "coveredby": lambda p, q: envelope_covers(q, p)}[name](a, b)


def _edges(ring: Column) -> Column:
    n = F.size(ring)
    return F.zip_with(F.slice(ring, 1, n - 1), F.slice(ring, 2, n - 1), lambda p, q: F.struct(p["x"].alias("ax"), p["y"].alias("ay"), q["x"].alias("bx"), q["y"].alias("by")))


def point_in_rings(px: Column, py: Column, rings: Column) -> Column:
    """1 inside, 0 on the border, -1 outside of a polygon with holes."""

    def on(e: Column) -> Column:
        cross = (e["bx"] - e["ax"]) * (py - e["ay"]) - (e["by"] - e["ay"]) * (px - e["ax"])
        return (cross == 0) & (px >= F.least(e["ax"], e["bx"])) & (px <= F.greatest(e["ax"], e["bx"])) & (py >= F.least(e["ay"], e["by"])) & (py <= F.greatest(e["ay"], e["by"]))

    def crossed(e: Column) -> Column:
        return F.when((e["ay"] > py) != (e["by"] > py), ((e["bx"] - e["ax"]) * (py - e["ay"]) / (e["by"] - e["ay"]) + e["ax"] > px).cast("int")).otherwise(0)

    edges = F.flatten(F.transform(rings, _edges))
    odd = F.aggregate(edges, F.lit(0), lambda n, e: n + crossed(e)) % 2 == 1
    return F.when(F.exists(edges, on), 0).when(odd, 1).otherwise(-1)


def point_in_polygon(p: Column, g: Column) -> Column:
    """Of a point and a polygon or several; the best of the parts."""
    return F.when(F.size(g["parts"]) == 1, point_in_rings(p["xmin"], p["ymin"], g["parts"][0])).otherwise(F.array_max(F.transform(g["parts"], lambda part: point_in_rings(p["xmin"], p["ymin"], part))))


def _areal(g: Column) -> Column:
    return g["gtype"].isin(POLYGON, MULTIPOLYGON)


def simple_spatial(name: str, a: Column, b: Column) -> Column:
    """By expression: points with points, points with polygons, rectangles with rectangles; null of other pairs."""
    same = (a["xmin"] == b["xmin"]) & (a["ymin"] == b["ymin"])
    pa, pb = a["gtype"] == POINT, b["gtype"] == POINT
    if name in ("containedby", "coveredby"):
        return simple_spatial(FLIPPED[name], b, a)
    least = {"intersects": 0, "contains": 1, "covers": 0}[name]
    boxes = envelopes_meet(a, b) if name == "intersects" else envelope_covers(a, b)
    out = F.when(pa & pb, same).when(pb & _areal(a), envelopes_meet(a, b) & (point_in_polygon(b, a) >= least))
    if name == "intersects":
        out = out.when(pa & _areal(b), envelopes_meet(a, b) & (point_in_polygon(a, b) >= least))
    else:
        out = out.when(pa & _areal(b), F.lit(False))
    return out.when(is_box(a) & is_box(b), boxes)


def _exact(name: str) -> Callable:
    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.Series:
        test, seen = kernel.TESTS[name], {}

        def shape(kind, parts):
            if kind is None or pd.isna(kind) or parts is None:
                return None
            key = (int(kind), str(parts)) if len(parts) == 1 and len(parts[0][0]) < 64 else None
            if key is None:
                return kernel.Shape(int(kind), parts)
            if key not in seen:
                if len(seen) > 1000:
                    seen.clear()
                seen[key] = kernel.Shape(*((int(kind), parts)))
            return seen[key]

        out = []
        for ka, ga, kb, gb in zip(a["gtype"], a["parts"], b["gtype"], b["parts"]):
            p, q = shape(ka, ga), shape(kb, gb)
            out.append(bool(p is not None and q is not None and test(p, q)))
        return pd.Series(out, dtype=bool)

    run.__name__ = f"st_{name}"
    run.__annotations__ = {"a": pd.DataFrame, "b": pd.DataFrame, "return": pd.Series}
    return F.pandas_udf(run, "boolean")


def known_spatial(name: str, a: Column, b: Column, kinds: tuple[str, str]) -> Column:
    """Of values that the caller vouches for: "point", "box" or "polygon" on either side. Short expressions, no tests of kind."""
    if name in ("containedby", "coveredby"):
        return known_spatial(FLIPPED[name], b, a, kinds[::-1])
    if kinds == ("point", "point"):
        return (a["xmin"] == b["xmin"]) & (a["ymin"] == b["ymin"])
    if kinds == ("box", "box"):
        return envelopes_meet(a, b) if name == "intersects" else envelope_covers(a, b)
    if kinds == ("box", "point"):
        inside = (b["xmin"] > a["xmin"]) & (b["xmin"] < a["xmax"]) & (b["ymin"] > a["ymin"]) & (b["ymin"] < a["ymax"])
        return inside if name == "contains" else envelopes_meet(a, b)
    if kinds == ("polygon", "point"):
        return envelopes_meet(a, b) & (point_in_polygon(b, a) >= (1 if name == "contains" else 0))
    if kinds in (("point", "box"), ("point", "polygon")):
        return known_spatial(name, b, a, kinds[::-1]) if name == "intersects" else F.lit(False)
    raise ValueError(f"no short form for {kinds}")


def plain_spatial(name: str, a: Column, b: Column) -> Column:
    """By comparisons alone, which round nothing: points with points and rectangles, rectangles with rectangles; null of other pairs."""
    if name in ("containedby", "coveredby"):
        return plain_spatial(FLIPPED[name], b, a)
    pa, pb = a["gtype"] == POINT, b["gtype"] == POINT
    inside = (b["xmin"] > a["xmin"]) & (b["xmin"] < a["xmax"]) & (b["ymin"] > a["ymin"]) & (b["ymin"] < a["ymax"])
    boxes = envelopes_meet(a, b) if name == "intersects" else envelope_covers(a, b)
    out = F.when(pa & pb, (a["xmin"] == b["xmin"]) & (a["ymin"] == b["ymin"]))
    out = out.when(pb & is_box(a), inside if name == "contains" else envelopes_meet(a, b))
    return out.when(pa & is_box(b), envelopes_meet(a, b) if name == "intersects" else F.lit(False)).when(is_box(a) & is_box(b), boxes)


def spatial(name: str, a: Column, b: Column, kinds: str | tuple[str, str] = "simple") -> Column:
    """The geometries' predicate alone; false, not null, of null values. Other pairs than the simple ones need kinds="any".
    A pair of kinds, such as ("point", "box"), says what the values are and gives a shorter expression."""
    if isinstance(kinds, tuple):
        return F.coalesce(known_spatial(name, a, b, kinds) & ~is_null(a) & ~is_null(b), F.lit(False))
    if kinds == "any":
        near, plain = F.coalesce(envelope_test(name, a, b), F.lit(False)), plain_spatial(name, a, b)
        # what comparisons decide reaches the kernel as nulls
        pick = lambda g: F.struct(*[F.when(near & plain.isNull(), g[n]).alias(n) for n in ("gtype", "parts")])
        return near & F.coalesce(plain, _exact(name)(pick(a), pick(b)))
    simple = simple_spatial(name, a, b)
    known = F.when(simple.isNull() & ~is_null(a) & ~is_null(b) & (F.size(a["parts"]) > 0) & (F.size(b["parts"]) > 0), F.raise_error(F.lit(f"{name}: these geometries need kinds='any'")).cast("boolean")).otherwise(simple)
    return F.coalesce(F.coalesce(envelope_test(name, a, b), F.lit(False)) & known, F.lit(False))


def time_rule(name: str, a: Column, b: Column) -> Column:
    none = a["t_kind"].isNull() & b["t_kind"].isNull()
    return none | TIMES[name](a, b)


def predicate(name: str, a: Column, b: Column, kinds: str | tuple[str, str] = "simple") -> Column:
    return spatial(name, a, b, kinds) & time_rule(name, a, b)


def st_equals(a: Column, b: Column, kinds: str | tuple[str, str] = "simple") -> Column:
    """The same places, however they are written down, and the same time or none on either side; false of null values."""
    same = (a["xmin"] == b["xmin"]) & (a["ymin"] == b["ymin"]) & (a["xmax"] == b["xmax"]) & (a["ymax"] == b["ymax"])
    time = a["t_kind"].eqNullSafe(b["t_kind"]) & a["t_start"].eqNullSafe(b["t_start"]) & a["t_end"].eqNullSafe(b["t_end"])
    return F.coalesce(same, F.lit(False)) & time & spatial("covers", a, b, kinds) & spatial("coveredby", a, b, kinds)


def st_intersects(a: Column, b: Column, kinds: str | tuple[str, str] = "simple") -> Column:
    return predicate("intersects", a, b, kinds)


def st_contains(a: Column, b: Column, kinds: str | tuple[str, str] = "simple") -> Column:
    return predicate("contains", a, b, kinds)


def st_containedby(a: Column, b: Column, kinds: str | tuple[str, str] = "simple") -> Column:
    return predicate("containedby", a, b, kinds)


def st_covers(a: Column, b: Column, kinds: str | tuple[str, str] = "simple") -> Column:
    return predicate("covers", a, b, kinds)


def st_coveredby(a: Column, b: Column, kinds: str | tuple[str, str] = "simple") -> Column:
    return predicate("coveredby", a, b, kinds)


def box_contains_point(lo: tuple[Column, Column], hi: tuple[Column, Column], x: Column, y: Column) -> Column:
    """Right-open boxes, as cells are."""
    return (x >= lo[0]) & (x < hi[0]) & (y >= lo[1]) & (y < hi[1])
