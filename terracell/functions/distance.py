"""Measures and distances as column expressions. Coordinates are planar."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terracell.functions import temporal
from terracell.functions.predicates import _edges
from terracell.functions.types import LINE, MULTILINE, MULTIPOINT, MULTIPOLYGON, POINT, POLYGON

_XYW = "struct<x:double,y:double,w:double>"


def _sum(items: Column, f) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda a, e: a + f(e))


def _ring_sums(ring: Column) -> Column:
    """Twice the signed area, and the moments that give the centroid, about the ring's first place."""
    ox, oy = ring[0]["x"], ring[0]["y"]
    zero = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("w"))

    def step(a: Column, e: Column) -> Column:
        ax, ay, bx, by = e["ax"] - ox, e["ay"] - oy, e["bx"] - ox, e["by"] - oy
        w = ax * by - bx * ay
        return F.struct((a["x"] + (ax + bx) * w).alias("x"), (a["y"] + (ay + by) * w).alias("y"), (a["w"] + w).alias("w"))

    return F.aggregate(_edges(ring), zero, step, lambda a: F.struct((a["x"] / 3 + ox * a["w"]).alias("x"), (a["y"] / 3 + oy * a["w"]).alias("y"), a["w"].alias("w")))


def st_area(st: Column) -> Column:
    """0 of points and lines; holes are taken off."""
    ring = lambda r, i: F.abs(_ring_sums(r)["w"]) / 2 * F.when(i == 0, 1.0).otherwise(-1.0)
    part = lambda p: _sum(F.transform(p, ring), lambda v: v)
    return F.when(st["gtype"].isin(POLYGON, MULTIPOLYGON), _sum(F.transform(st["parts"], part), lambda v: v)).otherwise(F.when(st["gtype"].isNotNull(), 0.0))


def _lengths(ring: Column) -> Column:
    length = lambda e: F.sqrt(F.pow(e["bx"] - e["ax"], 2) + F.pow(e["by"] - e["ay"], 2))
    return F.transform(_edges(ring), lambda e: F.struct(((e["ax"] + e["bx"]) / 2 * length(e)).alias("x"), ((e["ay"] + e["by"]) / 2 * length(e)).alias("y"), length(e).alias("w")))


def st_centroid(st: Column) -> Column:
    """struct<x, y>: by area, by length, or the mean of places, as the geometry's kind is."""

    def mean(items: Column) -> Column:
        w = _sum(items, lambda v: v["w"])
        return F.struct((_sum(items, lambda v: v["x"]) / w).alias("x"), (_sum(items, lambda v: v["y"]) / w).alias("y"))

    def rings(p: Column) -> Column:
        return F.transform(p, lambda r, i: F.transform(F.array(_ring_sums(r)), lambda s: F.struct(*[(s[n] * F.signum(s["w"]) * F.when(i == 0, 1.0).otherwise(-1.0)).alias(n) for n in "xyw"]))[0])

    parts = st["parts"]
    area = mean(F.flatten(F.transform(parts, rings)))
    line = mean(F.flatten(F.transform(parts, lambda p: _lengths(p[0]))))
    places = mean(F.transform(F.flatten(F.flatten(parts)), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), F.lit(1.0).alias("w"))))
    kind = st["gtype"]
    point = F.struct(st["xmin"].alias("x"), st["ymin"].alias("y"))
    return F.when(kind == POINT, point).when(kind.isin(POLYGON, MULTIPOLYGON) & (st_area(st) > 0), area).when(kind.isin(LINE, MULTILINE), line).when(kind.isNotNull() & (kind == MULTIPOINT), places).when(kind.isNotNull(), places)


def _middle(st: Column, points: bool) -> Column:
    return F.struct(st["xmin"].alias("x"), st["ymin"].alias("y")) if points else st_centroid(st)


def seuclid(a: Column, b: Column, points: bool = False) -> Column:
    """Distance of the centroids; `points` says that both are points, which saves working them out."""
    p, q = _middle(a, points), _middle(b, points)
    return F.sqrt((p["x"] - q["x"]) * (p["x"] - q["x"]) + (p["y"] - q["y"]) * (p["y"] - q["y"]))


def teuclid(a: Column, b: Column) -> Column:
    """Difference of the starts; null where a time is missing."""
    return temporal.t_gap(a, b)


def euclid(a: Column, b: Column, ws: float | None = None, wt: float | None = None, points: bool = False) -> Column:
    """struct<s, t>, or the weighted sum."""
    s, t = seuclid(a, b, points), teuclid(a, b)
    return F.struct(s.alias("s"), t.alias("t")) if ws is None else s * F.lit(float(ws)) + t * F.lit(float(wt))


def _border(st: Column) -> Column:
    """Vertices of the border: a polygon's rings, a line's ends; a point has none."""
    ends = lambda p: F.array(p[0][0], F.element_at(p[0], -1))
    return F.when(st["gtype"].isin(POLYGON, MULTIPOLYGON), F.flatten(F.flatten(st["parts"]))).when(st["gtype"].isin(LINE, MULTILINE), F.flatten(F.transform(st["parts"], ends)))


def shausdorff(a: Column, b: Column) -> Column:
    """Directed: the greatest of a's border vertices' least distances to b's; null where one has no border."""
    d = lambda p, q: F.sqrt(F.pow(p["x"] - q["x"], 2) + F.pow(p["y"] - q["y"], 2))
    return F.array_max(F.transform(_border(a), lambda p: F.array_min(F.transform(_border(b), lambda q: d(p, q)))))


def thausdorff(a: Column, b: Column) -> Column:
    """The greater difference of starts or ends; an open end counts as the start."""
    end = lambda s: F.coalesce(s["t_end"], s["t_start"])
    both = a["t_start"].isNotNull() & b["t_start"].isNotNull()
    return F.when(both, F.greatest(F.abs(a["t_start"] - b["t_start"]), F.abs(end(a) - end(b))).cast("double"))


def hausdorff(a: Column, b: Column, ws: float | None = None, wt: float | None = None) -> Column:
    s, t = shausdorff(a, b), thausdorff(a, b)
    return F.struct(s.alias("s"), t.alias("t")) if ws is None else s * F.lit(float(ws)) + t * F.lit(float(wt))


def corner_distance(xmin: Column, ymin: Column, xmax: Column, ymax: Column, x: Column, y: Column) -> Column:
    """Least distance of a place to a box's four corners."""
    return F.least(*[F.sqrt(F.pow(x - a, 2) + F.pow(y - b, 2)) for a in (xmin, xmax) for b in (ymin, ymax)])


def interval_less(a: Column, b: Column, equal: bool = False) -> Column:
    """Order of distances known as struct<min, max>: max below the other's min; with `equal`, max below or at the other's max."""
    return a["max"] <= b["max"] if equal else a["max"] < b["min"]


def envelope_distance(a: Column, b: Column) -> Column:
    """struct<min, max> of the distance of any two places in the envelopes."""
    gap = lambda p, q, r, s: F.greatest(r - q, p - s, F.lit(0.0))
    far = lambda p, q, r, s: F.greatest(F.abs(s - p), F.abs(q - r))
    axes = [(a[f"{c}min"], a[f"{c}max"], b[f"{c}min"], b[f"{c}max"]) for c in "xy"]
    made = [F.sqrt(sum((f(*ax) * f(*ax) for ax in axes), F.lit(0.0))) for f in (gap, far)]
    return F.struct(made[0].alias("min"), made[1].alias("max"))
