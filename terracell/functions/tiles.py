"""Raster tiles: a struct of the upper left corner, width and height in pixels, a pixel's side, and values row by row from
the top. y grows upwards, so the pixel in column i and row j covers [ulx + i s, ulx + (i+1) s] x [uly - (j+1) s, uly - j s].
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from terracell.functions import kernel
from terracell.functions.types import COLLECTION, MULTIPOLYGON, POLYGON, st_box

TILE = "struct<ulx:double,uly:double,width:int,height:int,pixelwidth:double,values:array<double>>"
BUCKET = "struct<values:int,lowerBounds:double,upperBounds:double>"
FIELDS = ("ulx", "uly", "width", "height", "pixelwidth", "values")


def tile(ulx, uly, width, height, values, pixelwidth=1.0) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    made = [as_col(v).cast(k).alias(n) for v, n, k in zip((ulx, uly, width, height, pixelwidth, values), FIELDS, ("double", "double", "int", "int", "double", "array<double>"))]
    return F.struct(*made)


def square(width, height, values) -> Column:
    """With its lower left corner at the origin."""
    return tile(0.0, height, width, height, values)


def filled(ulx, uly, width, height, value, pixelwidth=1.0) -> Column:
    return tile(ulx, uly, width, height, F.array_repeat(F.lit(value).cast("double"), (width if isinstance(width, Column) else F.lit(width)) * (height if isinstance(height, Column) else F.lit(height))), pixelwidth)


def span(t: Column) -> tuple[Column, Column, Column, Column]:
    """xmin, ymin, xmax, ymax."""
    return t["ulx"], t["uly"] - t["height"] * t["pixelwidth"], t["ulx"] + t["width"] * t["pixelwidth"], t["uly"]


def st_geomfromtile(t: Column) -> Column:
    return st_box(*span(t))


def center(t: Column) -> Column:
    a, b, c, d = span(t)
    return F.struct(((a + c) / 2).alias("x"), ((b + d) / 2).alias("y"))


def from_box(xmin, ymin, xmax, ymax, value: float = 0.0, pixelwidth: float = 1.0) -> Column:
    """A tile that covers a box, filled with a value."""
    return filled(xmin, ymax, F.ceil((xmax - xmin) / pixelwidth).cast("int"), F.ceil((ymax - ymin) / pixelwidth).cast("int"), value, pixelwidth)


def from_box_computed(xmin, ymin, xmax, ymax, f: Callable[[Column, Column], Column], pixelwidth: float = 1.0) -> Column:
    """A tile that covers a box; f gives the value of each pixel from its upper left place."""
    t = filled(xmin, ymax, F.ceil((xmax - xmin) / pixelwidth).cast("int"), F.ceil((ymax - ymin) / pixelwidth).cast("int"), 0.0, pixelwidth)
    at = lambda i: f(t["ulx"] + F.pmod(i, t["width"]) * pixelwidth, t["uly"] - F.floor(i / t["width"]) * pixelwidth)
    return with_values(t, F.transform(t["values"], lambda _, i: at(i).cast("double")))


def tile_intersects(a: Column, b: Column) -> Column:
    """Borders count."""
    (p, q, r, s), (t, u, v, w) = span(a), span(b)
    return (p <= v) & (r >= t) & (q <= w) & (s >= u)


def tile_contains(a: Column, b: Column) -> Column:
    (p, q, r, s), (t, u, v, w) = span(a), span(b)
    return (p <= t) & (q <= u) & (r >= v) & (s >= w)


def col_row(t: Column, i: Column) -> Column:
    return F.struct(F.pmod(i, t["width"]).alias("col"), F.floor(i / t["width"]).cast("int").alias("row"))


def index_of(t: Column, x: Column, y: Column) -> Column:
    """Index of the pixel at a place."""
    col, row = (F.floor(F.abs(v) / t["pixelwidth"]).cast("int") for v in (x - t["ulx"], t["uly"] - y))
    return row * t["width"] + col


def value_at(t: Column, x: Column, y: Column) -> Column:
    return F.get(t["values"], index_of(t, x, y))


def value(t: Column, i: Column) -> Column:
    return F.get(t["values"], i)


def value_array(t: Column, col: Column, row: Column) -> Column:
    return F.get(t["values"], row * t["width"] + col)


def with_values(t: Column, values: Column) -> Column:
    return t.withField("values", values.cast("array<double>"))


def set_value(t: Column, i: Column, v: Column) -> Column:
    return with_values(t, F.transform(t["values"], lambda old, j: F.when(j == i, v.cast("double")).otherwise(old)))


def set_row(t: Column, row: Column, values: Column) -> Column:
    return with_values(t, F.transform(t["values"], lambda old, j: F.when(F.floor(j / t["width"]) == row, F.get(values, F.pmod(j, t["width"]))).otherwise(old)))


def map_values(t: Column, f: Callable[[Column], Column]) -> Column:
    return with_values(t, F.transform(t["values"], f))


def sma(t: Column) -> Column:
    """Least, greatest and middle value (of the values as they lie, not sorted); null of an empty tile."""
    v = t["values"]
    mid = F.get(v, F.floor(F.size(v) / 2).cast("int"))
    return F.when(F.size(v) > 0, F.struct(F.array_min(v).alias("min"), F.array_max(v).alias("max"), mid.alias("median")))


def r_min(t: Column) -> Column:
    return F.array_min(t["values"])


def r_max(t: Column) -> Column:
    return F.array_max(t["values"])


def r_median(t: Column) -> Column:
    return sma(t)["median"]


def matrix(t: Column) -> Column:
    """Text of the rows."""
    rows = F.transform(F.sequence(F.lit(0), t["height"] - 1), lambda j: F.array_join(F.transform(F.slice(t["values"], j * t["width"] + 1, t["width"]), lambda v: v.cast("string")), ", "))
    return F.when(t["width"] * t["height"] > 0, F.array_join(rows, "\n")).otherwise(F.lit(""))


def count_value(t: Column, v: float) -> Column:
    """Occurrences; tiles whose least or greatest value leaves v out aren't gone through."""
    return F.when((r_min(t) <= v) & (r_max(t) >= v), F.size(F.filter(t["values"], lambda x: x == F.lit(float(v))))).otherwise(0)


def has_value(t: Column, v: float) -> Column:
    return F.coalesce(F.array_contains(t["values"], F.lit(float(v))), F.lit(False))


def has_values(t: Column, values: list[float]) -> Column:
    wanted = F.array(*[F.lit(float(v)) for v in values])
    return F.coalesce((r_min(t) <= min(values)) & (r_max(t) >= max(values)) & (F.size(F.array_except(wanted, t["values"])) == 0), F.lit(False))


def histogram(t: Column, n: int = 10, drop_last: bool = False) -> Column:
    """Buckets of ceil(distinct / n) distinct values each, with the number of pixels; `drop_last` leaves the last one out."""
    v = F.array_sort(F.array_distinct(t["values"]))

    def buckets(u: Column) -> Column:
        each = F.ceil(F.size(u) / n).cast("int")
        total = F.ceil(F.size(u) / each).cast("int") - int(drop_last)

        def one(i: Column) -> Column:
            lo, hi = F.get(u, i * each), F.get(u, F.least((i + 1) * each, F.size(u)) - 1)
            return F.struct(F.size(F.filter(t["values"], lambda x: (x >= lo) & (x <= hi))).alias("values"), lo.alias("lowerBounds"), hi.alias("upperBounds"))

        return F.when(total > 0, F.transform(F.sequence(F.lit(0), F.greatest(total - 1, F.lit(0))), one)).otherwise(F.array().cast(f"array<{BUCKET}>"))

    return F.when(F.size(t["values"]) > 0, F.transform(F.array(v), buckets)[0]).otherwise(F.array().cast(f"array<{BUCKET}>"))


def h_value(b: Column) -> Column:
    return b["values"]


def h_lower(b: Column) -> Column:
    return b["lowerBounds"]


def h_upper(b: Column) -> Column:
    return b["upperBounds"]


def _pixels(t: Column, x0: Column, y0: Column, w: Column, h: Column, f: Callable[[Column, Column], Column]) -> Column:
    """f(left edge, upper edge) of each pixel of a tile of w by h from (x0, y0), with t's pixels."""
    s = t["pixelwidth"]
    return F.when(w * h > 0, F.transform(F.sequence(F.lit(0), w * h - 1), lambda i: f(x0 + F.pmod(i, w) * s, y0 - F.floor(i / w) * s)))


def mask_box(t: Column, xmin: Column, ymin: Column, xmax: Column, ymax: Column, default: float, name: str = "intersects") -> Column:
    """The part of a tile that a box covers; pixels that don't match become `default`. intersects: pixels that the box
    touches; other predicates: pixels inside the box."""
    a, b, c, d = span(t)
    x0, y1 = F.greatest(a, xmin), F.least(d, ymax)
    s = t["pixelwidth"]
    w = F.ceil((F.least(c, xmax) - x0) / s).cast("int")
    h = F.ceil((y1 - F.greatest(b, ymin)) / s).cast("int")
    here = (lambda x, y: (x <= xmax) & (x + s >= xmin) & (y - s <= ymax) & (y >= ymin)) if name == "intersects" else (lambda x, y: (x >= xmin) & (x + s <= xmax) & (y - s >= ymin) & (y <= ymax))
    values = _pixels(t, x0, y1, w, h, lambda x, y: F.when(here(x, y), F.coalesce(value_at(t, x, y), F.lit(float(default)))).otherwise(F.lit(float(default))))
    return F.when((w >= 0) & (h >= 0), tile(x0, y1, w, h, F.coalesce(values, F.array().cast("array<double>")), s))


def _clip(ring: list, box: tuple) -> list:
    """A ring cut to a box, edge by edge."""
    for axis, edge, sign in ((0, box[0], 1), (1, box[1], 1), (0, box[2], -1), (1, box[3], -1)):
        out, inside = [], lambda p, axis=axis, edge=edge, sign=sign: sign * (p[axis] - edge) >= 0
        for p, q in pairwise([*ring, *ring[:1]]):
            if inside(p):
                out.append(p)
            if inside(p) != inside(q):
                f = (edge - p[axis]) / (q[axis] - p[axis])
                cut = [p[0] + f * (q[0] - p[0]), p[1] + f * (q[1] - p[1])]
                cut[axis] = edge
                out.append(tuple(cut))
        ring = out
    return ring


def _border_and_inside(parts: list, areal: bool, x0: float, y1: float, w: int, h: int, s: float) -> tuple[np.ndarray, np.ndarray]:
    """Pixels that an edge may touch (or more), and those whose middle lies in the geometry; of h by w pixels from (x0, y1)."""
    border, inside = np.zeros((h, w), bool), np.zeros((h, w), bool)
    mx, my = x0 + s * (np.arange(w) + 0.5), y1 - s * (np.arange(h) + 0.5)
    for part in parts:
        odd = np.zeros((h, w), bool)
        for ring in part:
            places = [(p["x"], p["y"]) if isinstance(p, dict) else (p[0], p[1]) for p in ring]
            if areal and places[0] != places[-1]:
                places.append(places[0])
            for (ax, ay), (bx, by) in zip(places, places[1:] or places):
                i0, i1 = (max(0, min(w, int((v - x0) // s) + d)) for v, d in ((min(ax, bx), -1), (max(ax, bx), 2)))
                j0, j1 = (max(0, min(h, int((y1 - v) // s) + d)) for v, d in ((max(ay, by), -1), (min(ay, by), 2)))
                if i1 > i0 and j1 > j0:
                    x, y = mx[None, i0:i1], my[j0:j1, None]
                    side = np.stack([(bx - ax) * (y + q - ay) - (by - ay) * (x + p - ax) for p in (-s / 2, s / 2) for q in (-s / 2, s / 2)])
                    slack = 1e-9 * (1 + abs(side).max())
                    border[j0:j1, i0:i1] |= (side.min(axis=0) <= slack) & (side.max(axis=0) >= -slack)
                if areal and ay != by:
                    rows = (ay > my) != (by > my)
                    odd[rows] ^= mx[None, :] < ((bx - ax) * (my[rows] - ay) / (by - ay) + ax)[:, None]
        inside |= odd
    return border, inside


def mask_any(name: str = "intersects", default: float = 0.0):
    """As `mask_box` for any geometry: an Arrow function of the tile and the geometry's kind and parts.

    Pixels that no edge can touch are told by their middle; the exact kernel decides on the others.
    """

    def run(t: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        out = []
        for ulx, uly, w, h, s, values, kind, parts in zip(*(t[f] for f in FIELDS), g["gtype"], g["parts"]):
            shape = kernel.Shape(int(kind), parts)
            box = (ulx, uly - h * s, ulx + w * s, uly)
            if int(kind) == POLYGON:
                places = _clip([(p["x"], p["y"]) for p in parts[0][0][:-1]], box)
            else:
                places = [(min(max(p["x"], box[0]), box[2]), min(max(p["y"], box[1]), box[3])) for part in parts for r in part for p in r]
            if not places:
                out.append((None,) * 6)
                continue
            x0, x1, y0, y1 = (f(p[i] for p in places) for i in (0, 1) for f in (min, max))
            nw, nh = -int(-(x1 - x0) / s // 1), -int(-(y1 - y0) / s // 1)
            border, fits = _border_and_inside(parts, int(kind) in (POLYGON, MULTIPOLYGON), x0, y1, nw, nh, s)
            border |= int(kind) == COLLECTION  # of mixed kinds, for the kernel
            for j, i in zip(*np.nonzero(border)):
                x, y = x0 + s * int(i), y1 - s * int(j)
                pixel = kernel.Shape(POLYGON, [[[(x, y - s), (x + s, y - s), (x + s, y), (x, y), (x, y - s)]]])
                fits[j, i] = kernel.intersects(shape, pixel) if name == "intersects" else kernel.contains(shape, pixel)
            rows, cols = ((uly - (y1 - s * np.arange(nh))) / s).astype(int), (abs(x0 + s * np.arange(nw) - ulx) / s).astype(int)
            k = rows[:, None] * w + cols[None, :]
            held = np.asarray(values, float)
            fits &= (k >= 0) & (k < len(held))
            made = np.where(fits, held[np.clip(k, 0, max(len(held) - 1, 0))] if len(held) else float(default), float(default))
            out.append((x0, y1, nw, nh, s, made.ravel().tolist()))
        return pd.DataFrame(out, columns=list(FIELDS))

    run.__annotations__ = {"t": pd.DataFrame, "g": pd.DataFrame, "return": pd.DataFrame}
    return F.pandas_udf(run, TILE)


def overlay(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    """f(value of a, value of b) over the common part of two tiles with pixels of one size."""
    p, q = span(a), span(b)
    x0, y0, x1, y1 = F.greatest(p[0], q[0]), F.greatest(p[1], q[1]), F.least(p[2], q[2]), F.least(p[3], q[3])
    s = a["pixelwidth"]
    w, h = F.ceil((x1 - x0) / s).cast("int"), F.ceil((y1 - y0) / s).cast("int")
    middle = lambda x, y: (x + s / 2, y - s / 2)
    values = _pixels(a, x0, y1, w, h, lambda x, y: f(value_at(a, *middle(x, y)), value_at(b, *middle(x, y))))
    return F.when((w > 0) & (h > 0), tile(x0, y1, w, h, values, s))
