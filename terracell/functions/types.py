"""The spatio-temporal value: a struct of a geometry, its envelope and an optional time.

`gtype` is one of KINDS by index; `parts` holds the rings of each part (a point is one part of one ring of one place, a
polygon one part whose first ring is the shell); xmin to ymax is the envelope, which storage can prune by; `t_kind` is
null without a time, 1 for an instant, 2 for an interval, whose null `t_end` leaves it open. Times are whole numbers in a
unit that the user chooses (the SQL constructors use seconds since 1970). zmin and zmax are the least and greatest height,
null without one; predicates and measures are of the plane and leave heights out.

A value whose coordinates are partly null is null: its gtype is, and no predicate holds of it. The envelope's fields are the
coordinates themselves, with nothing around them, so that comparisons of a made value reach the scan of its columns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = ("POINT", "LINESTRING", "POLYGON", "MULTIPOINT", "MULTILINESTRING", "MULTIPOLYGON", "GEOMETRYCOLLECTION")
POINT, LINE, POLYGON, MULTIPOINT, MULTILINE, MULTIPOLYGON, COLLECTION = range(7)
INSTANT, INTERVAL = 1, 2
PLACE = "struct<x:double,y:double>"
PARTS = f"array<array<array<{PLACE}>>>"
ST = f"struct<gtype:tinyint,parts:{PARTS},xmin:double,ymin:double,xmax:double,ymax:double,t_kind:tinyint,t_start:bigint,t_end:bigint,zmin:double,zmax:double>"

_Value = Column | float | int | str | None


def _col(v: _Value, kind: str) -> Column:
    return (F.col(v) if isinstance(v, str) else v if isinstance(v, Column) else F.lit(v)).cast(kind)


def place(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def time_fields(instant: _Value = None, start: _Value = None, end: _Value = None) -> list[Column]:
    """t_kind, t_start, t_end; an instant, or an interval from `start` that a null `end` leaves open, or no time.

    A null instant or start gives no time.
    """
    if instant is not None:
        s = _col(instant, "bigint")
        e, kind = s, INSTANT
    elif start is not None:
        s, e, kind = _col(start, "bigint"), _col(end, "bigint"), INTERVAL
    else:
        s = e = F.lit(None).cast("bigint")
        kind = 0
    return [F.when(s.isNotNull(), F.lit(kind)).cast("tinyint").alias("t_kind"), s.alias("t_start"), F.when(s.isNotNull(), e).alias("t_end")]


def _st(gtype: int, parts: Column, env: list[Column], time: list[Column], known: Column | None = None, z: _Value = None) -> Column:
    names = ("xmin", "ymin", "xmax", "ymax")
    kind = F.lit(gtype).cast("tinyint")
    return F.struct((kind if known is None else F.when(known, kind)).alias("gtype"), parts.cast(PARTS).alias("parts"), *[c.cast("double").alias(n) for c, n in zip(env, names)], *time, *[_col(z, "double").alias(n) for n in ("zmin", "zmax")])


def st_point(x: _Value, y: _Value, instant: _Value = None, start: _Value = None, end: _Value = None, z: _Value = None) -> Column:
    """Null (see above) where x or y is. A height z may be null."""
    x, y = _col(x, "double"), _col(y, "double")
    return _st(POINT, F.array(F.array(F.array(place(x, y)))), [x, y, x, y], time_fields(instant, start, end), x.isNotNull() & y.isNotNull(), z)


def st_box(xmin: _Value, ymin: _Value, xmax: _Value, ymax: _Value, instant: _Value = None, start: _Value = None, end: _Value = None) -> Column:
    """A rectangle along the axes."""
    a, b, c, d = (_col(v, "double") for v in (xmin, ymin, xmax, ymax))
    ring = F.array(place(a, b), place(c, b), place(c, d), place(a, d), place(a, b))
    return _st(POLYGON, F.array(F.array(ring)), [a, b, c, d], time_fields(instant, start, end), a.isNotNull() & b.isNotNull() & c.isNotNull() & d.isNotNull())


def st_polygon(shell: list[tuple], holes: list[list[tuple]] | None = None, instant: _Value = None, start: _Value = None, end: _Value = None) -> Column:
    """From rings of (x, y), each a number or a column; rings are closed where they aren't."""
    rings = [[*r, r[0]] if r[0] != r[-1] else list(r) for r in [shell, *(holes or [])]]
    made = F.array(*[F.array(*[place(_col(x, "double"), _col(y, "double")) for x, y in r]) for r in rings])
    xs, ys = ([_col(p[i], "double") for p in rings[0]] for i in (0, 1))
    return _st(POLYGON, F.array(made), [F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys)], time_fields(instant, start, end))


def st_line(places: list[tuple], instant: _Value = None, start: _Value = None, end: _Value = None) -> Column:
    xs, ys = ([_col(p[i], "double") for p in places] for i in (0, 1))
    line = F.array(*[place(x, y) for x, y in zip(xs, ys)])
    return _st(LINE, F.array(F.array(line)), [F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys)], time_fields(instant, start, end))


def with_time(st: Column, instant: _Value = None, start: _Value = None, end: _Value = None) -> Column:
    """The same geometry with another time, or none."""
    out = st
    for c, n in zip(time_fields(instant, start, end), ("t_kind", "t_start", "t_end")):
        out = out.withField(n, c)
    return out


def is_null(st: Column) -> Column:
    return st["gtype"].isNull()


def x(st: Column) -> Column:
    """Of a point."""
    return st["xmin"]


def y(st: Column) -> Column:
    return st["ymin"]


def shell(st: Column) -> Column:
    """First ring of the first part."""
    return st["parts"][0][0]


def is_box(st: Column) -> Column:
    """A polygon of one ring of five places, all at the corners of its envelope, each at another corner."""
    ring = shell(st)
    corner = lambda p: ((p["x"] == st["xmin"]) | (p["x"] == st["xmax"])) & ((p["y"] == st["ymin"]) | (p["y"] == st["ymax"]))
    one = (st["gtype"] == POLYGON) & (F.size(st["parts"]) == 1) & (F.size(st["parts"][0]) == 1) & (F.size(ring) == 5)
    return one & (st["xmin"] < st["xmax"]) & (st["ymin"] < st["ymax"]) & F.forall(ring, corner) & (F.size(F.array_distinct(ring)) == 4) & ((ring[0]["x"] == ring[1]["x"]) | (ring[0]["y"] == ring[1]["y"]))
