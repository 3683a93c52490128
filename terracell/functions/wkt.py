"""Well-known text: a parser, a writer, and both as columns."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from terracell.functions.types import COLLECTION, KINDS, LINE, MULTILINE, MULTIPOINT, MULTIPOLYGON, PARTS, POINT, POLYGON, ST, st_point, with_time

_TOKEN = re.compile(r"\s*([A-Za-z]+|[-+0-9.][-+0-9.eE]*|[(),])")
_GEOMETRY = f"struct<gtype:tinyint,parts:{PARTS},xmin:double,ymin:double,xmax:double,ymax:double,zmin:double,zmax:double>"


def parse(text: str, heights: list[float] | None = None) -> tuple[int, list]:
    """(kind, parts) with places as (x, y); third coordinates that are heights go to `heights`. Bad text raises ValueError."""
    tokens, at = [], 0
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"bad geometry text: {text[:100]!r}")
        tokens.append(m[1])
        at = m.end()
    pos, measured = 0, False

    def take(want: str | None = None) -> str:
        nonlocal pos
        if pos >= len(tokens) or want is not None and tokens[pos] != want:
            raise ValueError(f"bad geometry text: {text[:100]!r}")
        pos += 1
        return tokens[pos - 1]

    def listed(item):
        take("(")
        out = [item()]
        while pos < len(tokens) and tokens[pos] == ",":
            take()
            out.append(item())
        take(")")
        return out

    def spot() -> tuple[float, float]:
        numbers = []
        while pos < len(tokens) and tokens[pos] not in "(),":
            numbers.append(float(take()))
        if not 2 <= len(numbers) <= 4:
            raise ValueError(f"bad geometry text: {text[:100]!r}")
        if len(numbers) > 2 and heights is not None and not measured:
            heights.append(numbers[2])
        return numbers[0], numbers[1]

    def geometry() -> tuple[int, list]:
        name = take().upper()
        if name not in KINDS:
            raise ValueError(f"unknown geometry {name!r}")
        nonlocal measured
        if pos < len(tokens) and tokens[pos].upper() in ("Z", "M", "ZM"):
            measured = take().upper() == "M"
        kind = KINDS.index(name)
        if pos < len(tokens) and tokens[pos].upper() == "EMPTY":
            take()
            return kind, []
        if kind == POINT:
            return kind, [[listed(spot)]]
        if kind == LINE:
            return kind, [[listed(spot)]]
        if kind == POLYGON:
            return kind, [listed(lambda: listed(spot))]
        if kind == MULTIPOINT:
            return kind, [[[p]] for p in listed(lambda: listed(spot)[0] if tokens[pos] == "(" else spot())]
        if kind == MULTILINE:
            return kind, [[line] for line in listed(lambda: listed(spot))]
        if kind == MULTIPOLYGON:
            return kind, listed(lambda: listed(lambda: listed(spot)))
        return kind, [part for _, parts in listed(geometry) for part in parts]

    out = geometry()
    if pos != len(tokens):
        raise ValueError(f"bad geometry text: {text[:100]!r}")
    return out


def number(v: float) -> str:
    """Without an exponent and without trailing zeros."""
    s = format(v, "f") if abs(v) >= 1e15 else repr(float(v))
    if "e" in s or "E" in s:
        from decimal import Decimal

        s = format(Decimal(s), "f")
    return s.rstrip("0").rstrip(".") if "." in s else s


def write(gtype: int, parts: list) -> str:
    spot = lambda p: f"{number(p[0])} {number(p[1])}"
    ring = lambda r: "(" + ", ".join(map(spot, r)) + ")"
    name = KINDS[gtype]
    if not parts:
        return f"{name} EMPTY"
    if gtype in (POINT, LINE):
        return f"{name} {ring(parts[0][0])}"
    if gtype == POLYGON:
        return f"{name} ({', '.join(map(ring, parts[0]))})"
    if gtype == MULTIPOINT:
        return f"{name} ({', '.join(ring(p[0]) for p in parts)})"
    if gtype == MULTILINE:
        return f"{name} ({', '.join(ring(p[0]) for p in parts)})"
    return f"{name} ({', '.join('(' + ', '.join(map(ring, p)) + ')' for p in parts)})"


def _row(text: str) -> dict:
    heights: list[float] = []
    kind, parts = parse(text, heights)
    xs, ys = ([p[i] for part in parts for r in part for p in r] for i in (0, 1))
    env = (min(xs), min(ys), max(xs), max(ys)) if xs else (None,) * 4
    return {"gtype": kind, "parts": [[[{"x": a, "y": b} for a, b in r] for r in part] for part in parts], **dict(zip(("xmin", "ymin", "xmax", "ymax"), env)), "zmin": min(heights, default=None), "zmax": max(heights, default=None)}


def literal(text: str, instant=None, start=None, end=None) -> Column:
    """A constant value, parsed once on the driver."""
    row = _row(text)
    rings = lambda part: F.array(*[F.array(*[F.struct(F.lit(p["x"]).alias("x"), F.lit(p["y"]).alias("y")) for p in r]) for r in part])
    parts = F.array(*[rings(p) for p in row["parts"]]) if row["parts"] else F.array()
    env = [F.lit(row[n]).cast("double").alias(n) for n in ("xmin", "ymin", "xmax", "ymax")]
    none = [F.lit(None).cast(k).alias(n) for n, k in (("t_kind", "tinyint"), ("t_start", "bigint"), ("t_end", "bigint"))] + [F.lit(row[n]).cast("double").alias(n) for n in ("zmin", "zmax")]
    return with_time(F.struct(F.lit(row["gtype"]).cast("tinyint").alias("gtype"), parts.cast(PARTS).alias("parts"), *env, *none), instant, start, end)


def _parsed(texts: pd.Series) -> pd.DataFrame:
    if texts.isna().any():
        raise ValueError("a geometry's text is null")
    return pd.DataFrame([_row(t) for t in texts], columns=["gtype", "parts", "xmin", "ymin", "xmax", "ymax", "zmin", "zmax"])


def st_geomfromwkt(text: Column | str, instant=None, start=None, end=None) -> Column:
    """Any geometry; bad and null texts raise. For points alone, `st_pointfromwkt` stays out of Python."""
    g = F.pandas_udf(_parsed, _GEOMETRY)(F.col(text) if isinstance(text, str) else text)
    none = [F.lit(None).cast(k).alias(n) for n, k in (("t_kind", "tinyint"), ("t_start", "bigint"), ("t_end", "bigint"))]
    st = F.struct(*[g[n].alias(n) for n in ("gtype", "parts", "xmin", "ymin", "xmax", "ymax")], *none, g["zmin"], g["zmax"]).cast(ST)
    return with_time(st, instant, start, end) if instant is not None or start is not None else st


def st_pointfromwkt(text: Column | str, instant=None, start=None, end=None) -> Column:
    """POINT texts by expression; other texts give null."""
    t, n = F.col(text) if isinstance(text, str) else text, r"([-+]?[0-9.]+(?:[eE][-+]?[0-9]+)?)"
    pattern = rf"^\s*(?i:POINT)\s*\(\s*{n}\s+{n}\s*\)\s*$"
    part = lambda i: F.nullif(F.regexp_extract(t, pattern, i), F.lit("")).cast("double")
    return st_point(part(1), part(2), instant, start, end)


def _number(c: Column) -> Column:
    plain = F.when((F.abs(c) < 1e15) & (c == F.floor(c)), c.cast("bigint").cast("string"))
    tiny = F.regexp_replace(F.format_string("%.20f", c), r"\.?0+$", "")
    return plain.when((F.abs(c) >= 1e-3) & (F.abs(c) < 1e7), c.cast("string")).when(F.abs(c) >= 1e7, F.regexp_replace(c.cast("decimal(38,10)").cast("string"), r"\.?0+$", "")).otherwise(tiny)


def st_wkt(st: Column) -> Column:
    """Text of a value's geometry, by expression; null of a null value."""
    spot = lambda p: F.concat(_number(p["x"]), F.lit(" "), _number(p["y"]))
    ring = lambda r: F.concat(F.lit("("), F.array_join(F.transform(r, spot), ", "), F.lit(")"))
    rings = lambda part: F.concat(F.lit("("), F.array_join(F.transform(part, ring), ", "), F.lit(")"))
    parts, kind = st["parts"], st["gtype"]
    name = F.get(F.array(*[F.lit(k) for k in KINDS]), kind.cast("int"))
    body = F.when(kind.isin(POINT, LINE), ring(parts[0][0])).when(kind == POLYGON, rings(parts[0]))
    body = body.when(kind.isin(MULTIPOINT, MULTILINE), F.concat(F.lit("("), F.array_join(F.transform(parts, lambda p: ring(p[0])), ", "), F.lit(")")))
    body = body.otherwise(F.concat(F.lit("("), F.array_join(F.transform(parts, rings), ", "), F.lit(")")))
    return F.when(kind.isNull(), F.lit(None).cast("string")).when(F.size(parts) == 0, F.concat(name, F.lit(" EMPTY"))).otherwise(F.concat(name, F.lit(" "), body))


__all__ = ["COLLECTION", "literal", "number", "parse", "st_geomfromwkt", "st_pointfromwkt", "st_wkt", "write"]
