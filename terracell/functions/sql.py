"""SQL names of the functions: constructors, predicates, tile and histogram accessors."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from terracell.functions import predicates
from terracell.functions.types import KINDS, ST
from terracell.functions.wkt import _row

#: The unit of the value's time made from dates.
DAY_SECONDS = 86_400
_HIST = "array<struct<values:int,lowerBounds:double,upperBounds:double>>"
_TILE = "STRUCT<ulx: DOUBLE, uly: DOUBLE, width: INT, height: INT, pixelwidth: DOUBLE, values: ARRAY<DOUBLE>>"
_BUCKET = "STRUCT<values: INT, lowerBounds: DOUBLE, upperBounds: DOUBLE>"
_SQL_ST = "STRUCT<gtype: TINYINT, parts: ARRAY<ARRAY<ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>>>, xmin: DOUBLE, ymin: DOUBLE, xmax: DOUBLE, ymax: DOUBLE, t_kind: TINYINT, t_start: BIGINT, t_end: BIGINT, zmin: DOUBLE, zmax: DOUBLE>"
_PLACE = "named_struct('x', {}, 'y', {})"


def _point(x: str, y: str, z: str) -> str:
    p = _PLACE.format(x, y)
    time = "'t_kind', CAST(NULL AS TINYINT), 't_start', CAST(NULL AS BIGINT), 't_end', CAST(NULL AS BIGINT)"
    return f"named_struct('gtype', CAST(0 AS TINYINT), 'parts', array(array(array({p}))), 'xmin', {x}, 'ymin', {y}, 'xmax', {x}, 'ymax', {y}, {time}, 'zmin', {z}, 'zmax', {z})"


def _box(t: str) -> str:
    a, b, c, d = f"{t}.ulx", f"({t}.uly - {t}.height * {t}.pixelwidth)", f"({t}.ulx + {t}.width * {t}.pixelwidth)", f"{t}.uly"
    ring = ", ".join(_PLACE.format(x, y) for x, y in ((a, b), (c, b), (c, d), (a, d), (a, b)))
    time = "'t_kind', CAST(NULL AS TINYINT), 't_start', CAST(NULL AS BIGINT), 't_end', CAST(NULL AS BIGINT)"
    return f"named_struct('gtype', CAST(2 AS TINYINT), 'parts', array(array(array({ring}))), 'xmin', {a}, 'ymin', {b}, 'xmax', {c}, 'ymax', {d}, {time}, 'zmin', CAST(NULL AS DOUBLE), 'zmax', CAST(NULL AS DOUBLE))"


def _number(c: str) -> str:
    plain = f"CAST(CAST({c} AS BIGINT) AS STRING)"
    long = f"regexp_replace(CAST(CAST({c} AS DECIMAL(38,10)) AS STRING), '[.]?0+$', '')"
    tiny = f"regexp_replace(format_string('%.20f', {c}), '[.]?0+$', '')"
    return f"CASE WHEN abs({c}) < 1e15 AND {c} = floor({c}) THEN {plain} WHEN abs({c}) >= 1e-3 AND abs({c}) < 1e7 THEN CAST({c} AS STRING) WHEN abs({c}) >= 1e7 THEN {long} ELSE {tiny} END"


def _text(g: str) -> str:
    """The text of a value's geometry, as `wkt.st_wkt` makes it."""
    inside = lambda items: f"concat('(', array_join({items}, ', '), ')')"
    ring = lambda r: inside(f"transform({r}, p -> concat({_number('p.x')}, ' ', {_number('p.y')}))")
    rings = lambda part: inside(f"transform({part}, r -> {ring('r')})")
    kind = f"{g}.gtype"
    body = f"CASE WHEN {kind} IN (0, 1) THEN {ring(f'{g}.parts[0][0]')} WHEN {kind} = 2 THEN {rings(f'{g}.parts[0]')} WHEN {kind} IN (3, 4) THEN {inside(f'transform({g}.parts, q -> {ring("q[0]")})')} ELSE {inside(f'transform({g}.parts, q -> {rings("q")})')} END"
    name = f"array({', '.join(repr(k) for k in KINDS)})[{kind}]"
    return f"CASE WHEN {kind} IS NULL THEN NULL WHEN size({g}.parts) = 0 THEN concat({name}, ' EMPTY') ELSE concat({name}, ' ', {body}) END"


#: Name, parameters and body of the functions that are SQL expressions.
SQL_FUNCTIONS = {
    "st_point": ("x DOUBLE, y DOUBLE, z DOUBLE DEFAULT NULL", f"CASE WHEN x IS NULL OR y IS NULL THEN raise_error('st_point needs x and y') ELSE {_point('x', 'y', 'z')} END"),
    "st_geomfromtile": (f"tile {_TILE}", _box("tile")),
    "ulx": (f"tile {_TILE}", "tile.ulx"),
    "uly": (f"tile {_TILE}", "tile.uly"),
    "width": (f"tile {_TILE}", "tile.width"),
    "height": (f"tile {_TILE}", "tile.height"),
    "data": (f"tile {_TILE}", "tile.values"),
    "r_max": (f"tile {_TILE}", "array_max(tile.values)"),
    "r_min": (f"tile {_TILE}", "array_min(tile.values)"),
    "r_median": (f"tile {_TILE}", "get(tile.values, CAST(floor(size(tile.values) / 2) AS INT))"),
    "st_wkt": (f"st {_SQL_ST}", _text("st")),
    "h_value": (f"bucket {_BUCKET}", "bucket.values"),
    "h_lower": (f"bucket {_BUCKET}", "bucket.lowerBounds"),
    "h_upper": (f"bucket {_BUCKET}", "bucket.upperBounds"),
}


def _value(d: pd.DataFrame) -> pd.DataFrame:
    """A struct argument as a value; a tile becomes its box, without a time."""
    if "ulx" not in d.columns:
        return d
    a, b, c, e = d["ulx"], d["uly"] - d["height"] * d["pixelwidth"], d["ulx"] + d["width"] * d["pixelwidth"], d["uly"]
    known = a.notna() & b.notna() & c.notna()
    parts = [[[[{"x": x, "y": y} for x, y in ((i, j), (k, j), (k, m), (i, m), (i, j))]]] if f else None for i, j, k, m, f in zip(a, b, c, e, known)]
    kind = pd.Series([2 if f else None for f in known], dtype="object")
    none = pd.Series([None] * len(d), dtype="object")
    return pd.DataFrame({"gtype": kind, "parts": parts, "xmin": a, "ymin": b, "xmax": c, "ymax": e, "t_kind": none, "t_start": none, "t_end": none, "zmin": none, "zmax": none})


def _time_rule(name: str, a: pd.DataFrame, b: pd.DataFrame) -> np.ndarray:
    """Both without a time, or both with one and the times' predicate."""
    timed = [d["t_kind"].notna().to_numpy() for d in (a, b)]
    start = [pd.to_numeric(d["t_start"]).to_numpy(float, na_value=np.nan) for d in (a, b)]
    end = [pd.to_numeric(d["t_end"]).to_numpy(float, na_value=np.nan) for d in (a, b)]
    inside = lambda i, j: ~np.isnan(end[j]) & (start[j] >= start[i]) & (np.isnan(end[i]) | (end[j] <= end[i]))
    meet = (np.isnan(end[1]) | (start[0] <= end[1])) & (np.isnan(end[0]) | (start[1] <= end[0]))
    rule = {"contains": lambda: inside(0, 1), "containedby": lambda: inside(1, 0)}.get(name, lambda: meet)()
    return np.where(timed[0] & timed[1], rule, ~timed[0] & ~timed[1])


def _predicate(name: str):
    exact = predicates._exact(name).func

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.Series:
        """Kinds, envelopes and times of all rows at once; points by their places; what is left by the exact kernel."""
        a, b = _value(a), _value(b)
        env = lambda d, n: pd.to_numeric(d[n]).to_numpy(float, na_value=np.nan)
        (p, q, r, s), (t, u, v, w) = ([env(d, n) for n in ("xmin", "ymin", "xmax", "ymax")] for d in (a, b))
        near = {"contains": (p <= t) & (q <= u) & (r >= v) & (s >= w), "containedby": (t <= p) & (u <= q) & (v >= r) & (w >= s)}.get(name, (p <= v) & (r >= t) & (q <= w) & (s >= u))
        known = a["gtype"].notna().to_numpy() & b["gtype"].notna().to_numpy()
        out = near & known & _time_rule(name, a, b)
        points = (a["gtype"] == 0).to_numpy(bool) & (b["gtype"] == 0).to_numpy(bool)
        rest = np.flatnonzero(out & ~points)
        if len(rest):
            out[rest] = exact(a.iloc[rest].reset_index(drop=True), b.iloc[rest].reset_index(drop=True)).to_numpy(bool)
        return pd.Series(out, dtype=bool)

    run.__annotations__ = {"a": pd.DataFrame, "b": pd.DataFrame, "return": pd.Series}
    return F.pandas_udf(run, "boolean")


def _fromwkt(texts: pd.Series) -> pd.DataFrame:
    if texts.isna().any():
        raise ValueError("a geometry's text is null")
    return pd.DataFrame([_row(t) | {"t_kind": None, "t_start": None, "t_end": None} for t in texts], columns=["gtype", "parts", "xmin", "ymin", "xmax", "ymax", "t_kind", "t_start", "t_end", "zmin", "zmax"])


_F64 = pa.float64()
_ARROW_PARTS = pa.list_(pa.list_(pa.list_(pa.struct([("x", _F64), ("y", _F64)]))))
_ARROW_ST = [("gtype", pa.int8()), ("parts", _ARROW_PARTS), *[(n, _F64) for n in ("xmin", "ymin", "xmax", "ymax")], ("t_kind", pa.int8()), ("t_start", pa.int64()), ("t_end", pa.int64()), ("zmin", _F64), ("zmax", _F64)]


def _days(args: tuple[pa.Array, ...]) -> pa.Array | None:
    """Days since 1970 of a date (or what pandas reads as one), or of year, month and day; None of other numbers of arguments."""
    if len(args) == 1 and pa.types.is_date32(args[0].type):
        return args[0].cast(pa.int32()).cast(pa.int64())
    if len(args) == 1:
        at = pc.local_timestamp(args[0]) if pa.types.is_timestamp(args[0].type) and args[0].type.tz else args[0]
        days = pd.to_datetime(at.to_pandas())
    elif len(args) == 3:
        days = pd.to_datetime(pd.DataFrame({n: a.to_pandas() for n, a in zip(("year", "month", "day"), args)}))
    else:
        return None
    return pa.array(days.to_numpy("datetime64[D]").astype("int64"), pa.int64(), mask=days.isna().to_numpy())


def _sto(texts: pa.Array, *args: pa.Array) -> pa.Array:
    """Text; text and date; text, year, month and day. Other numbers of arguments leave the time out.

    Each different text of a batch is parsed once and given out as columns, so that no objects are kept for each row.
    """
    if texts.null_count:
        raise ValueError("a geometry's text is null")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    known, n = texts.dictionary_encode(), len(texts)
    rows = [_row(t) for t in known.dictionary.to_pylist()]
    column = lambda c, kind: pa.array([r[c] for r in rows], kind).take(known.indices)
    made = {c: column(c, kind) for c, kind in _ARROW_ST if not c.startswith("t_")}
    days = _days(args)
    seconds = pa.nulls(n, pa.int64()) if days is None else pc.multiply(days, DAY_SECONDS)
    kind = pc.if_else(pc.is_valid(seconds), pa.scalar(1, pa.int8()), pa.scalar(None, pa.int8()))
    made |= {"t_kind": kind, "t_start": seconds, "t_end": seconds}
    return pa.StructArray.from_arrays([made[c] for c, _ in _ARROW_ST], names=[c for c, _ in _ARROW_ST])


def _buckets(tiles, n=None):
    """Buckets of ceil(distinct / n) distinct values each (ten buckets if n is left out), as `tiles.histogram` makes them."""
    out = []
    for i, values in enumerate(tiles["values"]):
        distinct, counts = np.unique(np.asarray([] if values is None else values, float), return_counts=True)
        each = -(-len(distinct) // int(10 if n is None else n[i])) or 1
        starts = range(0, len(distinct), each)
        out.append([{"values": int(counts[j : j + each].sum()), "lowerBounds": float(distinct[j]), "upperBounds": float(distinct[j : j + each][-1])} for j in starts])
    return pd.Series(out, dtype="object")


def _merge(tiles: pd.Series) -> list:
    """Ten buckets of equal width over all tiles' values."""
    import numpy as np

    held = [t["values"] for t in tiles if t is not None]
    arrays = [np.asarray(v, float) for v in held if v is not None and len(v)]
    if not arrays:
        return []
    lo, hi = min(a.min() for a in arrays), max(a.max() for a in arrays)
    counts, edges = np.zeros(10, int), np.linspace(lo, hi if hi > lo else lo + 1, 11)
    for a in arrays:
        counts += np.histogram(a, edges)[0]
    return [{"values": int(n), "lowerBounds": float(a), "upperBounds": float(b)} for n, a, b in zip(counts, edges, edges[1:])]


def register(spark: SparkSession) -> SparkSession:
    """Makes the functions known to the session's SQL."""
    for name, (params, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURN {body}")
    spark.udf.register("st_geomfromwkt", F.pandas_udf(_fromwkt, ST))
    spark.udf.register("fromwkt", F.pandas_udf(_fromwkt, ST))
    spark.udf.register("st_sto", F.arrow_udf(_sto, ST))
    for name in ("contains", "containedby", "intersects"):
        spark.udf.register(f"st_{name}", _predicate(name))
    spark.udf.register("histogram", F.pandas_udf(_buckets, _HIST))
    spark.udf.register("rasterhistogram", F.pandas_udf(_merge, _HIST, F.PandasUDFType.GROUPED_AGG))
    return spark
