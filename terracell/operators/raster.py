"""Operators on DataFrames of raster tiles in a column `tile`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terracell.functions import predicates, tiles
from terracell.operators.cells import Grid
from terracell.operators.join import cell_join, st_join


def with_geometry(df: DataFrame, column: str = "tile", st: str = "st") -> DataFrame:
    return df.withColumn(st, tiles.st_geomfromtile(F.col(column)))


def raster_filter(df: DataFrame, query: Column, default: float = 0.0, name: str = "intersects", column: str = "tile", box: bool = True) -> DataFrame:
    """Tiles that stand in the predicate to a geometry (space alone), cut to it and masked. `box`: the query is a rectangle."""
    t = F.col(column)
    near = with_geometry(df, column, "_st").where(predicates.spatial(name, F.col("_st"), query, "simple" if box else "any")).drop("_st")
    if box:
        return near.withColumn(column, tiles.mask_box(t, query["xmin"], query["ymin"], query["xmax"], query["ymax"], default, name)).where(t.isNotNull())
    return near.withColumn(column, tiles.mask_any(name, default)(t, F.struct(query["gtype"].alias("gtype"), query["parts"].alias("parts")))).where(t["ulx"].isNotNull())


def values_filter(df: DataFrame, values: list[float], column: str = "tile") -> DataFrame:
    """Tiles that have all the values."""
    return df.where(tiles.has_values(F.col(column), values))


def has_value(df: DataFrame, value: float, column: str = "tile") -> DataFrame:
    """One row: whether any tile has the value; false of none."""
    return df.agg(F.coalesce(F.bool_or(tiles.has_value(F.col(column), value)), F.lit(False)).alias("found"))


def count_value(df: DataFrame, value: float, column: str = "tile") -> DataFrame:
    return df.agg(F.coalesce(F.sum(tiles.count_value(F.col(column), value)), F.lit(0)).cast("long").alias("n"))


def bounds(df: DataFrame, column: str = "tile") -> DataFrame:
    a, b, c, d = tiles.span(F.col(column))
    return df.agg(F.min(a).alias("xmin"), F.min(b).alias("ymin"), F.max(c).alias("xmax"), F.max(d).alias("ymax"))


def byte_range(df: DataFrame, column: str = "tile") -> DataFrame:
    """Least and greatest value of all tiles; the whole range of a signed byte where there is none."""
    t = F.col(column)
    return df.agg(F.coalesce(F.min(tiles.r_min(t)), F.lit(-128.0)).alias("lo"), F.coalesce(F.max(tiles.r_max(t)), F.lit(127.0)).alias("hi"))


def raster_histogram(df: DataFrame, n: int = 10, column: str = "tile") -> DataFrame:
    """bucket, values, lower, upper: n buckets of equal width over all tiles' range; the last one holds the greatest value."""
    t = F.col(column)
    r = df.agg(F.min(tiles.r_min(t)).alias("lo"), F.max(tiles.r_max(t)).alias("hi")).first()
    lo, hi = (r["lo"], r["hi"]) if r["lo"] is not None else (0.0, 0.0)
    step = (hi - lo) / n or 1.0
    pixels = df.select(F.explode(t["values"]).alias("v"))
    bucket = F.least(F.floor((F.col("v") - lo) / step), F.lit(n - 1)).cast("int")
    return pixels.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("values")).select("bucket", "values", (F.lit(lo) + F.col("bucket") * step).alias("lower"), (F.lit(lo) + (F.col("bucket") + 1) * step).alias("upper"))


def byte_histogram(df: DataFrame, n: int, column: str = "tile") -> DataFrame:
    """As above with whole-number steps of ceil(range / n), 1 at least; n of 0 or less: one bucket for each value."""
    t = F.col(column)
    r = byte_range(df, column).first()
    step = max(1, -int(-(r["hi"] - r["lo"]) // n)) if n > 0 else 1
    bucket = F.floor((F.col("v") - r["lo"]) / step).cast("int")
    return df.select(F.explode(t["values"]).alias("v")).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("values")).withColumn("lower", F.lit(r["lo"]) + F.col("bucket") * step)


def combine_histograms(*parts: DataFrame) -> DataFrame:
    """Of histograms with the same buckets: their sums."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    keys = [c for c in out.columns if c != "values"]
    return out.groupBy(*keys).agg(F.sum("values").alias("values"))


def grid_tiles(df: DataFrame, grid: Grid, column: str = "tile") -> DataFrame:
    """Adds the cell of each tile's middle."""
    c = tiles.center(F.col(column))
    return df.withColumn("cell", grid.cell(c["x"], c["y"]))


def rasterize(df: DataFrame, size: int, pixelwidth: float = 1.0, x: str = "x", y: str = "y", value: Column | None = None, default: float = 0.0) -> DataFrame:
    """Tiles of size by size pixels, aligned to the origin, whose pixels hold an aggregate of the points in them (a count)."""
    side = size * pixelwidth
    tx, ty = F.floor(F.col(x) / side).cast("long"), F.floor(F.col(y) / side).cast("long")
    col = F.least(F.floor((F.col(x) - F.col("tx") * side) / pixelwidth), F.lit(size - 1)).cast("int")
    row = F.least(F.floor((F.col(y) - F.col("ty") * side) / pixelwidth), F.lit(size - 1)).cast("int")
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumns({"tx": tx, "ty": ty})
    pixels = rows.withColumn("i", (size - 1 - row) * size + col).groupBy("tx", "ty", "i").agg((value if value is not None else F.count("*")).cast("double").alias("v"))
    held = pixels.groupBy("tx", "ty").agg(F.map_from_entries(F.collect_list(F.struct("i", "v"))).alias("m"))
    values = F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(float(default))))
    return held.select("tx", "ty", tiles.tile(F.col("tx") * side, (F.col("ty") + 1) * side, size, size, values, pixelwidth).alias("tile"))


def join_vector(df: DataFrame, vector: DataFrame, default: float = 0.0, name: str = "intersects", column: str = "tile", st: str = "st", box: bool = True, aggregate: Callable[[Column], Column] | None = None, side: float | None = None, whole: bool = False) -> DataFrame:
    """Tiles with each geometry that they stand in the predicate to, cut and masked; `aggregate` makes a column `agg` of the
    masked values instead of the tile. `whole` leaves tiles as they are."""
    rows = vector.withColumnRenamed(st, "_g")
    pairs = st_join(with_geometry(df, column, "_t"), rows, name, left_st="_t", right_st="_g", kinds="simple" if box else "any", side=side)
    g, t = F.col("_g"), F.col(column)
    if whole:
        cut = t
    elif box:
        cut = tiles.mask_box(t, g["xmin"], g["ymin"], g["xmax"], g["ymax"], default, name)
    else:
        cut = tiles.mask_any(name, default)(t, F.struct(g["gtype"].alias("gtype"), g["parts"].alias("parts")))
    out = pairs.withColumn(column, cut).drop("_t", "_g")
    if aggregate is None:
        return out
    return out.withColumn("agg", aggregate(F.col(column)["values"])).drop(column)


def join_raster(left: DataFrame, right: DataFrame, f: Callable[[Column, Column], Column], column: str = "tile", side: float | None = None) -> DataFrame:
    """Pairs of tiles that share an area, as one tile of f(left, right) over it; columns of both sides stay."""
    a = with_geometry(left, column, "_a")
    b = with_geometry(right, column, "_b")
    area = lambda p, q: (F.least(p["xmax"], q["xmax"]) > F.greatest(p["xmin"], q["xmin"])) & (F.least(p["ymax"], q["ymax"]) > F.greatest(p["ymin"], q["ymin"]))
    pairs = cell_join(a, b, area, left_st="_a", right_st="_b", side=side)
    return pairs.withColumn(column, tiles.overlay(F.col(column), F.col(f"r_{column}"), f)).drop("_a", "_b", f"r_{column}")
