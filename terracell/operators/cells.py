"""Partitioning as columns: grids, binary splits by cost, packed tiles, time slices, angles; extents and histograms.

A partitioning is a column of cell numbers, so it can be grouped, joined, written as a storage partition, or handed to
`repartition`. What reaches the driver is at most one row for each cell of a grid whose size the caller gives.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terracell.functions.distance import st_centroid
from terracell.scratch import stored

EPS = 1e-6
#: Most entries of the table by which a place's box is found.
TABLE = 4_000_000


@dataclass(frozen=True)
class Extent:
    xmin: float
    ymin: float
    xmax: float
    ymax: float


@dataclass(frozen=True)
class Grid:
    """nx by ny cells over an extent, numbered row by row from the lower left."""

    extent: Extent
    nx: int
    ny: int

    @property
    def side(self) -> tuple[float, float]:
        return (self.extent.xmax - self.extent.xmin) / self.nx, (self.extent.ymax - self.extent.ymin) / self.ny

    @classmethod
    def of_side(cls, extent: Extent, side: float) -> Grid:
        count = lambda lo, hi: max(1, math.ceil((hi - lo) / side - 1e-9))
        nx, ny = count(extent.xmin, extent.xmax), count(extent.ymin, extent.ymax)
        return cls(Extent(extent.xmin, extent.ymin, extent.xmin + nx * side, extent.ymin + ny * side), nx, ny)

    def axis(self, v: Column, i: int) -> Column:
        lo, n = ((self.extent.xmin, self.nx), (self.extent.ymin, self.ny))[i]
        return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((v - F.lit(lo)) / F.lit(self.side[i])))).cast("int")

    def cell(self, x: Column, y: Column) -> Column:
        """Number of the cell of a place; places outside belong to the nearest cell."""
        return self.axis(y, 1) * self.nx + self.axis(x, 0)

    def bounds(self, cell: Column) -> dict[str, Column]:
        (a, b), e = self.side, self.extent
        cx, cy = F.pmod(cell, F.lit(self.nx)), F.floor(cell / self.nx)
        return {"xmin": F.lit(e.xmin) + cx * a, "ymin": F.lit(e.ymin) + cy * b, "xmax": F.lit(e.xmin) + (cx + 1) * a, "ymax": F.lit(e.ymin) + (cy + 1) * b}

    def cells_in(self, xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
        """Numbers of all cells that a box meets; none of a box outside of the grid."""

        def along(lo: Column, hi: Column, i: int) -> Column:
            at, n = (lambda v: F.floor((v - F.lit((self.extent.xmin, self.extent.ymin)[i])) / F.lit(self.side[i]))), (self.nx, self.ny)[i]
            first, last = F.greatest(F.lit(0), at(lo)).cast("int"), F.least(F.lit(n - 1), at(hi)).cast("int")
            return F.when((at(lo) < n) & (at(hi) >= 0) & (first <= last), F.sequence(first, F.greatest(first, last))).otherwise(F.array().cast("array<int>"))

        xs = along(xmin, xmax, 0)
        return F.flatten(F.transform(along(ymin, ymax, 1), lambda cy: F.transform(xs, lambda cx: cy * self.nx + cx)))


def extent(df: DataFrame, st: str = "st") -> Extent | None:
    """Envelope of all values, open at the upper ends by EPS; None of none."""
    c = F.col(st)
    r = df.agg(F.min(c["xmin"]).alias("a"), F.min(c["ymin"]).alias("b"), F.max(c["xmax"]).alias("c"), F.max(c["ymax"]).alias("d")).first()
    return None if r["a"] is None else Extent(r["a"], r["b"], r["c"] + EPS, r["d"] + EPS)


def grid_cells(df: DataFrame, grid: Grid, st: str = "st", to: str = "cell", points: bool = False) -> DataFrame:
    """Adds each value's cell, by its centroid."""
    c = F.struct(F.col(st)["xmin"].alias("x"), F.col(st)["ymin"].alias("y")) if points else st_centroid(F.col(st))
    return df.withColumn(to, grid.cell(c["x"], c["y"]))


def grid_histogram(df: DataFrame, grid: Grid, st: str = "st", points: bool = False) -> DataFrame:
    """cell, its bounds, the number of values and their extent, with a row for empty cells too."""
    v = F.col(st)
    counts = grid_cells(df, grid, st, "cell", points).groupBy("cell").agg(F.count("*").alias("n"), *[f(v[k]).alias(f"e_{k}") for k, f in (("xmin", F.min), ("ymin", F.min), ("xmax", F.max), ("ymax", F.max))])
    every = df.sparkSession.range(grid.nx * grid.ny).select(F.col("id").cast("int").alias("cell"))
    out = every.join(counts, "cell", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumns(grid.bounds(F.col("cell")))


def combine_histograms(*parts: DataFrame) -> DataFrame:
    """Of histograms of the same grid: counts added up, extents joined; a cell that one of them lacks counts as empty there."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    sums = [F.sum("n").alias("n")] + [f(c).alias(c) for c, f in (("e_xmin", F.min), ("e_ymin", F.min), ("e_xmax", F.max), ("e_ymax", F.max))]
    return out.groupBy("cell", "xmin", "ymin", "xmax", "ymax").agg(*sums).select(*parts[0].columns)


def total_cost(histogram: DataFrame) -> DataFrame:
    """One row: the number of values."""
    return histogram.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def nonempty_cells(histogram: DataFrame) -> DataFrame:
    return histogram.where("n > 0")


def range_cost(histogram: DataFrame, box: Extent) -> DataFrame:
    """One row: the values in the cells that lie in a box, and the extent of these values."""
    inside = (F.col("xmin") >= box.xmin - EPS) & (F.col("xmax") <= box.xmax + EPS) & (F.col("ymin") >= box.ymin - EPS) & (F.col("ymax") <= box.ymax + EPS)
    return histogram.where(inside).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.min("e_xmin").alias("xmin"), F.min("e_ymin").alias("ymin"), F.max("e_xmax").alias("xmax"), F.max("e_ymax").alias("ymax"))


def write_cells(cells: DataFrame | list[Extent], path: str, spark: SparkSession | None = None) -> None:
    """Text lines `cell;WKT of its bounds[;WKT of its values' extent]` of a grid's histogram, or of boxes."""
    ring = lambda a, b, c, d: F.concat(F.lit("POLYGON (("), F.array_join(F.array(*[F.concat(x.cast("string"), F.lit(" "), y.cast("string")) for x, y in ((a, b), (c, b), (c, d), (a, d), (a, b))]), ", "), F.lit("))"))
    if isinstance(cells, list):
        cells = spark.createDataFrame([(i, b.xmin, b.ymin, b.xmax, b.ymax) for i, b in enumerate(cells)], "cell int, xmin double, ymin double, xmax double, ymax double")
    names = ("xmin", "ymin", "xmax", "ymax")
    lines = [F.col("cell").cast("string"), ring(*[F.col(n) for n in names])]
    if "e_xmin" in cells.columns:
        lines.append(F.when(F.col("e_xmin").isNotNull(), ring(*[F.col(f"e_{n}") for n in names])))  # concat_ws leaves nulls out
    cells.select(F.concat_ws(";", *lines)).write.text(path)


def spacetime_bsp(df: DataFrame, side: float, most: int, slices: int = 10, st: str = "st", points: bool = False) -> DataFrame:
    """Adds `cell` and `slice`: binary splits by cost in space, and in each box up to `slices` slices of its own time range."""
    rows = box_cells(df, bsp_cells(df, side, most, st, points), st, "cell", points)
    c = F.col(st)
    spans = rows.groupBy("cell").agg(F.min(c["t_start"]).alias("_lo"), F.max(c["t_start"]).alias("_hi"))  # one row for each box
    width = F.greatest(F.lit(1), F.ceil((F.col("_hi") - F.col("_lo") + 1) / slices))
    at = F.floor((c["t_start"] - F.col("_lo")) / width)
    return rows.join(F.broadcast(spans), "cell").withColumn("slice", F.coalesce(F.least(F.lit(slices - 1), at), F.lit(0)).cast("int")).drop("_lo", "_hi")


def bsp_cells(df: DataFrame, side: float, most: int, st: str = "st", points: bool = False, cells: int = 1_000_000) -> list[Extent]:
    """Boxes along the cells of a grid of the given side, split in two where the halves' numbers of values differ least,
    until a box holds `most` values or is one cell. The histogram of the grid (at most `cells`) is summed on the driver."""
    e = extent(df, st)
    if e is None:
        return []
    grid = Grid.of_side(e, side)
    if grid.nx * grid.ny > cells:
        raise ValueError(f"{grid.nx * grid.ny} cells; give a longer side")
    counts = np.zeros((grid.ny, grid.nx), np.int64)
    for r in grid_cells(df, grid, st, "cell", points).groupBy("cell").count().collect():
        counts[divmod(r["cell"], grid.nx)] = r["count"]
    sums = np.zeros((grid.ny + 1, grid.nx + 1), np.int64)
    sums[1:, 1:] = counts.cumsum(0).cumsum(1)
    cost = lambda x0, y0, x1, y1: int(sums[y1, x1] - sums[y0, x1] - sums[y1, x0] + sums[y0, x0])
    out, todo = [], [(0, 0, grid.nx, grid.ny)]
    while todo:
        box = x0, y0, x1, y1 = todo.pop()
        cuts = [(abs(cost(x0, y0, x, y1) - cost(x, y0, x1, y1)), 0, x) for x in range(x0 + 1, x1)] + [(abs(cost(x0, y0, x1, y) - cost(x0, y, x1, y1)), 1, y) for y in range(y0 + 1, y1)]
        if cost(*box) <= most or not cuts:
            if cost(*box):
                (a, b), g = grid.side, grid.extent
                out.append(Extent(g.xmin + x0 * a, g.ymin + y0 * b, g.xmin + x1 * a, g.ymin + y1 * b))
            continue
        _, axis, at = min(cuts)
        todo += [(x0, y0, at, y1), (at, y0, x1, y1)] if axis == 0 else [(x0, y0, x1, at), (x0, at, x1, y1)]
    return sorted(out, key=lambda e: (e.ymin, e.xmin))


def _box_of(boxes: list[Extent]) -> Callable[[pd.Series, pd.Series], pd.Series]:
    """Number of the first box that holds each place, from a table of the strips between the boxes' sides: two searches a
    place, however many boxes there are. The table of splits of a grid is no larger than the grid; where it would be larger
    than TABLE, places are compared with boxes, in blocks."""
    a, b, c, d = (np.array([getattr(e, n) for e in boxes], float) for n in ("xmin", "ymin", "xmax", "ymax"))
    xs, ys = np.unique(np.concatenate([a, c])), np.unique(np.concatenate([b, d]))
    table = None
    if len(xs) * len(ys) <= TABLE:
        table = np.full((len(ys) + 1, len(xs) + 1), -1, np.int32)  # what lies outside on either side is in none
        x0, x1, y0, y1 = np.searchsorted(xs, a), np.searchsorted(xs, c), np.searchsorted(ys, b), np.searchsorted(ys, d)
        for i in range(len(boxes) - 1, -1, -1):
            table[y0[i] + 1 : y1[i] + 1, x0[i] + 1 : x1[i] + 1] = i
    block = max(1, 1_000_000 // len(boxes))

    def find(x: pd.Series, y: pd.Series) -> pd.Series:
        x, y = x.to_numpy(float), y.to_numpy(float)
        known = ~(np.isnan(x) | np.isnan(y))
        out = np.full(len(x), 0 if table is None else -1, np.int32)
        if table is not None:
            out[known] = table[np.searchsorted(ys, y[known], "right"), np.searchsorted(xs, x[known], "right")]
        rest = np.flatnonzero(known if table is None else known & (out < 0))
        for k in range(0, len(rest), block):
            at = rest[k : k + block]
            p, q = x[at][:, None], y[at][:, None]
            inside = (p >= a) & (p < c) & (q >= b) & (q < d)
            far = np.minimum.reduce([np.sqrt((p - u) * (p - u) + (q - v) * (q - v)) for u in (a, c) for v in (b, d)])
            out[at] = np.where(inside.any(1), inside.argmax(1), far.argmin(1))
        out[~known] = 0
        return pd.Series(out)

    return find


def box_cells(df: DataFrame, boxes: list[Extent], st: str = "st", to: str = "cell", points: bool = False) -> DataFrame:
    """Adds the number of the box (right-open) that holds a value's centroid; outside of all, that of the nearest corner."""
    if not boxes:
        return df.withColumn(to, F.lit(0))
    find, c = F.pandas_udf(_box_of(boxes), "int"), F.col(st)
    if points:
        return df.withColumn(to, find(c["xmin"], c["ymin"]))
    # Spark doesn't take a Python function out of a projection whose arguments hold nested lambdas, so these come before
    rows = df.withColumn("_centre", F.explode(F.array(st_centroid(c))))
    return rows.withColumn(to, find(F.col("_centre")["x"], F.col("_centre")["y"])).drop("_centre")


def str_tiles(df: DataFrame, slices: int, per_slice: int, st: str = "st", key: str = "id") -> DataFrame:
    """Adds `tile`: values in equal numbers by x into slices, each by y into tiles. Ties go by `key`.

    Slices are ranges of x from a distributed sort, ranked inside; the ranks add up over the ranges' counts.
    """
    c = st_centroid(F.col(st))
    rows = df.withColumns({"_x": c["x"], "_y": c["y"]})
    rows = even_slices(rows, slices, ["_x", key], "_slice")
    rows = rows.withColumn("_tile", F.ntile(per_slice).over(W.partitionBy("_slice").orderBy("_y", key)))
    return rows.withColumn("tile", ((F.col("_slice") - 1) * per_slice + F.col("_tile") - 1).cast("int")).drop("_x", "_y", "_slice", "_tile")


def even_slices(df: DataFrame, n: int, order: list[str], to: str) -> DataFrame:
    """Adds the 1-based slice of n equal ones in a total order, as ntile does, without sorting in one task."""
    parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # ranges of the whole order, in which no two rows are equal, so that equal first values are spread too
    rows = stored(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = rows.groupBy("_part").agg(F.count("*").alias("_n"))  # one row for each range
    base = counts.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"), F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("_all"))
    rows = rows.join(F.broadcast(base), "_part").withColumn("_row", F.col("_base") + F.row_number().over(W.partitionBy("_part").orderBy(*order)) - 1)
    small, extra = F.floor(F.col("_all") / n), F.pmod(F.col("_all"), F.lit(n))
    edge = extra * (small + 1)
    tile = F.when(F.col("_row") < edge, F.floor(F.col("_row") / (small + 1))).otherwise(extra + F.floor((F.col("_row") - edge) / F.greatest(small, F.lit(1))))
    return rows.withColumn(to, (tile + 1).cast("int")).drop("_part", "_base", "_all", "_row")


def time_extent(df: DataFrame, st: str = "st") -> tuple[int, int] | None:
    """Least start, and greatest end or start plus 2."""
    c = F.col(st)
    r = df.agg(F.min(c["t_start"]).alias("a"), F.max(F.coalesce(c["t_end"], c["t_start"])).alias("b")).first()
    return None if r["a"] is None else (r["a"], r["b"] + 2)


def fixed_time_slices(df: DataFrame, n: int, lo: int, hi: int, st: str = "st", to: str = "slice") -> DataFrame:
    """Adds the slice of equal width of a value's start; earlier and later ones fall into the first and last."""
    width = max(1, math.ceil((hi - lo) / n))
    return df.withColumn(to, F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((F.col(st)["t_start"] - lo) / width))).cast("int"))


def even_time_slices(df: DataFrame, n: int, st: str = "st", key: str = "id", to: str = "slice") -> DataFrame:
    """Adds slices with equal numbers of values by start; ties go by `key`."""
    rows = df.withColumn("_t", F.col(st)["t_start"])
    return even_slices(rows, n, ["_t", key], "_s").withColumn(to, F.col("_s") - 1).drop("_s", "_t")


def angular_cells(df: DataFrame, n: int, st: str = "st", to: str = "cell", first_quadrant: bool = False) -> DataFrame:
    """Adds the slice of the angle of a value's upper corner about the origin; the first slice starts at -pi, or at 0."""
    c, start, whole = F.col(st), (0.0 if first_quadrant else -math.pi), (math.pi / 2 if first_quadrant else 2 * math.pi)
    at = F.ceil((F.atan2(c["ymax"], c["xmax"]) - start) / (whole / n)) - 1
    return df.withColumn(to, F.greatest(F.lit(0), F.least(F.lit(n - 1), at)).cast("int"))


def spacetime_cells(df: DataFrame, grid: Grid, n: int, lo: int, hi: int, st: str = "st", points: bool = False) -> DataFrame:
    """Adds `cell` and `slice`: a grid cell, and slices of time in each."""
    return fixed_time_slices(grid_cells(df, grid, st, "cell", points), n, lo, hi, st, "slice")


def partition_by(df: DataFrame, cell: str = "cell", n: int | None = None) -> DataFrame:
    """Rows of a cell in one task."""
    return df.repartition(n, cell) if n else df.repartition(cell)
