"""Partitioning and indexing strategies by name, as values that operators and writers take.

A strategy adds a `cell` column; rows of a cell go to one task. An index is the order of rows in stored cells: Parquet's
statistics of row groups sorted by place do what a tree in each partition would, and no strategy changes any result.
"""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terracell.operators import cells
from terracell.sources import partitioned


@dataclass(frozen=True)
class GridStrategy:
    """`per_side` by `per_side` equal cells over the values' extent."""

    per_side: int
    points: bool = False


@dataclass(frozen=True)
class BspStrategy:
    """Binary splits of a grid of the given side, until a box has `most` values. sample: share of the rows that is counted."""

    side: float
    most: int
    points: bool = False
    sample: float = 1.0


@dataclass(frozen=True)
class TileStrategy:
    """Slices and tiles of equal numbers of values, as a bulk-loaded tree's leaves are."""

    slices: int
    per_slice: int
    key: str = "id"


@dataclass(frozen=True)
class TimeStrategy:
    """Slices of time, of equal width or (`even`) of equal numbers of values."""

    slices: int
    even: bool = False
    key: str = "id"


@dataclass(frozen=True)
class SpaceTimeStrategy:
    """A grid, and slices of time in each cell."""

    per_side: int
    slices: int
    points: bool = False


@dataclass(frozen=True)
class AngularStrategy:
    slices: int
    first_quadrant: bool = False


@dataclass(frozen=True)
class NoStrategy:
    pass


_STRATEGIES = {c.__name__: c for c in (GridStrategy, BspStrategy, TileStrategy, TimeStrategy, SpaceTimeStrategy, AngularStrategy, NoStrategy)}


@dataclass(frozen=True)
class IndexConfig:
    """How rows lie in a stored cell: by place, or by time."""

    by: str = "place"
    row_group_bytes: int = 32 << 20


def with_cells(df: DataFrame, strategy, st: str = "st") -> DataFrame:
    """Adds `cell`. An empty table and no strategy have cell 0 alone."""
    s, whole = strategy, None
    if isinstance(s, (GridStrategy, SpaceTimeStrategy)):
        whole = cells.extent(df, st)
    if isinstance(s, GridStrategy) and whole:
        return cells.grid_cells(df, cells.Grid(whole, s.per_side, s.per_side), st, "cell", s.points)
    if isinstance(s, SpaceTimeStrategy) and whole:
        times = cells.time_extent(df, st) or (0, 1)
        out = cells.spacetime_cells(df, cells.Grid(whole, s.per_side, s.per_side), s.slices, *times, st, s.points)
        return out.withColumn("cell", F.col("cell") * s.slices + F.coalesce("slice", F.lit(0))).drop("slice")
    if isinstance(s, BspStrategy):
        some = df if s.sample >= 1 else df.sample(s.sample, seed=1)
        return cells.box_cells(df, cells.bsp_cells(some, s.side, max(1, int(s.most * min(s.sample, 1))), st, s.points), st, points=s.points)
    if isinstance(s, TileStrategy):
        return cells.str_tiles(df, s.slices, s.per_slice, st, s.key).withColumnRenamed("tile", "cell")
    if isinstance(s, TimeStrategy):
        if s.even:
            return cells.even_time_slices(df, s.slices, st, s.key, "cell")
        times = cells.time_extent(df, st) or (0, 1)
        return cells.fixed_time_slices(df, s.slices, *times, st, "cell")
    if isinstance(s, AngularStrategy):
        return cells.angular_cells(df, s.slices, st, "cell", s.first_quadrant)
    return df.withColumn("cell", F.lit(0))


def partition_by(df: DataFrame, strategy, st: str = "st", n: int | None = None) -> DataFrame:
    """Rows of a cell in one task, as a hint for what follows; without a strategy the table as it is."""
    return df if isinstance(strategy, NoStrategy) else cells.partition_by(with_cells(df, strategy, st), "cell", n)


def live_index(df: DataFrame, strategy=None, config: IndexConfig | None = None, st: str = "st") -> DataFrame:
    """Rows clustered by cell and sorted inside; results of later operators are the same."""
    rows = df.withColumn("cell", F.lit(0)) if strategy is None or isinstance(strategy, NoStrategy) else partition_by(df, strategy, st)
    v = F.col(st)
    first = v["t_start"] if config and config.by == "time" else v["xmin"]
    return rows.sortWithinPartitions("cell", first, v["ymin"])


def index(df: DataFrame, path: str, strategy=None, config: IndexConfig | None = None, st: str = "st") -> None:
    """Stores the table by cells, to be read by `partitioned.read`, `knn` and `join`."""
    config = config or IndexConfig()
    strategy = strategy or NoStrategy()
    options = {"parquet.block.size": str(config.row_group_bytes)}
    partitioned.write(with_cells(df, strategy, st), path, "cell", st, options=options, order="t_start" if config.by == "time" else "xmin")
    held = json.dumps({"strategy": type(strategy).__name__} | {"fields": dataclasses.asdict(strategy)})
    df.sparkSession.createDataFrame([(held,)], "value string").coalesce(1).write.text(f"{path}/strategy")


def strategy_of(spark: SparkSession, path: str):
    """The strategy that a table was stored by, so that other tables can be dealt alike."""
    held = json.loads("".join(r[0] for r in spark.read.text(f"{path}/strategy").collect()))  # one line
    return _STRATEGIES[held["strategy"]](**held["fields"])


def items(stored: DataFrame) -> DataFrame:
    """The rows of an indexed table without the index's column."""
    return stored.drop("cell")
