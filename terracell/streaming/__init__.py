"""Streams: the filters and cell numbers of the batch operators hold for streaming DataFrames unchanged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terracell.operators.cells import Grid, grid_cells
from terracell.operators.filter import st_filter


def filter_stream(stream: DataFrame, query: Column, name: str = "intersects", st: str = "st") -> DataFrame:
    return st_filter(stream, query, name, st)


def cell_counts(stream: DataFrame, grid: Grid, time: str, window: str, delay: str, st: str = "st") -> DataFrame:
    """Points in each cell and window of time; rows later than `delay` are dropped with the window's state."""
    cells = grid_cells(stream.withWatermark(time, delay), grid, st, "cell", points=True)
    return cells.groupBy(F.window(time, window), "cell").agg(F.count("*").alias("n"))
