"""Filters by a constant value. Rows pass unchanged; the envelope's comparisons come first and reach the scan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terracell.functions import distance, predicates


def st_filter(df: DataFrame, query: Column, name: str = "intersects", st: str = "st", kinds: str | tuple[str, str] = "simple") -> DataFrame:
    """Rows whose value stands in the predicate `name` to `query` (row first: "contains" keeps rows that contain it)."""
    col = F.col(st)
    near = df.where(predicates.envelope_test(name, col, query))
    return near.where(predicates.predicate(name, col, query, kinds))


def within_distance(df: DataFrame, query: Column, most: float, st: str = "st", metric: Callable[[Column, Column], Column] = distance.seuclid, spatial: bool = True) -> DataFrame:
    """Rows at `most` or less from `query`. With `spatial`, the metric is at least the centroids' distance on either axis,
    which cuts the envelope first; other metrics are worked out for every row."""
    col = F.col(st)
    if spatial:
        c = distance.st_centroid(query)
        df = df.where((col["xmin"] <= c["x"] + most) & (col["xmax"] >= c["x"] - most) & (col["ymin"] <= c["y"] + most) & (col["ymax"] >= c["y"] - most))
    return df.where(metric(col, query) <= F.lit(float(most)))
