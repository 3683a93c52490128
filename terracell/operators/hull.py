"""Convex hulls of groups of points."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    points = sorted(set(points))
    if len(points) < 3:
        return points
    turn = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
    out: list[list] = []
    for seq in (points, points[::-1]):
        half: list = []
        for p in seq:
            while len(half) > 1 and turn(half[-2], half[-1], p) <= 0:
                half.pop()
            half.append(p)
        out.append(half[:-1])
    return out[0] + out[1]


def convex_hull(df: DataFrame, group: list[str], x: str = "x", y: str = "y", salt: int = 16) -> DataFrame:
    """group, pos, x, y: corners counter-clockwise from the least. Hulls of batches first, then of salted parts of their corners, then of these."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*group).schema.fields)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        corners = _hull(list(zip(pdf[x], pdf[y])))
        out = pd.DataFrame(corners, columns=[x, y])
        for g in group:
            out[g] = pdf[g].iloc[0] if len(pdf) else None
        out["pos"] = range(len(out))
        return out[[*group, "pos", x, y]]

    schema = f"{fields}{', ' * bool(group)}pos int, `{x}` double, `{y}` double"
    rows = df.select(*group, F.col(x).cast("double"), F.col(y).cast("double")).where(F.col(x).isNotNull() & F.col(y).isNotNull())

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The hull of each group in a batch, so that corners alone are moved."""
        for pdf in parts:
            for _, g in pdf.groupby(group, dropna=False, sort=False) if group else [(None, pdf)]:
                yield run(g)

    first = rows.mapInPandas(batches, schema).drop("pos")
    part = first.withColumn("_salt", F.pmod(F.xxhash64(x, y), F.lit(salt))).groupBy(*group, "_salt").applyInPandas(run, schema)
    return part.drop("pos").groupBy(*group).applyInPandas(run, schema) if group else part.drop("pos").groupBy().applyInPandas(run, schema)
