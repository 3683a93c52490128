"""Nearest neighbours. Ties go by the key, so results don't depend on how rows lie."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terracell.functions import distance
from terracell.operators.cells import extent
from terracell.scratch import stored

Metric = Callable[[Column, Column], Column]
#: Candidates of one task in the search of nearest places.
CANDIDATES = 250_000


def knn(df: DataFrame, query: Column, k: int, st: str = "st", key: str = "id", metric: Metric = distance.seuclid) -> DataFrame:
    """The k nearest rows with `dist`: each task keeps its k, and these are merged."""
    return df.withColumn("dist", metric(F.col(st), query)).where(F.col("dist").isNotNull()).orderBy("dist", key).limit(k)


def knn_grouped(df: DataFrame, group: list[str], query: Column, k: int, st: str = "st", key: str = "id", metric: Metric = distance.seuclid) -> DataFrame:
    """The k nearest rows of each group, with `dist` and `rank`. A rank limit over a window keeps k rows a task before rows are moved."""
    rows = df.withColumn("dist", metric(F.col(st), query)).where(F.col("dist").isNotNull())
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*group).orderBy("dist", key))).where(F.col("rank") <= k)


def knn_two_phase(df: DataFrame, x: float, y: float, k: int, st: str = "st", key: str = "id", points: bool = True) -> DataFrame:
    """As `knn` of a place, for storage that prunes by envelope: a box that holds k rows bounds the distance, and only rows
    in the box of that distance are read for the answer. The box grows until it holds k or the whole extent."""
    from terracell.functions.types import st_point

    c, query = F.col(st), st_point(x, y)
    e = extent(df, st)
    if e is None:
        return df.withColumn("dist", F.lit(None).cast("double")).limit(0)
    far = 2 * max(abs(e.xmax - x), abs(e.xmin - x), abs(e.ymax - y), abs(e.ymin - y)) + 1
    half = far / 64
    metric = lambda a, b: distance.seuclid(a, b, points)

    def inside(r: float) -> DataFrame:
        return df.where((c["xmin"] >= x - r) & (c["xmax"] <= x + r) & (c["ymin"] >= y - r) & (c["ymax"] <= y + r)) if points else df.where((c["xmin"] <= x + r) & (c["xmax"] >= x - r) & (c["ymin"] <= y + r) & (c["ymax"] >= y - r))

    while half < far:
        found = knn(inside(half), query, k, st, key, metric).agg(F.count("*").alias("n"), F.max("dist").alias("d")).first()
        if found["n"] >= k:
            return knn(inside(found["d"]), query, k, st, key, metric)
        half *= 2
    return knn(df, query, k, st, key, metric)


def nearest_places(left: DataFrame, right: DataFrame, n: int, k: int, ties: str, metric: Callable[[list[Column], list[Column]], Column], reach: float | None = None, side: float | None = None) -> DataFrame:
    """The k nearest rows of `right` (q0 .. and more) to each row of `left`, which are different places p0 .. of n dimensions:
    columns of both, dist and rank. `reach`: only those nearer than that.

    A place looks into its cell and those around it, by equality of the cells of the first two dimensions. It is done where k
    rows are nearer than one cell's side, which nothing outside of these cells can be (the metric is no less than the
    difference on either axis); the others go on with cells of four times the side. Candidates are sorted, so their number is
    reckoned from the cells' counts first, and tasks are so many that each sorts about CANDIDATES; rows should be narrow.
    """
    left, right = stored(left, "knn-left"), stored(right, "knn-right")
    place, m = [f"p{i}" for i in range(n)], min(2, n)
    one = lambda d, c: d.agg(F.count("*"), *[f(f"{c}{i}") for i in range(m) for f in (F.min, F.max)]).first()
    a, b = one(left, "p"), one(right, "q")
    wide, most = 1.0, min(k, b[0])
    if a[0] and b[0]:
        spans = [max(a[2 * i + 2], b[2 * i + 2]) - min(a[2 * i + 1], b[2 * i + 1]) for i in range(m)]
        wide = max(spans) + 1e-6
        side = side or max((math.prod(max(v, 1e-9) for v in spans) * max(4, k) / (a[0] + b[0])) ** (1 / m), 1e-9)
    side = side or 1.0
    wide = wide if reach is None else reach
    todo, done = left, None
    while True:
        side = side if reach is None else min(side, reach)
        last = side >= wide or not most
        at = lambda c, side=side: F.floor(F.col(c) / side).cast("long")
        near = todo
        for i in range(m):
            near = near.withColumn(f"_c{i}", F.explode(F.array(*[at(f"p{i}") + j for j in (-1, 0, 1)])))
        cell = [f"_c{i}" for i in range(m)]
        theirs = right.withColumns({c: at(f"q{i}") for i, c in enumerate(cell)})
        met = near.groupBy(*cell).agg(F.count("*").alias("a")).join(theirs.groupBy(*cell).agg(F.count("*").alias("b")), cell)
        tasks = min(20_000, (met.agg(F.sum(F.col("a") * F.col("b"))).first()[0] or 0) // CANDIDATES + 1)
        near = near.repartition(tasks, *cell).join(theirs.repartition(tasks, *cell), cell).drop(*cell)
        near = near.withColumn("dist", metric([F.col(c) for c in place], [F.col(f"q{i}") for i in range(n)]))
        near = near if reach is None else near.where(F.col("dist") < reach)
        near = near.withColumn("rank", F.row_number().over(W.partitionBy(*place).orderBy("dist", ties))).where(F.col("rank") <= k)
        if last:
            return near if done is None else done.union(near)
        near = stored(near, "knn-near")
        sure = stored(near.groupBy(*place).agg(F.count("*").alias("n"), F.max("dist").alias("d")).where((F.col("n") >= most) & (F.col("d") < side)).select(*place), "knn-sure")
        part, side = near.join(sure, place, "left_semi").select(*near.columns), side * 4
        todo = stored(todo.join(sure, place, "left_anti").select(*todo.columns), "knn-left")
        done = part if done is None else done.union(part)
        if todo.isEmpty():
            return done


def knn_join(left: DataFrame, right: DataFrame, k: int, left_key: str = "id", right_key: str = "id", st: str = "st", side: float | None = None) -> DataFrame:
    """The k nearest right rows of each left row, for points: columns of both (the right's with r_), dist and rank.

    Places are compared, not rows: each left place once, with the k least keys of each right place, as no others of a place
    can be among k. Values and other columns come back afterwards, so that none is moved or sorted with the candidates.
    """
    names = [*left.columns, *[f"r_{c}" for c in right.columns], "dist", "rank"]
    place, theirs = F.col(st), F.col(f"r_{st}")
    rows = stored(left.where(place["gtype"].isNotNull()).withColumns({"p0": place["xmin"], "p1": place["ymin"]}), "knn-rows")
    r = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns]).where(theirs["gtype"].isNotNull())
    r = stored(r.withColumns({"_r": F.monotonically_increasing_id(), "q0": theirs["xmin"], "q1": theirs["ymin"]}), "knn-theirs")
    first = F.row_number().over(W.partitionBy("q0", "q1").orderBy("_k"))
    others = r.select("_r", F.col(f"r_{right_key}").alias("_k"), "q0", "q1").withColumn("_n", first).where(F.col("_n") <= k).drop("_n")
    metric = lambda p, q: F.sqrt((p[0] - q[0]) * (p[0] - q[0]) + (p[1] - q[1]) * (p[1] - q[1]))
    best = nearest_places(rows.select("p0", "p1").distinct(), others, 2, k, "_k", metric, side=side)
    best = stored(best.select("p0", "p1", "_r", "dist", "rank"), "knn-best")
    return rows.join(best, ["p0", "p1"]).join(r, "_r").select(*names)
