"""Density clustering of points, with labels that don't depend on the rows' order.

A point with `min_pts` points (itself counted) nearer than `eps` is a core. Cores nearer than `eps` to each other are one
cluster; a point that isn't a core belongs to the cluster with the least number among its cores' nearer than `eps`, else it
is noise. A cluster's number is the least key of its cores plus 1; noise has 0.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terracell.operators import knn
from terracell.scratch import stored

CORE, REACHABLE, NOISE = "core", "reachable", "noise"


def _cut(df: DataFrame) -> DataFrame:
    return stored(df, "dbscan")


#: Distance of two points given by lists of columns.
Metric = Callable[[list[Column], list[Column]], Column]


def euclid(p: list[Column], q: list[Column]) -> Column:
    return F.sqrt(sum(((a - b) * (a - b) for a, b in zip(p, q)), F.lit(0.0)))


def neighbours(df: DataFrame, eps: float, dims: list[str], key: str = "id", closed: bool = False, metric: Metric = euclid) -> DataFrame:
    """(a, b, d): keys of points nearer than eps, each pair both ways and each point with itself; `closed` takes eps too.

    Cells of side eps in the first two dimensions: each point meets those of its own and the neighbouring cells. A metric
    must be no less than the difference on either of these.
    """
    at = lambda c: F.floor(F.col(c) / eps).cast("long")
    grid = dims[:2]
    p = df.select(F.col(key).alias("a"), *[F.col(d).alias(f"p{i}") for i, d in enumerate(dims)], *[at(d).alias(f"_c{i}") for i, d in enumerate(grid)])
    q = df.select(F.col(key).alias("b"), *[F.col(d).alias(f"q{i}") for i, d in enumerate(dims)], *[at(d).alias(f"_c{i}") for i, d in enumerate(grid)])
    for i in range(len(grid)):
        p = p.withColumn(f"_c{i}", F.explode(F.array(*[F.col(f"_c{i}") + j for j in (-1, 0, 1)])))
    sides = ([F.col(f"{s}{i}") for i in range(len(dims))] for s in "pq")
    pairs = p.join(q, [f"_c{i}" for i in range(len(grid))]).withColumn("d", metric(*sides))
    return pairs.where(F.col("d") <= eps if closed else F.col("d") < eps).select("a", "b", "d")


def _joined_up(links: DataFrame) -> DataFrame:
    """(a, l): the least node that each node of the links (a, b), given both ways, can reach."""
    labels = _cut(links.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("l")))
    while True:
        near = links.join(labels.select(F.col("a").alias("b"), F.col("l").alias("m")), "b").groupBy("a").agg(F.min("m").alias("m"))
        moved = _cut(labels.join(near, "a").select("a", F.col("l").alias("was"), F.least("l", "m").alias("l")))
        up = moved.select(F.col("a").alias("l"), F.col("l").alias("above"))
        labels = _cut(moved.join(up, "l").select("a", "was", F.least("l", "above").alias("l")))
        if labels.where("l <> was").isEmpty():
            return labels.select("a", "l")
        labels = labels.select("a", "l")


def _by_pairs(df: DataFrame, eps: float, min_pts: int, dims: list[str], key: str, metric: Metric) -> tuple[DataFrame, DataFrame]:
    """(key, l) of cores and of reachable points, from all pairs that are near."""
    pairs = _cut(neighbours(df, eps, dims, key, metric=metric).select("a", "b"))
    cores = _cut(pairs.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") >= min_pts).select(F.col("a").alias("c")))
    links = pairs.join(cores, pairs.b == cores.c, "left_semi")
    labels = _joined_up(_cut(links.join(cores, links.a == cores.c, "left_semi")))
    border = links.join(labels.withColumnsRenamed({"a": "b"}), "b").groupBy("a").agg(F.min("l").alias("l"))
    return labels, border.join(labels.select("a"), "a", "left_anti")


def _by_cells(df: DataFrame, eps: float, min_pts: int, dims: list[str], key: str) -> tuple[DataFrame, DataFrame]:
    """As `_by_pairs` for up to three dimensions, with cells whose points are all near each other.

    A cell with `min_pts` points has cores alone, and the cores of a cell are one node of the graph of clusters; so what is
    written grows with the points, however many share a cell. Pairs are compared only between cells, and only counted,
    summed or made distinct. Cells whose points turn out not to be near each other count point by point.
    """
    n = len(dims)
    side, cell = eps / n**0.5 * (1 - 1e-9), [f"c{i}" for i in range(n)]
    pts = df.select(F.col(key).alias("k"), *[F.col(d).cast("double").alias(f"p{i}") for i, d in enumerate(dims)]).where(" AND ".join(f"p{i} IS NOT NULL" for i in range(n)))
    pts = _cut(pts.withColumns({f"c{i}": F.floor(F.col(f"p{i}") / side).cast("long") for i in range(n)}))
    diagonal = F.sqrt(sum((F.pow(F.max(f"p{i}") - F.min(f"p{i}"), 2) for i in range(n)), F.lit(0.0)))

    def near(left: DataFrame, right: DataFrame) -> DataFrame:
        """Rows of the left with rows of the right (columns q_) nearer than eps."""
        for c in cell:
            left = left.withColumn(c, F.explode(F.array(*[F.col(c) + j for j in range(-2, 3)])))
        right = right.withColumnsRenamed({c: f"q_{c}" for c in right.columns if c not in cell})
        d = euclid([F.col(f"p{i}") for i in range(n)], [F.col(f"q_p{i}") for i in range(n)])
        return left.join(right, cell).where(d < eps)

    dense = _cut(pts.groupBy(*cell).agg(F.count("*").alias("n"), diagonal.alias("d")).where((F.col("n") >= min_pts) & (F.col("d") < eps)).select(*cell))
    rest = pts.join(dense, cell, "left_anti")
    found = near(rest, pts).groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") >= min_pts).select("k")
    cores = _cut(pts.join(dense, cell, "left_semi").unionByName(rest.join(found, "k", "left_semi").select(*pts.columns)))
    nodes = cores.groupBy(*cell).agg(F.min("k").alias("least"), diagonal.alias("d"))
    cores = _cut(cores.join(nodes, cell).withColumn("node", F.when(F.col("d") < eps, F.col("least")).otherwise(F.col("k"))).drop("least", "d"))
    links = near(cores, cores).where("node <> q_node").select(F.col("node").alias("a"), F.col("q_node").alias("b")).distinct()
    labels = _joined_up(_cut(links))
    labels = _cut(cores.join(labels, cores.node == labels.a, "left").withColumn("l", F.coalesce("l", "node")).drop("a"))
    border = near(pts.join(labels.select("k"), "k", "left_anti").select(*pts.columns), labels.drop("node")).groupBy(F.col("k").alias("a")).agg(F.min("q_l").alias("l"))
    return labels.select(F.col("k").alias("a"), "l"), border


def dbscan(df: DataFrame, eps: float, min_pts: int, dims: list[str], key: str = "id", include_noise: bool = True, metric: Metric = euclid) -> DataFrame:
    """Adds cluster_id and label to rows with a unique key. Rows with a null coordinate are noise. metric: see `neighbours`."""
    cores, border = _by_cells(df, eps, min_pts, dims, key) if metric is euclid and len(dims) <= 3 else _by_pairs(df, eps, min_pts, dims, key, metric)
    known = cores.withColumn("label", F.lit(CORE)).unionByName(border.withColumn("label", F.lit(REACHABLE)))
    known = known.select(F.col("a").alias(key), (F.col("l") + 1).alias("cluster_id"), "label")
    out = df.join(known, key, "left").withColumns({"cluster_id": F.coalesce("cluster_id", F.lit(0).cast("long")), "label": F.coalesce("label", F.lit(NOISE))})
    return out if include_noise else out.where("cluster_id > 0")


def predict(df: DataFrame, clustered: DataFrame, eps: float, dims: list[str], key: str = "id", metric: Metric = euclid) -> DataFrame:
    """Adds the cluster_id of the nearest core that is nearer than eps, the least number among equals; 0 without one.

    Cores are looked for in cells that hold a few, and in larger ones, up to eps, only where these hold none near enough.
    """
    n = range(len(dims))
    known = " AND ".join(f"{{}}{i} IS NOT NULL" for i in n)
    cores = clustered.where(F.col("label") == CORE).select(F.col("cluster_id").cast("long").alias("c"), *[F.col(d).cast("double").alias(f"q{i}") for i, d in enumerate(dims)])
    cores = _cut(cores.where(known.format(*["q"] * len(dims))).groupBy(*[f"q{i}" for i in n]).agg(F.min("c").alias("c")))
    places = df.select(*[F.col(d).cast("double").alias(f"p{i}") for i, d in enumerate(dims)]).where(known.format(*["p"] * len(dims))).distinct()
    rest, here = places, None
    if metric is euclid:  # a core's own place is as near as any
        here = places.join(cores.withColumnsRenamed({f"q{i}": f"p{i}" for i in n}), [f"p{i}" for i in n])
        rest = places.join(cores.select(*[F.col(f"q{i}").alias(f"p{i}") for i in n]), [f"p{i}" for i in n], "left_anti")
    best = knn.nearest_places(rest, cores, len(dims), 1, "c", metric, float(eps)).select(*[f"p{i}" for i in n], "c")
    best = (best if here is None else best.union(here)).withColumnRenamed("c", "cluster_id")
    rows = df.withColumns({f"p{i}": F.col(d).cast("double") for i, d in enumerate(dims)})
    return rows.join(best, [f"p{i}" for i in n], "left").select(*df.columns, F.coalesce("cluster_id", F.lit(0).cast("long")).alias("cluster_id"))


def write_clusters(clustered: DataFrame, path: str, dims: list[str]) -> None:
    """Text lines of the coordinates and the cluster's number, with commas between."""
    clustered.select(F.concat_ws(",", *[F.col(d).cast("string") for d in dims], F.col("cluster_id").cast("string"))).write.text(path)


def num_clusters(clustered: DataFrame) -> DataFrame:
    return clustered.where("cluster_id > 0").agg(F.countDistinct("cluster_id").alias("n"))


def histogram(values: DataFrame, column: str, width: float) -> DataFrame:
    """bucket, lb, ub, num of values in buckets [bucket * width, (bucket + 1) * width)."""
    b = F.floor(F.col(column) / width).cast("long").alias("bucket")
    return values.where(F.col(column).isNotNull()).groupBy(b).agg(F.count("*").alias("num")).select("bucket", (F.col("bucket") * width).alias("lb"), ((F.col("bucket") + 1) * width).alias("ub"), "num")


def distance_histogram(df: DataFrame, width: float, dims: list[str], key: str = "id", reach: float | None = None) -> DataFrame:
    """Histogram of distances to the nearest other point. `reach` bounds the search at first; it doubles for points without one."""
    todo, reach, found = df, reach or width, None
    while True:
        pairs = todo.select(F.col(key).alias("a"), *dims)
        at = lambda c, r=reach: F.floor(F.col(c) / r).cast("long")
        p = pairs.select("a", *[F.col(d).alias(f"p{i}") for i, d in enumerate(dims)], *[at(d).alias(f"_c{i}") for i, d in enumerate(dims[:2])])
        for i in range(len(dims[:2])):
            p = p.withColumn(f"_c{i}", F.explode(F.array(*[F.col(f"_c{i}") + j for j in (-1, 0, 1)])))
        q = df.select(F.col(key).alias("b"), *[F.col(d).alias(f"q{i}") for i, d in enumerate(dims)], *[at(d).alias(f"_c{i}") for i, d in enumerate(dims[:2])])
        total = sum(((F.col(f"p{i}") - F.col(f"q{i}")) * (F.col(f"p{i}") - F.col(f"q{i}")) for i in range(len(dims))), F.lit(0.0))
        near = p.join(q, [f"_c{i}" for i in range(len(dims[:2]))]).where("a <> b").groupBy("a").agg(F.min(F.sqrt(total)).alias("d"))
        near = _cut(near.where(F.col("d") <= reach))
        found = near if found is None else found.union(near)
        todo = _cut(todo.join(near.select(F.col("a").alias(key)), key, "left_anti"))
        spans = df.agg(*[(F.max(d) - F.min(d)).alias(d) for d in dims]).first()
        if todo.isEmpty() or reach > 2 * max([spans[d] or 0.0 for d in dims]) * len(dims) ** 0.5 + width:
            return histogram(found, "d", width)
        reach *= 2


def neighbour_histogram(df: DataFrame, eps: float, dims: list[str], width: int = 1, key: str = "id") -> DataFrame:
    """Histogram of the numbers of other points at eps or less."""
    n = neighbours(df, eps, dims, key, closed=True).groupBy("a").agg((F.count("*") - 1).alias("n"))
    return histogram(n, "n", width)


def bounds(df: DataFrame, dims: list[str]) -> DataFrame:
    """Least and greatest value of each dimension, in one row."""
    return df.agg(*[f(d).alias(f"{n}_{d}") for d in dims for n, f in (("min", F.min), ("max", F.max))])
