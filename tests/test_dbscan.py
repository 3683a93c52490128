"""Clusters against a plain search, in one to three dimensions and with crowded places."""

import random

import pytest
from pyspark.sql import functions as F

from terracell.operators import dbscan


def plain(points, eps, least):
    near = {i: [j for j, q in points.items() if sum((a - b) ** 2 for a, b in zip(p, q)) ** 0.5 < eps] for i, p in points.items()}
    cores, label = {i for i in points if len(near[i]) >= least}, {}
    for i in sorted(cores):
        if i in label:
            continue
        todo, label[i] = [i], i + 1
        while todo:
            for j in near[todo.pop()]:
                if j in cores and j not in label:
                    label[j] = i + 1
                    todo.append(j)
    out = {i: (c, dbscan.CORE) for i, c in label.items()}
    for i in points:
        if i not in out:
            c = min((label[j] for j in near[i] if j in cores), default=0)
            out[i] = (c, dbscan.REACHABLE if c else dbscan.NOISE)
    return out


@pytest.mark.parametrize("n", [1, 2, 3])
def test_clusters(spark, n):
    rng = random.Random(n)
    points = {i: tuple(float(rng.randint(0, 24)) for _ in range(n)) for i in range(120)}
    points |= {200 + i: tuple(5 + rng.random() * 0.01 for _ in range(n)) for i in range(60)}  # a crowded place
    rows = [(i, *p, *[0.0] * (3 - n)) for i, p in points.items()] + [(999, None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "id long, x double, y double, z double").withColumn("c0", F.lit("mine"))
    for eps, least in ((2.0, 4), (1.0, 2), (4.5, 12)):
        got = {r["id"]: (r["cluster_id"], r["label"]) for r in dbscan.dbscan(df, eps, least, ["x", "y", "z"][:n]).collect()}
        assert got.pop(999) == (0, dbscan.NOISE)
        assert got == plain(points, eps, least)
    assert dbscan.dbscan(df.limit(0), 1.0, 2, ["x"]).count() == 0


def test_prediction_against_brute_force(spark, monkeypatch):
    """Nearest cores by place, with copies, equal distances, null coordinates, and a metric of one's own."""
    from terracell.operators import knn

    rng = random.Random(6)
    core = [(i, float(rng.randrange(25)), float(rng.randrange(25)), "core" if rng.random() < 0.8 else "reachable", 1 + rng.randrange(9)) for i in range(150)]
    pts = [(i, float(rng.randrange(-2, 27)) + rng.choice((0, 0.5)), float(rng.randrange(-2, 27))) for i in range(300)] + [(900, None, 1.0), (901, 300.0, 1.0)]
    clustered, df = spark.createDataFrame(core, "id long, x double, y double, label string, cluster_id long"), spark.createDataFrame(pts, "id long, x double, y double")
    seen, real = [], knn.nearest_places
    monkeypatch.setattr(knn, "nearest_places", lambda left, right, *more: seen.append((left.count(), right.count())) or real(left, right, *more))
    for metric, d in ((dbscan.euclid, lambda a, b: ((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2) ** 0.5), (lambda p, q: F.greatest(F.abs(p[0] - q[0]), F.abs(p[1] - q[1])), lambda a, b: max(abs(a[1] - b[1]), abs(a[2] - b[2])))):
        want = {a[0]: min(((d(a, b), b[4]) for b in core if a[1] is not None and b[3] == "core" and d(a, b) < 2), default=(0, 0))[1] for a in pts}
        assert {r["id"]: r["cluster_id"] for r in dbscan.predict(df, clustered, 2.0, ["x", "y"], metric=metric).collect()} == want
    assert seen[0][0] < seen[1][0] <= len({p[1:] for p in pts}) and seen[0][1] <= len({c[1:3] for c in core if c[3] == "core"})
    assert {r["cluster_id"] for r in dbscan.predict(df, clustered.limit(0), 2.0, ["x", "y"]).collect()} == {0}
