"""Spatial joins in SQL: the rows of the plain statement, by a plan that compares no cell with another."""

import collections
import random

import pytest

from terracell.functions.sql import register
from terracell.functions.types import st_box, st_point
from terracell.plans.spatial_sql import spatial_sql


@pytest.fixture(scope="module")
def views(spark):
    rng = random.Random(3)
    register(spark)
    spots = [(i, rng.uniform(0, 50), rng.uniform(0, 50)) for i in range(60)] + [(99, None, 1.0)]
    spark.createDataFrame(spots, "id int, x double, y double").withColumn("g", st_point("x", "y")).createOrReplaceTempView("spots")
    boxes = [(i, a, b, a + rng.uniform(1, 20), b + rng.uniform(1, 20)) for i in range(20) for a, b in [(rng.uniform(0, 40), rng.uniform(0, 40))]]
    spark.createDataFrame(boxes, "id int, a double, b double, c double, d double").withColumn("g", st_box("a", "b", "c", "d")).createOrReplaceTempView("boxes")
    texts = [(i, f"POINT ({x} {y})") for i, x, y in spots[:30]] + [(100, "POLYGON ((0 0, 30 0, 0 30, 0 0))")]
    spark.createDataFrame(texts, "id int, w string").createOrReplaceTempView("texts")
    grid = [((i % 5) * 10.0, (i // 5 + 1) * 10.0, 10, 10, 1.0, [float(i)] * 100) for i in range(25)]
    spark.createDataFrame([(i, t) for i, t in enumerate(grid)], "id int, tile struct<ulx:double,uly:double,width:int,height:int,pixelwidth:double,values:array<double>>").createOrReplaceTempView("grid")
    return spark


STATEMENTS = {
    "where": "SELECT s.id, b.id AS bid FROM spots s, boxes b WHERE st_containedby(s.g, b.g)",
    "on and more": "SELECT s.id, b.id AS bid FROM boxes b JOIN spots s ON st_contains(b.g, s.g) AND s.id > b.id WHERE s.id % 2 = 0",
    "turned": "SELECT b.id, count(*) AS n FROM boxes b JOIN spots s ON st_contains(b.g, s.g) GROUP BY b.id ORDER BY n DESC, 1",
    "same names": "SELECT * FROM (SELECT a.id, c.id AS other FROM boxes a, boxes c WHERE st_intersects(a.g, c.g)) WHERE id < other",
    "constructors": "SELECT t.id, b.id AS bid FROM texts t JOIN boxes b ON st_intersects(st_geomfromwkt(t.w), b.g)",
    "tile": "SELECT g.id, b.id AS bid FROM grid g, boxes b WHERE st_intersects(b.g, g.tile)",
    "left": "SELECT s.id, b.id AS bid FROM spots s LEFT JOIN boxes b ON st_intersects(s.g, b.g)",
    "semi": "SELECT s.id FROM spots s LEFT SEMI JOIN boxes b ON st_intersects(s.g, b.g)",
    "anti": "SELECT s.id FROM spots s LEFT ANTI JOIN boxes b ON st_intersects(s.g, b.g)",
    "in a query": "WITH h AS (SELECT s.id FROM spots s, boxes b WHERE st_intersects(s.g, b.g)) SELECT id, count(*) AS n FROM h GROUP BY id",
}


@pytest.mark.parametrize("name", sorted(STATEMENTS))
def test_rows_and_plan(views, name):
    df = spatial_sql(views, STATEMENTS[name])
    plain = views.sql(STATEMENTS[name].replace("LEFT SEMI", "LEFT SEMI")) if name not in ("left", "semi", "anti") else None
    got = collections.Counter(map(tuple, df.collect()))
    assert got
    if plain is not None:
        assert df.columns == plain.columns and got == collections.Counter(map(tuple, plain.collect()))
    else:
        inner = {tuple(r) for r in views.sql("SELECT s.id, b.id AS bid FROM spots s, boxes b WHERE st_intersects(s.g, b.g)").collect()}
        ids, have = [r[0] for r in views.table("spots").select("id").collect()], {i for i, _ in inner}
        want = {"left": inner | {(i, None) for i in ids if i not in have}, "semi": {(i,) for i in have}, "anti": {(i,) for i in ids if i not in have}}
        assert got == collections.Counter(want[name])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_other_statements_stay(views):
    assert spatial_sql(views, "SELECT id FROM spots WHERE st_intersects(g, st_geomfromwkt('POINT (1 1)')) OR id = 3").count() == 1
    assert spatial_sql(views, "SELECT a.id FROM texts a JOIN texts b ON a.id = b.id").count() == 31
