"""Joins, cells, clusters, skylines and storage, on small cases and against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from terracell.functions import tiles
from terracell.functions.types import st_box, st_point
from terracell.operators import cells, dbscan, hull, join, knn, skyline
from terracell.sources import partitioned, rasters


def boxes(spark, n, seed, name, wide):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x, y = rng.uniform(0, 100), rng.uniform(0, 100)
        w, h = (rng.uniform(0, wide if rng.random() < 0.95 else 80) for _ in range(2))
        rows.append((i, x, y, x + w, y + h))
    return rows, spark.createDataFrame(rows, f"{name} int, a double, b double, c double, d double").select(name, st_box("a", "b", "c", "d").alias("st"))


@pytest.mark.parametrize("side", [None, 3.0, 40.0])
def test_join_of_boxes_is_exact(spark, side):
    p, left = boxes(spark, 150, 1, "p", 6)
    q, right = boxes(spark, 130, 2, "q", 12)
    got = sorted(map(tuple, join.st_join(left, right, side=side).select("p", "q").collect()))
    want = sorted((r[0], s[0]) for r in p for s in q if r[1] <= s[3] and r[3] >= s[1] and r[2] <= s[4] and r[4] >= s[2])
    assert got == want
    anti = {r[0] for r in join.st_join(left, right, how="left_anti", side=side).select("p").collect()}
    assert anti == {r[0] for r in p} - {a for a, _ in want}


def test_join_with_nothing(spark):
    _, left = boxes(spark, 5, 1, "p", 6)
    none = left.limit(0).withColumnRenamed("p", "q")
    assert join.st_join(left, none).count() == 0
    assert join.st_join(left, none, how="left").count() == 5


def test_neighbours_of_far_points(spark):
    rng = random.Random(3)
    p = [(i, rng.uniform(0, 10), rng.uniform(0, 10)) for i in range(40)] + [(99, 5000.0, 5000.0)]
    q = [(i, rng.uniform(0, 10), rng.uniform(0, 10)) for i in range(60)]
    make = lambda rows: spark.createDataFrame(rows, "id int, x double, y double").select("id", st_point("x", "y").alias("st"))
    got = sorted((r["id"], r["r_id"]) for r in knn.knn_join(make(p), make(q), 3).collect())
    want = sorted((a[0], b[0]) for a in p for b in sorted(q, key=lambda b: ((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2, b[0]))[:3])
    assert got == want


def test_grid_cells(spark):
    g = cells.Grid(cells.Extent(0, 0, 4, 4), 4, 4)
    r = spark.range(1).select(g.cells_in(F.lit(2.0), F.lit(1.0), F.lit(3.5), F.lit(2.5)).alias("c")).first()
    assert set(r["c"]) == {6, 7, 10, 11}
    pts = spark.createDataFrame([(2.0, 2.0), (2.5, 2.5), (2.0, 4.0), (4.0, 2.0), (4.0, 4.0)], "x double, y double").select(st_point("x", "y").alias("st"))
    h = {r["cell"]: r["n"] for r in cells.grid_histogram(pts, cells.Grid(cells.Extent(0, 0, 9, 9), 3, 3)).collect()}
    assert h == {0: 2, 1: 1, 2: 0, 3: 1, 4: 1, 5: 0, 6: 0, 7: 0, 8: 0}


def test_angular_cells(spark):
    pts = spark.createDataFrame([(1.0, 1.0), (-1.0, 1.0), (-1.0, -1.0), (1.0, -1.0)], "x double, y double").select(st_point("x", "y").alias("st"))
    assert sorted(r["cell"] for r in cells.angular_cells(pts, 4).collect()) == [0, 1, 2, 3]


def test_binary_splits_hold_all(spark):
    rng = random.Random(8)
    pts = spark.createDataFrame([(rng.gauss(5, 1), rng.gauss(5, 1)) for _ in range(400)], "x double, y double").select(st_point("x", "y").alias("st"))
    b = cells.bsp_cells(pts, 0.5, 40, points=True)
    n = [r["count"] for r in cells.box_cells(pts, b).groupBy("cell").count().collect()]
    assert sum(n) == 400 and len(n) > 8


def test_clusters(spark):
    rng = random.Random(4)
    pts = [(i, rng.choice((0, 20, 40)) + rng.gauss(0, 1.2), rng.gauss(0, 1.2)) for i in range(150)] + [(500, 200.0, 200.0)]
    out = dbscan.dbscan(spark.createDataFrame(pts, "id long, x double, y double"), 0.9, 4, ["x", "y"])
    near = {a: [b for b, u, v in pts if ((x - u) ** 2 + (y - v) ** 2) ** 0.5 < 0.9] for a, x, y in pts}
    core = {a for a, n in near.items() if len(n) >= 4}
    label, todo = {}, sorted(core)
    for c in todo:
        if c not in label:
            stack = [c]
            while stack:
                v = stack.pop()
                if v not in label:
                    label[v] = c + 1
                    stack += [w for w in near[v] if w in core]
    want = {a: label.get(a, min((label[b] for b in near[a] if b in core), default=0)) for a, _, _ in pts}
    assert {r["id"]: r["cluster_id"] for r in out.collect()} == want


def test_fixed_width_histogram(spark):
    v = spark.createDataFrame([(float(x),) for x in (0, 15, 20, 27, 1, 9, 10, 11, 29.5)], "v double")
    assert {r["bucket"]: r["num"] for r in dbscan.histogram(v, "v", 10.0).collect()} == {0: 3, 1: 3, 2: 3}


def test_skyline_of_ties(spark):
    rows = [(1, 1.0, 5), (2, 1.0, 5), (3, 1.0, 6), (4, 2.0, 4), (5, 3.0, 4), (6, 9.0, 0)]
    df = spark.createDataFrame(rows, "id int, x double, t long").withColumn("st", st_point("x", F.lit(0.0), instant="t"))
    for angular in (False, True):
        assert sorted(r["id"] for r in skyline.skyline(df, st_point(0, 0, instant=0), angular=angular).collect()) == [1, 2, 4, 6]


def test_hull(spark):
    pts = spark.createDataFrame([("a", float(x), float(y)) for x in range(5) for y in range(5)], "g string, x double, y double")
    assert [(r["x"], r["y"]) for r in hull.convex_hull(pts, ["g"]).orderBy("pos").collect()] == [(0, 0), (4, 0), (4, 4), (0, 4)]


def test_storage_reads_cells_that_matter(spark, tmp_path):
    pts = spark.range(1000).select("id", st_point(F.col("id") % 100, F.floor(F.col("id") / 10)).alias("st"))
    g = cells.Grid(cells.Extent(0, 0, 100, 100), 4, 4)
    partitioned.write(cells.grid_cells(pts, g, points=True), str(tmp_path / "p"))
    box = st_box(1, 1, 9, 9)
    assert partitioned.cells_to_load(spark, str(tmp_path / "p"), box).count() == 1
    read = partitioned.read(spark, str(tmp_path / "p"), box)
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "cell" in plan.split("PartitionFilters:")[1][:60]
    assert read.count() == pts.where("id % 100 BETWEEN 1 AND 9 AND id / 10 >= 1 AND floor(id / 10) <= 9").count()


def test_tiles_as_text(spark, tmp_path):
    df = spark.range(3).select(tiles.filled(F.col("id") * 2.0, 2.0, 2, 2, 7.5).alias("tile"))
    rasters.write_tiles(df, str(tmp_path / "t"))
    back = rasters.read_tiles(spark, str(tmp_path / "t"))
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    assert rasters.read_tiles(spark, str(tmp_path / "t"), st_box(0, 0, 1, 1)).count() == 1


def test_image_tiles(spark, tmp_path):
    name = "a_b_c_d_e_f_g_h_101_100.pgm"
    (tmp_path / name).write_bytes(b"P5\n# grey\n2 2\n255\n" + bytes([1, 2, 3, 4]))
    t = rasters.read_image_tiles(spark, str(tmp_path)).first()["tile"]
    assert (t["ulx"], t["uly"], t["values"]) == (2.0, 2.0, [1.0, 2.0, 3.0, 4.0])
    pixels = rasters.image_pixels(rasters.read_image_tiles(spark, str(tmp_path)), 2, 2)
    assert rasters.image(pixels, 2, 2).startswith(b"\x89PNG")


def test_strategies_change_no_result(spark, tmp_path):
    from terracell.operators import strategies as s
    from terracell.operators.filter import st_filter

    df = spark.range(300).select("id", st_point(F.col("id") % 20, F.floor(F.col("id") / 20), instant=F.col("id")).alias("st"))
    box = st_box(2, 2, 9, 9, start=0, end=250)
    want = sorted(r["id"] for r in st_filter(df, box).collect())
    for strategy in (s.GridStrategy(3, True), s.BspStrategy(2.0, 40, True), s.TileStrategy(2, 3), s.TimeStrategy(4), s.TimeStrategy(4, True), s.SpaceTimeStrategy(2, 3, True), s.AngularStrategy(4), s.NoStrategy()):
        assert sorted(r["id"] for r in st_filter(s.live_index(df, strategy), box).collect()) == want
    s.index(df, str(tmp_path / "i"), s.GridStrategy(3, True))
    assert sorted(r["id"] for r in s.items(partitioned.read(spark, str(tmp_path / "i"), box)).collect()) == want


def test_interval_join_of_all_orders(spark, sf):
    from terracell.plans.fixtures import ord_intervals
    from terracell.plans.queries import QUERIES

    rows = [tuple(r) for r in ord_intervals(spark, sf).select("id", "s", "e").collect()]
    want = {(i, j) for i, s, e in rows for j, t, f in rows if i < j and (f is None or s <= f) and (e is None or t <= e)}
    got = [tuple(r) for r in QUERIES["j_interval_all"](spark, sf).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_interval_pairs_against_brute_force(spark):
    """Open, reversed and equal intervals, repeated keys and rows without a time."""
    rng = random.Random(12)
    rows = [(rng.randrange(90), s, rng.choice((None, s, s + rng.randrange(40), s + 500, s - 3))) for s in (rng.randrange(1000) for _ in range(120))] + [(95, None, None), (None, 3, 9)]
    df = spark.createDataFrame(rows, "id long, s long, e long").select("id", st_point(F.lit(0), F.lit(0), start="s", end="e").alias("st"))
    meet = lambda a, b: (b[2] is None or a[1] <= b[2]) and (a[2] is None or b[1] <= a[2])
    known = [r for r in rows if r[0] is not None and r[1] is not None]
    want = sorted((a[0], b[0]) for a in known for b in known if a[0] < b[0] and meet(a, b))
    for width in (None, 1, 5000):
        assert sorted(tuple(r) for r in join.interval_pairs(df, width=width).collect()) == want
    assert join.interval_pairs(df.limit(0)).count() == 0


def test_box_of_places_among_many_boxes(spark, monkeypatch):
    """As comparing with every box does, by the table and by blocks: borders, gaps, overlaps, places outside and null ones."""
    rng = random.Random(5)
    made = [cells.Extent(x, y, x + w, y + h) for x, y, w, h in ((rng.randrange(60), rng.randrange(60), rng.randrange(1, 9), rng.randrange(1, 9)) for _ in range(700))]
    pts = [(i, rng.choice((float(rng.randrange(-5, 75)), rng.uniform(-5, 75))), float(rng.randrange(-5, 75))) for i in range(600)] + [(990, None, 2.0)]

    def box(x, y):
        if x is None:
            return 0
        held = [i for i, b in enumerate(made) if b.xmin <= x < b.xmax and b.ymin <= y < b.ymax]
        far = lambda b: min(((x - u) * (x - u) + (y - v) * (y - v)) ** 0.5 for u in (b.xmin, b.xmax) for v in (b.ymin, b.ymax))
        return held[0] if held else min(range(len(made)), key=lambda i: (far(made[i]), i))

    want = {i: box(x, y) for i, x, y in pts}
    df = spark.createDataFrame(pts, "id int, x double, y double").select("id", st_point("x", "y").alias("st"))
    assert {r["id"]: r["cell"] for r in cells.box_cells(df, made, points=True).collect()} == want
    assert {r["id"]: r["cell"] for r in cells.box_cells(df, made).collect()} == want
    monkeypatch.setattr(cells, "TABLE", 0)
    assert {r["id"]: r["cell"] for r in cells.box_cells(df, made, points=True).collect()} == want
    assert len(cells.box_cells(df, made).limit(1)._jdf.queryExecution().optimizedPlan().toString()) < 50_000


def test_neighbours_of_places_with_many_rows(spark):
    """Copies on both sides are compared by place: against brute force, and with few rows in the step that compares."""
    rng = random.Random(21)
    spots = [(float(rng.randrange(30)), float(rng.randrange(3))) for _ in range(25)]
    p = [(i, *rng.choice(spots)) for i in range(200)] + [(500, -0.0, 900.0), (501, None, 1.0)]
    q = [(i, *rng.choice(spots)) for i in range(300)] + [(600, None, None)]
    make = lambda rows: spark.createDataFrame(rows, "id int, x double, y double").select("id", st_point("x", "y").alias("st"))
    got = sorted((r["id"], r["rank"], r["r_id"], round(r["dist"], 9)) for r in knn.knn_join(make(p), make(q), 4).collect())
    d = lambda a, b: ((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2) ** 0.5
    want = sorted((a[0], n, b[0], round(d(a, b), 9)) for a in p if a[1] is not None for n, b in enumerate(sorted(q[:-1], key=lambda b: (d(a, b), b[0]))[:4], 1))
    assert got == want

    compared = []
    real = knn.nearest_places
    try:
        knn.nearest_places = lambda left, right, *more, **named: compared.append((left.count(), right.count(), right.columns)) or real(left, right, *more, **named)
        knn.knn_join(make(p), make(q), 4).count()
    finally:
        knn.nearest_places = real
    assert compared[0][0] <= 26 and compared[0][1] <= 100 and "r_st" not in compared[0][2]
    assert knn.knn_join(make(p), make(q[-1:]), 4).count() == 0


def test_skyline_by_probes_is_that_of_all_pairs(spark, monkeypatch):
    """Any strict rule, with places taken out by a few before they are compared: against brute force."""
    rng = random.Random(31)
    pts = [(i, float(rng.randrange(300)), rng.randrange(300)) for i in range(1500)] + [(3000, 2.0, 1), (3001, 1.0, 2), (3002, 2.0, 1)]
    df = spark.createDataFrame(pts, "id int, x double, t long").select("id", st_point("x", F.lit(0.0), instant="t").alias("st"))
    query, held, real = st_point(0.0, 0.0, instant=0), [], skyline.stored
    monkeypatch.setattr(skyline, "FEW", 40)
    monkeypatch.setattr(skyline, "PROBES", 25)
    monkeypatch.setattr(skyline, "stored", lambda d, name: held.append((name, real(d, name))) or held[-1][1])
    metric = lambda a, b: F.struct(F.abs(a["xmin"] - b["xmin"]).alias("s"), F.abs(a["t_start"] - b["t_start"]).cast("double").alias("t"))
    rules = [
        (lambda a, b: (a["sd"] < b["sd"]) & (a["td"] < b["td"]), lambda a, b: a[1] < b[1] and a[2] < b[2]),
        (lambda a, b: (a["sd"] > b["sd"]) & (a["td"] < b["td"]), lambda a, b: a[1] > b[1] and a[2] < b[2]),
        (lambda a, b: a["sd"] + 280 < b["sd"], lambda a, b: a[1] + 280 < b[1]),
    ]
    for beats, plain in rules:
        held.clear()
        got = sorted(r["id"] for r in skyline.skyline_by(df, query, beats, metric=metric, parts=3).collect())
        assert got == sorted(a[0] for a in pts if not any(plain(b, a) for b in pts))
        sizes = [d.count() for name, d in held if name == "places"]
        assert len(sizes) > 1 and sizes[-1] <= sizes[0]
