"""Box and point math against plain Python, tile sinks, and the clusters' command line."""

import random

from pyspark.sql import functions as F

from terracell.functions import boxes
from terracell.functions.types import st_box
from terracell.operators import cluster_main, hull, skyline
from terracell.sources import rasters


def test_boxes_by_brute_force(spark):
    rng = random.Random(4)
    rows = [tuple(float(rng.randint(0, 6)) for _ in range(8)) for _ in range(80)]
    b = lambda i: boxes.box(boxes.point(F.col(f"_{i}"), F.col(f"_{i + 1}")), boxes.point(F.col(f"_{i + 2}"), F.col(f"_{i + 3}")))
    p, q = b(1), b(5)
    df = spark.createDataFrame(rows).select("*", boxes.volume(p).alias("vp"), boxes.overlap(p, q).alias("o"), boxes.difference(p, q, 2).alias("d"), boxes.contains(p, q).alias("c"), boxes.corners(p, 2).alias("k"), boxes.extend_point(p, boxes.point(7, 7), 0.5).alias("e"))
    for r in df.collect():
        (a, c, d, e), (f, g, h, i) = ((min(v[0], v[2]), min(v[1], v[3]), max(v[0], v[2]), max(v[1], v[3])) for v in (r[:4], r[4:8]))
        size = lambda x: (x["hi"][0] - x["lo"][0]) * (x["hi"][1] - x["lo"][1])
        shared = max(0, min(d, h) - max(a, f)) * max(0, min(e, i) - max(c, g))
        assert r["vp"] == (d - a) * (e - c) and (size(r["o"]) if r["o"] else 0) == shared
        assert sum(map(size, r["d"])) == r["vp"] - shared
        assert r["c"] == (a <= f and c <= g and d >= h and e >= i)
        assert r["k"] == [[a, c], [a, e], [d, c], [d, e]] and r["e"]["hi"] == [7.5, 7.5]


def test_images(spark, tmp_path):
    df = spark.createDataFrame([(0, 0, 1.0), (3, 2, 5.0)], "px int, py int, v double")
    made = rasters.image(df, 6, 4, color=lambda v: (255, 0, int(v)), background=(1, 2, 3), size=2, flip=True)
    assert made.startswith(b"\x89PNG") and b"IEND" in made
    rasters.save(spark, made, str(tmp_path / "a.png"))
    assert (tmp_path / "a.png").read_bytes() == made
    v = spark.range(1).select(st_box(1.0, 1.0, 4.0, 4.0).alias("st"))
    border, whole = (rasters.outline_pixels(v, 10, 10, 0.0, 0.0, 10.0, 10.0, fill=f).count() for f in (False, True))
    assert (border, whole) == (12, 16)


def test_cluster_command(spark, tmp_path):
    (tmp_path / "in.csv").write_text("\n".join(f"{x},{y}" for x, y in [(0, 0), (0, 1), (1, 0), (1, 1), (9, 9), (50, 50)]))
    cluster_main.main(["--input", str(tmp_path / "in.csv"), "--output", str(tmp_path / "out"), "--eps", "1.5", "--minPts", "3", "--ppd", "4"], spark)
    got = sorted(r[0] for r in spark.read.text(str(tmp_path / "out")).collect())
    assert len(got) == 6 and sum(line.endswith(",0") for line in got) == 2


def test_hull_and_skyline_of_nothing(spark):
    none = spark.createDataFrame([], "g string, x double, y double")
    assert hull.convex_hull(none, ["g"]).count() == 0
    from terracell.functions.types import st_point

    rows = none.select("g", st_point("x", "y", instant=F.lit(1)).alias("st"))
    for f in (skyline.skyline, skyline.skyline_by):
        assert f(rows, st_point(0, 0, instant=1)).count() == 0
    square = [("a", float(x), float(y)) for x in range(30) for y in range(30)]
    assert [(r["x"], r["y"]) for r in hull.convex_hull(spark.createDataFrame(square, "g string, x double, y double").repartition(5), ["g"]).orderBy("pos").collect()] == [(0, 0), (29, 0), (29, 29), (0, 29)]
