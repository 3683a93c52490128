"""Times, geometries, text forms and tiles, on values with known answers."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from terracell.functions import distance, kernel, predicates, temporal, tiles, wkt
from terracell.functions.types import st_box, st_line, st_point, st_polygon, with_time


def one(spark, *cols):
    r = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()
    return r[0] if len(cols) == 1 else tuple(r)


def at(i=None, s=None, e=None):
    return st_point(0, 0, instant=i, start=s, end=e)


@pytest.mark.parametrize(
    "f, a, b, want",
    [
        (temporal.t_lt, dict(s=1, e=3), dict(s=2, e=3), False),
        (temporal.t_lt, dict(s=1, e=2), dict(s=2, e=3), True),
        (temporal.t_lt, dict(s=1), dict(s=2, e=3), False),
        (temporal.t_lt, dict(s=1, e=2), dict(s=2), True),
        (temporal.t_le, dict(s=1, e=3), dict(s=1, e=3), True),
        (temporal.t_contains, dict(s=1), dict(s=1), False),
        (temporal.t_contains, dict(s=1), dict(s=2, e=9), True),
        (temporal.t_contains, dict(s=1, e=5), dict(i=5), True),
        (temporal.t_contains, dict(i=5), dict(s=5, e=5), True),
        (temporal.t_intersects, dict(s=1, e=5), dict(s=5), True),
        (temporal.t_intersects, dict(s=1, e=4), dict(i=5), False),
        (temporal.t_intersects, dict(i=5), dict(i=5), True),
        (temporal.t_intersects, dict(), dict(i=5), False),
    ],
)
def test_times(spark, f, a, b, want):
    assert one(spark, f(at(**a), at(**b))) is want


def test_center_and_length(spark):
    assert one(spark, temporal.t_center(at(s=1, e=4)), temporal.t_length(at(s=1, e=4)), temporal.t_center(at(s=1)), temporal.t_length(at(i=7))) == (2, 3, None, 0)


def test_rule_of_space_and_time(spark):
    box, p = st_box(0, 0, 10, 10), st_point(5, 5)
    timed = lambda g, *t: with_time(g, start=t[0], end=t[1])
    assert one(spark, predicates.st_contains(box, p), predicates.st_contains(timed(box, 10, 100), p), predicates.st_contains(timed(box, 10, 100), with_time(p, instant=50)), predicates.st_contains(timed(box, 10, 100), with_time(p, instant=101))) == (True, False, True, False)


def test_null_is_false(spark):
    nothing = st_point(F.lit(None).cast("double"), 1)
    assert one(spark, predicates.st_intersects(nothing, st_box(0, 0, 1, 1))) is False


def test_borders(spark):
    box = st_box(0, 0, 4, 4)
    c, v, i = predicates.st_contains, predicates.st_covers, predicates.st_intersects
    corner, edge, mid = st_point(0, 0), st_point(2, 0), st_point(2, 2)
    assert one(spark, *[f(box, p) for p in (corner, edge, mid) for f in (c, v, i)]) == (False, True, True, False, True, True, True, True, True)
    along, across = st_line([(0, 0), (4, 0)]), st_line([(0, 0), (4, 4)])
    assert one(spark, *[f(box, g, "any") for g in (along, across, box) for f in (c, v)]) == (False, True, True, True, True, True)
    side = st_box(4, 0, 8, 4)
    assert one(spark, c(box, side, "any"), v(box, side, "any"), i(box, side, "any"), i(box, side)) == (False, False, True, True)
    line = st_line([(0, 0), (2, 0)])
    assert one(spark, c(line, st_point(2, 0), "any"), v(line, st_point(2, 0), "any"), c(line, st_point(1, 0), "any")) == (False, True, True)


def test_hole(spark):
    ring = st_polygon([(0, 0), (9, 0), (9, 9), (0, 9)], [[(3, 3), (6, 3), (6, 6), (3, 6)]])
    assert one(spark, *[predicates.st_intersects(ring, st_point(x, y)) for x, y in ((1, 1), (4, 4), (3, 4))]) == (True, False, True)
    assert one(spark, predicates.st_contains(ring, st_box(1, 1, 8, 8), "any"), predicates.st_contains(ring, st_box(0, 0, 2, 2), "any"), predicates.st_intersects(ring, st_box(4, 4, 5, 5), "any")) == (False, True, False)


def test_kernel_against_the_platforms_geometry_library(spark):
    reader = spark._jvm.org.locationtech.jts.io.WKTReader()
    rng = random.Random(5)

    def ring(n):
        cx, cy = rng.randint(0, 8), rng.randint(0, 8)
        import math

        pts = [(cx + round(rng.uniform(1, 4) * math.cos(2 * math.pi * k / n)), cy + round(rng.uniform(1, 4) * math.sin(2 * math.pi * k / n))) for k in range(n)]
        return [*pts, pts[0]]

    def shape():
        kind = rng.choice("PLLGGG")
        if kind == "P":
            return f"POINT ({rng.randint(0, 8)} {rng.randint(0, 8)})"
        if kind == "L":
            return "LINESTRING (" + ", ".join(f"{rng.randint(0, 8)} {rng.randint(0, 8)}" for _ in range(rng.randint(2, 4))) + ")"
        return "POLYGON ((" + ", ".join(f"{x} {y}" for x, y in ring(rng.randint(3, 6))) + "))"

    done = 0
    while done < 250:
        a, b = shape(), shape()
        p, q = reader.read(a), reader.read(b)
        if not (p.isSimple() and q.isSimple() and p.isValid() and q.isValid()):
            continue
        s, t = (kernel.Shape(*wkt.parse(x)) for x in (a, b))
        assert (kernel.intersects(s, t), kernel.contains(s, t), kernel.covers(s, t)) == (p.intersects(q), p.contains(q), p.covers(q)), (a, b)
        done += 1


def test_text_forms(spark):
    for text in ("POINT (1.5 2)", "LINESTRING (0 0, 1 1)", "POLYGON ((-73 40.5, -70 40.5, -72 41, -73 40.5))", "POLYGON ((0 0, 9 0, 9 9, 0 9, 0 0), (3 3, 6 3, 6 6, 3 3))", "MULTIPOINT ((1 2), (3 4))", "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5)))"):
        assert wkt.write(*wkt.parse(text)) == text
        assert one(spark, wkt.st_wkt(wkt.literal(text))) == text
    assert (wkt.number(1e-10), wkt.number(1e20)) == ("0.0000000001", "100000000000000000000")
    for bad in ("POINT (1)", "POINT 1 2", "CIRCLE (1 2)", "POINT (1 2) x", ""):
        with pytest.raises((ValueError, IndexError)):
            wkt.parse(bad)
    df = spark.createDataFrame([("POINT (1 2.5)",), ("LINESTRING (0 0, 1 1)",), (None,)], "t string")
    assert [r[0] for r in df.select(wkt.st_wkt(wkt.st_pointfromwkt("t"))).collect()] == ["POINT (1 2.5)", None, None]


def test_sql_functions(spark):
    from terracell.functions.sql import register

    register(spark)
    q = lambda s: spark.sql(f"SELECT {s} AS v").first()[0]
    assert q("st_sto('POINT(1 1)', 2020, 2, 16).t_start") == 1581811200
    assert q("st_sto('POINT(1 1)', DATE'2020-02-16').t_start") == 1581811200
    assert q("st_wkt(st_geomfromwkt('POLYGON ((-73.0 40.5, -70 40.5, -72 41, -73.0 40.5))'))") == "POLYGON ((-73 40.5, -70 40.5, -72 41, -73 40.5))"
    assert q("st_containedby(st_point(25, 20), st_geomfromwkt('POLYGON ((30 10, 40 40, 20 40, 10 20, 30 10))'))")
    tile = "named_struct('ulx', 0D, 'uly', 2D, 'width', 2, 'height', 2, 'pixelwidth', 1D, 'values', array(1D, 5D, 3D, 3D))"
    assert q(f"array(ulx({tile}), uly({tile}), width({tile}), height({tile}), r_max({tile}), r_min({tile}), r_median({tile}))") == [0, 2, 2, 2, 5, 1, 3]
    assert q(f"st_wkt(st_geomfromtile({tile}))") == "POLYGON ((0 0, 2 0, 2 2, 0 2, 0 0))"
    buckets = spark.sql(f"SELECT h_value(b) AS n, h_lower(b) AS lo, h_upper(b) AS hi FROM (SELECT explode(histogram({tile}, 3)) AS b)")
    assert sorted(map(tuple, buckets.collect())) == [(1, 1, 1), (1, 5, 5), (2, 3, 3)]
    spark.sql(f"SELECT {tile} AS tile").createOrReplaceTempView("some_tiles")
    assert sum(b["values"] for b in spark.sql("SELECT rasterhistogram(tile) AS h FROM some_tiles").first()[0]) == 4


def test_measures(spark):
    poly = st_polygon([(0, 0), (9, 0), (9, 9), (0, 9)], [[(3, 3), (6, 3), (6, 6), (3, 6)]])
    c = distance.st_centroid(poly)
    assert one(spark, distance.st_area(poly), c["x"], c["y"]) == pytest.approx((72.0, 4.5, 4.5))
    line = distance.st_centroid(st_line([(0, 0), (2, 0), (2, 2)]))
    assert one(spark, line["x"], line["y"]) == pytest.approx((1.5, 0.5))
    assert one(spark, distance.shausdorff(st_point(0, 0), poly)) is None
    assert one(spark, distance.thausdorff(at(s=1, e=5), at(i=3))) == 2.0


def test_tiles(spark):
    t = tiles.tile(0, 11, 16, 11, F.array(*[F.lit(float(i)) for i in range(176)]))
    assert one(spark, *[tiles.value_at(t, F.lit(x), F.lit(y)) for x, y in ((4.5, 6.5), (14.5, 0.5), (0.0, 11.0))]) == (68, 174, 0)
    small = tiles.square(3, 3, F.array(*[F.lit(float(i)) for i in (0, 0, 1, 2, 1, 0, 2, 1, 0)]))
    assert one(spark, *[tiles.count_value(small, v) for v in (1, 2, 0, 7)]) == (3, 2, 4, 0)
    assert one(spark, tiles.set_value(small, F.lit(1), F.lit(9.0))["values"])[:3] == [0, 9, 1]
    empty = tiles.tile(0, 0, 0, 0, F.array())
    assert one(spark, tiles.sma(empty), tiles.count_value(empty, 1)) == (None, 0)


def test_mask_by_polygon(spark):
    t = tiles.tile(0, 7, 11, 7, F.array(*[F.lit(float(i)) for i in range(77)]))
    df = spark.range(1).select(t.alias("tile"), wkt.literal("POLYGON ((5 -1, 7.5 3.5, 13 5.5, 13 -1, 5 -1))").alias("g"))
    out = df.select(tiles.mask_any("intersects", -1)(F.col("tile"), F.struct("g.gtype", "g.parts"))).first()[0]
    assert (out["width"], out["height"]) == (6, 5)
    want = [*range(29, 33), *range(39, 44), *range(49, 55), *range(60, 66), *range(71, 77)]
    assert sorted(out["values"]) == [-1.0] * (30 - len(want)) + [float(v) for v in want]


def test_raster_filter_counts(spark):
    from terracell.operators import raster

    i = spark.range(100)
    df = i.select(tiles.filled((F.col("id") % 10) * 10, (F.floor(F.col("id") / 10) + 1) * 10, 10, 10, 1.0).alias("tile"))
    box = raster.raster_filter(df, st_box(11, 11, 89, 89))
    assert box.count() == 64
    assert raster.raster_filter(df, st_box(51, 51, 51.5, 51.5)).count() == 1


def test_st_sto_parses_each_text_of_a_batch_once(spark, monkeypatch):
    import pyarrow as pa

    from terracell.functions import sql as names

    parsed, real = [], names._row
    monkeypatch.setattr(names, "_row", lambda t: parsed.append(t) or real(t))
    dates = pa.array([datetime.date(1969, 12, 31), None, datetime.date(2020, 2, 16), datetime.date(1, 1, 1)])
    out = names._sto(pa.array(["POINT (1 2)", "POINT EMPTY", "POINT (1 2)", "POINT Z (1 2 3)"]), dates).to_pylist()
    assert len(parsed) == 3 and [r["t_start"] for r in out] == [-86_400, None, 1_581_811_200, -62_135_596_800]
    assert [r["t_kind"] for r in out] == [1, None, 1, 1] and [r["xmin"] for r in out] == [1.0, None, 1.0, 1.0] and out[3]["zmax"] == 3.0
    names.register(spark)
    row = spark.sql("SELECT st_sto('LINESTRING (0 0, 1 3)') AS a, st_sto('POINT (1 1)', TIMESTAMP'2020-02-16 23:00:00') AS b, st_sto('POINT (1 1)', CAST(NULL AS DATE)) AS c, st_sto('POINT (1 1)', 2020, 2, CAST(NULL AS INT)) AS d").first()
    assert row["a"]["parts"][0][0][1]["y"] == 3.0 and row["a"]["t_kind"] is None and row["b"]["t_start"] == row["b"]["t_end"] == 1_581_811_200
    assert row["c"]["t_kind"] is None and row["d"]["t_start"] is None
