"""Values with a place and a time, derived from the test tables alike in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terracell.functions.types import st_box, st_point, with_time

_T = "timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({} AS TIMESTAMP_NTZ))"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def ev_points(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("value").alias("x"), F.col("user_id").cast("double").alias("y"), F.expr(_T.format("ts")).alias("t"), "event_type")
    return rows.withColumn("st", st_point("x", "y", instant="t"))


def ev_places(spark: SparkSession, sf: str) -> DataFrame:
    """Without times."""
    return ev_points(spark, sf).withColumn("st", st_point("x", "y"))


def ev_untimed(spark: SparkSession, sf: str) -> DataFrame:
    """Every third event has no time."""
    rows = ev_points(spark, sf).withColumn("t", F.when(F.col("id") % 3 != 0, F.col("t")))
    return rows.withColumn("st", st_point("x", "y", instant="t"))


def user_boxes(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").groupBy(F.col("user_id").alias("bid")).agg(F.min("value").alias("x0"), F.max("value").alias("x1"))
    e = e.withColumns({"y0": F.col("bid") - 0.5, "y1": F.col("bid") + 0.5})
    return e.withColumn("st", st_box("x0", "y0", "x1", "y1"))


def grid_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Ten by ten boxes over [0, 500] x [0, 150]."""
    i = spark.range(100).select(F.col("id").alias("gid"), ((F.col("id") % 10) * 50.0).alias("x0"), (F.floor(F.col("id") / 10) * 15.0).alias("y0"))
    return i.withColumns({"x1": F.col("x0") + 50, "y1": F.col("y0") + 15}).withColumn("st", st_box("x0", "y0", "x1", "y1"))


def plots(spark: SparkSession) -> DataFrame:
    """A plot in the middle of each of the hundred boxes, with free ground around it."""
    i = spark.range(100).select(F.col("id").alias("gid"), ((F.col("id") % 10) * 50.0 + 10).alias("x0"), (F.floor(F.col("id") / 10) * 15.0 + 3).alias("y0"))
    return i.withColumn("st", st_box("x0", "y0", F.col("x0") + 30, F.col("y0") + 9))


def month_intervals(spark: SparkSession) -> DataFrame:
    """The 84 months from 1995 on, up to the last second of each."""
    i = spark.range(84).select(F.col("id").alias("mid"), F.add_months(F.lit("1995-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    sec = lambda d: F.unix_date(d).cast("long") * 86400
    return i.select("mid", with_time(st_point(F.lit(0), F.lit(0)), start=sec(F.col("d")), end=sec(F.add_months("d", 1)) - 1).alias("st"))


def ord_intervals(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.expr(_T.format("o_orderdate")).alias("s"))
    o = o.withColumn("e", F.when(F.col("id") % 50 != 0, F.col("s") + (F.col("id") % 30) * 86400))
    return o.withColumn("st", with_time(st_point(F.col("id") % 100, F.lit(0)), start="s", end="e"))


def emb_points(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("embedding")
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), (v[0].cast("double") * 100).alias("x"), (v[1].cast("double") * 100).alias("y"))


def cust_points(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"), F.col("c_nationkey").cast("double").alias("y"))
    return c.withColumn("st", st_point("x", "y"))


def ev_tiles(spark: SparkSession, sf: str) -> DataFrame:
    from terracell.operators.raster import rasterize

    return rasterize(table(spark, sf, "events").select(F.col("value").alias("x"), F.col("user_id").cast("double").alias("y")), 10)


SQL = {
    "ev": "ev AS (SELECT event_id AS id, value AS x, user_id::DOUBLE AS y, floor(epoch(ts))::BIGINT AS t, event_type FROM events)",
    "evu": "evu AS (SELECT event_id AS id, value AS x, user_id::DOUBLE AS y, CASE WHEN event_id % 3 <> 0 THEN floor(epoch(ts))::BIGINT END AS t FROM events)",
    "ub": "ub AS (SELECT user_id AS bid, min(value) AS x0, max(value) AS x1, user_id - 0.5 AS y0, user_id + 0.5 AS y1 FROM events GROUP BY user_id)",
    "gb": "gb AS (SELECT i AS gid, (i % 10) * 50.0::DOUBLE AS x0, (i // 10) * 15.0::DOUBLE AS y0, (i % 10) * 50.0::DOUBLE + 50 AS x1, (i // 10) * 15.0::DOUBLE + 15 AS y1 FROM range(100) r(i))",
    "pl": "pl AS (SELECT i AS gid, (i % 10) * 50.0::DOUBLE + 10 AS x0, (i // 10) * 15.0::DOUBLE + 3 AS y0, (i % 10) * 50.0::DOUBLE + 40 AS x1, (i // 10) * 15.0::DOUBLE + 12 AS y1 FROM range(100) r(i))",
    "mo": "mo AS (SELECT i AS mid, epoch(TIMESTAMP '1995-01-01' + INTERVAL (i) MONTH)::BIGINT AS m0, epoch(TIMESTAMP '1995-01-01' + INTERVAL (i + 1) MONTH)::BIGINT - 1 AS m1 FROM range(84) r(i))",
    "oi": "oi AS (SELECT o_orderkey AS id, floor(epoch(o_orderdate))::BIGINT AS s, CASE WHEN o_orderkey % 50 <> 0 THEN floor(epoch(o_orderdate))::BIGINT + (o_orderkey % 30) * 86400 END AS e FROM orders)",
    "em": "em AS (SELECT vec_id AS id, embedding[1]::DOUBLE * 100 AS x, embedding[2]::DOUBLE * 100 AS y FROM embeddings)",
    "cu": "cu AS (SELECT c_custkey AS id, c_acctbal AS x, c_nationkey::DOUBLE AS y FROM customer)",
    "px": "px AS (SELECT floor(value / 10)::BIGINT AS tx, floor(user_id / 10)::BIGINT AS ty, least(floor(value - floor(value / 10) * 10), 9)::INT AS c, 9 - (user_id % 10)::INT AS r FROM events)",
    "tl": "tl AS (SELECT tx, ty, tx * 10.0::DOUBLE AS ulx, (ty + 1) * 10.0::DOUBLE AS uly, list_transform(range(100), lambda i: coalesce(m[i], 0)::DOUBLE) AS v FROM (SELECT tx, ty, map_from_entries(list((i, n))) AS m FROM (SELECT tx, ty, r * 10 + c AS i, count(*) AS n FROM px GROUP BY tx, ty, r, c) GROUP BY tx, ty))",
}


def sql(body: str, *names: str) -> str:
    """A statement with the derived tables that it needs."""
    order = [n for n in SQL if n in names or (n == "px" and "tl" in names)]
    return f"WITH RECURSIVE {', '.join(SQL[n] for n in order)}{', ' if body.lstrip().startswith('+') else ' '}{body.lstrip().removeprefix('+')}"
