"""Partitioned storage of spatio-temporal values.

Values are written as Parquet, a folder for each cell, sorted by place inside, with a table of the cells' extents beside
them. Readers choose cells by their extents (partition pruning) and rows by their envelopes (statistics of row groups).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terracell.functions import distance
from terracell.operators.filter import st_filter
from terracell.operators.join import broadcast_join as _broadcast_join
from terracell.operators.join import st_join

INFO = "partition_info"


def write(df: DataFrame, path: str, cell: str = "cell", st: str = "st", mode: str = "error", options: dict[str, str] | None = None, order: str = "xmin") -> None:
    """Without a cell column all rows are one cell. A cell's rows come from one task; a hot cell is split by AQE's rebalancing."""
    rows = df if cell in df.columns else df.withColumn(cell, F.lit(0))
    v = F.col(st)
    rows = rows.hint("rebalance", cell).sortWithinPartitions(cell, v[order], v["ymin"])
    rows.write.options(**(options or {})).mode(mode).partitionBy(cell).parquet(f"{path}/data")
    ends = F.when(F.count(F.when(v["t_kind"].isNotNull() & v["t_end"].isNull(), 1)) == 0, F.max(v["t_end"]))
    info = df.sparkSession.read.parquet(f"{path}/data").groupBy(cell).agg(F.min(v["xmin"]).alias("xmin"), F.min(v["ymin"]).alias("ymin"), F.max(v["xmax"]).alias("xmax"), F.max(v["ymax"]).alias("ymax"), F.min(v["t_start"]).alias("t_start"), ends.alias("t_end"), F.count(F.when(v["t_kind"].isNull(), 1)).alias("untimed"), F.count("*").alias("n"))
    info.coalesce(1).write.mode(mode).parquet(f"{path}/{INFO}")


def write_text(df: DataFrame, path: str, line: Column, cell: str = "cell", st: str = "st", mode: str = "error") -> None:
    """Text lines, a folder for each cell, and lines `wkt;start;end;file` of the cells' extents and times beside them.

    An extent's `start` is empty where a value of the cell has no time, and `end` where one has none or leaves it open.
    """
    rows = df if cell in df.columns else df.withColumn(cell, F.lit(0))
    v = F.col(st)
    made = rows.select(line.cast("string").alias("value"), F.col(cell).alias("cell"), v.alias("_st"))
    made.select("value", "cell").hint("rebalance", "cell").write.mode(mode).partitionBy("cell").text(f"{path}/data")
    v = F.col("_st")
    timed = F.count(F.when(v["t_kind"].isNull(), 1)) == 0
    ended = timed & (F.count(F.when(v["t_end"].isNull(), 1)) == 0)
    e = made.groupBy("cell").agg(*[f(v[n]).alias(n) for n, f in (("xmin", F.min), ("ymin", F.min), ("xmax", F.max), ("ymax", F.max))], F.when(timed, F.min(v["t_start"])).alias("a"), F.when(ended, F.max(v["t_end"])).alias("b"))
    place = lambda x, y: F.concat(F.col(x).cast("string"), F.lit(" "), F.col(y).cast("string"))
    ring = F.concat(F.lit("POLYGON (("), F.array_join(F.array(place("xmin", "ymin"), place("xmax", "ymin"), place("xmax", "ymax"), place("xmin", "ymax"), place("xmin", "ymin")), ", "), F.lit("))"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    e.select(F.concat_ws(";", ring, text("a"), text("b"), F.concat(F.lit("cell="), F.col("cell").cast("string")))).coalesce(1).write.mode(mode).text(f"{path}/{INFO}")


def read_text(spark: SparkSession, path: str, query: Column | None = None) -> DataFrame:
    """(value, cell): the lines of the cells whose extents meet the query's in space and, if both have one, in time."""
    rows = spark.read.text(f"{path}/data")
    if query is None or not has_info(spark, path):
        return rows
    e = read_text_info(spark, f"{path}/{INFO}")
    v = F.col("st")
    near = (v["xmin"] <= query["xmax"]) & (v["xmax"] >= query["xmin"]) & (v["ymin"] <= query["ymax"]) & (v["ymax"] >= query["ymin"])
    far = F.lit(2**63 - 1)
    timed = query["t_kind"].isNull() | F.col("t_start").isNull() | (F.col("t_start") <= F.coalesce(query["t_end"], far)) & (F.coalesce("t_end", far) >= query["t_start"])
    wanted = [r[0] for r in e.where(near & timed).select(F.substring_index("file", "=", -1).cast("int")).collect()]  # one number for each cell
    return rows.where(F.col("cell").isin(wanted))


def has_info(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{INFO}")
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def info(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{INFO}")


def cells_to_load(spark: SparkSession, path: str, query: Column, cell: str = "cell") -> DataFrame:
    """Cells whose extent meets the query's: in time too, if the query has one and no value of the cell is without."""
    rows = info(spark, path)
    near = rows.where((F.col("xmin") <= query["xmax"]) & (F.col("xmax") >= query["xmin"]) & (F.col("ymin") <= query["ymax"]) & (F.col("ymax") >= query["ymin"]))
    timed = (F.col("t_start") <= F.coalesce(query["t_end"], F.lit(2**63 - 1))) & (F.coalesce("t_end", F.lit(2**63 - 1)) >= query["t_start"])
    return near.where(F.when(query["t_kind"].isNull(), F.col("untimed") > 0).otherwise(F.coalesce(timed, F.lit(False)))).select(cell)


def read(spark: SparkSession, path: str, query: Column | None = None, name: str = "intersects", cell: str = "cell", st: str = "st", kinds: str | tuple[str, str] = "simple") -> DataFrame:
    """All rows, or those that stand in the predicate to the query, from the cells that can hold any."""
    rows = spark.read.parquet(f"{path}/data")
    if query is None:
        return rows
    if has_info(spark, path):
        wanted = [r[0] for r in cells_to_load(spark, path, query, cell).collect()]  # one number for each cell
        rows = rows.where(F.col(cell).isin(wanted))
    return st_filter(rows, query, name, st, kinds)


def knn(spark: SparkSession, path: str, x: float, y: float, k: int, cell: str = "cell", st: str = "st", key: str = "id") -> DataFrame:
    """k nearest points: the cells around the place that hold k rows bound the distance; then cells within it are read."""
    from terracell.functions.types import st_point

    query, e = st_point(x, y), info(spark, path)
    gap = lambda lo, hi, v: F.greatest(F.col(lo) - v, F.lit(v) - F.col(hi), F.lit(0.0))
    e = e.withColumn("d", F.sqrt(F.pow(gap("xmin", "xmax", x), 2) + F.pow(gap("ymin", "ymax", y), 2)))
    near = e.orderBy("d", cell).select(cell, "d", "n").collect()  # one row for each cell
    first, seen = [], 0
    for r in near:
        first.append(r[0])
        seen += r["n"]
        if seen >= k:
            break
    rows = spark.read.parquet(f"{path}/data").withColumn("dist", distance.seuclid(F.col(st), query, points=True))
    bound = rows.where(F.col(cell).isin(first)).orderBy("dist", key).limit(k).agg(F.max("dist")).first()[0]
    if seen < k or bound is None:
        return rows.orderBy("dist", key).limit(k)
    return rows.where(F.col(cell).isin([r[0] for r in near if r["d"] <= bound])).where(F.col("dist") <= bound).orderBy("dist", key).limit(k)


def broadcast_join(left: DataFrame, path: str, name: str = "intersects", cell: str = "cell", st: str = "st", kinds: str | tuple[str, str] = "simple") -> DataFrame:
    """Join of a table with a stored one, of which only the cells that meet the table's extent are read. It goes to every
    task if its rows, counted, are few."""
    c = F.col(st)
    e = left.agg(F.min(c["xmin"]).alias("a"), F.min(c["ymin"]).alias("b"), F.max(c["xmax"]).alias("c"), F.max(c["ymax"]).alias("d")).first()
    spark = left.sparkSession
    rows = spark.read.parquet(f"{path}/data")
    if e["a"] is not None:
        meet = (F.col("xmin") <= e["c"]) & (F.col("xmax") >= e["a"]) & (F.col("ymin") <= e["d"]) & (F.col("ymax") >= e["b"])
        rows = rows.where(F.col(cell).isin([r[0] for r in info(spark, path).where(meet).select(cell).collect()]))  # one number for each cell
    return _broadcast_join(left, rows.drop(cell), name, st, st, kinds)


def join(spark: SparkSession, left: str, right: str, name: str = "intersects", query: Column | None = None, cell: str = "cell", st: str = "st", kinds: str | tuple[str, str] = "simple") -> DataFrame:
    """Join of two stored tables: only cells whose extents meet one of the other side's are read."""
    a, b = info(spark, left), info(spark, right)
    r = b.select(*[F.col(c).alias(f"r_{c}") for c in b.columns])
    meet = (F.col("xmin") <= F.col("r_xmax")) & (F.col("xmax") >= F.col("r_xmin")) & (F.col("ymin") <= F.col("r_ymax")) & (F.col("ymax") >= F.col("r_ymin"))
    pairs = a.join(r, meet).select(cell, f"r_{cell}").collect()  # numbers of cells
    one = spark.read.parquet(f"{left}/data").where(F.col(cell).isin(sorted({p[0] for p in pairs})))
    two = spark.read.parquet(f"{right}/data").where(F.col(cell).isin(sorted({p[1] for p in pairs})))
    if query is not None:
        one, two = (st_filter(d, query, "intersects", st, kinds) for d in (one, two))
    return st_join(one.drop(cell), two.drop(cell), name, left_st=st, right_st=st, kinds=kinds)


def read_text_info(spark: SparkSession, path: str) -> DataFrame:
    """Extents kept as lines `wkt;start;end;file`."""
    from terracell.functions.wkt import st_geomfromwkt

    rows = spark.read.option("sep", ";").schema("wkt string, t_start long, t_end long, file string").csv(path)
    return rows.withColumn("st", st_geomfromwkt("wkt"))


