"""Streams give what the batch operators give."""

import datetime

from pyspark.sql import functions as F

from terracell.functions.types import st_box, st_point
from terracell.operators.cells import Extent, Grid
from terracell.streaming import cell_counts, filter_stream


def test_stream(spark, tmp_path):
    t0 = datetime.datetime(2024, 1, 1)
    rows = [(i, float(i % 20), float(i % 7), t0 + datetime.timedelta(minutes=i)) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, x double, y double, ts timestamp")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withColumn("st", st_point("x", "y"))

    def all_rows(made, name, mode):
        q = made.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return sorted(map(tuple, spark.table(name).collect()))

    assert all_rows(filter_stream(stream, st_box(3, 2, 9, 5)).select("id"), "kept", "append") == [(i,) for i, x, y, _ in rows if 3 <= x <= 9 and 2 <= y <= 5]
    grid = Grid(Extent(0, 0, 20, 8), 4, 2)
    counted = cell_counts(stream, grid, "ts", "1 hour", "1 day").select(F.col("window.start").cast("string"), "cell", "n")
    want = {}
    for _, x, y, t in rows:
        k = (str(t.replace(minute=0)), int(y // 4) * 4 + int(x // 5))
        want[k] = want.get(k, 0) + 1
    assert all_rows(counted, "counted", "complete") == sorted((*k, n) for k, n in want.items())
