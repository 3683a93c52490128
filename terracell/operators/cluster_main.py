"""Clusters points of a CSV file: python -m terracell.operators.cluster_main --input IN --output OUT --eps 0.5 --minPts 5"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from terracell.operators.dbscan import dbscan, write_clusters


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    """Lines of OUT hold the coordinates and the cluster's number. ppd and maxPartitionSize are taken and change nothing:
    cells follow eps and the shuffle's partitions."""
    p = argparse.ArgumentParser()
    for name, kind in (("input", str), ("output", str), ("eps", float), ("minPts", int)):
        p.add_argument(f"--{name}", type=kind, required=True)
    p.add_argument("--ndims", type=int, default=2)
    for name in ("ppd", "maxPartitionSize"):
        p.add_argument(f"--{name}", type=int)
    a = p.parse_args(args)
    spark = spark or SparkSession.builder.getOrCreate()
    dims = [f"x{i}" for i in range(a.ndims)]
    parts = F.split("value", ",")
    rows = spark.read.text(a.input).where(F.length(F.trim("value")) > 0).select(F.monotonically_increasing_id().alias("id"), *[F.trim(parts[i]).cast("double").alias(d) for i, d in enumerate(dims)])
    write_clusters(dbscan(rows, a.eps, a.minPts, dims), a.output, dims)


if __name__ == "__main__":
    main()
