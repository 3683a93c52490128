"""Connected components of a table of links; nothing reaches the driver."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terracell.scratch import remove, stored

#: Links that one task may join up in memory (about 50 MB); more of them go through joins, round by round.
TASK_LINKS = 300_000


def _in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict[int, int] = {}

        def top(x: int) -> int:
            while above.setdefault(x, x) != x:
                above[x] = x = above[above[x]]
            return x

        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x, y = top(x), top(y)
                if x != y:
                    above[max(x, y)] = min(x, y)
        nodes = list(above)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([top(x) for x in nodes], pa.int64())], names=["node", "comp"])

    return edges.select("a", "b").coalesce(1).mapInArrow(run, "node long, comp long")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of the links (a, b); comp is the least node reachable.

    Each round takes the least label among a node's neighbours and then the label of its label; both are joins and sums
    with partial aggregation, so a node with very many links is not gathered. A round's labels are a table of their own.
    Up to TASK_LINKS links are joined up in a single task, which gives the same rows.
    """
    if edges.count() <= TASK_LINKS:
        return stored(_in_one_task(edges), "labels")
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")).distinct()
    both = stored(both, "links")
    labels = stored(both.groupBy(F.col("u").alias("node")).agg(F.least(F.first("u"), F.min("v")).alias("comp")), "labels")
    while True:
        near = both.join(labels, both.v == labels.node).groupBy("u").agg(F.min("comp").alias("least"))
        hooked = labels.join(near, labels.node == near.u).select("node", F.col("comp").alias("was"), F.least("comp", "least").alias("comp"))
        hooked = stored(hooked, "hooked")
        up = hooked.select(F.col("node").alias("comp"), F.col("comp").alias("above"))
        now = stored(hooked.join(up, "comp").select("node", "was", F.least("comp", "above").alias("comp")), "labels")
        changed = not now.where("comp <> was").isEmpty()
        remove(edges.sparkSession, hooked.terracell_path)
        remove(edges.sparkSession, labels.terracell_path)
        labels, path = now.select("node", "comp"), now.terracell_path
        labels.terracell_path = path
        if not changed:
            remove(edges.sparkSession, both.terracell_path)
            return labels
