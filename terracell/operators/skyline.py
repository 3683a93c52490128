"""Skylines: rows that no other row beats in spatial and temporal distance to a reference.

A row beats another if it is nearer in one and no farther in the other; equal rows stay together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terracell.functions import distance
from terracell.scratch import stored


#: Places that are compared with each other at once, and those whose skyline is held against all.
FEW, PROBES = 20_000, 1_000


def dominates(a: Column, b: Column) -> Column:
    """Of structs with sd and td."""
    return ((a["td"] < b["td"]) & (a["sd"] <= b["sd"])) | ((a["sd"] < b["sd"]) & (a["td"] <= b["td"]))


def distances(df: DataFrame, query: Column, st: str = "st", metric: Callable[[Column, Column], Column] = distance.euclid) -> DataFrame:
    d = metric(F.col(st), query)
    return df.withColumns({"sd": d["s"], "td": d["t"]}).where(F.col("sd").isNotNull() & F.col("td").isNotNull())


def _front(places: DataFrame, parts: int) -> DataFrame:
    """Of (sd, td) the places that none beats. Slices of sd hold about equal numbers; the least td of the slices before one
    (a number for each slice) beats most of its places in a filter, and the rest is passed over in order, slice by slice."""
    cuts = sorted(set(places.approxQuantile("sd", [i / parts for i in range(1, parts)], 0.001)))
    slice_ = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col("sd"))) if cuts else F.lit(0)
    rows = places.withColumn("_slice", slice_)
    least = {r["_slice"]: r["td"] for r in rows.groupBy("_slice").agg(F.min("td").alias("td")).collect()}  # `parts` rows at most
    before, so_far = [], float("inf")
    for i in range(len(cuts) + 1):
        before.append(so_far)
        so_far = min(so_far, least.get(i, so_far))
    rows = rows.where(F.col("td") < F.array(*[F.lit(v) for v in before])[F.col("_slice")])
    seen = W.partitionBy("_slice").orderBy("sd").rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("_least", F.min("td").over(seen)).where(F.col("_least").isNull() | (F.col("td") < F.col("_least"))).select("sd", "td")


def skyline(df: DataFrame, query: Column, st: str = "st", metric: Callable[[Column, Column], Column] = distance.euclid, parts: int | None = None, angular: bool = False) -> DataFrame:
    """Rows of the skyline with sd and td. With `angular`, slices of the angle of (sd, td) keep their own skylines first.

    parts: slices, as many as there are shuffle partitions or 64 if left out. No step has all places in one task.
    """
    parts = parts or max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = distances(df, query, st, metric)
    places = rows.groupBy("sd").agg(F.min("td").alias("td"))
    if angular:
        seen = W.partitionBy("_angle").orderBy("sd").rowsBetween(W.unboundedPreceding, -1)
        places = places.withColumn("_angle", F.floor(F.atan2("td", "sd") / (F.lit(3.141592653589793) / 2 / parts))).withColumn("_least", F.min("td").over(seen))
        places = places.where(F.col("_least").isNull() | (F.col("td") < F.col("_least"))).select("sd", "td")
    best = _front(stored(places, "places"), parts)
    return rows.join(best, ["sd", "td"], "left_semi").select(*df.columns, "sd", "td")


def skyline_by(df: DataFrame, query: Column, beats: Callable[[Column, Column], Column] = dominates, st: str = "st", metric: Callable[[Column, Column], Column] = distance.euclid, parts: int = 16) -> DataFrame:
    """Rows that no other row beats by a rule of one's own over structs of sd and td, which must be transitive and strict.

    A few places' own skyline is held against all places first, which takes out most of what is beaten, as long as that helps;
    by transitivity a place beaten by another is beaten by one of the skyline, which always stays. What is left is dealt to
    parts and compared inside of them; what a part keeps then meets what all parts keep, once for each pair of parts.
    """
    rows = distances(df, query, st, metric)

    def left(these: DataFrame, others: DataFrame) -> DataFrame:
        a = these.select("_part", F.struct("sd", "td").alias("a"))
        b = others.select("_part", F.struct("sd", "td").alias("b"))
        return a.join(b, (a["_part"] == b["_part"]) & beats(F.col("b"), F.col("a")), "left_anti").select("_part", "a.*")

    places = stored(rows.select("sd", "td").distinct().withColumn("_part", F.lit(0)), "places")
    n = places.count()
    while n > FEW:
        some = stored(places.orderBy(F.xxhash64("sd", "td", F.lit(n))).limit(PROBES), "probes")
        probes = F.broadcast(left(some, some).select(F.struct("sd", "td").alias("b")))
        rest = stored(places.join(probes, beats(F.col("b"), F.struct("sd", "td")), "left_anti"), "places")
        was, places, n = n, rest, rest.count()
        if n > was / 2:
            break
    places = places.withColumn("_part", F.pmod(F.xxhash64("sd", "td"), F.lit(parts)).cast("int"))
    local = stored(left(places, places), "skyline")
    every = local.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    best = left(local, every)
    return rows.join(best.select("sd", "td"), ["sd", "td"], "left_semi").select(*df.columns, "sd", "td")
