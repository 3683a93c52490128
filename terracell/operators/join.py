"""Exact joins of spatio-temporal values by cells.

Both sides' envelopes are dealt to the cells of a grid that they meet, cells are joined by equality, and envelopes and
values are compared. A pair that shares several cells is kept only in the one that holds the lower left corner of the
envelopes' overlap, so no pair is lost, doubled or sorted out afterwards. The cells' side follows the values' sizes, and
values that would meet very many cells are dealt to coarser grids, each side to the grids of the other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terracell.functions import distance, predicates, temporal
from terracell.scratch import stored

#: Each coarser grid's cells are this many times longer; a value goes to the finest where it spans at most SPAN cells an axis.
COARSER, SPAN, LEVELS = 8, 3, 8
#: Rows that may be broadcast when the caller asks for it.
BROADCAST_ROWS = 1_000_000


def cell_side(left: DataFrame, right: DataFrame, st: str = "st", grow: float = 0.0, rows_per_cell: int = 32) -> float:
    """Side from the sides of the values and from how many there are in the common extent."""
    c = F.col(st)
    one = lambda d: d.agg(F.avg(F.greatest(c["xmax"] - c["xmin"], c["ymax"] - c["ymin"])).alias("s"), F.count("*").alias("n"), F.min(c["xmin"]).alias("a"), F.min(c["ymin"]).alias("b"), F.max(c["xmax"]).alias("c"), F.max(c["ymax"]).alias("d")).first()
    p, q = one(left), one(right)
    if not p["n"] or not q["n"]:
        return 1.0
    area = max(p["c"], q["c"]) - min(p["a"], q["a"]), max(p["d"], q["d"]) - min(p["b"], q["b"])
    even = (max(area[0], 1e-9) * max(area[1], 1e-9) * rows_per_cell / (p["n"] + q["n"])) ** 0.5
    return max(p["s"] or 0.0, q["s"] or 0.0, 2 * grow, even, 1e-9)


def _level(st: Column, side: float) -> Column:
    """Number of the grid: 0 the finest."""
    long = F.greatest(st["xmax"] - st["xmin"], st["ymax"] - st["ymin"]) / side
    return F.greatest(F.lit(0), F.least(F.lit(LEVELS - 1), F.ceil(F.log(float(COARSER), F.greatest(long / SPAN, F.lit(1.0))))))


def _dealt(df: DataFrame, st: str, side: float, grow: float, levels: Column, tag: str) -> DataFrame:
    """A row for each grid and cell that a value's envelope, grown by `grow`, meets."""
    c = F.col(st)
    at = lambda v, s: F.floor(v / s).cast("long")
    rows = df.withColumn(f"_g{tag}", F.explode(levels)).withColumn(f"_s{tag}", F.pow(F.lit(float(COARSER)), F.col(f"_g{tag}")) * side)
    s = F.col(f"_s{tag}")
    xs = F.sequence(at(c["xmin"] - grow, s), at(c["xmax"] + grow, s))
    ys = F.sequence(at(c["ymin"] - grow, s), at(c["ymax"] + grow, s))
    return rows.withColumn(f"_cx{tag}", F.explode(xs)).withColumn(f"_cy{tag}", F.explode(ys))


def cell_join(left: DataFrame, right: DataFrame, condition: Callable[[Column, Column], Column], how: str = "inner", left_st: str = "st", right_st: str = "st", side: float | None = None, grow: float = 0.0) -> DataFrame:
    """Pairs whose envelopes (the left's grown by `grow`) meet and for which `condition` holds.

    Columns of the right side are prefixed with r_ where the left has them. how: inner, left, left_semi or left_anti. A
    null value has no partner. Rows may repeat; each pair of rows is one row of the result.
    """
    if side is None:
        side = cell_side(left.select(F.col(left_st).alias("st")), right.select(F.col(right_st).alias("st")), "st", grow)
    taken = set(left.columns)
    new = {c: f"r_{c}" if c in taken else c for c in right.columns}
    names = list(new.values())
    r, rst = right.withColumnsRenamed(new), new[right_st]
    if how != "inner":
        left = stored(left.withColumn("_row", F.monotonically_increasing_id()), "left")  # ids of rows must not change between two uses
    # a right value lies in its own grid; a left one is dealt to every grid that the right side has
    used = [int(x["g"]) for x in right.select(_level(F.col(right_st), side).alias("g")).where("g IS NOT NULL").distinct().collect()]  # at most LEVELS
    a = _dealt(left, left_st, side, grow, F.array(*[F.lit(float(g)) for g in sorted(used)]) if used else F.array().cast("array<double>"), "l")
    b = _dealt(r, rst, side, 0.0, F.array(_level(F.col(rst), side).cast("double")), "r")
    p, q = F.col(left_st), F.col(rst)
    corner = lambda lo, hi: F.floor(F.greatest(p[lo] - grow, q[lo]) / F.col("_sl")).cast("long")
    meet = (p["xmin"] - grow <= q["xmax"]) & (p["xmax"] + grow >= q["xmin"]) & (p["ymin"] - grow <= q["ymax"]) & (p["ymax"] + grow >= q["ymin"])
    here = (F.col("_cxl") == corner("xmin", "xmax")) & (F.col("_cyl") == corner("ymin", "ymax"))
    keys = (F.col("_gl") == F.col("_gr")) & (F.col("_cxl") == F.col("_cxr")) & (F.col("_cyl") == F.col("_cyr"))
    pairs = a.join(b, keys & meet & here).where(condition(p, q))
    if how == "inner":
        return pairs.select(*left.columns, *names)
    if how == "left":
        found = pairs.select("_row", *names)
        return left.join(found, "_row", "left").select(*[c for c in left.columns if c != "_row"], *names)
    if how in ("left_semi", "left_anti"):
        return left.join(pairs.select("_row").distinct(), "_row", how).drop("_row")
    raise ValueError(f"how is {how!r}")


def st_join(left: DataFrame, right: DataFrame, name: str = "intersects", how: str = "inner", left_st: str = "st", right_st: str = "st", kinds: str | tuple[str, str] = "simple", side: float | None = None) -> DataFrame:
    """Join by a predicate, the left value first. See `cell_join`."""
    return cell_join(left, right, lambda a, b: predicates.predicate(name, a, b, kinds), how, left_st, right_st, side)


def distance_join(left: DataFrame, right: DataFrame, most: float, how: str = "inner", left_st: str = "st", right_st: str = "st", metric: Callable[[Column, Column], Column] = distance.seuclid, side: float | None = None) -> DataFrame:
    """Pairs at `most` or less by a metric that is no less than the envelopes' distance."""
    return cell_join(left, right, lambda a, b: metric(a, b) <= F.lit(float(most)), how, left_st, right_st, side, float(most))


def broadcast_join(left: DataFrame, right: DataFrame, name: str = "intersects", left_st: str = "st", right_st: str = "st", kinds: str | tuple[str, str] = "simple", side: float | None = None) -> DataFrame:
    """As `st_join`, with the right side sent to every task if it has BROADCAST_ROWS rows at most; else joined by shuffle."""
    small = right.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return st_join(left, F.broadcast(right) if small else right, name, "inner", left_st, right_st, kinds, side)


def zip_join(left: DataFrame, right: DataFrame, name: str, columns: list[str], **more) -> DataFrame:
    """Set semantics: each combination of `columns` once."""
    return st_join(left, right, name, **more).select(*columns).distinct()


def theta_join(left: DataFrame, right: DataFrame, condition: Column, how: str = "inner") -> DataFrame:
    """Any condition, which compares all pairs of rows unless it holds an equality."""
    return left.join(right, condition, how)


def interval_join(left: DataFrame, right: DataFrame, name: str = "intersects", left_st: str = "st", right_st: str = "st", width: int | None = None) -> DataFrame:
    """Pairs by the times' predicate alone, dealt to buckets of time; a pair counts in the bucket where its overlap starts.

    Open intervals reach up to the last bucket that either side starts or ends in.
    """
    c = lambda s: F.col(s)
    one = lambda d, s: d.agg(F.min(c(s)["t_start"]).alias("a"), F.max(F.coalesce(c(s)["t_end"], c(s)["t_start"])).alias("b"), F.avg(c(s)["t_end"] - c(s)["t_start"]).alias("w"), F.count("*").alias("n")).first()
    p, q = one(left, left_st), one(right, right_st)
    if p["a"] is None or q["a"] is None:
        lo, hi, width = 0, 0, 1
    else:
        lo, hi = min(p["a"], q["a"]), max(p["b"], q["b"])
        width = width or max(1, int(max(p["w"] or 0, q["w"] or 0)), (hi - lo) // 20_000)
    new = {k: f"r_{k}" if k in set(left.columns) else k for k in right.columns}
    bucket = lambda v: F.floor((v - lo) / width).cast("long")

    def dealt(d: DataFrame, s: str, tag: str) -> DataFrame:
        v = F.col(s)
        return d.where(temporal.has_time(v)).withColumn(f"_b{tag}", F.explode(F.sequence(bucket(v["t_start"]), bucket(F.coalesce(v["t_end"], F.greatest(v["t_start"], F.lit(hi)))))))

    a, b = dealt(left, left_st, "l"), dealt(right.withColumnsRenamed(new), new[right_st], "r")
    x, y = F.col(left_st), F.col(new[right_st])
    here = F.col("_bl") == bucket(F.greatest(x["t_start"], y["t_start"]))
    test = predicates.TIMES[name](x, y)
    return a.join(b, (F.col("_bl") == F.col("_br")) & here & test).select(*left.columns, *new.values())


def interval_pairs(df: DataFrame, key: str = "id", st: str = "st", width: int | None = None) -> DataFrame:
    """Each two rows of different keys whose times meet, once: the lesser key, and the greater as r_ + key.

    The later start of two that meet lies in the other's time. So a row looks, in the bucket of its start alone, for those
    that reach into that bucket and started no later; equal starts go by key. A row lies in many buckets only where it has
    partners in them: the work grows with the pairs.
    """
    v, k = F.col(st), F.col(key)
    rows = df.where(temporal.has_time(v) & k.isNotNull()).select(k.alias("_k"), v["t_start"].alias("_s"), v["t_end"].alias("_e"))
    p = rows.agg(F.min("_s").alias("a"), F.max("_s").alias("b"), F.avg(F.col("_e") - F.col("_s")).alias("w")).first()
    lo, hi = (0, 0) if p["a"] is None else (p["a"], p["b"])
    width = width or max(1, int(p["w"] or 0) // 4, (hi - lo) // 20_000)
    bucket = lambda c: F.floor((c - F.lit(lo)) / F.lit(width)).cast("long")
    forever = F.lit((1 << 63) - 1)
    a = rows.select(bucket(F.col("_s")).alias("_b"), "_k", "_s", F.coalesce("_e", forever).alias("_e"))
    last = F.greatest(F.col("_s"), F.least(F.coalesce("_e", forever), F.lit(hi)))  # no start lies beyond the last one
    b = rows.select(F.explode(F.sequence(bucket(F.col("_s")), bucket(last))).alias("_c"), F.col("_k").alias("_q"), F.col("_s").alias("_t"), F.coalesce("_e", forever).alias("_f"))
    earlier = (F.col("_t") < F.col("_s")) | ((F.col("_t") == F.col("_s")) & (F.col("_q") < F.col("_k")))
    meet = (F.col("_s") <= F.col("_f")) & (F.col("_t") <= F.col("_e"))
    pairs = a.hint("merge").join(b, (F.col("_b") == F.col("_c")) & earlier & meet & (F.col("_k") != F.col("_q")))
    return pairs.select(F.least("_k", "_q").alias(key), F.greatest("_k", "_q").alias(f"r_{key}"))
