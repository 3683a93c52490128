"""Best-fit packing of token sequences by a configuration linear program.

A configuration is a multiset of lengths that fit a sequence; the program covers the lengths' histogram (at most `capacity`
sizes, whatever the corpus) by fractional uses of configurations, as few as it can. It is solved by multiplicative weights:
a length's weight shrinks with the share of its demand that is covered, a knapsack dynamic program prices all configurations
at these weights, and those within a small part of the best price are used a little further. The weights of every round are
a solution of the dual program, so they bound the number of sequences from below. Uses are rounded down. What that leaves,
and what no configuration near the best price covers, goes best-fit into gaps and then new sequences. Pieces get their
places by rank within their length, so nothing but the histogram reaches the driver.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from terracell.llm.common import by_weight, table
from terracell.llm.tokens import default_path, encoder
from terracell.scratch import stored

CAPACITY, END_ID, TOKENIZER = 2048, 0, "byte_bpe_50k.json"
#: Pieces ranked together in one task at most, on average.
RANKED_ROWS = 20_000


#: Rounds of the program at most, the share of a length's demand that a round covers at most, how fast weights shrink, how
#: far below the best price a configuration may be (at first, and at most where rounds cover little), and the share of all
#: tokens that may be left to best fit.
ROUNDS, STEP, RATE, SLACK, MOST_SLACK, REST = 120, 0.25, 0.05, 0.05, 0.2, 0.0005


def knapsack(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The greatest worth within each capacity, and the index of a size taken last there (-1: one token is left free).

    `sizes` ascend and may be taken again and again.
    """
    best, take = np.zeros(capacity + 1), np.full(capacity + 1, -1, np.int64)
    upto = np.searchsorted(sizes, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if n := upto[c]:
            v = best[c - sizes[:n]] + worth[:n]
            j = int(v.argmax())
            if v[j] > best[c]:
                best[c], take[c] = v[j], j
    return best, take


def _taken(sizes: np.ndarray, take: np.ndarray, capacity: int) -> dict[int, int]:
    """Index of size -> how often, of the best configuration within a capacity."""
    out: dict[int, int] = {}
    while capacity > 0:
        if (j := int(take[capacity])) < 0:
            capacity -= 1
        else:
            out[j] = out.get(j, 0) + 1
            capacity -= int(sizes[j])
    return out


def program(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[dict[tuple, float], float]:
    """Fractional uses of configurations ((index of size, how often), ...), and a lower bound on the uses of any cover.

    No length is covered beyond its demand, so that rounding down is all that is left to do. Starting from weights in
    proportion to sizes, the first bound is that of the tokens over the capacity.
    """
    left, used, bound = demand.astype(float), {}, 0.0
    weight, total, slack = np.ones(len(sizes)), float((sizes * demand).sum()), SLACK
    for _ in range(ROUNDS):
        if (sizes * left).sum() <= REST * total:
            break
        worth = sizes * weight
        best, take = knapsack(sizes, worth, capacity)
        bound = max(bound, float((demand * worth).sum() / best[capacity]))
        # lengths without demand are priced for the bound alone; configurations are made of the others
        open_ = np.flatnonzero(left > 1e-9)
        if len(open_) < len(sizes):
            best, take = knapsack(sizes[open_], worth[open_], capacity)
        some, room = sizes[open_], np.minimum(left[open_], STEP * demand[open_])
        before = room.copy()
        for i in np.argsort(-some, kind="stable").tolist():
            rest = capacity - int(some[i])
            if worth[open_[i]] + best[rest] < (1 - slack) * best[capacity]:
                continue
            held = _taken(some, take, rest)
            held[i] = held.get(i, 0) + 1
            uses = min(room[j] / n for j, n in held.items())
            if uses <= 1e-9:
                continue
            for j, n in held.items():
                room[j] -= uses * n
            key = tuple(sorted((int(open_[j]), n) for j, n in held.items()))
            used[key] = used.get(key, 0.0) + uses
        covered = before - room
        if not covered.any() and slack >= MOST_SLACK:
            break
        if (some * covered).sum() < 0.05 * (sizes * left).sum():
            slack = min(MOST_SLACK, slack * 1.5)
        left[open_] -= covered
        weight[open_] *= np.exp(-RATE * covered / demand[open_])
    return used, bound


def best_fit(sizes: np.ndarray, left: np.ndarray, capacity: int, groups: list[list]) -> None:
    """Puts what is left, longest first, into the fullest sequences with room; groups: [{size: count}, free, sequences]."""
    for i in np.argsort(-sizes, kind="stable"):
        size, n = int(sizes[i]), int(left[i])
        while n:
            room = [g for g in groups if g[1] >= size]
            if room:
                g = min(room, key=lambda g: g[1])
                each = min(g[1] // size, n)
                k = min(g[2], n // each)
            else:
                each = min(capacity // size, n)
                g, k = [{}, capacity, n // each], n // each
                groups.append(g)
            if k < g[2]:
                groups.append([dict(g[0]), g[1], g[2] - k])
                g[2] = k
            g[0][size] = g[0].get(size, 0) + each
            g[1] -= each * size
            n -= each * k


def _filled(sizes: np.ndarray, demand: np.ndarray, capacity: int, used: dict[tuple, float]) -> list[list]:
    """Whole sequences of the uses rounded down, and best fit for what they leave."""
    left, groups = demand.copy(), []
    for held, uses in sorted(used.items()):
        if n := math.floor(uses + 1e-9):
            n = min(n, *(int(left[i]) // k for i, k in held)) if held else 0
            for i, k in held:
                left[i] -= n * k
            if n:
                made = {int(sizes[i]): k for i, k in held}
                groups.append([made, capacity - sum(s * k for s, k in made.items()), n])
    best_fit(sizes, left, capacity, groups)
    return groups


def solve(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(configuration as size -> count, number of sequences) for all pieces of the histogram.

    Where so few pieces are of a length that rounding leaves most of them to best fit, best fit of them all may need fewer
    sequences; the program's plan is taken unless it needs more.
    """
    if not histogram:
        return []
    sizes = np.array(sorted(histogram), np.int64)
    demand = np.array([histogram[int(s)] for s in sizes], np.int64)
    used, _ = program(sizes, demand, capacity)
    plans = [_filled(sizes, demand, capacity, u) for u in (used, {})]
    groups = min(plans, key=lambda g: sum(x[2] for x in g))
    return [(g[0], g[2]) for g in groups]


def slots(plan: list[tuple[dict[int, int], int]], first: int = 0) -> pd.DataFrame:
    """For each size: from which rank on (`start`) its pieces lie in which sequences, how many in each, and where there."""
    rows, seq, seen = [], first, {}
    for held, times in plan:
        offset = 0
        for size in sorted(held, reverse=True):
            start = seen.get(size, 0)
            rows.append((size, start, seq, held[size], offset))
            seen[size] = start + held[size] * times
            offset += size * held[size]
        seq += times
    return pd.DataFrame(rows, columns=["length", "start", "seq", "each", "at"]).sort_values(["length", "start"])


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every text; a null text is empty, so it has the end id alone."""

    def cut(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for first, last, ids, bounds in encoder(path).encode_runs(b.column(1)):
            ids = np.insert(ids, bounds[1:], end_id)
            bounds = bounds + np.arange(len(bounds))
            n = np.diff(bounds)
            count = -(-n // capacity)
            doc = np.repeat(np.arange(len(n)), count)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            # the first piece may be shorter, so that all others are full
            hi = n[doc] - (count[doc] - 1 - piece) * capacity
            lo = np.maximum(hi - capacity, 0)
            view, at = memoryview(ids.astype("<u4").tobytes()), bounds[doc]
            parts = [view[4 * x : 4 * y] for x, y in zip((at + lo).tolist(), (at + hi).tolist())]
            cols = [b.column(0).take(pa.array(doc + first)), pa.array(piece, pa.int32()), pa.array(lo), pa.array(hi - lo), pa.array([zlib.crc32(x) for x in parts], pa.int64())]
            if with_ids:
                cols.append(pa.array([bytes(x) for x in parts], pa.binary()))
            yield pa.RecordBatch.from_arrays(cols, names=[str(i) for i in range(len(cols))])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return by_weight(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), cut, schema, 1)


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to a table with the lengths (1 to `capacity`) of pieces.

    Ranks within a length are dealt over (length, bucket), and the buckets' counts are added up, so that a length that a
    third of all pieces has is not ranked in one task. Rows that are equal get places of their own. An empty table stays
    empty. Null lengths are not allowed.
    """
    spark = cut.sparkSession
    cut = stored(cut, "pieces")
    total = cut.count()
    buckets = max(8, total // RANKED_ROWS)
    dealt = cut.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    counts = dealt.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = W.partitionBy("length").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    counts = stored(counts, "counts")
    # at most `capacity` rows
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    where = slots(solve(histogram, capacity))
    lengths, starts, seqs, each, at = (where[c].to_numpy(np.int64) for c in ("length", "start", "seq", "each", "at"))
    most = max(histogram.values(), default=0) + 1
    if capacity * most >= 1 << 62:
        raise ValueError("too many pieces of one length")
    # a row for each length of each configuration, of which there are some thousands, whatever the number of pieces
    held = spark.sparkContext.broadcast((lengths * most + starts, starts, seqs, each, at))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, starts, seqs, each, at = held.value
        for b in batches:
            size, rank = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            i = np.searchsorted(keys, size * most + rank, "right") - 1
            r = rank - starts[i]
            out = [b.column(j) for j, n in enumerate(b.schema.names) if n != "_rank"]
            names = [n for n in b.schema.names if n != "_rank"]
            yield pa.RecordBatch.from_arrays([*out, pa.array(seqs[i] + r // each[i]), pa.array(at[i] + r % each[i] * size)], names=[*names, "sequence_id", "offset"])

    inner = W.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = dealt.withColumn("_row", F.row_number().over(inner)).join(counts.select("length", "_bucket", "_base"), ["length", "_bucket"])
    ranked = ranked.select(*cut.columns, (F.col("_base") + F.col("_row") - 1).cast("long").alias("_rank"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields)
    return ranked.mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed; see the module's text. Columns as in `pieces`, and sequence_id and offset."""
    return pack(pieces(table(spark, sf_dir, "documents"), default_path(TOKENIZER)))
