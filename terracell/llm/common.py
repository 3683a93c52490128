"""What the corpus operators share: Arrow batches and word rules."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Code points that separate words in the space rule: space and tab to carriage return.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
#: Words of the letter rule, on text whose A-Z are lower-cased.
LETTER_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = str.maketrans(UPPER, LOWER)
#: Rows in an Arrow batch; texts are long, and Python holds a batch's words at once.
BATCH_ROWS = 256
#: Ids or pairs that may be broadcast; beyond it tables are joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: Bytes of text that are tokenized at once.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free(name: str, df: DataFrame) -> str:
    """The name, or with as many underscores before it as make it no column's (capitals aside)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A stored table of narrow rows with the hint to broadcast it if these, counted, are `most` or fewer."""
    return F.broadcast(df) if df.count() <= most else df


def by_batch(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, rows: int = BATCH_ROWS) -> DataFrame:
    """mapInArrow with a function of one batch, which gets `rows` rows at most; the session's batch size is left alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, rows):
                yield f(b.slice(at, rows))

    return df.mapInArrow(run, schema)


def by_weight(df: DataFrame, f: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str, column: int, most: int = BATCH_BYTES) -> DataFrame:
    """mapInArrow with a function that makes batches of one, whose texts in a column have about `most` bytes, or which is one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            step = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy().astype(np.int64) + 16) // most
            edges = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(edges, edges[1:]):
                if hi > lo:
                    yield from f(b.slice(lo, hi - lo))

    return df.mapInArrow(run, schema)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, UPPER, LOWER)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once."""
    return F.transform(F.array(value), f)[0]
