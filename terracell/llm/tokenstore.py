"""A content-addressed store of token ids.

Each text's ids (and an end id) are cut where a rolling hash of the last ids has a run of zero bits, so equal passages
give equal chunks wherever they stand. The store is three Parquet tables in the shared folder:

* chunks: digest, ids (packed little-endian, 2 or 4 bytes each); one row for each different chunk;
* recipes: row, doc_id, n_tokens, shard, digests of its chunks in order, leaf hash; ranges of doc_id in ascending order;
* manifest: for each shard its documents, ids and Merkle root over the recipes' leaves, in order of the shards.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terracell.llm.common import by_batch, by_weight, table
from terracell.llm.tokens import default_path, encoder
from terracell.scratch import remove, scratch, stored

END_ID, TOKENIZER = 2, "word_bpe_49k.json"
#: Ids in a chunk: the least, the mask of the rolling hash (one cut in 1,024 ids on average), the most; ids that the hash sees.
LEAST, MASK, MOST, SEEN = 256, 1023, 4096, 16
_GEAR = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 63, 1 << 12, dtype=np.uint64)


def cuts(ids: np.ndarray, bounds: np.ndarray | None = None) -> np.ndarray:
    """Ends of the chunks of id streams that lie one after the other; `bounds` has their ends, and 0 at first.

    A cut depends on the `SEEN` ids before it only, but for the least and most. Those of an earlier stream never count, as
    `LEAST` is more than `SEEN`.
    """
    bounds = np.array([0, len(ids)]) if bounds is None else bounds
    g = _GEAR[ids & 0xFFF] * (ids.astype(np.uint64) * np.uint64(2) + np.uint64(1))
    h = g.copy()
    for j in range(1, min(SEEN, len(g))):
        h[j:] += g[:-j] << np.uint64(j)
    marks = np.flatnonzero((h >> np.uint64(20)) & np.uint64(MASK) == 0) + 1
    first = np.searchsorted(marks, bounds, "right").tolist()
    marks, bounds, out = marks.tolist(), bounds.tolist(), []
    for k, (at, end) in enumerate(zip(bounds, bounds[1:])):
        for m in (*marks[first[k] : first[k + 1]], end):
            while m - at > MOST:
                out.append(at := at + MOST)
            if m - at >= LEAST or m == end and m > at:
                out.append(at := m)
    return np.array(out, np.int64)


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def leaf(doc_id: int | None, n: int, digests: list[bytes]) -> bytes:
    return hashlib.sha256(b"\0" + f"{doc_id}:{n}:".encode() + b"".join(digests)).digest()


def merkle(leaves: Iterator[bytes]) -> bytes:
    """Root over leaves in order, holding one node a level; an odd node moves up as it is. Of none: 32 zero bytes."""
    levels: list[bytes | None] = []
    for x in leaves:
        for k, y in enumerate(levels):
            if y is None:
                levels[k] = x
                break
            levels[k], x = None, hashlib.sha256(b"\1" + y + x).digest()
        else:
            levels.append(x)
    root = None
    for x in levels:
        if x is not None:
            root = x if root is None else hashlib.sha256(b"\1" + x + root).digest()
    return root or bytes(32)


# crc32 of joined parts, from the parts' own: multiplication modulo the crc's polynomial (reflected)
_POLY = 0xEDB88320


def _times(a: int, b: int) -> int:
    p = 0
    while a:
        if a & 0x80000000:
            p ^= b
        a = a << 1 & 0xFFFFFFFF
        b = b >> 1 ^ (_POLY if b & 1 else 0)
    return p


_SHIFT: dict[int, int] = {}


def _shift(n_bytes: int) -> int:
    if n_bytes not in _SHIFT:
        p, x, n = 1 << 31, 1 << 30, n_bytes * 8
        while n:
            if n & 1:
                p = _times(x, p)
            x, n = _times(x, x), n >> 1
        _SHIFT[n_bytes] = p
    return _SHIFT[n_bytes]


def joined_crc(parts: list[tuple[int, int]]) -> int:
    """crc32 of joined parts, each given by (its crc32, its bytes)."""
    crc = 0
    for c, n in parts:
        crc = _times(_shift(n), crc) ^ c if crc else c
    return crc


@dataclass
class Store:
    chunks: str
    recipes: str
    manifest: str
    width: int


def write(docs: DataFrame, tokenizer: str, end_id: int, base: str) -> Store:
    """Encodes (doc_id, text) and writes the three tables under `base`. A null text is empty; equal rows stay apart."""
    spark = docs.sparkSession
    import tokenizers

    width = 2 if tokenizers.Tokenizer.from_file(tokenizer).get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4

    def encode(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        docs = b.column(0).to_pylist()
        for first, last, ids, bounds in encoder(tokenizer).encode_runs(b.column(1)):
            ids = np.insert(ids, bounds[1:], end_id)
            bounds = bounds + np.arange(len(bounds))
            edges = np.concatenate(([0], cuts(ids, bounds)))
            packed = pa.py_buffer(ids.astype(f"<u{width}").tobytes())
            view = memoryview(packed)
            parts = pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((edges * width).astype("<i4")), packed])
            digests = [_digest(view[width * lo : width * hi]) for lo, hi in zip(edges.tolist(), edges[1:].tolist())]
            at, n = np.searchsorted(edges, bounds), np.diff(bounds)
            leaves = [leaf(d, k, digests[i:j]) for d, k, i, j in zip(docs[first:last], n.tolist(), at.tolist(), at[1:].tolist())]
            lists = pa.array(at.astype(np.int32))
            cols = [b.column(0).slice(first, last - first), pa.array(n), pa.ListArray.from_arrays(lists, pa.array(digests, pa.binary())), pa.ListArray.from_arrays(lists, parts), pa.array(leaves, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=list("abcde"))

    raw = by_weight(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), encode, "doc_id long, n_tokens long, digests array<binary>, parts array<binary>, leaf binary", 1)
    raw = stored(raw, "raw-ids")
    out = Store(f"{base}/chunks", f"{base}/recipes", f"{base}/manifest", width)
    each = raw.select(F.explode(F.arrays_zip("digests", "parts")).alias("c"))
    each = each.select(F.col("c.digests").alias("digest"), F.col("c.parts").alias("ids")).groupBy("digest").agg(F.first("ids").alias("ids"))
    each.write.option("compression", "zstd").parquet(out.chunks)

    rows = raw.select("doc_id", "n_tokens", "digests", "leaf")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), "leaf").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "leaf")
    rows.withColumns({"shard": F.spark_partition_id(), "row": F.monotonically_increasing_id()}).write.option("compression", "zstd").parquet(out.recipes)
    remove(spark, raw.terracell_path)
    roots(spark, out, anew=False).write.parquet(out.manifest)
    return out


def roots(spark: SparkSession, store: Store, anew: bool = True) -> DataFrame:
    """shard, documents, ids and Merkle root, from the recipes as they are; a shard is sorted again, in its own task.

    Leaves are hashed anew from the recipes' digests, or taken as they are written.
    """
    told = "digests" if anew else "leaf"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a task may hold several shards, one after the other
        rows = ((d, k, digests, s) for b in batches for d, k, digests, s in zip(*(c.to_pylist() for c in b.columns)))
        out = []
        for s, group in groupby(rows, key=lambda r: r[3]):
            n = ids = 0

            def hashes(group=group):
                nonlocal n, ids
                for d, k, digests, _ in group:
                    n, ids = n + 1, ids + k
                    yield leaf(d, k, digests) if anew else digests

            root = merkle(hashes())
            out.append((s, n, ids, root.hex()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int32(), pa.int64(), pa.int64(), pa.string()))], names=["a", "b", "c", "d"])

    rows = spark.read.parquet(store.recipes).repartition("shard").sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "leaf")
    return rows.select("doc_id", "n_tokens", told, "shard").mapInArrow(run, "shard int, documents long, ids long, root string")


def chunk_sums(spark: SparkSession, store: Store) -> DataFrame:
    """digest, crc32 of the chunk's ids as 32-bit integers and their number, from the chunks' bytes; a wrong digest raises."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        crc, n = [], []
        for d, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if _digest(p) != d:
                raise ValueError(f"chunk {d.hex()} is damaged")
            ids = np.frombuffer(p, f"<u{store.width}").astype("<u4")
            crc.append(zlib.crc32(ids.tobytes()))
            n.append(len(ids))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(crc, pa.int64()), pa.array(n, pa.int64())], names=["a", "b", "c"])

    return by_batch(spark.read.parquet(store.chunks).select("digest", "ids"), run, "digest binary, crc long, n long")


def read_sums(spark: SparkSession, store: Store) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, rebuilt from the recipes and the chunks' bytes.

    A document's crc is joined from its chunks' crcs, so each different chunk is read once and no ids are moved again.
    A recipe whose ids don't add up, or a shard whose Merkle root is not the manifest's, raises.
    """
    recipes = spark.read.parquet(store.recipes).select("doc_id", "leaf", "n_tokens", "shard", "digests", F.col("row").alias("_row"))
    said = spark.read.parquet(store.manifest)
    # one row for each shard, of which there are as many as shuffle partitions
    bases = said.select("shard", F.coalesce(F.sum("ids").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    order = W.partitionBy("shard").orderBy(F.col("doc_id").asc_nulls_first(), "leaf").rowsBetween(W.unboundedPreceding, -1)
    placed = recipes.select("_row", "doc_id", "n_tokens", "shard", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)).alias("_in"))
    placed = placed.join(F.broadcast(bases), "shard").select("_row", "doc_id", (F.col("_in") + F.col("_base")).alias("start"), "n_tokens")
    each = recipes.select("_row", F.posexplode("digests").alias("k", "digest")).join(chunk_sums(spark, store), "digest")
    each = each.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("k", "crc", "n"))).alias("parts"))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        crc = []
        for n, parts in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
            if n != sum(p["n"] for p in parts):
                raise ValueError("a document's chunks don't make up its ids")
            crc.append(joined_crc([(p["crc"], 4 * p["n"]) for p in parts]))
        return pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(crc, pa.int64())], names=["a", "b", "c", "d"])

    return by_batch(placed.join(each, "_row").select("doc_id", "start", "n_tokens", "parts"), run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def verify(spark: SparkSession, store: Store) -> int:
    """Shards whose Merkle root, documents or ids are not the manifest's."""
    return spark.read.parquet(store.manifest).join(roots(spark, store), ["shard", "documents", "ids", "root"], "left_anti").count()


def op5_content_addressed_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all documents to a store and reads them back."""
    store = write(table(spark, sf_dir, "documents"), default_path(TOKENIZER), END_ID, scratch(spark, "store"))
    if bad := verify(spark, store):
        raise ValueError(f"{bad} shards differ from the manifest")
    return read_sums(spark, store)
