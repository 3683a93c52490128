"""Benchmark decontamination with a broadcast set of n-gram hashes.

The test items' windows (n consecutive words, or a whole item that is shorter) are hashed into a sorted set, which goes to
every executor. A scan hashes each text's windows, looks them up, and compares the words of every hit with the item's.
A test set over `BLOCK_CHARS` characters is taken in blocks, one scan after the other, so what is broadcast is bounded; of
the earlier blocks only the rows with a hit are kept, and joined to the documents at the end.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terracell.llm.common import by_batch, free, table
from terracell.llm.neardup import _WORDS, _mix
from terracell.scratch import stored

WINDOW = 10
#: Characters of test items in one broadcast set.
BLOCK_CHARS = 16_000_000
#: Bits of the first look-up's address.
BITS = 22
#: Letter rule on UTF-8 bytes: A-Z become a-z, other ASCII but digits and letters becomes a blank.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
_STEP = np.random.Generator(np.random.PCG64(41)).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def letter_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_BYTES).split()


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    s = np.full(len(h) - n + 1, n, np.uint64)
    for j in range(n):
        s += h[j : len(h) - n + 1 + j] * _STEP[j % 256]
    return _mix(s)


class Windows:
    """The windows of test items: sorted hashes, and the items' words by place (some 30 bytes a window)."""

    def __init__(self, items: list[tuple], n: int) -> None:
        self.n, self.words, self.ids, known = n, [], [], {}
        hashes: dict[int, list[np.ndarray]] = {}
        places: dict[int, list[np.ndarray]] = {}
        first, owner = [], []
        for item, text in items:
            words = [known.setdefault(w, w) for w in letter_words(text)]
            if not words:
                continue
            k = min(n, len(words))
            h = window_hashes(np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words)), k)
            hashes.setdefault(k, []).append(h)
            places.setdefault(k, []).append(np.arange(len(h), dtype=np.int64) + len(self.words))
            first.append(len(self.words))
            owner.append(item)
            self.words += words
        self.first, self.owner = np.array(first, np.int64), owner
        self.keys, self.at, self.bits = {}, {}, {}
        for k in hashes:
            h, p = np.concatenate(hashes[k]), np.concatenate(places[k])
            order = np.argsort(h, kind="stable")
            self.keys[k], self.at[k] = h[order], p[order]
            self.bits[k] = np.zeros(1 << BITS, bool)
            self.bits[k][h >> np.uint64(64 - BITS)] = True

    def _owners(self, lo: int, hi: int, k: int, w: list[bytes]) -> tuple[bool, set]:
        """Whether a window of the sorted ones from lo to hi has these words, and whose."""
        p = [x for x in self.at[k][lo:hi].tolist() if self.words[x : x + k] == w]
        return bool(p), {self.owner[i] for i in np.unique(np.searchsorted(self.first, np.array(p, np.int64), "right") - 1).tolist()}

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set]:
        """Which words stand in a window's occurrence, and the items of the windows that occur."""
        hit, items = np.zeros(len(words), bool), set()
        if not words:
            return hit, items
        h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
        for k, keys in self.keys.items():
            if len(words) < k:
                continue
            s = window_hashes(h, k)
            at = np.flatnonzero(self.bits[k][s >> np.uint64(64 - BITS)])
            if not len(at):
                continue
            lo, hi = np.searchsorted(keys, s[at], "left"), np.searchsorted(keys, s[at], "right")
            seen: dict[tuple, bool] = {}
            for p, i, j in zip(at[lo < hi].tolist(), lo[lo < hi].tolist(), hi[lo < hi].tolist()):
                w = tuple(words[p : p + k])
                if w not in seen:
                    seen[w], found = self._owners(i, j, k, list(w))
                    items |= found
                if seen[w]:
                    hit[p : p + k] = True
        return hit, items


def _hits(texts: DataFrame, rows: DataFrame, n: int, every: bool) -> DataFrame:
    """(row, n_words, hit, items) of (row, text); without `every` of the rows with a hit alone."""
    held = texts.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, [(r[0], r[1]) for r in rows.collect()]))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        windows = _windows(held, n)
        out = []
        for r, t in zip(b.column(0).to_pylist(), b.column(1)):
            words = letter_words(t.as_py())
            hit, items = windows.scan(words)
            found = bool(hit.any())
            if found or every:
                out.append((r, len(words), hit.astype(np.uint8).tobytes() if found else b"", sorted(items - {None})))
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 4, kinds)], names=list("abcd"))

    return by_batch(texts, run, "row long, n_words long, hit binary, items array<long>")


def _joined(parts: DataFrame) -> DataFrame:
    """One row of (row, hit, items) from those of several blocks, of which a row has one each at most."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        hits = [np.bitwise_or.reduce([np.frombuffer(h, np.uint8) for h in some]).tobytes() for some in b.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(hits, pa.binary()), b.column(2)], names=list("abc"))

    items = F.array_sort(F.array_distinct(F.flatten(F.collect_list("items"))))
    return by_batch(parts.groupBy("row").agg(F.collect_list("hit").alias("hits"), items.alias("items")), run, "row long, hit binary, items array<long>")


def scan(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, names: tuple[str, str, str] = ("_n_words", "_hit", "_items")) -> DataFrame:
    """Adds the number of words, a byte for each word (1 inside a window) and the ids of the items to documents with a text.

    Without a hit the bytes are empty, in however many blocks the items are taken. Columns that have one of the three
    `names` are replaced. Null texts and items have no words. A null item_id counts as no item, its windows still hit.
    Repeated items count once, repeated rows each. An empty table stays empty.
    """
    spark = docs.sparkSession
    benchmark = benchmark.select("item_id", "text")
    chars = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = 1 + chars // BLOCK_CHARS
    docs = docs.drop(*names)
    kept, of = docs.columns, docs.schema
    if blocks == 1:
        held = spark.sparkContext.broadcast((uuid.uuid4().hex, [(r[0], r[1]) for r in benchmark.collect()]))

        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            windows = _windows(held, n)
            count, hits, ids = [], [], []
            for t in b.column(kept.index("text")):
                words = letter_words(t.as_py())
                hit, items = windows.scan(words)
                count.append(len(words))
                hits.append(hit.astype(np.uint8).tobytes() if hit.any() else b"")
                ids.append(sorted(items - {None}))
            made = [pa.array(count, pa.int64()), pa.array(hits, pa.binary()), pa.array(ids, pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays([*b.columns, *made], names=[*kept, *names])

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in of.fields)
        return by_batch(docs, run, f"{kinds}, `{names[0]}` long, `{names[1]}` binary, `{names[2]}` array<long>")
    row = free("_row", docs)
    docs = stored(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    texts, found, count = docs.select(F.col(row).alias("row"), "text"), None, None
    for i in range(blocks):
        part = _hits(texts, benchmark.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == i), n, every=i == 0)
        part = stored(part, "hits")
        if i == 0:
            count = part.select(F.col("row").alias(row), F.col("n_words").alias(names[0]))
        some = part.where(F.length("hit") > 0).select("row", "hit", "items")
        found = some if found is None else found.union(some)
    found = _joined(found).select(F.col("row").alias(row), F.col("hit").alias(names[1]), F.col("items").alias(names[2]))
    out = docs.join(count, row).join(found, row, "left")
    none = F.array().cast("array<bigint>")
    return out.select(*[F.col(f"`{c}`") for c in kept], F.col(names[0]), F.coalesce(names[1], F.lit(b"")).alias(names[1]), F.coalesce(names[2], none).alias(names[2]))


_MADE: dict[tuple[str, int], Windows] = {}


def _windows(held, n: int) -> Windows:
    """One set at a time for each worker process."""
    name, items = held.value
    if (name, n) not in _MADE:
        _MADE.clear()
        _MADE[name, n] = Windows(items, n)
    return _MADE[name, n]


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, remove: str = "documents") -> DataFrame:
    """Documents without test windows: whole documents go ("documents"), or the spans of their hit words ("spans").

    Every column stays, whatever its name. Rows that repeat are judged each; null texts stay as they are.
    """
    names = (free("_n_words", docs), free("_hit", docs), free("_items", docs))
    found = scan(docs, benchmark, n, names)
    if remove == "documents":
        return found.where(F.length(names[1]) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
    if remove != "spans":
        raise ValueError("remove is documents or spans")
    import re

    word, kept = re.compile(r"[0-9A-Za-z\u0080-\U0010ffff]+"), docs.columns

    def cut(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = []
        for t, h in zip(b.column(kept.index("text")).to_pylist(), b.column(len(kept) + 1).to_pylist()):
            if h:
                out, at, inside, end = [], 0, False, 0
                for m, x in zip(word.finditer(t), h):
                    if x and not inside:
                        out.append(t[at : m.start()])
                    if not x and inside:
                        at = end
                    inside, end = bool(x), m.end()
                t = "".join(out) + t[end if inside else at :]
            texts.append(t)
        return pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else b.column(i) for i, c in enumerate(kept)], names=kept)

    return by_batch(found, cut, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all test items."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))

    def digest(b: pa.RecordBatch) -> pa.RecordBatch:
        hit = [sum(x) for x in b.column(2).to_pylist()]
        items = b.column(3).to_pylist()
        sha = [hashlib.sha256(",".join(sorted(map(str, x))).encode()).hexdigest() for x in items]
        cols = [b.column(0), b.column(1), pa.array(hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(sha, pa.string())]
        return pa.RecordBatch.from_arrays(cols, names=list("abcde"))

    out = by_batch(found.select(F.col("doc_id").cast("long"), "_n_words", "_hit", "_items"), digest, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string")
    return out.withColumn("contaminated", F.col("n_hit") > 0)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(10, len(ws)) AS k, array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') AS w
  FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)
), ks AS (
  SELECT DISTINCT k FROM bw
), dw AS (
  SELECT doc_id, k, i, array_to_string(ws[i:i + k - 1], ' ') AS w
  FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, ks WHERE len(ws) >= k)
), h AS (
  SELECT doc_id, item_id, i, k FROM dw JOIN bw USING (k, w)
), n AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM h)) GROUP BY doc_id
), t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
"""
