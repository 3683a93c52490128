"""Near-duplicate documents by MinHash with sequential Bayesian verification.

1. Each text gets its set of shingles, a key of the set, and a MinHash signature. Equal sets fall together by key.
2. Bands of the signature put sets into buckets. In a first round a bucket's sets are compared with its least one.
3. Signatures (a byte of each value) are compared batch by batch; a pair is dropped where the posterior probability that its
   similarity reaches the threshold falls under `MISS`. What survives is decided on the full sets.
4. Links give components. In buckets that still hold several, the sets outside of the greatest component are compared with
   one of its members: a pair or fewer for each set.
5. What is open then is compared across components in blocks of bounded size, each pair of the bands' candidates whose sets
   aren't joined yet. Survivors are verified inside of the block, and only links that join components leave it, so rows grow
   with the input whatever a bucket holds. No candidate of the bands is lost.

A pair at the threshold of 0.8 misses all bands with probability (1 - 0.8^6)^40, about 5.2e-6. If it shares one, it is
dropped in any of the six batches with probability 5.0e-6 in all (1.2e-6 at 0.81; a byte matches at 0.8008), reckoned for
independent values of the signature. Together about 1.0e-5, 1 in 100,000 such pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terracell.llm.common import by_batch, small, table
from terracell.llm.components import components
from terracell.scratch import remove, stored

BANDS, ROWS, BATCH = 40, 6, 40
HASHES = BANDS * ROWS
#: Probability at which a pair of the wanted similarity may be dropped in a batch.
MISS = 1e-6
#: Rounds in which open buckets are compared with one member of their greatest component, after the one with the least member.
LEADERS = 1
#: Sets of a bucket in one block, and shingles of them (8 bytes each), on average at most; pairs looked at in one step.
BLOCK_ROWS, BLOCK_SHINGLES, PAIRS = 2_000, 1_000_000, 200_000
_RNG = np.random.Generator(np.random.PCG64(20))
_FACTORS = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHINGLE = _RNG.integers(0, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Words whose hashes a worker keeps.
MEMO = 400_000


class WordHashes(dict):
    """64-bit hashes of words (bytes), of which a bounded number is kept."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= MEMO:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = WordHashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; of fewer words, of the whole sequence; of none, nothing."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    k = min(k, len(words))
    s = np.full(len(h) - k + 1, k, np.uint64)
    for j in range(k):
        s = _mix(s * _SHINGLE[j % 16] + h[j : len(h) - k + 1 + j])
    return np.unique(s)


def signature(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the bands, and the middle byte of each MinHash value."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 256):
        np.minimum(least, np.multiply.outer(_FACTORS, s[i : i + 256]).min(axis=1), out=least)
    mixed = _mix(least)
    parts = mixed.reshape(BANDS, ROWS)
    band = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(ROWS):
        band = _mix(band * _SHINGLE[j] + parts[:, j])
    return band.view(np.int64), (mixed >> np.uint64(24)).astype(np.uint8)


def least_matches(threshold: float, miss: float = MISS) -> list[int]:
    """For each number of compared batches, the fewest matches with which P(similarity >= threshold) is `miss` or more.

    The prior is uniform, so the posterior after m matches of n is a beta distribution, and that probability is
    P(Binomial(n + 1, threshold) <= m).
    """
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        p, m = 0.0, -1
        while p < miss:
            m += 1
            p += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def _signed(docs: DataFrame, k: int) -> DataFrame:
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        n, key, bands, sig = [], [], [], []
        for t in b.column(1):
            s = shingles(t.as_py(), k)
            some = signature(s) if len(s) else None
            n.append(len(s))
            key.append(some and hashlib.blake2b(s.tobytes(), digest_size=16).digest())
            bands.append(some and some[0])
            sig.append(some and some[1].tobytes())
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sig, pa.binary())], names=list("abcde"))

    return by_batch(docs, run, "doc_id long, n long, key binary, bands array<long>, sig binary")


def _survivors(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, floor: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs (x[i], y[j]) those whose signatures leave the threshold possible, and their matches."""
    same = np.zeros(len(i), np.int64)
    for k, m in enumerate(floor):
        part = slice(k * BATCH, (k + 1) * BATCH)
        same = same + (x[i, part] == y[j, part]).sum(axis=1)
        fine = same >= m
        i, j, same = i[fine], j[fine], same[fine]
    return i, j, same


def _sigs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, HASHES)


def _likely(pairs: DataFrame, sigs: DataFrame, threshold: float) -> DataFrame:
    """(a, b, same): pairs whose signatures leave the threshold possible, and how many of their values match."""
    floor = least_matches(threshold)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        every = np.arange(b.num_rows)
        i, _, same = _survivors(_sigs(b.column(2)), _sigs(b.column(3)), every, every, floor)
        return pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(i)) for c in (0, 1)), pa.array(same, pa.int64())], names=["a", "b", "c"])

    sig = sigs.select("rep", "sig")
    both = pairs.join(sig.withColumnsRenamed({"rep": "a", "sig": "sig_a"}), "a").join(sig.withColumnsRenamed({"rep": "b", "sig": "sig_b"}), "b")
    return by_batch(both.select("a", "b", "sig_a", "sig_b"), run, "a long, b long, same long", 2000)


def _alike(pairs: DataFrame, percent: int) -> DataFrame:
    """(a, b) of pairs whose numbers of shingles n_a and n_b leave the threshold possible."""
    return pairs.where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent).select("a", "b")


def _open(rows: DataFrame, comps: DataFrame, turn: int) -> DataFrame:
    """Of (band, rep, n) the buckets that hold several components.

    Added are the row's component, the bucket's greatest one (main) and a member of it that differs from turn to turn
    (lead), and into how many parts a bucket's rows (p) and those outside of main (q) are dealt, by rows and by shingles.
    """
    known = rows.select("band", "rep", "n").join(comps.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    known = stored(known, "known")
    pick = F.min(F.struct(F.xxhash64("rep", "band", F.lit(turn)).alias("h"), "rep"))
    sums = known.groupBy("band", "comp").agg(F.count("*").alias("m"), F.sum("n").alias("w"), pick.alias("pick"))
    sums = sums.groupBy("band").agg(F.sum("m").alias("rows"), F.sum("w").alias("weight"), F.max(F.struct("m", "comp", "w", F.col("pick.rep").alias("lead"))).alias("big")).where("rows > big.m")
    parts = lambda n, w: F.ceil(F.greatest(n / BLOCK_ROWS, w / BLOCK_SHINGLES)).cast("int")
    sums = sums.select("band", F.col("big.comp").alias("main"), F.col("big.lead").alias("lead"), parts(F.col("rows"), F.col("weight")).alias("p"), parts(F.col("rows") - F.col("big.m"), F.col("weight") - F.col("big.w")).alias("q"))
    return stored(known.join(small(stored(sums, "sums")), "band"), "open")


def _across(here: DataFrame, sigs: DataFrame, sets: DataFrame, threshold: float, percent: int) -> DataFrame:
    """Links between components of the buckets in `here`, enough of them to join up all components that any link joins.

    A bucket's greatest component is only dealt to blocks; its other rows are also sent to each block, so that every pair
    across components meets in one. Small buckets share blocks. First the rows with a surviving pair in a block are found
    by signature; they alone get their full sets, and the block is gone through again: survivors are verified one row after
    the other, and a pair whose components links of the block join already is passed over. Of a block come fewer links than
    it has components. A pair that meets in several bands is looked at in the first.
    """
    floor = least_matches(threshold)
    loose = here.where("p = 1").agg(F.count("*"), F.sum("n")).first()
    packs = 1 + max(loose[0] // BLOCK_ROWS, (loose[1] or 0) // BLOCK_SHINGLES)
    deal = lambda n, salt: F.pmod(F.xxhash64("rep", F.lit(salt)), n).cast("int")
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    kept = ("band", "p", "rep", "n", "comp")
    held = here.select(*kept, F.lit(0).cast("tinyint").alias("role"), deal(F.col("p"), 1).alias("x"), F.explode(upto(F.col("q"))).alias("y"))
    asked = here.where("comp <> main").select(*kept, F.lit(1).cast("tinyint").alias("role"), F.explode(upto(F.col("p"))).alias("x"), deal(F.col("q"), 2).alias("y"))
    block = F.when(F.col("p") == 1, F.pmod(F.xxhash64("band"), F.lit(packs))).otherwise(F.xxhash64("band", "x", "y"))
    dealt = held.unionByName(asked).select(block.alias("block"), "band", "x", "y", "role", "rep", "n", "comp").join(sigs.select("rep", "sig", "bands"), "rep")

    def pairs(t: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Survivors (asked row, other row) of each bucket of a block, in bounded steps; a pair counts in its first common band."""
        band, x, y, role, rep, n, comp = (t.column(c).to_numpy().astype(np.int64) for c in ("band", "x", "y", "role", "rep", "n", "comp"))
        sig, order = _sigs(t.column("sig")), np.lexsort((rep, role, y, x, band))
        bands = t.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
        edge = np.flatnonzero(np.concatenate(([True], (np.diff(np.stack([band, x, y])[:, order]) != 0).any(axis=0), [True])))
        for lo, hi in zip(edge, edge[1:]):
            rows = order[lo:hi]
            b, a = rows[role[rows] == 0], rows[role[rows] == 1]
            step = max(1, PAIRS // max(1, len(b)))
            for at in range(0, len(a), step):
                c = a[at : at + step]
                fine = (comp[c][:, None] != comp[b][None, :]) & (np.minimum.outer(n[c], n[b]) * 100 >= np.maximum.outer(n[c], n[b]) * percent)
                i, j = np.nonzero(fine)
                i, j, _ = _survivors(sig, sig, c[i], b[j], floor)
                common = bands[i] == bands[j]
                first = common.argmax(axis=1) == (common & (bands[i] == np.int32(band[rows[0]] >> 32))).argmax(axis=1)
                if first.any():
                    yield i[first], j[first]

    def taking(t: pa.Table) -> pa.Table:
        part = np.zeros(t.num_rows, bool)
        for i, j in pairs(t):
            part[i] = part[j] = True
        return t.filter(pa.array(part))

    def linking(t: pa.Table) -> pa.Table:
        rep, comp = (t.column(c).to_numpy() for c in ("rep", "comp"))
        s = t.column("s").combine_chunks()
        starts, ids = s.offsets.to_numpy().astype(np.int64), np.unique(s.values.to_numpy(), return_inverse=True)[1]
        size, seen, links, above = np.diff(starts), np.zeros(len(ids), bool), [], {}

        def top(c: int) -> int:
            while above.setdefault(c, c) != c:
                above[c] = c = above[above[c]]
            return c

        for i, j in pairs(t):
            for row in np.unique(i):
                own = top(int(comp[row]))
                others = [k for k in j[i == row].tolist() if top(int(comp[k])) != own]
                mine = ids[starts[row] : starts[row + 1]]
                seen[mine] = True
                for k in others:
                    c = top(int(comp[k]))
                    if c == top(own):
                        continue
                    common = int(np.count_nonzero(seen[ids[starts[k] : starts[k + 1]]]))
                    if 100 * common >= percent * int(size[row] + size[k] - common):
                        above[c] = top(own)
                        links.append((min(rep[row], rep[k]), max(rep[row], rep[k])))
                seen[mine] = False
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([x for _, x in links], pa.int64())})

    shape = "rep long, block long, band long, x int, y int, role tinyint, n long, comp long, sig binary, bands array<int>"
    some = stored(dealt.groupBy("block").applyInArrow(taking, shape), "blocks")
    used = sets.join(small(stored(some.select("rep").distinct(), "used")), "rep", "left_semi")
    full = some.join(used, "rep").select(*some.columns, "s")
    return stored(full.groupBy("block").applyInArrow(linking, "a long, b long"), "links")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets reach the threshold."""
    one = sets.withColumnsRenamed({"rep": "a", "s": "x"}).join(small(pairs.select("a", "b")), "a")
    other = sets.join(small(pairs.select(F.col("b").alias("rep")).distinct()), "rep", "left_semi").withColumnsRenamed({"rep": "b", "s": "y"})
    two = one.join(other, "b")
    common = two.select("a", "b", F.size("x").alias("p"), F.size("y").alias("q"), F.size(F.array_intersect("x", "y")).alias("i"))
    return stored(common.where(F.lit(100).cast("long") * F.col("i") >= F.lit(percent) * (F.col("p") + F.col("q") - F.col("i"))).select("a", "b"), "links")


def _sets(docs: DataFrame, reps: DataFrame, k: int) -> DataFrame:
    """Sorted shingle hashes of the documents in `reps`."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t.as_py(), k).view(np.int64) for t in b.column(1)], pa.list_(pa.int64()))], names=["a", "b"])

    held = docs.where(F.col("doc_id").isNotNull()).join(small(reps), F.col("doc_id") == F.col("rep"), "left_semi")
    return stored(by_batch(held, run, "rep long, s array<long>"), "sets", "lz4")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of (doc_id, text).

    Links are at a Jaccard similarity of `percent`/100 or more of the sets of k-word shingles. Empty and null texts have no
    shingles and no links. Rows that repeat a doc_id count as one document, whose texts' links all hold. A null doc_id can
    have an equal text's component, else null, and is kept where it is null. An empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = stored(_signed(docs, k).withColumn("row", F.monotonically_increasing_id()), "signed")
    base = stored(signed.select("doc_id", "n", "key"), "base")
    live = signed.where("n > 0 AND doc_id IS NOT NULL")
    nodes = live.groupBy("key").agg(F.min(F.struct("doc_id", "row")).alias("first"), F.first("n").alias("n"))
    nodes = stored(nodes.select("key", F.col("first.doc_id").alias("rep"), F.col("first.row").alias("row"), "n"), "nodes")

    # buckets with two keys or more; of a key 32 bits, by which two keys look like one with probability 2^-32
    banded = live.select("key", F.hash("key").alias("short"), F.explode("bands").alias("band"))
    many = banded.groupBy("band").agg(F.min("short").alias("lo"), F.max("short").alias("hi")).where("lo < hi").select("band")
    shared = banded.join(small(stored(many, "buckets")), "band").select("band", "key").distinct().join(nodes, "key")
    shared = stored(shared.select("band", "rep", "row", "n"), "shared")
    leads = stored(shared.groupBy("band").agg(F.min("rep").alias("lead")), "leads")
    some = stored(shared.select("rep", "row").distinct(), "some")
    sets = _sets(docs, stored(some.select("rep").distinct(), "reps"), k)
    sigs = signed.select("row", "n", "sig", F.transform("bands", lambda b: F.shiftright(b, 32).cast("int")).alias("bands")).join(small(some), "row").drop("row")
    sigs = stored(sigs, "sigs")
    remove(spark, signed.terracell_path)
    shared = shared.select("band", "rep", "n").join(small(leads), "band")

    lead = sigs.select(F.col("rep").alias("a"), F.col("n").alias("n_a"))
    asked = shared.where("rep <> lead")
    links = None
    for turn in range(LEADERS + 1):
        pairs = asked.select(F.col("lead").alias("a"), F.col("rep").alias("b"), F.col("n").alias("n_b")).distinct().join(lead, "a")
        likely = _likely(_alike(pairs, percent), sigs, percent / 100)
        if turn:  # one pair of a row: its likeliest
            likely = likely.groupBy("b").agg(F.max_by("a", F.struct("same", "a")).alias("a"))
        new = _linked(stored(likely.select("a", "b"), "pairs"), sets, percent)
        links = new if links is None else links.union(new)
        comps = components(links)
        here = _open(shared, comps, turn)
        shared = here.select("band", "rep", "n")
        asked = here.where("comp <> main")
    links = links.union(_across(here, sigs, sets, percent / 100, percent))
    comps = components(links)

    known = nodes.select("key", "rep").join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("key", F.coalesce("comp", "rep").alias("comp"))
    out = base.where("n > 0").join(known, "key", "left").select("doc_id", F.col("n").alias("n_shingles"), F.col("comp").alias("component_id"))
    alone = base.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    out = out.union(alone)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, two-word shingles, similarity 0.8; see `near_duplicates`."""
    return near_duplicates(table(spark, sf_dir, "documents"), k=2)


#: Each set's shingles by frequency; sets that reach 0.8 share one of the first fifth (and one more) in that order.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) = 1 THEN ws[1] ELSE ws[i] || ' ' || ws[i + 1] END AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws), 2))) AS i FROM w WHERE len(ws) > 0)
), n AS MATERIALIZED (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), f AS MATERIALIZED (
  SELECT doc_id, g, n, row_number() OVER (PARTITION BY doc_id ORDER BY c, g) AS r
  FROM (SELECT doc_id, g, count(*) OVER (PARTITION BY g) AS c FROM s) JOIN n USING (doc_id)
), p AS MATERIALIZED (
  SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM f a JOIN f b ON a.g = b.g AND a.doc_id < b.doc_id
  WHERE a.r <= a.n - (a.n * 4 + 4) // 5 + 1 AND b.r <= b.n - (b.n * 4 + 4) // 5 + 1 AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 80
), e AS MATERIALIZED (
  SELECT p.a, p.b FROM p JOIN s x ON x.doc_id = p.a JOIN s y ON y.doc_id = p.b AND y.g = x.g JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b
  GROUP BY p.a, p.b, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))
), l AS MATERIALIZED (
  SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), c AS (
  SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a
)
SELECT c.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""
