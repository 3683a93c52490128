"""Language identification by nearest centroid.

A text is a unit vector of hashed letter pairs and triples, weighted by root frequency and inverse document frequency. Each
language has several centroids, found by clustering its own texts on the sphere; a text takes the language of the centroid
with the greatest cosine, and is rejected where that cosine is lower than nearly all training texts' at that centroid.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terracell.llm.common import by_batch, table

#: Texts that the centroids are fitted on, at most (those with the least hash of doc_id).
SAMPLE = 4_000
DIMS, CENTROIDS, ROUNDS = 4096, 4, 12
#: Share of a centroid's training texts that its radius leaves out.
OUTLIERS = 0.005
UNKNOWN = "und"


def _letters() -> np.ndarray:
    """Code points under 65,536: a letter's lower case, else a blank."""
    return np.array([ord(c.lower()[0]) if (c := chr(i)).isalpha() else 32 for i in range(1 << 16)], np.uint32)


_TABLE = _letters()
_A, _B, _C = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)


def counts(text: str | None) -> np.ndarray | None:
    """Counts of the hashed pairs and triples; None for texts without a letter."""
    if not text:
        return None
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    c = np.where(c < 1 << 16, _TABLE[np.minimum(c, 65535)], c)
    if not (c != 32).any() or (c.max() > 65535 and not any(x.isalpha() for x in text)):
        return None
    c = np.concatenate(([32], c, [32])).astype(np.uint32)
    c = c[np.concatenate(([True], (c[1:] != 32) | (c[:-1] != 32)))]
    two = c[:-1] * _A + c[1:] * _B
    three = two[:-1] + c[2:] * _C
    shift = np.uint32(32 - 12)
    mixed = lambda x: (x ^ (x >> np.uint32(15))) * _A >> shift
    return np.bincount(mixed(two), minlength=DIMS) + np.bincount(mixed(three), minlength=DIMS)


@dataclass
class Model:
    idf: np.ndarray
    centroids: np.ndarray
    languages: list[str]
    radius: np.ndarray

    def vector(self, n: np.ndarray) -> np.ndarray:
        v = np.sqrt(n) * self.idf
        return v / max(np.linalg.norm(v), 1e-12)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, cosine (0 to 1), and whether the text lies outside the centroid's radius."""
        n = counts(text)
        if n is None or not len(self.languages):
            return UNKNOWN, 0.0, True
        s = self.centroids @ self.vector(n)
        i = int(s.argmax())
        return self.languages[i], float(min(max(s[i], 0.0), 1.0)), bool(s[i] < self.radius[i])


def cluster(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit centroids and each row's own. Starts from rows far from each other; the result depends on the rows alone."""
    k = min(k, len(x))
    picks = [int((x @ x.mean(axis=0)).argmax())]
    near = x @ x[picks[0]]
    while len(picks) < k:
        picks.append(int(near.argmin()))
        near = np.maximum(near, x @ x[picks[-1]])
    c = x[picks]
    for _ in range(ROUNDS):
        own = (x @ c.T).argmax(axis=1)
        c = np.stack([x[own == j].sum(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c, (x @ c.T).argmax(axis=1)


def held_out(docs: DataFrame):
    return F.coalesce(F.crc32(docs["doc_id"].cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """From at most `sample` rows of (doc_id, text, lang) that are not held out; null texts, languages and ids teach nothing."""
    some = docs.where(~held_out(docs) & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    ids = some.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # so few may be broadcast
    some = some.join(F.broadcast(ids.distinct()), "doc_id").select("text", "lang", F.xxhash64("doc_id", "text", "lang").alias("h"))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        ids, n, lang, hashes = [], [], [], []
        for t, g, h in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist()):
            c = counts(t.as_py())
            if c is not None:
                i = np.flatnonzero(c)
                ids.append(i.astype("<u2").tobytes())
                n.append(c[i].astype("<u4").tobytes())
                lang.append(g)
                hashes.append(h)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(n, pa.binary()), pa.array(lang, pa.string()), pa.array(hashes, pa.int64())], names=list("abcd"))

    # ids that repeat bring more rows than ids; the cut is by hash, so that it falls on all languages, and of counts, not texts
    seen = by_batch(some, run, "i binary, n binary, lang string, h long").orderBy("h", "lang", "i", "n").limit(sample)
    rows = sorted((r["lang"], bytes(r["i"]), bytes(r["n"])) for r in seen.collect())
    if not rows:
        return Model(np.ones(DIMS), np.zeros((0, DIMS)), [], np.zeros(0))
    x = np.zeros((len(rows), DIMS), np.float32)
    for row, (_, i, n) in zip(x, rows):
        row[np.frombuffer(i, "<u2")] = np.frombuffer(n, "<u4")
    idf = (np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 1).astype(np.float32)
    x = np.sqrt(x) * idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    lang = np.array([r[0] for r in rows])
    centroids, names, radius = [], [], []
    for g in sorted(set(lang)):
        own_rows = x[lang == g]
        c, own = cluster(own_rows, CENTROIDS)
        for j in range(len(c)):
            if (own == j).any():
                centroids.append(c[j])
                names.append(str(g))
                radius.append(np.quantile(own_rows[own == j] @ c[j], OUTLIERS))
    return Model(idf, np.stack(centroids), names, np.array(radius))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Adds lang_pred, score and rejected to documents with a text; columns of these names are replaced.

    A rejected text keeps its nearest language; a user who wants none takes `rejected`. Null texts and texts without a
    letter are UNKNOWN with score 0, rejected. Repeated rows are judged alike, of equal cosines the first centroid's counts,
    and an empty table stays empty.
    """
    docs = docs.drop("lang_pred", "score", "rejected")
    held, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        p = [held.value.predict(t.as_py()) for t in b.column(at)]
        made = [pa.array([x[i] for x in p], k) for i, k in enumerate((pa.string(), pa.float64(), pa.bool_()))]
        return pa.RecordBatch.from_arrays([*b.columns, *made], names=[*b.schema.names, "lang_pred", "score", "rejected"])

    return by_batch(docs, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + ", lang_pred string, score double, rejected boolean")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    out = identify(docs.select("doc_id", "text"), fit(docs))
    return out.select("doc_id", held_out(out).alias("held_out"), "lang_pred", "score", "rejected")
