"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton on folded text.

Folding lower-cases, takes accents off, and turns look-alike letters and digits that stand for letters into those letters,
in the lexicon's words and in the texts alike. The lexicon holds whole words and beginnings of words with their log odds
in labelled texts. A text's weights are added up, without hits inside exception phrases, and set against its length; a
logistic function of both gives the score.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terracell.llm.common import by_batch, table
from terracell.scratch import stored

#: Labelled rows that the lexicon and the score are fitted on, at most (those with the least hash of doc_id).
SAMPLE = 20_000
#: Of the toxic texts, at least this share and this many have a term; its log odds are at least ODDS. The share bounds the
#: terms that can pass: a hundred times those of an average text, whatever the sample.
SHARE, LEAST, ODDS = 0.01, 5, 2.5
#: Lengths of the beginnings of words that may be terms.
STEMS = (4, 5, 6, 7, 8, 9)
#: Digits and signs that stand for letters; letters of other scripts that look like Latin ones.
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
LOOK_ALIKES = {"а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i"}
#: Phrases whose words are not meant badly.
EXCEPTIONS = ("trash can", "trash bin", "trash collection", "clown fish", "class clown", "pond scum", "worthless cheque", "stupid proof")


class _Fold(dict):
    """Code point to folded letter or blank, worked out when first seen."""

    def __missing__(self, c: int) -> str:
        ch = unicodedata.normalize("NFKD", chr(c))[:1].lower()
        ch = SIGNS.get(ch) or LOOK_ALIKES.get(ch) or (ch if ch.isalpha() else "" if unicodedata.combining(ch) else " ")
        self[c] = ch
        return ch


_FOLD = _Fold()
_ASCII = "".join(_FOLD[c] for c in range(128)).encode()
_ASCII += bytes(128)


def fold(text: str | None) -> str:
    """Folded words with single or more blanks between, and one at either end."""
    if not text:
        return "  "
    if text.isascii():
        return " " + text.encode().translate(_ASCII).decode() + " "
    return " " + text.translate(_FOLD) + " "


def terms_of(text: str | None) -> set[str]:
    """Whole words and beginnings of words, each with the blanks that bound it."""
    out = set()
    for w in set(fold(text).split()):
        out.add(f" {w} ")
        out.update(f" {w[:k]}" for k in STEMS if k < len(w))
    return out


@dataclass
class Lexicon:
    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    #: Of log(1 + sum), log(1 + sum for 100 words), and alone.
    factors: tuple[float, float, float] = (1.0, 1.0, -2.0)
    _made: list = field(default_factory=list, repr=False, compare=False)

    def __getstate__(self):
        return self.__dict__ | {"_made": []}

    def automaton(self):
        if not self._made:
            import ahocorasick

            a = ahocorasick.Automaton()
            for t, w in self.weights.items():
                a.add_word(t, (len(t), w))
            for p in self.exceptions:
                t = f" {' '.join(fold(p).split())} "
                a.add_word(t, (len(t), None))
            if len(a):
                a.make_automaton()
            self._made.append(a)
        return self._made[0]

    def sums(self, text: str | None) -> tuple[float, int]:
        """Sum of the weights of what is found, each place once, and number of words."""
        folded = fold(text)
        words = folded.count(" ") if text else 0
        a = self.automaton()
        if not len(a):
            return 0.0, words
        hits, fine = [], []
        for end, (n, w) in a.iter(folded):
            (hits if w is not None else fine).append((end - n + 1, end, w))
        best: dict[int, float] = {}
        for lo, hi, w in hits:
            if not any(x <= lo and hi <= y for x, y, _ in fine):
                best[lo] = max(best.get(lo, w), w)
        return sum(best.values()), words

    def features(self, text: str | None) -> tuple[float, float, float]:
        s, n = self.sums(text)
        return math.log1p(max(s, 0)), math.log1p(100 * max(s, 0) / max(n, 1)), 1.0

    def score(self, text: str | None) -> float:
        z = sum(a * b for a, b in zip(self.factors, self.features(text)))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Newton steps; the ridge keeps the factors finite where the classes part."""
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * b)
        b += step
        if abs(step).max() < 1e-6:
            break
    return b


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _counts(texts: DataFrame, only: list[str] | None = None) -> DataFrame:
    """(term, n): texts that have each term; summed within a task first."""
    known = None if only is None else texts.sparkSession.sparkContext.broadcast(frozenset(only))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for b in batches:
            for t in b.column(0):
                terms = terms_of(t.as_py())
                found.update(terms if known is None else terms & known.value)
        yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], names=["a", "b"])

    return texts.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def choose(bad: dict[str, int], good: dict[str, int], n_bad: int, n_good: int) -> dict[str, float]:
    """Terms with their log odds. Of a word and its beginnings, the longest that is about as frequent as the shortest."""
    odds = {}
    for t, p in bad.items():
        w = math.log((p + 0.5) / (n_bad + 1)) - math.log((good.get(t, 0) + 0.5) / (n_good + 1))
        if p >= max(LEAST, SHARE * n_bad) and w >= ODDS:
            odds[t] = w
    kept: dict[str, float] = {}
    for t in sorted(odds, key=lambda t: (len(t), t)):
        parent = next((t[:k] for k in range(len(t) - 1, 1, -1) if t[:k] in kept), None)
        if parent is None:
            kept[t] = odds[t]
        elif bad[t] >= 0.9 * bad[parent] or odds[t] > odds[parent] + 1:
            if bad[t] >= 0.9 * bad[parent]:
                del kept[parent]
            kept[t] = odds[t]
    return kept


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Lexicon:
    """From (doc_id, text) and (doc_id, toxic 0/1); null labels and texts teach nothing. Without toxic texts: an empty lexicon.

    Only rows that `held_out` doesn't take are read, and of these at most `sample`. What reaches the driver is counts of the
    terms that SHARE of its toxic texts have, and three numbers for each of the sample's texts. Equal texts teach once.
    """
    spark = docs.sparkSession
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "toxic")
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample)  # so few rows may be broadcast
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(known), "doc_id").select("text", "toxic")
    rows = stored(rows.groupBy("text").agg(F.max("toxic").alias("toxic")), "labelled")
    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n_bad, n_good = n.get(1, 0), n.get(0, 0)
    if not n_bad:
        return Lexicon({}, factors=(0.0, 0.0, -3.0))
    least = max(LEAST, SHARE * n_bad)
    bad = _counts(rows.where("toxic = 1")).where(F.col("n") >= least)
    bad = {r["term"]: r["n"] for r in bad.collect()}
    good = {r["term"]: r["n"] for r in _counts(rows.where("toxic = 0"), list(bad)).collect()}
    lexicon = Lexicon(choose(bad, good, n_bad, n_good))
    held = spark.sparkContext.broadcast(lexicon)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        f = [held.value.features(t.as_py())[:2] for t in b.column(0)]
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in f]), pa.array([x[1] for x in f]), b.column(1)], names=["a", "b", "c"])

    seen = by_batch(rows.select("text", F.col("toxic").cast("int")), run, "a double, b double, y int").collect()
    x = np.array([(r["a"], r["b"], 1.0) for r in seen])
    lexicon.factors = tuple(float(v) for v in logistic(x, np.array([r["y"] for r in seen], float)))
    return lexicon


def scored(docs: DataFrame, lexicon: Lexicon, name: str = "score") -> DataFrame:
    """Adds a score (0 to 1; a null or empty text's is that of no hits) to documents with a text, under `name`.

    A column of that name is replaced. Repeated rows get the same score each; an empty table stays empty.
    """
    docs = docs.drop(name)
    held, at = docs.sparkSession.sparkContext.broadcast(lexicon), docs.columns.index("text")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        s = [held.value.score(t.as_py()) for t in b.column(at)]
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], names=[*b.schema.names, name])

    return by_batch(docs, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + f", `{name}` double")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; learned from labelled rows that aren't held out."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = scored(docs, fit(docs, table(spark, sf_dir, "labels"))).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
