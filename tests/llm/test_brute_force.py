"""Operators that SQL doesn't express, against plain forms of their rules on whole small tables."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from terracell.llm import langid, licenses, queries, toxicity

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def licence_rows(text):
    """n_words, n_base, first, last, base labels, labels and score of a text, by going through all pairs of places."""
    words = WORD.findall((text or "").translate(LOWER))
    base, labels, score = [], set(), 0.0
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        base += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    for label, phrase in licenses.TEMPLATES:
        p, k = phrase.split(), licenses.K
        windows, diagonals = len(p) - k + 1, collections.defaultdict(list)
        for i in range(len(words) - k + 1):
            for j in range(windows):
                if words[i : i + k] == p[j : j + k]:
                    diagonals[i - j].append((i, j))
        spans = []
        for d in sorted(diagonals):
            if spans and d - spans[-1][-1][0] <= licenses.NEAR:
                spans[-1].append((d, diagonals[d]))
            else:
                spans.append([(d, diagonals[d])])
        for s in spans:
            at = [x for _, hits in s for x in hits]
            share = len({j for _, j in at}) / windows
            near = max(i for i, _ in at) - min(i for i, _ in at) < 2 * windows
            if share >= licenses.COVER and (near or max(len({j for _, j in hits}) for _, hits in s) >= licenses.COVER * windows):
                labels.add(label)
                score = max(score, share)
    places = [i for i, _ in base]
    if base:
        score = 1.0
    joined = lambda x: ",".join(sorted(set(x)))
    return len(words), len(base), min(places, default=None), max(places, default=None), joined(x for _, x in base), joined(labels | {x for _, x in base}), score


def test_licenses(spark, sf):
    rng = random.Random(12)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    pool = [p for _, p in licenses.TEMPLATES] + list(licenses.BASE)
    made = []
    for i in range(150):  # templates with words put in, left out, repeated and cut short
        words = []
        for _ in range(rng.randint(1, 3)):
            p = rng.choice(pool).split()
            for _ in range(rng.randint(0, 2)):
                at = rng.randrange(len(p))
                p[at : at + rng.randint(0, 1)] = [rng.choice(["the", "x", "license"])][: rng.randint(0, 1)]
            words += p[: rng.randint(2, len(p) + 3)] + ["filler"] * rng.randint(0, 3)
        made.append((100_000 + i, " ".join(words).title() if i % 3 else " -- ".join(words)))
    made += [(1_000_000, "Under the MIT Lıcense Key UNDER THE MIT LICENSE"), (1_000_001, None), (1_000_002, "")]
    extra = spark.createDataFrame(made, "doc_id long, text string")
    every = docs.union(extra)
    want = {r["doc_id"]: licence_rows(r["text"]) for r in every.collect()}
    base = F.col("exact") & F.col("label").isNotNull()
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    rows = licenses.spans(every).groupBy("doc_id").agg(F.first("n_words").alias("n"), F.sum(base.cast("long")).alias("b"), F.min(F.when(base, F.col("first_word"))).alias("f"), F.max(F.when(base, F.col("first_word"))).alias("l"), joined(F.when(base, F.col("label"))).alias("bl"), joined("label").alias("ls"), F.max("score").alias("s"))
    got = {r["doc_id"]: tuple(r)[1:] for r in rows.collect()}
    assert {k: v[:6] for k, v in got.items()} == {k: v[:6] for k, v in want.items()}
    assert all(math.isclose(got[k][6], want[k][6]) for k in want)
    mine = queries.op3_license_scan(spark, sf).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"]) for r in mine} == {r["doc_id"]: want[r["doc_id"]][:6] for r in docs.collect()}


def test_toxicity_matches():
    """The automaton's sums are those of looking for each term at each place."""
    rng = random.Random(2)
    for _ in range(300):
        terms = {f" {''.join(rng.choice('abc') for _ in range(rng.randint(1, 3)))}{rng.choice(['', ' '])}": rng.choice([1.0, 2.0, 3.5]) for _ in range(4)}
        phrases = (" ".join("".join(rng.choice("abc") for _ in range(rng.randint(1, 2))) for _ in range(2)),)
        lexicon = toxicity.Lexicon(terms, phrases)
        text = " ".join("".join(rng.choice("abc@4") for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(0, 12)))
        folded = toxicity.fold(text)
        fine = [(i, i + len(p) + 2) for p in phrases for i in range(len(folded)) if folded.startswith(f" {p} ", i)]
        total = 0.0
        for i in range(len(folded)):
            hits = [w for t, w in terms.items() if folded.startswith(t, i) and not any(a <= i and i + len(t) <= b for a, b in fine)]
            total += max(hits, default=0.0)
        assert math.isclose(lexicon.sums(text)[0], total)


def test_toxicity_held_out(spark, sf):
    rows = queries.op4_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert all(r["held_out"] for r in held) and sum(r["held_out"] for r in rows) == len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert sum(r["predicted"] == r["toxic"] for r in held) >= 0.9 * len(held)


def test_language_by_brute_force(spark, sf):
    """Each text's cosine with each centroid, by going through its letters one by one."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model, mask = langid.fit(docs), 0xFFFFFFFF
    mixed = lambda x: ((x ^ x >> 15) * int(langid._A) & mask) >> 20

    def naive(text):
        letters = [ord(c.lower()[0]) if c.isalpha() else 32 for c in text]
        if not any(c != 32 for c in letters):
            return langid.UNKNOWN, 0.0
        c = [32]
        for x in [*letters, 32]:
            if x != 32 or c[-1] != 32:
                c.append(x)
        n = collections.Counter()
        for i in range(len(c) - 1):
            two = (c[i] * int(langid._A) + c[i + 1] * int(langid._B)) & mask
            n[mixed(two)] += 1
            if i + 2 < len(c):
                n[mixed((two + c[i + 2] * int(langid._C)) & mask)] += 1
        v = {d: math.sqrt(k) * float(model.idf[d]) for d, k in n.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        s = [sum(x * float(m[d]) for d, x in v.items()) / norm for m in model.centroids]
        return model.languages[int(np.argmax(s))], max(s)

    got = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    for r in docs.collect():
        lang, cosine = naive((r["text"] or "")[:3000])
        if len(r["text"] or "") <= 3000:
            assert math.isclose(got[r["doc_id"]]["score"], cosine, abs_tol=1e-4)
            assert got[r["doc_id"]]["lang_pred"] == lang or cosine == 0
    held = [r for r in got.values() if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 and r["lang"]]
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.9 * len(held)


@pytest.fixture(scope="module")
def odd(spark, sf):
    """The documents with repeated rows, nulls in every column, long and empty texts, and columns whose names operators use."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    some = docs.limit(20)
    long = "delta " * 30_000 + "end"
    more = spark.createDataFrame([(None, None, None, None, None), (900_001, "", "en", None, 0), (900_002, None, None, "web", None), (900_003, long, "en", "web", len(long)), (900_003, long, "en", "web", len(long)), (None, "only words of mine here today", "en", "web", 29)], docs.schema)
    return docs.union(some).union(more).withColumns({"score": F.lit("mine"), "_hit": F.lit(1), "_items": F.lit(2), "_row": F.lit(3), "row": F.lit(4), "group": F.lit(5), "_found": F.lit(6), "key": F.lit(7), "kept": F.lit(8), "length": F.lit(9)})


def test_pipeline_of_odd_rows(spark, sf, odd):
    """Stage by stage: only rows that the rule of the stage rejects go, columns stay, and the tokens of all kept texts are packed."""
    import corpus_pipeline as p

    docs, seen = odd, []
    for name, stage in p.STAGES[:-1]:
        before = docs.collect()
        out = stage(spark, docs, sf)
        assert out.columns == odd.columns, name
        rows = out.collect()
        kind = lambda r: tuple(r[c] for c in ("score", "_hit", "_items", "_row", "row", "group", "_found", "key", "kept", "length"))
        assert {kind(r) for r in rows} == {("mine", 1, 2, 3, 4, 5, 6, 7, 8, 9)}, name
        if name != "pii":
            assert not collections.Counter(map(tuple, rows)) - collections.Counter(map(tuple, before)), name
        else:
            assert collections.Counter(r["doc_id"] for r in rows) == collections.Counter(r["doc_id"] for r in before)
        seen.append(len(rows))
        docs = spark.createDataFrame(rows, odd.schema)
    assert seen == sorted(seen, reverse=True)
    kept = docs.collect()
    ids = collections.Counter(r["doc_id"] for r in kept)
    assert ids[900_003] == 1 and ids[900_001] == 1 and ids[900_002] == 1
    packed = p.STAGES[-1][1](spark, docs, sf).collect()
    assert collections.Counter(r["doc_id"] for r in packed if r["piece"] == 0) == ids
    ends = collections.defaultdict(int)
    for r in sorted(packed, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends[r["sequence_id"]]
        ends[r["sequence_id"]] += r["length"]
    assert max(ends.values()) <= 2048


def test_pipeline_of_nothing(spark, sf, odd):
    import corpus_pipeline as p

    docs = odd.limit(0)
    for _, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0 and docs.columns == odd.columns
    assert p.STAGES[-1][1](spark, docs, sf).count() == 0
