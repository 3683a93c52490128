"""Queries against their SQL, and the pipeline stage by stage, on the smallest tables."""

import collections
import re

import pytest
from tokenizers import Tokenizer

from terracell.llm import queries


def clean(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(tuple(r[i] for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_rows(name, spark, sf, duck):
    df = queries.queries()[name](spark, sf)
    cursor = duck.execute(queries.oracle_sql()[name])
    assert clean(df.columns, [tuple(r) for r in df.collect()]) == clean([d[0] for d in cursor.description], cursor.fetchall())


def test_pipeline(spark, sf):
    """Each stage's rows against the plain form of its rule, on what the stage before kept."""
    import corpus_pipeline as p
    from terracell.llm.tokens import default_path
    from terracell.llm.toxicity import fit

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = [docs]
    for _, stage in p.STAGES[:-1]:
        out = stage(spark, kept[-1], sf)
        assert out.columns == docs.columns
        kept.append(spark.createDataFrame(out.collect(), docs.schema))
    ids = [{r["doc_id"]: r["text"] for r in k.collect()} for k in kept]
    lexicon = fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert set(ids[1]) == {d for d, t in ids[0].items() if lexicon.score(t) < 0.5}
    sets = {}
    for d, t in ids[1].items():
        w = (t or "").encode().lower().split()
        k = min(5, len(w))
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
    above = {d: d for d in sets}

    def top(x):
        while above[x] != x:
            x = above[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                above[max(x, y)] = min(x, y)
    assert set(ids[2]) == {d for d in sets if top(d) == d}
    word, lower = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: word.findall((t or "").translate(lower))
    held = set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = words(r["text"])
        k = min(10, len(w))
        held |= {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
    sizes = {len(x) for x in held}
    clean = lambda w: not any(tuple(w[i : i + k]) in held for k in sizes for i in range(len(w) - k + 1))
    assert set(ids[3]) == {d for d, t in ids[2].items() if clean(words(t))}
    assert {d: t for d, t in ids[3].items() if t is None} == {d: t for d, t in ids[4].items() if t is None}
    assert set(ids[4]) == set(ids[3])
    packed = p.STAGES[-1][1](spark, kept[-1], sf).collect()
    assert {r["doc_id"] for r in packed} == set(ids[4])
    whole = Tokenizer.from_file(default_path("byte_bpe_50k.json"))
    n = {d: len(whole.encode(t or "", add_special_tokens=False).ids) + 1 for d, t in ids[4].items()}
    got = collections.defaultdict(int)
    for r in packed:
        got[r["doc_id"]] += r["length"]
    assert got == n and len({r["sequence_id"] for r in packed}) <= -(-sum(n.values()) // 2048) + 1
