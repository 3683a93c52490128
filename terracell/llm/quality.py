"""Quality rules by host, in DataFrame expressions alone.

Each text's rules are counted; failures are summed by host, and a host's rate of a rule is shrunk towards the rate of all
hosts with a beta prior fitted to them by moments, so that hosts with few documents are not judged by chance. A host whose
shrunk rate passes a limit is rejected, and its verdict is joined back to its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terracell.llm.common import let, small, table
from terracell.scratch import stored

#: Fewest words; most of the words that may stand in repeated windows, symbols and repeated lines, in per cent.
MIN_WORDS, MAX_REPEATED, MAX_SYMBOLS, MAX_LINES = 50, 50, 30, 50
#: Hosts whose verdicts may be broadcast; more of them are joined by shuffle, where a hot host's partition is split.
HOST_ROWS = 200_000
#: Shrunk rate of failures over which a host is rejected.
HOST_LIMIT = 0.6
RULES = ("short", "repeated", "symbols", "lines")
_SPACE = r"[\x20\x09-\x0D]+"


def repeat_words(words: Column) -> Column:
    """Words that stand in a 3-word window found twice or more."""
    n = F.size(words)
    hashes = F.when(n < 3, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))))

    def covered(s: Column) -> Column:
        beside = lambda i, j: F.coalesce(F.get(s, i)["h"] == F.get(s, j)["h"], F.lit(False))
        found = F.filter(s, lambda x, i: beside(i, i + 1) | F.when(i > 0, beside(i, i - 1)).otherwise(False))
        at = F.sort_array(F.transform(found, lambda x: x["p"]))
        step = lambda a, p: F.struct((p + 3).alias("end"), (a["n"] + p + 3 - F.greatest(p, a["end"])).alias("n"))
        return F.aggregate(at, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), step, lambda a: a["n"])

    def count(h: Column) -> Column:
        paired = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(paired, covered))

    return let(hashes, count)


def counted(docs: DataFrame) -> DataFrame:
    """doc_id, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words. A null text has no words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), text.alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", _SPACE), ""))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return rows.select(
        "doc_id",
        "source",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("words")).cast("long").alias("n_repeat_words"),
    )


def failures() -> dict[str, Column]:
    n = F.col("n_words")
    return {"short": n < MIN_WORDS, "repeated": 100 * F.col("n_repeat_words") > MAX_REPEATED * n, "symbols": 100 * F.col("n_symbols") > MAX_SYMBOLS * F.greatest(n, F.lit(1)) * 3, "lines": 100 * F.col("n_dup_lines") > MAX_LINES * n}


def host_verdicts(rows: DataFrame) -> DataFrame:
    """host (the source, null as the empty string), its documents, its shrunk rate of each rule, and host_failed.

    The prior's mean is the mean of the hosts' rates, its strength what their variance leaves: mean (1 - mean) / variance - 1,
    held between 2 and 10,000. With a single host, or none, the strength is 10,000 and nothing is shrunk elsewhere.
    """
    each = [F.sum(c.cast("long")).alias(f"f_{r}") for r, c in failures().items()]
    hosts = stored(rows.groupBy(F.coalesce("source", F.lit("")).alias("host")).agg(F.count("*").alias("n"), *each), "hosts")
    sums = [f(F.col(f"f_{r}") / F.col("n")).alias(f"{k}_{r}") for r in RULES for k, f in (("m", F.avg), ("v", F.var_pop))]
    prior = hosts.agg(*sums).first()  # eight numbers
    rates = []
    for r in RULES:
        m, v = min(max(prior[f"m_{r}"] or 0.0, 1e-6), 1 - 1e-6), prior[f"v_{r}"] or 0.0
        strength = min(max(m * (1 - m) / v - 1, 2.0), 10_000.0) if v else 10_000.0
        rates.append(((F.col(f"f_{r}") + m * strength) / (F.col("n") + strength)).alias(f"rate_{r}"))
    out = hosts.select("host", F.col("n").alias("host_docs"), *rates)
    return out.withColumn("host_failed", F.greatest(*[F.col(f"rate_{r}") for r in RULES]) > HOST_LIMIT)


def judge(docs: DataFrame) -> DataFrame:
    """Counts, base_failed, the host's shrunk rates and verdict, and kept, of each row of (doc_id, text, source).

    Null and empty texts fail as short. Equal rows are judged alike, each on its own. An empty table gives no rows.
    """
    rows = stored(counted(docs), "counted")
    f = failures()
    hosts = small(stored(host_verdicts(rows), "verdicts"), HOST_ROWS)
    out = rows.withColumn("host", F.coalesce("source", F.lit(""))).join(hosts, "host")
    out = out.withColumn("base_failed", f["short"] | f["repeated"])
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, judged; source is the host."""
    out = judge(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE = r"""
WITH w AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), l AS (
  SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w
), g AS (
  SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3
), v AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS c FROM g
), r AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM v WHERE c > 1) GROUP BY doc_id
), c AS (
  SELECT w.doc_id, host, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM w JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)
), f AS (
  SELECT *, n_words < 50 AS a, 100 * n_repeat_words > 50 * n_words AS b, 100 * n_symbols > 30 * greatest(n_words, 1) * 3 AS d,
         100 * n_dup_lines > 50 * n_words AS e FROM c
), h AS (
  SELECT host, count(*) AS n, unnest([sum(a::INT), sum(b::INT), sum(d::INT), sum(e::INT)]) AS k, unnest([1, 2, 3, 4]) AS rule FROM f GROUP BY host
), p AS (
  SELECT rule, least(greatest(avg(k / n), 1e-6), 1 - 1e-6) AS m, var_pop(k / n) AS v FROM h GROUP BY rule
), s AS (
  SELECT rule, m, CASE WHEN v > 0 THEN least(greatest(m * (1 - m) / v - 1, 2), 10000) ELSE 10000 END AS s FROM p
), x AS (
  SELECT host, max((k + m * s) / (n + s)) > 0.6 AS bad FROM h JOIN s USING (rule) GROUP BY host
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (a OR b) AS base_failed, NOT (a OR b) AND NOT bad AS kept
FROM f JOIN x USING (host)
"""
