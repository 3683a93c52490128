"""A corpus pipeline: five operators, each on all that the one before it kept.

Columns of documents stay as they are through the stages that filter or rewrite; the last stage gives the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terracell.llm.common import SPACE_WORD, free, small, table
from terracell.llm.decontaminate import decontaminate
from terracell.llm.neardup import near_duplicates
from terracell.llm.packing import TOKENIZER, pack, pieces
from terracell.llm.pii import pseudonymize
from terracell.llm.tokens import default_path
from terracell.llm.toxicity import fit, scored
from terracell.scratch import scratch, stored


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the score takes for toxic (0.5 or more) go."""
    lexicon = fit(docs, table(spark, sf_dir, "labels"))
    score = free("score", docs)
    return scored(docs, lexicon, score).where(F.col(score) < 0.5).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the row with the least doc_id stays, nulls last.

    Each row is judged by itself, also where doc_ids repeat. Rows without a word stay, of those alike in all columns one.
    """
    row = free("_row", docs)
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    blank = ~F.coalesce("text", F.lit("")).rlike(SPACE_WORD)
    ids = rows.select(F.col(row).alias("row"), F.col("doc_id").alias("id"), F.when(blank, F.to_json(F.struct(*docs.columns))).alias("same"))
    judged = near_duplicates(rows.select(F.col(row).alias("doc_id"), "text"), k=5).withColumnRenamed("doc_id", "row").join(ids, "row")
    judged = stored(judged.select("row", "id", F.coalesce("same", F.col("component_id").cast("string")).alias("group")), "judged")
    first = judged.groupBy("group").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first"), F.count("*").alias("n"))
    first = stored(first.where("n > 1").select("group", F.col("first.row").alias("stays")), "first")
    gone = stored(judged.join(small(first), "group").where("row <> stays").select(F.col("row").alias(row)), "gone")
    return rows.join(small(gone), row, "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a test item go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), remove="documents")


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes pseudonyms; n_chars follows the text."""
    return pseudonymize(docs, names=(free("_found", docs), free("_kinds", docs))).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2,048 tokens and their places in sequences."""
    return pack(pieces(docs, default_path(TOKENIZER)))


STAGES = [("toxicity", toxicity), ("minhash_near_dedup", near_dedup), ("benchmark_decontamination", decontamination), ("pii", pii), ("best_fit_packing", packing)]
#: The stages learn, hash and tokenize, which SQL cannot express; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, base = table(spark, sf_dir, "documents"), scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
