"""Licence scans by diagonal voting.

Every k-word window of a text is hashed and joined to the places in licence texts that have it. A place (text position,
template position) votes for the diagonal they lie on; a span of a template stands out as a diagonal with many votes.
Neighbouring diagonals, which a few words more or less part, are merged; a span counts if enough of its template's windows
are there, and the windows' words are compared, not their hashes alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terracell.llm.common import ascii_lower, table

K = 3
#: Diagonals this near to each other are one span; share of a template's windows that it needs.
NEAR, COVER = 4, 0.86
#: Phrases of which every consecutive place counts, with their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Notices and openings of licence texts, with their labels.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "released under the mit license"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("lgpl", "under the terms of the gnu lesser general public license"),
    ("agpl-3", "licensed under the gnu affero general public license version 3"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "released under cc by nc 4 0"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("proprietary", "all rights reserved"),
)


def _templates(spark: SparkSession, base: dict[str, str], templates: tuple[tuple[str, str], ...]) -> DataFrame:
    """A row for each window of each template; a few hundred, as given by the caller's phrases."""
    rows = [(-1, None, False, 0, -1, None, None, None)]
    for i, (label, phrase, exact) in enumerate([*((v, k, True) for k, v in base.items()), *((a, b, False) for a, b in templates)]):
        words = phrase.split()
        if len(words) < K:
            raise ValueError(f"a template needs {K} words")
        rows += [(i, label, exact, len(words) - K + 1, p, *words[p : p + K]) for p in range(len(words) - K + 1)]
    out = spark.createDataFrame(rows, "t int, label string, exact boolean, windows int, at int, a string, b string, c string")
    return out.select("t", "label", "exact", "windows", "at", F.concat_ws(" ", "a", "b", "c").alias("gram"), F.when(F.col("t") < 0, F.lit(0).cast("long")).otherwise(F.xxhash64("a", "b", "c")).alias("h"))


def spans(docs: DataFrame, base: dict[str, str] | None = None, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """Verified spans, and for each row of (doc_id, text) one with a null label.

    Columns: _row, doc_id, n_words, label, exact, first_word, last_word (start of the span's last window), score (share of
    the template's windows). Null and empty texts have no words. Rows with equal doc_ids stay apart by _row, and so do equal
    rows. Of spans that tie, all are given. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    grams = F.broadcast(_templates(spark, BASE if base is None else base, templates))  # fixed phrases
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), ascii_lower(F.coalesce(F.col("text"), F.lit(""))).alias("text"))
    rows = rows.select("_row", "doc_id", F.array_remove(F.split("text", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "").alias("words"))
    n = F.size("words")
    hashes = F.when(n < K, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n - K, F.lit(0))), lambda i: F.xxhash64(*[F.get("words", i + j) for j in range(K)])))
    # place 0 stands for the document itself, so that every document passes the join
    rows = rows.select("_row", "doc_id", n.cast("long").alias("n_words"), "words", F.posexplode(F.concat(F.array(F.lit(0).cast("long")), hashes)).alias("pos", "h"))
    same = F.array_join(F.slice("words", F.greatest("pos", F.lit(1)), K), " ") == F.col("gram")
    hits = rows.join(grams, "h").where(F.when(F.col("t") < 0, F.col("pos") == 0).otherwise((F.col("pos") > 0) & same))
    diagonals = hits.withColumn("pos", F.col("pos").cast("long") - 1).groupBy("_row", "doc_id", "n_words", "t", "label", "exact", "windows", (F.col("pos") - F.col("at")).alias("diagonal"))
    diagonals = diagonals.agg(F.collect_set("at").alias("ats"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    order = W.partitionBy("_row", "t").orderBy("diagonal")
    apart = F.col("exact") | F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > NEAR, F.lit(True))
    merged = diagonals.withColumn("_new", apart.cast("int")).withColumn("_span", F.sum("_new").over(order))
    merged = merged.groupBy("_row", "doc_id", "n_words", "t", "label", "exact", "windows", "_span").agg(F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("seen"), F.max(F.size("ats")).alias("most"), F.min("lo").alias("first_word"), F.max("hi").alias("last_word"))
    score = F.when(F.col("windows") > 0, F.col("seen") / F.col("windows")).otherwise(0.0)
    # repeats of a short template merge to a wide span; one diagonal with enough windows is a place by itself
    near = (F.col("last_word") - F.col("first_word") < 2 * F.col("windows")) | (F.col("most") >= COVER * F.col("windows"))
    fine = F.col("label").isNull() | F.when(F.col("exact"), score == 1).otherwise((score >= COVER) & near)
    return merged.withColumn("score", score).where(fine).select("_row", "doc_id", "n_words", "label", "exact", "first_word", "last_word", "score")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: places of the base phrases, labels, and the best span's share of its template."""
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    base = F.col("exact") & F.col("label").isNotNull()
    out = spans(table(spark, sf_dir, "documents")).groupBy("_row").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        F.sum(base.cast("long")).alias("n_base"),
        F.min(F.when(base, F.col("first_word"))).alias("first_word"),
        F.max(F.when(base, F.col("first_word"))).alias("last_word"),
        joined(F.when(base, F.col("label"))).alias("base_labels"),
        joined("label").alias("labels"),
        F.max("score").alias("score"),
    )
    return out.drop("_row")
