"""Queries over the corpus tables, one for each operator, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terracell.llm import decontaminate, neardup, quality
from terracell.llm.decontaminate import op10_benchmark_decontamination
from terracell.llm.langid import op7_language_id
from terracell.llm.licenses import op3_license_scan
from terracell.llm.neardup import op9_minhash_near_dedup
from terracell.llm.packing import op8_best_fit_packing
from terracell.llm.pii import op2_pii
from terracell.llm.quality import op1_quality_rules
from terracell.llm.tokenstore import op5_content_addressed_store
from terracell.llm.toxicity import op4_toxicity
from terracell.llm.warc import op6_arc_to_warc

_ALL = (op1_quality_rules, op2_pii, op3_license_scan, op4_toxicity, op5_content_addressed_store, op6_arc_to_warc, op7_language_id, op8_best_fit_packing, op9_minhash_near_dedup, op10_benchmark_decontamination)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": quality.ORACLE, "op9_minhash_near_dedup": neardup.ORACLE, "op10_benchmark_decontamination": decontaminate.ORACLE}
