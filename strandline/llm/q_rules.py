"""Query of operator 10 over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandline.llm.common import table
from strandline.llm.rules import judge


def op10_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents"), keep_all=("doc_id",))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


QUERIES = {"op10_rules": op10_rules}
ORACLES: dict[str, str] = {}
