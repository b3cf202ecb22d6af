"""Query of operator 8 over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandline.llm.common import table
from strandline.llm.minhash import fingerprint_edits


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))


QUERIES = {"op8_minhash": op8_minhash}
ORACLES: dict[str, str] = {}
