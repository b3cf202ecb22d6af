"""Query of operator 1 over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandline.llm.common import table
from strandline.llm.mixing import mix


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


QUERIES = {"op1_mixing": op1_mixing}
ORACLES: dict[str, str] = {}
