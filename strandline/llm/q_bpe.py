"""Query of operator 5 over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandline.llm.bpe import round_trip
from strandline.llm.common import table


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), vocabulary_path())


QUERIES = {"op5_bpe": op5_bpe}
ORACLES: dict[str, str] = {}
