"""Query of operator 3 over ``documents`` and ``labels``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import table
from strandline.llm.quality_model import fit, score

#: Most labelled rows that the trees are fitted on.
MAX_ROWS = 20_000


def held_out(key: Column) -> Column:
    """Rows that no model may learn from; a null key is none of them."""
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


def op3_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(documents, table(spark, sf_dir, "labels"), ~held_out(F.col("key")), max_rows=MAX_ROWS)
    return score(documents, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


QUERIES = {"op3_quality_model": op3_quality_model}
ORACLES: dict[str, str] = {}
