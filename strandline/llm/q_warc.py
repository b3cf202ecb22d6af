"""Query of operator 2 over ``pages``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import scratch, table
from strandline.llm.warc import restore, write_archive


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "archive")
    write_archive(table(spark, sf_dir, "pages"), path)
    restored = restore(spark, path)
    return restored.select(
        F.col("record_id").alias("page_id"), "payload_bytes", F.col("payload_sha1").alias("payload_digest"), "record_type", "refers_to"
    )


QUERIES = {"op2_warc": op2_warc}
ORACLES = {
    "op2_warc": """
WITH p AS (
    SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
    SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS first_id FROM p
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM f
"""
}
