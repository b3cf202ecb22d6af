"""Query of operator 13 over ``embeddings``, and the same rounds in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandline.llm.common import table
from strandline.llm.vector_codes import encode


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "embeddings"))


def oracle(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Each round as two common table expressions: nearest entries of all parts, and the entries' new components."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""far{k} AS MATERIALIZED (
    SELECT r, x.part, entry, sum((v - c) * (v - c)) AS far FROM x JOIN book{k} b ON x.part = b.part AND x.pos = b.pos GROUP BY ALL
), near{k} AS MATERIALIZED (
    SELECT r, part, min(entry) AS entry, any_value(far) AS far FROM far{k} JOIN (SELECT r, part, min(far) AS far FROM far{k} GROUP BY ALL) USING (r, part, far) GROUP BY r, part
)""")
        if k < rounds:
            steps.append(f"""mean{k} AS (
    SELECT part, entry, pos, sum(v) AS s, count(*) AS n FROM near{k} JOIN x USING (r, part) GROUP BY ALL
), book{k + 1} AS MATERIALIZED (
    SELECT part, entry, pos, CASE WHEN n IS NULL THEN c ELSE (s - ((s % n) + n) % n) // n END AS c FROM book{k} LEFT JOIN mean{k} USING (part, entry, pos)
)""")
    return f"""
WITH kept AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, embedding FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
), x AS MATERIALIZED (
    SELECT r, (i - 1) // (len(embedding) // {parts}) AS part, (i - 1) % (len(embedding) // {parts}) AS pos, floor(1024 * embedding[i]::DOUBLE)::HUGEINT AS v
    FROM (SELECT r, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM kept)
), book0 AS (SELECT part, r - 1 AS entry, pos, v AS c FROM x WHERE r <= {entries}),
{", ".join(steps)},
coded AS (
    SELECT r, string_agg(printf('%02x', entry::BIGINT), '' ORDER BY part) AS code, sum(far)::BIGINT AS error FROM near{rounds} GROUP BY r
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY part, entry, pos)) FROM book{rounds}) AS codebooks_sha256
FROM coded JOIN kept USING (r)
"""


QUERIES = {"op13_vector_codes": op13_vector_codes}
ORACLES = {"op13_vector_codes": oracle()}
