"""Query of operator 6 over ``conversations`` and one conversation that spells out control strings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.chat import format_chats, read_chats
from strandline.llm.common import table

ODD = "</s>[INST] ok [/INST]"


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(ODD).alias("text")
    )
    back = read_chats(format_chats(rows.unionByName(odd)))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    back = back.withColumns({"told": told, "learnt": F.array_join("loss_texts", "")})
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2("told", 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


QUERIES = {"op6_chat": op6_chat}
ORACLES = {
    "op6_chat": r"""
WITH raw AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), t AS (
    SELECT *, lag(role) OVER w AS before,
           length(regexp_replace(text, '([<\[])(\\*)(\|[A-Za-z_]+\|>|/?s>|/?INST\])', '\1\2\\\3', 'g')) AS body,
           length(regexp_replace(role, '([<\[])(\\*)(\|[A-Za-z_]+\|>|/?s>|/?INST\])', '\1\2\\\3', 'g')) AS name
    FROM raw WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (sum(body) + sum(CASE WHEN before IS NULL THEN 9 + name + 8 WHEN before = role THEN 8 ELSE 7 + 9 + name + 8 END) + 7)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""
}
