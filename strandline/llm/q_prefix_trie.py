"""Query of operator 12 over ``conversations`` rebuilt so that they share first turns, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import table
from strandline.llm.prefix_trie import ordered_turns, trie

#: Conversations that share the first turns of the one that is divisible by it; the borrowed turns are fewer than MOST.
FAMILY, MOST = 20, 4


def rebuilt(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each conversation c with the first turns, crc32(c) modulo MOST of them, of its family's first conversation instead of as many of its own.

    The remainder c % FAMILY has the sign of c. Borrowed turns are at most MOST - 1 from a conversation, for fewer than 2 * FAMILY others.
    """
    firsts = convs.select(F.col("conv").alias("lender"), F.col("n").alias("lent"))
    told = convs.withColumns({"lender": F.col("conv") - F.col("conv") % FAMILY, "h": F.crc32(F.col("conv").cast("string").cast("binary")) % MOST})
    told = told.join(firsts, "lender", "left").withColumn("k", F.least("h", F.coalesce("lent", F.lit(0))))
    told = told.select("conv", "lender", "h", "k", (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n"))
    own = turns.join(told, "conv").filter("i >= h").select("conv", (F.col("i") - F.col("h") + F.col("k")).alias("i"), "digest", "words")
    heads = turns.filter(F.col("i") < MOST - 1).withColumnRenamed("conv", "lender")
    taken = heads.join(told, "lender").filter("i < k").select("conv", "i", "digest", "words")
    return own.unionByName(taken), told.select("conv", "n")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(*rebuilt(*ordered_turns(table(spark, sf_dir, "conversations"))))


QUERIES = {"op12_prefix_trie": op12_prefix_trie}
ORACLES = {
    "op12_prefix_trie": r"""
WITH t AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i
    FROM conversations WHERE conv_id IS NOT NULL
), crc AS (
    SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, b)) AS step
), c AS (
    SELECT a.conv_id, a.conv_id - a.conv_id % 20 AS lender, n,
           xor(list_reduce(list_transform(string_split(a.conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT), lambda v, b: xor(v >> 8, step[(xor(v, b) & 255) + 1]), 4294967295), 4294967295) % 4 AS h
    FROM (SELECT conv_id, count(*) AS n FROM t GROUP BY ALL) a, crc
), told AS (
    SELECT c.*, least(c.h, coalesce(l.n, 0)) AS k FROM c LEFT JOIN c l ON l.conv_id = c.lender
), r AS (
    SELECT told.conv_id, i - h + k AS i, role, text FROM t JOIN told USING (conv_id) WHERE i >= h
    UNION ALL SELECT told.conv_id, i, role, text FROM told JOIN t ON t.conv_id = told.lender WHERE i < k
), keyed AS (
    SELECT conv_id, i, text, md5(string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER (PARTITION BY conv_id ORDER BY i)) AS key FROM r
), m AS MATERIALIZED (
    SELECT conv_id, i + 1 AS depth, key, lag(key, 1, '') OVER (PARTITION BY conv_id ORDER BY i) AS parent, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM keyed
    UNION ALL SELECT conv_id, 0, '', NULL, 0 FROM told
), nodes AS MATERIALIZED (
    SELECT key, depth, min(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(words) AS saved FROM m GROUP BY key, depth
), counted AS MATERIALIZED (
    SELECT n.*, coalesce(n_children, 0) AS n_children, p.conv_id AS parent_conv_id
    FROM nodes n LEFT JOIN (SELECT parent AS key, count(*) AS n_children FROM nodes GROUP BY ALL) USING (key) LEFT JOIN nodes p ON p.key = n.parent
), subtree AS (
    SELECT m.key, sum((n_children = 0)::BIGINT) AS n_leaves, sum(saved) AS saved_tokens FROM counted v JOIN m ON m.conv_id = v.conv_id AND m.depth <= v.depth GROUP BY m.key
), ends AS (
    SELECT key, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids
    FROM (SELECT conv_id, arg_max(key, depth) AS key FROM m GROUP BY conv_id) GROUP BY key
)
SELECT conv_id, depth::BIGINT AS depth, parent_conv_id, n_convs::BIGINT AS n_convs, n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves,
       saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM counted JOIN subtree USING (key) LEFT JOIN ends USING (key)
"""
}
