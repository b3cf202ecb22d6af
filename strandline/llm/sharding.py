"""Sharding along a Hilbert curve over quantised metadata, so that a shard covers a small box of languages, sources and sizes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from strandline.llm.common import materialize, ordered_positions

#: Bits of each dimension.
BITS = 4


def hilbert_index(axes: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of each row of integer coordinates below ``2**bits`` (rows by dimensions).

    From the highest bit down, each coordinate's bit says whether the lower bits of the first coordinate are inverted or
    swapped with its own; the Gray code of what results, read bit by bit across the dimensions, is the index.
    """
    x = axes.astype(np.int64).T.copy()
    n = len(x)
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for i in range(n):
            turned = (x[i] >> level & 1).astype(bool)
            swap = np.where(turned, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(turned, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(x[n - 1] >> level & 1, (1 << level) - 1, 0)
    x ^= flip
    index = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            index = index << 1 | x[i] >> level & 1
    return index


@F.pandas_udf(LongType())
def _curve(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
    return pd.Series(hilbert_index(np.stack([a.to_numpy(), b.to_numpy(), c.to_numpy()], 1)))


def _levels(df: DataFrame, column: str, rows: str, total: int) -> DataFrame:
    """For each value of a column its level: the share of all rows before it in the order of the values, in 2**BITS steps."""
    values = df.groupBy(column).agg(F.sum(rows).alias("_rows"))
    placed = ordered_positions(values, [F.col(column).asc_nulls_last()], "_rows", f"levels-{column}")
    level = F.least(F.floor((F.col("before") + F.col("_rows") / 2) * (1 << BITS) / max(1, total)), F.lit((1 << BITS) - 1)).cast("int")
    return placed.select(F.col(column).alias("_value"), level.alias(f"_{column}_level"))


def assign(df: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``doc_id``, ``size`` (UTF-8 bytes plus 1), ``text_crc32``, ``curve``, ``shard`` and ``slot`` (gapless place in the shard) of every row.

    Equal texts are one group and share a shard; their metadata are those of the smallest key. Groups follow each other by the
    curve's index over language and source (levels of equal numbers of rows) and size (powers of two); shards are runs of
    about equal bytes: a group belongs to the shard that its middle byte falls into, so that a shard misses its share by less
    than one group. A group above a shard's share gets a shard of its own, and the rest share the others. A null text has
    size 1, and nulls are equal to each other and to empty texts; null metadata come last; repeated rows stay and get slots of
    their own; an empty table gives no rows. Nothing but one row for each oversized group, fewer than the shards, goes through
    the driver.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
        F.unhex(F.sha2(body, 256)).alias("content"),
        F.col(lang).alias("lang"),
        F.col(source).alias("source"),
    )
    rows = materialize(rows, "shard-rows")
    groups = rows.groupBy("content").agg(
        F.count("*").alias("n"), F.sum("size").alias("bytes"), F.max("size").alias("size"), F.min(F.struct("doc_id", "lang", "source")).alias("first")
    )
    groups = materialize(groups.select("content", "n", "bytes", "size", F.col("first.lang").alias("lang"), F.col("first.source").alias("source")), "shard-groups")
    whole = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    log_size = F.least(F.floor(F.log2(F.col("size").cast("double"))), F.lit((1 << BITS) - 1)).cast("int")
    placed = groups
    for column in ("lang", "source"):
        levels = _levels(groups, column, "n", whole["n"])
        placed = placed.join(levels, placed[column].eqNullSafe(levels["_value"])).drop("_value")
    placed = placed.select("content", "n", "bytes", _curve("_lang_level", "_source_level", log_size).alias("curve"))
    # at most shards - 1 groups are above a shard's share
    large = [r["content"] for r in placed.filter(F.col("bytes") * shards > whole["bytes"]).orderBy(F.desc("bytes"), "content").limit(shards - 1).select("content").collect()]
    is_large = F.col("content").isin([bytes(c) for c in large]) if large else F.lit(False)
    placed = ordered_positions(placed.withColumn("small", ~is_large), ["small", "curve", "content"], "bytes", "shard-order")
    ahead = int(placed.filter(~F.col("small")).agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]) if large else 0
    left, rest = shards - len(large), max(1, whole["bytes"] - ahead)
    run = F.least(F.floor((F.col("before") - ahead + F.col("bytes") / 2) * left / rest), F.lit(left - 1)) + len(large)
    placed = placed.select("content", "small", "curve", "pos", F.when(F.col("small"), run).otherwise(F.col("pos")).cast("int").alias("shard"))
    ordered = ordered_positions(rows.join(placed.drop("pos"), "content"), ["shard", "curve", "content", "doc_id"], name="shard-slots")
    starts = ordered.groupBy("shard").agg(F.min("pos").alias("start"))  # a row for each shard
    ordered = ordered.join(F.broadcast(starts), "shard")
    return ordered.select("doc_id", "size", "text_crc32", "curve", "shard", (F.col("pos") - F.col("start")).alias("slot"))


def write_shards(df: DataFrame, assigned: DataFrame, path: str, key: str = "doc_id") -> None:
    """Writes the rows as Parquet, a folder for each shard, sorted by slot: readers prune shards by partition and files by statistics.

    Keys have to be unique; rows without a key are not written. Large shards are spread over several files, each a run of slots. Input columns
    named ``shard`` or ``slot`` are replaced; an empty table writes no files.
    """
    per_file = 100_000
    rows = df.select(*[c for c in df.columns if c.lower() not in {"shard", "slot"}])
    joined = rows.join(assigned.select(F.col("doc_id").alias(key), "shard", "slot"), key)
    joined = joined.repartition("shard", F.floor(F.col("slot") / per_file)).sortWithinPartitions("shard", "slot")
    joined.write.partitionBy("shard").parquet(path)


