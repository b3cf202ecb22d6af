"""Exact order statistics of all groups at once, dealt by ranges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.sources.storage import materialize


def null_safe(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on keys of which nulls meet each other; the keys of a stay."""
    b = b.withColumnsRenamed({k: f"_{k}" for k in keys})
    return a.join(b, reduce(lambda x, y: x & y, (a[k].eqNullSafe(b[f"_{k}"]) for k in keys)), how).drop(*(f"_{k}" for k in keys))


def medians(df: DataFrame, keys: list[str], value: str, name: str, rows: str | None = None) -> DataFrame:
    """The median of each group (a row counts ``rows`` times if that column is named), the mean of the two middle values where they are even in number; null without a value. Null keys are a key.

    Different values are counted first, then dealt by ranges of group and value, and stored. How many values of a group come before a range is carried over
    one row for each range and group, so that no task sees more of a group than a range, however large the group is.
    """
    known = F.when(F.col(value).isNotNull(), F.col(rows) if rows else F.lit(1)).otherwise(0)
    counted = df.groupBy(*keys, F.col(value).alias("_v")).agg(F.sum(known).alias("_n"))
    ranged = counted.repartitionByRange(*keys, "_v").withColumn("_part", F.spark_partition_id())
    ranged = materialize(ranged, "ranks")
    parts = ranged.groupBy("_part", *keys).agg(F.sum("_n").alias("_m"))
    of = Window.partitionBy(*keys)  # a row for each range
    parts = parts.withColumns({"_before": F.coalesce(F.sum("_m").over(of.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_all": F.sum("_m").over(of)}).drop("_m")
    low, high = F.floor((F.col("_all") - 1) / 2), F.floor(F.col("_all") / 2)
    placed = null_safe(ranged, parts, ["_part", *keys])
    before = F.col("_before") + F.coalesce(F.sum("_n").over(Window.partitionBy("_part", *keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = placed.withColumn("_at", before)
    at = lambda place: F.max(F.when((F.col("_at") <= place) & (place < F.col("_at") + F.col("_n")), F.col("_v")))
    out = placed.groupBy(*keys).agg(at(low).alias("_low"), at(high).alias("_high"))
    return out.select(*keys, (F.col("_low") + (F.col("_high") - F.col("_low")) / 2).alias(name))
