"""What the operators of this package share: tables, shared storage and distributed ordering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.sources.storage import Latest, Shelf, materialize, scratch, shared_dir

__all__ = ["Latest", "Shelf", "WORD", "fresh", "materialize", "ordered_positions", "scratch", "shared_dir", "table"]

#: A word: a longest run of characters other than the ASCII blanks. ``bytes.split()`` cuts at the same places.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """For each wanted column name one that the DataFrame doesn't have."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def ordered_positions(df: DataFrame, order: list[str | Column], weight: str | None = None, name: str = "positions", keep: list[str] | None = None) -> DataFrame:
    """Adds ``pos`` (0-based place in the total order) and, with a weight, ``before`` (sum of the weights of the rows before).

    With ``keep`` only those columns stay once the rows are in order.

    Rows are dealt by ranges of the order and stored; each range gets its offset from a window over one row per
    range, so that no task sees more than one range. Rows with equal keys get places in any order.
    """
    spark = df.sparkSession
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = ranged.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id() - F.shiftleft(F.col("_part").cast("long"), 33))
    ranged = ranged.select(*keep, "_part", "_row") if keep else ranged
    ranged = materialize(ranged, name)
    mass = F.col(weight) if weight else F.lit(0)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("_part").agg(F.count("*").alias("_n"), F.sum(mass).alias("_w"))
    offsets = offsets.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_w").over(before), F.lit(0)).alias("_w0"))
    # one row per range: as small as the number of partitions
    out = ranged.join(F.broadcast(offsets), "_part").withColumn("pos", F.col("_n0") + F.col("_row"))
    if weight:
        inside = Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumn("before", F.col("_w0") + F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    return out.drop("_part", "_row", "_n0", "_w0")
