"""Spectral libraries as MSP text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.predicates import pinned

LEAST_INTENSITY, TOP = 1e-4, 10_000.0


def normal_peaks(peaks: Column) -> Column:
    """Peaks with an m/z and an intensity above the least, scaled to a maximum of 10 000, by rising m/z."""
    good = F.filter(peaks, lambda p: (p["mz"] > 0) & ~F.isnan(p["intensity"]) & (p["intensity"] > LEAST_INTENSITY))
    most = F.array_max(F.transform(good, lambda p: p["intensity"]))
    return F.array_sort(F.transform(good, lambda p: F.struct(p["mz"].alias("mz"), (p["intensity"] / most * TOP).alias("intensity"), p["annotation"].alias("annotation"))))


def to_msp(df: DataFrame, comment: str = "") -> DataFrame:
    """A text record for each spectrum (``name``, ``peaks``) that has a peak left."""
    kept = pinned(df.select("name", "peaks"), {"peaks": normal_peaks(F.col("peaks"))}).filter(F.size("peaks") > 0)
    lines = F.transform("peaks", lambda p: F.format_string('%.4f\t%.1f\t"%s"', p["mz"], p["intensity"], p["annotation"]))
    head = F.concat(F.lit("Name: "), F.col("name"), F.lit(f"\nComment: {comment}\nNum Peaks: "), F.size("peaks").cast("string"), F.lit("\n"))
    return kept.select(F.concat(head, F.array_join(lines, "\n")).alias("value"))


def write_msp(records: DataFrame, path: str) -> None:
    records.write.option("lineSep", "\n\n").text(path)


def read_msp(spark: SparkSession, path: str) -> DataFrame:
    """``name`` and ``peaks`` of all records; lines that aren't peaks are left out."""
    rows = spark.read.option("lineSep", "\n\n").text(path).filter(F.col("value").contains("Name:"))
    parts = F.filter(F.transform(F.split("value", "\n"), lambda x: F.split(x, "\t")), lambda p: (F.size(p) >= 2) & p[0].try_cast("double").isNotNull())
    peak = lambda p: F.struct(p[0].cast("double").alias("mz"), p[1].try_cast("double").alias("intensity"), F.regexp_replace(F.coalesce(F.get(p, F.lit(2)), F.lit("")), '^"|"$', "").alias("annotation"))
    return rows.select(F.trim(F.regexp_extract("value", r"Name:([^\n]*)", 1)).alias("name"), F.transform(parts, peak).alias("peaks")).filter(F.size("peaks") > 0)
