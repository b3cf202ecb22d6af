"""Genomic text formats: GTF, BED, FASTA and id lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.genome import stranded_coordinates

#: Attributes of a GTF line: key, blank, quoted value.
ATTRIBUTE = r'(\S+) "([^"]+)"'


def attributes(text: Column) -> Column:
    """Attributes as a map; of a repeated key the last value counts."""
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(ATTRIBUTE), F.lit(1)).alias("k"), F.regexp_extract_all(text, F.lit(ATTRIBUTE), F.lit(2)).alias("v"))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def parse_gtf(lines: DataFrame) -> DataFrame:
    """Rows of text lines (``value``): the nine columns and the attribute map; comments and short lines are left out."""
    parts = F.split("value", "\t")
    rows = lines.filter(~F.col("value").startswith("#")).select("value", parts.alias("_p")).filter(F.size("_p") >= 9)
    names = ("chrom", "source", "feature", "start_pos", "end_pos", "score", "strand", "frame", "attributes")
    rows = rows.select(*(F.col("_p")[i].alias(n) for i, n in enumerate(names)), "value")
    return rows.withColumns({"start_pos": F.col("start_pos").try_cast("long"), "end_pos": F.col("end_pos").try_cast("long"), "attrs": attributes(F.col("attributes"))})


def read_gtf(spark: SparkSession, path: str) -> DataFrame:
    return parse_gtf(spark.read.text(path)).drop("value")


def gtf_line(columns: dict[str, Column], attrs: list[tuple[str, Column]]) -> Column:
    """A GTF line; null attributes are left out."""
    text = F.concat_ws("; ", *(F.concat(F.lit(f'{k} "'), v, F.lit('"')) for k, v in attrs))
    names = ("chrom", "source", "feature", "start_pos", "end_pos", "score", "strand", "frame")
    return F.concat_ws("\t", *(F.coalesce(columns[n].cast("string"), F.lit(".")) if n in columns else F.lit(".") for n in names), text)


def gtf_subset(lines: DataFrame, novel: str, ids: DataFrame, keep_others: bool) -> DataFrame:
    """Lines of the novel source whose gene is among the ids; with ``keep_others`` all lines of other sources too. Comments go."""
    rows = parse_gtf(lines).withColumn("gene_id", F.col("attrs")["gene_id"])
    is_novel = F.col("source") == novel
    chosen = rows.filter(is_novel).join(ids.select("gene_id").distinct(), "gene_id", "left_semi").select("value")
    return chosen.unionByName(rows.filter(~is_novel).select("value")) if keep_others else chosen


def to_bed(df: DataFrame, name: str = "gene_symbol") -> DataFrame:
    """Six BED columns from coordinates in an identifier; rows without are left out. Starts count from zero."""
    at = stranded_coordinates(F.col(name))
    return df.select(at.alias("_at"), F.col(name).alias("name")).filter(F.col("_at").isNotNull()).select(
        F.col("_at.chrom").alias("chrom"), (F.col("_at.start") - 1).alias("start_pos"), F.col("_at.end").alias("end_pos"), "name", F.lit("0").alias("score"), F.col("_at.strand").alias("strand")
    )


def write_bed(bed: DataFrame, path: str) -> None:
    bed.write.option("sep", "\t").csv(path)


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("chrom string, start_pos long, end_pos long, name string, score string, strand string").option("sep", "\t").csv(path)


def fasta(header: Column, sequence: Column, width: int | None = None) -> Column:
    """A FASTA record; lines of a width, if given."""
    body = F.trim(sequence)
    if width:
        body = F.regexp_replace(F.regexp_replace(body, f"(.{{{width}}})", "$1\n"), "\n$", "")
    return F.concat(F.lit(">"), header, F.lit("\n"), body)


def named_fasta(df: DataFrame, status: str) -> DataFrame:
    """Records under ``id|gene|database|status``; a null part is ``nan``."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in ("gene_id", "gene_name", "database", status)]
    return df.select(fasta(F.concat_ws("|", *parts), F.col("sequence")).alias("value"))


def view_fasta(df: DataFrame, ids: list[str], gene: str) -> DataFrame:
    """Records of 60 columns under the first id that isn't blank, with the gene where there is one; blank sequences are left out."""
    first = F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in ids), F.lit("smORF"))
    header = F.concat(first, F.coalesce(F.concat(F.lit("|"), F.nullif(F.col(gene), F.lit(""))), F.lit("")))
    return df.filter(F.coalesce(F.col("sequence"), F.lit("")) != "").select(fasta(header, F.col("sequence"), 60).alias("value"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """``header`` and ``sequence`` of all records."""
    records = spark.read.option("lineSep", "\n>").text(path).filter(F.trim("value") != "")
    text = F.regexp_replace("value", "^>", "")
    return records.select(F.substring_index(text, "\n", 1).alias("header"), F.regexp_replace(F.regexp_replace(text, "^[^\n]*\n?", ""), "\\s", "").alias("sequence"))


def id_list(df: DataFrame, column: str) -> DataFrame:
    """Different ids without quotes and blanks around."""
    return df.select(F.trim(F.regexp_replace(F.col(column), "[\"']", "")).alias("value")).dropna().distinct()


def coordinate_map(df: DataFrame) -> DataFrame:
    return df.select("genomic_coordinates", "sequence").dropna().distinct()
