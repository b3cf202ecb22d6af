"""Evidence rules over the table of candidate proteins: filters, flags, the gate, and the summaries cut from it.

Rows have the snake-case columns of the evidence table (``sequence``, ``database``, ``smorf_type``, ``ribocode`` and so on).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.lists import decode_list
from strandline.functions.predicates import contains_any, is_in, is_true, matches

# Labels and patterns as they stand in the data.
CONTAMINANTS = "SHEEP|Peptide|Horse|BOVIN"
DATABASES = "TrEMBL|Salk|Swiss-Prot"
NOVEL, REVIEWED, TREMBL = "Salk", "Swiss-Prot-MP", "TrEMBL"
SECRETED_LABELS = ("SAM-Secreted", "SAM-Intracellular")
TIERS = ("Strong", "Moderate", "Weak", "Insufficient")
MOST_Q = 0.01


def reject_contaminants(df: DataFrame, column: str = "gene_symbol", pattern: str = CONTAMINANTS) -> DataFrame:
    return df.filter(~matches(F.col(column), pattern, ignore_case=True))


def keep_databases(df: DataFrame, pattern: str = DATABASES) -> DataFrame:
    return df.filter(F.col("database").rlike(pattern))


def remap_labels(df: DataFrame) -> DataFrame:
    """TrEMBL rows get the type TrEMBL, then count as novel; plain Swiss-Prot rows count as its microproteins."""
    kind = F.when(F.col("database") == TREMBL, TREMBL).otherwise(F.col("smorf_type"))
    label = F.when(F.col("database") == TREMBL, NOVEL).when(F.col("database") == "Swiss-Prot", REVIEWED).otherwise(F.col("database"))
    return df.withColumns({"smorf_type": kind, "database": label})


def remap_for_joins(df: DataFrame) -> DataFrame:
    label = F.when(F.col("database") == NOVEL, "Unreviewed").when(F.col("database") == REVIEWED, "Swiss-Prot").otherwise(F.col("database"))
    return df.withColumn("database", label)


def ribo_flags(df: DataFrame) -> DataFrame:
    """``has_ribo_sam`` and ``has_loose_ribo_sam``: null where the ribosome call is null and nothing else says no."""
    labelled = F.col("ribocode") & is_in(F.col("shortstop_label"), SECRETED_LABELS)
    strict = labelled & ~is_in(F.col("smorf_type"), ("oORF",)) & ~matches(F.col("smorf_type"), "iso", ignore_case=True)
    return df.withColumns({"has_ribo_sam": strict, "has_loose_ribo_sam": labelled & ~is_in(F.col("smorf_type"), ("Iso",))})


def ms_flags(df: DataFrame, most_q: float = MOST_Q) -> DataFrame:
    """``dda_evidence``, ``dia_evidence`` and ``has_ms``, in three-valued logic; needs the flags of :func:`ribo_flags`."""
    q = F.col("global_pg_q_value")
    dda = F.col("total_unique_spectral_counts") > 0
    dia = F.col("has_loose_ribo_sam") & q.isNotNull() & (q <= most_q) & (F.col("proteotypic") == 1)
    return df.withColumns({"dda_evidence": dda, "dia_evidence": dia}).withColumn("has_ms", F.col("dda_evidence") | F.col("dia_evidence"))


def first_per_sequence(df: DataFrame, order: list[Column], key: str = "sequence") -> DataFrame:
    """The first row of each key; rows with a null key are one key."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.filter("_rank = 1").drop("_rank")


def evidence_gate(df: DataFrame, row_id: str = "row_id", reviewed_need_evidence: bool = False) -> DataFrame:
    """The microproteins that count: clean, labelled, flagged, of the class, with evidence where it is asked for, one row per sequence and database.

    Novel rows need one kind of evidence, reviewed ones only if asked. Of a sequence's rows the one with mass-spectrometry evidence comes first
    (null last), then the smaller row id. Both groups go through one window, so the table is shuffled once.
    """
    flagged = ms_flags(ribo_flags(remap_labels(keep_databases(reject_contaminants(df)))))
    evidence = F.col("has_ribo_sam") | F.col("dda_evidence") | F.col("dia_evidence")
    reviewed = (F.col("database") == REVIEWED) & (evidence if reviewed_need_evidence else F.lit(True))
    kept = flagged.filter((F.col("protein_class_length") == "Microprotein") & (reviewed | (F.col("database") == NOVEL) & evidence))
    # reviewed rows keep the order of the input
    novel_first = F.when(F.col("database") == NOVEL, F.col("has_ms"))
    ranked = kept.withColumn("_rank", F.row_number().over(Window.partitionBy("sequence", "database").orderBy(novel_first.desc_nulls_last(), row_id)))
    return ranked.filter("_rank = 1").drop("_rank")


def annotation_status(df: DataFrame) -> DataFrame:
    return df.withColumn("annotation_status", F.when(F.col("has_ms"), "MS").when(~F.col("has_ms"), "RiboCode_SAM"))


def ms_type(df: DataFrame) -> DataFrame:
    dda, dia = is_true(F.col("dda_evidence")), is_true(F.col("dia_evidence"))
    return df.withColumn("ms_type", F.when(dda & dia, "DDA+DIA").when(dda, "DDA only").when(dia, "DIA only").otherwise("No MS"))


def best_tier(text: Column) -> Column:
    """Best confidence tier in a list written as text; null without one."""
    known = F.lit(list(TIERS))
    ranks = F.transform(F.filter(decode_list(text), lambda x: F.array_contains(known, x)), lambda x: F.array_position(known, x))
    return F.when(F.trim(text).startswith("["), F.get(known, (F.array_min(ranks) - 1).cast("int")))


def graded(df: DataFrame) -> DataFrame:
    """``dda_grade``: the best tier, or why there is none."""
    missing = F.when(F.col("annotation_status") == "RiboCode_SAM", "No MS").when(F.col("annotation_status") == "MS", "No PROSIT")
    return df.withColumn("dda_grade", F.coalesce(best_tier(F.col("confidence")), missing))


def projected(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """The named columns under their new names, in that order."""
    return df.select(*(F.col(old).alias(new) for old, new in names.items()))


# Columns of the summaries and their published names.
DISCOVERY = {
    "sequence": "Microprotein Sequence", "genomic_coordinates": "smORF Coordinates", "smorf_type": "smORF Class", "gene_name": "Parent Gene",
    "protein_length": "Microprotein Length", "annotation_status": "Annotation Status", "ms_type": "MS Evidence Type", "dda_grade": "DDA Grade", "mean_phylocsf": "PhyloCSF Score",
}
CLASSIFIER = {
    "sequence": "Microprotein Sequence", "gene_symbol": "smORF ID", "gene_name": "Gene Body (Name)", "smorf_type": "smORF Class", "shortstop_label": "ShortStop Label",
    "shortstop_score": "ShortStop Score", "annotation_status": "Annotation Status", "mean_phylocsf": "PhyloCSF Score",
}
RIBO_COLUMNS = (
    "sequence", "rp3_default", "rp3_mm_amb", "rp3_amb", "rp3_mm", "ribocode", "database", "gene_name", "gene_symbol", "protein_length", "start_codon", "smorf_type",
    "total_unique_spectral_counts", "total_razor_spectral_counts", "mean_phylocsf",
)


def discovery_summary(gated: DataFrame) -> DataFrame:
    """Novel microproteins with status, evidence type and grade; those that begin with M first."""
    rows = graded(ms_type(annotation_status(gated.filter(F.col("database") == NOVEL))))
    return projected(rows.orderBy(F.col("sequence").startswith("M").desc(), "sequence"), DISCOVERY)


def classifier_summary(gated: DataFrame) -> DataFrame:
    rows = annotation_status(gated.filter((F.col("database") == NOVEL) & F.col("shortstop_label").isNotNull()))
    return projected(rows, CLASSIFIER)


def ribo_summary(gated: DataFrame) -> DataFrame:
    return gated.filter(F.col("database").isin(NOVEL, REVIEWED)).select(*RIBO_COLUMNS)


def pseudogene_subset(summary: DataFrame) -> DataFrame:
    return summary.filter((F.col("total_unique_spectral_counts") > 0) & (F.col("smorf_type") == "psORF"))


def long_read_summary(gated: DataFrame, base_mean: str = "nanopore_basemean") -> DataFrame:
    kept = gated.filter((F.col("database") == NOVEL) | F.col(base_mean).isNotNull())
    return kept.select("sequence", base_mean, "database", "gene_name", "gene_symbol", "protein_length", "start_codon", "smorf_type", "total_razor_spectral_counts", "total_unique_spectral_counts")


def review_status(database: Column) -> Column:
    text = F.trim(database)
    return F.when(contains_any(text, ("Swiss-Prot",)), "Reviewed").when(contains_any(text, (NOVEL, TREMBL, "Unreviewed")), "Unreviewed").otherwise("Unknown")


def with_base_mean(df: DataFrame, column: str = "nanopore_basemean") -> DataFrame:
    """Drops rows whose mean is missing, blank or zero."""
    return df.filter(F.col(column).isNotNull() & (F.trim(F.col(column).cast("string")) != "") & (F.col(column).try_cast("double") != 0))
