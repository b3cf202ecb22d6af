"""Queries of the evidence rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import evidence as ev
from strandline.plans.fixtures import Book

book = Book()
QUERIES, ORACLES = book.queries, book.oracles

#: The gate in the oracles' words; other oracles select from gated.
FLAGS = """
flagged AS (
    SELECT *, ribocode AND coalesce(shortstop_label IN ('SAM-Secreted', 'SAM-Intracellular'), false) AND coalesce(smorf_type, '') <> 'oORF' AND NOT coalesce(regexp_matches(smorf_type, '(?i)iso'), false) AS has_ribo_sam,
        ribocode AND coalesce(shortstop_label IN ('SAM-Secreted', 'SAM-Intracellular'), false) AND coalesce(smorf_type, '') <> 'Iso' AS has_loose_ribo_sam
    FROM (
        SELECT * REPLACE (CASE WHEN database = 'TrEMBL' THEN 'TrEMBL' ELSE smorf_type END AS smorf_type,
            CASE database WHEN 'TrEMBL' THEN 'Salk' WHEN 'Swiss-Prot' THEN 'Swiss-Prot-MP' ELSE database END AS database)
        FROM v_evidence WHERE NOT coalesce(regexp_matches(gene_symbol, '(?i)SHEEP|Peptide|Horse|BOVIN'), false) AND regexp_matches(database, 'TrEMBL|Salk|Swiss-Prot')
    )
), ms AS (
    SELECT *, total_unique_spectral_counts > 0 AS dda_evidence,
        has_loose_ribo_sam AND global_pg_q_value IS NOT NULL AND global_pg_q_value <= 0.01 AND proteotypic = 1 AS dia_evidence,
        total_unique_spectral_counts > 0 OR (has_loose_ribo_sam AND global_pg_q_value IS NOT NULL AND global_pg_q_value <= 0.01 AND proteotypic = 1) AS has_ms
    FROM flagged
), gated AS (
    SELECT * EXCLUDE (rn) FROM (
        SELECT *, row_number() OVER (PARTITION BY sequence, database ORDER BY CASE WHEN database = 'Salk' THEN has_ms END DESC NULLS LAST, row_id) AS rn
        FROM ms WHERE protein_class_length = 'Microprotein' AND (database = 'Swiss-Prot-MP' OR (database = 'Salk' AND (has_ribo_sam OR dda_evidence OR dia_evidence)))
    ) WHERE rn = 1
)"""
TIER = """CASE WHEN confidence LIKE '%''Strong''%' THEN 'Strong' WHEN confidence LIKE '%''Moderate''%' THEN 'Moderate' WHEN confidence LIKE '%''Weak''%' THEN 'Weak' WHEN confidence LIKE '%''Insufficient''%' THEN 'Insufficient' END"""
STATUS = "CASE WHEN has_ms THEN 'MS' WHEN NOT has_ms THEN 'RiboCode_SAM' END"
MS_TYPE = "CASE WHEN dda_evidence AND dia_evidence THEN 'DDA+DIA' WHEN dda_evidence THEN 'DDA only' WHEN dia_evidence THEN 'DIA only' ELSE 'No MS' END"


@book.query("flt1_reject_contaminants", "v_evidence", sql="SELECT row_id, gene_symbol FROM v_evidence WHERE NOT coalesce(regexp_matches(gene_symbol, '(?i)SHEEP|Peptide|Horse|BOVIN'), false)")
def _(v):
    return ev.reject_contaminants(v).select("row_id", "gene_symbol")


@book.query("flt2_keep_databases", "v_evidence", sql="SELECT row_id, database FROM v_evidence WHERE regexp_matches(database, 'TrEMBL|Salk|Swiss-Prot')")
def _(v):
    return ev.keep_databases(v).select("row_id", "database")


@book.query(
    "flt3_remap_labels", "v_evidence",
    sql="""SELECT row_id, CASE WHEN database = 'TrEMBL' THEN 'TrEMBL' ELSE smorf_type END AS smorf_type,
    CASE database WHEN 'TrEMBL' THEN 'Unreviewed' WHEN 'Salk' THEN 'Unreviewed' WHEN 'Swiss-Prot' THEN 'Swiss-Prot' WHEN 'Swiss-Prot-MP' THEN 'Swiss-Prot' ELSE database END AS database FROM v_evidence""",
)
def _(v):
    return ev.remap_for_joins(ev.remap_labels(v)).select("row_id", "smorf_type", "database")


@book.query("flt4_ribo_flags", "v_evidence", sql=f"WITH {FLAGS} SELECT row_id, has_ribo_sam, has_loose_ribo_sam FROM flagged")
def _(v):
    return ev.ribo_flags(ev.remap_labels(ev.keep_databases(ev.reject_contaminants(v)))).select("row_id", "has_ribo_sam", "has_loose_ribo_sam")


@book.query("flt5_ms_flags", "v_evidence", sql=f"WITH {FLAGS} SELECT row_id, dda_evidence, dia_evidence, has_ms FROM ms")
def _(v):
    flagged = ev.ms_flags(ev.ribo_flags(ev.remap_labels(ev.keep_databases(ev.reject_contaminants(v)))))
    return flagged.select("row_id", "dda_evidence", "dia_evidence", "has_ms")


@book.query("evidence_gate", "v_evidence", sql=f"WITH {FLAGS} SELECT row_id, sequence, database, smorf_type, has_ms FROM gated")
def _(v):
    return ev.evidence_gate(v).select("row_id", "sequence", "database", "smorf_type", "has_ms")


@book.query("flt7_annotation_status", "v_evidence", sql=f"WITH {FLAGS} SELECT row_id, {STATUS} AS annotation_status FROM gated")
def _(v):
    return ev.annotation_status(ev.evidence_gate(v)).select("row_id", "annotation_status")


@book.query("flt8_ms_type", "v_evidence", sql=f"WITH {FLAGS} SELECT row_id, {MS_TYPE} AS ms_type FROM ms")
def _(v):
    flagged = ev.ms_flags(ev.ribo_flags(ev.remap_labels(ev.keep_databases(ev.reject_contaminants(v)))))
    return ev.ms_type(flagged).select("row_id", "ms_type")


@book.query(
    "flt9_best_tier", "v_evidence",
    sql=f"WITH {FLAGS} SELECT row_id, coalesce({TIER}, CASE {STATUS} WHEN 'MS' THEN 'No PROSIT' WHEN 'RiboCode_SAM' THEN 'No MS' END) AS dda_grade FROM gated",
)
def _(v):
    return ev.graded(ev.annotation_status(ev.evidence_gate(v))).select("row_id", "dda_grade")


@book.query(
    "flt10_discovery_summary", "v_evidence",
    sql=f"""WITH {FLAGS} SELECT sequence AS "Microprotein Sequence", genomic_coordinates AS "smORF Coordinates", smorf_type AS "smORF Class", gene_name AS "Parent Gene", protein_length AS "Microprotein Length",
    {STATUS} AS "Annotation Status", {MS_TYPE} AS "MS Evidence Type", coalesce({TIER}, CASE {STATUS} WHEN 'MS' THEN 'No PROSIT' WHEN 'RiboCode_SAM' THEN 'No MS' END) AS "DDA Grade", mean_phylocsf AS "PhyloCSF Score" FROM gated WHERE database = 'Salk'""",
)
def _(v):
    return ev.discovery_summary(ev.evidence_gate(v))


@book.query(
    "flt11_classifier_summary", "v_evidence",
    sql=f"""WITH {FLAGS} SELECT sequence AS "Microprotein Sequence", gene_symbol AS "smORF ID", gene_name AS "Gene Body (Name)", smorf_type AS "smORF Class", shortstop_label AS "ShortStop Label", shortstop_score AS "ShortStop Score",
    {STATUS} AS "Annotation Status", mean_phylocsf AS "PhyloCSF Score" FROM gated WHERE database = 'Salk' AND shortstop_label IS NOT NULL""",
)
def _(v):
    return ev.classifier_summary(ev.evidence_gate(v))


@book.query(
    "flt12_long_read_summary", "v_evidence",
    sql=f"WITH {FLAGS} SELECT sequence, nanopore_basemean, database, gene_name, gene_symbol, protein_length, start_codon, smorf_type, total_razor_spectral_counts, total_unique_spectral_counts FROM gated WHERE database = 'Salk' OR nanopore_basemean IS NOT NULL",
)
def _(v):
    return ev.long_read_summary(ev.evidence_gate(v))


@book.query("flt13_ribo_summary", "v_evidence", sql=f"WITH {FLAGS} SELECT {', '.join(ev.RIBO_COLUMNS)} FROM gated WHERE database IN ('Salk', 'Swiss-Prot-MP')")
def _(v):
    return ev.ribo_summary(ev.evidence_gate(v))


@book.query("flt14_pseudogene_subset", "v_evidence", sql=f"WITH {FLAGS} SELECT sequence, rp3_mm_amb, total_unique_spectral_counts FROM gated WHERE total_unique_spectral_counts > 0 AND smorf_type = 'psORF'")
def _(v):
    return ev.pseudogene_subset(ev.ribo_summary(ev.evidence_gate(v))).select("sequence", "rp3_mm_amb", "total_unique_spectral_counts")


@book.query(
    "flt15_review_status", "v_evidence",
    sql="SELECT row_id, CASE WHEN database LIKE '%Swiss-Prot%' THEN 'Reviewed' WHEN database LIKE '%Salk%' OR database LIKE '%TrEMBL%' OR database LIKE '%Unreviewed%' THEN 'Unreviewed' ELSE 'Unknown' END AS status FROM v_evidence",
)
def _(v):
    return v.select("row_id", ev.review_status(F.col("database")).alias("status"))


@book.query("flt16_with_base_mean", "v_evidence", sql="SELECT row_id, nanopore_basemean FROM v_evidence WHERE nanopore_basemean IS NOT NULL AND nanopore_basemean <> 0")
def _(v):
    return ev.with_base_mean(v).select("row_id", "nanopore_basemean")


@book.query(
    "rnk1_first_per_sequence", "v_evidence",
    sql="SELECT row_id, sequence FROM (SELECT *, row_number() OVER (PARTITION BY sequence ORDER BY ribocode DESC NULLS LAST, row_id) AS rn FROM v_evidence) WHERE rn = 1",
)
def _(v):
    return ev.first_per_sequence(v, [F.col("ribocode").desc_nulls_last(), F.col("row_id")]).select("row_id", "sequence")


@book.query("agg12_value_counts", "v_evidence", sql=f"WITH {FLAGS} SELECT {STATUS} AS annotation_status, count(*) AS n FROM gated WHERE has_ms IS NOT NULL GROUP BY 1")
def _(v):
    return ev.annotation_status(ev.evidence_gate(v)).dropna(subset=["annotation_status"]).groupBy("annotation_status").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "annotation_status")


@book.query("srt1_methionine_first", "v_evidence", sql="SELECT row_id, sequence, sequence LIKE 'M%' AS starts_with_m FROM v_evidence")
def _(v):
    rows = v.select("row_id", "sequence", F.col("sequence").startswith("M").alias("starts_with_m"))
    return rows.orderBy(F.desc("starts_with_m"), "sequence", "row_id")
