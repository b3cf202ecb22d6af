"""Test views over the driver's tables, each one SQL text that Spark and DuckDB both run, and the book that queries are kept in."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: Tables are named in braces.
VIEWS = {
    "v_evidence": """
        SELECT o_orderkey AS row_id,
            CASE WHEN o_custkey % 3 = 0 THEN 'M' ELSE 'K' END || 'PEPTIDEC' || CAST(o_custkey AS STRING) AS sequence,
            CASE c_mktsegment WHEN 'BUILDING' THEN 'TrEMBL' WHEN 'AUTOMOBILE' THEN 'Swiss-Prot' WHEN 'MACHINERY' THEN 'Salk'
                WHEN 'HOUSEHOLD' THEN 'Swiss-Prot-MP' ELSE 'RefSeq' END AS database,
            CASE WHEN o_orderkey % 41 = 0 THEN 'Q1_sHeEp' WHEN o_orderkey % 43 = 0 THEN 'ALBU_BOVIN' WHEN o_orderkey % 19 = 0 THEN NULL
                ELSE 'T' || CAST(o_orderkey % 97 AS STRING) || '+chr' || CAST(1 + o_custkey % 22 AS STRING) || ':' || CAST(1000 + o_custkey AS STRING) || '-' || CAST(1090 + o_custkey AS STRING) END AS gene_symbol,
            CASE WHEN o_custkey % 13 = 0 THEN NULL ELSE 'GENE' || CAST(o_custkey % 60 AS STRING) END AS gene_name,
            'ENSG' || CAST(o_custkey % 200 AS STRING) || '.' || CAST(o_custkey % 5 AS STRING) AS gene_id,
            CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE 'chr' || CAST(1 + o_custkey % 22 AS STRING) || ':' || CAST(1000 + o_custkey AS STRING) || '-' || CAST(1090 + o_custkey AS STRING) END AS genomic_coordinates,
            CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE CASE o_orderkey % 9 WHEN 0 THEN 'uORF' WHEN 1 THEN 'dORF' WHEN 2 THEN 'oORF' WHEN 3 THEN 'Iso' WHEN 4 THEN 'lncRNA'
                WHEN 5 THEN 'psORF' WHEN 6 THEN 'iORF' WHEN 7 THEN 'N-Iso' ELSE 'eORF' END END AS smorf_type,
            CASE WHEN o_orderkey % 5 < 4 THEN 'Microprotein' ELSE 'Protein' END AS protein_class_length,
            CASE WHEN o_custkey % 17 = 0 THEN NULL ELSE CAST(8 + o_custkey % 170 AS INT) END AS protein_length,
            CASE WHEN o_orderkey % 29 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN 'ATG' ELSE 'CTG' END AS start_codon,
            CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE o_orderkey % 3 < 2 END AS ribocode,
            CASE o_orderkey % 4 WHEN 0 THEN 'SAM-Secreted' WHEN 1 THEN 'SAM-Intracellular' WHEN 2 THEN 'PRISM' END AS shortstop_label,
            CAST(o_orderkey % 1000 AS DOUBLE) / 1000 AS shortstop_score,
            CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE greatest(o_orderkey % 6 - 3, 0) END AS total_unique_spectral_counts,
            o_orderkey % 8 AS total_razor_spectral_counts,
            CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderkey % 20 AS DOUBLE) / 1000 END AS global_pg_q_value,
            CASE WHEN o_orderkey % 37 = 0 THEN NULL ELSE CAST(o_orderkey % 2 AS INT) END AS proteotypic,
            CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST(o_orderkey % 50 AS DOUBLE) - 25 END AS mean_phylocsf,
            CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN '[]' WHEN 2 THEN '[' || chr(39) || 'Weak' || chr(39) || ', ' || chr(39) || 'Strong' || chr(39) || ']'
                WHEN 3 THEN '[' || chr(39) || 'Insufficient' || chr(39) || ', None]' WHEN 4 THEN 'broken [' WHEN 5 THEN '[' || chr(39) || 'N/A' || chr(39) || ']'
                ELSE '[' || chr(39) || 'Moderate' || chr(39) || ']' END AS confidence,
            o_orderkey % 5 AS rp3_default, o_orderkey % 4 AS rp3_mm_amb, o_orderkey % 3 AS rp3_amb, o_orderkey % 2 AS rp3_mm,
            CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN CAST(0 AS DOUBLE) ELSE CAST(o_custkey % 300 AS DOUBLE) / 2 END AS nanopore_basemean,
            CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_custkey % 100 AS DOUBLE) / 100 END AS tmt_qvalue_50pct,
            CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST(o_orderkey % 100 AS DOUBLE) / 100 END AS rosmap_padj,
            CAST(o_orderkey % 200 AS DOUBLE) / 50 - 2 AS log2fc
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
    "v_interval_a": """
        SELECT 'T' || CAST(l_orderkey AS STRING) || '-chr' || CAST(1 + l_suppkey % 5 AS STRING) || ':' || CAST(l_partkey * 10 + l_linenumber AS STRING) || '-'
                || CAST(l_partkey * 10 + l_linenumber + CAST(l_quantity AS BIGINT) AS STRING) AS id,
            l_orderkey * 10 + l_linenumber AS pos,
            'chr' || CAST(1 + l_suppkey % 5 AS STRING) AS chrom, CASE WHEN l_returnflag = 'A' THEN '+' ELSE '-' END AS strand,
            l_partkey * 10 + l_linenumber AS start_pos, l_partkey * 10 + l_linenumber + CAST(l_quantity AS BIGINT) AS end_pos,
            CASE WHEN l_linenumber = 7 THEN 'exon' ELSE 'CDS' END AS feature
        FROM {lineitem}""",
    "v_interval_b": """
        SELECT p_partkey AS ref_pos, 'G' || CAST(p_partkey % 211 AS STRING) AS gene_id, 'X' || CAST(p_partkey % 701 AS STRING) AS transcript_id,
            CASE WHEN p_partkey % 211 % 10 = 0 THEN NULL ELSE 'NAME' || CAST(p_partkey % 211 AS STRING) END AS gene_name,
            'chr' || CAST(1 + p_partkey % 211 % 5 AS STRING) AS chrom, CASE WHEN p_partkey % 211 % 2 = 0 THEN '+' ELSE '-' END AS strand,
            p_partkey * 10 - (p_partkey % 3) * 20 AS start_pos, p_partkey * 10 + p_size * (1 + p_partkey % 4) AS end_pos,
            CASE p_type WHEN 'ECONOMY' THEN 'three_prime_utr' WHEN 'LARGE' THEN 'five_prime_utr' WHEN 'MEDIUM' THEN 'exon' WHEN 'PROMO' THEN 'retrotransposed' ELSE 'CDS' END AS feature,
            CASE p_size % 5 WHEN 0 THEN 'lncRNA' WHEN 1 THEN NULL ELSE 'protein_coding' END AS gene_biotype,
            CASE p_size % 7 WHEN 0 THEN 'processed_pseudogene' WHEN 1 THEN 'retained_intron' WHEN 2 THEN 'nonsense_mediated_decay' WHEN 3 THEN NULL ELSE 'protein_coding' END AS transcript_biotype
        FROM {part}""",
    "v_psm": """
        SELECT l_orderkey * 10 + l_linenumber AS psm_id, 'PEPC' || CAST(l_partkey AS STRING) || 'K' AS peptide,
            CASE WHEN l_suppkey % 3 = 0 THEN 'round2/b' ELSE 'b' END || CAST(1 + l_suppkey % 14 AS STRING) AS batch,
            CASE WHEN l_linenumber = 1 THEN 'n[43]PEPCK' WHEN l_linenumber = 2 THEN 'n[230]PEM[147]CK[305]' WHEN l_linenumber = 3 THEN NULL ELSE 'PEPC[160]K' END AS modified_peptide,
            CAST(2 + l_linenumber % 3 AS INT) AS charge, l_extendedprice / 1000 AS hyperscore, CASE WHEN l_tax > 0.07 THEN NULL ELSE 1 - 5 * l_discount END AS purity,
            'run' || CAST(l_suppkey AS STRING) || '.' || CAST(l_orderkey AS STRING) || '.' || CAST(l_orderkey AS STRING) || '.' || CAST(2 + l_linenumber % 3 AS STRING) AS spectrum,
            CAST(l_quantity AS BIGINT) AS spectral_count
        FROM {lineitem}""",
    "v_matrix": """
        SELECT 'F' || CAST(l_partkey % 400 AS STRING) AS feature, 'S' || CAST(l_suppkey AS STRING) AS sample, sum(l_quantity) AS value, count(*) AS n_rows
        FROM {lineitem} GROUP BY l_partkey % 400, l_suppkey""",
    "v_samples": """
        SELECT 'S' || CAST(s_suppkey AS STRING) AS sample, CASE s_nationkey % 3 WHEN 0 THEN 'Control' WHEN 1 THEN 'AsymAD' ELSE 'AD' END AS grp,
            'b' || CAST(1 + s_nationkey % 4 AS STRING) AS batch, CASE WHEN s_suppkey % 2 = 0 THEN 'F' ELSE 'M' END AS sex,
            CASE WHEN s_suppkey % 10 = 0 THEN '90+' WHEN s_suppkey % 33 = 5 THEN 'unknown' ELSE CAST(60 + s_suppkey % 30 AS STRING) END AS age_death,
            CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE CAST(s_suppkey % 40 AS DOUBLE) / 4 END AS pmi, s_acctbal / 1000 AS rin,
            CASE WHEN s_suppkey % 21 = 0 THEN NULL ELSE CAST(s_suppkey % 7 AS INT) END AS braak, CAST(1 + s_suppkey % 4 AS INT) AS cerad,
            CASE WHEN s_suppkey % 17 = 3 THEN NULL ELSE CAST(10 + s_suppkey % 21 AS DOUBLE) END AS mmse, CAST(1 + s_suppkey % 6 AS INT) AS cogdx, CAST(s_suppkey % 4 AS DOUBLE) / 2 AS cdr
        FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey""",
    "v_peaks": """
        SELECT vec_id, label, embedding FROM {embeddings}""",
    "v_lists": """
        SELECT event_id, user_id, CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN '[]' WHEN 2 THEN 'P' || CAST(user_id AS STRING)
            WHEN 3 THEN '[' || chr(39) || 'P' || CAST(user_id AS STRING) || chr(39) || ', ' || chr(39) || ' P' || CAST(user_id % 10 AS STRING) || chr(39) || ']'
            WHEN 4 THEN '[' || chr(39) || 'P' || CAST(user_id AS STRING) || chr(39) || ', None, ' || chr(39) || 'nan' || chr(39) || ']'
            ELSE '[' || CAST(event_id % 4 AS STRING) || ', ' || CAST(user_id AS STRING) || ']' END AS list_text, event_type, value
        FROM {events}""",
    "v_celltype": """
        SELECT o_orderkey AS row_id, 'GENE' || CAST(o_custkey % 60 AS STRING) AS gene,
            CASE o_orderkey % 11 WHEN 0 THEN 'Exc L2' WHEN 1 THEN 'Inh PV' WHEN 2 THEN 'Ast DPP' WHEN 3 THEN 'Mic' WHEN 4 THEN 'MicTPT1' WHEN 5 THEN 'Oli' WHEN 6 THEN 'OPC' WHEN 7 THEN 'End'
                WHEN 8 THEN 'SMC' WHEN 9 THEN ' Per' ELSE 'Unknown' END AS celltype,
            CAST(o_orderkey % 200 AS DOUBLE) / 50 - 2 AS logfc, CAST(1 + o_orderkey % 97 AS DOUBLE) / 100 AS p_adj_loc,
            CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE CAST(1 + o_orderkey % 53 AS DOUBLE) / 400 END AS p_adj_glb
        FROM {orders}""",
    "v_idmap": """
        SELECT 'GENE' || CAST(n_nationkey AS STRING) AS gene_name, 'ENSG' || CAST(n_nationkey AS STRING) AS gene_id FROM {nation}
        UNION ALL SELECT 'GENE' || CAST(n_nationkey AS STRING), 'ENSGX' || CAST(n_nationkey AS STRING) FROM {nation} WHERE n_nationkey % 5 = 0""",
    "v_assets": """
        SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'mirror_plots/' ELSE 'expression_profiles/' END
            || CASE WHEN page_id % 3 = 0 THEN CASE page_id % 4 WHEN 0 THEN 'Strong' WHEN 1 THEN 'Moderate' WHEN 2 THEN 'Weak' ELSE 'Other' END WHEN page_id % 3 = 1 THEN 'coupled' ELSE 'non_coupled' END
            || CASE WHEN page_id % 3 = 0 THEN '/P' || CAST(page_id % 60 AS STRING) || '_2z_' || CAST(page_id AS STRING) ELSE '/GENE' || CAST(page_id % 50 AS STRING) || '_chr3_' || CAST(page_id % 40 AS STRING) || '-900' END
            || CASE WHEN page_id % 5 = 4 THEN '.pdf' ELSE '.png' END AS path, length(url) AS size
        FROM {pages}""",
    "v_src_a": "SELECT 'D' || CAST(doc_id % 300 AS STRING) AS sequence, lang AS gene_name, source AS database, n_chars AS protein_length, doc_id AS row_id FROM {documents}",
    "v_src_b": "SELECT 'D' || CAST(doc_id % 400 AS STRING) AS sequence, CASE WHEN quality = 1 THEN 'Swiss-Prot' END AS database, toxic, doc_id AS row_id FROM {labels}",
    "v_src_c": "SELECT 'D' || CAST(page_id AS STRING) AS sequence, url AS ucsc, CASE WHEN page_id % 2 = 0 THEN '12' ELSE 'n/a' END AS length_text, page_id AS row_id FROM {pages}",
}

Query = Callable[[SparkSession, str], DataFrame]


def with_views(sql: str, views: tuple[str, ...]) -> str:
    """The oracle's text: the views as common table expressions before it."""
    named = ", ".join(f"{v} AS ({re.sub(r'{(\w+)}', r'\1', VIEWS[v])})" for v in views if v in VIEWS)
    sql = sql.strip()
    if not named:
        return sql
    return f"WITH {named}, {sql[4:]}" if sql[:5].upper() == "WITH " else f"WITH {named} {sql}"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view or a table as a DataFrame."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    used = dict.fromkeys(re.findall(r"{(\w+)}", VIEWS[name]))
    return spark.sql(VIEWS[name], **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


class Book:
    """Queries and oracles of a module."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def query(self, name: str, *views: str, sql: str | None = None) -> Callable:
        """Registers a function of the views' DataFrames; sql is its oracle over the views."""

        def register(function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
            self.queries[name] = lambda spark, sf_dir: function(*(load(spark, sf_dir, v) for v in views))
            if sql:
                self.oracles[name] = with_views(sql, views)
            return function

        return register
