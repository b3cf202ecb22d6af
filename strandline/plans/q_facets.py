"""Queries of the faceted view, of merging and of set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import genome, lists
from strandline.functions.predicates import number
from strandline.operators import facets, merging
from strandline.operators.evidence import evidence_gate
from strandline.plans.fixtures import Book
from strandline.plans.q_evidence import FLAGS

book = Book()
QUERIES, ORACLES = book.queries, book.oracles
GROUP_SQL = "CASE " + " ".join(f"WHEN smorf_type IN ({', '.join(repr(m) for m in members)}) THEN '{g}'" for g, members in facets.GROUPS.items()) + " ELSE smorf_type END"


@book.query("flt17_drop_and_move_columns", "v_evidence", sql="SELECT gene_name, sequence, row_id, database FROM (SELECT row_id, sequence, gene_name, database FROM v_evidence)")
def _(v):
    return merging.without_columns(v.select("row_id", "sequence", "rp3_default", "gene_name", "database", "rp3_mm"), "^(Unnamed|rp3_)", ("GENE_NAME",))


@book.query("flt18_drop_rows_with_bar", "v_assets", sql="SELECT page_id, path FROM v_assets WHERE path NOT LIKE '%non%' AND CAST(size AS VARCHAR) NOT LIKE '%non%'")
def _(v):
    return merging.without_text(v, "non").select("page_id", "path")


@book.query("flt19_one_of", "v_evidence", sql="SELECT row_id, shortstop_label FROM v_evidence WHERE shortstop_label IN ('PRISM', 'SAM-Secreted')")
def _(v):
    return facets.one_of(facets.one_of(v, "shortstop_label", ["PRISM", "SAM-Secreted"]), "database", []).select("row_id", "shortstop_label")


@book.query(
    "flt20_within_or_null", "v_evidence",
    sql="SELECT row_id FROM v_evidence WHERE (start_codon IN ('ATG') OR start_codon IS NULL) AND (protein_length BETWEEN 20 AND 100 OR protein_length IS NULL) AND (mean_phylocsf BETWEEN -10 AND 5 OR mean_phylocsf IS NULL)",
)
def _(v):
    v = facets.one_of(v, "start_codon", ["ATG"], keep_null=True)
    return facets.within(facets.within(facets.within(v, "protein_length", (20, 100)), "mean_phylocsf", (-10, 5)), "shortstop_score", None).select("row_id")


@book.query("flt21_search", "v_evidence", sql="SELECT row_id, gene_name, sequence FROM v_evidence WHERE regexp_matches(gene_name, '(?i)gene1[0-3]$') AND regexp_matches(sequence, '(?i)^mpep')")
def _(v):
    return facets.search(facets.search(v, "gene_name", "gene1[0-3]$"), "sequence", "^mpep").select("row_id", "gene_name", "sequence")


@book.query("flt22_in_groups", "v_evidence", sql="SELECT row_id, smorf_type FROM v_evidence WHERE smorf_type IN ('uORF', 'uoORF', 'uaORF', 'uaoORF', 'udORF', 'dORF')")
def _(v):
    return facets.in_groups(v, "smorf_type", ["Upstream", "Downstream"], "Downstream", ["dORF"]).select("row_id", "smorf_type")


@book.query(
    "flt23_beyond_start", "v_lists",
    sql="SELECT event_id FROM (SELECT *, CASE WHEN event_id % 2 = 0 THEN 'Iso' ELSE CASE WHEN event_id % 5 = 0 THEN 'N-Iso' ELSE 'uORF' END END AS kind FROM v_lists) WHERE kind = 'uORF' OR list_text IS NULL OR NOT (list_text = '[]' OR event_id % 6 = 5) OR (event_id % 6 = 5 AND (event_id % 4 > 2 OR user_id > 2))",
)
def _(v):
    kinds = v.withColumn("kind", F.when(F.col("event_id") % 2 == 0, "Iso").when(F.col("event_id") % 5 == 0, "N-Iso").otherwise("uORF"))
    return facets.beyond_start(kinds, "kind", "list_text").select("event_id")


@book.query(
    "flt24_significance", "v_evidence",
    sql="SELECT row_id, coalesce(tmt_qvalue_50pct, 1) < 0.2 AS tmt_significant, coalesce(tmt_qvalue_50pct, 1) < 0.05 AS tmt_highly_significant, coalesce(rosmap_padj, 1) < 0.2 AS rna_significant, coalesce(rosmap_padj, 1) < 0.05 AS rna_highly_significant FROM v_evidence",
)
def _(v):
    out = facets.significance(v, {"tmt": "tmt_qvalue_50pct", "rna": "rosmap_padj"})
    return out.select("row_id", "tmt_significant", "tmt_highly_significant", "rna_significant", "rna_highly_significant")


@book.query("flt25_reviewed_split", "v_evidence", sql="SELECT row_id, coalesce(database LIKE '%Swiss%', false) AS reviewed FROM v_evidence")
def _(v):
    return v.select("row_id", facets.is_reviewed(F.col("database")).alias("reviewed"))


@book.query(
    "flt26_included", "v_evidence",
    sql="SELECT row_id FROM v_evidence WHERE coalesce(ribocode, false) OR (database LIKE '%Swiss-Prot%' AND length(sequence) <= 11 AND total_unique_spectral_counts > 0)",
)
def _(v):
    return facets.included(v, F.col("ribocode"), ["database"], F.col("total_unique_spectral_counts") > 0, longest=11).select("row_id")


@book.query(
    "flt27_masked", "v_evidence",
    sql="""SELECT row_id, CASE WHEN database LIKE '%Swiss%' THEN '—' ELSE coalesce(shortstop_label, '') END AS shortstop_label, CASE WHEN database LIKE '%Swiss%' THEN 'Swiss-Prot' ELSE coalesce(smorf_type, '') END AS smorf_type,
    CASE WHEN database LIKE '%Swiss%' THEN '—' ELSE printf('%.3f', shortstop_score) END AS shortstop_score FROM v_evidence""",
)
def _(v):
    return facets.masked(v, "database", ["shortstop_label"], ["smorf_type"], ["shortstop_score"]).select("row_id", "shortstop_label", "smorf_type", "shortstop_score")


@book.query(
    "agg13_headline", "v_evidence",
    sql=f"""SELECT count(*) AS total, count(DISTINCT gene_name) AS genes, count(DISTINCT {GROUP_SQL}) AS groups, count(DISTINCT smorf_type) AS types, count(*) FILTER (coalesce(tmt_qvalue_50pct, 1) < 0.2) AS tmt,
    count(*) FILTER (coalesce(rosmap_padj, 1) < 0.2) AS rna, count(*) FILTER (database LIKE '%Swiss%') AS reviewed, count(*) FILTER (database NOT LIKE '%Swiss%') AS unreviewed,
    round(100.0 * count(*) FILTER (database LIKE '%Swiss%') / count(*), 1)::DOUBLE AS reviewed_percent, round(100.0 * count(*) FILTER (database NOT LIKE '%Swiss%') / count(*), 1)::DOUBLE AS unreviewed_percent FROM v_evidence""",
)
def _(v):
    v = facets.significance(v.withColumn("smorf_group", facets.group_of(F.col("smorf_type"))), {"tmt": "tmt_qvalue_50pct", "rna": "rosmap_padj"})
    return facets.headline(v, "gene_name", "smorf_group", "smorf_type", "database", {"tmt": "tmt_significant", "rna": "rna_significant"})


@book.query(
    "agg26_facet_options", "v_evidence",
    sql="SELECT list_sort(list(DISTINCT start_codon) FILTER (start_codon IS NOT NULL)) AS start_codon, list_sort(list(DISTINCT database)) AS database, min(protein_length)::BIGINT AS min_protein_length, max(protein_length)::BIGINT AS max_protein_length FROM v_evidence",
)
def _(v):
    return facets.options(v, ["start_codon", "database"], ["protein_length"])


MERGED = """
merged AS (
    SELECT coalesce(a.sequence, b.sequence, c.sequence) AS sequence, a.gene_name AS a_gene_name, a.database AS a_database, a.protein_length AS a_protein_length, a.row_id AS a_row_id,
        b.database AS b_database, b.toxic AS b_toxic, b.row_id AS b_row_id, c.ucsc AS c_ucsc, c.length_text AS c_length_text, c.row_id AS c_row_id,
        a.sequence IS NOT NULL AS a_present, b.sequence IS NOT NULL AS b_present, c.sequence IS NOT NULL AS c_present
    FROM v_src_a a FULL JOIN v_src_b b ON a.sequence = b.sequence FULL JOIN v_src_c c ON coalesce(a.sequence, b.sequence) = c.sequence
)"""
TIE = ["a_row_id", "b_row_id", "c_row_id"]


def merged(a, b, c):
    return merging.merge_sources({"a": a, "b": b, "c": c})


@book.query("jn6_merge_sources", "v_src_a", "v_src_b", "v_src_c", sql=f"WITH {MERGED} SELECT * FROM merged")
def _(a, b, c):
    return merged(a, b, c)


FILLED = "+".join(f"(CASE WHEN {c} IS NOT NULL THEN 1 ELSE 0 END)" for c in ("a_gene_name", "a_database", "a_protein_length", "a_row_id", "b_database", "b_toxic", "b_row_id", "c_ucsc", "c_length_text", "c_row_id"))


@book.query("agg17_completeness", "v_src_a", "v_src_b", "v_src_c", sql=f"WITH {MERGED} SELECT sequence, a_row_id, b_row_id, c_row_id, {FILLED} AS filled FROM merged")
def _(a, b, c):
    return merging.completeness_merge({"a": a, "b": b, "c": c}, ["row_id"])


@book.query(
    "rnk2_most_complete", "v_src_a", "v_src_b", "v_src_c",
    sql=f"WITH {MERGED} SELECT sequence, a_row_id, b_row_id, c_row_id FROM merged QUALIFY row_number() OVER (PARTITION BY sequence ORDER BY {FILLED} DESC, a_row_id NULLS LAST, b_row_id NULLS LAST, c_row_id NULLS LAST) = 1",
)
def _(a, b, c):
    return merging.most_complete_merge({"a": a, "b": b, "c": c}, "row_id").select("sequence", *TIE)


@book.query("scl13_unified_columns", "v_src_a", "v_src_b", "v_src_c", sql=f"WITH {MERGED} SELECT a_row_id, b_row_id, c_row_id, coalesce(a_database, b_database) AS database FROM merged")
def _(a, b, c):
    return merging.unified(merged(a, b, c), {"database": "database"}).select(*TIE, "database")


@book.query("scl14_numbers", "v_src_c", sql="SELECT row_id, TRY_CAST(length_text AS DOUBLE) AS n FROM v_src_c")
def _(c):
    return c.select("row_id", number(F.col("length_text")).alias("n"))


@book.query("scl15_protein_length", "v_evidence", sql="SELECT row_id, coalesce(protein_length, length(sequence))::INT AS protein_length FROM v_evidence")
def _(v):
    return v.select("row_id", F.coalesce("protein_length", F.length("sequence")).alias("protein_length"))


@book.query("scl16_parent_group", "v_evidence", sql=f"SELECT row_id, {GROUP_SQL} AS smorf_group FROM v_evidence")
def _(v):
    return v.select("row_id", facets.group_of(F.col("smorf_type")).alias("smorf_group"))


@book.query(
    "agg23_joined_labels", "v_src_a", "v_src_b", "v_src_c",
    sql=f"WITH {MERGED} SELECT a_row_id, b_row_id, c_row_id, coalesce(array_to_string(list_sort(list_distinct(list_filter([trim(a_database), trim(b_database)], lambda x: x IS NOT NULL AND x <> '' AND lower(x) <> 'none'))), '|'), '') AS labels FROM merged",
)
def _(a, b, c):
    return merged(a, b, c).select(*TIE, lists.joined_labels(F.col("a_database"), F.col("b_database")).alias("labels"))


@book.query(
    "scl20_direction", "v_evidence",
    sql="SELECT row_id, CASE WHEN log2fc IS NULL THEN 'na' WHEN rosmap_padj >= 0.2 THEN 'ns' WHEN log2fc > 0 THEN 'up' WHEN log2fc < 0 THEN 'down' ELSE '' END AS direction, CASE WHEN rosmap_padj IS NULL THEN 'na' WHEN rosmap_padj < 0.05 THEN 'yes' ELSE 'ns' END AS p_class FROM v_evidence",
)
def _(v):
    return v.select("row_id", facets.direction(F.col("log2fc"), F.col("rosmap_padj")).alias("direction"), facets.p_class(F.col("rosmap_padj"), 0.05).alias("p_class"))


@book.query(
    "jn9_enrich", "v_src_a", "v_src_b",
    sql="SELECT a.row_id, a.sequence, b.toxic, b.database AS label FROM v_src_a a LEFT JOIN (SELECT * FROM v_src_b QUALIFY row_number() OVER (PARTITION BY sequence ORDER BY row_id) = 1) b ON a.sequence = b.sequence",
)
def _(a, b):
    master = b.withColumnsRenamed({"database": "label", "row_id": "master_row"})
    return merging.enrich(a.select("row_id", "sequence"), master, "sequence", ["toxic", "label"], [F.col("master_row")]).select("row_id", "sequence", "toxic", "label")


@book.query("jn10_mapped", "v_celltype", "v_idmap", sql="SELECT row_id, coalesce(m.gene_id, gene) AS gene FROM v_celltype LEFT JOIN (SELECT gene_name, min(gene_id) AS gene_id FROM v_idmap GROUP BY 1) m ON gene = gene_name")
def _(c, m):
    return merging.mapped(c, m, "gene", "gene_name", "gene_id").select("row_id", "gene")


@book.query("rnk9_first_match", "v_idmap", sql="SELECT gene_name, min(gene_id) AS gene_id FROM v_idmap GROUP BY 1")
def _(m):
    return m.groupBy("gene_name").agg(F.min("gene_id").alias("gene_id"))


@book.query("jn11_celltype_to_master", "v_celltype", "v_evidence", sql=f"WITH {FLAGS} SELECT c.row_id, v.row_id AS master_row, v.sequence FROM v_celltype c LEFT JOIN gated v ON c.gene = v.gene_name")
def _(c, v):
    master = evidence_gate(v).select(F.col("row_id").alias("master_row"), "sequence", F.col("gene_name").alias("gene"))
    return merging.list_join(c.select("row_id", "gene"), master, "gene", "left").select("row_id", "master_row", "sequence")


@book.query("set1_bind_rows", "v_src_a", "v_src_b", sql="SELECT row_id, sequence, gene_name, database, NULL AS toxic FROM v_src_a UNION ALL SELECT row_id, sequence, NULL, database, toxic FROM v_src_b")
def _(a, b):
    return merging.bound(a, b).select("row_id", "sequence", "gene_name", "database", "toxic")


@book.query("set2_bind_same", "v_src_a", "v_src_b", sql="SELECT sequence, database FROM v_src_a UNION ALL SELECT sequence, database FROM v_src_b")
def _(a, b):
    return merging.bound(a.select("sequence", "database"), b.select("sequence", "database"))


@book.query("set3_distinct", "v_src_a", sql="SELECT DISTINCT sequence, gene_name FROM v_src_a")
def _(a):
    return a.select("sequence", "gene_name").distinct()


@book.query("set4_intersection", "v_src_a", "v_src_b", sql="SELECT sequence, true AS shared FROM (SELECT sequence FROM v_src_a INTERSECT SELECT sequence FROM v_src_b) UNION ALL SELECT sequence, false FROM (SELECT sequence FROM v_src_a EXCEPT SELECT sequence FROM v_src_b)")
def _(a, b):
    x, y = a.select("sequence"), b.select("sequence")
    return x.intersect(y).withColumn("shared", F.lit(True)).unionByName(x.subtract(y).withColumn("shared", F.lit(False)))


FAMILY = """CASE WHEN celltype LIKE 'Exc%' THEN 'Exc Neur' WHEN celltype LIKE 'Inh%' THEN 'Inh Neur' WHEN celltype LIKE 'Ast%' THEN 'Astr' WHEN celltype IN ('Mic', 'MicMKI67', 'MicP2RY12', 'MicTPT1', 'CAMs', 'Tcells') THEN 'Immune'
    WHEN celltype IN ('Oli', 'OPC') THEN 'Oli' WHEN celltype IN ('End', 'Per', 'SMC', 'Fib') THEN 'Vas' ELSE 'Other' END"""


@book.query("agg14_signatures", "v_celltype", sql=f"SELECT signature, count(*) AS n FROM (SELECT gene, string_agg(DISTINCT family, ' & ' ORDER BY family) AS signature FROM (SELECT gene, {FAMILY} AS family FROM v_celltype WHERE p_adj_glb < 0.05 AND logfc > 1.9) GROUP BY gene) GROUP BY signature")
def _(c):
    from strandline.operators.cohorts import cell_family

    hits = c.filter((F.col("p_adj_glb") < 0.05) & (F.col("logfc") > 1.9)).withColumn("family", cell_family(F.col("celltype")))
    return merging.signatures(hits, "gene", "family")


@book.query(
    "set5_wide_by_category", "v_celltype",
    sql="SELECT row_id, CASE WHEN celltype = 'Oli' THEN logfc END AS \"Oli_logfc\", CASE WHEN celltype = 'Oli' THEN p_adj_loc END AS \"Oli_p_adj_loc\", CASE WHEN celltype = 'Exc L2' THEN logfc END AS \"Exc_L2_logfc\", CASE WHEN celltype = 'Exc L2' THEN p_adj_loc END AS \"Exc_L2_p_adj_loc\" FROM v_celltype WHERE celltype IN ('Oli', 'Exc L2')",
)
def _(c):
    return merging.wide_by_category(c, "celltype", ["Oli", "Exc L2"], ["logfc", "p_adj_loc"], "row_id")


@book.query("flt40_prefixed", "v_src_b", sql="SELECT row_id, sequence AS r_sequence, database AS r_database, toxic AS r_toxic FROM v_src_b")
def _(b):
    return merging.prefixed(b, "r_", "row_id")


@book.query("scl1_coordinates", "v_evidence", sql="SELECT row_id, nullif(regexp_extract(gene_symbol, '(chr[0-9XYM]+):(\\d+)-(\\d+)', 1), '') AS chrom, TRY_CAST(regexp_extract(gene_symbol, '(chr[0-9XYM]+):(\\d+)-(\\d+)', 2) AS BIGINT) AS start_pos, nullif(regexp_extract(gene_symbol, '^[^+-]+([+-])(chr\\w+):(\\d+)-(\\d+)', 1), '') AS strand FROM v_evidence")
def _(v):
    c, s = genome.coordinates(F.col("gene_symbol")), genome.stranded_coordinates(F.col("gene_symbol"))
    return v.select("row_id", c["chrom"].alias("chrom"), c["start"].alias("start_pos"), s["strand"].alias("strand"))


@book.query("scl2_biological_start", "v_interval_a", sql="SELECT pos, CASE WHEN strand = '+' THEN start_pos ELSE end_pos END AS bio_start FROM v_interval_a")
def _(a):
    return a.select("pos", genome.biological_start(F.col("strand"), F.col("start_pos"), F.col("end_pos")).alias("bio_start"))


LINK = "https://genome.ucsc.edu/cgi-bin/hgTracks?db=hg38"


@book.query(
    "scl3_browser_links", "v_evidence",
    sql=f"""SELECT row_id, CASE WHEN p IS NULL THEN '' ELSE '=HYPERLINK("{LINK}&position=' || p || '", "' || p || '")' END AS link, CASE WHEN p IS NOT NULL THEN '{LINK}&position=' || p WHEN genomic_coordinates IS NOT NULL THEN '{LINK}&position=' || genomic_coordinates END AS plain,
    CASE WHEN p IS NOT NULL THEN '{LINK}&hgS_doOtherUser=submit&hgS_otherUserName=lab&hgS_otherUserSessionName=my%20session&position=' || p END AS session
    FROM (SELECT *, nullif(regexp_extract(gene_symbol, 'chr[0-9XYM]+:\\d+-\\d+'), '') AS p FROM v_evidence)""",
)
def _(v):
    v = v.withColumn("link", genome.browser_link(F.col("gene_symbol")))
    v = v.withColumn("plain", genome.link_or_coordinates(F.col("link"), F.col("genomic_coordinates")))
    return v.select("row_id", "link", "plain", genome.session_link(genome.plain_link(F.col("link")), "lab", "my session").alias("session"))


@book.query(
    "scl12_names", "v_evidence",
    sql="SELECT row_id, regexp_replace(gene_id, '\\..*$', '') AS gene, regexp_replace(smorf_type, '-.*$', '') AS isoform, regexp_replace('b' || CAST(row_id % 20 AS VARCHAR) || '.x', '^b(\\d)\\.', 'b0\\1.') AS channel FROM v_evidence",
)
def _(v):
    channel = F.concat(F.lit("b"), (F.col("row_id") % 20).cast("string"), F.lit(".x"))
    return v.select("row_id", genome.without_version(F.col("gene_id")).alias("gene"), genome.without_isoform(F.col("smorf_type")).alias("isoform"), genome.padded_channel(channel).alias("channel"))


@book.query("scl22_safe_names", "pages", sql="SELECT page_id, regexp_replace(url, '[^A-Za-z0-9_.-]', '_', 'g') AS name FROM pages")
def _(p):
    return p.select("page_id", genome.safe_name(F.col("url")).alias("name"))


DECODED = """CASE event_id % 6 WHEN 1 THEN [] WHEN 3 THEN ['P' || CAST(user_id AS VARCHAR), ' P' || CAST(user_id % 10 AS VARCHAR)] WHEN 4 THEN ['P' || CAST(user_id AS VARCHAR), NULL, 'nan'] WHEN 5 THEN [CAST(event_id % 4 AS VARCHAR), CAST(user_id AS VARCHAR)] END"""


@book.query("scl4_decode_list", "v_lists", sql=f"SELECT event_id, len({DECODED}) AS n, array_to_string(list_transform({DECODED}, lambda x: coalesce(x, '?')), '/') AS items FROM v_lists")
def _(v):
    items = lists.decode_list(F.col("list_text"))
    return v.select("event_id", F.when(items.isNotNull(), F.size(items)).cast("long").alias("n"), F.array_join(items, "/", "?").alias("items"))


@book.query("scl5_display_list", "v_lists", sql=f"SELECT event_id, array_to_string(list_filter({DECODED}, lambda x: x IS NOT NULL), ' · ') AS shown, '[' || array_to_string(list_transform({DECODED}, lambda x: coalesce(chr(39) || x || chr(39), 'None')), ', ') || ']' AS encoded FROM v_lists")
def _(v):
    items = lists.decode_list(F.col("list_text"))
    return v.select("event_id", lists.display_list(items).alias("shown"), lists.encode_list(items).alias("encoded"))
