"""Queries of genomic intervals and of binned profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import intervals as iv
from strandline.plans.fixtures import Book

book = Book()
QUERIES, ORACLES = book.queries, book.oracles

OV = "ov AS (SELECT a.id, a.pos, a.chrom, a.strand, a.feature, a.start_pos, a.end_pos, b.ref_pos, b.feature AS rf, b.gene_id, b.gene_name, b.gene_biotype, coalesce(b.transcript_biotype, 'Unknown') AS tb, least(a.end_pos, b.end_pos) - greatest(a.start_pos, b.start_pos) + 1 AS overlap FROM v_interval_a a JOIN v_interval_b b ON a.chrom = b.chrom AND a.strand = b.strand AND a.start_pos <= b.end_pos AND b.start_pos <= a.end_pos)"
CDS = "cds AS (SELECT * FROM v_interval_b WHERE feature = 'CDS')"
EXT = "ext AS (SELECT gene_id, min(chrom) AS chrom, CASE WHEN bool_or(strand = '+') THEN min(start_pos) ELSE max(end_pos) END AS upstream, CASE WHEN bool_or(strand = '+') THEN max(end_pos) ELSE min(start_pos) END AS downstream FROM cds GROUP BY 1)"
STARTS = "starts AS (SELECT DISTINCT chrom, CASE WHEN strand = '+' THEN start_pos ELSE end_pos END AS bio_start FROM cds)"
MERGED = """spans AS (SELECT chrom, least(upstream, downstream) AS lo, greatest(upstream, downstream) AS hi FROM ext), isl AS (SELECT *, CASE WHEN lo > coalesce(max(hi) OVER (PARTITION BY chrom ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1000000) THEN 1 ELSE 0 END AS fresh FROM spans),
merged AS (SELECT chrom, min(lo) AS lo, max(hi) AS hi FROM (SELECT *, sum(fresh) OVER (PARTITION BY chrom ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM isl) GROUP BY chrom, island)"""


@book.query("jn1_overlaps", "v_interval_a", "v_interval_b", sql=f"WITH {OV} SELECT id, pos, ref_pos, overlap FROM ov")
def _(a, b):
    return iv.overlaps(a, b).select("id", "pos", F.col("ref_ref_pos").alias("ref_pos"), "overlap")


@book.query("jn2_not_overlapping", "v_interval_a", "v_interval_b", sql="SELECT id, pos FROM v_interval_a a WHERE NOT EXISTS (SELECT 1 FROM v_interval_b b WHERE a.chrom = b.chrom AND a.strand = b.strand AND a.start_pos <= b.end_pos AND b.start_pos <= a.end_pos)")
def _(a, b):
    return iv.not_overlapping(a, b, ["id", "pos", "start_pos", "end_pos"]).select("id", "pos")


def coding(b):
    return b.filter("feature = 'CDS'")


@book.query("agg3_extents", "v_interval_b", sql=f"WITH {CDS}, {EXT} SELECT * FROM ext")
def _(b):
    return iv.extents(coding(b), "gene_id")


@book.query("agg3_transcript_extents", "v_interval_b", sql=f"WITH {CDS}, {EXT.replace('gene_id', 'transcript_id')} SELECT transcript_id, upstream FROM ext")
def _(b):
    return iv.extents(coding(b), "transcript_id").select("transcript_id", "upstream")


@book.query("agg4_coding_starts", "v_interval_b", sql=f"WITH {CDS}, {STARTS} SELECT * FROM starts")
def _(b):
    return iv.coding_starts(coding(b))


def spans(b):
    e = iv.extents(coding(b), "gene_id")
    return e.select("chrom", F.least("upstream", "downstream").alias("lo"), F.greatest("upstream", "downstream").alias("hi"))


@book.query("agg5_merged", "v_interval_b", sql="WITH s AS (SELECT chrom || strand AS chrom, start_pos AS lo, end_pos AS hi FROM v_interval_b), isl AS (SELECT *, CASE WHEN lo > coalesce(max(hi) OVER (PARTITION BY chrom ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1000000) THEN 1 ELSE 0 END AS fresh FROM s) SELECT chrom, min(lo) AS lo, max(hi) AS hi FROM (SELECT *, sum(fresh) OVER (PARTITION BY chrom ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM isl) GROUP BY chrom, island")
def _(b):
    return iv.merged(b.select(F.concat("chrom", "strand").alias("chrom"), F.col("start_pos").alias("lo"), F.col("end_pos").alias("hi")))


@book.query("rnk8_running_reach", "v_interval_b", sql="SELECT ref_pos, max(end_pos) OVER (PARTITION BY chrom ORDER BY start_pos, end_pos, ref_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM v_interval_b")
def _(b):
    return iv.running_max(b.select("ref_pos", "chrom", "start_pos", "end_pos"), "chrom", ["start_pos", "end_pos", "ref_pos"], "end_pos", "reach").select("ref_pos", "reach")


@book.query("jn3_inside_merged", "v_interval_a", "v_interval_b", sql=f"WITH {CDS}, {EXT}, {MERGED} SELECT id, pos, EXISTS (SELECT 1 FROM merged m WHERE m.chrom = a.chrom AND a.start_pos BETWEEN m.lo AND m.hi) AS in_cds FROM v_interval_a a")
def _(a, b):
    return iv.in_unions(a, "start_pos", iv.merged(spans(b)), "in_cds").select("id", "pos", "in_cds")


@book.query("jn4_shared_starts", "v_interval_a", "v_interval_b", sql=f"WITH {CDS}, {STARTS} SELECT id, pos FROM v_interval_a a WHERE EXISTS (SELECT 1 FROM starts s WHERE s.chrom = a.chrom AND s.bio_start = CASE WHEN a.strand = '+' THEN a.start_pos ELSE a.end_pos END)")
def _(a, b):
    from strandline.functions.genome import biological_start

    at = a.withColumn("bio_start", biological_start(F.col("strand"), F.col("start_pos"), F.col("end_pos")))
    return at.join(iv.coding_starts(coding(b)), ["chrom", "bio_start"], "left_semi").select("id", "pos")


@book.query("jn5_gene_extents", "v_interval_b", sql=f"WITH {CDS}, {EXT} SELECT ref_pos, upstream, downstream FROM v_interval_b b LEFT JOIN ext ON ext.gene_id = b.gene_id")
def _(b):
    return b.join(iv.extents(coding(b), "gene_id").drop("chrom"), "gene_id", "left").select("ref_pos", "upstream", "downstream")


LABELLED = f"""{OV}, {CDS}, {EXT}, {STARTS}, {MERGED},
x AS (SELECT ov.*, CAST(regexp_extract(id, 'chr[0-9XYM]+:(\\d+)-(\\d+)', 1) AS BIGINT) AS os, CAST(regexp_extract(id, 'chr[0-9XYM]+:(\\d+)-(\\d+)', 2) AS BIGINT) AS oe, e.upstream AS u, e.downstream AS d FROM ov LEFT JOIN ext e ON e.gene_id = ov.gene_id WHERE feature = 'CDS'),
y AS (SELECT *, CASE WHEN strand = '+' THEN os ELSE oe END AS bs FROM x),
z AS (SELECT y.*, s.bio_start IS NOT NULL AS shares, m.lo IS NOT NULL AS any_cds, coalesce(bs BETWEEN least(u, d) AND greatest(u, d), false) AS in_gene, coalesce(CASE WHEN strand = '+' THEN os > d ELSE oe < d END, false) AS down, coalesce(CASE WHEN strand = '+' THEN os < u ELSE oe > u END, false) AS up, coalesce(CASE WHEN strand = '+' THEN oe > d ELSE os < d END, false) AS over
    FROM y LEFT JOIN starts s ON s.chrom = y.chrom AND s.bio_start = bs LEFT JOIN merged m ON m.chrom = y.chrom AND bs BETWEEN m.lo AND m.hi),
lab AS (SELECT id, pos, ref_pos, coalesce(gene_name, 'Unnamed') AS gene_name, gene_id,
    CASE rf WHEN 'three_prime_utr' THEN CASE WHEN shares THEN 'iORF' WHEN down THEN 'dORF' WHEN NOT in_gene AND any_cds THEN 'iORF' ELSE 'daORF' END
    WHEN 'five_prime_utr' THEN CASE WHEN shares THEN 'iORF' WHEN up THEN 'uORF' WHEN NOT in_gene AND any_cds THEN 'iORF' ELSE 'uaORF' END
    WHEN 'CDS' THEN CASE WHEN shares OR any_cds THEN 'iORF' WHEN up THEN 'uoORF' WHEN over THEN 'doORF' ELSE 'iORF' END WHEN 'retrotransposed' THEN 'psORF'
    ELSE CASE WHEN tb = 'processed_pseudogene' THEN 'psORF' WHEN tb = 'nonsense_mediated_decay' THEN 'aORF' WHEN tb = 'retained_intron' THEN 'riORF' WHEN gene_biotype = 'lncRNA' THEN 'lncRNA' WHEN rf = 'exon' THEN 'eORF' ELSE 'UA' END END AS annotation FROM z)"""


@book.query("agg6_labels", "v_interval_a", "v_interval_b", sql=f"WITH {LABELLED} SELECT id, pos, ref_pos, annotation FROM lab")
def _(a, b):
    return iv.annotated_pairs(a, b).select("id", "pos", "ref_pos", "annotation")


PRIORITY = "[" + ", ".join(f"'{p}'" for p in iv.PRIORITY) + "]"
PAIR = " ".join(f"WHEN (s.annotation = '{a}' AND x.annotation = '{b}') OR (s.annotation = '{b}' AND x.annotation = '{a}') THEN struct_pack(annotation := '{c}', gene_name := x.gene_name, gene_id := x.gene_id)" for (a, b), c in iv.TOGETHER.items())
FOLDED = f"""folded AS (SELECT id, list_reduce(list(struct_pack(annotation := annotation, gene_name := gene_name, gene_id := gene_id) ORDER BY pos, ref_pos, annotation, gene_name, gene_id),
    lambda s, x: CASE {PAIR} WHEN coalesce(nullif(list_position({PRIORITY}, x.annotation), 0), 99) < coalesce(nullif(list_position({PRIORITY}, s.annotation), 0), 99) THEN x ELSE s END) AS r FROM lab GROUP BY id)"""


@book.query("agg7_resolved", "v_interval_a", "v_interval_b", sql=f"WITH {LABELLED}, {FOLDED} SELECT id, r.annotation AS annotation, r.gene_name AS gene_name, r.gene_id AS gene_id FROM folded")
def _(a, b):
    return iv.resolved(iv.annotated_pairs(a, b))


@book.query(
    "interval_classification", "v_interval_a", "v_interval_b",
    sql=f"WITH {LABELLED}, {FOLDED} SELECT id, r.annotation AS annotation, r.gene_name AS gene_name, r.gene_id AS gene_id FROM folded UNION ALL SELECT DISTINCT id, 'intergenic', 'None', 'None' FROM v_interval_a a WHERE NOT EXISTS (SELECT 1 FROM ov WHERE ov.id = a.id AND ov.pos = a.pos AND ov.start_pos = a.start_pos AND ov.end_pos = a.end_pos) AND id NOT IN (SELECT id FROM folded)",
)
def _(a, b):
    return iv.classified(a, b, ["id", "pos", "start_pos", "end_pos"])


@book.query(
    "agg21_profile", "lineitem",
    sql="""WITH s AS (SELECT l_suppkey AS item, min(l_shipdate) AS lo FROM lineitem GROUP BY 1), p AS (SELECT l_suppkey AS item, l_extendedprice / 100 AS x, l_quantity AS v FROM lineitem), r AS (SELECT item, min(x) AS lo, max(x) AS hi FROM p GROUP BY 1 HAVING max(x) - min(x) >= 1),
    m AS (SELECT p.item, least(floor((x - lo) / (hi - lo) * 200), 199)::INT AS bin, avg(v) AS mean FROM p JOIN r ON p.item = r.item GROUP BY 1, 2), g AS (SELECT item, unnest(range(200))::INT AS bin FROM r)
    SELECT g.item, g.bin, (SELECT mean FROM m WHERE m.item = g.item ORDER BY abs(m.bin - g.bin), m.bin DESC LIMIT 1) AS mean FROM g""",
)
def _(t):
    points = t.select(F.col("l_suppkey").alias("item"), (F.col("l_extendedprice") / 100).alias("along"), F.col("l_quantity").alias("intensity"))
    return iv.profile(points, 200)


@book.query(
    "agg22_best_overlap", "lineitem", "part", "supplier",
    sql="WITH c AS (SELECT l_suppkey AS cell, l_partkey % 50 AS nucleus, count(*) AS n FROM lineitem GROUP BY 1, 2), b AS (SELECT cell, nucleus FROM c QUALIFY row_number() OVER (PARTITION BY cell ORDER BY n DESC, nucleus) = 1) SELECT cell, nucleus, p_size / (10 + s_acctbal / 100) AS share FROM b JOIN part ON p_partkey = nucleus JOIN supplier ON s_suppkey = cell WHERE p_size / (10 + s_acctbal / 100) BETWEEN 0.1 AND 0.9",
)
def _(t, p, s):
    shared = t.select(F.col("l_suppkey").alias("cell"), (F.col("l_partkey") % 50).alias("nucleus"))
    areas = p.select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("nucleus_area")).join(s.select(F.col("s_suppkey").alias("id"), (10 + F.col("s_acctbal") / 100).alias("cell_area")), "id", "full_outer")
    return iv.best_overlap(shared, areas, 0.1, 0.9)


@book.query("rnk11_central", "lineitem", sql="SELECT l_suppkey AS image, arg_min(l_orderkey * 10 + l_linenumber, struct_pack(s := s, i := l_orderkey * 10 + l_linenumber)) AS item FROM (SELECT *, l_quantity / max(l_quantity) OVER (PARTITION BY l_suppkey) - 0.5 * (l_extendedprice / max(l_extendedprice) OVER (PARTITION BY l_suppkey)) AS s FROM lineitem) GROUP BY 1")
def _(t):
    items = t.select(F.col("l_suppkey").alias("image"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item"), F.col("l_quantity").alias("distance"), F.col("l_extendedprice").alias("area"))
    return iv.central(items)


@book.query("agg27_mask_ratios", "lineitem", sql="SELECT l_suppkey AS cell, avg(l_extendedprice) FILTER (l_returnflag = 'A') AS nuclear, avg(l_extendedprice) AS cell_mean, avg(l_extendedprice) FILTER (l_returnflag = 'A') / avg(l_extendedprice) AS ratio FROM lineitem GROUP BY 1")
def _(t):
    pixels = t.select(F.col("l_suppkey").alias("cell"), F.col("l_extendedprice").alias("intensity"), (F.col("l_returnflag") == "A").alias("is_nucleus"))
    return iv.mask_ratios(pixels, ["cell"])
