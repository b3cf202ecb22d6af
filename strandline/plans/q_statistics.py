"""Queries of matrices, sample tables and per-feature tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import distributions as dist
from strandline.operators import cohorts, matrices, merging, testing
from strandline.operators.evidence import evidence_gate
from strandline.plans.fixtures import Book
from strandline.plans.q_evidence import FLAGS
from strandline.plans.q_facets import FAMILY

book = Book()
QUERIES, ORACLES = book.queries, book.oracles
GROUPS = ("Control", "AD")

CERAD = "CASE WHEN cerad BETWEEN 1 AND 4 THEN 4 - cerad ELSE cerad END"
RUBRIC_A = f"""CASE WHEN braak IS NULL OR cerad IS NULL OR mmse IS NULL OR cogdx IS NULL THEN NULL WHEN {CERAD} <= 1 AND braak <= 3 AND NOT (mmse < 24 OR cogdx >= 4) THEN CASE WHEN braak = 3 AND {CERAD} <> 0 THEN NULL ELSE 'Control' END
    WHEN {CERAD} BETWEEN 1 AND 3 AND braak >= 3 AND NOT (mmse < 24 OR cogdx >= 4) THEN 'AsymAD' WHEN {CERAD} >= 2 AND braak >= 3 AND (mmse < 24 OR cogdx >= 4) THEN 'AD' END"""
RUBRIC_B = f"CASE WHEN braak IS NULL OR cerad IS NULL OR cdr IS NULL THEN NULL WHEN {CERAD} BETWEEN 1 AND 3 AND braak >= 3 AND cdr < 1 THEN 'AsymAD' WHEN {CERAD} <= 3 AND braak <= 3 AND cdr < 1 THEN 'Control' WHEN {CERAD} >= 1 AND braak >= 3 AND cdr >= 1 THEN 'AD' END"
AGE = "CASE WHEN age_death = '90+' THEN 91 ELSE TRY_CAST(age_death AS DOUBLE) END"




def beta_sql(a: str, b: str, x: str) -> str:
    """The regularised incomplete beta function in SQL: its hypergeometric series, on the side where that converges faster."""

    def series(a: str, b: str, x: str) -> str:
        terms = f"list_sum(list_transform(range(0, CAST(500 + 20 * ({a} + {b}) AS BIGINT)), lambda i_: exp(lgamma({a} + {b} + i_) - lgamma({a} + {b}) - lgamma({a} + 1 + i_) + lgamma({a} + 1) + i_ * ln({x}))))"
        return f"exp(lgamma({a} + {b}) - lgamma({a}) - lgamma({b}) + {a} * ln({x}) + {b} * ln(1 - ({x}))) / {a} * {terms}"

    return f"CASE WHEN {x} >= 1 THEN 1.0 WHEN {x} <= 0 THEN 0.0 WHEN {x} <= ({a} + 1) / ({a} + {b} + 2) THEN {series(a, b, x)} ELSE 1 - {series(b, a, f'(1 - {x})')} END"


def f_tail_sql(f: str, d1: str, d2: str) -> str:
    """P(F > f) in SQL; null for negative figures."""
    return f"CASE WHEN {f} >= 0 THEN {beta_sql(f'({d2} / 2.0)', f'({d1} / 2.0)', f'({d2} / ({d2} + {d1} * {f}))')} END"


def normal_tail_sql(z: str) -> str:
    """P(|Z| > |z|) in SQL: one less the series of the odd powers over the double factorials, times the density."""
    terms = f"list_sum(list_transform(range(0, 300), lambda i_: exp((2 * i_ + 1) * ln(abs({z})) - (i_ + 1) * ln(2) - lgamma(i_ + 1.5) + ln(pi()) / 2)))"
    return f"CASE WHEN {z} = 0 THEN 1.0 WHEN abs({z}) > 12 THEN 0.0 ELSE 1 - 2 * exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()) * {terms} END"


@book.query("flt28_rubric_a", "v_samples", sql=f"SELECT sample, {RUBRIC_A} AS diagnosis FROM v_samples")
def _(s):
    return s.select("sample", cohorts.rubric_a(*map(F.col, ("braak", "cerad", "mmse", "cogdx"))).alias("diagnosis"))


@book.query("flt29_rubric_b", "v_samples", sql=f"SELECT sample, {RUBRIC_B} AS diagnosis FROM v_samples WHERE {RUBRIC_B} IS NOT NULL")
def _(s):
    verdict = cohorts.rubric_b(*map(F.col, ("braak", "cerad", "cdr")))
    return cohorts.classified(s.withColumn("diagnosis", F.lit(None).cast("string")), "diagnosis", verdict).select("sample", "diagnosis")


@book.query("flt30_complete_cases", "v_samples", sql=f"SELECT sample, {AGE} AS age, pmi FROM v_samples WHERE {AGE} IS NOT NULL AND pmi IS NOT NULL AND grp IS NOT NULL")
def _(s):
    return cohorts.complete_cases(s.withColumn("age", cohorts.numeric_age(F.col("age_death"))), ["age", "pmi", "grp", "absent"]).select("sample", "age", "pmi")


@book.query("flt31_excluded_samples", "v_matrix", "v_samples", sql="SELECT feature, sample, value FROM v_matrix WHERE sample NOT IN (SELECT sample FROM v_samples WHERE pmi IS NULL)")
def _(m, s):
    return cohorts.without_samples(m, s.filter("pmi is null")).select("feature", "sample", "value")


@book.query("flt32_cell_family", "v_celltype", sql=f"SELECT row_id, {FAMILY} AS family FROM v_celltype")
def _(c):
    return c.select("row_id", cohorts.cell_family(F.col("celltype")).alias("family"))


@book.query("flt33_de_hits", "v_celltype", sql="SELECT row_id, 'significant' AS label, -logfc AS reversed FROM v_celltype WHERE p_adj_glb < 0.05 AND abs(logfc) > 1")
def _(c):
    return cohorts.de_hits(c, "p_adj_glb", "logfc").select("row_id", "label", "reversed")


@book.query(
    "flt34_selected_pairs", "v_evidence",
    sql="SELECT DISTINCT coalesce(nullif(trim(genomic_coordinates), ''), nullif(trim(gene_symbol), '')) AS smorf_id, trim(gene_id) AS main_id, gene_name AS main_gene FROM v_evidence WHERE coalesce(smorf_type NOT IN ('oORF', 'Iso'), true) AND gene_id LIKE 'ENSG%' AND gene_id NOT LIKE '%,%' AND coalesce(genomic_coordinates, gene_symbol) IS NOT NULL",
)
def _(v):
    named = v.withColumns({"parent": F.col("gene_id"), "coordinates": F.col("genomic_coordinates"), "symbol": F.col("gene_symbol")})
    return cohorts.selected_pairs(named, ["oORF", "Iso"])


@book.query("flt35_above_median", "v_matrix", sql="SELECT feature, sample, cpm FROM (SELECT *, value * 1e6 / sum(value) OVER (PARTITION BY sample) AS cpm FROM v_matrix) QUALIFY median(cpm) OVER (PARTITION BY feature) >= 2500")
def _(m):
    return matrices.above_median(matrices.per_million(m), 2500).select("feature", "sample", "cpm")


MATCHED = f"matched AS (SELECT c.row_id, {FAMILY.replace('celltype', 'trim(celltype)')} AS family, trim(celltype) AS celltype, logfc, p_adj_loc, p_adj_glb, v.row_id AS master_row, v.database, v.smorf_type, v.total_razor_spectral_counts, v.total_unique_spectral_counts FROM v_celltype c LEFT JOIN gated v ON c.gene = v.gene_name)"


def with_family(c):
    return c.withColumns({"family": cohorts.cell_family(F.trim("celltype")), "celltype": F.trim("celltype")})


def matched(c, v):
    """Cell rows and the master table's rows of their gene: what both need of the other columns is worked out before rows are multiplied."""
    master = evidence_gate(v).filter("database is not null").select(F.col("row_id").alias("master_row"), F.col("gene_name").alias("gene"))
    return merging.list_join(c, master, "gene")


@book.query("flt38_significant_rows", "v_celltype", "v_evidence", sql=f"WITH {FLAGS}, {MATCHED} SELECT row_id, master_row, family, celltype FROM matched WHERE p_adj_glb < 0.05 AND database IS NOT NULL")
def _(c, v):
    return matched(with_family(c).filter(F.col("p_adj_glb") < 0.05).select("row_id", "gene", "family", "celltype"), v).select("row_id", "master_row", "family", "celltype")


@book.query("flt39_family_volcano", "v_celltype", "v_evidence", sql=f"WITH {FLAGS}, {MATCHED} SELECT row_id, master_row, family, -log10(p_adj_loc) AS log10_padj FROM matched WHERE database IS NOT NULL")
def _(c, v):
    return matched(cohorts.family_volcano(c).select("row_id", "gene", "family", "log10_padj"), v).select("row_id", "master_row", "family", "log10_padj")


@book.query(
    "agg11_heat_map", "v_celltype", "v_evidence",
    sql=f"WITH {FLAGS}, {MATCHED} SELECT family, celltype, smorf_type, count(*) AS n, avg(logfc) AS log2fc, CASE WHEN smorf_type IN ('SwissProt', 'TrEMBL') THEN avg(total_razor_spectral_counts) ELSE avg(total_unique_spectral_counts) END AS counts FROM matched WHERE p_adj_glb < 0.05 GROUP BY 1, 2, 3",
)
def _(c, v):
    return cohorts.heat_map(with_family(c).filter(F.col("p_adj_glb") < 0.05), evidence_gate(v))


@book.query("src11_to_long", "lineitem", sql="SELECT l_orderkey, l_linenumber, 'l_quantity' AS sample, l_quantity AS value FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'l_tax', l_tax FROM lineitem")
def _(t):
    return matrices.to_long(t, ["l_orderkey", "l_linenumber"], ["l_quantity", "l_tax"])


@book.query("src12_to_wide", "v_matrix", "v_samples", sql="SELECT feature, sum(value) FILTER (grp = 'AD') AS \"AD\", sum(value) FILTER (grp = 'AsymAD') AS \"AsymAD\", sum(value) FILTER (grp = 'Control') AS \"Control\" FROM v_matrix JOIN v_samples USING (sample) GROUP BY feature")
def _(m, s):
    sums = m.join(s, "sample").groupBy("feature", "grp").agg(F.sum("value").alias("value"))
    return matrices.to_wide(sums, "feature", "grp", ["AD", "AsymAD", "Control"])


@book.query("agg8_per_million", "v_matrix", sql="SELECT feature, sample, value * 1e6 / sum(value) OVER (PARTITION BY sample) AS cpm FROM v_matrix")
def _(m):
    return matrices.per_million(m).select("feature", "sample", "cpm")


@book.query("agg9_row_medians", "v_matrix", sql="SELECT feature, median(value) AS median FROM v_matrix GROUP BY feature")
def _(m):
    return matrices.row_medians(m, "value")


@book.query("agg10_psm_counts", "v_matrix", sql="SELECT feature, sum(n_rows)::BIGINT AS psms FROM v_matrix GROUP BY feature")
def _(m):
    return matrices.summed(m, ["feature"], "n_rows", "psms")


@book.query("agg25_observed_share", "v_matrix", sql="SELECT feature, count(value) / (SELECT count(DISTINCT sample) FROM v_matrix)::DOUBLE AS share FROM v_matrix GROUP BY feature HAVING share >= 0.75")
def _(m):
    return matrices.observed_share(m, 0.75)


@book.query("jn7_stacked_batches", "v_matrix", "v_samples", sql="SELECT feature, 'b' || '.' || sample AS sample, value, 'b' AS round FROM v_matrix JOIN v_samples USING (sample) WHERE batch = 'b1' UNION ALL SELECT feature, 'c' || '.' || sample, value, 'c' FROM v_matrix JOIN v_samples USING (sample) WHERE batch <> 'b1'")
def _(m, s):
    both = m.join(s, "sample")
    part = lambda at: both.filter(at).select("feature", "sample", "value")
    return matrices.stacked({"b": part(F.col("batch") == "b1"), "c": part(F.col("batch") != "b1")}, "round").select("feature", "sample", "value", "round")


@book.query("jn8_two_rounds", "v_matrix", "v_samples", sql="SELECT feature, sum(value) FILTER (batch IN ('b1', 'b2')) AS round1, sum(value) FILTER (batch NOT IN ('b1', 'b2')) AS round2 FROM v_matrix JOIN v_samples USING (sample) GROUP BY feature")
def _(m, s):
    both = m.join(s, "sample")
    first = both.filter(F.col("batch").isin("b1", "b2")).groupBy("feature").agg(F.sum("value").alias("round1"))
    second = both.filter(~F.col("batch").isin("b1", "b2")).groupBy("feature").agg(F.sum("value").alias("round2"))
    return first.join(second, "feature", "full_outer")


@book.query("jn12_with_covariates", "v_matrix", "v_samples", sql=f"SELECT feature, sample, value, grp, {AGE} AS age FROM v_matrix JOIN v_samples USING (sample)")
def _(m, s):
    return m.join(s, "sample").select("feature", "sample", "value", "grp", cohorts.numeric_age(F.col("age_death")).alias("age"))


@book.query("jn13_aligned", "v_matrix", "v_samples", sql="SELECT feature, sample FROM v_matrix WHERE sample IN (SELECT sample FROM v_samples WHERE sex = 'F')")
def _(m, s):
    return matrices.aligned(m, s.filter("sex = 'F'"))[0].select("feature", "sample")


@book.query("agg16_group_intervals", "v_matrix", "v_samples", sql="SELECT feature, grp, avg(value) AS mean, stddev_samp(value) / sqrt(count(value)) AS sem, avg(value) - 1.96 * stddev_samp(value) / sqrt(count(value)) AS lower, avg(value) + 1.96 * stddev_samp(value) / sqrt(count(value)) AS upper FROM v_matrix JOIN v_samples USING (sample) GROUP BY 1, 2")
def _(m, s):
    return matrices.group_intervals(m.join(s, "sample"), ["feature", "grp"])


@book.query("agg19_filled", "v_samples", sql="SELECT sample, coalesce(pmi, (SELECT max(pmi) FROM v_samples)) AS pmi, (pmi IS NULL)::INT AS pmi_missing, coalesce(mmse, (SELECT avg(mmse) FROM v_samples)) AS mmse FROM v_samples")
def _(s):
    return matrices.filled(s, {"pmi": F.max("pmi"), "mmse": F.avg("mmse")}).select("sample", "pmi", "pmi_missing", "mmse")


@book.query("agg20_varying", "v_matrix", "v_samples", sql="SELECT feature, sample, value FROM v_matrix JOIN v_samples USING (sample) WHERE batch = 'b1' QUALIFY var_samp(value) OVER (PARTITION BY feature) > 0")
def _(m, s):
    return matrices.varying(m.join(s.filter("batch = 'b1'"), "sample")).select("feature", "sample", "value")


@book.query("rnk13_top_rows_centred", "v_matrix", sql="WITH t AS (SELECT feature FROM v_matrix GROUP BY feature ORDER BY var_samp(value) DESC, feature LIMIT 50) SELECT feature, sample, value - avg(value) OVER (PARTITION BY feature) AS centred FROM v_matrix WHERE feature IN (SELECT feature FROM t)")
def _(m):
    top = matrices.top_rows(m.groupBy("feature").agg(F.round(F.var_samp("value"), 9).alias("v")), F.desc("v"), 50).select("feature")
    return matrices.centred(m.join(top, "feature", "left_semi")).select("feature", "sample", "centred")


@book.query("scl17_logs", "v_matrix", sql="SELECT feature, sample, log10(value + 0.1) AS tenth, log10(value + 0.01) AS hundredth, greatest(least(log10(value), 2), 1) AS squished FROM v_matrix")
def _(m):
    return m.select("feature", "sample", F.log10(F.col("value") + 0.1).alias("tenth"), F.log10(F.col("value") + 0.01).alias("hundredth"), F.greatest(F.least(F.log10("value"), F.lit(2.0)), F.lit(1.0)).alias("squished"))


@book.query("scl18_normal_cdf", "v_samples", sql=f"SELECT sample, (1 + sign(rin) * (1 - ({normal_tail_sql('rin')}))) / 2 AS probability FROM v_samples")
def _(s):
    return s.select("sample", dist.normal_cdf(F.col("rin")).alias("probability"))


@book.query("scl19_rounding", "v_matrix", sql="SELECT feature, sample, round(value / 7, 2) AS two, round(value / 7, 4) AS four, printf('%.2f', value) AS shown FROM v_matrix")
def _(m):
    return m.select("feature", "sample", F.round(F.col("value") / 7, 2).alias("two"), F.round(F.col("value") / 7, 4).alias("four"), F.format_string("%.2f", F.col("value")).alias("shown"))


def grouped(m, s):
    return m.join(s.select("sample", "grp"), "sample")


G = "g AS (SELECT feature, grp, count(*) AS n, avg(value) AS m, coalesce(var_samp(value), 0) AS v FROM v_matrix JOIN v_samples USING (sample) GROUP BY 1, 2)"


@book.query(
    "sta1_t_test", "v_matrix", "v_samples",
    sql=f"WITH {G} SELECT coalesce(a.feature, b.feature) AS feature, a.m - b.m AS estimate, (a.m - b.m) / nullif(sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / nullif(a.n + b.n - 2, 0) * (1.0 / a.n + 1.0 / b.n)), 0) AS t, a.n + b.n - 2 AS df FROM (SELECT * FROM g WHERE grp = 'AD') a FULL JOIN (SELECT * FROM g WHERE grp = 'Control') b ON a.feature = b.feature",
)
def _(m, s):
    return testing.t_test(grouped(m, s), "AD", "Control", with_p=False)


@book.query("sta2_anova", "v_matrix", "v_samples", sql=f"WITH {G}, w AS (SELECT feature, count(*) AS k, sum(n) AS n, sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n) AS b, sum((n - 1) * v) AS w FROM g GROUP BY 1) SELECT feature, k AS groups, n::BIGINT AS n, (b / (k - 1)) / (w / (n - k)) AS f FROM w")
def _(m, s):
    return testing.anova(grouped(m, s), with_p=False).select("feature", "groups", "n", "f")


@book.query("sta3_tukey", "v_matrix", "v_samples")
def _(m, s):
    return testing.adjusted(testing.tukey(grouped(m, s)))


@book.query(
    "sta3_two_groups", "v_matrix", "v_samples",
    sql=f"""WITH {G}, d AS (SELECT feature, b.m - a.m AS difference, a.n + b.n - 2 AS df, (b.m - a.m) / nullif(sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / nullif(a.n + b.n - 2, 0) * (1.0 / a.n + 1.0 / b.n)), 0) AS t
        FROM (SELECT * FROM g WHERE grp = 'AD') a JOIN (SELECT * FROM g WHERE grp = 'Control') b USING (feature)),
    e AS (SELECT *, {f_tail_sql('(t * t)', '1', 'df')} AS p FROM d)
    SELECT feature, difference, round(abs(t) * sqrt(2), 6) AS q, round(p, 6) AS p, CASE WHEN abs(p - 0.05) > 1e-9 THEN p < 0.05 END AS excludes_zero FROM e""",
)
def _(m, s):
    """With two groups the studentised range is a t test, and an interval leaves zero out where its p is below 0.05."""
    out = testing.tukey(grouped(m, s.filter(F.col("grp").isin(*GROUPS))))
    apart = F.when(F.abs(F.col("p") - 0.05) > 1e-9, (F.col("lower") > 0) | (F.col("upper") < 0))
    return out.select("feature", "difference", F.round("q", 6).alias("q"), F.round("p", 6).alias("p"), apart.alias("excludes_zero"))


@book.query("sta4_regressed", "v_matrix", "v_samples")
def _(m, s):
    known = s.withColumns({"age": F.coalesce(cohorts.numeric_age(F.col("age_death")), F.lit(75.0)), "male": (F.col("sex") == "M").cast("double"), "pmi": F.coalesce("pmi", F.lit(10.0))})
    return testing.regressed(m.join(known, "sample").select("feature", "sample", "value", "age", "male", "pmi", "grp"), ["age", "male", "pmi"], "grp", ["age", "male", "pmi"])


@book.query("sta5_median_polish", "v_matrix", "v_samples")
def _(m, s):
    return matrices.median_polish(m.select("feature", "sample", "value"), s.select("sample", "batch", "grp"), F.col("grp") == "Control")


@book.query("sta6_outlying_samples", "v_matrix")
def _(m):
    return testing.outlying_samples(m.select("feature", "sample", "value"))


FACTORS = "f AS (SELECT sample, exp(median(ln(value) - mean)) AS size_factor FROM v_matrix JOIN (SELECT feature, avg(ln(value)) AS mean FROM v_matrix GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT sample) FROM v_matrix)) USING (feature) GROUP BY 1)"
# features are summed over 20 residues, so that some have counts in all samples
DENSE = "d AS (SELECT 'F' || CAST(CAST(substr(feature, 2) AS BIGINT) % 20 AS VARCHAR) AS feature, sample, sum(value) AS value FROM v_matrix GROUP BY 1, 2)"


def dense(m):
    return m.groupBy(F.concat(F.lit("F"), (F.substring("feature", 2, 9).cast("long") % 20).cast("string")).alias("feature"), "sample").agg(F.sum("value").alias("value"))


@book.query("sta7_size_factors", "v_matrix", sql=f"WITH {DENSE}, {FACTORS.replace('v_matrix', 'd')} SELECT feature, sum(value / size_factor) / (SELECT count(DISTINCT sample) FROM d) AS base_mean FROM d JOIN f USING (sample) GROUP BY 1")
def _(m):
    d = dense(m)
    return matrices.base_means(d, matrices.size_factors(d))


@book.query("sta8_count_tests", "v_matrix", "v_samples")
def _(m, s):
    return testing.adjusted(testing.count_tests(m, matrices.size_factors(dense(m)), s, ["rin"], "grp", "Control", "AD"))


@book.query(
    "sta9_stabilised", "v_matrix", "v_samples",
    sql=f"""WITH {DENSE}, {FACTORS.replace('v_matrix', 'd')}, c AS (SELECT f.* FROM f JOIN v_samples USING (sample) WHERE grp IN ('Control', 'AD') AND rin IS NOT NULL),
    z AS (SELECT count(*) AS n, avg(1 / size_factor) AS inverse FROM c),
    m AS (SELECT feature, s1 / n AS mean, CASE WHEN n > 1 THEN greatest(s2 - s1 * s1 / n, 0) / (n - 1) ELSE 0 END AS var, inverse FROM (SELECT feature, sum(value / size_factor) AS s1, sum((value / size_factor) ** 2) AS s2 FROM d JOIN c USING (sample) GROUP BY 1), z),
    p AS (SELECT 1 / mean AS x, greatest((var - mean * inverse) / (mean * mean), 1e-8) AS a FROM m WHERE mean > 0),
    s AS (SELECT greatest(covar_pop(x, a) / nullif(var_pop(x), 0), 1e-8) AS a1, avg(a) AS a, avg(x) AS x FROM p),
    t AS (SELECT greatest(a - a1 * x, 1e-4) AS a0, a1 FROM s)
    SELECT feature, sample, log2((1 + a1 + 2 * a0 * q + 2 * sqrt(a0 * q * (1 + a1 + a0 * q))) / (4 * a0)) AS value FROM (SELECT feature, sample, value / size_factor AS q FROM d JOIN f USING (sample)), t""",
)
def _(m, s):
    d = dense(m)
    factors = matrices.size_factors(d)
    design = testing.count_design(factors, s, ["rin"], "grp", "Control", "AD")
    return testing.stabilised(d, factors, testing.dispersion_trend(testing.dispersions(d, design, 3)))


def projected(value: str, on: str) -> str:
    return f"{on} * (sum({value} * {on}) OVER w / sum({on} * {on}) OVER w)"


# the centred columns made orthogonal one after another, the group first; then the coefficients from the last to the first
@book.query(
    "sta10_without_effects", "v_matrix", "v_samples",
    sql=f"""WITH {DENSE}, x AS (SELECT feature, sample, value AS y, (sex = 'M')::DOUBLE AS a, (batch = 'b2')::DOUBLE AS b, rin AS c, (grp = 'AD')::DOUBLE AS k FROM d JOIN v_samples USING (sample) WHERE rin IS NOT NULL),
    z AS (SELECT feature, sample, y, a - avg(a) OVER w AS a, b - avg(b) OVER w AS b, c - avg(c) OVER w AS c, k - avg(k) OVER w AS k FROM x WINDOW w AS (PARTITION BY feature)),
    p1 AS (SELECT *, a - {projected('a', 'k')} AS qa FROM z WINDOW w AS (PARTITION BY feature)),
    p2 AS (SELECT *, b - {projected('b', 'k')} - {projected('b', 'qa')} AS qb FROM p1 WINDOW w AS (PARTITION BY feature)),
    p3 AS (SELECT *, c - {projected('c', 'k')} - {projected('c', 'qa')} - {projected('c', 'qb')} AS qc FROM p2 WINDOW w AS (PARTITION BY feature)),
    e AS (SELECT feature, sum(y * qc) / sum(qc * qc) AS ec, sum(y * qb) / sum(qb * qb) AS yb, sum(c * qb) / sum(qb * qb) AS cb, sum(y * qa) / sum(qa * qa) AS ya, sum(b * qa) / sum(qa * qa) AS ba, sum(c * qa) / sum(qa * qa) AS ca FROM p3 GROUP BY 1)
    SELECT feature, sample, y - a * (ya - ba * (yb - cb * ec) - ca * ec) - b * (yb - cb * ec) - c * ec AS value FROM p3 JOIN e USING (feature)""",
)
def _(m, s):
    known = s.withColumns({"male": (F.col("sex") == "M").cast("double"), "second": (F.col("batch") == "b2").cast("double"), "ad": (F.col("grp") == "AD").cast("double")})
    return testing.without_effects(dense(m), known, ["male", "second", "rin"], ["ad"])


PAIRS = """pairs AS (SELECT DISTINCT feature AS smorf_id, 'F' || CAST((CAST(substr(feature, 2) AS BIGINT) * 7 + 1) % 400 AS VARCHAR) AS main_id FROM v_matrix),
pv AS (SELECT smorf_id, main_id, y.sample, grp, x.value AS x, y.value AS y FROM pairs JOIN v_matrix y ON y.feature = smorf_id JOIN v_matrix x ON x.feature = main_id AND x.sample = y.sample JOIN v_samples s ON s.sample = y.sample)"""
R = "r AS (SELECT smorf_id, main_id, CASE WHEN min(x) FILTER (grp = 'Control') < max(x) FILTER (grp = 'Control') AND min(y) FILTER (grp = 'Control') < max(y) FILTER (grp = 'Control') THEN corr(y, x) FILTER (grp = 'Control') END AS r1, CASE WHEN min(x) FILTER (grp = 'AD') < max(x) FILTER (grp = 'AD') AND min(y) FILTER (grp = 'AD') < max(y) FILTER (grp = 'AD') THEN corr(y, x) FILTER (grp = 'AD') END AS r2, count(*) FILTER (grp = 'Control') AS n1, count(*) FILTER (grp = 'AD') AS n2 FROM pv GROUP BY 1, 2)"


def paired(m, s):
    pairs = m.select(F.col("feature").alias("smorf_id")).distinct()
    pairs = pairs.withColumn("main_id", F.concat(F.lit("F"), ((F.substring("smorf_id", 2, 9).cast("long") * 7 + 1) % 400).cast("string")))
    return testing.paired_values(m, pairs, s)


@book.query("jn14_paired_values", "v_matrix", "v_samples", sql=f"WITH {PAIRS} SELECT * FROM pv")
def _(m, s):
    return paired(m, s).select("smorf_id", "main_id", "sample", "grp", "x", "y")


@book.query("agg15_coexpression", "v_matrix", "v_samples", sql=f"WITH {PAIRS}, {R} SELECT smorf_id, main_id, r1 AS r_group1, r2 AS r_group2, r2 - r1 AS delta_r, CASE WHEN abs(r2 - r1) > 0.1 THEN 'non_coupled' ELSE 'coupled' END AS route FROM r WHERE n1 >= 3 AND n2 >= 3 AND r1 IS NOT NULL AND r2 IS NOT NULL AND NOT isnan(r1) AND NOT isnan(r2)")
def _(m, s):
    return testing.coexpression(paired(m, s), GROUPS)


@book.query("sta11_fisher_z", "v_matrix", "v_samples", sql=f"WITH {PAIRS}, {R} SELECT smorf_id, main_id, CASE WHEN abs(r1) < 1 AND abs(r2) < 1 THEN abs(atanh(r1) - atanh(r2)) END / sqrt(1.0 / nullif(n1 - 3, 0) + 1.0 / nullif(n2 - 3, 0)) AS fisher_z FROM r WHERE n1 >= 3 AND n2 >= 3 AND NOT isnan(r1) AND NOT isnan(r2) AND smorf_id <> main_id")
def _(m, s):
    return testing.nested_models(paired(m, s), GROUPS, with_p=False).filter("smorf_id <> main_id").select("smorf_id", "main_id", "fisher_z")


SUMS = """g AS (SELECT smorf_id, main_id, grp, count(*) AS n, avg(x) AS mx, avg(y) AS my, count(*) * var_pop(x) AS sxx, count(*) * var_pop(y) AS syy, count(*) * covar_pop(x, y) AS sxy FROM pv WHERE grp IN ('Control', 'AD') GROUP BY ALL),
    o AS (SELECT smorf_id, main_id, count(*) AS n, count(*) * var_pop(x) AS sxx, count(*) * var_pop(y) AS syy, count(*) * covar_pop(x, y) AS sxy FROM pv WHERE grp IN ('Control', 'AD') GROUP BY ALL),
    j AS (SELECT o.*, a.n AS n1, b.n AS n2, b.mx - a.mx AS gx, b.my - a.my AS gy, a.sxx + b.sxx AS wxx, a.sxy + b.sxy AS wxy, a.syy + b.syy AS wyy, b.sxy / b.sxx - a.sxy / a.sxx AS bi, a.sxx AS ax, b.sxx AS bx, a.syy - a.sxy * a.sxy / a.sxx + b.syy - b.sxy * b.sxy / b.sxx AS ri
        FROM o JOIN g a ON a.smorf_id = o.smorf_id AND a.grp = 'Control' JOIN g b ON b.smorf_id = o.smorf_id AND b.grp = 'AD' WHERE a.n >= 3 AND b.n >= 3 AND a.sxx > 1e-12 AND b.sxx > 1e-12 AND a.syy > 1e-12 AND b.syy > 1e-12)"""


@book.query(
    "sta12_nested_models", "v_matrix", "v_samples",
    sql=f"""WITH {PAIRS}, {SUMS}
    SELECT smorf_id, main_id, round((syy - sxy * sxy / sxx - (wyy - wxy * wxy / wxx)) / ((wyy - wxy * wxy / wxx) / (n - 3)), 4) AS add_f, CASE WHEN ri > 0 THEN round((wyy - wxy * wxy / wxx - ri) / (ri / (n - 4)), 4) END AS int_f, round(gy - wxy / wxx * gx, 4) AS add_b,
        round(sqrt((wyy - wxy * wxy / wxx) / (n - 3) * (1.0 / n1 + 1.0 / n2 + gx * gx / wxx)), 4) AS add_se, round(bi, 4) AS int_b, round(sqrt(ri / (n - 4) * (1 / ax + 1 / bx)), 4) AS int_se FROM j WHERE smorf_id <> main_id""",
)
def _(m, s):
    out = testing.nested_models(paired(m, s), GROUPS, with_p=False).filter("smorf_id <> main_id")
    return out.select("smorf_id", "main_id", *(F.round(c, 4).alias(c) for c in ("add_f", "int_f", "add_b", "add_se", "int_b", "int_se")))


@book.query(
    "sta12_model_p_values", "v_matrix", "v_samples",
    sql=f"""WITH {PAIRS}, {R}, {SUMS}, k AS (SELECT *, wyy - wxy * wxy / wxx AS ra FROM j), h AS (SELECT k.*, abs(atanh(r1) - atanh(r2)) / sqrt(1.0 / nullif(k.n1 - 3, 0) + 1.0 / nullif(k.n2 - 3, 0)) AS z,
        greatest((syy - sxy * sxy / sxx - ra) / (ra / (n - 3)), 0) AS fa, CASE WHEN ri > 0 AND n > 4 THEN greatest((ra - ri) / (ri / (n - 4)), 0) END AS fi FROM k JOIN (SELECT smorf_id, main_id, CASE WHEN abs(r1) < 1 THEN r1 END AS r1, CASE WHEN abs(r2) < 1 THEN r2 END AS r2 FROM r) USING (smorf_id, main_id))
    SELECT smorf_id, main_id, round({f_tail_sql('fa', '1', '(n - 3)')}, 6) AS add_p, round({f_tail_sql('fi', '1', '(n - 4)')}, 6) AS int_p, round({normal_tail_sql('z')}, 6) AS fisher_p FROM h""",
)
def _(m, s):
    out = testing.nested_models(paired(m, s), GROUPS).select("smorf_id", "main_id", *(F.round(c, 6).alias(c) for c in ("add_p", "int_p", "fisher_p")))
    return out.orderBy("fisher_p", "add_p")


@book.query("sta13_scaled", "v_samples", sql=f"SELECT sample, ({AGE} - (SELECT avg({AGE}) FROM v_samples)) / (SELECT stddev_samp({AGE}) FROM v_samples) AS age, (rin - (SELECT avg(rin) FROM v_samples)) / (SELECT stddev_samp(rin) FROM v_samples) AS rin FROM v_samples")
def _(s):
    return cohorts.scaled(s.withColumn("age", cohorts.numeric_age(F.col("age_death"))), ["age", "rin"]).select("sample", "age", "rin")


@book.query("sta14_correlated_with", "v_matrix", sql="SELECT a.feature, corr(a.value, b.value) AS correlation, abs(corr(a.value, b.value)) AS abs_corr FROM v_matrix a JOIN v_matrix b ON a.sample = b.sample AND b.feature = 'F7' AND a.feature <> 'F7' GROUP BY 1 HAVING correlation IS NOT NULL AND NOT isnan(correlation)")
def _(m):
    return testing.correlated_with(m, "F7")


@book.query(
    "sta15_p_values", "v_matrix", "v_samples",
    sql=f"""WITH {G}, a AS (SELECT coalesce(x.feature, y.feature) AS feature, x.n + y.n - 2 AS df, (x.m - y.m) / nullif(sqrt(((x.n - 1) * x.v + (y.n - 1) * y.v) / nullif(x.n + y.n - 2, 0) * (1.0 / x.n + 1.0 / y.n)), 0) AS t FROM (SELECT * FROM g WHERE grp = 'AD') x FULL JOIN (SELECT * FROM g WHERE grp = 'Control') y ON x.feature = y.feature),
    w AS (SELECT feature, count(*) - 1 AS d1, sum(n) - count(*) AS d2, sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n) AS b, sum((n - 1) * v) AS w FROM g GROUP BY 1),
    f AS (SELECT feature, d1, d2, CASE WHEN d1 > 0 AND d2 > 0 AND w > 0 THEN (b / d1) / (w / d2) END AS f FROM w)
    SELECT feature, round({f_tail_sql('(t * t)', '1', 'df')}, 6) AS t_p, round({f_tail_sql('f', 'd1', 'd2')}, 6) AS f_p FROM a JOIN f USING (feature)""",
)
def _(m, s):
    t = testing.t_test(grouped(m, s), "AD", "Control").select("feature", F.round("p", 6).alias("t_p"))
    return t.join(testing.anova(grouped(m, s)).select("feature", F.round("p", 6).alias("f_p")), "feature")


@book.query("rnk10_adjusted", "v_celltype", sql="SELECT row_id, CASE WHEN p_adj_glb IS NOT NULL THEN least(min(raw) OVER (ORDER BY p_adj_glb DESC), 1) END AS q_value FROM (SELECT *, p_adj_glb * count(p_adj_glb) OVER () / (rank() OVER (ORDER BY p_adj_glb) + count(*) OVER (PARTITION BY p_adj_glb) - 1) AS raw FROM v_celltype) WHERE p_adj_glb IS NOT NULL UNION ALL SELECT row_id, NULL FROM v_celltype WHERE p_adj_glb IS NULL")
def _(c):
    return testing.adjusted(c, "p_adj_glb").select("row_id", "q_value")


@book.query("srt3_by_q_then_p", "v_celltype", sql="SELECT row_id, p_adj_glb, p_adj_loc FROM v_celltype")
def _(c):
    return c.select("row_id", "p_adj_glb", "p_adj_loc").orderBy(F.col("p_adj_glb").asc_nulls_last(), F.col("p_adj_loc").asc_nulls_last(), "row_id")


@book.query("srt5_category_order", "v_celltype", sql="SELECT row_id, list_position(['Immune', 'Oli', 'Vas'], family) AS place FROM (SELECT row_id, " + FAMILY + " AS family FROM v_celltype) WHERE family IN ('Immune', 'Oli', 'Vas')")
def _(c):
    wanted = F.lit(["Immune", "Oli", "Vas"])
    placed = c.select("row_id", F.array_position(wanted, cohorts.cell_family(F.col("celltype"))).cast("int").alias("place"))
    return placed.filter("place > 0").orderBy("place", "row_id")
