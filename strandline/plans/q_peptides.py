"""Queries of peptides and spectra."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import spectra as sp
from strandline.operators import peptides as pep
from strandline.plans.fixtures import Book
from strandline.plans.q_facets import DECODED

book = Book()
QUERIES, ORACLES = book.queries, book.oracles
PPM = 2000.0


@book.query("scl6_listed_peptides", "v_lists", sql=f"SELECT event_id, trim(p) AS peptide FROM (SELECT event_id, unnest(CASE WHEN event_id % 6 = 5 THEN [CAST(event_id % 4 AS VARCHAR), CAST(user_id AS VARCHAR)] ELSE {DECODED} END) AS p FROM v_lists) WHERE p IS NOT NULL AND p <> 'nan'")
def _(v):
    return pep.listed_peptides(v, "event_id", "list_text")


@book.query("agg1_protein_rollup", "v_psm", sql="SELECT peptide, sum(spectral_count)::BIGINT AS spectral_count, string_agg(DISTINCT coalesce(nullif(modified_peptide, ''), 'BLANK'), ';' ORDER BY coalesce(nullif(modified_peptide, ''), 'BLANK')) AS modified_peptide FROM v_psm GROUP BY 1")
def _(v):
    return pep.protein_rollup(v, "peptide", ["spectral_count"], "modified_peptide")


@book.query("agg2_spectral_counts", "v_psm", sql="SELECT peptide, sum(spectral_count)::BIGINT AS global_count, sum(spectral_count) = 1 AS is_one_hit FROM v_psm GROUP BY 1")
def _(v):
    return pep.spectral_counts(v)


CANDIDATES = r"""c1 AS (SELECT *, coalesce(modified_peptide LIKE 'n[43]%', false) AS acetyl, coalesce(purity >= 0.5, false) AS pure FROM v_psm),
c2 AS (SELECT *, bool_or(NOT acetyl) OVER (PARTITION BY peptide) AS any_plain, bool_or(acetyl) OVER (PARTITION BY peptide) AS any_acetyl FROM c1),
c3 AS (SELECT *, bool_or(pure) OVER (PARTITION BY peptide) AS any_pure, row_number() OVER (PARTITION BY peptide ORDER BY hyperscore DESC NULLS LAST, psm_id) AS place FROM c2 WHERE NOT any_plain OR NOT acetyl),
c4 AS (SELECT *, first_value(charge) OVER w AS c0, first_value(modified_peptide) OVER w AS m0 FROM c3 WHERE CASE WHEN any_pure THEN pure ELSE place = 1 END WINDOW w AS (PARTITION BY peptide ORDER BY hyperscore DESC NULLS LAST, psm_id)),
cand AS (SELECT *, any_plain AND any_acetyl AS acetyl_rescued, row_number() OVER (PARTITION BY peptide ORDER BY hyperscore DESC NULLS LAST, psm_id) AS candidate_rank FROM c4 WHERE charge = c0 AND modified_peptide = m0)"""


@book.query("rnk3_candidates", "v_psm", sql=f"WITH {CANDIDATES} SELECT psm_id, peptide, candidate_rank, acetyl_rescued FROM cand WHERE candidate_rank <= 5")
def _(v):
    return pep.candidates(v, "psm_id").select("psm_id", "peptide", "candidate_rank", "acetyl_rescued")


@book.query("rnk4_primary", "v_psm", sql=f"WITH {CANDIDATES} SELECT psm_id, peptide, CASE WHEN batch LIKE 'round2/%' THEN 2 ELSE 1 END AS round FROM cand WHERE candidate_rank = 1 AND modified_peptide NOT LIKE 'n[43]%'")
def _(v):
    return pep.primary(pep.candidates(v, "psm_id")).select("psm_id", "peptide", pep.round_of(F.col("batch")).alias("round"))


@book.query("srt4_top_candidates", "v_psm", sql="SELECT psm_id, hyperscore FROM v_psm ORDER BY hyperscore DESC, psm_id LIMIT 20")
def _(v):
    return v.select("psm_id", "hyperscore").orderBy(F.desc("hyperscore"), "psm_id").limit(20)  # a top list


@book.query(
    "rnk12_stratified", "v_psm",
    sql="""WITH s AS (SELECT *, row_number() OVER (ORDER BY psm_id) AS p, 0 AS s FROM v_psm WHERE modified_peptide LIKE '%[147]%' QUALIFY p <= 5
        UNION ALL SELECT *, row_number() OVER (ORDER BY psm_id) AS p, 1 FROM v_psm WHERE batch LIKE 'round2/%' QUALIFY p <= 5 UNION ALL SELECT *, row_number() OVER (ORDER BY psm_id) AS p, 2 FROM v_psm WHERE spectral_count = 1 QUALIFY p <= 5)
    SELECT psm_id, peptide FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY peptide ORDER BY s, p) = 1) ORDER BY s, p LIMIT 12""",
)
def _(v):
    strata = [(F.col("modified_peptide").contains("[147]"), 5), (F.col("batch").startswith("round2/"), 5), (F.col("spectral_count") == 1, 5)]
    return pep.stratified(v, strata, ["psm_id"], "peptide", 12).select("psm_id", "peptide")


NOTATION = "CASE WHEN modified_peptide IS NULL OR modified_peptide LIKE 'n[43]%' THEN NULL WHEN modified_peptide LIKE 'n[230]%' THEN '[UNIMOD:737]-PEM[UNIMOD:35]C[UNIMOD:4]K[UNIMOD:737]' ELSE '[UNIMOD:737]-PEPC[UNIMOD:4]K[UNIMOD:737]' END"


@book.query("scl7_library_notation", "v_psm", sql=f"SELECT psm_id, {NOTATION} AS notation FROM v_psm")
def _(v):
    return v.select("psm_id", sp.library_notation(F.col("modified_peptide")).alias("notation"))


@book.query("flt36_predictable", "v_psm", sql="SELECT psm_id, modified_peptide IS NOT NULL AND modified_peptide NOT LIKE 'n[43]%' AS valid FROM v_psm")
def _(v):
    return v.select("psm_id", sp.is_predictable(sp.library_notation(F.col("modified_peptide"))).alias("valid"))


@book.query("scl9_spectrum_id", "v_psm", sql="SELECT psm_id, split_part(spectrum, '.', 1) AS file, CAST(split_part(spectrum, '.', 2) AS BIGINT) AS scan FROM v_psm")
def _(v):
    at = sp.spectrum_id(F.col("spectrum"))
    return v.select("psm_id", at["file"].alias("file"), at["scan"].alias("scan"))


#: Predicted peaks of a vector and observed peaks of the three after it: place and value become m/z and intensity.
PEAKS = """p AS (SELECT vec_id, label % 3 + 2 AS charge, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS e FROM v_peaks),
pred AS (SELECT vec_id, charge, i, 100 + 10 * i + e AS mz, abs(e) AS intensity, CASE WHEN i % 5 = 4 THEN 'x' WHEN i % 2 = 0 THEN 'b' || (1 + i % 12)::VARCHAR || '+' || (1 + i % 3)::VARCHAR ELSE 'y' || (1 + i % 12)::VARCHAR || '+' || (1 + i % 3)::VARCHAR END AS annotation, i % 5 = 4 OR 1 + i % 3 < charge AS possible FROM p),
kept AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY i) - 1 AS k FROM pred WHERE possible),
obs AS (SELECT vec_id, i, 100 + 10 * i + e * 2 AS mz, abs(e) AS intensity FROM p WHERE NOT 100 + 10 * i + e * 2 BETWEEN 125.5 AND 131.5),
near AS (SELECT a.vec_id, c.vec_id AS obs_id, a.k, a.annotation, a.intensity AS pi, o.intensity AS oi, a.mz, o.mz AS omz, o.i AS oi_place, abs(o.mz - a.mz) AS off
    FROM kept a JOIN (SELECT DISTINCT vec_id FROM obs) c ON c.vec_id > a.vec_id AND c.vec_id <= a.vec_id + 3 JOIN obs o ON o.vec_id = c.vec_id
    QUALIFY row_number() OVER (PARTITION BY a.vec_id, c.vec_id, a.k ORDER BY abs(o.mz - a.mz), o.i) = 1),
m AS (SELECT * FROM near WHERE off <= mz * 2000 / 1e6 QUALIFY row_number() OVER (PARTITION BY vec_id, obs_id, oi_place ORDER BY k) = 1),
pairs AS (SELECT a.vec_id, b.vec_id AS obs_id FROM v_peaks a JOIN v_peaks b ON b.vec_id > a.vec_id AND b.vec_id <= a.vec_id + 3),
sites AS (SELECT vec_id, obs_id, count(DISTINCT CASE WHEN annotation LIKE 'b%' THEN split_part(substr(annotation, 2), '+', 1)::INT WHEN annotation LIKE 'y%' THEN 13 - split_part(substr(annotation, 2), '+', 1)::INT END) AS n_cleavages, count(*) AS n_matched,
    degrees(acos(greatest(least(sum(pi * oi) / (sqrt(sum(pi * pi)) * sqrt(sum(oi * oi))), 1), -1))) AS degrees FROM m GROUP BY 1, 2),
scores AS (SELECT pairs.vec_id, pairs.obs_id, coalesce(n_cleavages, 0) AS n_cleavages, coalesce(n_matched, 0) AS n_matched, coalesce(degrees, 90) AS degrees FROM pairs LEFT JOIN sites ON sites.vec_id = pairs.vec_id AND sites.obs_id = pairs.obs_id),
best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY n_cleavages DESC, round(degrees, 9), n_matched DESC, obs_id) = 1),
rated AS (SELECT *, CASE WHEN degrees <= 20 THEN 'High' WHEN degrees <= 45 THEN 'Moderate' WHEN degrees <= 70 THEN 'Poor' ELSE 'Terrible' END AS sa_rating, CASE WHEN 100.0 * n_cleavages / 12 <= 25 THEN 'Sparse' WHEN 100.0 * n_cleavages / 12 <= 50 THEN 'Partial' ELSE 'Majority' END AS match_coverage FROM best),
final AS (SELECT *, CASE sa_rating WHEN 'High' THEN CASE WHEN match_coverage = 'Sparse' THEN 'Moderate' ELSE 'Strong' END WHEN 'Moderate' THEN CASE WHEN match_coverage = 'Sparse' THEN 'Weak' ELSE 'Moderate' END WHEN 'Poor' THEN CASE WHEN match_coverage = 'Majority' THEN 'Weak' ELSE 'Insufficient' END ELSE 'Insufficient' END AS confidence FROM rated)"""


def spectra(v):
    def mz(x, i, factor):
        return 100 + 10 * i + x.cast("double") * factor

    kind = lambda i: F.when(i % 5 == 4, "x").otherwise(F.concat(F.when(i % 2 == 0, "b").otherwise("y"), (1 + i % 12).cast("string"), F.lit("+"), (1 + i % 3).cast("string")))
    predicted = F.transform("embedding", lambda x, i: F.struct(mz(x, i, 1.0).alias("mz"), F.abs(x.cast("double")).alias("intensity"), kind(i).alias("annotation")))
    observed = F.transform("embedding", lambda x, i: F.struct(mz(x, i, 2.0).alias("mz"), F.abs(x.cast("double")).alias("intensity"), F.lit("").alias("annotation")))
    return v.select("vec_id", (F.col("label") % 3 + 2).alias("charge"), predicted.alias("predicted"), observed.alias("observed"))


def scored_pairs(v):
    s = spectra(v)
    wanted = s.select("vec_id", "charge", "predicted", F.explode(F.sequence(F.col("vec_id") + 1, F.col("vec_id") + 3)).alias("obs_id"))
    both = wanted.join(s.select(F.col("vec_id").alias("obs_id"), "observed"), "obs_id").withColumn("length", F.lit(13))
    return pep.scored(both, PPM)


@book.query("scl8_ions", "v_peaks", sql=f"WITH {PEAKS} SELECT vec_id, i, CASE WHEN annotation <> 'x' THEN left(annotation, 1) END AS kind, CASE WHEN annotation <> 'x' THEN 1 + i % 12 END AS ordinal, CASE WHEN annotation <> 'x' THEN 1 + i % 3 END AS charge FROM pred")
def _(v):
    rows = spectra(v).select("vec_id", F.posexplode("predicted").alias("i", "p")).withColumn("ion", sp.ion(F.col("p.annotation")))
    return rows.select("vec_id", "i", F.col("ion.kind").alias("kind"), F.col("ion.ordinal").alias("ordinal"), F.col("ion.charge").alias("charge"))


@book.query("flt37_fragments", "v_peaks", sql=f"WITH {PEAKS} SELECT a.vec_id, a.n AS n_predicted, b.n AS n_observed FROM (SELECT vec_id, count(*) AS n FROM kept GROUP BY 1) a JOIN (SELECT vec_id, count(*) AS n FROM obs GROUP BY 1) b ON a.vec_id = b.vec_id")
def _(v):
    return spectra(v).select("vec_id", F.size(sp.possible_fragments(F.col("predicted"), F.col("charge"))).alias("n_predicted"), F.size(sp.without_reporters(F.col("observed"))).alias("n_observed"))


@book.query("jn17_matched_peaks", "v_peaks", sql=f"WITH {PEAKS} SELECT vec_id, obs_id, k AS i, round(mz, 6) AS mz, round(omz, 6) AS observed_mz FROM m")
def _(v):
    rows = scored_pairs(v).select("vec_id", "obs_id", F.explode("matches").alias("m"))
    return rows.select("vec_id", "obs_id", F.col("m.i").alias("i"), F.round("m.mz", 6).alias("mz"), F.round("m.observed_mz", 6).alias("observed_mz"))


@book.query("scl21_ppm_errors", "v_peaks", sql=f"WITH {PEAKS} SELECT vec_id, obs_id, k AS i, round((omz - mz) / mz * 1e6, 3) AS ppm FROM m")
def _(v):
    rows = scored_pairs(v).select("vec_id", "obs_id", F.explode("matches").alias("m"))
    return rows.select("vec_id", "obs_id", F.col("m.i").alias("i"), F.round(sp.ppm_error(F.col("m")), 3).alias("ppm"))


@book.query("scl10_spectral_angle", "v_peaks", sql=f"WITH {PEAKS} SELECT vec_id, obs_id, round(degrees, 5) AS degrees, round(1 - degrees / 90, 5) AS normalised FROM scores")
def _(v):
    return scored_pairs(v).select("vec_id", "obs_id", F.round("degrees", 5).alias("degrees"), F.round("normalised", 5).alias("normalised"))


@book.query("agg24_cleavages", "v_peaks", sql=f"WITH {PEAKS} SELECT vec_id, obs_id, n_cleavages, 12 AS n_sites FROM scores")
def _(v):
    return scored_pairs(v).select("vec_id", "obs_id", "n_cleavages", "n_sites")


def best(v):
    return pep.rated(pep.best_candidate(scored_pairs(v).withColumn("degrees", F.round("degrees", 9)), "vec_id", "obs_id"))


@book.query("rnk5_best_candidate", "v_peaks", sql=f"WITH {PEAKS} SELECT vec_id, obs_id, n_cleavages, n_matched FROM best")
def _(v):
    return best(v).select("vec_id", "obs_id", "n_cleavages", "n_matched")


@book.query("scl11_ratings", "v_peaks", sql=f"WITH {PEAKS} SELECT vec_id, sa_rating, match_coverage, confidence FROM final")
def _(v):
    return best(v).select("vec_id", "sa_rating", "match_coverage", "confidence")


@book.query(
    "agg18_score_report", "v_peaks",
    sql=f"""WITH {PEAKS}, e AS (SELECT degrees, 'all' AS facet, '' AS value FROM final UNION ALL SELECT degrees, 'sa_rating', sa_rating FROM final UNION ALL SELECT degrees, 'confidence', confidence FROM final)
    SELECT facet, value, count(*) AS n, round(avg(degrees), 4) AS mean_degrees, round(median(degrees), 4) AS median_degrees, round(100.0 * count(*) / (SELECT count(*) FROM final), 4)::DOUBLE AS percent FROM e GROUP BY 1, 2""",
)
def _(v):
    report = pep.score_report(best(v), ["sa_rating", "confidence"])
    return report.select("facet", "value", "n", *(F.round(c, 4).alias(c) for c in ("mean_degrees", "median_degrees", "percent")))


@book.query("jn22_predictions", "v_psm", "v_peaks", sql="SELECT psm_id, len(embedding) AS n_peaks FROM v_psm LEFT JOIN v_peaks ON vec_id = CAST(substr(peptide, 5, length(peptide) - 5) AS BIGINT) AND label % 3 + 2 = charge")
def _(v, peaks):
    library = spectra(peaks).select(F.concat(F.lit("PEPC"), F.col("vec_id").cast("string"), F.lit("K/"), F.col("charge").cast("string")).alias("name"), "predicted")
    named = v.select("psm_id", F.concat_ws("/", "peptide", F.col("charge").cast("string")).alias("name"))
    return named.join(library, "name", "left").select("psm_id", F.when(F.col("predicted").isNotNull(), F.size("predicted")).alias("n_peaks"))


@book.query(
    "jn18_along_list", "v_lists",
    sql=f"""WITH metric AS (SELECT 'P' || CAST(user_id AS VARCHAR) AS peptide, round(sum(value), 2) AS total FROM v_lists GROUP BY user_id), u AS (SELECT event_id, unnest({DECODED}) AS item, generate_subscripts({DECODED}, 1) AS place FROM v_lists)
    SELECT l.event_id, coalesce((SELECT string_agg(coalesce(printf('%.2f', total), '?'), '/' ORDER BY place) FROM u LEFT JOIN metric ON peptide = trim(item) WHERE u.event_id = l.event_id), '') AS totals FROM v_lists l""",
)
def _(v):
    metric = v.groupBy(F.concat(F.lit("P"), F.col("user_id").cast("string")).alias("peptide")).agg(F.format_string("%.2f", F.round(F.sum("value"), 2)).alias("total"))
    return pep.along_list(v, "event_id", "list_text", metric, ["total"]).select("event_id", F.array_join("total", "/", "?").alias("totals"))


@book.query(
    "jn16_mentioned", "v_psm", "v_idmap",
    sql="""WITH pattern AS (SELECT string_agg(regexp_escape(gene_id), '|' ORDER BY gene_id) AS p FROM (SELECT DISTINCT gene_id FROM v_idmap)),
    n AS (SELECT psm_id, 'sp|ENSG' || CAST(psm_id % 40 AS VARCHAR) || ';ENSGX' || CAST(psm_id % 7 AS VARCHAR) || ' x' || CAST(psm_id AS VARCHAR) AS protein FROM v_psm),
    found AS (SELECT protein, unnest(regexp_extract_all(protein, (SELECT p FROM pattern))) AS gene_id FROM (SELECT DISTINCT protein FROM n))
    SELECT DISTINCT psm_id, gene_id FROM n JOIN found USING (protein)""",
)
def _(v, ids):
    named = v.withColumn("protein", F.concat(F.lit("sp|ENSG"), (F.col("psm_id") % 40).cast("string"), F.lit(";ENSGX"), (F.col("psm_id") % 7).cast("string"), F.lit(" x"), F.col("psm_id").cast("string")))
    return pep.mentioned(named, "protein", ids, ["psm_id"]).select("psm_id", "gene_id").distinct()


@book.query("jn15_tolerant_ids", "v_evidence", sql="SELECT row_id, genomic_coordinates AS row_name FROM v_evidence")
def _(v):
    known = v.select(F.when(F.col("row_id") % 2 == 0, F.replace("genomic_coordinates", F.lit(":"), F.lit("."))).otherwise(F.col("genomic_coordinates")).alias("id")).dropna().distinct()
    found = pep.tolerant_ids(v.select("row_id", "genomic_coordinates"), "genomic_coordinates", known)
    return found.select("row_id", F.replace(F.replace("row_name", F.lit("."), F.lit(":")), F.lit("."), F.lit(":")).alias("row_name"))


@book.query("jn21_member_rows", "v_psm", "v_peaks", sql="SELECT psm_id FROM v_psm WHERE peptide IN (SELECT 'PEPC' || CAST(vec_id AS VARCHAR) || 'K' FROM v_peaks)")
def _(v, peaks):
    wanted = peaks.select(F.concat(F.lit("PEPC"), F.col("vec_id").cast("string"), F.lit("K")).alias("peptide"))
    return v.join(wanted, "peptide", "left_semi").select("psm_id")


@book.query("jn23_longest_prefix", "v_assets", sql="SELECT page_id, CASE WHEN lower(path) LIKE 'mirror_plots/strong%' THEN 'Mirror_Plots/Strong' WHEN lower(path) LIKE 'mirror%' THEN 'MIRROR' ELSE lower(path) END AS grp FROM v_assets")
def _(v):
    prefixes = v.select(F.explode(F.array(F.lit("MIRROR"), F.lit("Mirror_Plots/Strong"))).alias("prefix")).distinct()
    return pep.longest_prefix(v, "path", prefixes).select("page_id", "grp")
