"""Steps that decide how an operator grows: results against brute force, and the plans that keep them small."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandline.functions import spectra
from strandline.operators import fits, intervals, merging, peptides, testing


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("most", [0, 100_000])
def test_points_in_unions(spark, most):
    """Unions of many levels, points on their ends, nulls; few unions are sent to the points, which aren't shuffled."""
    rng = random.Random(5)
    spans = [(c, lo, lo + rng.choice([0, 3, 700, 40_000, 5_000_000])) for c in ("c1", "c2") for lo in rng.sample(range(-1000, 60_000_000), 60)]
    unions = intervals.merged(spark.createDataFrame(spans, "chrom string, lo long, hi long"))
    known = [(r.chrom, r.lo, r.hi) for r in unions.collect()]
    at = [(c, p + d) for c, lo, hi in known for p in (lo, hi) for d in (-1, 0, 1)] + [(None, 5), ("c1", None), ("c3", 5)]
    points = spark.createDataFrame([(i, c, p) for i, (c, p) in enumerate(at)], "id long, chrom string, at long")
    got = intervals.in_unions(points, "at", unions, "found", most)
    assert got.columns == ["id", "chrom", "at", "found"]
    assert {r.id: r.found for r in got.collect()} == {i: p is not None and any(c == k and lo <= p <= hi for k, lo, hi in known) for i, (c, p) in enumerate(at)}
    assert ("hashpartitioning" in plan_of(got)) == (most == 0)


def test_classified_rows_alone(spark):
    """A row over two bins that meets something in the second one, a row without a start, an id with a row alone, and ids with other than coding pairs."""
    rows = [
        ("two", 1, 500, 1030, "CDS"), ("alone", 2, 90_000, 90_010, "CDS"), ("none", 3, None, 7, "CDS"), ("exon", 4, 1020, 1025, "exon"),
        ("mixed", 5, 1020, 1025, "exon"), ("mixed", 6, 90_000, 90_010, "CDS"), ("both", 7, 1020, 1025, "CDS"), ("both", 8, 90_000, 90_010, "CDS"),
    ]
    orfs = spark.createDataFrame([(i, p, "c", "+", s, e, f) for i, p, s, e, f in rows], "id string, pos long, chrom string, strand string, start_pos long, end_pos long, feature string")
    kind = "ref_pos long, gene_id string, transcript_id string, gene_name string, chrom string, strand string, start_pos long, end_pos long, feature string, gene_biotype string, transcript_biotype string"
    reference = spark.createDataFrame([(1, "g", "t", "n", "c", "+", 1025, 1040, "exon", None, None)], kind)
    got = {r.id: r.annotation for r in intervals.classified(orfs, reference, ["id", "pos", "start_pos", "end_pos"]).collect()}
    assert got == {"two": "eORF", "alone": "intergenic", "none": "intergenic", "mixed": "intergenic", "both": "eORF"}


def test_labels_shuffle_rows_for_starts_and_bins_alone(spark):
    """Genes and unions are sent to the rows: no range is dealt and stored for them."""
    orfs = spark.range(300).select(F.format_string("T-chr1:%d-%d", F.col("id"), F.col("id") + 9).alias("id"), F.col("id").alias("pos"), F.lit("chr1").alias("chrom"), F.lit("+").alias("strand"), F.col("id").alias("start_pos"), (F.col("id") + 9).alias("end_pos"), F.lit("CDS").alias("feature"))
    columns = [F.col("id").alias("ref_pos"), *(F.lit(x).alias(c) for c, x in (("gene_id", "g"), ("transcript_id", "t"), ("gene_name", "n"), ("chrom", "chr1"), ("strand", "+")))]
    reference = spark.range(0, 300, 50).select(*columns, F.col("id").alias("start_pos"), (F.col("id") + 20).alias("end_pos"), *(F.lit(x).alias(c) for c, x in (("feature", "CDS"), ("gene_biotype", "x"), ("transcript_biotype", "y"))))
    got = intervals.annotated_pairs(orfs, reference)
    assert got.count() > 0
    assert "_part" not in plan_of(got) and "Window" not in plan_of(got)


@pytest.mark.parametrize(("alternatives", "most"), [(256, 50_000), (0, 50_000), (0, 0)])
def test_mentioned_ids_by_number(spark, alternatives, most):
    """Few ids are one pattern, more are sent to the texts, and many are joined: all find what an escaped alternation does; few or some shuffle no places."""
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("ab.|\\Eé") for _ in range(n))
    ids = sorted({word(rng.choice([1, 2, 4, 5, 7])) for _ in range(40)} - {"a"})
    texts = [word(rng.choice([0, 3, 30])) for _ in range(60)] + [None]
    ranked = [(i, rng.randrange(10**6)) for i in ids]
    pattern = "|".join(re.escape(i) for i, _ in sorted(ranked, key=lambda x: x[1]))
    df = spark.createDataFrame([*enumerate(texts)], "k long, t string")
    got = peptides.mentioned(df, "t", spark.createDataFrame([*ranked, (None, 1), ("", 2)], "gene_id string, place long"), ["k"], alternatives, most)
    assert sorted((r.k, r.gene_id) for r in got.collect()) == sorted((k, i) for k, t in enumerate(texts) if t for i in set(re.findall(pattern, t)))
    if most:
        assert not re.search(r"hashpartitioning\(_(gram|number)", plan_of(got))


def test_poisson_weights_of_one_digest(spark):
    """Digits compare as the numbers did; a row and draw has one digest, filter included."""
    rows = spark.range(20_000).withColumn("h", fits.poisson_hash(F.lit(1), F.col("id")))
    u = F.conv("h", 16, 10).cast("double") / 2.0**32
    before = sum(((u >= t).cast("double") for t in fits.POISSON), F.lit(0.0))
    assert rows.select(fits.poisson_weight(F.col("h")).alias("w"), before.alias("b")).filter("w <> b").isEmpty()
    ends = spark.createDataFrame([(f"{int(t * 2**32) + d:08x}",) for t in fits.POISSON for d in (-1, 0, 1) if int(t * 2**32) + d < 2**32], "h string")
    assert ends.select(fits.poisson_weight(F.col("h")).alias("w"), before.alias("b")).filter("w <> b").isEmpty()
    df = rows.select((F.col("id") % 3).cast("string").alias("feature"), F.col("id").cast("string").alias("sample"), F.lit("g").alias("grp"), (F.col("id") % 7).cast("double").alias("value"), (F.col("id") % 5).alias("age"))
    seen = []
    kept = fits.cross_products
    try:
        fits.cross_products = lambda x, y, w: seen.append(1) or kept(x, y, w)
        out = testing.regressed(df, ["age"], "grp", ["age"])
    finally:
        fits.cross_products = kept
    assert seen and out.count() == 20_000 and "md5" not in plan_of(out)  # effects are stored


def test_spectra_are_matched_some_at_a_time(monkeypatch):
    """Of a batch no more peaks than the limit and a spectrum's are in work at once, and matches are the same; null and empty spectra stay in place."""
    monkeypatch.setattr(spectra.F, "arrow_udf", lambda run, _: lambda *columns: run)
    rng = np.random.default_rng(2)
    peaks = lambda n: [{"mz": float(m), "intensity": float(m % 5), "annotation": "b1+1"} for m in rng.integers(100, 112, n)]
    kind = pa.list_(pa.struct([("mz", pa.float64()), ("intensity", pa.float64()), ("annotation", pa.string())]))
    predicted, observed = (pa.array([None if i % 9 == k else peaks(i % 7) for i in range(60)], kind) for k in (0, 4))
    whole, seen = spectra.matched(None, None, 20.0)(predicted, observed), []
    kept = spectra._peaks
    monkeypatch.setattr(spectra, "MATCH_PEAKS", 20)
    monkeypatch.setattr(spectra, "_peaks", lambda x: seen.append(len(x.flatten())) or kept(x))
    assert spectra.matched(None, None, 20.0)(predicted, observed).equals(whole) and len(whole.flatten()) > 20
    assert max(seen) <= 20 + 12 and len(spectra.matched(None, None, 20.0)(predicted[:0], observed[:0])) == 0


def test_count_tests_of_many_samples(spark, monkeypatch):
    """Samples are in no task's list: the design isn't collected, lists name a few features each, and figures don't depend on them."""
    monkeypatch.setattr(testing, "LISTED_FEATURES", 2)
    rng = np.random.default_rng(8)
    samples = spark.createDataFrame([(f"s{k}", "ab"[k % 2], 1.0) for k in range(20)], "sample string, g string, size_factor double")
    df = spark.createDataFrame([(f"f{i}", f"s{k}", float(rng.poisson(20 * (4 if i == 0 and k % 2 else 1)))) for i in range(5) for k in range(20)], "feature string, sample string, value double")
    seen = []
    fit = fits.negative_binomial
    monkeypatch.setattr(fits, "negative_binomial", lambda rows, *a: seen.append(rows) or fit(rows, *a))
    got = {r.feature: r for r in testing.count_tests(df, samples.select("sample", "size_factor"), samples.select("sample", "g"), [], "g", "a", "b").collect()}
    assert len(got) == 5 and abs(got["f0"].log2fc - 2) < 0.4 and got["f0"].converged
    assert seen[0].count() == 100 and "collect_list" not in plan_of(seen[0])


def test_completeness_is_counted_before_rows_are_combined(spark):
    """Columns of the sources don't go through the join: a source's key and row, its count and its flag do; figures are those of the whole merge."""
    a = spark.createDataFrame([("k", 1, "x", None), ("k", 2, None, None), (None, 3, "y", 1.0)], "sequence string, row_id long, wide string, v double")
    b = spark.createDataFrame([("k", 4, 5), ("z", None, None)], "sequence string, row_id long, n int")
    whole = merging.merge_sources({"a": a, "b": b})
    want = whole.select("sequence", "a_row_id", "b_row_id", merging.completeness(["a_row_id", "a_wide", "a_v", "b_row_id", "b_n"]).alias("filled"))
    got = merging.completeness_merge({"a": a, "b": b}, ["row_id"])
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    joined = [line for line in plan_of(got).split("\n") if "Join" in line]
    assert joined and "a_wide" not in plan_of(got)
