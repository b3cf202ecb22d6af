"""Operators on hand-made rows: nulls, ties, both strands, and figures worked out another way."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions import distributions as dist
from strandline.functions import lists
from strandline.functions import spectra as sp
from strandline.operators import cohorts, evidence, facets, intervals, matrices, merging, peptides, testing


def test_lists(spark):
    texts = [("['A', 'B']",), ("[]",), ("['A', None]",), ("'A'",), ("7",), ("[1, 2.5]",), ("broken [",), ("['A' 'B']",), (None,)]
    got = [r.x for r in spark.createDataFrame(texts, "t string").select(lists.decode_list(F.col("t")).alias("x")).collect()]
    assert got == [["A", "B"], [], ["A", None], ["A"], ["7"], ["1", "2.5"], None, None, None]


EVIDENCE = "row_id long, sequence string, database string, gene_symbol string, smorf_type string, protein_class_length string, ribocode boolean, shortstop_label string, total_unique_spectral_counts long, global_pg_q_value double, proteotypic int"


def test_gate(spark):
    sam, micro = "SAM-Secreted", "Microprotein"
    rows = [
        (1, "A", "Salk", "x", None, micro, True, sam, None, None, None), (2, "A", "Salk", "x", "uORF", micro, True, sam, 0, 0.01, 1), (3, "A", "Salk", "x", "uORF", micro, True, sam, 0, 0.5, 1),
        (4, "B", "TrEMBL", None, "Iso", micro, None, sam, 0, 0.01, 1), (5, "B", "TrEMBL", None, "Iso", micro, None, None, 1, None, None), (6, "C", "Swiss-Prot", "ok", "uORF", micro, False, None, 0, None, None),
        (7, "C", "Swiss-Prot", "ok", "uORF", micro, True, sam, 5, None, None), (8, "D", "Salk", "a bOvIn", "uORF", micro, True, sam, 5, None, None), (9, "E", "RefSeq", "x", "uORF", micro, True, sam, 5, None, None),
        (10, "F", "Salk", "x", "N-Iso", micro, True, sam, 0, 0.02, 1), (11, "G", "Salk", "x", "uORF", "Protein", True, sam, 5, None, None), (12, "H", "Salk", "x", "oORF", micro, True, sam, None, 0.01, 1),
    ]
    df = spark.createDataFrame(rows, EVIDENCE)
    got = {r.row_id: r for r in evidence.evidence_gate(df).collect()}
    assert set(got) == {2, 5, 6, 12}
    assert got[2].has_ms and got[5].smorf_type == "TrEMBL" and got[6].database == "Swiss-Prot-MP" and got[12].dia_evidence
    strict = {r.row_id for r in evidence.evidence_gate(df, reviewed_need_evidence=True).collect()}
    assert strict == {2, 5, 7, 12}


def test_merge_null_keys(spark):
    a = spark.createDataFrame([("k", 1), (None, 2)], "sequence string, v int")
    b = spark.createDataFrame([("k", 3), ("k", 4), (None, 5)], "sequence string, v int")
    assert merging.merge_sources({"a": a, "b": b}).count() == 4
    assert merging.merge_sources({"a": a, "b (x+y)": b}, null_safe=True).count() == 3
    assert "b_x_y_v" in merging.merge_sources({"a": a, "b (x+y)": b}).columns


def test_facets_do_nothing_when_empty(spark):
    df = spark.createDataFrame([("uORF", 1.0), (None, None)], "kind string, v double")
    assert facets.one_of(df, "kind", []).count() == 2 and facets.in_groups(df, "kind", []).count() == 2 and facets.search(df, "kind", "").count() == 2
    assert facets.in_groups(df, "kind", [], "Downstream", ["dORF"]).count() == 0 and facets.within(df, "v", (2, 3)).count() == 1


@pytest.mark.parametrize("places, span", [(400, 60), (400, 1), (20_000, 5000), (3 * 10**7, 10**7)])
def test_overlaps_equal_brute_force(spark, places, span):
    """Spans from 1 to 10 million, most of them short, a few as long as all places, some at the edges of bins."""
    draw = random.Random(span)
    width = lambda: int(span ** draw.random()) - 1 if draw.random() < 0.9 else 2 ** draw.randrange(24) % span
    place = lambda: draw.choice([draw.randrange(-places // 4, places), 512 * draw.randrange(places // 512 + 1)])
    make = lambda n: [(i, f"chr{draw.randrange(2)}", draw.choice("+-"), s, s + width()) for i in range(n) for s in [place()]]
    schema = "id long, chrom string, strand string, start_pos long, end_pos long"
    a, b = make(80), make(60)
    x, y = (spark.createDataFrame(r, schema) for r in (a, b))
    got = [(r.id, r.ref_id, r.overlap) for r in intervals.overlaps(x, y).collect()]
    want = {(i, j, min(e, f) - max(s, t) + 1) for i, c, d, s, e in a for j, g, h, t, f in b if (c, d) == (g, h) and s <= f and t <= e}
    assert len(got) == len(want) and set(got) == want
    alone = {r.id for r in intervals.not_overlapping(x, y, ["id"]).collect()}
    assert alone | {i for i, _, _ in want} == {r[0] for r in a} and not alone & {i for i, _, _ in want}
    spans = spark.createDataFrame([(c, s, e) for _, c, _, s, e in a], "chrom string, lo long, hi long")
    merged = sorted((r.chrom, r.lo, r.hi) for r in intervals.merged(spans).collect())
    assert all(p[0] != q[0] or p[2] < q[1] for p, q in zip(merged, merged[1:]))
    assert all(any(c == k and lo <= s and e <= hi for k, lo, hi in merged) for _, c, _, s, e in a)


def fold(labels):
    state = None
    rank = lambda x: intervals.PRIORITY.index(x) if x in intervals.PRIORITY else 99
    for x in labels:
        if state is None:
            state = x
        elif (state, x) in intervals.TOGETHER or (x, state) in intervals.TOGETHER:
            state = intervals.TOGETHER.get((state, x)) or intervals.TOGETHER[x, state]
        elif rank(x) < rank(state):
            state = x
    return state


def test_resolution_folds_in_order(spark):
    draw = random.Random(1)
    lists_ = [["iORF", "uORF", "dORF"], ["uORF", "dORF", "iORF"], ["UA", "eORF"], ["UA"]] + [[draw.choice([*intervals.PRIORITY, "UA"]) for _ in range(draw.randrange(1, 7))] for _ in range(60)]
    rows = [(f"t{i}", p, 0, x, "n", "g") for i, xs in enumerate(lists_) for p, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "id string, pos long, ref_pos long, annotation string, gene_name string, gene_id string").repartition(5)
    assert {r.id: r.annotation for r in intervals.resolved(df).collect()} == {f"t{i}": fold(xs) for i, xs in enumerate(lists_)}


def test_profile_gaps(spark):
    points = spark.createDataFrame([("a", 0.0, 1.0), ("a", 10.0, 5.0), ("a", 4.1, 3.0), ("b", 0.0, 1.0), ("b", 0.5, 1.0)], "item string, along double, intensity double")
    got = [r["mean"] for r in intervals.profile(points, 10).orderBy("bin").collect()]
    assert got == [1.0, 1.0, 3.0, 3.0, 3.0, 3.0, 3.0, 5.0, 5.0, 5.0]


def test_matching_equals_a_loop(spark):
    draw = random.Random(4)
    peak = "array<struct<mz:double,intensity:double,annotation:string>>"
    rows = []
    for i in range(60):
        make = lambda n: [(round(draw.uniform(200, 230), 1), draw.random(), draw.choice(["b1+1", "y2+1", "x"])) for _ in range(n)]
        rows.append((i, make(draw.randrange(0, 12)), make(draw.randrange(0, 12))))
    df = spark.createDataFrame(rows, f"id long, p {peak}, o {peak}")
    odd = spark.createDataFrame([(900, None, [(1.0, 1.0, "x")]), (901, [(1.0, 1.0, "x")], None), (902, [(None, 1.0, "x"), (5.0, None, None)], [(None, 1.0, "x"), (5.0, 2.0, None)]), (903, [], [])], df.schema)
    found = {r.id: r.m for r in df.unionByName(odd).select("id", sp.matched(F.col("p"), F.col("o"), 5000.0).alias("m")).collect()}
    assert found.pop(900) is None and found.pop(901) is None and found.pop(903) == []
    assert [tuple(m) for m in found.pop(902)] == [(1, 1, 0.0, 5.0, 5.0, None, 2.0, None)]
    for k, p, o in rows:
        assert all((m.mz, m.predicted, m.annotation) == p[m.i] and (m.observed_mz, m.observed) == o[m.j][:2] and m.off == abs(m.mz - m.observed_mz) for m in found[k])
    got = {k: [(m.i, m.j) for m in ms] for k, ms in found.items()}
    for i, p, o in rows:
        used, want = set(), []
        for k, (mz, _, _) in enumerate(p):
            if not o:
                continue
            j = min(range(len(o)), key=lambda j: (abs(o[j][0] - mz), j))
            if abs(o[j][0] - mz) <= mz * 5000 / 1e6 and j not in used:
                used.add(j)
                want.append((k, j))
        assert got[i] == want


def test_notation(spark):
    cases = {"n[230]PEM[147]CK[305]M": "[UNIMOD:737]-PEM[UNIMOD:35]C[UNIMOD:4]K[UNIMOD:737]M", "n[43]PEPK": None, "PEPC[160.03]K": "[UNIMOD:737]-PEPC[UNIMOD:4]K[UNIMOD:737]", None: None}
    df = spark.createDataFrame([(k,) for k in cases], "m string").select("m", sp.library_notation(F.col("m")).alias("x"))
    assert {r.m: r.x for r in df.collect()} == cases


def test_candidates_fall_back(spark):
    schema = "psm_id long, peptide string, modified_peptide string, charge int, hyperscore double, purity double"
    rows = [(1, "A", "n[43]A", 2, 9.0, 1.0), (2, "A", "x", 2, 5.0, 0.9), (3, "A", "x", 3, 4.0, 0.9), (4, "A", "x", 2, 5.0, 0.9), (5, "B", "n[43]B", 2, 1.0, 0.1), (6, "C", "y", 2, 1.0, 0.1), (7, "C", "y", 2, 3.0, None)]
    got = peptides.candidates(spark.createDataFrame(rows, schema), "psm_id")
    assert {(r.psm_id, r.candidate_rank, r.acetyl_rescued) for r in got.collect()} == {(2, 1, True), (4, 2, True), (5, 1, False), (7, 1, False)}
    assert {r.peptide for r in peptides.primary(got).collect()} == {"A", "C"}


def test_distributions():
    known = [(dist.t_tail(np.array([2.228139]), np.array([10.0])), 0.05), (dist.f_tail(np.array([4.964603]), np.array([1.0]), np.array([10.0])), 0.05), (dist.normal_tail(np.array([1.959964])), 0.05)]
    known += [(dist.range_tail(np.array([3.877676]), np.array([3.0]), np.array([10.0])), 0.05), (dist.range_tail(np.array([3.314]), np.array([3.0]), np.array([1e5])), 0.05)]
    for got, want in known:
        assert abs(got[0] - want) < 2e-4
    x = np.linspace(0.01, 0.99, 9)
    assert np.allclose(dist.incomplete_beta(1.0, 1.0, x), x) and np.allclose(dist.incomplete_beta(2.0, 3.0, x), 6 * x**2 - 8 * x**3 + 3 * x**4)


def test_adjustment(spark):
    draw = random.Random(2)
    p = [draw.choice([0.001, 0.01, 0.2, draw.random()]) for _ in range(300)] + [None, 1.0]
    got = {r.i: r.q_value for r in testing.adjusted(spark.createDataFrame(list(enumerate(p)), "i long, p double").repartition(6)).collect()}
    known = [x for x in p if x is not None]
    ordered = sorted(known, reverse=True)
    q, least = {}, 1.0
    for k, x in enumerate(ordered):
        least = min(least, x * len(known) / (len(known) - k))
        q[x] = least
    for i, x in enumerate(p):
        assert got[i] is None if x is None else math.isclose(got[i], q[x], rel_tol=1e-9) and got[i] >= x


def test_nested_models_equal_least_squares(spark):
    draw = np.random.default_rng(0)
    rows, want = [], {}
    for k in range(12):
        n = (5, 9)
        x, g = draw.normal(size=sum(n)), np.repeat([0.0, 1.0], n)
        y = x * draw.normal() + g * draw.normal() + draw.normal(size=sum(n))
        rows += [(f"s{k}", "m", "ab"[int(c)], float(a), float(b)) for a, b, c in zip(x, y, g)]
        rss = []
        for d in (np.stack([np.ones_like(x), x], 1), np.stack([np.ones_like(x), x, g], 1), np.stack([np.ones_like(x), x, g, x * g], 1)):
            b, r, *_ = np.linalg.lstsq(d, y, rcond=None)
            rss.append((float(((y - d @ b) ** 2).sum()), b))
        want[f"s{k}"] = ((rss[0][0] - rss[1][0]) / (rss[1][0] / (len(x) - 3)), (rss[1][0] - rss[2][0]) / (rss[2][0] / (len(x) - 4)), rss[1][1][2], rss[2][1][3])
    got = testing.nested_models(spark.createDataFrame(rows, "smorf_id string, main_id string, grp string, x double, y double"), ("a", "b")).collect()
    for r in got:
        assert np.allclose((r.add_f, r.int_f, r.add_b, r.int_b), want[r.smorf_id]) and 0 <= r.add_p <= 1 and 0 <= r.fisher_p <= 1
    assert len(got) == 12


def test_tests_skip_what_does_not_vary(spark):
    rows = [("flat", g, 1.0) for g in "aabb"] + [("up", g, v) for g, v in zip("aabb", (1.0, 2.0, 5.0, 6.0))] + [("gap", "a", None), ("gap", "b", 1.0)]
    df = spark.createDataFrame(rows, "feature string, grp string, value double")
    t = {r.feature: r for r in testing.t_test(df, "a", "b").collect()}
    assert t["flat"].p is None and abs(t["up"].t + 4 * math.sqrt(2)) < 1e-9 and abs(t["up"].p - 0.029857) < 1e-5 and t["gap"].t is None
    f = {r.feature: r for r in testing.anova(df).collect()}
    assert abs(f["up"].f - 32) < 1e-9 and abs(f["up"].p - t["up"].p) < 1e-9 and f["flat"].p is None


def test_polish_takes_batches_out(spark):
    draw = np.random.default_rng(1)
    level, shift = draw.normal(8, 1, 20), {"p": 0.0, "q": 3.0}
    rows, samples = [], []
    for k in range(12):
        b = "pq"[k % 2]
        samples.append((f"s{k}", b, "ref" if k < 4 else "x"))
        rows += [(f"f{i}", f"s{k}", float(2 ** (level[i] + shift[b] + (i % 3) * (b == "q") + draw.normal(0, 0.01)))) for i in range(20)]
    out = matrices.median_polish(spark.createDataFrame(rows, "feature string, sample string, value double"), spark.createDataFrame(samples, "sample string, batch string, kind string"), F.col("kind") == "ref")
    got = out.toPandas()
    assert set(got["sample"]) == {f"s{k}" for k in range(4, 12)} and got["value"].abs().max() < 0.1


def test_count_model_finds_a_fold(spark):
    draw = np.random.default_rng(3)
    rows, samples = [], [(f"s{k}", "ab"[k % 2]) for k in range(40)]
    for i in range(60):  # enough features for steady size factors
        for k in range(40):
            mean = 100 * (4 if i == 0 and k % 2 else 1)
            rows.append((f"f{i}", f"s{k}", float(draw.negative_binomial(10, 10 / (10 + mean)))))
    df = spark.createDataFrame(rows, "feature string, sample string, value double")
    got = {r.feature: r for r in testing.count_tests(df, matrices.size_factors(df), spark.createDataFrame(samples, "sample string, g string"), [], "g", "a", "b").collect()}
    assert abs(got["f0"].log2fc - 2) < 0.5 and got["f0"].p < 1e-6 and all(abs(r.log2fc) < 1 for f, r in got.items() if f != "f0")


def test_dispersions_draw_towards_the_trend(spark):
    draw, n = np.random.default_rng(5), 12
    truth, sizes = 0.2, [(f"s{k}", "ab"[k % 2], 0.5 + k / n) for k in range(n)]
    rows = [(f"f{i}", s, float(draw.negative_binomial(1 / truth, 1 / (1 + truth * 40 * (1 + i % 9) * z)))) for i in range(300) for s, _, z in sizes]
    rows += [("wild", s, float(5000 if k == 0 else 1)) for k, (s, _, _) in enumerate(sizes)] + [("none", s, 0.0) for s, _, _ in sizes]
    counts = spark.createDataFrame([r for r in rows if r[2]], "feature string, sample string, value double")  # zeros are left out
    design = testing.count_design(*(spark.createDataFrame([(s, x) for s, x in c], f"sample string, {n}") for n, c in (("size_factor double", [(s, z) for s, _, z in sizes]), ("g string", [(s, g) for s, g, _ in sizes]))), [], "g", "a", "b")
    got = {r.feature: r for r in testing.dispersions(counts, design).collect()}
    z = np.array([x[2] for x in sizes])
    for f in ("f0", "f7", "wild"):
        y = np.array([r[2] for r in rows if r[0] == f]) / z
        assert math.isclose(got[f].base_mean, y.mean()) and math.isclose(got[f].dispersion, max(1e-8, (y.var(ddof=1) - y.mean() * (1 / z).mean()) / y.mean() ** 2), rel_tol=1e-9)
    assert got["wild"].moderated == got["wild"].dispersion and "none" not in got
    own, drawn = (np.log([getattr(r, c) for f, r in got.items() if f != "wild" and r.dispersion > 1e-6]) for c in ("dispersion", "moderated"))
    assert drawn.std() < own.std() and abs(np.median(drawn) - math.log(truth)) < 0.5
    x = spark.createDataFrame([(0.5,), (1.0,), (7.5,)], "x double").select(testing._trigamma(F.col("x")).alias("t")).collect()
    assert np.allclose([r.t for r in x], [math.pi**2 / 2, math.pi**2 / 6, sum(1 / (7.5 + k) ** 2 for k in range(10**6))], atol=2e-6)


def test_regression_is_seeded(spark):
    draw = np.random.default_rng(4)
    rows = [("f", f"s{k}", float(3 * k + draw.normal()), float(k), "ab"[k % 2]) for k in range(30)]
    df = spark.createDataFrame(rows, "feature string, sample string, value double, age double, g string")
    one, two = ({r["sample"]: r["value"] for r in testing.regressed(d, ["age"], "g", ["age"]).collect()} for d in (df, df.repartition(7)))
    assert one == two and np.std(list(one.values())) < 3


def test_rubrics(spark):
    rows = [(3, 4, 30.0, 1, "Control"), (3, 3, 30.0, 1, None), (2, 4, 30.0, 1, "Control"), (5, 1, 30.0, 1, "AsymAD"), (5, 1, 20.0, 1, "AD"), (1, 1, 20.0, 5, None), (None, 1, 20.0, 5, None)]
    got = spark.createDataFrame(rows, "b int, c int, m double, d int, w string").select(cohorts.rubric_a(F.col("b"), F.col("c"), F.col("m"), F.col("d")).alias("g"), "w").collect()
    assert [r.g for r in got] == [r.w for r in got]


def test_mentioned_ids_are_searched_for(spark):
    """Ids with other characters than letters and digits, inside longer words, leftmost and without overlaps, like an escaped alternation."""
    import random
    import re

    from strandline.operators import peptides as pep

    draw = random.Random(3)
    ids = ["HLA-A", "chr1:100-200", "ENSG1", "ENSG12", "T7+chr2:5-9", "A.B", "aa", "aaa", "SG1", "x*"]
    texts = ["sp|HLA-A;y", "xxchr1:100-200+ENSG12", "ENSG12 ENSG1", "AxB A.B", "aaaa", "aaaaa", "T7+chr2:5-9,T7+chr2:5-9", "none", "", None, "x*x*", "xHLA-AENSG1z"]
    texts += ["".join(draw.choice(["a", "aa", "ENSG1", "SG12", " ", "HLA-A", "x*"]) for _ in range(6)) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "psm_id long, protein string")
    for order in (ids, ids[::-1]):
        known = spark.createDataFrame(list(enumerate(order)), "place long, gene_id string")
        pattern = "|".join(map(re.escape, order))
        want = {(i, g) for i, t in enumerate(texts) for g in re.findall(pattern, t or "")}
        got = [(r.psm_id, r.gene_id) for r in pep.mentioned(df, "protein", known, ["psm_id"]).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert pep.mentioned(df, "protein", known.filter("false"), ["psm_id"]).count() == 0


def test_ids_of_many_lengths(spark):
    """Ids of 200 lengths, found at the ends of texts and inside each other; the rows to shuffle are the texts' places."""
    from strandline.operators import peptides as pep

    draw = random.Random(9)
    word = lambda n: "".join(draw.choice("acgt") for _ in range(n))
    ids = [word(n) for n in range(1, 201)]
    texts = [word(30) + draw.choice(ids) + word(draw.randrange(9)) for _ in range(60)] + ids[::7] + [ids[50] + ids[90], ids[120][:-1], ids[120][1:]]
    numbered = spark.createDataFrame(list(enumerate(texts)), "_number long, _text string")
    got = pep.found_at(numbered, spark.createDataFrame([(x,) for x in ids], "_want string"))
    want = {(i, k + 1, x) for i, t in enumerate(texts) for x in ids if len(x) >= pep.GRAM for k in range(len(t)) if t.startswith(x, k)}
    assert {(r["_number"], r["at"], r["_want"]) for r in got.collect()} == want


def test_tolerant_ids_are_searched_for(spark):
    """An id that equals none is found inside known ones, a colon standing for any character; the first known id counts."""
    import re

    from strandline.operators import peptides as pep

    known = ["GENE_chr1.5-9_x", "chr1:5-9", "chr2x77", "Achr2-77", "chr1_5-9", "q", "T+chr3.1", "ab"]
    ids = ["chr1:5-9", "chr1:5-9_x", "chr2:77", "ENE_chr1:5", "hr1:5:9", "GENE:chr1", "GENE:chr2", "chr2-77:",  "chr9:1", "T+chr3:1", "Tchr3:1", "a", "", None, "::", "b:b", "hr1:5-9"]
    df = spark.createDataFrame(list(enumerate(ids)), "i long, want string")
    for order in (known, known[::-1]):
        table = spark.createDataFrame(list(enumerate(order)), "place long, id string")
        find = lambda x: None if not x else x if x in order else next((k for k in order if re.search(re.escape(x).replace(":", "."), k)), None)
        got = {r.i: r.row_name for r in pep.tolerant_ids(df, "want", table).collect()}
        assert got == {i: find(x) for i, x in enumerate(ids)}


def test_normal_distribution_can_be_used_again(spark):
    from strandline.functions import distributions as dist

    for _ in range(2):
        assert abs(dist.normal_below(np.array([1.96]))[0] - 0.9750021) < 1e-6  # the driver's own use comes before the workers'
        got = spark.range(3).select(dist.normal_cdf(F.col("id").cast("double")).alias("p")).collect()
        assert [round(r.p, 6) for r in got] == [0.5, 0.841345, 0.97725]


@pytest.mark.parametrize("parts", ["1", "7"])
def test_islands_across_ranges(spark, parts):
    """Islands that span many ranges, nested and touching intervals, a single chromosome, ties and repeats."""
    draw = random.Random(int(parts))
    rows = [("c", a := draw.randrange(5000), a + draw.choice([0, 1, 5, 900 if i % 50 == 0 else 3])) for i in range(600)] + [("d", 5, 9), ("d", 9, 12), ("d", 13, 13), ("d", 5, 9), ("e", 0, 10**6), ("e", 7, 8)]
    want = []
    for c, lo, hi in sorted(rows):
        if want and want[-1][0] == c and lo <= want[-1][2]:
            want[-1] = (c, want[-1][1], max(hi, want[-1][2]))
        else:
            want.append((c, lo, hi))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = intervals.merged(spark.createDataFrame(rows, "chrom string, lo long, hi long").repartition(5)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted((r.chrom, r.lo, r.hi) for r in got) == want


def test_adjustment_with_a_common_value(spark):
    draw = random.Random(8)
    p = [1.0] * 300 + [0.0] * 20 + [draw.random() ** 3 for _ in range(300)] + [None] * 5
    got = {r.i: r.q_value for r in testing.adjusted(spark.createDataFrame(list(enumerate(p)), "i long, p double").repartition(4)).collect()}
    known = sorted(x for x in p if x is not None)
    n = len(known)
    for i, x in enumerate(p):
        if x is None:
            assert got[i] is None
        else:
            want = min(1.0, min(y * n / (k + 1) for k, y in enumerate(known) if y >= x))
            assert abs(got[i] - want) < 1e-12


@pytest.mark.parametrize("features,held", [(3, 2000), (30, 2000), (120, 100)])
def test_outlying_samples_equal_a_decomposition(spark, monkeypatch, features, held):
    from strandline.operators.testing import outlying_samples

    monkeypatch.setattr(testing, "COVARIANCE_FEATURES", held)
    rng = np.random.default_rng(features)
    x = rng.normal(size=(40, features)) + np.outer(rng.normal(size=40) * 2, rng.normal(size=features))
    x[7] += 25 * np.sign(rng.normal(size=features))
    x[3, 1] = np.nan
    rows = [(f"f{j}", f"s{i}", float(x[i, j])) for i in range(40) for j in range(features)] + [("flat", f"s{i}", 1.0) for i in range(40)]
    got = {r["sample"]: r for r in outlying_samples(spark.createDataFrame(rows, "feature string, sample string, value double")).collect()}
    x[3, 1] = np.nanmean(x[:, 1])
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    _, s, vt = np.linalg.svd(z, full_matrices=False)
    for i in range(min(2, features)):
        want, have = z @ vt[i], np.array([got[f"s{k}"][f"pc{i + 1}"] for k in range(40)])
        assert min(np.abs(want - have).max(), np.abs(want + have).max()) < 1e-6 * s[0]
    assert [k for k, r in got.items() if r["outlier"]] == ["s7"]
    if features < 5:
        assert all(r["pc5"] is None for r in got.values())


def test_outlying_samples_of_nothing(spark):
    from strandline.operators.testing import outlying_samples

    kind = "feature string, sample string, value double"
    assert outlying_samples(spark.createDataFrame([], kind)).count() == 0
    flat = outlying_samples(spark.createDataFrame([("f", "a", 1.0), ("f", "b", 1.0)], kind)).collect()
    assert len(flat) == 2 and not any(r["outlier"] for r in flat)
