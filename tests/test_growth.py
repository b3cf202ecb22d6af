"""Rows that plans make on common keys: they follow the input, not the square of a key's rows."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from strandline.functions import lists
from strandline.operators import cohorts, matrices, merging, peptides
from strandline.plans import q_facets, q_sources, q_statistics
from strandline.sources.storage import shared_dir


def most_rows(df):
    """The most rows that any step of a collected DataFrame's final plan made."""

    def walk(p):
        kind = p.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            p = p.executedPlan()
        elif kind.endswith("QueryStageExec"):
            p = p.plan()
        if p.getClass().getSimpleName() != kind:
            return walk(p)
        found = p.metrics().get("numOutputRows")
        below = [walk(p.children().apply(i)) for i in range(p.children().size())]
        return max([found.get().value() if found.isDefined() else 0, *below])

    return walk(df._jdf.queryExecution().executedPlan())


def test_heat_map_sums_before_it_matches(spark):
    fold = F.when(F.col("id") % 3 > 0, F.col("id") / 7).alias("logfc")
    cells = spark.range(2000).select(F.when(F.col("id") % 10 > 0, F.concat(F.lit("g"), (F.col("id") % 2).cast("string"))).alias("gene"), F.lit("Oli").alias("family"), F.concat(F.lit("c"), (F.col("id") % 3).cast("string")).alias("celltype"), fold)
    counts = [F.when(F.col("id") % 5 > 0, F.col("id") % 11).alias("total_razor_spectral_counts"), (F.col("id") % 13).alias("total_unique_spectral_counts")]
    master = spark.range(1500).select(F.when(F.col("id") % 4 > 0, F.lit("g1")).alias("gene_name"), F.when(F.col("id") % 6 > 0, F.when(F.col("id") % 2 > 0, "TrEMBL").otherwise("uORF")).alias("smorf_type"), *counts)
    pairs = cells.join(master, F.col("gene") == F.col("gene_name"), "left")
    total = F.when(F.col("smorf_type") == "TrEMBL", F.avg("total_razor_spectral_counts")).otherwise(F.avg("total_unique_spectral_counts"))
    want = pairs.groupBy("family", "celltype", "smorf_type").agg(F.count("*").alias("n"), F.avg("logfc").alias("log2fc"), total.alias("counts"))
    plain = lambda df: sorted((r.family, r.celltype, str(r.smorf_type), r.n, f"{r.log2fc or -1:.9f}", f"{r.counts or -1:.9f}") for r in df.collect())
    got = cohorts.heat_map(cells, master)
    assert plain(got) == plain(want) and len(plain(got)) == 9
    assert most_rows(got) <= 2000 < most_rows(want)


def test_spread_join_cuts_common_keys(spark):
    a = spark.range(3000).select(F.when(F.col("id") % 9 > 0, F.least("id", F.lit(20))).alias("k"), F.col("id").alias("x"))
    b = spark.range(500).select(F.when(F.col("id") % 7 > 0, F.greatest("id", F.lit(20))).alias("k"), F.col("id").alias("y"))
    plain = lambda df: sorted(map(str, df.select("k", "x", "y").collect()))
    for how in ("inner", "left"):
        for rows in ((10, 3), (100_000, 100_000), (7, 100_000)):
            assert plain(merging.spread_join(a, b, "k", how, *rows)) == plain(a.join(b, "k", how))
    few = a.filter("k = 20").limit(1000)
    tasks = merging.spread_join(few, b.filter("k = 20"), "k", "inner", 100, 100).groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) == 4  # one key, all of the session's partitions


def test_list_join_is_a_join(spark):
    """Keys of one row, of many and of none on either side, null keys, equal rows, lists that aren't full."""
    a = spark.range(3000).select(F.when(F.col("id") % 9 > 0, F.least("id", F.lit(20))).alias("k"), F.col("id").alias("x")).unionByName(spark.range(40).select(F.lit(20).cast("long").alias("k"), F.lit(7).cast("long").alias("x")))
    b = spark.range(500).select(F.when(F.col("id") % 7 > 0, F.greatest("id", F.lit(20))).alias("k"), F.when(F.col("id") % 5 > 0, F.col("id")).alias("y"), F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("z"))
    b = b.unionByName(spark.range(30).select(F.lit(20).cast("long").alias("k"), F.lit(4).cast("long").alias("y"), F.lit("s").alias("z")))
    plain = lambda out: sorted(map(str, out.select("k", "x", "y", "z").collect()))
    for df, other, how, rows in ((a, b, "left", (8, 24, 10)), (a, b, "inner", (7, 7, 100_000)), (b, a, "left", (100, 300, 50)), (a, b.filter("k < 0"), "left", (8, 24, 10))):
        assert plain(merging.list_join(df, other, "k", how, *rows)) == plain(df.join(other, "k", how))


def stored_bytes(df, path):
    df.coalesce(1).write.parquet(str(path))
    return sum(p.stat().st_size for p in path.glob("*.parquet")) / df.count()


def tables_of_one_gene(spark, path):
    """1200 orders of a gene, whose rows pass the gate."""
    ids = spark.range(1200).select((F.col("id") * 60 + 1).alias("key"), F.col("id"))
    # no order number that a rule of the fixture drops or empties, so that all rows are alike
    good = spark.range(400_000).filter("id % 41 > 0 and id % 43 > 0 and id % 5 < 4 and id % 7 > 0 and id % 8 > 0 and id % 53 < 18").select(F.col("id").alias("o_orderkey")).limit(1200)
    good = good.coalesce(1).select("o_orderkey", F.monotonically_increasing_id().alias("id"))
    ids.join(good, "id").select("o_orderkey", F.col("key").alias("o_custkey")).write.parquet(f"{path}/orders.parquet")
    ids.select(F.col("key").alias("c_custkey"), F.lit("HOUSEHOLD").alias("c_mktsegment")).write.parquet(f"{path}/customer.parquet")


@pytest.mark.parametrize(("name", "most"), [("flt38_significant_rows", 0.2), ("flt39_family_volcano", 0.2), ("jn11_celltype_to_master", 0.4)])
def test_rows_of_a_gene_are_stored_small(spark, tmp_path, name, most):
    """Rows out grow with the square of a gene's rows: they come in runs and patterns that Parquet keeps in a fraction of a byte for each."""
    tables_of_one_gene(spark, tmp_path)
    out = (q_facets.QUERIES | q_statistics.QUERIES)[name](spark, str(tmp_path))
    assert out.count() > 1_000_000
    assert stored_bytes(out, tmp_path / "out") < most


def test_assets_are_not_repeated_for_each_list(spark):
    lists = spark.range(600).select(F.col("id").alias("k"), F.when(F.col("id") % 3 > 0, F.when(F.col("id") % 3 > 1, "['P1', ' P1', 'P3']").otherwise("[]")).alias("t"))
    assets = spark.range(900).select(F.concat(F.lit("P"), (F.col("id") % 2).cast("string")).alias("peptide"), F.when(F.col("id") == 5, "Moderate").otherwise("Weak").alias("quality"), F.col("id").cast("string").alias("path"))
    got = peptides.assets_of(lists, "k", "t", assets)
    assert {(r.quality, r.n, tuple(r.peptides)) for r in got.collect()} == {("No PSM", 0, ()), ("Insufficient", 0, ()), ("Moderate", 900, ("P1", "P1"))}
    assert got.count() == 600 and most_rows(got) <= 900


def test_best_of_a_merge_without_combinations(spark):
    def source(n, *columns):
        key = F.when(F.col("id") % 11 > 0, (F.col("id") % 3).cast("string")).alias("sequence")
        return spark.range(n).select(key, *(F.when(F.hash("id", F.lit(c)) % 3 != 0, F.col("id")).alias(c) for c in columns), F.when(F.col("id") % 50 > 0, F.col("id")).alias("row_id"))

    tie = ["a_row_id", "b_row_id", "c_row_id"]
    for sizes in ((200, 150, 20), (0, 40, 2), (200, 150, 1)):
        sources = {name: source(n, *columns) for name, n, columns in zip("abc", sizes, (("u", "v"), ("w",), ("x", "y")))}
        plain = lambda df: sorted(map(str, df.select("sequence", *tie).collect()))
        want = merging.most_complete(merging.merge_sources(sources), "sequence", tie)
        got = merging.most_complete_merge(sources, "row_id")
        assert plain(got) == plain(want) and most_rows(got) <= 300


def test_merge_of_common_keys_is_dealt(spark, monkeypatch):
    monkeypatch.setattr(merging.spread_join, "__defaults__", ("inner", 20, 10))
    source = lambda n, step: spark.range(n).select(F.when(F.col("id") % step > 0, F.lit("k")).otherwise(F.col("id").cast("string")).alias("sequence"), F.col("id").alias("v"))
    a, b, c = source(100, 5), source(60, 4), source(6, 3)
    got = merging.merge_sources({"a": a, "b": b, "c": c})
    named = [x.withColumnRenamed("v", f"{n}_v") for n, x in (("a", a), ("b", b), ("c", c))]
    want = named[0].join(named[1], "sequence", "full_outer").join(named[2], "sequence", "full_outer")
    plain = lambda df: sorted(map(str, df.select("sequence", "a_v", "b_v", "c_v").collect()))
    assert plain(got) == plain(want)
    tasks = got.filter("sequence = 'k'").groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) == 4  # one key's combinations, in all of the session's partitions


def test_a_cached_merge_stores_no_combinations(spark, tmp_path):
    rows = spark.range(900).select((F.col("id") * 1200).alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"), (F.col("id") % 3).cast("int").alias("toxic"))
    rows.select("doc_id", F.lit("en").alias("lang"), F.lit("web").alias("source"), F.lit(5).cast("long").alias("n_chars")).write.parquet(f"{tmp_path}/documents.parquet")
    rows.filter("doc_id % 3600 > 0").withColumn("doc_id", F.col("doc_id") + 400 * F.col("toxic")).write.parquet(f"{tmp_path}/labels.parquet")
    rows.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url")).write.parquet(f"{tmp_path}/pages.parquet")
    folder = Path(shared_dir(spark).removeprefix("file://")) / "strandline"
    before = set(folder.glob("cache-*"))
    out = q_sources.QUERIES["src16_cached_merge"](spark, str(tmp_path))
    (made,) = set(folder.glob("cache-*")) - before
    stored = [spark.read.parquet(f"file://{p}").count() for kind in ("versions", "parts") for p in (made / kind).iterdir()]
    assert out.count() == 900 * 600 + 899  # key D0 of documents, labels and one page; all other pages have a key of their own
    assert sum(stored) < 10_000  # two versions and the parts of both, as the input


def test_two_labels_are_joined_as_many(spark):
    values = [None, "", " ", "none", "None ", "B", " A", "A", "b"]
    rows = spark.createDataFrame([(x, y) for x in values for y in values], "x string, y string")
    got = rows.select(lists.joined_labels(F.col("x"), F.col("y")).alias("two"), lists.joined_labels(F.col("x"), F.col("y"), F.lit(None)).alias("many")).collect()
    assert all(r.two == r.many for r in got) and {"", "A", "A|B", "A|b"} < {r.two for r in got}


def test_polish_keeps_one_pass(spark):
    rows = spark.range(240).select(F.concat(F.lit("f"), (F.col("id") % 20).cast("string")).alias("feature"), F.concat(F.lit("s"), F.floor(F.col("id") / 20).cast("string")).alias("sample"), (1 + F.col("id") * 7 % 31).cast("double").alias("value"))
    samples = rows.select("sample").distinct().select("sample", F.lit("b").alias("batch"), (F.col("sample") < "s3").alias("ref"))
    folder = shared_dir(spark).removeprefix("file://")
    kept = lambda: len([p for p in Path(folder).glob("strandline/polish-*")])
    before = kept()
    out = matrices.median_polish(rows, samples, F.col("ref"), most_passes=3)
    assert out.filter("sample >= 's3'").count() == out.count() > 0 and kept() == before + 1
