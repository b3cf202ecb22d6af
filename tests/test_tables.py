"""Batch folders, merges refreshed by source, and exports, on files that change."""

import hashlib

import pytest

from strandline.operators.merging import merge_keys, merge_sources
from strandline.sources import tables


def lines(folder, rows, name="psm.tsv"):
    folder.mkdir(parents=True)
    (folder / name).write_text("psm_id\tpeptide\n" + "".join(f"{i}\t{p}\n" for i, p in rows))


@pytest.fixture
def batches(tmp_path):
    lines(tmp_path / "b1", [(1, "AK"), (2, "CK")])
    lines(tmp_path / "b2" / "results", [(3, "AK")])  # one folder below
    lines(tmp_path / "name=b12", [(4, "CK"), (5, "AK")])  # a partition folder
    lines(tmp_path / "round2" / "b1", [(6, "AK")])
    lines(tmp_path / "b3", [(7, "AK")], "other.tsv")  # without the file
    return str(tmp_path)


SCHEMA = "psm_id long, peptide string"


def test_batches_are_told_by_their_folders(spark, batches):
    rows = tables.read_batches(spark, batches, "psm.tsv", SCHEMA)
    want = [(1, "b1", 1), (2, "b1", 1), (3, "b2", 1), (4, "b12", 1), (5, "b12", 1), (6, "round2/b1", 2)]
    assert sorted(map(tuple, rows.select("psm_id", "batch", "round").collect())) == want
    assert rows.columns == ["psm_id", "peptide", "batch", "round"]
    tables.drop_batches(spark)
    assert not spark.catalog.listTables(pattern=f"{tables.BATCHES}*")


def test_only_wanted_batches_are_opened(spark, batches, tmp_path):
    kept = spark.createDataFrame([("AK", "b12"), ("AK", "round2/b1"), ("ZK", "b9"), (None, "b12"), ("CK", None)], "peptide string, batch string")
    rows = tables.read_batches(spark, batches, "psm.tsv", SCHEMA, kept)
    # CK is wanted from no batch that is named, but read from those that are, as AK is
    assert sorted(r[0] for r in rows.collect()) == [4, 5, 6]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()
    files = tmp_path / "b1" / "psm.tsv"
    files.unlink()  # a file of another batch is missed only by those who open it
    assert sorted(r[0] for r in rows.collect()) == [4, 5, 6]
    tables.drop_batches(spark)


@pytest.mark.parametrize("root", ["batches-3cb9", "b7", "round2", "a b $1/name=b8"])
def test_the_root_is_no_batch(spark, tmp_path, root):
    for i, at in enumerate(["b1", "name=b2/results", "round2/b3", "deep/b4", "lib5"]):
        lines(tmp_path / root / at, [(i, "AK")])
    for path in (f"{tmp_path}/{root}", f"file://{tmp_path}/{root}/"):
        rows = tables.read_batches(spark, path, "psm.tsv", SCHEMA)
        # a folder whose name only ends as a batch's is none
        assert sorted(map(tuple, rows.select("psm_id", "batch", "round").collect())) == [(0, "b1", 1), (1, "b2", 1), (2, "round2/b3", 2), (3, "b4", 1)]
    tables.drop_batches(spark)


def test_no_batches(spark, tmp_path):
    (tmp_path / "b1").mkdir()
    assert tables.read_batches(spark, str(tmp_path), "psm.tsv", SCHEMA).collect() == []
    tables.drop_batches(spark)


def test_a_changed_source_rebuilds_its_part_only(spark, tmp_path):
    path, made = f"file://{tmp_path}/cache", []
    sources = {name: [f"file://{tmp_path}/{name}"] for name in "abc"}
    put = lambda name, rows: spark.createDataFrame(rows, "sequence string, v int").write.mode("append").parquet(sources[name][0])
    for name in "abc":
        put(name, [("x", 1), (name, 2), (None, 3)])

    def load(name):
        made.append(name)
        return spark.read.parquet(*sources[name])

    build = lambda: tables.refreshed(spark, path, sources, load, merge_sources)
    first = build()
    assert made == ["a", "b", "c"] and first.count() == 7
    assert build().count() == 7 and made == ["a", "b", "c"]  # nothing changed
    put("b", [("y", 4)])

    def fails(parts):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):  # a build that ends early publishes nothing
        tables.refreshed(spark, path, sources, load, fails)
    assert tables.manifest(spark, path).count() == 3
    seen = []

    def slow(parts):
        seen.append((first.count(), {r["version"] for r in tables.manifest(spark, path).collect()}))  # a reader during the build
        return merge_sources(parts)

    second = tables.refreshed(spark, path, sources, load, slow)
    assert seen == [(7, {1})] and made[3:] == ["b", "b"]
    assert second.count() == 8 and first.count() == 7  # the version before stays readable
    put("c", [("z", 5)])
    third = build()
    assert third.count() == 9 and second.count() == 8 and made[5:] == ["c"]
    kept = tables.manifest(spark, path).collect()
    assert {r["version"] for r in kept} == {2, 3} and len(list((tmp_path / "cache" / "versions").iterdir())) == 2
    assert sorted(map(tuple, third.select("sequence", "b_v").filter("b_v = 4").collect())) == [("y", 4)]


def test_a_table_combined_when_it_is_read(spark, tmp_path):
    path, made = f"file://{tmp_path}/cache", []
    sources = {name: [f"file://{tmp_path}/{name}"] for name in "ab"}
    put = lambda name, rows: spark.createDataFrame(rows, "sequence string, v int").write.mode("append").parquet(sources[name][0])
    load = lambda name: spark.read.parquet(*sources[name])
    plain = lambda df: sorted(map(str, df.collect()))

    def keys(parts):
        made.append(sorted(parts))
        return merge_keys(parts)

    build = lambda: tables.refreshed(spark, path, sources, load, keys, combine=lambda parts, k: merge_sources(parts, keys=k))
    whole = lambda: plain(merge_sources({name: load(name) for name in "ab"}))
    put("a", [("x", 1), ("x", 2), ("y", 3), (None, 4)])
    put("b", [("x", 5), ("x", 6), ("z", 7), (None, 8)])
    first, want = build(), whole()
    assert plain(first) == want == plain(build()) and len(want) == 8 and len(made) == 1  # nothing changed: nothing was made
    put("b", [("y", 9), ("w", 10)])
    second = build()
    assert plain(second) == whole() and second.count() == 9 and plain(first) == want  # the version before stays readable
    put("a", [("w", 11)])
    assert plain(build()) == whole() and second.count() == 9 and len(made) == 3


def test_the_export_describes_what_was_written(spark, tmp_path):
    df = spark.createDataFrame([("x", 1), ("y", None), (None, 3)], "name string, `a b` int")
    none = spark.createDataFrame([], "name string")
    contents, columns = tables.export_tables({"S1": (df, "one"), "S2": (none, "none")}, f"file://{tmp_path}/out", {"name": "what it is called"})
    assert [tuple(r) for r in contents.orderBy("position").collect()] == [(0, "S1", "one", 2, 3), (1, "S2", "none", 1, 0)]
    digest = lambda *texts: sum(int(hashlib.md5(t.encode()).hexdigest()[:8], 16) for t in texts)
    assert [tuple(r) for r in columns.orderBy("name", "position").collect()] == [
        ("S1", 0, "name", "string", "what it is called", 2, digest("x", "y")),
        ("S1", 1, "a b", "int", None, 2, digest("1", "3")),
        ("S2", 0, "name", "string", "what it is called", 0, 0),
    ]


def test_endings_are_renamed(spark, tmp_path):
    from strandline.sources.storage import rename_endings

    for i in range(25):
        (tmp_path / f"part-{i}.txt").write_text(str(i))
    (tmp_path / "_SUCCESS").write_text("")
    assert rename_endings(spark, f"file://{tmp_path}", ".txt", ".rows", at_once=10) == 25
    assert {f.name: f.read_text() for f in tmp_path.iterdir()} == {f"part-{i}.rows": str(i) for i in range(25)} | {"_SUCCESS": ""}
    assert rename_endings(spark, f"file://{tmp_path}", ".txt", ".rows") == 0
