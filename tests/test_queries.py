"""Every registered query of the library against its oracle on the smallest tables."""

import os

import pytest

from strandline.plans import registry
from strandline.plans.fixtures import TABLES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and v != v):
        return "NULL"
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    return str(list(v)) if isinstance(v, (list, tuple)) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    found = duck.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    want = sorted(tuple(plain(r[names.index(c)]) for c in order) for r in found.fetchall())
    assert sorted(tuple(plain(r[c]) for c in order) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys()))
def test_runs(spark, name):
    df = QUERIES[name](spark, SF_DIR)
    rows = df.collect()
    assert rows and len(set(map(str, rows))) > 1  # figures that depend on the rows


def test_entry_needs_no_training_data_package(monkeypatch, spark):
    import sys

    import __spark_entry__ as entry

    for m in [m for m in sys.modules if m.startswith("strandline.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, m)

    class Gone:
        def find_spec(self, name, path=None, target=None):
            if name.startswith("strandline.llm") or name == "corpus_pipeline":
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    monkeypatch.setattr(sys, "meta_path", [Gone(), *sys.meta_path])
    import strandline

    monkeypatch.delattr(strandline, "llm", raising=False)
    assert set(entry.queries()) == set(QUERIES) and set(entry.oracle_sql()) == set(ORACLES)
    assert entry.entry(spark).count() > 0
