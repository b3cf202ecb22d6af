"""Views keep all rows of the tables that they stand for."""

from strandline.plans import fixtures


def test_intervals_are_all_of_lineitem(spark):
    d = "/root/testdata/sf0.001"
    assert fixtures.load(spark, d, "v_interval_a").count() == fixtures.load(spark, d, "lineitem").count()


def test_first_source_is_all_of_documents(spark):
    d = "/root/testdata/sf0.001"
    assert fixtures.load(spark, d, "v_src_a").count() == fixtures.load(spark, d, "documents").count()
