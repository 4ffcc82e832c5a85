"""What large inputs change: the number of parts into which Spark deals what it shuffles."""

import pytest

from tessera import catalog_queries, shipping


@pytest.fixture()
def parts(spark, monkeypatch):
    """Parts of few bytes, so that small tables count as large; how many Spark has been told to make."""
    monkeypatch.setattr(shipping, "PART_BYTES", 50_000)
    yield lambda: int(spark.conf.get(shipping.PARTS, "0"))
    for key in (shipping.PARTS, shipping.MERGED):
        spark.conf.unset(key)
    spark.sparkContext._tessera_parts = None


def answer(spark, name, sf):
    return sorted(map(tuple, catalog_queries.QUERIES[name](spark, f"/root/testdata/{sf}").collect()), key=str)


@pytest.mark.parametrize("name", ["keyless_minus", "keyless_group", "keyless_exists", "typed_datatype"])
def test_larger_tables_are_dealt_into_more_parts(spark, parts, name):
    few = answer(spark, name, "sf0.001")
    assert parts() in (0, *range(5, 60))
    before = parts()
    answer(spark, name, "sf0.01")
    assert parts() > max(4, before)
    most = parts()
    assert answer(spark, name, "sf0.001") == few
    assert parts() == most  # frames made before may still run


@pytest.mark.parametrize("name", ["free_file_json", "free_file_xml"])
def test_larger_documents_are_dealt_into_more_parts(spark, parts, name):
    assert len(answer(spark, name, "sf0.01")) == spark.read.parquet("/root/testdata/sf0.01/orders.parquet").count()
    assert parts() > 4


def test_many_parts_of_spark_are_not_merged_into_large_ones(spark, parts):
    few = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        assert len(answer(spark, "free_file_json", "sf0.01")) == spark.read.parquet("/root/testdata/sf0.01/orders.parquet").count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", few)
    assert spark.conf.get(shipping.PARTS, None) is None and spark.conf.get(shipping.MERGED, None) == str(shipping.MERGED_BYTES)


def test_what_the_user_set_stays(spark, parts):
    spark.conf.set(shipping.PARTS, "7")
    answer(spark, "keyless_minus", "sf0.01")
    assert parts() == 7 and spark.conf.get(shipping.MERGED, None) is None


def test_small_inputs_change_nothing(spark):
    answer(spark, "keyless_minus", "sf0.01")
    assert spark.conf.get(shipping.PARTS, None) is None
