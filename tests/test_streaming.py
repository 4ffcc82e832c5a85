"""Patterns over a stream equal the same patterns over the table."""

import shutil

import pytest
from pyspark.sql import functions as F

from tessera.engine import Engine
from tessera.plans.terms import UnsupportedQuery
from tessera.sources import tables
from tessera.streaming.patterns import stream, streaming_graph, windowed

SF = "/root/testdata/sf0.001"


@pytest.fixture
def engines(spark, tmp_path):
    (tmp_path / "in").mkdir()
    shutil.copy(f"{SF}/events.parquet", tmp_path / "in" / "events.parquet")
    at_rest = tables.graph(spark, SF)
    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    moving = streaming_graph(at_rest, {"urn:t:events/": spark.readStream.schema(schema).parquet(str(tmp_path / "in"))})
    return Engine(spark, at_rest, tables.PREFIXES), Engine(spark, moving, tables.PREFIXES)


def drained(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return sorted(map(repr, spark.table(name).collect()))


def test_star_filter_and_static_join(spark, engines):
    text = "SELECT ?e ?v ?seg WHERE { ?e t:event_type 'click' ; t:value ?v ; t:user_id ?u . ?u t:c_mktsegment ?seg FILTER(?v > 20) }"
    rest, moving = engines
    assert stream(moving, text).isStreaming
    assert drained(spark, stream(moving, text), "star_rows") == sorted(map(repr, rest.query(text).collect()))


def test_windows_with_a_watermark(spark, engines):
    text = "SELECT ?k ?v ?at WHERE { ?e t:event_type ?k ; t:value ?v ; t:ts ?at }"
    rest, moving = engines
    agg = {"n": F.count(F.lit(1)), "most": F.max("v")}
    got = drained(spark, windowed(stream(moving, text), "at", "1 day", ["k"], **agg), "window_rows", "complete")
    assert got == sorted(map(repr, windowed(rest.query(text), "at", "1 day", ["k"], **agg).collect())) and got


def test_state_without_bound_is_refused(engines):
    with pytest.raises(UnsupportedQuery):
        stream(engines[1], "SELECT ?k (COUNT(*) AS ?n) WHERE { ?e t:event_type ?k } GROUP BY ?k")
