"""Documents that are split over tasks, and schemas of many documents."""

import json
import random
import re
import xml.etree.ElementTree as ET

import pytest

from tessera.operators import extract, infer
from tessera.service_queries import BIG_JSON, CHAIN
from tessera.sources import documents
from tessera.sources.mapping import Mapping

SIZES = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")


@pytest.fixture
def split(spark):
    """Sets the size of splits."""
    saved = [spark.conf.get(k) for k in SIZES]
    spark.conf.set(SIZES[1], "1")
    yield lambda size: spark.conf.set(SIZES[0], size)
    for k, v in zip(SIZES, saved):
        spark.conf.set(k, v)


def value(rng, depth=0):
    k = rng.randrange(6 if depth < 3 else 4)
    if k == 0:
        return "".join(rng.choice('a{}[]"\\,: é🙂\n') for _ in range(rng.randrange(12)))
    if k < 4:
        return (rng.randrange(100), None, True)[k - 1]
    if k == 4:
        return [value(rng, depth + 1) for _ in range(rng.randrange(3))]
    return {rng.choice('abc}"'): value(rng, depth + 1) for _ in range(rng.randrange(3))}


@pytest.mark.parametrize("seed", range(3))
def test_json_arrays_are_split_anywhere(spark, split, tmp_path, seed):
    rng = random.Random(seed)
    rows = [{"k": k, **{c: value(rng) for c in "xyz"}} for k in range((0, 60, 300)[seed])]
    other = [{"no": k} for k in range(30)]
    (tmp_path / "root.json").write_text(json.dumps(rows, indent=(None, 2, 1)[seed], ensure_ascii=False), "utf-8")
    (tmp_path / "field.json").write_text(json.dumps({"meta": {"a": [1, {"v": 2}]}, "first": other, "value": rows, "last": other}, ensure_ascii=seed == 1) + "\n", "utf-8")
    for size in ("300", "2000", "1m"):
        split(size)
        for name, field in (("root.json", None), ("field.json", "value")):
            got = documents.ordinals(documents.json_elements(spark, str(tmp_path / name), field)).orderBy("ordinal").collect()
            assert [json.loads(r.body) for r in got] == rows and len({r.ordinal for r in got}) == len(rows)
            assert size == "1m" or len(rows) < 60 or len({r.split for r in got}) > 2


def test_folders_of_documents_and_of_none(spark, split, tmp_path):
    split("100")
    for k in range(3):
        (tmp_path / f"{k}.json").write_text(json.dumps([{"k": 10 * k + m} for m in range(5 * k)]))
    got = documents.ordinals(documents.json_elements(spark, str(tmp_path))).orderBy("ordinal").collect()
    assert sorted(json.loads(r.body)["k"] for r in got) == [10, 11, 12, 13, 14, *range(20, 30)] and len({r.ordinal for r in got}) == 15
    assert documents.json_elements(spark, str(tmp_path), "value").count() == 0


def test_xml_rows_are_split_at_their_ends(spark, split, tmp_path):
    text = "<doc at='1'><rows/>" + "".join(f'<row id="{k}"><v>{k} é</v></row>\n' if k % 3 else f"<row id=\"{k}\" w='>'/>" for k in range(200)) + "</doc>"
    (tmp_path / "a.xml").write_text(text, "utf-8")
    for size in ("500", "1m"):
        split(size)
        got = [r.body for r in documents.ordinals(documents.xml_elements(spark, str(tmp_path), "row")).orderBy("ordinal").collect()]
        assert [int(re.search(r'id="(\d+)"', x)[1]) for x in got] == list(range(200)) and all(ET.fromstring(x).tag == "row" for x in got)


def test_written_documents_are_documents(spark, tmp_path):
    df = spark.range(50).selectExpr("to_json(struct(id)) AS value").repartition(3)
    documents.write_documents(df, str(tmp_path / "d"), '{"a": [', ",", "]}")
    found = [json.loads(p.read_text()) for p in (tmp_path / "d").glob("part-*")]
    assert sorted(x["id"] for d in found for x in d["a"]) == list(range(50))
    documents.write_documents(df.limit(0), str(tmp_path / "e"), "[", ",", "]")
    assert all(json.loads(p.read_text() or "[]") == [] for p in (tmp_path / "e").glob("part-*"))


def test_only_documents_of_one_array_are_split(spark):
    m = Mapping.parse(CHAIN)
    assert extract.element_node(m, m.services["urn:map:customers"]).label == "customers"
    assert extract.element_node(m, m.services["urn:map:orders"]).label == "order"
    assert extract.element_node(m, m.services["urn:map:unused"]) is None
    big = Mapping.parse(BIG_JSON.replace("m:hasOutput m:big-root .", "m:hasOutput m:big-root , m:big-key ."))
    with pytest.raises(ValueError):
        extract.elements(spark, big, big.services["urn:map:big"], "nowhere")


@pytest.mark.parametrize("seed", range(4))
def test_summaries_merge_in_any_order(seed):
    rng = random.Random(seed)
    parts = [infer.json_summary({k: value(rng) for k in "abc" if rng.random() < 0.7}) for _ in range(12)]

    def same(x):
        return json.dumps(x, sort_keys=True)

    def folded(xs):
        out = xs[0]
        for x in xs[1:]:
            out = infer.merged_summaries(out, x)
        return out

    for _ in range(20):
        mixed = rng.sample(parts, len(parts))
        k = rng.randrange(1, len(parts))
        tree = infer.merged_summaries(folded(mixed[:k]), folded(mixed[k:]))
        assert same(tree) == same(folded(parts))


def test_the_schema_of_all_bodies_is_that_of_one_sample(spark):
    bodies = ['{"a": [{"x": 1}, {"y": {"z": null}}], "n": null}', '{"a": [{"y": {"z": "t", "w": true}}], "n": 2.5}', "no document", None, '{"a": [], "m": [1, 2]}']
    df = spark.createDataFrame([(b,) for b in bodies], "body string").repartition(3)
    m = infer.infer_mapping_of("http://h/x", "json", df)
    one = infer.infer_mapping("http://h/x", "json", '{"a": [{"x": 1}, {"y": {"z": "t", "w": true}}], "n": 2.5, "m": [1, 2]}')
    tree = lambda m: sorted((m.json_path(u), n.content, n.structure) for u, n in m.nodes.items())
    assert tree(m) == tree(one) and set(m.nodes) == set(one.nodes)
    x = spark.createDataFrame([("<d><r a='1'><t>5</t></r></d>",), ("<d>text<r b='x'/><r><t>word</t></r></d>",), ("<d",)], "body string").repartition(3)
    m = infer.infer_mapping_of("http://h/x", "xml", x)
    assert sorted((m.xpath(u), n.content) for u, n in m.nodes.items()) == [("/", "String"), ("/d/r", None), ("/d/r/@a", "Number"), ("/d/r/@b", "String"), ("/d/r/t", "String")]
    assert infer.infer_mapping_of("http://h/x?a=1", "json", df.limit(0)).nodes == {}
