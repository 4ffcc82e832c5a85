"""Rows of split documents as tables give what their triples gave, and keep little."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessera import catalog_queries
from tessera.engine import Engine
from tessera.operators.materialise import Materialiser, Minting
from tessera.operators.planner import Options
from tessera.plans.compiler import Compiler
from tessera.plans.relation import Kind, apart
from tessera.plans.sparql import parse
from tessera.service_queries import BIG_JSON, PREFIXES
from tessera.sources import tables
from tessera.sources.mapping import Mapping
from tessera.sources.responders import Files

#: A second row entity, one with a row that is an inner one, and a property of the entities of a node.
MORE = BIG_JSON + """
m:big-customer ex:bought m:big-key .
m:big-resource2 a m:customResource ; m:big-total <http://www.w3.org/2001/XMLSchema#double> .
m:big-resource3 a m:customResource , ex:Third ; m:big-key <http://www.w3.org/2001/XMLSchema#string> ; ex:beside m:big-resource2 .
"""
ROWS = [
    {"key": "1", "paid": {"total": "10.5"}, "customer": "a"},
    {"key": 2, "paid": {"total": 9}, "customer": "b"},
    {"key": "3", "paid": {}, "customer": "a"},
    {"key": "4", "customer": "c"},
    {"key": "5", "paid": {"total": "10.50"}},
    {"paid": {"total": "7"}, "customer": "b"},
    {"key": "7"},
    {"other": 1},
    {"key": None, "paid": None, "customer": None},
    {"key": "1", "paid": {"total": "x"}, "customer": "a"},
]
QUERIES = [
    "SELECT ?k ?t ?n WHERE { ?x a ex:Order ; ex:key ?k ; ex:by ?c . ?c rdfs:label ?n OPTIONAL { ?x ex:total ?t } }",
    "SELECT * WHERE { ?x ex:key ?k OPTIONAL { ?x ex:total ?t } OPTIONAL { ?x ex:by ?c . ?c rdfs:label ?n } }",
    "SELECT * WHERE { ?x ex:key ?k OPTIONAL { ?x ex:by ?c } OPTIONAL { ?x ex:total ?t } OPTIONAL { ?c rdfs:label ?n } }",
    "SELECT * WHERE { ?x ex:key ?k OPTIONAL { ?x ex:total ?t } ?y ex:total ?t }",
    "SELECT * WHERE { ?x ex:key ?k OPTIONAL { ?x ex:total ?k } }",
    "SELECT * WHERE { ?x ex:key ?k OPTIONAL { ?x ex:none ?t } OPTIONAL { ?x rdfs:label ?l } }",
    "SELECT * WHERE { ?c a ex:Customer OPTIONAL { ?c ex:bought ?k } }",
    "SELECT * WHERE { ?x ex:key ?k OPTIONAL { ?x ex:total ?t } FILTER(!BOUND(?t)) }",
    "SELECT * WHERE { ?x ex:key ?k OPTIONAL { ?x ex:total ?t FILTER(?t > 9.5) } }",
    "SELECT ?k WHERE { ?x ex:total ?t ; ex:key ?k FILTER(?t > 9) }",
    "SELECT ?x WHERE { ?x ex:total 10.5 }",
    'SELECT ?x WHERE { ?x ex:total "10.5" }',
    'SELECT ?x ?c WHERE { ?x ex:key "1" ; ex:by ?c }',
    'SELECT ?x WHERE { ?x ex:key "1"@en }',
    "SELECT * WHERE { ?s ?p ?o }",
    "SELECT ?p (COUNT(*) AS ?n) WHERE { ?x a ex:Order ; ?p ?o } GROUP BY ?p",
    "SELECT * WHERE { ?x ?p 9 }",
    "SELECT * WHERE { ?s rdfs:label ?l }",
    "SELECT * WHERE { ?s a ?t ; rdfs:label ?l }",
    "SELECT * WHERE { ?s a ?t OPTIONAL { ?s a ex:Order ; ex:key ?k } }",
    "SELECT ?k ?n WHERE { ?x ex:key ?k ; ex:by/rdfs:label ?n }",
    "SELECT ?k ?y WHERE { ?x ex:by ?c ; ex:key ?k . ?y ex:by ?c FILTER(?x != ?y) }",
    "SELECT ?n (COUNT(?x) AS ?many) (MAX(?t) AS ?most) WHERE { ?x ex:by ?c . ?c rdfs:label ?n OPTIONAL { ?x ex:total ?t } } GROUP BY ?n",
    "SELECT DISTINCT ?c WHERE { ?x ex:by ?c MINUS { ?y ex:by ?c ; ex:total ?t } }",
    "SELECT ?x WHERE { ?x ex:key ?k FILTER NOT EXISTS { ?x ex:by ?c } }",
    "SELECT ?x ?k WHERE { { ?x ex:key ?k } UNION { ?k ex:bought ?x } }",
    "SELECT * WHERE { ?x ex:beside ?y . ?y rdfs:label ?l }",
    "SELECT * WHERE { ?x ex:by ?x }",
    "SELECT * WHERE { ?x ex:by ?c ; (ex:by|ex:total) ?o }",
    "SELECT ?k ?t WHERE { ?x ex:key ?k OPTIONAL { ?x ex:total ?t } } ORDER BY ?t ?k LIMIT 3",
    "SELECT (COUNT(*) AS ?n) WHERE { ?a ex:key ?k . ?b ex:total ?t }",
]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("docs")
    for k in range(2):
        (at / f"{k}.json").write_text(json.dumps({"orders": ROWS[5 * k : 5 * k + 5]}))
    return str(at)


def engine(spark, folder, mapping=MORE, graph=None, prefixes=PREFIXES, **options):
    return Engine(spark, graph, prefixes, Mapping.parse(mapping), Files({"urn:map:big": folder}), Options(deadline=None, **options))


@pytest.fixture
def tables_made(monkeypatch):
    """The row entities that became tables."""
    made, keep = [], Materialiser.keep_apart

    def run(self, elements):
        keep(self, elements)
        made.extend(self.apart)

    monkeypatch.setattr(Materialiser, "keep_apart", run)
    return made


def both(monkeypatch, ask):
    """Answers with tables and with triples."""
    got = ask()
    with monkeypatch.context() as m:
        m.setattr(Materialiser, "keep_apart", lambda self, elements: None)
        return got, ask()


def answer(df):
    return sorted(map(repr, df.collect())), df.columns


@pytest.fixture(scope="module")
def graphs(spark, folder):
    """The graph with tables, and with triples only."""
    with pytest.MonkeyPatch.context() as m:
        return both(m, lambda: engine(spark, folder)._ready(QUERIES[0], None, None)[1])


def answers(spark, graphs, query):
    return [answer(Compiler(spark, g).result(parse(query, PREFIXES))[0]) for g in graphs]


def test_row_entities_of_one_value_each_become_tables(graphs):
    new, old = graphs
    assert [m.minted for m in new.maps] == ["urn:map:big-resource1", "urn:map:big-resource2"] and not old.maps
    assert new.triples.where(F.col("p").isin("urn:ex:total", "urn:ex:by")).isEmpty() and new.said >= {r.p for r in new.triples.select("p").distinct().collect()}


@pytest.mark.parametrize("query", QUERIES)
def test_tables_answer_as_triples(spark, graphs, query):
    got, want = answers(spark, graphs, query)
    assert got == want


def test_a_row_by_its_iri(spark, graphs):
    x = answers(spark, graphs, 'SELECT ?x WHERE { ?x ex:total "9" ; ex:key ?k }')[0][0][0].split("'")[1]
    got, want = answers(spark, graphs, f"SELECT * WHERE {{ <{x}> ?p ?o ; ex:key ?k OPTIONAL {{ <{x}> ex:by ?c }} }}")
    assert got == want and got[0]


def test_a_limit_is_counted_on_triples(spark, folder, tables_made):
    assert engine(spark, folder).query("SELECT ?k WHERE { ?x ex:key ?k } LIMIT 3").count() == 3 and not tables_made


def test_results_documents_are_the_same(spark, folder, monkeypatch):
    got, want = both(monkeypatch, lambda: json.loads(engine(spark, folder).json(QUERIES[1])))
    key = lambda d: sorted(json.dumps(b, sort_keys=True) for b in d["results"]["bindings"])
    assert key(got) == key(want) and got["head"] == want["head"]


def test_beside_tables_of_the_graph(spark, folder, monkeypatch, tables_made):
    graph = tables.graph(spark, "/root/testdata/sf0.001")
    text = 'SELECT ?n ?r ?k ?t WHERE { ?x a ex:Order ; ex:key ?k OPTIONAL { ?x ex:total ?t } ?n t:n_nationkey ?k ; t:n_regionkey ?r }'
    got, want = both(monkeypatch, lambda: answer(engine(spark, folder, graph=graph, prefixes={**PREFIXES, **tables.PREFIXES}).query(text)))
    assert got == want and tables_made


def test_where_something_else_may_have_the_rows_they_stay_triples(spark, folder, tables_made, monkeypatch):
    engine(spark, folder, BIG_JSON, all_to_all=True).query(QUERIES[0])
    engine(spark, folder, BIG_JSON, minting=Minting(known=spark.createDataFrame([("a", "urn:ex:Customer", "urn:a")], "label string, class string, iri string"))).query(QUERIES[0])
    engine(spark, folder, BIG_JSON.replace('rdfs:label "paid" ; m:hasStructure "JSON_Object"', 'rdfs:label "paid" ; m:hasStructure "JSON_Array"')).query(QUERIES[0])
    assert not tables_made
    engine(spark, folder, BIG_JSON).query(QUERIES[0])
    assert tables_made == ["urn:map:big-resource1"]


def test_digests_of_two_classes_are_apart():
    a, b = (Kind("iri", "urn:e:", minted=x) for x in ("urn:A", "urn:B"))
    assert apart(a, b) and not apart(a, a) and not apart(a, Kind("iri", "urn:e:")) and not apart(a, Kind("iri"))


def kept(spark):
    """Bytes of what is kept, and of documents."""
    found = [p for p in Path(spark.sparkContext.getCheckpointDir().removeprefix("file:")).rglob("*") if p.is_file()]
    docs = {p for p in found if any(x.name.startswith("documents-") for x in p.parents)}
    return sum(p.stat().st_size for p in found if p not in docs), sum(p.stat().st_size for p in docs)


def test_less_is_kept_than_the_documents_have(spark):
    before = kept(spark)
    df = catalog_queries.QUERIES["free_file_json"](spark, "/root/testdata/sf0.1")
    rest, docs = (x - y for x, y in zip(kept(spark), before))
    assert 0 < rest < docs
    o = spark.read.parquet("/root/testdata/sf0.1/orders.parquet")
    assert df.agg(F.count("k"), F.count("t")).first() == o.agg(F.count("o_orderkey"), F.sum((F.col("o_orderkey") % 5 > 0).cast("long"))).first()
