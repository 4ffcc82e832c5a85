"""Parser, algebra and compiled queries against SQL twins and RDF semantics."""

import json
import math

import duckdb
import pytest

from tessera import catalog_queries, sparql_queries
from tessera.engine import Engine
from tessera.plans.sparql import Exists, Group, Path, parse
from tessera.plans.terms import Lit, UnsupportedQuery, Var
from tessera.sources import tables
from tessera.sources.graph import Graph

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v.to_pydatetime() if hasattr(v, "to_pydatetime") else v


@pytest.mark.parametrize("name", sorted(catalog_queries.QUERIES))
def test_query_equals_its_sql_twin(spark, con, name):
    df = catalog_queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    cur = con.execute(catalog_queries.ORACLES[name])
    at = [[d[0] for d in cur.description].index(c) for c in cols]
    want = sorted(repr([plain(r[k]) for k in at]) for r in cur.fetchall())
    assert len(cur.description) == len(cols) and got == want


def test_parser_reads_the_grammar():
    q = parse("""BASE <http://b/> PREFIX p: <http://p/> # a remark
      SELECT DISTINCT ?a (COUNT(DISTINCT ?b) AS ?n) WHERE { ?a p:x|^p:y/p:z* [ p:q "l\\n"@en, 'm'^^<t>, 1, -2.5, 3e4, true ] ; a p:C . (1 ?b) p:w <r> }
      GROUP BY ?a (STRLEN(?c) AS ?k) HAVING (COUNT(*) > 1) ORDER BY DESC(?n) ?a LIMIT 3 OFFSET 2""")
    assert q.distinct and q.limit == 3 and q.offset == 2 and [n for n, _ in q.projection] == ["a", "n"]
    path = next(x.p for k, x in q.where.elements if k == "triple" and isinstance(x.p, Path))
    assert path.op == "alt" and path.args[1].op == "seq" and path.args[1].args[1].op == "star"


@pytest.mark.parametrize("text", ["ASK { ?s ?p ?o }", "CONSTRUCT { ?s ?p ?o } WHERE { ?s ?p ?o }", "DESCRIBE <x>", "SELECT * WHERE { GRAPH <g> { ?s ?p ?o } }", "SELECT * FROM <g> WHERE { ?s ?p ?o }", "SELECT * WHERE { SERVICE <s> { ?s ?p ?o } }", "SELECT ?x WHERE { ?x u:y ?z }", "SELECT * WHERE { ?s ?p }", "SELECT * WHERE { ?s <p> ?o } nonsense"])
def test_what_is_not_supported_is_refused(text):
    with pytest.raises(UnsupportedQuery):
        parse(text)


def plan(spark, sparql):
    df = Engine(spark, tables.graph(spark, SF), tables.PREFIXES).query(sparql)
    return df._jdf.queryExecution().executedPlan().toString()


def test_patterns_of_one_subject_are_one_scan(spark):
    text = plan(spark, "SELECT ?p ?d WHERE { ?o t:o_totalprice ?p ; t:o_orderdate ?d ; t:o_orderstatus 'F' }")
    assert text.count("FileScan") == 1 and "Join" not in text and "EqualTo(o_orderstatus,F)" in text


def test_constant_iris_reach_the_scan(spark):
    assert "EqualTo(c_nationkey,7)" in plan(spark, "SELECT ?a WHERE { ?c t:c_nationkey <urn:t:nation/7> ; t:c_acctbal ?a }")
    assert "EqualTo(c_custkey,7)" in plan(spark, "SELECT ?a WHERE { ?c t:c_acctbal ?a FILTER(?c = <urn:t:customer/7>) }")


def test_links_join_on_native_keys_and_unbound_ones_without_a_product(spark):
    text = plan(spark, "SELECT ?n WHERE { ?o t:o_custkey ?c . ?c t:c_name ?n }")
    assert "concat" not in text and "CartesianProduct" not in text
    text = plan(spark, "SELECT ?d ?q ?x WHERE { ?d t:lang 'fr' OPTIONAL { ?d t:quality ?q } ?x t:p_size ?q }")
    assert "CartesianProduct" not in text.split("Union")[0]


MAYBE = "?d t:lang 'fr' OPTIONAL { ?d t:quality ?q }"


@pytest.mark.parametrize("tail", ["OPTIONAL { ?d t:toxic ?q ; t:quality ?z }", "MINUS { ?d t:toxic ?q }", "FILTER EXISTS { ?d t:toxic ?q }", "FILTER NOT EXISTS { ?d t:toxic ?q }", "OPTIONAL { ?d t:n_chars ?c OPTIONAL { ?d t:toxic ?q } }"])
def test_variables_that_may_be_unbound_need_no_nested_loop(spark, tail):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(spark, f"SELECT * WHERE {{ {MAYBE} {tail} }}")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "NestedLoop" not in text and "Cartesian" not in text


@pytest.mark.parametrize("name", ["exists_in_exists", "not_exists_nested_group", "exists_union_correlated", "exists_optional_filter", "exists_minus_correlated", "optional_exists", "exists_in_having", "exists_in_aggregate"])
def test_correlated_exists_needs_no_nested_loop(spark, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(spark, sparql_queries.PAIRS[name][0])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "NestedLoop" not in text and "Cartesian" not in text


NUMBERS = [(f"u:{s}", f"u:{p}", o) for s, p, o in [("a", "p", 1), ("a", "p", 4), ("b", "p", 2), ("c", "p", 3), ("a", "q", 2), ("b", "q", 2), ("b", "q", 5), ("d", "q", 1), ("c", "r", 3), ("d", "r", 4), ("a", "r", 1)]]


def solve(g, row):
    """Plain solutions of a group for an outer row, whose values stand for its variables everywhere."""

    def value(t, m):
        return m.get(t.name) if isinstance(t, Var) else t.python() if isinstance(t, Lit) else t.value

    def test(e, m):
        if isinstance(e, Exists):
            return bool(solve(e.group, m)) != e.negated
        if e.name == "!":
            return None if (x := test(e.args[0], m)) is None else not x
        if e.name in ("&&", "||"):
            x, y = (test(a, m) for a in e.args)
            end = e.name == "||"
            return end if end in (x, y) else None if None in (x, y) else not end
        if e.name == "bound":
            return e.args[0].name in m
        x, y = (value(a, m) for a in e.args)
        return None if x is None or y is None else {"<": x < y, ">": x > y, "=": x == y, "!=": x != y}[e.name]

    def joined(a, b):
        return [x | y for x in a for y in b if all(x[k] == y[k] for k in x.keys() & y.keys())]

    out, filters = [dict(row)], []
    for kind, x in g.elements:
        if kind == "filter":
            filters.append(x)
        elif kind == "triple":
            found = []
            for s, p, o in NUMBERS:
                if p == x.p.value:
                    m = {x.s.name: s}
                    if not isinstance(x.o, Var):
                        found += [m] if value(x.o, {}) == o else []
                    elif x.o.name != x.s.name:
                        found.append(m | {x.o.name: o})
            out = joined(out, found)
        elif kind == "union":
            out = joined(out, [m for part in x for m in solve(part, row)])
        elif kind == "group":
            out = joined(out, solve(x, row))
        elif kind == "minus":
            right = [{k: v for k, v in m.items() if k not in row} for m in solve(x, row)]
            out = [m for m in out if not any(m.keys() & r.keys() and all(m[k] == r[k] for k in m.keys() & r.keys()) for r in right)]
        elif kind == "optional":
            inner = Group(tuple(e for e in x.elements if e[0] != "filter"))
            conditions, kept = [e for k, e in x.elements if k == "filter"], []
            for m in out:
                both = [n for n in joined([m], solve(inner, row)) if all(test(c, n) for c in conditions)]
                kept += both or [m]
            out = kept
    return [m for m in out if all(test(f, m) for f in filters)]


@pytest.mark.parametrize(
    "inner",
    [
        "?x u:q ?b FILTER EXISTS { ?z u:r ?c FILTER(?c > ?a) FILTER NOT EXISTS { ?z u:q ?d FILTER(?d < ?b) } }",
        "{ ?x u:q ?b FILTER(?b > ?a) } UNION { ?x u:r ?b FILTER(?b = ?a) }",
        "?z u:q ?b OPTIONAL { ?z u:r ?c FILTER(?c > ?a) } FILTER(!BOUND(?c) && ?b > ?a)",
        "?z u:q ?b OPTIONAL { ?z u:r ?a } FILTER(BOUND(?a))",
        "?z u:r ?b MINUS { ?z u:q ?c FILTER(?c > ?a) }",
        "?z u:r ?b MINUS { ?x u:p ?a }",
        "{ { ?z u:r ?c FILTER(?c < ?a) } ?z u:q ?b } FILTER(?b != ?a)",
        "?z u:r ?c OPTIONAL { ?z u:q ?b FILTER EXISTS { ?x u:r ?e FILTER(?e = ?c || ?b > ?a) } } FILTER(BOUND(?b))",
        "{ ?z u:q ?a OPTIONAL { ?z u:r ?o } } FILTER(?o > 0 || ?a = 2)",
        "OPTIONAL { ?x u:r ?o } ?z u:q ?b FILTER(?o < ?b)",
    ],
)
@pytest.mark.parametrize("negated", [False, True])
def test_exists_stands_for_the_outer_row(spark, inner, negated):
    text = f"SELECT ?x ?a ?o WHERE {{ ?x u:p ?a OPTIONAL {{ ?x u:r ?o FILTER(?o != 3) }} FILTER {'NOT ' if negated else ''}EXISTS {{ {inner} }} }}"
    rows = [(s, p, str(o), "literal", "http://www.w3.org/2001/XMLSchema#integer") for s, p, o in NUMBERS]
    graph = Graph(triples=spark.createDataFrame(rows, "s string, p string, o string, o_kind string, o_datatype string"))
    got = Engine(spark, graph, {"u": "u:"}).query(text).collect()
    want = solve(parse(text, {"u": "u:"}).where, {})
    assert sorted(repr((r.x, r.a, r.o)) for r in got) == sorted(repr((m["x"], str(m["a"]), str(m["o"]) if "o" in m else None)) for m in want)


def test_variable_predicates_push_constants_and_keep_keys(spark):
    text = plan(spark, "SELECT ?p ?o WHERE { <urn:t:orders/5> ?p ?o }")
    assert "EqualTo(o_orderkey,5)" in text and text.count("FileScan") == 1
    text = plan(spark, "SELECT ?s ?p WHERE { ?s ?p <urn:t:nation/3> }")
    assert "EqualTo(c_nationkey,3)" in text and "EqualTo(s_nationkey,3)" in text and text.count("FileScan") == 2
    text = plan(spark, "SELECT ?p ?o WHERE { ?s t:n_name 'NATION_1' ; ?p ?o }")
    assert text.count("FileScan") == 2 and "urn:t:nation/" not in text.split("FileScan")[0].split("Join")[-1]
    text = plan(spark, "SELECT ?o WHERE { <urn:t:nation/5> !(t:n_name|t:n_nationkey|rdf:type) ?o }")
    assert "ReadSchema: struct<n_nationkey:bigint,n_regionkey:bigint>" in text or "n_name" not in text.split("ReadSchema")[1].split("\n")[0]


def test_paths_from_a_constant_keep_what_it_reaches(spark, monkeypatch):
    from tessera.plans import compiler

    sizes, keep = [], compiler._checkpointed
    monkeypatch.setattr(compiler, "_checkpointed", lambda df: sizes.append((out := keep(df)).count()) or out)
    df = Engine(spark, tables.graph(spark, SF), tables.PREFIXES).query("SELECT ?y WHERE { <urn:t:orders/5> (t:o_custkey|t:c_nationkey|t:n_regionkey)* ?y }")
    assert df.count() == 4 and sizes == [1, 1, 1, 0]


def test_paths_from_a_joined_end_keep_what_its_values_reach(spark, monkeypatch):
    from tessera.plans import compiler

    sizes, keep = [], compiler._checkpointed
    monkeypatch.setattr(compiler, "_checkpointed", lambda df: sizes.append((out := keep(df)).count()) or out)
    e = Engine(spark, tables.graph(spark, SF), tables.PREFIXES)
    df = e.query("SELECT ?y WHERE { ?x t:n_name 'NATION_3' . ?x (t:o_custkey|t:c_nationkey|t:n_regionkey)+ ?y }")
    assert df.count() == 1 and sizes == [1, 1, 0]
    sizes.clear()
    df = e.query("SELECT ?c ?y WHERE { ?c t:c_name ?n FILTER(?c = <urn:t:customer/3> || ?c = <urn:t:customer/4>) ?c (t:c_nationkey/t:n_regionkey)* ?y }")
    assert df.count() == 4
    assert rows(spark, "SELECT ?x ?y WHERE { ?x u:n '5' . ?x u:p* ?y }") == [("u:a", "u:a"), ("u:a", "u:b"), ("u:a", "u:c")]
    assert rows(spark, "SELECT ?x WHERE { ?x u:n ?v . ?x u:p+ ?x }") == [("u:a",), ("u:b",), ("u:c",)]


def test_rows_without_a_key_are_not_joined(spark):
    from tessera.sources.graph import table_map

    df = spark.createDataFrame([(1, "a"), (1, "b")], "k long, v string")
    e = Engine(spark, Graph([table_map(df, "urn:t:x/", None, "urn:t:")]), tables.PREFIXES)
    assert e.query("SELECT ?v WHERE { ?x t:k 1 ; t:v ?v }").count() == 2
    assert e.query("SELECT (COUNT(?x) AS ?n) WHERE { ?x t:k 1 }").first().n == 2
    for text in ("SELECT ?x WHERE { ?x t:k 1 }", "SELECT ?v WHERE { ?x t:v ?v OPTIONAL { ?x t:k ?k } }", "SELECT ?v WHERE { ?x t:v ?v MINUS { ?x t:k 1 } }", "SELECT ?v WHERE { ?x t:v ?v FILTER EXISTS { ?x t:k 1 } }", "SELECT (COUNT(*) AS ?n) WHERE { ?x t:k 1 } GROUP BY ?x", "SELECT ?p WHERE { ?x ?p ?o }", "SELECT DISTINCT ?x WHERE { ?x t:k 1 }"):
        with pytest.raises(UnsupportedQuery):
            e.query(text)
    both = Engine(spark, Graph([table_map(df, "urn:t:x/", ("k", "v"), "urn:t:")]), tables.PREFIXES)
    assert sorted(r.x for r in both.query("SELECT ?x WHERE { ?x t:k 1 OPTIONAL { ?x t:v ?v } }").collect()) == ["urn:t:x/1/a", "urn:t:x/1/b"]
    assert [r.v for r in both.query("SELECT ?v WHERE { <urn:t:x/1/b> t:v ?v }").collect()] == ["b"]


def test_a_literal_is_no_iri_of_the_same_text(spark):
    assert rows(spark, "SELECT ?x WHERE { ?x u:q ?y . ?y u:p ?z }") == [("_:z",)]
    assert rows(spark, "SELECT ?x ?a WHERE { ?x u:q ?y . ?a u:p ?y }") == [("_:z", "u:a")]


def test_incompatible_prefixes_meet_nowhere(spark):
    assert "FileScan" not in plan(spark, "SELECT ?x WHERE { ?x t:n_name ?a ; t:c_name ?b }")


def triples(spark):
    rows = [("u:a", "u:p", "u:b", "iri"), ("u:b", "u:p", "u:c", "iri"), ("u:c", "u:p", "u:a", "iri"), ("u:a", "u:n", "5", "literal"), ("u:b", "u:n", "40", "literal"), ("u:c", "u:n", "x", "literal"), ("u:a", "u:q", "u:b", "literal"), ("_:z", "u:q", "u:b", "iri")]
    return Graph(triples=spark.createDataFrame(rows, "s string, p string, o string, o_kind string"))


def rows(spark, sparql):
    return sorted(tuple(r) for r in Engine(spark, triples(spark), {"u": "u:", "xsd": "http://www.w3.org/2001/XMLSchema#"}).query(sparql).collect())


def test_plain_triples(spark):
    assert rows(spark, "SELECT ?x ?z WHERE { ?x u:p ?y . ?y u:p ?z }") == [("u:a", "u:c"), ("u:b", "u:a"), ("u:c", "u:b")]
    assert rows(spark, "SELECT ?x WHERE { ?x u:n ?n FILTER(xsd:integer(?n) > 4) }") == [("u:a",), ("u:b",)]
    assert rows(spark, "SELECT ?x WHERE { ?x u:q ?y FILTER isIRI(?y) }") == [("_:z",)]
    assert rows(spark, "SELECT ?x WHERE { ?x u:q 'u:b' }") == [("u:a",)]
    assert rows(spark, "SELECT ?x WHERE { ?x u:q <u:b> FILTER isBlank(?x) }") == [("_:z",)]


def test_paths_over_a_cycle(spark):
    assert rows(spark, "SELECT ?y WHERE { <u:a> u:p+ ?y }") == [("u:a",), ("u:b",), ("u:c",)]
    assert rows(spark, "SELECT ?y WHERE { <u:none> u:p* ?y }") == [("u:none",)]
    assert rows(spark, "SELECT ?x ?y WHERE { ?x ^u:p/u:n ?y }") == [("u:a", "x"), ("u:b", "5"), ("u:c", "40")]


def test_minus_and_not_exists_differ_without_shared_variables(spark):
    assert len(rows(spark, "SELECT ?x WHERE { ?x u:n ?n MINUS { ?y u:p ?z } }")) == 3
    assert rows(spark, "SELECT ?x WHERE { ?x u:n ?n FILTER NOT EXISTS { ?y u:p ?z } }") == []


def test_variables_that_differ_by_case(spark):
    got = Engine(spark, triples(spark), {"u": "u:"}).query("SELECT ?x ?X WHERE { ?x u:p ?X }")
    assert sorted(tuple(r) for r in got.collect()) == [("u:a", "u:b"), ("u:b", "u:c"), ("u:c", "u:a")]


def test_results_document(spark):
    doc = json.loads(Engine(spark, tables.graph(spark, SF), tables.PREFIXES).json("SELECT ?x ?k ?q WHERE { ?x t:r_regionkey ?k FILTER(?k = 2) OPTIONAL { ?x t:quality ?q } }"))
    assert doc == {"head": {"vars": ["x", "k", "q"]}, "results": {"bindings": [{"x": {"type": "uri", "value": "urn:t:region/2"}, "k": {"type": "literal", "value": "2", "datatype": "http://www.w3.org/2001/XMLSchema#integer"}}]}}
    doc = json.loads(Engine(spark, triples(spark), {"u": "u:"}).json("SELECT ?y WHERE { ?x u:q ?y } ORDER BY ?y"))
    assert [b["y"]["type"] for b in doc["results"]["bindings"]] == ["uri", "literal"]


def test_terms_of_any_kind_in_results_documents(spark):
    doc = json.loads(Engine(spark, tables.graph(spark, SF), tables.PREFIXES).json("SELECT ?v WHERE { { ?x t:r_regionkey ?v FILTER(?v = 2) } UNION { ?x t:r_name ?v FILTER(?v = 'ASIA') } UNION { VALUES ?v { 'ciao'@it 2.5 <u:x> } } } ORDER BY ?v"))
    xsd = "http://www.w3.org/2001/XMLSchema#"
    assert [b["v"] for b in doc["results"]["bindings"]] == [{"type": "uri", "value": "u:x"}, {"type": "literal", "value": "2", "datatype": xsd + "integer"}, {"type": "literal", "value": "2.5", "datatype": xsd + "decimal"}, {"type": "literal", "value": "ASIA"}, {"type": "literal", "value": "ciao", "xml:lang": "it"}]


def test_unlike_terms_are_not_compared(spark):
    e = Engine(spark, tables.graph(spark, SF), tables.PREFIXES)
    ask = lambda text: e.query(text).count()
    assert ask("SELECT ?v WHERE { ?x ?p ?v ; t:r_name ?n FILTER(?v < 'B') }") == 3  # names only, no keys and no IRIs
    assert ask("SELECT ?v WHERE { ?x ?p ?v ; t:r_name ?n FILTER(?v < 2) }") == 2
    assert ask("SELECT ?v WHERE { VALUES ?v { '1' 1 <u:1> '1'@en } ?x t:r_regionkey ?v }") == 1
    assert ask("SELECT DISTINCT ?v WHERE { VALUES ?v { '1' 1 <u:1> '1'@en '1' 1 } }") == 4
    assert ask("SELECT ?v WHERE { VALUES ?v { '1' 1 <u:1> '1'@en } FILTER sameTerm(?v, '1'@EN) }") == 1
