"""Turtle, mappings, inference, extraction, responders and planning."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tessera import service_queries as sq
from tessera.operators import extract, infer
from tessera.engine import Engine
from tessera.operators.materialise import Minting, nearest, nearest_on_earth
from tessera.operators.planner import Options, Planner, needed
from tessera.operators.suggest import domains_and_ranges, suggestions
from tessera.plans.compiler import Compiler
from tessera.plans.sparql import parse
from tessera.plans.terms import Iri
from tessera.sources import config, turtle
from tessera.sources.graph import Graph
from tessera.sources.mapping import MalformedMapping, Mapping, merged
from tessera.sources.responders import Http, Tables, full_url


def test_turtle_round_trip():
    text = """@prefix a: <urn:a:> . PREFIX b: <urn:b:>
    a:x a b:C ; b:p "q\\"\\n", 5, true, -1.5, "l"@en , [ b:in a:y ] ; . # remark
    <urn:z> b:list (1 "two") ."""
    triples, prefixes = turtle.parse(text)
    again, _ = turtle.parse(turtle.write(triples, prefixes))
    assert {t for t in triples if "BNode" not in repr(t)} == {t for t in again if "BNode" not in repr(t)} and len(again) == len(triples)
    for bad in ("a:x b:y c:z .", "<a> <b> .", "?v <b> <c> .", "<a> <b> <c>"):
        with pytest.raises(turtle.MalformedTurtle):
            turtle.parse(bad)


def test_ntriples_round_trip(spark, tmp_path):
    rows = [("urn:a", "urn:p", 'say "hi"\n\\x', "literal"), ("_:b", "urn:p", "urn:c", "iri"), ("urn:a", "urn:p", "_:b", "bnode")]
    df = spark.createDataFrame(rows, "s string, p string, o string, o_kind string")
    turtle.write_ntriples(df, str(tmp_path / "nt"))
    assert sorted(map(tuple, turtle.read_ntriples(spark, str(tmp_path / "nt")).select("s", "p", "o", "o_kind").collect())) == sorted(rows)


def test_ntriples_lines_are_matched_once(spark):
    """Whatever is asked of their columns."""
    df = turtle.parsed_ntriples(spark.createDataFrame([('<a> <p> "x"@en .',), ('<a> <q> "x"@en .',)], "value string"))
    df = df.where("bad IS NULL AND p = 'p' AND startswith(o_lang, 'e')").select("s", "o", "o_lang")
    assert df._jdf.queryExecution().optimizedPlan().toString().count("(?:#.*)?$") == 1
    assert [tuple(r) for r in df.collect()] == [("a", "x", "en")]


def test_stored_triples_are_parsed_once_for_each_pattern(spark):
    df = sq.QUERIES["stored_language_tags"](spark, "/root/testdata/sf0.001")
    assert df._jdf.queryExecution().optimizedPlan().toString().count("(?:#.*)?$") == 2


def test_only_objects_that_are_asked_for_are_matched(spark):
    """A filter on the predicate stands below the expression for what follows it, whatever form the line has."""
    lines = ['<a> <p> "x"@en .', '<a>\t<p> "y" .', '_:b <\\u0070> "z" .', '<a> <q> "x" .', '<a> <p> "\\q" .', "<a> <p> .", '<a> <p>\n"n"\n.', '<a> <p>\n n .', '_:b<r><a> <p> "x" .']
    rows = spark.createDataFrame([(x,) for x in lines], "value string")
    assert [r.bad for r in turtle.parsed_ntriples(rows).where("bad IS NOT NULL").collect()] == [lines[k] for k in (4, 5, 7, 8)]
    df = turtle.statements(rows).where("p = 'p'").select("s", "o")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("(?:#.*)?$") < plan.rindex("END = p)")
    assert [tuple(r) for r in df.collect()] == [("a", "x"), ("a", "y"), ("_:b", "z"), ("a", "n")]


def test_ntriples_nodes_end_with_the_statement(spark):
    lines = ["<a> <p> _:b.# c", "<a> <p> _:b.c.", '_:b<p>"' + "\\\\\\n" * 100_000 + '".']
    rows = turtle.parsed_ntriples(spark.createDataFrame([(x,) for x in lines], "value string")).select("s", "o", "bad").collect()
    assert [tuple(r) for r in rows] == [("a", "_:b", None), ("a", "_:b.c", None), ("_:b", "\\\n" * 100_000, None)]


def test_ntriples_lines(spark):
    lines = [
        ' <urn:a><urn:p>"x"@en-GB . # "no" .',
        '_:b1 <urn:p\\u00e9> <urn:c> .',
        '<urn:a> <urn:p> "\\\\u00e9\\u00E9\\U0001F642\\uD83D\\uDE42\\\\\\\\t" .',
        '<urn:a> <urn:p> "1"^^<urn:int> .',
        "# a remark",
        "   ",
        '<urn:a> <urn:p> "open .',
        '<urn:a> <urn:p> "bad \\q" .',
        '<urn:a> "p" <urn:c> .',
        '<urn:a> <urn:p> "a" "b" .',
        '<urn:a> <urn:p> "' + 'long \\" text ' * 20_000 + '" .',
    ]
    rows = turtle.parsed_ntriples(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [r.bad for r in rows if r.bad] == [lines[k] for k in (6, 7, 8, 9)]
    xsd = "http://www.w3.org/2001/XMLSchema#string"
    assert [tuple(r)[:6] for r in rows if not r.bad] == [
        ("urn:a", "urn:p", "x", "literal", None, "en-GB"),
        ("_:b1", "urn:p\u00e9", "urn:c", "iri", None, None),
        ("urn:a", "urn:p", "\\u00e9\u00e9\U0001f642\U0001f642\\\\t", "literal", xsd, None),
        ("urn:a", "urn:p", "1", "literal", "urn:int", None),
        ("urn:a", "urn:p", 'long " text ' * 20_000, "literal", xsd, None),
    ]


def test_catalog_paths():
    m = Mapping.parse(sq.CHAIN, base_path="http://x")
    assert m.services["urn:map:orders"].url == "http://x/orders"
    assert m.json_path("urn:map:customers-bal") == "$.customers[*].bal"
    assert m.xpath("urn:map:orders-key") == "/orders/order/@key" and m.xpath("urn:map:orders-root") == "/"
    assert m.lowest_common_ancestor(["urn:map:orders-key", "urn:map:orders-total"]) == "urn:map:orders-order"
    assert m.lowest_common_ancestor([]) is None and m.lowest_common_ancestor(["urn:map:orders-key"]) == "urn:map:orders-key"
    with pytest.raises(MalformedMapping):
        m.lowest_common_ancestor(["urn:map:orders-key", "urn:map:customers-name"])
    with pytest.raises(MalformedMapping):
        m.add_property("urn:map:orders-order", "http://www.w3.org/1999/02/22-rdf-syntax-ns#li", "urn:map:orders-root").path("urn:map:orders-root")


def test_legacy_names_behind_a_flag():
    text = sq.HEAD + 'm:s m:hasUrl "u" ; m:hasOutput m:o . m:o a owl:DatatypeProperty ; owl:samePropertyAs ex:p ; rdfs:label "o" . m:r a m:CustomResource ; m:o ex:x .'
    assert Mapping.parse(text).equivalent("urn:map:o") is None and not Mapping.parse(text).row_entities
    m = Mapping.parse(text, legacy=True)
    assert m.equivalent("urn:map:o") == "urn:ex:p" and list(m.row_entities) == ["urn:map:r"]


def test_edits_merge_and_listing():
    m = Mapping.parse(sq.CHAIN)
    assert m.merge(m).triples == m.triples == Mapping.parse(m.turtle()).triples
    a, b = Mapping.parse(sq.FREE), m
    assert a.merge(b).triples == b.merge(a).triples == merged(json.dumps({"models": [sq.CHAIN, sq.FREE]})).triples
    new = m.apply(json.dumps({"addInput": [{"serviceURI": "urn:map:orders", "label": "page"}, {"label": "skipped"}], "addResource": [{"resourceIsSubjectOf": [{"propertyURI": "urn:ex:at", "objectURI": "urn:map:orders-total"}], "resourceIsObjectOf": [{"subjectURI": "urn:map:orders-key", "propertyURI": "urn:ex:row"}], "findUri": "label"}]}))
    assert new.inputs["urn:map:orders-input1"].param == "page" and new.next_uri("urn:map:orders-input") == "urn:map:orders-input2"
    assert [r.find_uri for r in new.row_entities.values()] == ["label"]
    again = new.apply({"editInput": [{"inputURI": "urn:map:orders-input1", "DatatypeProperty": True, "classRDF": "urn:ex:page", "isRequired": False}]})
    i = again.inputs["urn:map:orders-input1"]
    assert i.literal and i.key == "urn:ex:page" and not i.required
    tree = m.parameter_tree()
    assert len(tree["outputList"]) == len(m.nodes) and tree["Output"][1]["children"][0]["label"] == "order"
    assert tree["Output"][1]["children"][0]["children"][0]["isAttribute"]


@pytest.mark.parametrize(("url", "want"), [("http://a/b", ("http://a/b", [])), ("http://a/b?x=1&y=2", ("http://a/b", ["x", "y"])), ("http://a/b?x=1&flag&y=", ("http://a/b", ["x", "y"]))])
def test_url_parts(url, want):
    assert infer.url_parts(url) == want


def test_url_without_values_is_an_error():
    with pytest.raises(ValueError):
        infer.url_parts("http://a/b?x")
    with pytest.raises(ValueError):
        infer.infer_mapping("http://a/b", "json", "{}", "no namespace")


def test_content_kinds():
    assert [infer.content_of(x) for x in ("12", "-1,5", "+3.", "1e5", "TRUE", "x")] == ["Number", "Number", "Number", "String", "Boolean", "String"]


SAMPLES = [
    ("json", {"value": [{"day": "d1", "v": 1, "in": {"x": True}}, {"day": "d2", "extra": "e"}], "n": 5}),
    ("json", [{"a": "1"}, {"a": "2"}]),
    ("json", {"tags": ["x", "y"]}),
    ("xml", '<w a="1"><time from="f1"><t unit="c">5</t></time><time from="f2" to="g"/><name>n</name></w>'),
]


@pytest.mark.parametrize(("language", "sample"), SAMPLES)
def test_inferred_paths_return_every_leaf(spark, language, sample):
    body = sample if language == "xml" else json.dumps(sample)
    m = infer.infer_mapping("http://h/x", language, body)
    values = extract.extracted(m, next(iter(m.services.values())), spark.createDataFrame([("c", body)], "call_id string, body string"))
    got = sorted((m.nodes[r.node].label, r.value) for r in values.collect())

    def leaves(name, v):
        if isinstance(v, dict):
            return [x for k, y in v.items() for x in leaves(k, y)]
        if isinstance(v, list):
            return [x for y in v for x in leaves(name, y)]
        return [(name, v if isinstance(v, str) else json.dumps(v))]

    if language == "json":
        assert got == sorted(leaves("jsonArrayRoot", sample))
    else:
        assert got == sorted([("a", "1"), ("from", "f1"), ("from", "f2"), ("to", "g"), ("t", "5"), ("unit", "c"), ("name", "n")])


def test_long_arrays_and_missing_fields_stay_aligned(spark):
    rows = [{"k": str(k)} | ({} if k % 3 else {"v": f"v{k}"}) for k in range(400)]
    m = infer.infer_mapping("http://h/x", "json", json.dumps({"rows": rows}))
    values = extract.extracted(m, next(iter(m.services.values())), spark.createDataFrame([("c", json.dumps({"rows": rows})), ("bad", "{not json")], "call_id string, body string"))
    by = {}
    for r in values.collect():
        by.setdefault((r.call_id, r.pos[0]), {})[m.nodes[r.node].label] = r.value
    assert list(by.values()) and {tuple(sorted(x.items())) for x in by.values()} == {tuple(sorted(x.items())) for x in rows}


def test_full_url_encodes_everything():
    assert full_url("http://a/b", {"q": "a&b c", "k": "ü"}) == "http://a/b?k=%C3%BC&q=a%26b%20c"
    assert full_url("http://a/b?x=1", {"q": "1"}) == "http://a/b?x=1&q=1"


def test_http_failures_are_rows(spark):
    def get(url):
        if "boom" in url:
            raise OSError("gone")
        return (404, None) if "missing" in url else (200, url)

    calls = spark.createDataFrame([("1", "s", "http://x/ok", {"a": "b"}), ("2", "s", "http://x/boom", {}), ("3", "s", "http://x/missing", {})], "call_id string, service string, url string, params map<string,string>")
    got = {r.call_id: r for r in Http(get, 2).answer(calls).collect()}
    assert got["1"].body == "http://x/ok?a=b" and got["1"].error is None
    assert got["2"].status is None and "gone" in got["2"].error
    assert got["3"].status == 404 and got["3"].body is None


ECHO = sq.HEAD + """
m:s m:hasUrl "http://x/s" ; m:hasLanguage "json" ; m:hasInput m:s-id , m:s-extra ; m:hasOutput m:s-next .
m:s-id m:paramName "id" ; a ex:Thing ; ex:leadsTo m:s-next .
m:s-extra m:paramName "extra" ; a ex:Other ; m:isRequired false .
m:s-next a ex:Thing ; rdfs:label "next" ; m:isData true ; m:isRelatedToService m:s .
"""


def echoing(fails=""):
    def echo(url):
        if fails and url.endswith(fails):
            raise OSError("down")
        return 200, f'{{"next": "{int(url.rpartition("id=")[2]) + 1}"}}'

    return echo


def test_rounds_are_bounded_and_calls_are_made_once(spark):
    m = Mapping.parse(ECHO)
    q = parse('SELECT * WHERE { ?x a ex:Thing ; rdfs:label "0" ; ex:leadsTo ?y }', sq.PREFIXES)
    p = Planner(spark, m, Http(echoing(), 1), Options(deadline=None, max_rounds=4))
    t = p.run(q)
    assert p.rounds == 4 and p.calls.count() == 4 == p.calls.select("call_id").distinct().count()
    assert t.where(F.col("p") == "urn:ex:leadsTo").count() == 4
    late = Planner(spark, m, Http(echoing(), 1), Options(deadline=0.0))
    late.run(q)
    assert late.calls.count() == 0  # what was found until then is the answer


def test_a_failing_source_leaves_the_others(spark):
    p = Planner(spark, Mapping.parse(ECHO), Http(echoing("=1"), 1), Options(deadline=None))
    t = p.run(parse('SELECT * WHERE { ?x a ex:Thing ; rdfs:label "0" ; ex:leadsTo ?y . ?z a ex:Thing ; rdfs:label "7" }', sq.PREFIXES))
    errors = [r.error for r in p.responses.collect() if r.error]
    assert len(errors) == 1 and t.where(F.col("p") == "urn:ex:leadsTo").count() > 1


def test_pruning_keeps_what_feeds_the_needed_services():
    m = Mapping.parse(sq.CHAIN)
    q = lambda text: needed(parse(text, sq.PREFIXES), m)
    assert q("SELECT * WHERE { ?x ex:placed ?y }") == {"urn:map:customers", "urn:map:orders"}
    assert q("SELECT * WHERE { ?x ex:hasCustomer ?y }") == {"urn:map:customers"}
    assert q("SELECT * WHERE { ?x ?p ?y }") == set(m.services)


def test_all_to_all_links_as_a_flag(spark):
    strict = sq._engine(spark, "/root/testdata/sf0.001", sq.FREE).query("SELECT * WHERE { ?x ex:seenAs ?y }")
    loose = sq._engine(spark, "/root/testdata/sf0.001", sq.FREE, all_to_all=True).query("SELECT * WHERE { ?x ex:seenAs ?y }")
    assert (strict.count(), loose.count()) == (25, 625)


def test_suggestions_from_an_ontology(spark):
    rdfs = "http://www.w3.org/2000/01/rdf-schema#"
    rows = [("urn:o:p", rdfs + "domain", "urn:ex:Customer"), ("urn:o:p", rdfs + "range", "urn:ex:Order"), ("urn:o:half", rdfs + "domain", "urn:ex:Customer")]
    onto = domains_and_ranges(spark.createDataFrame(rows, "s string, p string, o string"))
    got = suggestions(spark, Mapping.parse(sq.CHAIN), [onto, onto])
    assert got[("urn:map:customers-name", "urn:map:orders-key")] == ["urn:o:p"] and all(v == ["urn:o:p"] for v in got.values())


def test_mappings_are_not_changed_by_edits():
    m = Mapping.parse(sq.CHAIN)
    before = m.triples
    m.add_property("urn:a", "urn:b", "urn:c")
    assert m.triples == before and (Iri("urn:a"), Iri("urn:b"), Iri("urn:c")) not in before


def test_properties_and_lookup_services(tmp_path):
    (tmp_path / "config.properties").write_text("# main\nservices = one\nbasepathuri=http\\://h\n")
    (tmp_path / "one.properties").write_text("contains=known\nendpoint = http://e\nquery=SELECT ?l { <URI> ?p \\\n  ?l }\nplaceholder: URI\n")
    c = config.load(str(tmp_path))
    assert c.base_path == "http://h" and c.lookups[0].contains == "known"
    assert c.lookups[0].text("urn:a$1") == "SELECT ?l { <urn:a$1> ?p ?l }"
    with pytest.raises(ValueError):
        c.lookups[0].text("urn:a> } #")
    with pytest.raises(ValueError):
        config.within(str(tmp_path), "../secret")


def test_mapping_files_come_from_the_folder_only(spark, tmp_path):
    (tmp_path / "free.ttl").write_text(sq.FREE)
    base = sq._engine(spark, "/root/testdata/sf0.001", sq.FREE)
    e = Engine(spark, prefixes=sq.PREFIXES, responder=base.responder, options=Options(deadline=None), folder=str(tmp_path))
    assert e.query("SELECT ?k WHERE { ?r ex:key ?k ; ex:name ?n }", mapping_path="free.ttl").count() == 25
    with pytest.raises(ValueError):
        e.query("SELECT ?k WHERE { ?r ex:key ?k }", mapping_path="../free.ttl")
    assert e.query("SELECT ?k WHERE { ?r ex:key ?k ; ex:name ?n }", mapping=sq.FREE).count() == 25


def test_minting_by_lookup_falls_back_to_readable_iris(spark):
    table = spark.createDataFrame([("ROME", "http://x/o/Place", "urn:b"), ("ROME", "http://x/o/Place", "urn:a")], "label string, class string, iri string")
    m = Minting("urn:e:", lookups={"place": table})
    df = spark.createDataFrame([("ROME",), ("BARI B",)], "x string")
    assert sorted(r.x for r in m.put(df, "x", "http://x/o/Place", "place").collect()) == ["urn:a", "urn:e:Place#BARI%20B"]


def test_nearest_place_equals_brute_force(spark):
    import random

    rnd = random.Random(4)
    points = [(k, rnd.uniform(-3, 3), rnd.uniform(-3, 3)) for k in range(80)]
    places = [(f"p{k:02}", rnd.uniform(-3, 3), rnd.uniform(-3, 3)) for k in range(30)]
    got = {r.id: r.iri for r in nearest(spark.createDataFrame(points, "id int, lat double, long double"), spark.createDataFrame(places, "iri string, lat double, long double")).collect()}
    for k, a, b in points:
        best = min(((a - x) ** 2 + (b - y) ** 2, p) for p, x, y in places)
        assert got[k] == (best[1] if best[0] <= 0.25 else None)


def test_nearest_on_earth_equals_brute_force(spark):
    import math
    import random

    rnd = random.Random(5)

    def somewhere():
        return math.degrees(math.asin(rnd.uniform(-1, 1))), rnd.uniform(-180, 180)

    points = [*(somewhere() for _ in range(60)), (10.0, 179.9), (10.0, -179.9), (89.9, 0.0), (-90.0, 77.0)]
    places = [(f"p{k:02}", *somewhere()) for k in range(40)] + [("date", 10.0, -179.5), ("pole", 89.8, 180.0), ("twin", 10.0, -179.5)]

    def km(a, b, c, d):
        a, b, c, d = map(math.radians, (a, b, c, d))
        return 2 * 6371.0088 * math.asin(min(1, math.sqrt(math.sin((a - c) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((b - d) / 2) ** 2)))

    rows = spark.createDataFrame([*points, points[0], (None, 1.0), (95.0, 1.0)], "lat double, long double")
    table = spark.createDataFrame(places, "iri string, lat double, long double")
    for within in (60.0, 1500.0, 30_000.0):
        got = {(r.lat, r.long): r.iri for r in nearest_on_earth(rows, table, within).collect()}
        assert len(got) == len(points)
        for a, b in points:
            far, iri = min((round(km(a, b, c, d), 6), p) for p, c, d in places)
            assert got[a, b] == (iri if far <= within else None)
    assert got[10.0, 179.9] == "date" and got[89.9, 0.0] == "pole"


COUNTING = sq.HEAD + """m:s m:hasUrl "http://x/s" ; m:hasLanguage "json" ; m:hasInput m:s-a , m:s-b , m:s-c ; m:hasOutput m:s-o , m:s-p .
m:s-a m:paramName "a" ; a ex:A ; ex:gave m:s-o . m:s-b m:paramName "b" ; a ex:B . m:s-c m:paramName "c" ; a ex:C .
m:s-o a ex:A ; rdfs:label "o" ; m:isData true ; m:isRelatedToService m:s . m:s-p a ex:B ; rdfs:label "p" ; m:isData true ; m:isRelatedToService m:s ."""


def counting(spark, limit=None, **options):
    """Each call gives A and B with one more digit, up to three."""
    longer = lambda c: F.when(F.length(c) < 3, F.concat(c, F.lit("1"))).otherwise(c)
    answer = Tables({"urn:map:s": lambda calls: calls.select("call_id", F.to_json(F.struct(longer(F.col("params")["a"]).alias("o"), longer(F.col("params")["b"]).alias("p"))).alias("body"))})
    p = Planner(spark, Mapping.parse(COUNTING), answer, Options(deadline=None, **options))
    q = parse('SELECT ?x ?y WHERE { ?x a ex:A ; rdfs:label ?l ; ex:gave ?y . ?y rdfs:label ?m FILTER(?l != "zz") ' + '?a rdfs:label "q" ; a ex:A . ?b rdfs:label "q" ; a ex:B . ?c a ex:C ; rdfs:label "1" . ?d a ex:C ; rdfs:label "2" . }' + (f" LIMIT {limit}" if limit else ""), sq.PREFIXES)
    return p, q


def test_a_round_makes_its_new_calls_only(spark, monkeypatch):
    made, named = [], Planner.named_calls
    monkeypatch.setattr(Planner, "named_calls", lambda self, s, df, r: made.append(df.count()) or named(self, s, df, r))
    p, q = counting(spark)
    p.run(q)
    calls = {r["round"]: r["count"] for r in p.calls.groupBy("round").count().collect()}
    # q, q1, q11 on both sides: what is new to a round, times two
    assert calls == {1: 1 * 2, 2: (4 - 1) * 2, 3: (9 - 4) * 2} and made == [2, 6, 10, 0]


def test_limit_counts_what_a_round_adds(spark, monkeypatch):
    work, added = [], Planner.added
    monkeypatch.setattr(Planner, "added", lambda self, patterns, filters, old, new: work.append((new.count(), n := added(self, patterns, filters, old, new))) or n)
    text = 'SELECT ?x ?y WHERE { ?x ex:gave ?y . ?a rdfs:label "q" ; a ex:A , ex:B . ?c a ex:C ; rdfs:label "1" FILTER(?x != ?y) } LIMIT '
    p, _ = counting(spark)
    found = p.run(parse(text.replace("ex:A , ex:B", "ex:A ; rdfs:label ?l . ?b rdfs:label \"q\" ; a ex:B") + "2", sq.PREFIXES))
    assert p.rounds == 2 and [n for _, n in work] == [1, 1] and sum(k for k, _ in work) == found.count()


def test_calls_are_asked_once_though_their_task_is_killed(spark, tmp_path):
    """A worker that dies after some calls; whoever runs the task again asks for the rest only."""
    asked = tmp_path / "asked"

    def get(url):
        with open(asked, "a") as f:
            f.write(url + "\n")
        if url.endswith("=7") and not (tmp_path / "died").exists():
            (tmp_path / "died").touch()
            os._exit(1)
        return 200, url[-1]

    calls = spark.createDataFrame([(f"c{k}", f"http://h{k % 2}/s", {"k": str(k)}) for k in range(10)], "call_id string, url string, params map<string,string>")
    df = Http(get, parallel=1).answer(calls)
    with pytest.raises(Exception):
        df.collect()
    again = df.select("*")  # what failed is remembered by the frame that ran
    assert {r.call_id: r.body for r in again.collect()} == {f"c{k}": str(k) for k in range(10)}
    urls = asked.read_text().split()
    assert sorted(urls) == sorted([f"http://h{k % 2}/s?k={k}" for k in range(10)] + ["http://h1/s?k=7"])  # the one that died unanswered


def test_hosts_are_asked_by_few_tasks_and_again_after_a_while(spark, tmp_path):
    def get(url):
        import time

        from pyspark import TaskContext

        with open(tmp_path / "tasks", "a") as f:
            f.write(f"{url.split('/')[2]} {TaskContext.get().partitionId()} {url} {time.time()}\n")
        n = (tmp_path / "tasks").read_text().count(f" {url} ")
        if "=3" in url:
            raise OSError("down")
        return (503, None) if "=4" in url and n < 3 else (404, None) if "=5" in url else (200, "x")

    calls = spark.createDataFrame([(f"c{k}", f"http://h{k % 2}/s", {"k": str(k)}) for k in range(40)], "call_id string, url string, params map<string,string>")
    got = {r.call_id: r for r in Http(get, parallel=8, per_host=2, tries=3, wait=0.05).answer(calls).collect()}
    lines = [x.split() for x in (tmp_path / "tasks").read_text().splitlines()]
    assert all(len({t for h, t, *_ in lines if h == host}) <= 2 for host in ("h0", "h1"))
    times = lambda k: [float(t) for *_, u, t in lines if u.endswith(f"k={k}")]
    assert [len(times(k)) for k in (1, 3, 4, 5)] == [1, 3, 3, 1] and times(4)[2] - times(4)[1] >= 0.1
    assert (got["c3"].error, got["c4"].status, got["c5"].error, got["c6"].body) == ("OSError: down", 200, "status 404", "x")
