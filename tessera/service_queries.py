"""Queries over services whose payloads are built from the test tables, each with an SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from .engine import Engine
from .operators import extract, infer, suggest
from .operators.materialise import Materialiser, Minting
from .operators.planner import Options, Planner, constants
from .plans.sparql import parse
from .sources.mapping import Mapping, merged
from .sources.responders import Tables

EX = "urn:ex:"
PREFIXES = {"ex": EX, "rdfs": "http://www.w3.org/2000/01/rdf-schema#", "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#"}
HEAD = """@prefix m: <urn:map:> . @prefix ex: <urn:ex:> . @prefix owl: <http://www.w3.org/2002/07/owl#> .
@prefix rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .
"""

#: nation -> customers -> orders: each service is called with what the one before gave.
CHAIN = HEAD + """
m:customers m:hasUrl "{{basepath}}/customers" ; m:hasLanguage "json" ; m:hasInput m:customers-nation ; m:hasOutput m:customers-root .
m:customers-nation m:paramName "nation" ; a ex:Nation ; m:isRequired true ; ex:hasCustomer m:customers-name .
m:customers-root a rdf:Bag ; rdfs:label "customers" ; m:hasStructure "JSON_Array" ; m:isRelatedToService m:customers ; rdf:li m:customers-name , m:customers-bal .
m:customers-name a ex:Customer ; rdfs:label "name" ; m:isData true ; m:content "String" ; m:isRelatedToService m:customers ; m:customers-bal <http://www.w3.org/2001/XMLSchema#double> .
m:customers-bal a owl:DatatypeProperty ; owl:equivalentProperty ex:balance ; rdfs:label "bal" ; m:isData true ; m:content "Number" ; m:isRelatedToService m:customers .
m:orders m:hasUrl "{{basepath}}/orders" ; m:hasLanguage "xml" ; m:hasInput m:orders-customer , m:orders-format ; m:hasOutput m:orders-root .
m:orders-customer m:paramName "customer" ; a ex:Customer ; ex:placed m:orders-key .
m:orders-format m:paramName "format" ; a owl:DatatypeProperty ; m:hasFixedValue "full" .
m:orders-root rdfs:label "orders" ; rdf:li m:orders-order ; m:isRelatedToService m:orders .
m:orders-order rdfs:label "order" ; m:hasAttribute m:orders-key ; rdf:li m:orders-total ; m:isRelatedToService m:orders .
m:orders-key a ex:Order ; rdfs:label "key" ; m:isData true ; m:content "Number" ; m:isRelatedToService m:orders ; m:orders-total <http://www.w3.org/2001/XMLSchema#double> .
m:orders-total a owl:DatatypeProperty ; owl:equivalentProperty ex:total ; rdfs:label "total" ; m:isData true ; m:content "Number" ; m:isRelatedToService m:orders .
m:unused m:hasUrl "http://x/unused" ; m:hasLanguage "json" ; m:hasInput m:unused-a ; m:hasOutput m:unused-root .
m:unused-a m:paramName "a" ; a ex:Nothing .
m:unused-root rdfs:label "r" ; m:isData true ; m:isRelatedToService m:unused .
"""  # fmt: skip

#: A document of all nations, read without inputs; its rows are entities of their own.
FREE = HEAD + """
m:nations m:hasUrl "http://x/nations" ; m:hasLanguage "json" ; m:hasOutput m:nations-root .
m:nations-root a rdf:Bag ; rdfs:label "jsonArrayRoot" ; m:hasStructure "JSON_Array" ; m:isRelatedToService m:nations ; rdf:li m:nations-name , m:nations-key , m:nations-region .
m:nations-name a owl:DatatypeProperty ; owl:equivalentProperty ex:name ; rdfs:label "name" ; m:isData true ; m:isRelatedToService m:nations .
m:nations-key a owl:DatatypeProperty ; owl:equivalentProperty ex:key ; rdfs:label "key" ; m:isData true ; m:isRelatedToService m:nations .
m:nations-region a ex:Region ; rdfs:label "region" ; m:isData true ; m:isRelatedToService m:nations .
m:nations-resource1 a m:customResource , ex:Row ; m:nations-name <http://www.w3.org/2001/XMLSchema#string> ; m:nations-key <http://www.w3.org/2001/XMLSchema#string> ; ex:inRegion m:nations-region ; ex:seenAs m:nations-resource2 .
m:nations-resource2 a m:customResource , ex:Tag ; m:nations-key <http://www.w3.org/2001/XMLSchema#string> .
"""  # fmt: skip


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _customers(spark, sf_dir):
    """call -> {"customers": [{name, bal}]}"""
    c = _table(spark, sf_dir, "customer").join(_table(spark, sf_dir, "nation"), F.expr("c_nationkey = n_nationkey"))

    def make(calls):
        rows = calls.select("call_id", F.col("params")["nation"].alias("n")).join(c, F.expr("n = n_name"))
        return rows.groupBy("call_id").agg(F.to_json(F.struct(F.sort_array(F.collect_list(F.struct(F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal")))).alias("customers"))).alias("body"))

    return make


def _orders(spark, sf_dir):
    """call -> <orders><order key=""><total/></order></orders>"""
    o = _table(spark, sf_dir, "orders").join(_table(spark, sf_dir, "customer"), F.expr("o_custkey = c_custkey"))

    def make(calls):
        rows = calls.where(F.col("params")["format"] == "full").select("call_id", F.col("params")["customer"].alias("c")).join(o, F.expr("c = c_name"))
        one = F.concat(F.lit('<order key="'), F.col("o_orderkey").cast("string"), F.lit('"><total>'), F.col("o_totalprice").cast("string"), F.lit("</total></order>"))
        return rows.groupBy("call_id").agg(F.concat(F.lit("<orders>"), F.array_join(F.sort_array(F.collect_list(one)), ""), F.lit("</orders>")).alias("body"))

    return make


def _nations_document(spark, sf_dir):
    n = _table(spark, sf_dir, "nation").join(_table(spark, sf_dir, "region"), F.expr("n_regionkey = r_regionkey"))
    doc = n.groupBy().agg(F.to_json(F.sort_array(F.collect_list(F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.col("r_name").alias("region"))))).alias("body"))
    return lambda calls: calls.select("call_id").crossJoin(doc)


def chain(spark, sf_dir) -> Tables:
    return Tables({"urn:map:customers": _customers(spark, sf_dir), "urn:map:orders": _orders(spark, sf_dir)})


def _options(**x) -> Options:
    return Options(deadline=None, **x)


def _engine(spark, sf_dir, mapping=CHAIN, **options) -> Engine:
    responder = chain(spark, sf_dir) if mapping == CHAIN else Tables({"urn:map:nations": _nations_document(spark, sf_dir)})
    return Engine(spark, prefixes=PREFIXES, mapping=Mapping.parse(mapping, base_path="http://x"), responder=responder, options=_options(**options))


CHAIN_QUERY = 'SELECT ?c ?o ?t WHERE { ?n a ex:Nation ; rdfs:label "NATION_3" ; ex:hasCustomer ?x . ?x rdfs:label ?c ; ex:placed ?y . ?y rdfs:label ?o ; ex:total ?t }'


def fixpoint_chain(spark, sf_dir):
    return _engine(spark, sf_dir).query(CHAIN_QUERY)


def fixpoint_aggregate(spark, sf_dir):
    return _engine(spark, sf_dir).query('PREFIX xsd: <http://www.w3.org/2001/XMLSchema#> SELECT ?c (COUNT(?y) AS ?n) WHERE { ?n rdfs:label "NATION_5" ; ex:hasCustomer ?x . ?x rdfs:label ?c ; ex:balance ?b OPTIONAL { ?x ex:placed ?y } FILTER(xsd:double(?b) > 0) } GROUP BY ?c')


def limit_early_stop(spark, sf_dir):
    """Two customers are known after the first round, so there is no second one."""
    q = parse('SELECT ?x WHERE { ?n rdfs:label "NATION_3" ; a ex:Nation ; ex:hasCustomer ?x } LIMIT 2', PREFIXES)
    p = Planner(spark, Mapping.parse(CHAIN, base_path="http://x"), chain(spark, sf_dir), _options(prune=False))
    p.run(q)
    return p.calls.groupBy("service", "round").agg(F.count(F.lit(1)).alias("n"))


def dedup_calls(spark, sf_dir):
    """Calls by service: each distinct binding once."""
    p = Planner(spark, Mapping.parse(CHAIN, base_path="http://x"), chain(spark, sf_dir), _options())
    p.run(parse('SELECT * WHERE { ?a a ex:Nation ; rdfs:label "NATION_3" . ?b a ex:Nation ; rdfs:label "NATION_3" . ?x ex:placed ?y }', PREFIXES))
    return p.calls.groupBy("service").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("call_id").alias("d"))


def service_applicability(spark, sf_dir):
    m = Mapping.parse(CHAIN, base_path="http://x")
    keys = {k for k, _ in constants(parse(CHAIN_QUERY, PREFIXES), m)}
    p = Planner(spark, m, chain(spark, sf_dir))
    return spark.createDataFrame([(u, s.url, p.applicable(s, keys)) for u, s in m.services.items()], "service string, url string, ready boolean")


def constants_of_query(spark, sf_dir):
    q = parse('SELECT * WHERE { ?n rdfs:label "A" ; ex:hasCustomer ?x . ?y a ex:Order ; rdfs:label "7" ; ex:total "1.5" OPTIONAL { ?y ex:note "n" } FILTER(?x = "no") }', PREFIXES)
    return spark.createDataFrame(constants(q, Mapping.parse(CHAIN)), "key string, value string")


def iri_dereference_lookup(spark, sf_dir):
    """An IRI in the query is looked up: its label becomes a constant, and its entity keeps the IRI."""
    n = _table(spark, sf_dir, "nation")
    lookup = n.select(F.concat(F.lit("urn:known:"), F.col("n_nationkey").cast("string")).alias("uri"), F.concat("n_name", F.lit("@en")).alias("label"), F.lit(EX + "Nation").alias("type"))
    e = _engine(spark, sf_dir, lookup=lookup, lookup_marker="urn:known:")
    return e.query("SELECT ?l ?c WHERE { <urn:known:7> rdfs:label ?l ; ex:hasCustomer ?x . ?x rdfs:label ?c }")


def free_source_rows(spark, sf_dir):
    return _engine(spark, sf_dir, FREE).query("SELECT ?name ?key ?region WHERE { ?row a ex:Row ; ex:name ?name ; ex:key ?key ; ex:inRegion ?r . ?r a ex:Region ; rdfs:label ?region }")


def row_entity_links(spark, sf_dir):
    """Row entities of one row are linked, those of different rows are not."""
    return _engine(spark, sf_dir, FREE).query("SELECT ?a ?b WHERE { ?row ex:key ?a ; ex:seenAs ?tag . ?tag a ex:Tag ; ex:key ?b }")


#: Documents of all orders, read element by element from files.
BIG_JSON = HEAD + """
m:big m:hasUrl "http://x/big" ; m:hasLanguage "json" ; m:hasOutput m:big-root .
m:big-root a rdf:Bag ; rdfs:label "orders" ; m:hasStructure "JSON_Array" ; m:isRelatedToService m:big ; rdf:li m:big-key , m:big-paid , m:big-customer .
m:big-key a owl:DatatypeProperty ; owl:equivalentProperty ex:key ; rdfs:label "key" ; m:isData true ; m:isRelatedToService m:big .
m:big-paid rdfs:label "paid" ; m:hasStructure "JSON_Object" ; m:isRelatedToService m:big ; rdf:li m:big-total .
m:big-total a owl:DatatypeProperty ; owl:equivalentProperty ex:total ; rdfs:label "total" ; m:isData true ; m:isRelatedToService m:big .
m:big-customer a ex:Customer ; rdfs:label "customer" ; m:isData true ; m:isRelatedToService m:big .
m:big-resource1 a m:customResource , ex:Order ; m:big-key <http://www.w3.org/2001/XMLSchema#string> ; m:big-total <http://www.w3.org/2001/XMLSchema#string> ; ex:by m:big-customer .
"""  # fmt: skip
BIG_XML = HEAD + """
m:big m:hasUrl "http://x/big" ; m:hasLanguage "xml" ; m:hasOutput m:big-root .
m:big-root rdfs:label "orders" ; rdf:li m:big-order ; m:isRelatedToService m:big .
m:big-order rdfs:label "order" ; m:hasAttribute m:big-key ; rdf:li m:big-total ; m:isRelatedToService m:big .
m:big-key a ex:Order ; rdfs:label "key" ; m:isData true ; m:isRelatedToService m:big ; m:big-total <http://www.w3.org/2001/XMLSchema#double> .
m:big-total a owl:DatatypeProperty ; owl:equivalentProperty ex:total ; rdfs:label "total" ; m:isData true ; m:isRelatedToService m:big .
"""  # fmt: skip


def _big(spark, sf_dir, mapping, elements, *ends) -> Engine:
    import uuid

    from .shipping import shared_folder
    from .sources.documents import write_documents
    from .sources.responders import Files

    to = f"{shared_folder(spark)}/documents-{uuid.uuid4().hex}"
    write_documents(elements, to, *ends)
    return Engine(spark, prefixes=PREFIXES, mapping=Mapping.parse(mapping), responder=Files({"urn:map:big": to}), options=_options())


def free_file_json(spark, sf_dir):
    """All orders as JSON documents whose arrays are split over the tasks; some orders have no total."""
    o = _table(spark, sf_dir, "orders").join(_table(spark, sf_dir, "customer"), F.expr("o_custkey = c_custkey"))
    one = F.struct(F.col("o_orderkey").cast("string").alias("key"), F.struct(F.when(F.col("o_orderkey") % 5 > 0, F.col("o_totalprice").cast("string")).alias("total"), F.lit('}, {"key": "no"').alias("note")).alias("paid"), F.col("c_name").alias("customer"))
    e = _big(spark, sf_dir, BIG_JSON, o.select(F.to_json(one).alias("value")), '{"made": {"by": ["x", 1]}, "orders": [', ",\n", '], "end": [{"key": "none"}]}')
    return e.query("SELECT ?k ?t ?n WHERE { ?x a ex:Order ; ex:key ?k ; ex:by ?c . ?c rdfs:label ?n OPTIONAL { ?x ex:total ?t } }")


def free_file_xml(spark, sf_dir):
    """All orders as XML documents, read by row."""
    o = _table(spark, sf_dir, "orders")
    one = F.concat(F.lit('<order key="'), F.col("o_orderkey").cast("string"), F.lit('"><total>'), F.col("o_totalprice").cast("string"), F.lit("</total></order>"))
    one = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit('<order key="'), F.col("o_orderkey").cast("string"), F.lit('" />'))).otherwise(one)
    e = _big(spark, sf_dir, BIG_XML, o.select(one.alias("value")), "<orders>", "\n", "</orders>")
    return e.query("SELECT ?k ?t WHERE { ?x a ex:Order ; rdfs:label ?k OPTIONAL { ?x ex:total ?t } }")


STOPS = HEAD + """
m:big m:hasUrl "http://x/big" ; m:hasLanguage "json" ; m:hasOutput m:big-root .
m:big-root a rdf:Bag ; rdfs:label "stops" ; m:hasStructure "JSON_Array" ; m:isRelatedToService m:big ; rdf:li m:big-key , m:big-lat , m:big-long .
m:big-key a owl:DatatypeProperty ; owl:equivalentProperty ex:key ; rdfs:label "key" ; m:isData true ; m:isRelatedToService m:big .
m:big-lat a owl:DatatypeProperty ; owl:equivalentProperty ex:lat ; rdfs:label "lat" ; m:isData true ; m:isRelatedToService m:big .
m:big-long a owl:DatatypeProperty ; owl:equivalentProperty ex:long ; rdfs:label "long" ; m:isData true ; m:isRelatedToService m:big .
m:big-resource1 a m:customResource , ex:Stop ; m:findURI "place" ; m:big-key <http://www.w3.org/2001/XMLSchema#string> ; m:big-lat <http://www.w3.org/2001/XMLSchema#double> ; m:big-long <http://www.w3.org/2001/XMLSchema#double> .
"""  # fmt: skip
#: Where the rows of a table lie: all over the earth, by their keys.
LAT, LONG = "asin(2 * ((%s * 7919 + 13) %% 1000 + 0.5) / 1000 - 1) * 57.29577951308232", "((%s * 104729 + 7) %% 36000) / 100.0 - 180"


def mint_by_place(spark, sf_dir):
    """Rows of customers that become the nearest nation within 2,000 km, by latitude and longitude together."""
    from .operators.materialise import places

    c = _table(spark, sf_dir, "customer")
    one = F.struct(F.col("c_custkey").cast("string").alias("key"), F.expr(LAT % "c_custkey").cast("double").alias("lat"), F.expr(LONG % "c_custkey").cast("double").alias("long"))
    nations = _table(spark, sf_dir, "nation").select(F.concat(F.lit("urn:nation:"), F.col("n_name")).alias("iri"), F.expr(LAT % "n_nationkey").cast("double").alias("lat"), F.expr(LONG % "n_nationkey").cast("double").alias("long"))
    e = _big(spark, sf_dir, STOPS, c.select(F.to_json(one).alias("value")), '{"stops": [', ",\n", "]}")
    e.options.minting = Minting(rows={"place": places(nations, EX + "lat", EX + "long", 2000.0)})
    return e.query('SELECT ?x (COUNT(?k) AS ?n) WHERE { ?x a ex:Stop ; ex:key ?k FILTER(STRSTARTS(STR(?x), "urn:nation:")) } GROUP BY ?x')


def free_source_antijoin(spark, sf_dir):
    m = Mapping.parse(CHAIN, base_path="http://x").merge(Mapping.parse(FREE))
    services = spark.createDataFrame([(u,) for u in m.services], "service string")
    inputs = spark.createDataFrame([(s.uri, i.uri) for s in m.services.values() for i in s.inputs], "service string, input string")
    return services.join(inputs, "service", "left_anti")


def generic_properties(spark, sf_dir):
    """What the free document's rows say, by predicate."""
    e = _engine(spark, sf_dir, FREE)
    return e.query("SELECT ?p (COUNT(*) AS ?n) (COUNT(DISTINCT ?o) AS ?d) WHERE { ?s ?p ?o } GROUP BY ?p")


def input_subject_triples(spark, sf_dir):
    calls = _table(spark, sf_dir, "nation").select(F.col("n_name").alias("call_id"), F.lit("urn:map:customers").alias("service"), F.create_map(F.lit("nation"), F.col("n_name")).alias("params"))
    m = Mapping.parse(CHAIN)
    s = m.services["urn:map:customers"]
    values = extract.extracted(m, s, _customers(spark, sf_dir)(calls))
    t = Materialiser(m, s, calls, values, Minting(plugins={"": lambda ns, label, cls: F.concat(F.lit(cls + "/"), label)})).triples()
    return t.where(F.col("p").isin(EX + "hasCustomer", EX + "balance"))


def entity_upsert_label_class(spark, sf_dir):
    """Entities are one per label and class, whatever the number of rows."""
    t = Minting().put(_table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("x"), F.col("c_mktsegment").alias("label")), "x", EX + "Segment", None)
    return t.groupBy("label").agg(F.countDistinct("x").alias("iris"), F.count(F.lit(1)).alias("n"))


def minting_by_label(spark, sf_dir):
    return Minting("urn:e:").put(_table(spark, sf_dir, "region").select(F.col("r_name").alias("x")), "x", "http://x/o/Region", "label")


def json_path_extract(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    return extract.json_values(e, "props", "$.k", "event_id").select("event_id", F.col("value").cast("int").alias("k"))


def _by_nation_json(spark, sf_dir):
    return _table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.to_json(F.struct(F.struct(F.sort_array(F.collect_list(F.struct(F.col("s_suppkey").alias("k"), F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("b")))).alias("list")).alias("data"))).alias("body"))


def json_array_explode(spark, sf_dir):
    """Elements keep their places where a field is missing before them."""
    return extract.json_values(_by_nation_json(spark, sf_dir), "body", "$.data.list[*].b", "s_nationkey").select("s_nationkey", F.col("pos")[0].alias("place"), F.col("value").cast("double").alias("b"))


def root_array_wrap(spark, sf_dir):
    doc = _nations_document(spark, sf_dir)(spark.createDataFrame([("c",)], "call_id string"))
    return extract.json_values(doc, "body", "$.jsonArrayRoot[*].name", "call_id").select("call_id", F.col("pos")[0].alias("place"), "value")


def _xml(spark, sf_dir):
    s = _table(spark, sf_dir, "supplier")
    one = F.concat(F.lit('<row id="'), F.col("s_suppkey").cast("string"), F.lit('"><name>'), F.col("s_name"), F.lit("</name>"), F.when(F.col("s_acctbal") > 0, F.concat(F.lit("<bal>"), F.col("s_acctbal").cast("string"), F.lit("</bal>"))).otherwise(F.lit("")), F.lit("</row>"))
    return s.groupBy("s_nationkey").agg(F.concat(F.lit("<doc>"), F.array_join(F.sort_array(F.collect_list(one)), ""), F.lit("</doc>")).alias("body"))


def xml_path_extract(spark, sf_dir):
    return extract.xml_values(_xml(spark, sf_dir), "body", "/doc/row/name", "s_nationkey").select("s_nationkey", "value")


def xml_attr_extract(spark, sf_dir):
    return extract.xml_values(_xml(spark, sf_dir), "body", "/doc/row/@id", "s_nationkey").select("s_nationkey", F.col("value").cast("long").alias("id"))


XML_ROWS = HEAD + """
m:doc m:hasUrl "http://x/doc" ; m:hasLanguage "xml" ; m:hasOutput m:doc-root .
m:doc-root rdfs:label "doc" ; m:isRelatedToService m:doc ; rdf:li m:doc-row .
m:doc-row rdfs:label "row" ; m:isRelatedToService m:doc ; m:hasAttribute m:doc-id ; rdf:li m:doc-name , m:doc-bal .
m:doc-id rdfs:label "id" ; m:isData true ; m:isRelatedToService m:doc .
m:doc-name rdfs:label "name" ; m:isData true ; m:isRelatedToService m:doc .
m:doc-bal rdfs:label "bal" ; m:isData true ; m:isRelatedToService m:doc .
"""


def xml_ancestor_rows(spark, sf_dir):
    """Attribute and elements of a row, aligned by their row element though some rows have no balance."""
    m = Mapping.parse(XML_ROWS)
    v = extract.extracted(m, m.services["urn:map:doc"], _xml(spark, sf_dir).select(F.col("s_nationkey").cast("string").alias("call_id"), "body"))
    rows = v.groupBy("call_id", F.slice("pos", 1, m.path("urn:map:doc-id").__len__() - 1).alias("row"))
    pick = lambda u: F.max(F.when(F.col("node") == u, F.col("value")))
    return rows.agg(pick("urn:map:doc-id").cast("long").alias("id"), pick("urn:map:doc-name").alias("name"), pick("urn:map:doc-bal").cast("double").alias("bal")).select("id", "name", "bal")


def url_params(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", infer.url_parts_columns(F.col("url")).alias("u")).select("page_id", "u.endpoint", F.array_join("u.params", ",").alias("params"))


def infer_schema_json(spark, sf_dir):
    m = infer.infer_mapping_of("http://h.x/api/list?nation=1&lang=en", "json", _by_nation_json(spark, sf_dir), "urn:map:")
    return spark.createDataFrame([(m.json_path(u), n.content or "", n.structure) for u, n in m.nodes.items()], "path string, content string, structure string")


def merge_mappings(spark, sf_dir):
    m = merged({"models": [CHAIN, FREE, FREE]})
    return spark.createDataFrame([("services", len(m.services)), ("inputs", len(m.inputs)), ("row_entities", len(m.row_entities))], "what string, n int")


def parameter_listing(spark, sf_dir):
    return spark.createDataFrame([(x["label"], x["path"], x.get("isData")) for x in Mapping.parse(CHAIN).parameters()["Output"]], "label string, path string, data boolean")


def edit_mapping(spark, sf_dir):
    m = Mapping.parse(CHAIN).apply({"editInput": [{"inputURI": "urn:map:unused-a", "isRequired": False, "fixedValue": "7"}], "addOutput": [{"serviceURI": "urn:map:unused", "label": "new", "parentURI": "urn:map:unused-root", "isData": True}], "addProperty": [{"subjectURI": "urn:map:customers-name", "propertyURI": "urn:ex:knows", "objectURI": "urn:map:customers-name"}]})
    i = m.inputs["urn:map:unused-a"]
    return spark.createDataFrame([(i.key, i.fixed, i.required, m.xpath("urn:map:unused-output1"), len(m.links()) - len(Mapping.parse(CHAIN).links()))], "key string, fixed string, required boolean, path string, links int")


def _ontology(spark, sf_dir):
    """Foreign keys as properties with domain and range."""
    rows = [("c_nationkey", "customer", "nation"), ("s_nationkey", "supplier", "nation"), ("n_regionkey", "nation", "region"), ("o_custkey", "orders", "customer"), ("billed", "orders", "customer")]
    return spark.createDataFrame(rows, "property string, domain string, range string")


def suggest_properties(spark, sf_dir):
    resources = _table(spark, sf_dir, "nation").select(F.col("n_name").alias("uri"), F.lit("nation").alias("class")).union(_table(spark, sf_dir, "region").select("r_name", F.lit("region"))).union(_table(spark, sf_dir, "supplier").select("s_name", F.lit("supplier")))
    return suggest.suggest(resources, [_ontology(spark, sf_dir), _ontology(spark, sf_dir)])


def _tables_as_resources(spark, sf_dir):
    """Rows of tables as resources of the table's class."""
    out = None
    for table, key in (("nation", "n_name"), ("region", "r_name"), ("supplier", "s_name"), ("customer", "c_name"), ("orders", "o_orderkey")):
        part = _table(spark, sf_dir, table).select(F.concat(F.lit(f"{table}/"), F.col(key).cast("string")).alias("uri"), F.lit(table).alias("class"))
        out = part if out is None else out.union(part)
    return out


def suggest_class_pairs(spark, sf_dir):
    """Properties between the classes of all rows of five tables, with the sizes of both sides instead of all pairs."""
    return suggest.suggest_classes(_tables_as_resources(spark, sf_dir), [_ontology(spark, sf_dir), _ontology(spark, sf_dir)])


def suggest_for_one(spark, sf_dir):
    """What could link one customer."""
    return suggest.suggest(_tables_as_resources(spark, sf_dir), [_ontology(spark, sf_dir)], F.col("uri") == "nation/NATION_3")


def fixpoint_product(spark, sf_dir):
    """Three inputs over two rounds: pairs of what the first round found are asked for with what the query says."""
    text = HEAD + """m:first m:hasUrl "http://x/first" ; m:hasLanguage "json" ; m:hasInput m:first-n ; m:hasOutput m:first-root .
m:first-n m:paramName "n" ; a ex:Nation .
m:first-root a rdf:Bag ; rdfs:label "list" ; m:hasStructure "JSON_Array" ; m:isRelatedToService m:first ; rdf:li m:first-s , m:first-r .
m:first-s a ex:Supplier ; rdfs:label "s" ; m:isData true ; m:isRelatedToService m:first .
m:first-r a ex:Region ; rdfs:label "r" ; m:isData true ; m:isRelatedToService m:first .
m:then m:hasUrl "http://x/then" ; m:hasLanguage "json" ; m:hasInput m:then-s , m:then-r , m:then-n ; m:hasOutput m:then-o .
m:then-s m:paramName "s" ; a ex:Supplier . m:then-r m:paramName "r" ; a ex:Region . m:then-n m:paramName "n" ; a ex:Nation .
m:then-o a ex:Region ; rdfs:label "o" ; m:isData true ; m:isRelatedToService m:then ."""
    s = _table(spark, sf_dir, "supplier").join(_table(spark, sf_dir, "nation"), F.expr("s_nationkey = n_nationkey")).join(_table(spark, sf_dir, "region"), F.expr("n_regionkey = r_regionkey"))

    def first(calls):
        rows = calls.select("call_id", F.col("params")["n"].alias("n")).join(s, F.expr("n = n_name"))
        return rows.groupBy("call_id").agg(F.to_json(F.struct(F.sort_array(F.collect_list(F.struct(F.col("s_name").alias("s"), F.col("r_name").alias("r")))).alias("list"))).alias("body"))

    then = lambda calls: calls.select("call_id", F.to_json(F.struct(F.concat(F.lit("near "), F.substring(F.col("params")["r"], 1, 2)).alias("o"))).alias("body"))
    p = Planner(spark, Mapping.parse(text), Tables({"urn:map:first": first, "urn:map:then": then}), _options())
    p.run(parse('SELECT * WHERE { ?a a ex:Nation ; rdfs:label "NATION_1" . ?b a ex:Nation ; rdfs:label "NATION_2" . ?x a ex:Region }', PREFIXES))
    return p.calls.groupBy("service", "round").agg(F.count(F.lit(1)).alias("n"))


def type_infer_domain_range(spark, sf_dir):
    from .operators.planner import classes_of, patterns
    from .plans.terms import Var

    m = Mapping.parse(CHAIN)
    q = parse("SELECT * WHERE { ?n ex:hasCustomer ?c . ?c ex:balance ?b ; ex:placed ?o . ?o ex:total ?t }", PREFIXES)
    rows = [(v, ",".join(classes_of(Var(v), patterns(q.where), m))) for v in ("n", "c", "o", "t")]
    return spark.createDataFrame(rows, "var string, classes string")


def equivalent_property_rewrite(spark, sf_dir):
    m = Mapping.parse(CHAIN)
    return spark.createDataFrame([(u, m.equivalent(u)) for u in [*m.nodes, *m.inputs] if m.equivalent(u)], "node string, public string")


#: Outputs that refer to the inputs they were asked with: as an object, and as the value of a property.
BACK = CHAIN + """
m:customers-name ex:livesIn m:customers-nation ; m:customers-since <http://www.w3.org/2001/XMLSchema#string> .
m:customers m:hasInput m:customers-since .
m:customers-since m:paramName "since" ; a owl:DatatypeProperty ; owl:equivalentProperty ex:since ; m:isRequired false .
"""


def _back(spark, sf_dir, p):
    calls = _table(spark, sf_dir, "nation").select(F.col("n_name").alias("call_id"), F.lit("urn:map:customers").alias("service"), F.create_map(F.lit("nation"), F.col("n_name"), F.lit("since"), F.concat(F.lit("y"), F.col("n_nationkey").cast("string"))).alias("params"))
    m = Mapping.parse(BACK)
    s = m.services["urn:map:customers"]
    values = extract.extracted(m, s, _customers(spark, sf_dir)(calls))
    return Materialiser(m, s, calls, values, Minting(plugins={"": lambda ns, label, cls: F.concat(F.lit(cls + "/"), label)})).triples().where(F.col("p") == EX + p)


def input_object_triples(spark, sf_dir):
    return _back(spark, sf_dir, "livesIn")


def input_property_triples(spark, sf_dir):
    return _back(spark, sf_dir, "since")


def parameter_product(spark, sf_dir):
    """Every combination of the constants of two inputs is one call."""
    m = HEAD + """m:s m:hasUrl "http://x/s" ; m:hasLanguage "json" ; m:hasInput m:s-a , m:s-b ; m:hasOutput m:s-o .
m:s-a m:paramName "a" ; a ex:A . m:s-b m:paramName "b" ; a ex:B . m:s-o a ex:C ; rdfs:label "o" ; m:isData true ; m:isRelatedToService m:s ."""
    names = [r.r_name for r in _table(spark, sf_dir, "region").orderBy("r_name").collect()]
    asked = " ".join(f'?a{k} a ex:A ; rdfs:label "{n}" . ?b{k} a ex:B ; rdfs:label "{n}" .' for k, n in enumerate(names))
    answer = Tables({"urn:map:s": lambda calls: calls.select("call_id", F.lit("{}").alias("body"))})
    p = Planner(spark, Mapping.parse(m), answer, _options())
    p.run(parse(f"SELECT * WHERE {{ {asked} ?x a ex:C }}", PREFIXES))
    return p.calls.select(F.col("params")["a"].alias("a"), F.col("params")["b"].alias("b"))


def deadline_partial_answer(spark, sf_dir):
    """Past the deadline no source is called; what the query itself says is the answer."""
    e = _engine(spark, sf_dir)
    e.options.deadline = 0.0
    return e.query('SELECT ?l ?c WHERE { ?n a ex:Nation ; rdfs:label "NATION_3" , ?l OPTIONAL { ?n ex:hasCustomer ?c } }')


def failing_source(spark, sf_dir):
    """Sources that fail, or answer with a bad status, are rows beside those that answer."""
    from .sources.responders import Http

    def get(url):
        k = int(url.rpartition("key=")[2])
        if k % 3 == 1:
            raise OSError("down")
        return (404, None) if k % 3 == 2 else (200, str(k * 2))

    calls = _table(spark, sf_dir, "nation").select(F.col("n_name").alias("call_id"), F.lit("http://x/s").alias("url"), F.create_map(F.lit("key"), F.col("n_nationkey").cast("string")).alias("params"))
    return Http(get, 4).answer(calls).select("call_id", "status", "body", "error")


def ntriples_round_trip(spark, sf_dir):
    """What the free document's rows say, written as N-Triples and read again."""
    import uuid

    from .shipping import shared_folder
    from .sources import turtle

    n = _table(spark, sf_dir, "nation")
    iri = F.concat(F.lit("urn:n:"), F.col("n_nationkey").cast("string"))
    rows = n.select(iri.alias("s"), F.lit("urn:name").alias("p"), F.concat("n_name", F.lit(' "x"\n')).alias("o"), F.lit("literal").alias("o_kind"))
    rows = rows.union(n.select(iri, F.lit("urn:in"), F.concat(F.lit("urn:r:"), F.col("n_regionkey").cast("string")), F.lit("iri")))
    to = f"{shared_folder(spark)}/triples-{uuid.uuid4().hex}"
    turtle.write_ntriples(rows, to)
    return turtle.read_ntriples(spark, to).select("s", "p", "o", "o_kind")


#: Texts that are easily read wrongly, put behind names.
HARD_TEXTS = ("", "C:\\temp\\new", "\\", "\\\\n", 'say "x" . # "', "\t\n\r\b\f'", "\\u00e9 \u00e9 \U0001f642")


def ntriples_typed_round_trip(spark, sf_dir):
    """Orders as triples with datatypes, tags and backslashes, written as N-Triples and read again."""
    import uuid

    from .shipping import shared_folder
    from .sources import turtle

    o = _table(spark, sf_dir, "orders")
    iri = F.concat(F.lit("urn:o:"), F.col("o_orderkey").cast("string"))
    text = F.concat("o_orderpriority", F.element_at(F.array(*map(F.lit, HARD_TEXTS)), (F.col("o_orderkey") % len(HARD_TEXTS) + 1).cast("int")))
    none = F.lit(None).cast("string")
    rows = o.select(iri.alias("s"), F.lit("urn:text").alias("p"), text.alias("o"), F.lit("literal").alias("o_kind"), F.lit("http://www.w3.org/2001/XMLSchema#string").alias("o_datatype"), none.alias("o_lang"))
    rows = rows.union(o.select(iri, F.lit("urn:status"), "o_orderstatus", F.lit("literal"), none, F.when(F.col("o_orderkey") % 2 == 0, "en").otherwise("it-CH")))
    rows = rows.union(o.select(iri, F.lit("urn:key"), F.col("o_orderkey").cast("string"), F.lit("literal"), F.lit("http://www.w3.org/2001/XMLSchema#integer"), none))
    rows = rows.union(o.select(iri, F.lit("urn:by"), F.concat(F.lit("urn:c <"), F.col("o_custkey").cast("string"), F.lit(">\\u")), F.lit("iri"), none, none))
    to = f"{shared_folder(spark)}/triples-{uuid.uuid4().hex}"
    turtle.write_ntriples(rows, to)
    return turtle.read_ntriples(spark, to)


def stored_language_tags(spark, sf_dir):
    """LANGMATCHES, DATATYPE and numbers over stored triples that were read from N-Triples."""
    from .engine import Engine
    from .sources.graph import Graph

    e = Engine(spark, Graph(triples=ntriples_typed_round_trip(spark, sf_dir)))
    return e.query("SELECT ?t (COUNT(*) AS ?n) (MAX(?k) AS ?top) WHERE { ?o <urn:status> ?v ; <urn:key> ?k BIND(LANG(?v) AS ?t) FILTER(LANGMATCHES(?t, 'EN') || LANGMATCHES(?t, 'it')) FILTER(?k > 9) } GROUP BY ?t")


def _inferred_xml(spark, sf_dir):
    return infer.infer_mapping_of("http://h.x/api/list?nation=1", "xml", _xml(spark, sf_dir), "urn:map:")


def infer_schema_xml(spark, sf_dir):
    m = _inferred_xml(spark, sf_dir)
    return spark.createDataFrame([(m.xpath(u), n.content or "", n.attribute) for u, n in m.nodes.items()], "path string, content string, attribute boolean")


def readable_uris(spark, sf_dir):
    """Inferred nodes and inputs are named by their paths and parameters."""
    m = _inferred_xml(spark, sf_dir)
    return spark.createDataFrame([(u,) for u in [*m.nodes, *m.inputs]], "uri string")


def nested_listing(spark, sf_dir):
    """The tree of outputs, each with the number of its children."""
    tree = _inferred_xml(spark, sf_dir).parameter_tree()
    return spark.createDataFrame([(x["label"], x["path"], len(x["children"]), x.get("isAttribute", False)) for x in tree["outputList"]], "label string, path string, children int, attribute boolean")


def edit_outputs(spark, sf_dir):
    """New inputs, changed outputs and new row entities, by what the mapping then holds."""
    m = _inferred_xml(spark, sf_dir)
    s, name = next(iter(m.services)), next(u for u, n in m.nodes.items() if n.label == "name")
    new = m.apply({"addInput": [{"serviceURI": s, "label": "page", "isRequired": False}], "editOutput": [{"outputURI": name, "DatatypeProperty": True, "classRDF": "urn:ex:name"}], "addResource": [{"resourceIsSubjectOf": [{"propertyURI": name, "objectURI": "http://www.w3.org/2001/XMLSchema#string"}]}]})
    rows = [("input", i.param, str(i.required)) for i in new.inputs.values()] + [("output", n.label, n.equivalent) for n in new.nodes.values() if n.equivalent] + [("row", p.rpartition("-")[2], None) for r in new.row_entities.values() for p, _ in r.properties]
    return spark.createDataFrame(rows, "what string, name string, detail string")


def vocabulary_terms(spark, sf_dir):
    """Predicates of the mapping that describe it, and those that are asked for."""
    m = Mapping.parse(CHAIN)
    return spark.createDataFrame(sorted({(p.value, m.blacklisted(p.value)) for _, p, _ in m.triples if p.value.startswith("urn:ex:") or p.value.rpartition(":")[2] in ("hasUrl", "paramName", "isData")}), "predicate string, described boolean")


NATIONS = "nation JOIN region ON n_regionkey = r_regionkey"

QUERIES = {f.__name__: f for f in (input_object_triples, input_property_triples, parameter_product, deadline_partial_answer, failing_source, mint_by_place, suggest_class_pairs, suggest_for_one, fixpoint_product, free_file_json, free_file_xml, ntriples_round_trip, ntriples_typed_round_trip, stored_language_tags, infer_schema_xml, readable_uris, nested_listing, edit_outputs, vocabulary_terms, fixpoint_chain, fixpoint_aggregate, limit_early_stop, dedup_calls, service_applicability, constants_of_query, iri_dereference_lookup, free_source_rows, row_entity_links, free_source_antijoin, generic_properties, input_subject_triples, entity_upsert_label_class, minting_by_label, json_path_extract, json_array_explode, root_array_wrap, xml_path_extract, xml_attr_extract, xml_ancestor_rows, url_params, infer_schema_json, merge_mappings, parameter_listing, edit_mapping, suggest_properties, type_infer_domain_range, equivalent_property_rewrite)}

ORACLES = {
    "fixpoint_chain": "SELECT c_name AS c, o_orderkey::VARCHAR AS o, o_totalprice::VARCHAR AS t FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_3'",
    "fixpoint_aggregate": "SELECT c_name AS c, count(o_orderkey) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey WHERE n_name = 'NATION_5' AND c_acctbal > 0 GROUP BY 1",
    "limit_early_stop": "SELECT 'urn:map:customers' AS service, 1 AS round, 1::BIGINT AS n",
    "dedup_calls": "SELECT 'urn:map:customers' AS service, 1::BIGINT AS n, 1::BIGINT AS d UNION ALL SELECT 'urn:map:orders', count(*), count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_3'",
    "service_applicability": "SELECT * FROM (VALUES ('urn:map:customers', 'http://x/customers', true), ('urn:map:orders', 'http://x/orders', false), ('urn:map:unused', 'http://x/unused', false)) t(service, url, ready)",
    "constants_of_query": "SELECT * FROM (VALUES ('urn:ex:Nation', 'A'), ('urn:ex:Order', '7'), ('urn:ex:total', '1.5'), ('urn:ex:note', 'n'), ('urn:map:orders-formatkey', 'full')) t(key, value)",
    "iri_dereference_lookup": "SELECT n_name AS l, c_name AS c FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey = 7",
    "free_source_rows": f"SELECT n_name AS name, n_nationkey::VARCHAR AS key, r_name AS region FROM {NATIONS}",
    "row_entity_links": "SELECT n_nationkey::VARCHAR AS a, n_nationkey::VARCHAR AS b FROM nation",
    "input_object_triples": "SELECT 'urn:ex:Customer/' || c_name AS s, 'urn:ex:livesIn' AS p, 'urn:ex:Nation/' || n_name AS o, 'iri' AS o_kind FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "input_property_triples": "SELECT 'urn:ex:Customer/' || c_name AS s, 'urn:ex:since' AS p, 'y' || n_nationkey AS o, 'literal' AS o_kind FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "parameter_product": "SELECT x.r_name AS a, y.r_name AS b FROM region x CROSS JOIN region y",
    "deadline_partial_answer": "SELECT n_name AS l, NULL::VARCHAR AS c FROM nation WHERE n_name = 'NATION_3'",
    "failing_source": "SELECT n_name AS call_id, CASE n_nationkey % 3 WHEN 0 THEN 200 WHEN 2 THEN 404 END::INTEGER AS status, CASE WHEN n_nationkey % 3 = 0 THEN (n_nationkey * 2)::VARCHAR END AS body, CASE n_nationkey % 3 WHEN 1 THEN 'OSError: down' WHEN 2 THEN 'status 404' END AS error FROM nation",
    "ntriples_typed_round_trip": r"""
WITH t AS (SELECT *, 'urn:o:' || o_orderkey AS s, ['', 'C:\temp\new', '\', '\\n', 'say "x" . # "', chr(9) || chr(10) || chr(13) || chr(8) || chr(12) || chr(39), '\u00e9 ' || chr(233) || ' ' || chr(128578)][1 + o_orderkey % 7] AS hard FROM orders)
SELECT s, 'urn:text' AS p, o_orderpriority || hard AS o, 'literal' AS o_kind, 'http://www.w3.org/2001/XMLSchema#string' AS o_datatype, NULL AS o_lang FROM t
UNION ALL SELECT s, 'urn:status', o_orderstatus, 'literal', NULL, CASE WHEN o_orderkey % 2 = 0 THEN 'en' ELSE 'it-CH' END FROM t
UNION ALL SELECT s, 'urn:key', o_orderkey::VARCHAR, 'literal', 'http://www.w3.org/2001/XMLSchema#integer', NULL FROM t
UNION ALL SELECT s, 'urn:by', 'urn:c <' || o_custkey || '>\u', 'iri', NULL, NULL FROM t
""",
    "mint_by_place": f"""
WITH c AS (SELECT c_custkey AS k, radians(({LAT % "c_custkey"})::DOUBLE) AS a, radians(({LONG % "c_custkey"})::DOUBLE) AS b FROM customer),
     p AS (SELECT n_name, radians(({LAT % "n_nationkey"})::DOUBLE) AS a, radians(({LONG % "n_nationkey"})::DOUBLE) AS b FROM nation),
     d AS (SELECT k, n_name, 2 * 6371.0088 * asin(least(1, sqrt(pow(sin((c.a - p.a) / 2), 2) + cos(c.a) * cos(p.a) * pow(sin((c.b - p.b) / 2), 2)))) AS km FROM c, p),
     n AS (SELECT k, arg_min(n_name, km) AS n_name FROM d WHERE km <= 2000 GROUP BY k)
SELECT 'urn:nation:' || n_name AS x, count(*) AS n FROM n GROUP BY 1
""",
    "suggest_class_pairs": "WITH c AS (SELECT 'nation' AS k, (SELECT count(*) FROM nation) AS n UNION ALL SELECT 'region', (SELECT count(*) FROM region) UNION ALL SELECT 'supplier', (SELECT count(*) FROM supplier) UNION ALL SELECT 'customer', (SELECT count(*) FROM customer) UNION ALL SELECT 'orders', (SELECT count(*) FROM orders)) SELECT domain, range, property, 0 AS ontology, a.n AS subjects, b.n AS objects FROM (VALUES ('c_nationkey', 'customer', 'nation'), ('s_nationkey', 'supplier', 'nation'), ('n_regionkey', 'nation', 'region'), ('o_custkey', 'orders', 'customer'), ('billed', 'orders', 'customer')) v(property, domain, range) JOIN c a ON a.k = domain JOIN c b ON b.k = range",
    "suggest_for_one": "SELECT 'nation/NATION_3' AS subject, 'region/' || r_name AS object, 'n_regionkey' AS property, 0 AS ontology FROM region",
    "fixpoint_product": """
WITH f AS (SELECT s_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE n_name IN ('NATION_1', 'NATION_2')),
     s AS (SELECT count(DISTINCT s_name) AS n FROM f), r AS (SELECT count(DISTINCT r_name) AS n, count(DISTINCT substr(r_name, 1, 2)) AS near FROM f)
SELECT * FROM (SELECT 'urn:map:first' AS service, 1 AS round, 2::BIGINT AS n
UNION ALL SELECT 'urn:map:then', 2, s.n * r.n * 2 FROM s, r
UNION ALL SELECT 'urn:map:then', 3, s.n * r.near * 2 FROM s, r
UNION ALL SELECT 'urn:map:then', 4, s.n * 2 FROM s) WHERE n > 0
""",
    "free_file_json": "SELECT o_orderkey::VARCHAR AS k, CASE WHEN o_orderkey % 5 > 0 THEN o_totalprice::VARCHAR END AS t, c_name AS n FROM orders JOIN customer ON o_custkey = c_custkey",
    "free_file_xml": "SELECT o_orderkey::VARCHAR AS k, CASE WHEN o_orderkey % 5 > 0 THEN o_totalprice::VARCHAR END AS t FROM orders",
    "stored_language_tags": "SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'en' ELSE 'it-CH' END AS t, count(*) AS n, max(o_orderkey)::VARCHAR AS top FROM orders WHERE o_orderkey > 9 GROUP BY 1",
    "ntriples_round_trip": "SELECT 'urn:n:' || n_nationkey AS s, 'urn:name' AS p, n_name || ' \"x\"' || chr(10) AS o, 'literal' AS o_kind FROM nation UNION ALL SELECT 'urn:n:' || n_nationkey, 'urn:in', 'urn:r:' || n_regionkey, 'iri' FROM nation",
    "infer_schema_xml": "SELECT * FROM (VALUES ('/', '', false), ('/doc/row', '', false), ('/doc/row/@id', 'Number', true), ('/doc/row/name', 'String', false), ('/doc/row/bal', 'Number', false)) t(path, content, attribute)",
    "readable_uris": "SELECT 'urn:map:h-x-api-list-' || x AS uri FROM (VALUES ('root'), ('doc-row'), ('doc-row-id'), ('doc-row-name'), ('doc-row-bal'), ('nation')) t(x)",
    "nested_listing": "SELECT * FROM (VALUES ('doc', '/', 1, false), ('row', '/doc/row', 3, false), ('id', '/doc/row/@id', 0, true), ('name', '/doc/row/name', 0, false), ('bal', '/doc/row/bal', 0, false)) t(label, path, children, attribute)",
    "edit_outputs": "SELECT * FROM (VALUES ('input', 'nation', 'True'), ('input', 'page', 'False'), ('output', 'name', 'urn:ex:name'), ('row', 'name', NULL)) t(what, name, detail)",
    "vocabulary_terms": "SELECT * FROM (VALUES ('urn:ex:hasCustomer', false), ('urn:ex:placed', false), ('urn:map:hasUrl', true), ('urn:map:paramName', true), ('urn:map:isData', true)) t(predicate, described)",
    "free_source_antijoin": "SELECT 'urn:map:nations' AS service",
    "generic_properties": "SELECT * FROM (SELECT 'urn:ex:name' AS p, count(*) AS n, count(DISTINCT n_name) AS d FROM nation UNION ALL SELECT 'urn:ex:key', 2 * count(*), count(*) FROM nation UNION ALL SELECT 'urn:ex:inRegion', count(*), count(DISTINCT n_regionkey) FROM nation UNION ALL SELECT 'urn:ex:seenAs', count(*), count(*) FROM nation UNION ALL SELECT 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 2 * count(*) + count(DISTINCT n_regionkey), 3 FROM nation UNION ALL SELECT 'http://www.w3.org/2000/01/rdf-schema#label', 2 * count(*) + count(DISTINCT n_regionkey), 2 * count(*) + count(DISTINCT n_regionkey) FROM nation)",
    "input_subject_triples": "SELECT 'urn:ex:Nation/' || n_name AS s, 'urn:ex:hasCustomer' AS p, 'urn:ex:Customer/' || c_name AS o, 'iri' AS o_kind FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 'urn:ex:Customer/' || c_name, 'urn:ex:balance', c_acctbal::VARCHAR, 'literal' FROM customer",
    "entity_upsert_label_class": "SELECT c_mktsegment AS label, 1::BIGINT AS iris, count(*) AS n FROM customer GROUP BY 1",
    "minting_by_label": "SELECT 'urn:e:Region#' || replace(r_name, ' ', '%20') AS x FROM region",
    "json_path_extract": "SELECT event_id, (props::JSON->>'$.k')::INTEGER AS k FROM events WHERE (props::JSON->>'$.k') IS NOT NULL",
    "json_array_explode": "SELECT s_nationkey, place::INTEGER AS place, b FROM (SELECT s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS place, s_acctbal AS b FROM supplier) WHERE b > 0",
    "root_array_wrap": "SELECT 'c' AS call_id, (row_number() OVER (ORDER BY n_nationkey))::INTEGER AS place, n_name AS value FROM nation",
    "xml_path_extract": "SELECT s_nationkey, s_name AS value FROM supplier",
    "xml_attr_extract": "SELECT s_nationkey, s_suppkey AS id FROM supplier",
    "xml_ancestor_rows": "SELECT s_suppkey AS id, s_name AS name, CASE WHEN s_acctbal > 0 THEN s_acctbal END AS bal FROM supplier",
    "url_params": r"SELECT page_id, regexp_replace(regexp_replace(url, '\?.*$', ''), '#.*$', '') AS endpoint, array_to_string(regexp_extract_all(regexp_replace(CASE WHEN url LIKE '%?%' THEN regexp_replace(url, '^[^?]*\?', '') ELSE '' END, '#.*$', ''), '([^&=]+)=', 1), ',') AS params FROM pages",
    "infer_schema_json": "SELECT * FROM (VALUES ('$.data', '', 'JSON_Object'), ('$.data.list', '', 'JSON_Array'), ('$.data.list[*].k', 'Number', 'JSON_Data'), ('$.data.list[*].b', 'Number', 'JSON_Data')) t(path, content, structure)",
    "merge_mappings": "SELECT * FROM (VALUES ('services', 4), ('inputs', 4), ('row_entities', 2)) t(what, n)",
    "parameter_listing": "SELECT * FROM (VALUES ('customers', '/', NULL::BOOLEAN), ('name', '/customers/name', true), ('bal', '/customers/bal', true), ('orders', '/', NULL), ('order', '/orders/order', NULL), ('key', '/orders/order/@key', true), ('total', '/orders/order/total', true), ('r', '/', NULL)) t(label, path, data)",
    "edit_mapping": "SELECT 'urn:map:unused-akey' AS key, '7' AS fixed, false AS required, '/r/new' AS path, 1 AS links",
    "suggest_properties": f"SELECT n_name AS subject, r_name AS object, 'n_regionkey' AS property, 0 AS ontology FROM nation CROSS JOIN region UNION ALL SELECT s_name, n_name, 's_nationkey', 0 FROM supplier CROSS JOIN nation",
    "type_infer_domain_range": "SELECT * FROM (VALUES ('n', 'urn:ex:Nation'), ('c', 'urn:ex:Customer'), ('o', 'urn:ex:Order'), ('t', '')) t(var, classes)",
    "equivalent_property_rewrite": "SELECT * FROM (VALUES ('urn:map:customers-bal', 'urn:ex:balance'), ('urn:map:orders-total', 'urn:ex:total')) t(node, public)",
}
