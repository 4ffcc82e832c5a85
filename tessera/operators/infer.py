"""A first mapping of a service from a sample URL and a sample response."""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from urllib.parse import unquote_plus

import pyarrow as pa
from pyspark.sql import DataFrame

from ..plans.terms import OWL, RDF, RDF_TYPE, RDFS, RDFS_LABEL, XSD, Iri, Lit
from ..shipping import ship_code
from ..sources.mapping import BAG, DEFAULT, LI, ROOT, Mapping

# Fixed value: what counts as a number in a sample.
NUMBER = re.compile(r"[-]?\+?[0-9]+[\.,]?[0-9]*")
NAMESPACE = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:\S+[/#:]")


def url_parts(url: str) -> tuple[str, list[str]]:
    """Address and parameter names. No ? : a source without inputs; ? without = is an error."""
    address, mark, query = url.partition("?")
    if not mark:
        return address, []
    if "=" not in query:
        raise ValueError("no parameters can be read from the URL")
    return address, [unquote_plus(x.partition("=")[0]) for x in query.split("&") if "=" in x]


def url_parts_columns(url):
    """The same of a column: a struct (endpoint, params)."""
    from pyspark.sql import functions as F

    query = F.when(F.instr(url, "?") > 0, F.substr(url, F.instr(url, "?") + 1)).otherwise(F.lit(""))
    query = F.regexp_replace(query, "#.*$", "")
    names = F.transform(F.filter(F.split(query, "&"), lambda x: x.contains("=")), lambda x: F.substring_index(x, "=", 1))
    return F.struct(F.regexp_replace(F.regexp_replace(url, r"\?.*$", ""), "#.*$", "").alias("endpoint"), names.alias("params"))


def content_of(text: str) -> str:
    if NUMBER.fullmatch(text):
        return "Number"
    return "Boolean" if text.lower() in ("true", "false") else "String"


def slug(address: str) -> str:
    return re.sub(r"[/.:]", "-", re.sub(r"^https?://", "", address))


class _Builder:
    def __init__(self, service: str, vocabulary: str):
        self.service, self.v, self.n, self.triples = service, vocabulary, 0, []

    def say(self, s: str, p: str, o) -> None:
        self.triples.append((Iri(s), Iri(p), o))

    def node(self, label: str, parent: str | None, how: str) -> str:
        self.n += 1
        uri = f"{self.service}-output{self.n}"
        self.say(uri, RDFS_LABEL, Lit(label))
        self.say(uri, self.v + "isRelatedToService", Iri(self.service))
        self.say(parent or self.service, {"root": self.v + "hasOutput", "child": LI, "attribute": self.v + "hasAttribute"}[how], Iri(uri))
        return uri

    def data(self, uri: str, content: str) -> None:
        self.say(uri, self.v + "isData", Lit("true", XSD + "boolean"))
        self.say(uri, self.v + "content", Lit(content))

    def json(self, label: str, x: dict, parent: str | None) -> None:
        """A node and those below it, from the summary of its values."""
        uri = self.node(label, parent, "child" if parent else "root")
        self.say(uri, self.v + "hasStructure", Lit({"object": "JSON_Object", "array": "JSON_Array", "data": "JSON_Data"}[x["is"]]))
        if x["is"] != "data":
            self.say(uri, RDF_TYPE, Iri(BAG))
        for k, y in x["in"].items():
            self.json(k, y, uri)
        if x["is"] == "data" or x["is"] == "array" and x["as"] and not x["in"]:
            self.data(uri, x["as"] or "String")

    def xml(self, label: str, x: dict, parent: str | None) -> None:
        uri = self.node(label, parent, "child" if parent else "root")
        for k, content in x["own"].items():
            self.data(self.node(k, uri, "attribute"), content)
        if x["in"]:
            self.say(uri, RDF_TYPE, Iri(BAG))
        for k, y in x["in"].items():
            self.xml(k, y, uri)
        if x["as"]:
            self.data(uri, x["as"])


def scalar(value) -> str | None:
    """What a JSON value is read as; null says nothing."""
    if value is None:
        return None
    if isinstance(value, str):
        return "Boolean" if value.lower() in ("true", "false") else "String"
    return content_of(json.dumps(value))


# A summary tells what values at a place are: "is" object, array or data, "in" the summaries of what they hold by name,
# "as" the kind of the text, and for XML "own" the kinds of the attributes. Merging is commutative and associative, so
# summaries of parts of the data may be merged in any order.


def json_summary(value) -> dict:
    if isinstance(value, dict):
        return {"is": "object", "in": {k: json_summary(x) for k, x in value.items()}, "as": None}
    if isinstance(value, list):
        out = {"is": "array", "in": {}, "as": None}
        for x in value:
            if isinstance(x, dict):
                out = merged_summaries(out, {"is": "array", "in": {k: json_summary(y) for k, y in x.items()}, "as": None})
            elif not isinstance(x, list):
                out["as"] = _either(out["as"], scalar(x))
        return out
    return {"is": "data", "in": {}, "as": scalar(value)}


def xml_summary(e: ET.Element) -> dict:
    out = {"is": "object", "own": {k: content_of(v) for k, v in e.attrib.items()}, "in": {}, "as": content_of(e.text.strip()) if (e.text or "").strip() else None}
    for c in e:
        x = xml_summary(c)
        out["in"][c.tag] = merged_summaries(out["in"][c.tag], x) if c.tag in out["in"] else x
    return out


def _either(a: str | None, b: str | None) -> str | None:
    """The kind of texts of two kinds."""
    return a or b if a is None or b is None or a == b else "String"


_RANK = {"data": 0, "object": 1, "array": 2}


def merged_summaries(a: dict, b: dict) -> dict:
    """Null and empty values give way; of unlike structures the richer one is kept."""
    if a["is"] != b["is"]:
        empty = [x for x in (a, b) if not x["in"] and x["as"] is None]
        if len(empty) == 1:
            return b if empty[0] is a else a
        return max(a, b, key=lambda x: _RANK[x["is"]])
    both = lambda x, y, f: {k: f(x[k], y[k]) if k in x and k in y else x.get(k, y.get(k)) for k in {**x, **y}}
    out = {"is": a["is"], "in": both(a["in"], b["in"], merged_summaries), "as": _either(a["as"], b["as"])}
    if "own" in a:
        out["own"] = both(a["own"], b["own"], _either)
    return out


def summary(language: str, sample: str) -> dict:
    """Of a whole document; the outermost array of JSON, and the root of XML, under their names."""
    if language == "json":
        value = json.loads(sample)
        return json_summary(value if isinstance(value, dict) else {ROOT: value})
    if re.search(r"<!DOCTYPE|<!ENTITY", sample, re.IGNORECASE):
        raise ValueError("samples with a document type are not read")
    root = ET.fromstring(sample)
    return {"is": "object", "own": {}, "in": {root.tag: xml_summary(root)}, "as": None}


def summary_of(bodies: DataFrame, language: str) -> dict | None:
    """The summary of all documents of a column (body): made in each partition, merged in two more steps. Null bodies and
    such that are no documents say nothing."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            for body in batch.column(0).to_pylist():
                try:
                    x = summary(language, body or "")
                except (ValueError, ET.ParseError):
                    continue
                out = x if out is None else merged_summaries(out, x)
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array([json.dumps(out)])], names=["summary"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            for x in map(json.loads, batch.column(0).to_pylist()):
                out = x if out is None else merged_summaries(out, x)
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array([json.dumps(out)])], names=["summary"])

    ship_code(bodies.sparkSession)
    parts = bodies.select("body").mapInArrow(made, "summary string").repartition(16).mapInArrow(merged, "summary string")
    out = None
    for r in parts.collect():  # 16 schemas
        x = json.loads(r.summary)
        out = x if out is None else merged_summaries(out, x)
    return out


def infer_mapping_of(url: str, language: str, bodies: DataFrame, namespace: str = DEFAULT, vocabulary: str = DEFAULT) -> Mapping:
    """As infer_mapping(), from all responses of a column (body)."""
    return _inferred(url, language, summary_of(bodies, language.lower()), namespace, vocabulary)


def infer_mapping(url: str, language: str, sample: str | None = None, namespace: str = DEFAULT, vocabulary: str = DEFAULT) -> Mapping:
    """Service, inputs and output tree. All elements of an array and all siblings of a name are looked at."""
    return _inferred(url, language, summary(language.lower(), sample) if sample and language.lower() in ("json", "xml") else None, namespace, vocabulary)


def _inferred(url: str, language: str, found: dict | None, namespace: str, vocabulary: str) -> Mapping:
    if not NAMESPACE.fullmatch(namespace):
        raise ValueError(f"not a namespace: {namespace}")
    address, names = url_parts(url)
    service = namespace + slug(address)
    b = _Builder(service, vocabulary)
    b.say(service, vocabulary + "hasUrl", Lit(address))
    b.say(service, vocabulary + "hasLanguage", Lit(language.lower()))
    for k, n in enumerate(names, 1):
        b.say(service, vocabulary + "hasInput", Iri(f"{service}-input{k}"))
        b.say(f"{service}-input{k}", vocabulary + "paramName", Lit(n))
    for k, x in (found["in"] if found else {}).items():
        (b.xml if language.lower() == "xml" else b.json)(k, x, None)
    prefixes = {"map": vocabulary, "rdf": RDF, "rdfs": RDFS, "owl": OWL, "xsd": XSD} | ({"own": namespace} if namespace != vocabulary else {})
    return Mapping(frozenset(b.triples), prefixes).readable()
