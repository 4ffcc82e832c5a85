"""Mappings: descriptions of web services in RDF, read into a typed catalog, listed, edited and merged.

A mapping's vocabulary is known by its local names; its namespace is that of the predicate hasUrl, so any
namespace will do. A Mapping is never changed: edits give a new one.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from functools import cached_property

from ..plans.terms import OWL, RDF, RDF_TYPE, RDFS_LABEL, XSD, Iri, Lit
from . import turtle

# The vocabulary of mappings.
TERMS = ("hasUrl", "hasMethod", "hasInput", "hasOutput", "hasLanguage", "hasAttribute", "content", "isData", "isRequired", "hasStructure", "isRelatedToService", "hasFixedValue", "customResource", "paramName", "findURI")
LI, BAG = RDF + "li", RDF + "Bag"
DATATYPE_PROPERTY, EQUIVALENT = OWL + "DatatypeProperty", OWL + "equivalentProperty"
#: What older mappings write instead.
LEGACY = {OWL + "samePropertyAs": EQUIVALENT}
ROOT = "jsonArrayRoot"
DEFAULT = "urn:mapping:"


class MalformedMapping(ValueError):
    pass


@dataclass(frozen=True)
class Input:
    uri: str
    param: str | None
    classes: tuple[str, ...]
    equivalent: str | None
    required: bool
    fixed: str | None
    find_uri: str | None

    @property
    def literal(self) -> bool:
        return DATATYPE_PROPERTY in self.classes

    @property
    def key(self) -> str | None:
        """The class or property whose constants bind the input."""
        if self.fixed is not None:
            return self.uri + "key"
        return self.equivalent if self.literal else next(iter(self.classes), None)


@dataclass(frozen=True)
class Node:
    """An output: path has the nodes from the root to it."""

    uri: str
    label: str | None
    parent: str | None
    attribute: bool
    structure: str | None
    data: bool
    content: str | None
    classes: tuple[str, ...]
    equivalent: str | None
    find_uri: str | None
    service: str | None
    children: tuple[str, ...]
    path: tuple[str, ...]

    @property
    def literal(self) -> bool:
        return DATATYPE_PROPERTY in self.classes

    @property
    def entity_class(self) -> str | None:
        return next((c for c in self.classes if c not in (DATATYPE_PROPERTY, BAG)), None) if not self.literal else None


@dataclass(frozen=True)
class Service:
    uri: str
    url: str
    language: str
    inputs: tuple[Input, ...]
    roots: tuple[str, ...]


@dataclass(frozen=True)
class RowEntity:
    uri: str
    classes: tuple[str, ...]
    properties: tuple[tuple[str, object], ...]
    find_uri: str | None


@dataclass(frozen=True)
class Mapping:
    triples: frozenset
    prefixes: dict = field(default_factory=dict, hash=False)
    base_path: str = ""

    @staticmethod
    def parse(text: str, legacy: bool = False, base_path: str = "") -> Mapping:
        """legacy: also read the older names of the equivalence and of row entities."""
        triples, prefixes = turtle.parse(text)
        if legacy:
            ns = next((p.value[: -len("hasUrl")] for _, p, _ in triples if p.value.endswith("hasUrl")), DEFAULT)
            odd = {ns + "CustomResource": ns + "customResource"}
            triples = [(s, Iri(LEGACY.get(p.value, p.value)), Iri(odd.get(o.value, o.value)) if isinstance(o, Iri) else o) for s, p, o in triples]
        return Mapping(frozenset(triples), prefixes, base_path)

    def turtle(self) -> str:
        return turtle.write(self.triples, self.prefixes)

    # lookups

    @cached_property
    def namespace(self) -> str:
        return next((p.value[: -len("hasUrl")] for _, p, _ in sorted(self.triples, key=repr) if p.value.endswith(("/hasUrl", "#hasUrl", ":hasUrl"))), DEFAULT)

    def term(self, name: str) -> str:
        return self.namespace + name

    @cached_property
    def _out(self) -> dict:
        by: dict = {}
        for s, p, o in self.triples:
            by.setdefault(s.value, {}).setdefault(p.value, []).append(o)
        for ps in by.values():
            for os in ps.values():
                os.sort(key=lambda t: (t.value, repr(t)))
        return by

    @cached_property
    def _in(self) -> dict:
        by: dict = {}
        for s, p, o in self.triples:
            if isinstance(o, Iri):
                by.setdefault(o.value, {}).setdefault(p.value, []).append(s.value)
        for ps in by.values():
            for ss in ps.values():
                ss.sort()
        return by

    def objects(self, s: str, p: str) -> list:
        return self._out.get(s, {}).get(p, [])

    def value(self, s: str, p: str) -> str | None:
        found = self.objects(s, p)
        return found[0].value if found else None

    def subjects(self, p: str, o: str) -> list[str]:
        return self._in.get(o, {}).get(p, [])

    def classes(self, s: str) -> tuple[str, ...]:
        return tuple(o.value for o in self.objects(s, RDF_TYPE))

    def equivalent(self, s: str) -> str | None:
        """The public property of a node, given in either direction."""
        found = [o.value for o in self.objects(s, EQUIVALENT)] or self.subjects(EQUIVALENT, s)
        return found[0] if found else None

    def _flag(self, s: str, name: str) -> bool | None:
        v = self.value(s, self.term(name))
        return None if v is None else v.lower() in ("true", "1")

    # the catalog

    @cached_property
    def services(self) -> dict[str, Service]:
        out = {}
        for s in sorted(self._out):
            url = self.value(s, self.term("hasUrl"))
            if url is None:
                continue
            inputs = tuple(self.input(o.value) for o in self.objects(s, self.term("hasInput")))
            language = (self.value(s, self.term("hasLanguage")) or "json").lower()
            out[s] = Service(s, url.replace("{{basepath}}", self.base_path), language, inputs, tuple(o.value for o in self.objects(s, self.term("hasOutput"))))
        return out

    @cached_property
    def inputs(self) -> dict[str, Input]:
        return {i.uri: i for s in self.services.values() for i in s.inputs}

    def input(self, uri: str) -> Input:
        required = self._flag(uri, "isRequired")
        return Input(uri, self.value(uri, self.term("paramName")), self.classes(uri), self.equivalent(uri), required is not False, self.value(uri, self.term("hasFixedValue")), self.value(uri, self.term("findURI")))

    def parent(self, uri: str) -> str | None:
        """The element of an attribute, else the container."""
        for p in (self.term("hasAttribute"), LI):
            if found := self.subjects(p, uri):
                return found[0]
        return None

    def path(self, uri: str) -> tuple[str, ...]:
        out = [uri]
        while (up := self.parent(out[0])) is not None:
            if up in out:
                raise MalformedMapping(f"{uri} lies within itself")
            out.insert(0, up)
        return tuple(out)

    @cached_property
    def nodes(self) -> dict[str, Node]:
        found = {s for s, ps in self._out.items() if self.term("isRelatedToService") in ps}
        for s in self.services.values():
            found |= set(s.roots)
        todo = list(found)
        while todo:  # children that don't name their service
            for p in (LI, self.term("hasAttribute")):
                for o in self.objects(todo[-1] if todo else "", p):
                    if o.value not in found:
                        found.add(o.value)
                        todo.insert(0, o.value)
            todo.pop()
        out = {}
        root_of = {r: s.uri for s in self.services.values() for r in s.roots}
        for uri in sorted(found):
            path = self.path(uri)
            children = tuple(o.value for p in (self.term("hasAttribute"), LI) for o in self.objects(uri, p))
            service = self.value(uri, self.term("isRelatedToService")) or root_of.get(path[0])
            find = self.value(uri, self.term("findURI"))
            out[uri] = Node(uri, self.value(uri, RDFS_LABEL), self.parent(uri), bool(self.subjects(self.term("hasAttribute"), uri)), self.value(uri, self.term("hasStructure")), bool(self._flag(uri, "isData")), self.value(uri, self.term("content")), self.classes(uri), self.equivalent(uri), find, service, children, path)
        return out

    def outputs(self, service: str) -> list[Node]:
        """Nodes of a service that carry values."""
        return [n for n in self.nodes.values() if n.service == service and n.data]

    @cached_property
    def row_entities(self) -> dict[str, RowEntity]:
        kind = self.term("customResource")
        out = {}
        for s in self.subjects(RDF_TYPE, kind):
            skip = {RDF_TYPE, RDFS_LABEL, self.term("findURI")}
            props = tuple((p, o) for p, os in sorted(self._out[s].items()) if p not in skip for o in os)
            out[s] = RowEntity(s, tuple(c for c in self.classes(s) if c != kind), props, self.value(s, self.term("findURI")))
        return out

    def json_path(self, uri: str) -> str:
        """$.a[*].b, with [*] behind each array."""
        parts = ["$"]
        for u in self.path(uri):
            n = self.nodes[u]
            if n.label is None:
                raise MalformedMapping(f"{u} has no label")
            parts.append(n.label + ("[*]" if n.structure == "JSON_Array" and u != uri else ""))
        return ".".join(parts)

    def xpath(self, uri: str) -> str:
        """/a/b/@c; / for a root."""
        path = self.path(uri)
        if len(path) == 1:
            return "/"
        names = [(self.nodes[u].label, self.nodes[u].attribute) for u in path]
        if any(label is None for label, _ in names):
            raise MalformedMapping(f"a node above {uri} has no label")
        return "".join(f"/{'@' * attribute}{label}" for label, attribute in names)

    def lowest_common_ancestor(self, uris: list[str]) -> str | None:
        """One node: itself. None of them: None."""
        if not uris:
            return None
        paths = [self.path(u) for u in uris]
        shared = [a[0] for a in zip(*paths) if len(set(a)) == 1]
        if not shared:
            raise MalformedMapping(f"nodes of different trees: {', '.join(uris)}")
        return shared[-1]

    def blacklisted(self, p: str) -> bool:
        """Whether a predicate belongs to the description itself."""
        known = {self.term(t).lower() for t in TERMS} | {RDF_TYPE.lower(), RDFS_LABEL.lower(), LI.lower(), EQUIVALENT.lower()}
        return p.lower() in known

    def links(self) -> list[tuple[str, str, object]]:
        """Triples that the mapping asks to be made: (subject node, predicate, object)."""
        ends = set(self.nodes) | set(self.inputs) | set(self.row_entities)
        return sorted(((s.value, p.value, o) for s, p, o in self.triples if s.value in ends and not self.blacklisted(p.value)), key=repr)

    # listings

    def parameters(self) -> dict:
        """Inputs, and outputs as a flat list with their parents and paths."""
        out = []
        for s in self.services.values():
            todo = [(r, s.uri) for r in reversed(s.roots)]
            while todo:
                uri, parent = todo.pop()
                n = self.nodes[uri]
                item = {"label": n.label, "uri": uri, "parent": parent, "path": self.xpath(uri)}
                if n.content is not None:
                    item |= {"isData": n.data, "type": n.content}
                out.append(item)
                todo += [(c, uri) for c in reversed(n.children)]
        return {"model": self.turtle(), "Input": self._inputs(), "Output": out}

    def _inputs(self) -> list[dict]:
        return [{"label": i.param, "uri": i.uri, "path": "/inputs/"} for i in self.inputs.values()]

    def parameter_tree(self) -> dict:
        """Inputs, outputs as nested children, and the same outputs as a list."""
        listed: list[dict] = []

        def tree(uri: str) -> dict:
            n = self.nodes[uri]
            item: dict = {"uri": uri, "label": n.label, "path": self.xpath(uri)}
            if n.content is not None:
                item |= {"hasValue": n.data, "contentType": n.content}
            if n.attribute:
                item["isAttribute"] = True
            listed.append(item)
            item["children"] = [tree(c) for c in n.children]
            return item

        out = [tree(r) for s in self.services.values() for r in s.roots]
        return {"model": self.turtle(), "Input": self._inputs(), "Output": out, "outputList": listed}

    # changes

    def changed(self, add=(), drop=()) -> Mapping:
        return Mapping((self.triples - frozenset(drop)) | frozenset(add), self.prefixes, self.base_path)

    def _without(self, s: str, p: str) -> list:
        return [(Iri(s), Iri(p), o) for o in self.objects(s, p)]

    def _set(self, s: str, p: str, value) -> Mapping:
        return self.changed([(Iri(s), Iri(p), value)], self._without(s, p))

    def next_uri(self, base: str) -> str:
        """base1, base2, ...: the first that nothing is said of."""
        k = 1
        while f"{base}{k}" in self._out:
            k += 1
        return f"{base}{k}"

    def _described(self, uri: str, is_data=None, content=None, find_uri=None, is_required=None, datatype_property=None, class_rdf=None, fixed_value=None) -> Mapping:
        """The settings that input and output edits share."""
        m = self
        for name, v in (("isRequired", is_required), ("isData", is_data)):
            if v is not None:
                m = m._set(uri, m.term(name), Lit(str(bool(v)).lower(), XSD + "boolean"))
        for name, v in (("content", content), ("findURI", find_uri)):
            if v is not None:
                m = m._set(uri, m.term(name), Lit(v))
        if datatype_property:
            m = m._set(uri, RDF_TYPE, Iri(DATATYPE_PROPERTY))
            if class_rdf:
                m = m.changed([(Iri(uri), Iri(EQUIVALENT), Iri(class_rdf))])
        elif class_rdf:
            m = m._set(uri, RDF_TYPE, Iri(class_rdf))
        if fixed_value:
            m = m._set(uri, m.term("hasFixedValue"), Lit(fixed_value))._set(uri, RDF_TYPE, Iri(uri + "key"))
        return m

    def edit_input(self, uri: str, **settings) -> Mapping:
        return self._described(uri, **settings)

    edit_output = edit_input

    def add_input(self, service: str, label: str, **settings) -> Mapping:
        uri = self.next_uri(f"{service}-input")
        m = self.changed([(Iri(service), Iri(self.term("hasInput")), Iri(uri)), (Iri(uri), Iri(self.term("paramName")), Lit(label))])
        return m._described(uri, **settings)

    def add_output(self, service: str, label: str, parent: str, **settings) -> Mapping:
        uri = self.next_uri(f"{service}-output")
        m = self.changed([(Iri(parent), Iri(LI), Iri(uri)), (Iri(uri), Iri(RDFS_LABEL), Lit(label)), (Iri(uri), Iri(self.term("isRelatedToService")), Iri(service))])
        return m._described(uri, **settings)

    def add_property(self, s: str, p: str, o: str) -> Mapping:
        return self.changed([(Iri(s), Iri(p), Iri(o))])

    def add_resource(self, subject_of=(), object_of=(), find_uri: str | None = None) -> Mapping:
        service = next(iter(self.services))
        uri = self.next_uri(f"{service}-resource")
        m = self.add_property(uri, RDF_TYPE, self.term("customResource"))
        for p, o in subject_of:
            m = m.add_property(uri, p, o)
        for s, p in object_of:
            m = m.add_property(s, p, uri)
        return m._described(uri, find_uri=find_uri) if find_uri else m

    def apply(self, commands: str | dict) -> Mapping:
        """Edit commands as JSON, applied kind by kind in the order of _EDITS; ones without a needed key are skipped."""
        given = json.loads(commands) if isinstance(commands, str) else commands
        m = self

        def settings(x: dict) -> dict:
            names = {"isRequired": "is_required", "isData": "is_data", "DatatypeProperty": "datatype_property", "content": "content", "classRDF": "class_rdf", "fixedValue": "fixed_value", "findUri": "find_uri"}
            return {names[k]: v for k, v in x.items() if k in names}

        for kind, needed in _EDITS:
            for x in given.get(kind, ()):
                if any(k not in x for k in needed):
                    continue
                if kind in ("editInput", "editOutput"):
                    m = m.edit_input(x[needed[0]], **settings(x))
                elif kind == "addInput":
                    m = m.add_input(x["serviceURI"], x["label"], **settings(x))
                elif kind == "addOutput":
                    m = m.add_output(x["serviceURI"], x["label"], x["parentURI"], **settings(x))
                elif kind == "addProperty":
                    m = m.add_property(x["subjectURI"], x["propertyURI"], x["objectURI"])
                else:
                    subject_of = [(y["propertyURI"], y["objectURI"]) for y in x.get("resourceIsSubjectOf", ()) if {"propertyURI", "objectURI"} <= set(y)]
                    object_of = [(y["subjectURI"], y["propertyURI"]) for y in x.get("resourceIsObjectOf", ()) if {"subjectURI", "propertyURI"} <= set(y)]
                    m = m.add_resource(subject_of, object_of, x.get("findUri"))
        return m

    def merge(self, *others: Mapping) -> Mapping:
        triples, prefixes = self.triples, dict(self.prefixes)
        for o in others:
            triples = triples | o.triples
            prefixes = {**o.prefixes, **prefixes}
        return Mapping(triples, prefixes, self.base_path)

    def renamed(self, new: dict[str, str]) -> Mapping:
        def one(t):
            return Iri(new[t.value]) if isinstance(t, Iri) and t.value in new else t

        return Mapping(frozenset((one(s), one(p), one(o)) for s, p, o in self.triples), self.prefixes, self.base_path)

    def readable(self) -> Mapping:
        """Numbered inputs and outputs named by parameter and path."""
        new: dict[str, str] = {}
        for i in self.inputs.values():
            new[i.uri] = re.sub(r"-+$", "", i.uri.rpartition("-")[0]) + f"-{i.param}"
        for uri, n in self.nodes.items():
            tail = self.xpath(uri)[1:].replace("/", "-").replace("@", "")
            alone = len(self.services[n.service].roots) < 2 if n.service in self.services else True
            new[uri] = uri.rpartition("-")[0].rstrip("-") + "-" + (tail or ("root" if alone else n.label))
        return self.renamed(new)


_EDITS = (("editInput", ("inputURI",)), ("addInput", ("serviceURI", "label")), ("editOutput", ("outputURI",)), ("addOutput", ("serviceURI", "label", "parentURI")), ("addProperty", ("subjectURI", "propertyURI", "objectURI")), ("addResource", ()))


def merged(models: str | dict, legacy: bool = False) -> Mapping:
    """{"models": [Turtle, ...]} as one mapping."""
    given = json.loads(models) if isinstance(models, str) else models
    parts = [Mapping.parse(x, legacy) for x in given["models"]]
    return parts[0].merge(*parts[1:]) if parts else Mapping(frozenset())
