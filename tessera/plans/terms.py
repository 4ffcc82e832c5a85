"""RDF terms and the names of well-known ones."""

from __future__ import annotations

from dataclasses import dataclass

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
XSD = "http://www.w3.org/2001/XMLSchema#"
RDF_TYPE, RDFS_LABEL = RDF + "type", RDFS + "label"


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Iri:
    value: str


@dataclass(frozen=True)
class BNode:
    value: str


@dataclass(frozen=True)
class Lit:
    value: str
    datatype: str | None = None  # None: a plain string
    lang: str | None = None

    def python(self):
        """The value as a Python number or boolean where the datatype is one; else the text."""
        kind = (self.datatype or "").removeprefix(XSD)
        try:
            if kind in ("integer", "int", "long", "short", "byte", "nonNegativeInteger", "positiveInteger", "unsignedInt", "unsignedLong"):
                return int(self.value)
            if kind in ("decimal", "double", "float"):
                return float(self.value)
        except ValueError:
            return None
        if kind == "boolean":
            return {"true": True, "1": True, "false": False, "0": False}.get(self.value)
        return self.value


Term = Var | Iri | BNode | Lit


class UnsupportedQuery(ValueError):
    """A query outside the supported part of SPARQL 1.1 SELECT."""
