"""The engine: SPARQL SELECT queries over tables, triples and web services."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from .operators.materialise import minted_prefix
from .operators.planner import Options, Planner
from .plans.compiler import Compiler
from .plans.relation import Kind, apart
from .plans.sparql import Select, parse
from .shipping import size_of_frame, spread
from .sources.config import within
from .sources.graph import Graph
from .sources.mapping import Mapping


class Engine:
    """graph: tables and triples at hand. mapping and responder: services that a query may call first.
    folder: where queries may name mapping files."""

    def __init__(self, spark: SparkSession, graph: Graph | None = None, prefixes: dict[str, str] | None = None, mapping: Mapping | None = None, responder=None, options: Options | None = None, folder: str | None = None):
        self.spark, self.graph, self.prefixes = spark, graph or Graph(), prefixes or {}
        self.mapping, self.responder, self.options, self.folder = mapping, responder, options, folder

    def _ready(self, sparql: str, mapping: Mapping | str | None, path: str | None) -> tuple[Select, Graph]:
        q = parse(sparql, self.prefixes)
        frames = [m.frame for m in self.graph.maps] + [x for x in (self.graph.triples,) if x is not None]
        spread(self.spark, sum(map(size_of_frame, frames)))
        if path is not None:
            if self.folder is None:
                raise ValueError("the engine has no folder of mappings")
            mapping = within(self.folder, path).read_text("utf-8")
        m = Mapping.parse(mapping) if isinstance(mapping, str) else mapping or self.mapping
        if m is None:
            return q, self.graph
        planner = Planner(self.spark, m, self.responder, self.options or Options())
        prefix = minted_prefix(planner.options.minting.namespace)
        # rows of documents are tables where nothing else can have their subjects, and no LIMIT is counted on triples
        planner.keep_apart = q.limit is None and self.graph.triples is None and all(apart(Kind("iri", m.prefix), Kind("iri", prefix)) for m in self.graph.maps)
        found = planner.run(q)
        if self.graph.triples is not None:
            found = found.unionByName(self.graph.triples, allowMissingColumns=True).distinct()
        return q, Graph([*self.graph.maps, *planner.maps], found, self.graph.strings, frozenset(planner.said) if self.graph.triples is None else None)

    def query(self, sparql: str, mapping: Mapping | str | None = None, mapping_path: str | None = None) -> DataFrame:
        """A column for each projected variable; unbound is null."""
        q, graph = self._ready(sparql, mapping, mapping_path)
        return Compiler(self.spark, graph).result(q)[0]

    def json(self, sparql: str, mapping: Mapping | str | None = None, mapping_path: str | None = None) -> str:
        """The SPARQL 1.1 results document; its rows come through the driver one partition at a time."""
        q, graph = self._ready(sparql, mapping, mapping_path)
        df = Compiler(self.spark, graph).solutions(q)
        rows = []
        for r in df.toLocalIterator():
            rows.append({v: {k: x for k, x in t.asDict().items() if x is not None} for v, t in r.asDict().items() if t is not None})
        return json.dumps({"head": {"vars": df.columns}, "results": {"bindings": rows}}, ensure_ascii=False)
