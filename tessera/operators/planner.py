"""Access planning: which services to call with what, from the constants of a query.

Constants are rows (key, value, round): a class with labels, or a property with values. In each round every
service whose inputs all have constants is called with the combinations that hold a constant of the round
before; what its class-typed outputs give are new constants. Rounds end when no call is left, at the deadline,
when the query's LIMIT is reached, or after MAX_ROUNDS.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.compiler import Compiler, _checkpointed, _has_exists
from ..plans.relation import joined
from ..plans.sparql import Group, Path, Select, patterns
from ..plans.terms import RDF_TYPE, RDFS_LABEL, Iri, Lit, Var
from ..shipping import size_of_files, spread
from ..sources.graph import Graph, SubjectMap
from ..sources.mapping import Mapping, Service
from .extract import elements, extracted, extracted_elements, parsed_elements
from .materialise import Materialiser, Minting, minted

MAX_ROUNDS = 10
DEADLINE = 5.0

CONSTANTS = "key string, value string, round int"


@dataclass
class Options:
    deadline: float | None = DEADLINE  # seconds; None: no deadline
    max_rounds: int = MAX_ROUNDS
    literal_outputs_as_constants: bool = False
    null_text: bool = False
    all_to_all: bool = False
    prune: bool = True
    lookup: DataFrame | None = None  # (uri, label, type) of IRIs that a query may name
    lookup_marker: str = ""  # part of the IRIs that are looked up
    minting: Minting = field(default_factory=Minting)


def classes_of(var: Var, triples: list, mapping: Mapping) -> list[str]:
    """Classes that the query gives a variable, else those that its properties' ends in the mapping agree on."""
    given = [t.o.value for t in triples if t.s == var and isinstance(t.p, Iri) and t.p.value.lower() == RDF_TYPE.lower() and isinstance(t.o, Iri)]
    if given:
        return given
    agreed: list[str] | None = None
    for t in triples:
        if not isinstance(t.p, Iri) or t.p.value in (RDF_TYPE, RDFS_LABEL):
            continue
        for end, mine in ((t.s, "domain"), (t.o, "range")):
            if end == var:
                found = ends(mapping, t.p.value, mine)
                agreed = found if agreed is None else [c for c in agreed if c in found]
    return agreed or []


def ends(mapping: Mapping, prop: str, which: str) -> list[str]:
    """Classes of the nodes that a public property has in the mapping as subjects (domain) or objects (range)."""
    out: dict[str, None] = {}
    for s, p, o in mapping.links():
        public = mapping.equivalent(p) or p
        if public != prop:
            continue
        uri = s if which == "domain" else o.value if isinstance(o, Iri) else ""
        if uri in mapping.row_entities:
            out |= dict.fromkeys(mapping.row_entities[uri].classes)
        elif uri in mapping.nodes and mapping.nodes[uri].entity_class:
            out[mapping.nodes[uri].entity_class] = None
        elif uri in mapping.inputs and not mapping.inputs[uri].literal:
            out |= dict.fromkeys(mapping.inputs[uri].classes)
    return list(out)


def constants(query: Select, mapping: Mapping) -> list[tuple[str, str]]:
    """(key, value) of the literals in the query's patterns, and of the mapping's fixed inputs."""
    triples = patterns(query.where)
    out: dict[tuple[str, str], None] = {}
    for t in triples:
        if not isinstance(t.o, Lit) or not isinstance(t.p, Iri):
            continue
        if t.p.value == RDFS_LABEL:
            for c in classes_of(t.s, triples, mapping) if isinstance(t.s, Var) else ():
                out[c, t.o.value] = None
        else:
            out[t.p.value, t.o.value] = None
    for i in mapping.inputs.values():
        if i.fixed is not None:
            out[i.key, i.fixed] = None
    return list(out)


def looked_up(query: Select, options: Options) -> DataFrame | None:
    """Rows (uri, label, type) of the query's IRIs that carry the marker."""
    if options.lookup is None:
        return None
    named = sorted({x.value for t in patterns(query.where) for x in (t.s, t.o) if isinstance(x, Iri) and options.lookup_marker in x.value and t.p != Iri(RDF_TYPE)})
    df = options.lookup.where(F.col("uri").isin(named)) if named else options.lookup.where("false")
    return df.select("uri", F.substring_index("label", "@", 1).alias("label"), "type")


def needed(query: Select, mapping: Mapping) -> set[str]:
    """Services that can add to the answer: those that make a property or class of the query, and those whose
    outputs bind inputs of such. All of them, if the query has a variable for a property."""
    every = set(mapping.services)

    def groups(g: Group):
        yield g
        for kind, x in g.elements:
            if kind in ("optional", "minus", "group"):
                yield from groups(x)
            elif kind == "union":
                for y in x:
                    yield from groups(y)
            elif kind == "select":
                yield from groups(x.where)

    wanted: set[str] = set()
    for g in groups(query.where):
        for kind, x in g.elements:
            if kind == "filter":
                return every  # it may hold patterns
            if kind != "triple":
                continue
            if not isinstance(x.p, Iri):
                return every
            if x.p.value == RDF_TYPE:
                if not isinstance(x.o, Iri):
                    return every
                wanted.add(x.o.value)
            elif x.p.value == RDFS_LABEL:
                return every
            else:
                wanted.add(x.p.value)
    makes: dict[str, set[str]] = {}
    for s in mapping.services.values():
        own = {i.uri for i in s.inputs} | {n.uri for n in mapping.nodes.values() if n.service == s.uri}
        made = {n.entity_class for n in mapping.outputs(s.uri) if n.entity_class} | {c for i in s.inputs for c in i.classes if not i.literal}
        for a, p, o in mapping.links():
            touched = {a, p, o.value if isinstance(o, Iri) else ""}
            rows = [mapping.row_entities[u] for u in touched if u in mapping.row_entities]
            touched |= {u for r in rows for q, y in r.properties for u in (q, y.value if isinstance(y, Iri) else "")}
            if touched & own:
                made.add(mapping.equivalent(p) or p)
                made |= {c for r in rows for c in r.classes}
        makes[s.uri] = made
    out = {s for s, made in makes.items() if made & wanted}
    while True:
        keys = {i.key for s in out for i in mapping.services[s].inputs if not i.literal}
        more = {s for s in every - out if any(n.entity_class in keys for n in mapping.outputs(s))}
        if not more:
            return out
        out |= more


class Planner:
    """keep_apart: row entities of documents may become tables (maps) instead of triples; said: predicates of the triples."""

    def __init__(self, spark: SparkSession, mapping: Mapping, responder, options: Options | None = None):
        self.spark, self.mapping, self.responder, self.options = spark, mapping, responder, options or Options()
        self.rounds = 0
        self.keep_apart = False
        self.maps: list[SubjectMap] = []
        self.said: set[str] = {RDF_TYPE, RDFS_LABEL}
        self.calls: DataFrame = spark.createDataFrame([], "call_id string, service string, url string, params map<string,string>, round int")
        self.constants: DataFrame = spark.createDataFrame([], CONSTANTS)
        self.responses: DataFrame | None = None
        self.parts: list[DataFrame] = []
        self.known = self.spark.createDataFrame([], "s string, p string, o string, o_kind string")
        self.solved = 0

    def applicable(self, service: Service, keys: set[str]) -> bool:
        return all(i.key in keys for i in service.inputs if i.required) and all(i.key is not None for i in service.inputs if i.required)

    def bindings(self, service: Service, r: int, keys: set[str]) -> DataFrame:
        """Parameter combinations with a constant of the last round. For each input, its new constants meet the old ones of
        the inputs before it and all of those after it, so a combination comes once, and none that was there before."""
        inputs = [i for i in service.inputs if i.key in keys]
        if not inputs:
            return self.named_calls(service, self.spark.range(1).select(F.create_map().cast("map<string,string>").alias("params")), r)
        out = None
        for new in range(len(inputs)):
            df = None
            for k, i in enumerate(inputs):
                of_round = F.col("round") == r - 1 if k == new else F.col("round") < r - 1 if k < new else F.col("round") < r
                one = self.constants.where((F.col("key") == i.key) & of_round).select(F.regexp_replace("value", '"', "").alias(f"p{k}"))
                df = one if df is None else df.crossJoin(one)  # what is called is this product
            params = F.create_map(*[x for k, i in enumerate(inputs) for x in (F.lit(i.param), F.col(f"p{k}"))])
            df = df.select(params.alias("params"))
            out = df if out is None else out.union(df)
        return self.named_calls(service, out, r)

    def named_calls(self, service: Service, df: DataFrame, r: int) -> DataFrame:
        """Calls by their parameters; values that differ only in quotes are one."""
        text = F.array_join(F.array_sort(F.transform(F.map_entries("params"), lambda e: F.concat(e["key"], F.lit("\u0002"), e["value"]))), "\u0001")
        df = df.select(F.sha2(F.concat(F.lit(service.uri + "\u0001"), text), 256).alias("call_id"), F.lit(service.uri).alias("service"), F.lit(service.url).alias("url"), "params", F.lit(r).alias("round"))
        return df.dropDuplicates(["call_id"]).join(self.calls.select("call_id"), "call_id", "left_anti")

    def run(self, query: Select) -> DataFrame:
        """Calls services round by round; the triples found, as rows (s, p, o, o_kind)."""
        o, m = self.options, self.mapping
        started = time.monotonic()
        late = lambda: o.deadline is not None and time.monotonic() - started > o.deadline
        rows = [(k, v, 0) for k, v in constants(query, m)]
        seed = self.spark.createDataFrame(rows, CONSTANTS)
        named = looked_up(query, o)
        classes = {c for i in m.inputs.values() if not i.literal for c in i.classes} | {n.entity_class for n in m.nodes.values() if n.entity_class}
        if named is not None:
            seed = seed.unionByName(named.select(F.col("type").alias("key"), F.col("label").alias("value"), F.lit(0).alias("round")))
            o.minting.known = named.select("label", F.col("type").alias("class"), F.col("uri").alias("iri"))
        self.constants = _checkpointed(seed.dropDuplicates(["key", "value"]))
        self.parts = [self.entities(self.constants.where(F.col("key").isin(sorted(classes)))) if classes else None, None if named is None else self.named(named)]
        services = [s for u, s in m.services.items() if not o.prune or u in needed(query, m)]
        free = [s for s in services if not s.inputs]
        if free:
            self.step(free, 0, set())
        r = 1
        while r <= o.max_rounds and not late():
            keys = {x.key for x in self.constants.select("key").distinct().collect()}  # keys of the mapping at most
            ready = [s for s in services if s.inputs and self.applicable(s, keys)]
            self.rounds = r
            if not ready or not self.step(ready, r, keys):
                break
            if query.limit is not None and self.enough(query):
                break
            r += 1
        self.settle()
        return self.known

    def step(self, services: list[Service], r: int, keys: set[str]) -> int:
        """One round; the number of calls."""
        new = None
        for s in services:
            b = self.bindings(s, r, keys)
            new = b if new is None else new.unionByName(b)
        new = _checkpointed(new)
        n = new.count()
        if not n:
            return 0
        self.calls = self.calls.unionByName(new)
        answers = _checkpointed(self.responder.answer(new))  # a source is asked once, whatever is computed again
        self.responses = answers if self.responses is None else self.responses.unionByName(answers)
        found = None
        for s in services:
            mine = new.where(F.col("service") == s.uri)
            rows = self.elements(s, mine)
            values = extracted_elements(self.mapping, s, rows) if rows is not None else extracted(self.mapping, s, answers.join(mine.select("call_id"), "call_id"), self.options.null_text)
            made = Materialiser(self.mapping, s, mine.join(answers.where("body IS NOT NULL").select("call_id"), "call_id", "left_semi"), values, self.options.minting, self.options.all_to_all)
            if rows is not None and self.keep_apart:
                made.keep_apart(parsed_elements(self.mapping, s, rows))
            if not made.apart:
                made.values = values = _checkpointed(values)  # else few of them are read again, and elements are kept already
            t = made.triples()
            self.maps += made.apart.values()
            self.said |= made.said
            if t is not None:
                self.parts.append(t)
            keyed = {n.uri: n.entity_class for n in self.mapping.outputs(s.uri) if n.entity_class}
            if self.options.literal_outputs_as_constants:
                keyed |= {n.uri: n.equivalent for n in self.mapping.outputs(s.uri) if n.literal and n.equivalent}
            if keyed:
                kind = F.create_map(*[F.lit(x) for kv in keyed.items() for x in kv])
                got = values.where(F.col("node").isin(list(keyed))).select(kind[F.col("node")].alias("key"), "value", F.lit(r).alias("round"))
                found = got if found is None else found.unionByName(got)
        if found is not None:
            fresh = found.dropDuplicates(["key", "value"]).join(self.constants.select("key", "value"), ["key", "value"], "left_anti")
            self.constants = _checkpointed(self.constants.unionByName(fresh))
        return n

    def elements(self, s: Service, calls: DataFrame) -> DataFrame | None:
        """Rows (call_id, ordinal, body) of a service whose answer is read from files."""
        path = getattr(self.responder, "paths", {}).get(s.uri)
        if path is None:
            return None
        if s.inputs:
            raise ValueError(f"{s.uri} has inputs, so a file can't answer it")
        call = calls.first().call_id  # the only one
        spread(self.spark, size_of_files(self.spark, path))
        return elements(self.spark, self.mapping, s, path).withColumn("call_id", F.lit(call))

    def entities(self, rows: DataFrame) -> DataFrame:
        """Class and label of the entities that constants name."""
        out = None
        for c in sorted({x.key for x in rows.select("key").distinct().collect()}):
            find = next((i.find_uri for i in self.mapping.inputs.values() if c in i.classes and i.find_uri), None)
            both = self.options.minting.put(rows.where(F.col("key") == c).select(F.col("value").alias("x"), F.col("value").alias("label")), "x", c, find)
            part = both.select(F.col("x").alias("s"), F.lit(RDF_TYPE).alias("p"), F.lit(c).alias("o"), F.lit("iri").alias("o_kind")).unionByName(both.select(F.col("x").alias("s"), F.lit(RDFS_LABEL).alias("p"), F.col("label").alias("o"), F.lit("literal").alias("o_kind")))
            out = part if out is None else out.unionByName(part)
        return out

    def named(self, rows: DataFrame) -> DataFrame:
        """Looked-up entities keep their own IRIs."""
        return rows.select(F.col("uri").alias("s"), F.lit(RDF_TYPE).alias("p"), F.col("type").alias("o"), F.lit("iri").alias("o_kind")).unionByName(rows.select(F.col("uri").alias("s"), F.lit(RDFS_LABEL).alias("p"), F.col("label").alias("o"), F.lit("literal").alias("o_kind")))

    def settle(self) -> DataFrame:
        """The triples that the parts since the last time add to the known ones."""
        new = self.known.limit(0)
        for t in self.parts:
            if t is not None:
                new = new.unionByName(t)
        self.parts = []
        new = _checkpointed(new.distinct().join(self.known, ["s", "p", "o", "o_kind"], "left_anti"))
        self.known = self.known.unionByName(new)
        return new

    def enough(self, query: Select) -> bool:
        """Whether the query's LIMIT is reached already; an order or an aggregate needs all rounds. Of patterns alone the
        solutions that a round adds are those with a new triple, so only these are counted."""
        if query.order_by or query.group_by or query.offset:
            return False
        old, new = self.known, self.settle()
        patterns = [x for kind, x in query.where.elements if kind == "triple"]
        filters = [x for kind, x in query.where.elements if kind == "filter"]
        alone = len(patterns) + len(filters) == len(query.where.elements) and not any(isinstance(t.p, Path) for t in patterns)
        if not alone or query.distinct or query.reduced or query.values or any(e is not None for _, e in query.projection) or any(_has_exists(e) for e in filters):
            rel = Compiler(self.spark, Graph(triples=self.known)).select(query)
            return rel.df.count() >= query.limit
        self.solved += self.added(patterns, filters, old, new)
        return self.solved >= query.limit

    def added(self, patterns: list, filters: list, old: DataFrame, new: DataFrame) -> int:
        """How many solutions have a new triple: for each pattern those where it is the first that has one."""
        if new.isEmpty():
            return 0
        every, n = old.unionByName(new), 0
        said = {r.p for r in new.select("p").distinct().collect()}  # predicates of the mapping at most
        for k, t in enumerate(patterns):
            if isinstance(t.p, Iri) and t.p.value not in said:
                continue
            # the new triples first, so that all others are only looked up
            out = Compiler(self.spark, Graph(triples=new)).patterns([t])
            left = [(x, old if j < k else every) for j, x in enumerate(patterns) if j != k]
            while left:
                seen = set(out.kinds)
                x = next((y for y in left if {v.name for v in (y[0].s, y[0].p, y[0].o) if isinstance(v, Var)} & seen), left[0])
                left.remove(x)
                out = joined(out, Compiler(self.spark, Graph(triples=x[1])).patterns([x[0]]))
            compiler = Compiler(self.spark, Graph(triples=every))
            n += compiler.filtered(out, filters).frame(self.spark).count()
        return n


__all__ = ["Options", "Planner", "constants", "looked_up", "minted", "needed"]
