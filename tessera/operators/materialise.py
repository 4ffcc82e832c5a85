"""Triples from calls and extracted values: entities, literals and the links that a mapping asks for."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import encoded
from ..plans.terms import RDF_TYPE, RDFS_LABEL, Iri
from ..sources.graph import Column as Place
from ..sources.graph import SubjectMap
from ..sources.mapping import Input, Mapping, Node, RowEntity, Service
from .extract import single_value


def digest(label: Column, cls: str) -> Column:
    return F.sha2(F.concat_ws("\u0001", F.lit(cls), label), 256)


def minted_prefix(namespace: str) -> str:
    return namespace + "resource-"


def minted(namespace: str, label: Column, cls: str) -> Column:
    """The IRI of an entity: the same label and class always give the same one."""
    return F.concat(F.lit(minted_prefix(namespace)), digest(label, cls))


def by_label(namespace: str, label: Column, cls: str) -> Column:
    """Readable: namespace, local name of the class, and the encoded label."""
    return F.concat(F.lit(namespace + cls.rsplit("/", 1)[-1].rsplit("#", 1)[-1] + "#"), encoded(label))


@dataclass
class Minting:
    """How entities get their IRIs. plugins: findURI name -> expression of namespace, label column and class.
    lookups: findURI name -> rows (label, class, iri); labels that it lacks get readable IRIs.
    known: rows (label, class, iri) of entities that have an IRI already; they win.
    rows: findURI name of row entities -> a function of rows (call_id, pos, values), values being a map from properties to
    the row's values, that adds a column iri, null where it knows none (see places)."""

    namespace: str = "urn:entity:"
    plugins: dict[str, Callable[[str, Column, str], Column]] = field(default_factory=lambda: {"label": by_label})
    lookups: dict[str, DataFrame] = field(default_factory=dict)
    known: DataFrame | None = None
    rows: dict[str, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)

    def plain(self, find_uri: str | None) -> bool:
        """Whether all IRIs are those of minted()."""
        return self.known is None and find_uri not in self.lookups and (find_uri or "") not in self.plugins

    def put(self, df: DataFrame, column: str, cls: str, find_uri: str | None) -> DataFrame:
        """The column of labels replaced by IRIs."""
        tables = [t for t in (self.known, self.lookups.get(find_uri or "")) if t is not None]
        make = by_label if find_uri in self.lookups else self.plugins.get(find_uri or "", minted)
        own, hits = make(self.namespace, F.col(column), cls), []
        for k, t in enumerate(tables):
            first = t.where(F.col("class") == cls).groupBy(F.col("label").alias(column)).agg(F.min("iri").alias(f"__iri{k}"))
            df = df.join(first, column, "left")
            hits.append(f"__iri{k}")
        return df.withColumn(column, F.coalesce(*hits, own)).drop(*hits)


def nearest(points: DataFrame, places: DataFrame, within: float = 0.5) -> DataFrame:
    """points (id, lat, long) with the nearest of places (iri, lat, long) in `within` degrees, or null.

    Both sides are put into cells of that size; a point looks into its own and the eight around it, so the
    join is one on cells. Equally near places: the least IRI.
    """
    cell = lambda c: F.floor(c / within).cast("long")
    around = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x in (-1, 0, 1) for y in (-1, 0, 1)])
    p = points.select("id", "lat", "long", F.explode(around).alias("d")).select("id", "lat", "long", (cell(F.col("lat")) + F.col("d.x")).alias("cx"), (cell(F.col("long")) + F.col("d.y")).alias("cy"))
    q = places.select("iri", F.col("lat").alias("plat"), F.col("long").alias("plong"), cell(F.col("lat")).alias("cx"), cell(F.col("long")).alias("cy"))
    far = (F.col("lat") - F.col("plat")) ** 2 + (F.col("long") - F.col("plong")) ** 2
    hit = p.join(q, ["cx", "cy"]).where(far <= within**2).groupBy("id").agg(F.min(F.struct(far.alias("far"), "iri")).alias("best")).select("id", F.col("best.iri").alias("iri"))
    return points.select("id").join(hit, "id", "left")


EARTH_KM = 6371.0088


def nearest_on_earth(points: DataFrame, places: DataFrame, within_km: float) -> DataFrame:
    """Distinct points (lat, long) in degrees with the nearest of places (iri, lat, long) along the surface, or null where none
    is within the distance. Both lie on a sphere in cubes as wide as the chord of that distance, and a point looks into its
    own and the 26 around it: neither the poles nor the date line are borders. Equally near places: the least IRI."""
    chord = 2 * math.sin(min(within_km / EARTH_KM, math.pi) / 2)
    lat, long = F.radians("lat"), F.radians("long")
    axes = {"x": F.cos(lat) * F.cos(long), "y": F.cos(lat) * F.sin(long), "z": F.sin(lat)}
    cube = lambda c: F.floor(F.col(c) / chord).cast("long")
    steps = F.array(*[F.struct(*[F.lit(v).alias(f"d{c}") for v, c in zip(d, "xyz")]) for d in itertools.product((-1, 0, 1), repeat=3)])
    here = points.select("lat", "long").where("lat BETWEEN -90 AND 90 AND abs(long) <= 360").distinct()
    p = here.select("lat", "long", *[c.alias(k) for k, c in axes.items()]).withColumn("d", F.explode(steps)).select("lat", "long", "x", "y", "z", *[(cube(c) + F.col(f"d.d{c}")).alias(f"c{c}") for c in "xyz"])
    q = places.select("iri", *[c.alias(k) for k, c in axes.items()]).select("iri", *[cube(c).alias(f"c{c}") for c in "xyz"], *[F.col(c).alias(f"p{c}") for c in "xyz"])
    far = sum(((F.col(c) - F.col(f"p{c}")) ** 2 for c in "xyz"), F.lit(0.0))
    hit = p.join(q, ["cx", "cy", "cz"]).where(far <= chord**2).groupBy("lat", "long").agg(F.min(F.struct(far.alias("far"), "iri")).alias("best"))
    return here.join(hit.select("lat", "long", F.col("best.iri").alias("iri")), ["lat", "long"], "left")


def places(table: DataFrame, lat: str, long: str, within_km: float) -> Callable[[DataFrame], DataFrame]:
    """For Minting.rows: the IRI of the nearest of table's places (iri, lat, long), by two properties of a row together."""

    def find(rows: DataFrame) -> DataFrame:
        at = rows.withColumn("lat", F.col("values")[lat].try_cast("double")).withColumn("long", F.col("values")[long].try_cast("double"))
        return at.join(nearest_on_earth(at, table, within_km), ["lat", "long"], "left").drop("lat", "long")

    return find


def stripped(value: Column) -> Column:
    """Without the quotes around a raw value."""
    return F.regexp_replace(value, '^"|"$', "")


class Materialiser:
    """Triples of one service from calls (call_id, params) and values (call_id, node, pos, value)."""

    def __init__(self, mapping: Mapping, service: Service, calls: DataFrame, values: DataFrame, minting: Minting, all_to_all: bool = False):
        self.m, self.service, self.calls, self.values, self.minting = mapping, service, calls, values, minting
        self.all_to_all = all_to_all
        self.apart: dict[str, SubjectMap] = {}  # row entities of which triples() says nothing, see keep_apart()
        self.said: set[str] = {RDF_TYPE, RDFS_LABEL}  # predicates of the triples

    def depth(self, uris: list[str]) -> int:
        """How many positions rows have that hold all these nodes."""
        low = self.m.lowest_common_ancestor(uris)
        return len(self.m.path(low)) if low else 0

    def scope(self, r: RowEntity) -> tuple[list[str], int]:
        """The outputs of a row entity, and the depth of its rows."""
        uris = []
        for p, o in r.properties:
            for u in (p, o.value if isinstance(o, Iri) else ""):
                if u in self.m.nodes and self.m.nodes[u].service == self.service.uri:
                    uris.append(u)
        return uris, self.depth(uris)

    def mine(self, r: RowEntity) -> bool:
        """Whether the entity takes values of this service."""
        for p, o in r.properties:
            for u in (p, o.value if isinstance(o, Iri) else ""):
                if u in self.m.nodes and self.m.nodes[u].service == self.service.uri or any(i.uri == u for i in self.service.inputs):
                    return True
        return False

    def keep_apart(self, elements: DataFrame) -> None:
        """Row entities of which an element of the service's document (see parsed_elements) is one at most, with one value of a
        property at most, become tables: an element has all that their triples say, so these are neither joined nor kept."""
        for uri, r in self.m.row_entities.items():
            if self.mine(r) and (table := self.table(uri, r, elements)) is not None:
                self.apart[uri] = table

    def table(self, uri: str, r: RowEntity, elements: DataFrame) -> SubjectMap | None:
        uris, depth = self.scope(r)
        cells = {u: single_value(self.m, self.service, self.m.nodes[u]) for u in uris}
        if not uris or self.all_to_all or self.service.inputs or r.find_uri in self.minting.rows or any(c is None for c in cells.values()):
            return None
        prefix, columns, values = minted_prefix(self.minting.namespace), {}, []
        for s, p, o in self.m.links():
            target = p if p in self.m.nodes or p in self.m.inputs else o.value if isinstance(o, Iri) else None
            public = self.m.equivalent(p) if target == p else p
            if s != uri or public is None or target is None:
                continue
            if target in self.m.row_entities and self.mine(self.m.row_entities[target]):
                return None  # a row of its own
            if target not in self.m.nodes or self.m.nodes[target].service != self.service.uri:
                continue
            n = self.m.nodes[target]
            value, cls = single_value(self.m, self.service, n), n.entity_class
            if value is None or public in columns or public in (RDF_TYPE, RDFS_LABEL) or cls is not None and not self.minting.plain(n.find_uri):
                return None
            name = f"value{len(columns)}"
            columns[public] = Place(name) if cls is None else Place(name, prefix, minted=cls)
            values.append((value if cls is None else F.when(value.isNotNull(), digest(value, cls))).alias(name))
        pos = F.concat(F.col("ordinal").cast("string"), F.lit(".0" * (depth - 1)))
        label = F.concat(F.lit(uri + "R"), pos, F.lit("-"), F.col("call_id"))
        frame = elements.where(F.coalesce(*cells.values()).isNotNull())
        frame = frame.select(digest(F.concat_ws("\u0001", "call_id", pos), uri).alias("key"), stripped(label).alias("label"), *values)
        classes = r.classes or (self.m.term("customResource"),)
        return SubjectMap(frame, prefix, "key", {RDFS_LABEL: Place("label"), **columns}, tuple(dict.fromkeys(classes)), minted=uri)

    def end(self, uri: str) -> tuple[DataFrame, str, tuple[str, ...], str | None] | None:
        """Rows (call_id, pos, x) of a node, input or row entity; iri or literal; its path; its class."""
        if uri in self.m.row_entities:
            r = self.m.row_entities[uri]
            if not self.mine(r):
                return None
            uris, depth = self.scope(r)
            if uris:
                rows = self.values.where(F.col("node").isin(uris)).select("call_id", F.slice("pos", 1, depth).alias("pos")).distinct()
            else:
                rows = self.calls.select("call_id", F.array().cast("array<int>").alias("pos"))
            key = F.concat_ws("\u0001", "call_id", F.array_join(F.transform("pos", lambda x: x.cast("string")), "."))
            path = self.m.path(uris[0])[:depth] if uris else ()
            own = minted(self.minting.namespace, key, uri)
            if r.find_uri not in self.minting.rows or not uris:
                return rows.withColumn("x", own), "iri", path, uri
            # the least value of each property of a row
            cells = {u: self.m.nodes[u].equivalent or u for u in dict.fromkeys(uris)}
            got = self.values.where(F.col("node").isin(list(cells))).groupBy("call_id", F.slice("pos", 1, depth).alias("pos"))
            got = got.agg(*[F.min(F.when(F.col("node") == u, F.col("value"))).alias(f"v{k}") for k, u in enumerate(cells)])
            of = {u: [F.col(f"v{k}") for k, v in enumerate(cells.values()) if v == u] for u in cells.values()}
            whole = F.create_map(*[x for u, cols in of.items() for x in (F.lit(u), F.coalesce(*cols))])
            found = self.minting.rows[r.find_uri](got.select("call_id", "pos", whole.alias("values")))
            return found.select("call_id", "pos", F.coalesce("iri", own).alias("x")), "iri", path, uri
        if uri in self.m.nodes and self.m.nodes[uri].service == self.service.uri:
            n: Node = self.m.nodes[uri]
            rows = self.values.where(F.col("node") == uri).select("call_id", "pos", F.col("value").alias("x"))
            if n.entity_class is None:
                return rows, "literal", n.path, None
            return self.minting.put(rows, "x", n.entity_class, n.find_uri), "iri", n.path, n.entity_class
        i = next((i for i in self.service.inputs if i.uri == uri), None)
        if i is not None:
            rows = self.calls.select("call_id", F.array().cast("array<int>").alias("pos"), F.col("params")[i.param].alias("x")).where("x IS NOT NULL")
            cls = None if i.literal else next(iter(i.classes), None)
            if cls is None:
                return rows, "literal", (), None
            return self.minting.put(rows, "x", cls, i.find_uri), "iri", (), cls
        return None

    def pair(self, s, p: str, o) -> DataFrame | None:
        """Triples of two ends, aligned by call and by the position of their common ancestor."""
        (left, kind, a, _), (right, o_kind, b, _) = s, o
        if kind != "iri":
            return None
        shared = 0
        for x, y in zip(a, b):
            if x != y:
                break
            shared += 1
        if self.all_to_all:
            shared = 0
        at = F.slice("pos", 1, shared) if shared else F.array().cast("array<int>")
        left = left.select("call_id", at.alias("at"), F.col("x").alias("s"))
        right = right.select("call_id", at.alias("at"), F.col("x").alias("o"))
        return left.join(right, ["call_id", "at"]).select("s", F.lit(p).alias("p"), "o", F.lit(o_kind).alias("o_kind"))

    def triples(self) -> DataFrame | None:
        """The distinct triples of the service, None if the mapping asks for none."""
        parts: list[DataFrame] = []
        used: set[str] = set()
        for s, p, o in self.m.links():
            subject = self.end(s) if s not in self.apart else None
            if subject is None:
                continue
            target = p if p in self.m.nodes or p in self.m.inputs else o.value if isinstance(o, Iri) else None
            public = self.m.equivalent(p) if target == p else p
            if target == p and public is None:
                continue  # a property without a public name
            found = self.end(target) if target else None
            if found is None:
                continue
            used |= {s, target}
            if (t := self.pair(subject, public, found)) is not None:
                parts.append(t)
                self.said.add(public)
        ends = used | {n.uri for n in self.m.outputs(self.service.uri) if n.entity_class} | {i.uri for i in self.service.inputs if not i.literal and i.classes and i.fixed is None}
        for u in sorted(ends - set(self.apart)):
            parts += self.described(u)
        if not parts:
            return None
        out = parts[0]
        for t in parts[1:]:
            out = out.unionByName(t)
        return out.distinct()

    def described(self, uri: str) -> list[DataFrame]:
        """Class and label of the entities of a node, input or row entity."""
        found = self.end(uri)
        if found is None or found[1] != "iri":
            return []
        rows, _, _, cls = found
        if uri in self.m.row_entities:
            classes = self.m.row_entities[uri].classes or (self.m.term("customResource"),)
            label = F.concat(F.lit(uri + "R"), F.array_join(F.transform("pos", lambda x: x.cast("string")), "."), F.lit("-"), F.col("call_id"))
            both = rows.select("x", label.alias("label"))
        else:
            classes = (cls,)
            if uri in self.m.nodes:
                raw = self.values.where(F.col("node") == uri).select(F.col("value").alias("x"))
                find = self.m.nodes[uri].find_uri
            else:
                i: Input = self.m.inputs[uri]
                raw = self.calls.select(F.col("params")[i.param].alias("x")).where("x IS NOT NULL")
                find = i.find_uri
            both = self.minting.put(raw.select("x", F.col("x").alias("label")).distinct(), "x", cls, find).select("x", "label")
        out = [both.select(F.col("x").alias("s"), F.lit(RDF_TYPE).alias("p"), F.lit(c).alias("o"), F.lit("iri").alias("o_kind")) for c in classes]
        return [*out, both.select(F.col("x").alias("s"), F.lit(RDFS_LABEL).alias("p"), stripped(F.col("label")).alias("o"), F.lit("literal").alias("o_kind"))]
