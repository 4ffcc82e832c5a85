"""Compiles a query over a graph to DataFrame operations.

Patterns of one subject on one table become one scan; links between subjects become joins on native keys;
constant IRIs become comparisons of keys, which reach the scan; sources that cannot give a pattern's predicate
or IRI take no part. Plain triples are joined as strings.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import E, Expressions, key_equal, literal, literal_equal, literal_tag, type_of
from ..shipping import shared_folder
from ..sources.graph import Graph, SubjectMap, as_triples, shared_predicates
from ..sources.graph import bound as has_key
from .relation import TAGGED, TYPED, Kind, Rel, _named, apart, beside, is_literal, joined, key_text, left_joined, name, semi_joined, tag_of, term_class, unioned
from .sparql import Aggregate, Call, Exists, Group, Path, Select, Triple, variables
from .terms import RDF_TYPE, XSD, Iri, Lit, UnsupportedQuery, Var

UNIT = Rel(None)


def order(items: list, names, bound) -> list:
    """Greedy connected order: the most bound first, then what shares a variable with those before."""
    left, out, seen = list(items), [], set()
    while left:
        best = max(left, key=lambda x: (bool(names(x) & seen) or not seen, bound(x), -left.index(x)))
        left.remove(best)
        out.append(best)
        seen |= names(best)
    return out


def _vars(*terms) -> set[str]:
    return {t.name for t in terms if isinstance(t, Var)}


@dataclass(frozen=True)
class Domain:
    """What a group inside EXISTS is evaluated for: the distinct bindings of the outer variables that it mentions, each
    with an id. Outer variables stand for constants in there, at any depth, so nested groups start with them too.
    outer: their names and that of the id."""

    start: Rel
    outer: frozenset[str]


class Compiler:
    def __init__(self, spark: SparkSession, graph: Graph):
        self.spark, self.graph = spark, graph
        self.fresh = 0

    def temp(self) -> str:
        self.fresh += 1
        return f".t{self.fresh}"

    # groups

    def group(self, g: Group, domain: Domain | None = None) -> Rel:
        out, waiting, extra, filters = domain.start if domain else UNIT, [], [], []

        def close():
            nonlocal out
            if waiting:
                out = joined(out, self.patterns(waiting, extra))
                waiting.clear()
                extra.clear()

        for kind, x in _triples_first(g.elements) if domain else g.elements:
            if kind == "triple":
                if extra:
                    close()
                waiting.append(x)
                continue
            if kind == "filter":
                filters.append(x)
                continue
            if kind == "optional" and domain is None and self.same_row(x, out, waiting, extra):
                extra.append(x.elements[0][1])
                continue
            close()
            if kind == "optional":
                out = self.optional(out, x, domain)
            elif kind == "minus":
                out = semi_joined(out, self.nested(out, x, domain), False, minus=True, outer=domain.outer if domain else frozenset())
            elif kind == "group":
                out = joined(out, self.nested(out, x, domain))
            elif kind == "union":
                parts = [self.nested(out, p, domain) for p in x]
                rel = parts[0]
                for p in parts[1:]:
                    rel = unioned(rel, p)
                out = joined(out, rel)
            elif kind == "bind":
                out = self.extend(out, *x)
            elif kind == "values":
                out = joined(out, self.values(*x))
            elif kind == "select":
                out = joined(out, self.select(x))
        close()
        return self.filtered(out, filters)

    def nested(self, out: Rel, g: Group, domain: Domain | None) -> Rel:
        """A group within one whose solutions so far are out. In a domain it starts with the outer bindings, and with the
        values in out of what its own first triples bind, which only leaves out what would not join anyway."""
        if domain is None:
            return self.group(g)
        if domain.start.maybe & domain.outer:  # out may have bound them, which the group doesn't see
            return self.group(g, domain)
        known = [v for v in out.kinds if v in domain.outer or v in _bound_first(g) and v not in out.maybe and not out.kinds[v].nameless]
        start = out.keep(known)
        return self.group(g, Domain(replace(start, df=start.df.distinct()), domain.outer))

    def same_row(self, g: Group, out: Rel, waiting: list[Triple], extra: list[Triple]) -> bool:
        """Whether an OPTIONAL is one property, with a variable of its own, of a subject of the patterns before it, so that a row
        of a document that has these has it too: no join is needed."""
        if [kind for kind, _ in g.elements] != ["triple"] or not any(m.minted for m in self.graph.maps):
            return False
        t = g.elements[0][1]
        if not (isinstance(t.s, Var) and isinstance(t.p, Iri) and isinstance(t.o, Var)) or t.p.value == RDF_TYPE:
            return False
        subjects = [w.s for w in waiting if not isinstance(w.p, (Path, Var))]
        return t.s in subjects and t.o.name not in {*out.kinds}.union(*[_vars(w.s, w.p, w.o) for w in [*waiting, *extra]])

    def optional(self, left: Rel, g: Group, domain: Domain | None = None) -> Rel:
        """Filters of the group itself see the variables of both sides, so they join the condition."""
        inner = Group(tuple(e for e in g.elements if e[0] != "filter"))
        conditions = [e for k, e in g.elements if k == "filter"]
        right = self.nested(left, inner, domain)
        own = [e for e in conditions if (_used(e) | _mentioned_by(e) & set(left.kinds)) - {"."} <= set(right.kinds)]
        rest = [e for e in conditions if e not in own]
        right = self.filtered(right, own)
        if any(_has_exists(e) for e in rest):
            # solutions of both sides are filtered; those of the left of which none is left stay alone
            left, known = self.numbered(left, list(left.kinds))
            both = self.filtered(joined(left, right), rest)
            alone = replace(left, df=left.df.join(both.df.select(name(known)), name(known), "left_anti"))
            out = unioned(both, alone)
            return out.keep([v for v in out.kinds if v != known])

        def condition(scope: Rel):
            ex = Expressions(scope)
            out = F.lit(True)
            for e in rest:
                out = out & ex.condition(e)
            return out

        return left_joined(left, right, condition if rest else None)

    def numbered(self, rel: Rel, names: list[str]) -> tuple[Rel, str]:
        """The relation with a variable that tells apart the bindings of some others, unbound ones among them."""
        known = self.temp()
        df = rel.frame(self.spark)
        columns = rel.keep(names).columns()
        return replace(rel, df=df.withColumn(name(known), F.struct(*columns) if columns else F.struct(F.lit(0).alias("none"))), kinds=rel.kinds | {known: Kind()}), known

    def filtered(self, rel: Rel, filters: list) -> Rel:
        plain = []
        for e in filters:
            for c in _conjuncts(e):
                if isinstance(c, Exists):
                    rel = self.exists(rel, c)
                elif isinstance(c, Call) and c.name == "!" and isinstance(c.args[0], Exists):
                    rel = self.exists(rel, replace(c.args[0], negated=not c.args[0].negated))
                else:
                    plain.append(c)
        for c in plain:
            rel, flags = self.flagged(rel, c)
            rel = replace(rel, df=rel.frame(self.spark))
            rel = rel.where(Expressions(rel, flags=flags).condition(c))
            if flags:
                rel = replace(rel, df=rel.df.drop(*flags.values()))
            # a comparison with a variable leaves only rows where it is bound
            rel = replace(rel, maybe=rel.maybe - _demanded(c))
        return rel

    def exists(self, rel: Rel, e: Exists) -> Rel:
        """Solutions for which the group has one, or none. Where outer variables occur only in what its own patterns join
        on, and in its own filters, that is one semi-join; else see correlated()."""
        if not _plain(e.group, set(rel.kinds)):
            return self.correlated(rel, e)
        inner = Group(tuple(x for x in e.group.elements if x[0] != "filter"))
        right = self.group(inner)
        conditions = [x for k, x in e.group.elements if k == "filter"]
        own = [c for c in conditions if _used(c) <= set(right.kinds)]
        outer = [c for c in conditions if c not in own]
        right = self.filtered(right, own)

        def condition(scope: Rel):
            ex = Expressions(scope)
            out = F.lit(True)
            for c in outer:
                out = out & ex.condition(c)
            return out

        return semi_joined(rel, right, not e.negated, condition if outer else None)

    def correlated(self, rel: Rel, e: Exists) -> Rel:
        """EXISTS whose nested groups use outer variables: evaluated once for each distinct binding of these."""
        seen = _mentioned(e.group)
        mine = [v for v in rel.kinds if v in seen]
        if not mine:
            return semi_joined(rel, self.group(e.group).keep([]), not e.negated)
        for v in mine:
            _named(rel.kinds[v])
        rel, known = self.numbered(rel, mine)
        start = rel.keep([*mine, known])
        start = replace(start, df=start.df.distinct())
        hold = self.group(e.group, Domain(start, frozenset(start.kinds)))
        df = rel.df.join(hold.df.select(name(known)), name(known), "left_anti" if e.negated else "left_semi")
        out = replace(rel, df=df)
        return out.keep([v for v in out.kinds if v != known])

    def flagged(self, rel: Rel, e) -> tuple[Rel, dict]:
        """Columns that tell whether EXISTS inside an expression holds: it depends on the values that a row
        shares with the pattern, so each combination of them is tested once."""
        flags = {}
        for x in _exists_in(e):
            rel = replace(rel, df=rel.frame(self.spark))
            column = "flag" + self.temp().replace(".", "_")
            seen = _mentioned(x.group)
            mine = [v for v in rel.kinds if v in seen]
            for v in mine:
                _named(rel.kinds[v])
            part = rel.keep(mine)
            part = replace(part, df=part.df.distinct() if mine else self.spark.range(1).select(F.lit(True).alias("unit")))
            hold = self.exists(part, replace(x, negated=False)).df
            on, keys = F.lit(True), part.columns()
            hold = hold.select(*[F.col(c).alias("e" + c) for c in keys], F.lit(True).alias(column))
            for c in keys:
                on = on & F.col(c).eqNullSafe(F.col("e" + c))
            df = rel.df.join(hold if keys else F.broadcast(hold), on, "left").drop(*["e" + c for c in keys])  # without keys, one row
            df = df.withColumn(column, F.coalesce(column, F.lit(False)) != F.lit(x.negated))
            flags[x] = column
            rel = replace(rel, df=df)
        return rel, flags

    def extend(self, rel: Rel, var: str, e) -> Rel:
        if var in rel.kinds:
            raise UnsupportedQuery(f"?{var} is already bound")
        rel, flags = self.flagged(rel, e)
        rel = replace(rel, df=rel.frame(self.spark))
        out = self.put(rel, var, Expressions(rel, flags=flags)(e))
        return replace(out, df=out.df.drop(*flags.values())) if flags else out

    def put(self, rel: Rel, var: str, v: E) -> Rel:
        df = rel.df.withColumn(name(var), v.col)
        if v.kind.kind == "any":
            df = df.withColumn(beside(var), v.kinds)
        return Rel(df, rel.kinds | {var: v.kind}, rel.maybe | {var})

    def values(self, names: tuple[str, ...], rows: tuple) -> Rel:
        kinds, cells = {}, []
        for k, v in enumerate(names):
            given = [r[k] for r in rows if r[k] is not None]
            whole = {isinstance(x, Iri) for x in given}
            if whole == {True}:
                kinds[v] = Kind("iri")
            else:
                kinds[v] = Kind("any") if whole == {True, False} else Kind("lit")
            types = {literal(x).type for x in given if isinstance(x, Lit)}
            if len(types) > 1 and types != {"int", "num"} or any(isinstance(x, Lit) and (x.lang or literal_tag(x)[len(TYPED) :] != XSD + "string" and literal(x).type == "str") for x in given):
                kinds[v], types = Kind("any"), set()
            kind = {"int": "long", "num": "double", "bool": "boolean", "time": "timestamp"}.get(types.copy().pop(), "string") if len(types) == 1 and whole == {False} else "double" if types == {"int", "num"} else "string"
            cells.append((v, kind))
        fields, data = [], []
        for v, kind in cells:
            fields.append(f"{name(v)} {'string' if kind == 'timestamp' else kind}")
            if kinds[v].kind == "any":
                fields.append(f"{beside(v)} string")
        for r in rows:
            row = []
            for (v, kind), x in zip(cells, r):
                value = None if x is None else x.value if isinstance(x, Iri) or kind in ("string", "timestamp") else x.python()
                row.append(float(value) if kind == "double" and value is not None else value)
                if kinds[v].kind == "any":
                    row.append(None if x is None else "iri" if isinstance(x, Iri) else literal_tag(x))
            data.append(tuple(row))
        if not fields:
            return UNIT
        df = self.spark.createDataFrame(data, ", ".join(fields))
        for v, kind in cells:
            if kind == "timestamp":
                df = df.withColumn(name(v), F.col(name(v)).try_cast("timestamp"))
        return Rel(df, kinds, frozenset(v for k, v in enumerate(names) if any(r[k] is None for r in rows)))

    # patterns

    def patterns(self, triples: list[Triple], extra: list[Triple] = ()) -> Rel:
        """extra: those that may be missing, see same_row()."""
        stars: dict = {}
        parts: list[tuple[set[str], int, object]] = []
        for t in triples:
            if isinstance(t.p, Path):
                parts.append((_vars(t.s, t.o), -1, lambda out, t=t: self.path(t.s, t.p, t.o, out)))
            elif isinstance(t.p, Var):
                parts.append((_vars(t.s, t.p, t.o), -2, lambda out, t=t: self.any_predicate(t, out)))
            else:
                stars.setdefault(t.s, []).append(t)
        for s, ts in stars.items():
            found = _vars(s).union(*[_vars(t.o) for t in ts])
            fixed = sum(not isinstance(t.o, Var) for t in ts) + 3 * (not isinstance(s, Var))
            more = [t for t in extra if t.s == s]
            parts.append((found, fixed, lambda out, s=s, ts=ts, more=more: self.star(s, ts, more, out)))
        out = UNIT
        for _, _, build in order(parts, lambda p: p[0], lambda p: p[1]):
            out = joined(out, build(out))
        return out

    def candidates(self, t: Triple) -> list[SubjectMap]:
        """Maps that can give a pattern with a constant predicate."""
        out = []
        for m in self.graph.maps:
            if isinstance(t.s, Iri) and (m.key is None or not t.s.value.startswith(m.prefix)):
                continue
            if isinstance(t.s, Lit):
                continue
            if t.p.value == RDF_TYPE:
                if m.classes and (isinstance(t.o, Var) or isinstance(t.o, Iri) and t.o.value in m.classes):
                    out.append(m)
                if RDF_TYPE not in m.columns:
                    continue
            c = m.columns.get(t.p.value)
            if c is None or m in out:
                continue
            if isinstance(t.o, Iri) and (c.link is None or not t.o.value.startswith(c.link)) or isinstance(t.o, Lit) and c.link is not None:
                continue
            out.append(m)
        return out

    def star(self, s, ts: list[Triple], extra: list[Triple] = (), beside: Rel = UNIT) -> Rel:
        """Patterns of one subject, and those that may be missing. beside: the relation that they will be joined with."""
        ts = list(dict.fromkeys(ts))
        if any(m.minted for m in self.graph.maps):
            return self.star_of_rows(s, ts, extra, beside)
        options = {t: self.candidates(t) for t in ts}
        if self.graph.triples is not None:
            out = UNIT
            for t in ts:
                parts = [self.scan(m, s, [t]) for m in options[t]] + [self.stored(t)]
                rel = parts[0]
                for p in parts[1:]:
                    rel = unioned(rel, p)
                out = joined(out, _once(rel) if len(parts) > 1 else rel)
            return out
        rels = []
        for prefix in dict.fromkeys(m.prefix for m in self.graph.maps):
            per = {t: [m for m in options[t] if m.prefix == prefix] for t in ts}
            if not all(per.values()):
                continue  # no subject of this prefix has all the predicates
            # few maps that cover the patterns: one scan each
            left, out = list(ts), UNIT
            while left:
                sole = [t for t in left if len(per[t]) == 1]
                if sole:
                    m = per[sole[0]][0]
                    mine = [t for t in sole if per[t][0] is m]
                    out = joined(out, self.scan(m, s, mine))
                else:
                    mine = left[:1]
                    rel = None
                    for m in per[mine[0]]:
                        part = self.scan(m, s, mine)
                        rel = part if rel is None else unioned(rel, part)
                    out = joined(out, _once(rel))  # a triple that two maps give is one
                left = [t for t in left if t not in mine]
            rels.append(out)
        if not rels:
            return self.nothing(set().union(*[_vars(t.s, t.o) for t in ts]))
        out = rels[0]
        for r in rels[1:]:
            out = unioned(out, r)
        return out

    def star_of_rows(self, s, ts: list[Triple], extra: list[Triple], beside: Rel) -> Rel:
        """A star where some maps have subjects of their own: these are one scan each, and what the other sources give is found
        without them."""
        per = [self.candidates(t) for t in ts]
        known = beside.kinds.get(s.name) if isinstance(s, Var) and s.name not in beside.maybe else None
        rels = []
        for m in self.graph.maps:
            if m.minted and all(m in ms for ms in per) and not (known and apart(known, Kind("iri", m.prefix, minted=m.minted))):
                rels.append(self.scan(m, s, ts, extra))
        others = Compiler(self.spark, replace(self.graph, maps=[m for m in self.graph.maps if not m.minted]))
        said = self.graph.said
        if all(said is None or t.p.value in said or others.candidates(t) for t in ts):
            rel = others.star(s, ts)
            for t in extra:
                rel = left_joined(rel, others.star(s, [t]))
            rels.append(rel)
        if not rels:
            return self.nothing(set().union(*[_vars(t.s, t.o) for t in [*ts, *extra]]))
        out = rels[0]
        for r in rels[1:]:
            out = unioned(out, r)
        return out

    def any_of(self, maps: list[SubjectMap], native: bool, s, o, without: frozenset[str]) -> list[DataFrame]:
        """Triples of maps; repeats are looked for only among predicates that several maps of one prefix give."""
        shared = shared_predicates(maps)
        frames = [as_triples(m, native, s, o, without | shared[m.prefix], strings=self.graph.strings) for m in maps]
        for prefix, names in shared.items():
            if names := names - without:
                parts = [as_triples(m, native, s, o, without, names, self.graph.strings) for m in maps if m.prefix == prefix]
                both = parts[0]
                for x in parts[1:]:
                    both = both.union(x)
                frames.append(both.distinct())
        return frames

    def nothing(self, names: set[str]) -> Rel:
        kinds = {v: Kind("iri") for v in sorted(names)}
        df = self.spark.range(0).select(*[F.lit(None).cast("string").alias(name(v)) for v in kinds] or [F.lit(True).alias("unit")])
        return Rel(df, kinds)

    def scan(self, m: SubjectMap, s, ts: list[Triple], extra: list[Triple] = ()) -> Rel:
        """One scan of a map for patterns of one subject, and for those that may be missing."""
        df = m.frame
        key = F.col(f"`{m.key}`") if m.key else F.monotonically_increasing_id()
        tests = [has_key(key, df.schema[m.key].dataType)] if m.key and not m.minted else []
        cols: dict[str, tuple] = {}
        if isinstance(s, Var):
            cols[s.name] = (key, Kind("iri", m.prefix, nameless=m.key is None, minted=m.minted))
        else:
            tests.append(key_equal(key, df.schema[m.key].dataType, m.prefix, s.value))
        many: str | None = None
        for t in ts:
            c = m.columns.get(t.p.value)
            if t.p.value == RDF_TYPE and c is None or t.p.value == RDF_TYPE and isinstance(t.o, Iri) and t.o.value in m.classes:
                if isinstance(t.o, Var):
                    value = F.lit(m.classes[0]) if len(m.classes) == 1 else F.explode(F.array(*[F.lit(x) for x in m.classes]))
                    many = t.o.name if len(m.classes) > 1 else many
                    if t.o.name in cols:
                        raise UnsupportedQuery("a class variable that is also another column of its subject")
                    cols[t.o.name] = (value, Kind("iri"))
                continue
            v = F.col(f"`{c.name}`")
            t_type = df.schema[c.name].dataType
            if c.link is None and self.graph.strings:
                v = v.cast("string")
            tests.append(v.isNotNull())
            if isinstance(t.o, Var):
                kind = Kind("iri", c.link, minted=c.minted) if c.link is not None else Kind("any" if m.minted else "lit")
                if t.o.name in cols:
                    other, kind2 = cols[t.o.name]
                    _named(kind2)
                    if kind2 == kind:
                        tests.append(other == v)
                    elif kind.kind == kind2.kind == "iri":
                        key_type = df.schema[m.key].dataType if m.key and t.o == s else None
                        tests.append(F.concat(F.lit(kind.prefix or ""), v.cast("string")) == F.concat(F.lit(kind2.prefix or ""), key_text(other, key_type)))
                    else:
                        tests.append(F.lit(False))
                else:
                    cols[t.o.name] = (v, kind)
            elif isinstance(t.o, Iri):
                tests.append(key_equal(v, t_type, c.link, t.o.value))
            elif m.minted and literal(t.o).type in ("int", "num"):
                tests.append(E(v, "any", Kind("any"), F.lit("literal")).number == literal(t.o).col)
            elif m.minted:
                tests.append(v == t.o.value)  # as stored() has it
            else:
                tests.append(literal_equal(v, t_type if not self.graph.strings else None, t.o))
        for t in extra:
            c = m.columns.get(t.p.value)
            v = F.col(f"`{c.name}`") if c else F.lit(None).cast("string")
            cols[t.o.name] = (v, Kind("iri", c.link, minted=c.minted) if c and c.link is not None else Kind("any"))
        for x in tests:
            df = df.where(x)
        out = []
        for n, (c, k) in cols.items():
            out.append(c.alias(name(n)))
            if k.kind == "any":
                out.append(F.when(c.isNotNull(), F.lit("literal")).alias(beside(n)))
        return Rel(df.select(*out or [F.lit(True).alias("unit")]), {n: k for n, (_, k) in cols.items()}, frozenset(t.o.name for t in extra))

    def stored(self, t: Triple, subject: Kind = Kind("iri")) -> Rel:
        """A pattern over the plain triples. subject: what s holds."""
        df = self.graph.triples
        tag = tag_of(F.col("o_kind"), *[F.col(c) if c in df.columns else None for c in ("o_datatype", "o_lang")])
        cols: dict[str, list] = {}

        def place(term, column, kind):
            if isinstance(term, Var):
                if term.name in cols:
                    first, _, _ = cols[term.name]
                    return [F.col(column) == first]
                cols[term.name] = [F.col(column), kind, column]
                return []
            if column == "o" and isinstance(term, Lit):
                given, one = E(F.col("o"), "any", Kind("any"), tag), literal(term)
                if one.type in ("int", "num"):
                    return [is_literal(tag), given.number == one.col]
                return [F.col("o") == term.value, is_literal(tag), (tag == "literal") | (term_class(tag) == term_class(F.lit(literal_tag(term))))]
            if column == "o":
                return [F.col("o") == term.value, ~is_literal(tag)]
            return [F.col(column) == term.value]

        for x in place(t.s, "s", subject) + place(t.p, "p", Kind("iri")) + place(t.o, "o", Kind("any")):
            df = df.where(x)
        out, kinds = [], {}
        for v, (c, kind, _) in cols.items():
            out.append(c.alias(name(v)))
            kinds[v] = kind
            if kind.kind == "any":
                out.append(tag.alias(beside(v)))
        return Rel(df.select(*out or [F.lit(True).alias("unit")]), kinds)

    def any_predicate(self, t: Triple, beside: Rel = UNIT, without: frozenset[str] = frozenset()) -> Rel:
        """A variable predicate: one scan of each source whose subjects the pattern, or the relation that it
        will be joined with, can mean. without: predicates that don't count."""
        maps = self.graph.maps
        if isinstance(t.s, Iri):
            maps = [m for m in maps if t.s.value.startswith(m.prefix)]
        elif isinstance(t.s, Var) and t.s.name in beside.kinds and t.s.name not in beside.maybe:
            maps = [m for m in maps if not apart(beside.kinds[t.s.name], Kind("iri", m.prefix, minted=m.minted))]
        native = isinstance(t.s, Var) and t.s not in (t.p, t.o) and self.graph.triples is None and len({(m.prefix, m.key and m.frame.schema[m.key].dataType) for m in maps}) == 1
        o = None if isinstance(t.o, Var) else t.o
        frames = self.any_of(maps, native, t.s, o, without)
        if self.graph.triples is not None:
            kept = self.graph.triples
            frames.append(kept.where(~F.col("p").isin(*sorted(without))) if without else kept)
        if not frames:
            return self.nothing(_vars(t.s, t.p, t.o))
        df = frames[0]
        for x in frames[1:]:
            df = df.unionByName(x, allowMissingColumns=True)
        if self.graph.triples is not None and not all(m.minted for m in maps):
            df = df.distinct()
        return Compiler(self.spark, Graph([], df)).stored(t, Kind("iri", maps[0].prefix) if native else Kind("iri"))

    # property paths

    def path(self, s, p, o, beside: Rel = UNIT) -> Rel:
        """beside: the relation that the path will be joined with, whose values of an end tell a closure where to begin."""
        if p.op == "link":
            return self.patterns([Triple(s, Iri(p.args[0]), o)])
        if p.op == "inv":
            return self.path(o, p.args[0], s, beside)
        if p.op == "seq":
            out, at = UNIT, s
            hidden = []
            for k, part in enumerate(p.args):
                to = o if k == len(p.args) - 1 else Var(self.temp())
                hidden += [to.name] if k < len(p.args) - 1 else []
                out = joined(out, self.path(at, part, to, beside if k == 0 else out))
                at = to
            return out.keep([v for v in out.kinds if v not in hidden])
        if p.op == "alt":
            out = self.path(s, p.args[0], o, beside)
            for part in p.args[1:]:
                out = unioned(out, self.path(s, part, o, beside))
            return replace(out, maybe=frozenset())
        if p.op == "neg":
            out = None
            for inverse in (False, True):
                names = frozenset(x for x, inv in p.args if inv == inverse)
                if not names and (inverse or any(not inv for _, inv in p.args)):
                    continue
                v = Var(self.temp())
                rel = self.any_predicate(Triple(o, v, s) if inverse else Triple(s, v, o), without=names)
                rel = rel.keep([x for x in rel.kinds if x != v.name])
                out = rel if out is None else unioned(out, rel)
            return out
        return self.closure(s, p.op, p.args[0], o, beside)

    def closure(self, s, op: str, part: Path, o, beside: Rel = UNIT) -> Rel:
        """?, + and * as sets of pairs: outward from a constant end or from the values that an end has in the relation beside,
        round by round, else in rounds that each double the length that paths can have."""
        a, b = self.temp(), self.temp()
        step = self.path(Var(a), part, Var(b)).with_text(a).with_text(b)
        step = replace(step, df=step.df.select(F.col(name(a)).alias("a"), F.col(name(b)).alias("b")).distinct())
        pairs = step.df
        if isinstance(s, Iri) or isinstance(o, Iri):
            return self.reached(s, op, pairs, o)
        for here, there, start, end in (("a", "b", s, o), ("b", "a", o, s)):
            if start.name in beside.kinds and start.name not in beside.maybe and beside.kinds[start.name].kind == "iri" and not beside.kinds[start.name].nameless:
                seeds = beside.keep([start.name]).with_text(start.name)
                return self.walked(seeds.df.select(F.col(name(start.name)).alias("from")).distinct(), start, op, pairs.select(F.col(here).alias("x"), F.col(there).alias("y")), end)
        if op in ("plus", "star"):
            pairs = _checkpointed(pairs)
            n = pairs.count()
            while True:
                far = pairs.alias("x").join(pairs.alias("y"), F.col("x.b") == F.col("y.a")).select("x.a", "y.b")
                pairs = _checkpointed(pairs.union(far).distinct())
                if (now := pairs.count()) == n:
                    break
                n = now
        if op in ("star", "opt"):
            nodes = step.df.select("a").union(step.df.select("b")).distinct()
            pairs = pairs.union(nodes.select("a", F.col("a").alias("b"))).distinct()
        cols, kinds = {}, {}
        for t, c in ((s, "a"), (o, "b")):
            if t.name in cols:
                pairs = pairs.where("a = b")
            cols[t.name], kinds[t.name] = F.col(c), Kind("iri")
        return Rel(pairs.select(*[c.alias(name(v)) for v, c in cols.items()]), kinds)

    def reached(self, s, op: str, step: DataFrame, o) -> Rel:
        """What a constant end reaches; no more is ever kept than that."""
        here, there, start, end = ("a", "b", s, o) if isinstance(s, Iri) else ("b", "a", o, s)
        first = self.spark.createDataFrame([(start.value,)], "x string")
        new = seen = _checkpointed(step.join(F.broadcast(first.withColumnRenamed("x", here)), here, "left_semi").select(F.col(there).alias("x")).distinct())
        while op != "opt" and not new.isEmpty():
            far = step.join(new.withColumnRenamed("x", here), here, "left_semi").select(F.col(there).alias("x")).distinct()
            new = _checkpointed(far.join(seen, "x", "left_anti"))
            seen = seen.union(new)
        if op != "plus":  # a constant reaches itself, wherever it occurs
            seen = seen.union(first).distinct()
        if isinstance(end, Var):
            return Rel(seen.select(F.col("x").alias(name(end.name))), {end.name: Kind("iri")})
        return Rel(seen.where(F.col("x") == end.value).select(F.lit(True).alias("unit")))

    def walked(self, seeds: DataFrame, start: Var, op: str, step: DataFrame, end: Var) -> Rel:
        """What each of the seeds (from) reaches by steps (x, y): a round goes on from the pairs that the last one found."""
        seeds = _checkpointed(seeds)
        new = seen = _checkpointed(step.join(seeds.withColumnRenamed("from", "x"), "x").select(F.col("x").alias("from"), "y").distinct())
        while op != "opt" and not new.isEmpty():
            far = step.join(new.withColumnRenamed("y", "x"), "x").select("from", "y").distinct()
            new = _checkpointed(far.join(seen, ["from", "y"], "left_anti"))
            seen = seen.union(new)
        if op != "plus":  # each seed reaches itself, wherever it occurs
            seen = seen.union(seeds.select("from", F.col("from").alias("y"))).distinct()
        if start == end:
            return Rel(seen.where("from = y").select(F.col("y").alias(name(end.name))), {end.name: Kind("iri")})
        return Rel(seen.select(F.col("from").alias(name(start.name)), F.col("y").alias(name(end.name))), {start.name: Kind("iri"), end.name: Kind("iri")})

    # SELECT

    def select(self, q: Select, ordered: bool = False) -> Rel:
        rel = self.group(q.where)
        if q.values:
            rel = joined(rel, self.values(*q.values))
        rel = replace(rel, df=rel.frame(self.spark))
        exprs = [e for _, e in q.projection if e is not None] + q.having + [e for e, _ in q.order_by]
        found = list(dict.fromkeys(a for e in exprs for a in _aggregates(e)))
        aggregates: dict = {}
        if found or q.group_by:
            rel, aggregates = self.grouped(rel, q, found)
            for e in q.having:
                rel, flags = self.flagged(rel, e)
                rel = rel.where(Expressions(rel, aggregates, flags).condition(e))
                rel = replace(rel, df=rel.df.drop(*flags.values())) if flags else rel
        names = []
        for v, e in q.projection:
            names.append(v)
            if e is not None:
                if aggregates and e in aggregates:
                    rel = self.put(rel, v, Expressions(rel, aggregates)(e))
                    if isinstance(e, Aggregate) and e.name == "count":
                        rel = replace(rel, maybe=rel.maybe - {v})
                else:
                    rel, flags = self.flagged(rel, e)
                    rel = self.put(rel, v, Expressions(rel, aggregates, flags)(e))
            elif v not in rel.kinds:
                rel = self.put(rel, v, E(F.lit(None).cast("string"), "str"))
        names = names or [v for v in variables(q.where) if v in rel.kinds] + [v for v in (q.values[0] if q.values else ()) if v not in variables(q.where)]
        if q.distinct or q.reduced:
            rel = rel.keep(names)
            rel = replace(rel, df=rel.df.distinct())
        if q.order_by:
            keys = []
            for e, up in q.order_by:
                rel, flags = self.flagged(rel, e)
                v = Expressions(rel, aggregates, flags)(e)
                for c in v.order if v.kinds is not None else [v.col if v.kind.prefix is None else v.text]:
                    keys.append(c.asc_nulls_first() if up else c.desc_nulls_last())
            rel = replace(rel, df=rel.df.orderBy(*keys))
        if q.offset:
            rel = replace(rel, df=rel.df.offset(q.offset))
        if q.limit is not None:
            rel = replace(rel, df=rel.df.limit(q.limit))
        return rel.keep(names)

    def grouped(self, rel: Rel, q: Select, found: list[Aggregate]) -> tuple[Rel, dict]:
        keys = []
        for v, e in q.group_by:
            if not (isinstance(e, Var) and e.name == v):
                v = v or self.temp()
                rel, flags = self.flagged(rel, e)
                rel = self.put(rel, v, Expressions(rel, flags=flags)(e))
            elif v not in rel.kinds:
                rel = self.put(rel, v, E(F.lit(None).cast("string"), "str"))
            _named(rel.kinds[v])
            keys.append(v)
        flags = {}
        for a in found:
            rel, more = self.flagged(rel, a.arg)
            flags |= more
        ex = Expressions(rel, flags=flags)
        cols, kinds, names, after = [], {}, {}, {}
        for a in found:
            v = self.temp()
            col, kind, done = self.aggregate(rel, ex, a)
            cols.append(col.alias(name(v)))
            kinds[v], names[a] = kind, v
            if kind.kind == "any":
                after[v] = done
        group = [c for v in keys for c in ([name(v), beside(v)] if rel.kinds[v].kind == "any" else [name(v)])]
        if cols:
            df = rel.df.groupBy(*group).agg(*cols) if keys else rel.df.agg(*cols)
        else:
            df = rel.df.select(*group).distinct()
        for v, done in after.items():
            for c, part in zip((beside(v), name(v)), done(F.col(name(v)))):
                df = df.withColumn(c, part)
        out = Rel(df, {v: rel.kinds[v] for v in keys} | kinds, frozenset(v for v in keys if v in rel.maybe) | {v for a, v in names.items() if a.name != "count"})
        return out, names

    def aggregate(self, rel: Rel, ex: Expressions, a: Aggregate):
        """The column, its kind, and if that is any what of the column are the term's tag and text."""
        if a.arg is None:
            if not a.distinct:
                return F.count(F.lit(1)), Kind(), None
            cols = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in rel.columns()]
            return F.countDistinct(F.struct(*cols)), Kind(), None
        v = ex(a.arg)
        if a.name == "count":
            if a.distinct:
                one = v.col if v.kind.kind == "lit" else v.text if v.kind.kind == "iri" else F.when(v.col.isNotNull(), F.struct(v.text, term_class(v.tag)))
                return F.countDistinct(one), Kind(), None
            return F.count(v.col), Kind(), None
        if a.name in ("sum", "avg"):
            n = v.number
            c = {("sum", False): F.sum, ("sum", True): F.sum_distinct, ("avg", False): F.avg, ("avg", True): lambda x: F.sum_distinct(x) / F.countDistinct(x)}[a.name, a.distinct](n)
            # no value gives 0, a value that is no number an error
            zero = F.coalesce(c, F.lit(0))
            return F.when(F.count(v.col) == F.count(n), zero), Kind(), None
        if a.name in ("min", "max", "sample"):
            f = F.max if a.name == "max" else F.min
            if v.kind.kind == "iri":
                return f(v.text), Kind("iri"), None
            if v.kind.kind == "any":
                whole = F.struct(F.struct(*[c.alias(f"k{k}") for k, c in enumerate(v.order)]).alias("key"), v.tag.alias("tag"), v.text.alias("text"))
                return f(F.when(v.col.isNotNull(), whole)), Kind("any"), lambda c: (c["tag"], c["text"])
            return f(v.col), Kind(), None
        text = v.text
        got = F.collect_set(text) if a.distinct else F.collect_list(text)
        return F.concat_ws(a.separator, F.sort_array(got)), Kind(), None

    def result(self, q: Select) -> tuple[DataFrame, dict[str, Kind]]:
        """The solutions with whole IRIs, and the kind of each variable (any: see solutions())."""
        rel = self.select(q)
        df = rel.df.select(*[(rel.text(v) if rel.kinds[v].kind == "iri" else rel.col(v)).alias(v) for v in rel.kinds])
        return df, rel.kinds

    def solutions(self, q: Select) -> DataFrame:
        """A struct (type, value, datatype, xml:lang) for each variable, null if unbound."""
        rel = self.select(q)
        cols = []
        for v, k in rel.kinds.items():
            t = type_of(rel.type(v)) if k.kind == "lit" else "str"
            text = F.date_format(rel.col(v), "yyyy-MM-dd'T'HH:mm:ss") if t == "time" else rel.text(v)
            tag = rel.kind_col(v)
            kind = F.when(is_literal(tag), F.lit("literal")).when(text.startswith("_:"), F.lit("bnode")).otherwise(F.lit("uri"))
            type_ = F.when(tag.startswith(TYPED) & (tag != TYPED + XSD + "string"), F.substr(tag, F.lit(len(TYPED) + 1)))
            lang = F.when(tag.startswith(TAGGED), F.substr(tag, F.lit(len(TAGGED) + 1)))
            cols.append(F.when(rel.col(v).isNotNull(), F.struct(kind.alias("type"), text.alias("value"), type_.alias("datatype"), lang.alias("xml:lang"))).alias(v))
        return rel.df.select(*cols)


def _once(rel: Rel) -> Rel:
    """A set of solutions."""
    for k in rel.kinds.values():
        _named(k)
    return replace(rel, df=rel.df.distinct())


def _checkpointed(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint()


def _conjuncts(e) -> list:
    return _conjuncts(e.args[0]) + _conjuncts(e.args[1]) if isinstance(e, Call) and e.name == "&&" else [e]


def _used(e) -> set[str]:
    if isinstance(e, Var):
        return {e.name}
    if isinstance(e, Call):
        return set().union(*[_used(x) for x in e.args]) if e.args else set()
    if isinstance(e, Aggregate):
        return _used(e.arg) if e.arg is not None else set()
    return {"."} if isinstance(e, Exists) else set()


def _mentioned_by(e) -> set[str]:
    """Variables that an expression mentions, also in the groups of EXISTS."""
    return (_used(e) - {"."}).union(*[_mentioned(x.group) for x in _exists_in(e)])


def _mentioned(g: Group) -> set[str]:
    """Variables that a group mentions at any depth, but for those that a sub-select keeps to itself."""
    out = set(variables(g))
    for kind, x in g.elements:
        if kind == "filter":
            out |= _mentioned_by(x)
        elif kind == "bind":
            out |= _mentioned_by(x[1])
        elif kind in ("optional", "minus", "group"):
            out |= _mentioned(x)
        elif kind == "union":
            out = out.union(*[_mentioned(y) for y in x])
    return out


#: Elements whose order does not matter.
_JOINS = ("triple", "group", "union", "values", "select")


def _triples_first(elements) -> list:
    """Among elements that are only joined triples come first, as they tell nested groups where to look."""
    out, run = [], []
    for e in [*elements, ("", None)]:
        if e[0] in _JOINS:
            run.append(e)
            continue
        out += sorted(run, key=lambda x: x[0] != "triple")
        run = []
        if e[0]:
            out.append(e)
    return out


def _bound_first(g: Group) -> set[str]:
    """Variables of the triples that a group begins with, before anything whose result may depend on them."""
    out: set[str] = set()
    for kind, x in g.elements:
        if kind == "triple":
            out |= _vars(x.s, x.p, x.o)
        elif kind not in _JOINS and kind != "filter":
            break
    return out


def _plain(g: Group, outer: set[str]) -> bool:
    """Whether outer variables have no part in a group but as what its patterns bind and its own filters compare."""
    mine = outer - _bound_first(g)
    for kind, x in g.elements:
        if kind == "filter" and _has_exists(x) or kind == "bind" and _mentioned_by(x[1]) & outer:
            return False
        if kind in ("optional", "minus") and _mentioned(x) & (mine if kind == "optional" and _alike(x) else outer):
            return False
        if any(not _within(p, outer) for p in (x if kind == "union" else (x,) if kind == "group" else ())):
            return False
    return True


def _alike(g: Group) -> bool:
    return all(k == "triple" or k == "filter" and not _has_exists(x) for k, x in g.elements)


def _within(g: Group, outer: set[str]) -> bool:
    """As _plain, for a nested group, whose filters don't see the outer row by a join."""
    seen = outer - _bound_first(g)
    return _plain(g, outer) and not any(kind == "filter" and _used(x) & seen for kind, x in g.elements)


def _exists_in(e) -> list[Exists]:
    if isinstance(e, Exists):
        return [e]
    return [x for a in e.args for x in _exists_in(a)] if isinstance(e, Call) else []


def _has_exists(e) -> bool:
    return bool(_exists_in(e))


def _aggregates(e) -> list[Aggregate]:
    if isinstance(e, Aggregate):
        return [e]
    return [x for a in e.args for x in _aggregates(a)] if isinstance(e, Call) else []


def _demanded(e) -> set[str]:
    """Variables that are bound wherever a condition holds."""
    if isinstance(e, Call) and e.name in ("=", "!=", "<", ">", "<=", ">="):
        return {x.name for x in e.args if isinstance(x, Var)}
    if isinstance(e, Call) and e.name == "bound":
        return _used(e.args[0])
    return set()
