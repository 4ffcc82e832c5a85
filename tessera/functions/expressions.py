"""SPARQL expressions as columns. An error is null, as unbound is, which agrees with SQL's three values."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.relation import NUMBERS, NUMERIC, STRING_TAG, TAGGED, TYPED, WHOLE, Kind, Rel, _named, is_literal, term_class
from ..plans.sparql import Call
from ..plans.terms import RDF, XSD, BNode, Iri, Lit, UnsupportedQuery, Var


@dataclass(frozen=True)
class E:
    """A value: kind as in Rel; type num, int, str, bool, time or any; kinds: the column of its tag if any."""

    col: Column
    type: str
    kind: Kind = Kind("lit")
    kinds: Column | None = None
    lang: str | None = None

    @property
    def text(self) -> Column:
        _named(self.kind)
        c = self.col.cast("string")
        return F.concat(F.lit(self.kind.prefix), c) if self.kind.prefix is not None else c

    @property
    def number(self) -> Column:
        if self.type in ("num", "int"):
            return self.col
        if self.type != "any":
            return F.lit(None).cast("double")
        # what a source without types gives is read as a number where one is wanted
        return F.when(self.kinds.isin("literal", *[TYPED + XSD + x for x in NUMBERS]), self.text.try_cast("double"))

    @property
    def tag(self) -> Column:
        if self.kinds is not None:
            return self.kinds
        if self.kind.kind == "iri":
            return F.when(self.col.isNotNull(), F.lit("iri"))
        kind = {"num": "double", "int": "integer", "bool": "boolean", "time": "dateTime"}.get(self.type, "string")
        return F.when(self.col.isNotNull(), F.lit(TAGGED + self.lang if self.lang else TYPED + XSD + kind))

    @property
    def family(self) -> Column:
        """With which values it can be compared: n, b, t, s, u (text without a type), r (resources), or its own tag."""
        if self.kinds is None:
            return F.lit("r" if self.kind.kind == "iri" else {"num": "n", "int": "n", "bool": "b", "time": "t"}.get(self.type, "s"))
        times = (TYPED + XSD + "dateTime", TYPED + XSD + "date")
        return F.when(self.kinds == "literal", "u").when(self.kinds == TYPED + XSD + "boolean", "b").when(self.kinds.isin(*times), "t").otherwise(term_class(self.kinds))

    @property
    def whole(self) -> Column:
        """As a whole number, null if it is none."""
        if self.type == "int":
            return self.col.cast("long")
        return F.when(self.kinds.isin(*[TYPED + XSD + x for x in WHOLE]), self.text.try_cast("long")) if self.kinds is not None else F.lit(None).cast("long")

    @property
    def moment(self) -> Column:
        return self.col.cast("timestamp") if self.type == "time" else self.text.try_cast("timestamp")

    @property
    def flag(self) -> Column:
        return self.col if self.type == "bool" else self.text.try_cast("boolean")

    @property
    def order(self) -> list[Column]:
        """What any terms are ordered by: unbound ones, blank nodes, IRIs, then numbers, times and other literals."""
        f = self.family
        rank = F.when(self.col.isNull(), 0).when((f == "r") & self.text.startswith("_:"), 1).when(f == "r", 2).when(f == "n", 3).when(f == "t", 4).when(f == "b", 5).otherwise(6)
        return [rank, F.when(f == "n", self.number), F.when(f == "n", self.whole), F.when(f == "t", self.moment), self.text]

    @property
    def true(self) -> Column:
        """The effective boolean value."""
        if self.type == "bool":
            return self.col
        if self.type in ("num", "int"):
            return (self.col != 0) & ~F.isnan(self.col.cast("double"))
        if self.type == "any":
            f = self.family
            return F.when(f == "n", (self.number != 0) & ~F.isnan(self.number)).when(f == "b", self.flag).when(f.isin("s", "u"), F.length(self.col) > 0)
        if self.type in ("str", "any") and self.kind.kind != "iri":
            return F.length(self.col) > 0
        return F.lit(None).cast("boolean")


def type_of(t: T.DataType) -> str:
    if isinstance(t, (T.DoubleType, T.FloatType, T.DecimalType)):
        return "num"
    if isinstance(t, NUMERIC):
        return "int"
    if isinstance(t, T.BooleanType):
        return "bool"
    return "time" if isinstance(t, (T.TimestampType, T.DateType, T.TimestampNTZType)) else "str"


def literal(x: Lit) -> E:
    v = x.python()
    if isinstance(v, bool):
        return E(F.lit(v), "bool")
    if isinstance(v, int):
        return E(F.lit(v), "int")
    if isinstance(v, float):
        return E(F.lit(v), "num")
    if x.datatype in (XSD + "dateTime", XSD + "date"):
        return E(F.lit(x.value).try_cast("timestamp"), "time")
    return E(F.lit(v), "str", lang=x.lang)


def _same(a: E, b: E) -> Column:
    ka, kb = a.kind.kind, b.kind.kind
    if ka == kb == "iri":
        if a.kind == b.kind:
            return a.col == b.col
        return a.text == b.text
    if "iri" in (ka, kb) and "lit" in (ka, kb):
        return F.when(a.col.isNotNull() & b.col.isNotNull(), F.lit(False))
    if "any" in (ka, kb):
        one, other = a.family == "r", b.family == "r"
        return F.when(one & other, a.text == b.text).when(one | other, F.when(a.col.isNotNull() & b.col.isNotNull(), F.lit(False))).otherwise(_ordered(a, b, lambda x, y: x == y))
    return _ordered(a, b, lambda x, y: x == y)


def _ordered(a: E, b: E, op) -> Column:
    nums = ("num", "int")
    if a.type in nums and b.type in nums:
        return op(a.col, b.col)
    if "any" in (a.type, b.type):
        return _ordered_any(a, b, op)
    if "time" in (a.type, b.type):
        if a.type in ("time", "str") and b.type in ("time", "str"):
            return op(a.col.try_cast("timestamp") if a.type != "time" else a.col, b.col.try_cast("timestamp") if b.type != "time" else b.col)
        return F.lit(None).cast("boolean")
    if a.type == b.type:
        return op(a.col, b.col) if a.type == "bool" else op(a.text, b.text)
    return F.lit(None).cast("boolean")


def _ordered_any(a: E, b: E, op) -> Column:
    """Compares terms of any kind; those of unlike kinds are an error. Text without a type is what the other side is."""
    x, y = a.family, b.family
    either = lambda f: x.isin(f, "u") & y.isin(f, "u") & ((x == f) | (y == f))
    out = F.when(a.whole.isNotNull() & b.whole.isNotNull(), op(a.whole, b.whole))
    out = out.when(either("n"), op(a.number, b.number)).when(either("t"), op(a.moment, b.moment)).when(either("b"), op(a.flag, b.flag))
    return out.when(x.isin("s", "u") & y.isin("s", "u") | (x == y), op(a.text, b.text))


_CASTS = {"integer": ("long", "int"), "int": ("int", "int"), "long": ("long", "int"), "double": ("double", "num"), "float": ("float", "num"), "decimal": ("decimal(38,10)", "num"), "string": ("string", "str"), "boolean": ("boolean", "bool"), "dateTime": ("timestamp", "time")}


def _regex(pattern: Column, flags: E | None) -> Column:
    if flags is None:
        return pattern
    # flags stand in front as an inline group; the letter q has no inline form
    return F.when(flags.col == "", pattern).otherwise(F.concat(F.lit("(?"), F.translate(flags.col, "q", ""), F.lit(")"), pattern))


def _unary_num(a: E, f) -> E:
    return E(f(a.number), "int" if a.type == "int" else "num")


class Expressions:
    """Compiles expressions in the scope of a relation; exists(rel, expression) serves EXISTS inside one."""

    def __init__(self, rel: Rel, aggregates: dict | None = None, flags: dict | None = None):
        self.rel, self.aggregates, self.flags = rel, aggregates or {}, flags or {}

    def __call__(self, e) -> E:
        if e in self.aggregates if e.__hash__ else False:
            return self(Var(self.aggregates[e]))
        if e in self.flags if e.__hash__ else False:
            return E(F.col(self.flags[e]), "bool")
        if isinstance(e, Var):
            if e.name not in self.rel.kinds:
                return E(F.lit(None).cast("string"), "str")
            k = self.rel.kinds[e.name]
            if k.kind == "lit":
                return E(self.rel.col(e.name), type_of(self.rel.type(e.name)))
            if isinstance(self.rel.type(e.name), T.StructType):
                return E(self.rel.text(e.name), "str", Kind("iri"))
            return E(self.rel.col(e.name), "any" if k.kind == "any" else "str", k, self.rel.kind_col(e.name) if k.kind == "any" else None)
        if isinstance(e, Lit):
            return literal(e)
        if isinstance(e, Iri):
            return E(F.lit(e.value), "str", Kind("iri"))
        if isinstance(e, BNode):
            return E(F.lit("_:" + e.value), "str", Kind("iri"))
        if isinstance(e, Call):
            return self.call(e)
        raise UnsupportedQuery(f"cannot evaluate {type(e).__name__} here")

    def condition(self, e) -> Column:
        return self(e).true

    def equal(self, a, b) -> Column:
        """Equality; a constant IRI against native keys is compared by key, so that filters reach the scan."""
        for x, y in ((a, b), (b, a)):
            if isinstance(x, Var) and isinstance(y, Iri) and x.name in self.rel.kinds:
                k = self.rel.kinds[x.name]
                if k.prefix is not None and not k.nameless:
                    return key_equal(self.rel.col(x.name), self.rel.type(x.name), k.prefix, y.value)
        return _same(self(a), self(b))

    def call(self, e: Call) -> E:
        f, args = e.name, e.args
        if f == "&&":
            return E(self.condition(args[0]) & self.condition(args[1]), "bool")
        if f == "||":
            return E(self.condition(args[0]) | self.condition(args[1]), "bool")
        if f == "!":
            return E(~self.condition(args[0]), "bool")
        if f == "=":
            return E(self.equal(*args), "bool")
        if f == "!=":
            return E(~self.equal(*args), "bool")
        if f in ("<", ">", "<=", ">="):
            op = {"<": lambda x, y: x < y, ">": lambda x, y: x > y, "<=": lambda x, y: x <= y, ">=": lambda x, y: x >= y}[f]
            return E(_ordered(self(args[0]), self(args[1]), op), "bool")
        if f == "in":
            out = F.lit(False)
            for x in args[1:]:
                out = out | self.equal(args[0], x)
            return E(out, "bool")
        if f == "bound":
            name = args[0].name
            return E(self.rel.col(name).isNotNull() if name in self.rel.kinds else F.lit(False), "bool")
        a = [self(x) for x in args]
        if f == "if":
            return self._merged(a[1:], lambda c: F.when(a[0].true, c[0]).when(~a[0].true, c[1]))
        if f == "coalesce":
            return self._merged(a, lambda c: F.coalesce(*c)) if a else E(F.lit(None).cast("string"), "str")
        if f in ("+", "-", "*", "/", "neg"):
            return self._arithmetic(f, a)
        if f.startswith(XSD):
            return self._cast(f.removeprefix(XSD), a[0])
        method = getattr(self, f"f_{f}", None)
        if method is None:
            raise UnsupportedQuery(f"unknown function {f}")
        return method(*a)

    def _merged(self, values: list[E], merge) -> E:
        kinds = {v.kind for v in values}
        types = {v.type for v in values}
        if len(kinds) == 1 and len(types) == 1 and len({v.lang for v in values}) == 1:
            v = values[0]
            return E(merge([x.col for x in values]), v.type, v.kind, merge([x.kinds for x in values]) if v.kinds is not None else None)
        if types <= {"num", "int"}:
            return E(merge([x.col.cast("double") for x in values]), "num")
        if all(k.kind == "iri" for k in kinds):
            return E(merge([x.text for x in values]), "str", Kind("iri"))
        if all(k.kind == "lit" for k in kinds) and types == {"str"} and len({v.lang for v in values}) == 1:
            return E(merge([x.text for x in values]), "str", lang=values[0].lang)
        return E(merge([x.text for x in values]), "any", Kind("any"), merge([x.tag for x in values]))

    def _arithmetic(self, f: str, a: list[E]) -> E:
        x = a[0].number
        if f == "neg":
            return E(-x, a[0].type if a[0].type == "int" else "num")
        y = a[1].number
        whole = a[0].type == a[1].type == "int" and f != "/"
        if whole:
            x, y = x.cast("long"), y.cast("long")
        op = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply, "/": F.try_divide}[f]
        return E(op(x, y) if f != "/" else op(x.cast("double"), y.cast("double")), "int" if whole else "num")

    def _cast(self, to: str, a: E) -> E:
        if to not in _CASTS:
            raise UnsupportedQuery(f"cannot cast to {to}")
        kind, type_ = _CASTS[to]
        if to == "string":
            return E(a.text, "str")
        if type_ == "int" and a.type != "bool":
            source = F.trim(a.text)
            return E(F.when(source.rlike(r"^[+-]?\d+$") | F.lit(a.type in ("num", "int")), (source if a.type in ("str", "any") else a.col).try_cast(kind)), "int")
        return E((F.trim(a.text) if a.type in ("str", "any") else a.col).try_cast(kind), type_)

    # terms

    def f_str(self, a: E) -> E:
        return E(a.text, "str")

    def f_lang(self, a: E) -> E:
        tag = a.tag
        return E(F.when(tag.startswith(TAGGED), F.substr(tag, F.lit(len(TAGGED) + 1))).when(is_literal(tag), F.lit("")), "str")

    def f_langmatches(self, a: E, b: E) -> E:
        tag, want = F.lower(a.text), F.lower(b.text)
        return E(F.when(want == "*", tag != "").otherwise((tag == want) | tag.startswith(F.concat(want, F.lit("-")))), "bool")

    def f_datatype(self, a: E) -> E:
        tag = a.tag
        return E(F.when(tag.startswith(TYPED), F.substr(tag, F.lit(len(TYPED) + 1))).when(tag.startswith(TAGGED), F.lit(RDF + "langString")).when(tag == "literal", F.lit(XSD + "string")), "str", Kind("iri"))

    def f_iri(self, a: E) -> E:
        return E(a.text, "str", Kind("iri"))

    f_uri = f_iri

    def f_bnode(self, *a: E) -> E:
        return E(F.concat(F.lit("_:"), F.sha1(a[0].text) if a else F.uuid()), "str", Kind("iri"))

    def f_strdt(self, a: E, b: E) -> E:
        return E(a.text, "any", Kind("any"), F.when(a.col.isNotNull(), F.concat(F.lit(TYPED), b.text)))

    def f_strlang(self, a: E, b: E) -> E:
        return E(a.text, "any", Kind("any"), F.when(a.col.isNotNull(), F.concat(F.lit(TAGGED), b.text)))

    def _is(self, a: E, want: str) -> E:
        if a.kinds is not None:
            blank = a.text.startswith("_:")
            found = {"iri": (a.kinds == "iri") & ~blank, "blank": blank & ~is_literal(a.kinds), "literal": is_literal(a.kinds)}[want]
        elif a.kind.kind == "iri":
            blank = a.text.startswith("_:")
            found = {"iri": ~blank, "blank": blank, "literal": F.lit(False)}[want]
        else:
            found = F.lit(want == "literal")
        return E(F.when(a.col.isNotNull(), found), "bool")

    def f_isiri(self, a: E) -> E:
        return self._is(a, "iri")

    f_isuri = f_isiri

    def f_isblank(self, a: E) -> E:
        return self._is(a, "blank")

    def f_isliteral(self, a: E) -> E:
        return self._is(a, "literal")

    def f_isnumeric(self, a: E) -> E:
        return E(F.when(a.col.isNotNull(), a.family == "n"), "bool")

    def f_sameterm(self, a: E, b: E) -> E:
        if "any" not in (a.kind.kind, b.kind.kind) and a.kind.kind != b.kind.kind or a.kind.kind == b.kind.kind == "lit" and a.type != b.type:
            return E(F.when(a.col.isNotNull() & b.col.isNotNull(), F.lit(False)), "bool")
        if "any" in (a.kind.kind, b.kind.kind):
            return E((a.text == b.text) & (F.when(a.tag == "literal", STRING_TAG).otherwise(F.lower(a.tag)) == F.when(b.tag == "literal", STRING_TAG).otherwise(F.lower(b.tag))), "bool")
        return E((a.text == b.text) & F.lit(a.lang == b.lang), "bool")

    # strings

    def f_strlen(self, a: E) -> E:
        return E(F.length(a.text), "int")

    def f_substr(self, a: E, start: E, n: E | None = None) -> E:
        s = start.number.cast("int")
        return E(F.substr(a.text, s, n.number.cast("int")) if n else F.substr(a.text, s), "str")

    def f_ucase(self, a: E) -> E:
        return E(F.upper(a.text), "str")

    def f_lcase(self, a: E) -> E:
        return E(F.lower(a.text), "str")

    def f_strstarts(self, a: E, b: E) -> E:
        return E(a.text.startswith(b.text), "bool")

    def f_strends(self, a: E, b: E) -> E:
        return E(a.text.endswith(b.text), "bool")

    def f_contains(self, a: E, b: E) -> E:
        return E(a.text.contains(b.text), "bool")

    def f_strbefore(self, a: E, b: E) -> E:
        at = F.instr(a.text, b.text)
        return E(F.when(a.text.contains(b.text), F.substr(a.text, F.lit(1), at - 1)).otherwise(F.when(b.col.isNotNull() & a.col.isNotNull(), F.lit(""))), "str")

    def f_strafter(self, a: E, b: E) -> E:
        at = F.instr(a.text, b.text)
        return E(F.when(b.text == "", a.text).when(a.text.contains(b.text), F.substr(a.text, at + F.length(b.text))).otherwise(F.when(b.col.isNotNull() & a.col.isNotNull(), F.lit(""))), "str")

    def f_concat(self, *a: E) -> E:
        return E(F.concat(*[x.text for x in a]) if a else F.lit(""), "str")

    def f_encode_for_uri(self, a: E) -> E:
        return E(encoded(a.text), "str")

    def f_regex(self, a: E, pattern: E, flags: E | None = None) -> E:
        return E(F.rlike(a.text, _regex(pattern.text, flags)), "bool")

    def f_replace(self, a: E, pattern: E, new: E, flags: E | None = None) -> E:
        return E(F.regexp_replace(a.text, _regex(pattern.text, flags), new.text), "str")

    # numbers

    def f_abs(self, a: E) -> E:
        return _unary_num(a, F.abs)

    def f_round(self, a: E) -> E:
        """Halves go up, also those of negative numbers."""
        return a if a.type == "int" else E(F.floor(a.number + 0.5).cast("double"), "num")

    def f_ceil(self, a: E) -> E:
        return a if a.type == "int" else E(F.ceil(a.number).cast("double"), "num")

    def f_floor(self, a: E) -> E:
        return a if a.type == "int" else E(F.floor(a.number).cast("double"), "num")

    def f_rand(self) -> E:
        return E(F.rand(), "num")

    # time

    def _time(self, a: E) -> Column:
        return a.col if a.type == "time" else a.text.try_cast("timestamp")

    def f_now(self) -> E:
        return E(F.current_timestamp(), "time")

    def f_year(self, a: E) -> E:
        return E(F.year(self._time(a)), "int")

    def f_month(self, a: E) -> E:
        return E(F.month(self._time(a)), "int")

    def f_day(self, a: E) -> E:
        return E(F.dayofmonth(self._time(a)), "int")

    def f_hours(self, a: E) -> E:
        return E(F.hour(self._time(a)), "int")

    def f_minutes(self, a: E) -> E:
        return E(F.minute(self._time(a)), "int")

    def f_seconds(self, a: E) -> E:
        return E(F.second(self._time(a)), "int")

    def f_tz(self, a: E) -> E:
        return E(F.when(self._time(a).isNotNull(), F.when(a.text.endswith("Z"), F.lit("Z")).otherwise(F.regexp_extract(a.text, r"([+-]\d\d:\d\d)$", 1))), "str")

    def f_timezone(self, a: E) -> E:
        return E(F.when(a.text.endswith("Z"), F.lit("PT0S")), "str")

    # hashes

    def f_md5(self, a: E) -> E:
        return E(F.md5(a.text), "str")

    def f_sha1(self, a: E) -> E:
        return E(F.sha1(a.text), "str")

    def f_sha256(self, a: E) -> E:
        return E(F.sha2(a.text, 256), "str")

    def f_sha384(self, a: E) -> E:
        return E(F.sha2(a.text, 384), "str")

    def f_sha512(self, a: E) -> E:
        return E(F.sha2(a.text, 512), "str")

    def f_uuid(self) -> E:
        return E(F.concat(F.lit("urn:uuid:"), F.uuid()), "str", Kind("iri"))

    def f_struuid(self) -> E:
        return E(F.uuid(), "str")


def encoded(c: Column) -> Column:
    """Percent-encoding of all but unreserved characters."""
    out = F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    return F.replace(F.replace(out, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def literal_equal(v: Column, t: T.DataType | None, x: Lit) -> Column:
    """Whether a column of a type, or of plain text if None, has the literal's value."""
    if t is None:
        return v == x.value
    c, mine = literal(x), type_of(t)
    if x.lang is not None:
        return F.lit(False)
    if {mine, c.type} <= {"int", "num"} or mine == c.type:
        return v == c.col
    if mine == "time":
        return v == F.lit(x.value).try_cast("timestamp")
    return F.lit(False)


def literal_tag(x: Lit) -> str:
    return TAGGED + x.lang if x.lang else TYPED + (x.datatype or XSD + "string")


def key_equal(col: Column, t: T.DataType, prefix: str, iri: str) -> Column:
    """Whether prefix + key is the IRI: a comparison of the native key, which reaches the scan."""
    if not iri.startswith(prefix):
        return F.lit(False)
    tail = iri[len(prefix) :]
    if isinstance(t, T.StructType):
        parts = tail.rsplit("/", len(t.fields) - 1)
        out = F.lit(len(parts) == len(t.fields))
        for f, part in zip(t.fields, parts):
            out = out & key_equal(col[f.name], f.dataType, "", part)
        return out
    if isinstance(t, T.StringType):
        return col == tail
    if type_of(t) == "int":
        try:
            n = int(tail)
        except ValueError:
            return F.lit(False)
        return col == n if str(n) == tail else F.lit(False)
    return col.cast("string") == tail
