"""Relations of variable bindings on DataFrames, and their joins with unbound values."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .terms import XSD, UnsupportedQuery


@dataclass(frozen=True)
class Kind:
    """kind: iri, lit, or any (a string whose tag stands in a column beside it, see tag_of). prefix: of an iri whose
    column holds the native key behind it, a struct if several columns are the key; None for whole IRIs.
    nameless: rows without any key, which can be counted but neither joined, grouped nor shown.
    minted: of keys that are digests, the class or row entity that they are digests of: those of two are never equal."""

    kind: str = "lit"
    prefix: str | None = None
    nameless: bool = False
    minted: str | None = None


NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)

#: A tag tells what a term's text is: iri, bnode, "literal" (text of a source without types), or one of these before the
#: datatype's IRI or the language.
TYPED, TAGGED = "literal^", "literal@"
STRING_TAG = TYPED + XSD + "string"
#: Datatypes whose values are numbers, those of whole ones first.
WHOLE = ("integer", "long", "int", "short", "byte", "nonNegativeInteger", "positiveInteger", "nonPositiveInteger", "negativeInteger", "unsignedLong", "unsignedInt", "unsignedShort", "unsignedByte")
NUMBERS = (*WHOLE, "decimal", "double", "float")


def datatype(t: T.DataType) -> str:
    """The datatype of a column's literals."""
    if isinstance(t, (T.DoubleType, T.FloatType, T.DecimalType)):
        return XSD + "double"
    if isinstance(t, NUMERIC):
        return XSD + "integer"
    if isinstance(t, T.BooleanType):
        return XSD + "boolean"
    return XSD + ("dateTime" if isinstance(t, (T.TimestampType, T.DateType, T.TimestampNTZType)) else "string")


def tag_of(kind: Column, datatype: Column | None = None, lang: Column | None = None) -> Column:
    """The tag of a stored term."""
    none = F.lit(None).cast("string")
    more = F.coalesce(F.concat(F.lit("@"), lang if lang is not None else none), F.concat(F.lit("^"), datatype if datatype is not None else none), F.lit(""))
    return F.when(kind == "literal", F.concat(F.lit("literal"), more)).otherwise(kind)


def is_literal(tag: Column) -> Column:
    return tag.startswith("literal")


def term_class(tag: Column) -> Column:
    """What two terms of one text have in common where they are one: both resources, numbers, plain strings, or literals of the
    same datatype or language."""
    number = tag.isin(*[TYPED + XSD + x for x in NUMBERS])
    return F.when(~is_literal(tag), "r").when(number, "n").when(tag.isin("literal", STRING_TAG), "s").otherwise(F.lower(tag))


def key_text(col: Column, t: T.DataType) -> Column:
    """What stands behind the prefix: the key, or its parts with a slash between them."""
    if isinstance(t, T.StructType):
        return F.when(col.isNotNull(), F.concat_ws("/", *[col[f.name].cast("string") for f in t.fields]))
    return col.cast("string")


def _named(k: Kind) -> None:
    if k.nameless:
        raise UnsupportedQuery(f"rows of {k.prefix} have no key: their patterns have to be one group of one subject, whose IRI is not used elsewhere")


def name(var: str) -> str:
    """Column of a variable; Spark's names ignore case, those of variables don't."""
    return "v_" + re.sub(r"[A-Z0.]", lambda m: "00" if m[0] == "0" else "0d" if m[0] == "." else f"0{m[0].lower()}", var)


def beside(var: str) -> str:
    return "k" + name(var)


@dataclass(frozen=True)
class Rel:
    """df None: the one solution without variables. maybe: variables that may be unbound (null)."""

    df: DataFrame | None
    kinds: dict[str, Kind] = field(default_factory=dict)
    maybe: frozenset[str] = frozenset()

    def col(self, var: str) -> Column:
        return F.col(name(var))

    def type(self, var: str) -> T.DataType:
        return self.df.schema[name(var)].dataType

    def text(self, var: str) -> Column:
        """The term as a string."""
        k = self.kinds[var]
        _named(k)
        v = key_text(self.col(var), self.type(var))
        return F.concat(F.lit(k.prefix), v) if k.prefix is not None else v

    def kind_col(self, var: str) -> Column:
        """The tag of the term."""
        k = self.kinds[var].kind
        return F.col(beside(var)) if k == "any" else F.when(self.col(var).isNotNull(), F.lit("iri" if k == "iri" else TYPED + datatype(self.type(var))))

    def columns(self) -> list[str]:
        return [c for v, k in self.kinds.items() for c in ([name(v), beside(v)] if k.kind == "any" else [name(v)])]

    def frame(self, spark: SparkSession) -> DataFrame:
        return self.df if self.df is not None else spark.range(1).select(F.lit(True).alias("unit"))

    def keep(self, variables: list[str]) -> Rel:
        kinds = {v: self.kinds[v] for v in variables if v in self.kinds}
        out = replace(self, kinds=kinds, maybe=self.maybe & set(kinds))
        return replace(out, df=self.df.select(*out.columns())) if self.df is not None else out

    def where(self, condition: Column) -> Rel:
        return replace(self, df=self.df.where(condition))

    def none(self) -> Rel:
        return self.where(F.lit(False))

    def with_text(self, var: str) -> Rel:
        """The variable as a whole string, with its tag beside it if its kind isn't fixed."""
        k = self.kinds[var]
        if k.kind == "any" or k == Kind("iri") or k.kind == "lit" and isinstance(self.type(var), T.StringType):
            return self
        df = self.df.withColumn(name(var), self.text(var))
        return replace(self, df=df, kinds=self.kinds | {var: Kind("iri") if k.kind == "iri" else Kind("lit")})

    def with_any(self, var: str) -> Rel:
        if self.kinds[var].kind == "any":
            return self
        df = self.df.withColumn(beside(var), self.kind_col(var)).withColumn(name(var), self.text(var))
        return replace(self, df=df, kinds=self.kinds | {var: Kind("any")})


def apart(a: Kind, b: Kind) -> bool:
    """Whether no IRI can have both kinds: neither prefix continues the other, or one is a literal."""
    if "any" in (a.kind, b.kind):
        return False
    if a.kind != b.kind:
        return True
    if a.kind == "lit" or a.prefix is None or b.prefix is None:
        return False
    if a.prefix == b.prefix and a.minted and b.minted:
        return a.minted != b.minted
    return not (a.prefix.startswith(b.prefix) or b.prefix.startswith(a.prefix))


def _comparable(s: T.DataType, t: T.DataType) -> bool:
    """Columns that are compared as they are. A struct as a literal only tells rows apart, see Compiler.numbered()."""
    return s == t or isinstance(s, NUMERIC) and isinstance(t, NUMERIC) or isinstance(s, T.StructType) and isinstance(t, T.StructType)


def aligned(a: Rel, b: Rel, var: str) -> tuple[Rel, Rel]:
    """Both relations with the variable in one form, so that equal terms are equal values."""
    x, y = a.kinds[var], b.kinds[var]
    _named(x)
    _named(y)
    if x == y and x.kind == "iri":
        return a, b  # the same prefix: native keys
    if x == y == Kind("lit"):
        s, t = a.type(var), b.type(var)
        if _comparable(s, t):
            return a, b
    if {x.kind, y.kind} == {"any", "lit"}:
        return a.with_any(var), b.with_any(var)
    return a.with_text(var), b.with_text(var)


def unioned(a: Rel, b: Rel) -> Rel:
    """Both bags of solutions; variables that one lacks are unbound there."""
    for v in [*a.kinds]:
        if v not in b.kinds:
            continue
        x, y = a.kinds[v], b.kinds[v]
        if x == y and x.kind != "lit":
            continue
        if x == y:
            s, t = a.type(v), b.type(v)
            if _comparable(s, t):
                continue
            a, b = a.with_any(v), b.with_any(v)
        elif x.kind == y.kind == "iri":
            a, b = a.with_text(v), b.with_text(v)
        else:
            a, b = a.with_any(v), b.with_any(v)
    only = (set(a.kinds) | set(b.kinds)) - (set(a.kinds) & set(b.kinds))
    if a.df is None or b.df is None:
        spark = (a.df if a.df is not None else b.df).sparkSession
        a, b = replace(a, df=a.frame(spark)), replace(b, df=b.frame(spark))
    return Rel(a.df.unionByName(b.df, allowMissingColumns=True), a.kinds | b.kinds, a.maybe | b.maybe | only)


def _shared(a: Rel, b: Rel) -> list[str]:
    return [v for v in a.kinds if v in b.kinds]


def _renamed(b: Rel, variables: list[str]) -> DataFrame:
    df = b.df
    for v in variables:
        df = df.withColumnRenamed(name(v), "r" + name(v))
        if b.kinds[v].kind == "any":
            df = df.withColumnRenamed(beside(v), "r" + beside(v))
    return df


def joined(a: Rel, b: Rel) -> Rel:
    """Compatible pairs of solutions."""
    if a.df is None:
        return b
    if b.df is None:
        return a
    shared = _shared(a, b)
    for v in shared:
        if apart(a.kinds[v], b.kinds[v]) and v not in a.maybe | b.maybe:
            out = Rel(a.df.crossJoin(_renamed(b, shared)), b.kinds | a.kinds, (a.maybe | b.maybe)).none()
            return out.keep([*a.kinds, *[v for v in b.kinds if v not in a.kinds]])
        a, b = aligned(a, b, v)
    loose = [v for v in shared if v in a.maybe or v in b.maybe]
    if loose:
        return _split(a, b, loose[0])
    kinds = {**a.kinds}
    for v, k in b.kinds.items():
        if v not in kinds or kinds[v].kind == "any":
            kinds[v] = k
    left, right, on = a.df, b.df, [name(v) for v in shared]
    for v in shared:
        mine, other = a.kinds[v].kind == "any", b.kinds[v].kind == "any"
        if mine and other:  # a literal is no IRI of the same text, and a string no number
            left, right = (x.withColumn("class" + name(v), term_class(F.col(beside(v)))) for x in (left, right))
            right = right.drop(beside(v))
            on.append("class" + name(v))
        elif mine:  # the other one is an IRI
            left = left.where(~is_literal(F.col(beside(v)))).drop(beside(v))
        elif other:
            right = right.where(~is_literal(F.col(beside(v)))).drop(beside(v))
    df = left.join(right, on) if shared else left.crossJoin(right)
    return replace(Rel(df, kinds, a.maybe | b.maybe)).keep(list(kinds))


def _split(a: Rel, b: Rel, v: str) -> Rel:
    """A shared variable that may be unbound: bound rows join on it, unbound ones without it. An OR in the
    join condition would leave nothing but a product of all rows."""
    sides = []
    for r in (a, b):
        if v in r.maybe:
            bound = replace(r.where(r.col(v).isNotNull()), maybe=r.maybe - {v})
            rest = r.where(r.col(v).isNull())
            sides.append((bound, rest.keep([x for x in r.kinds if x != v])))
        else:
            sides.append((r, None))
    (a1, a2), (b1, b2) = sides
    out = joined(a1, b1)
    for x, y in ((a1, b2), (a2, b1), (a2, b2)):
        if x is not None and y is not None:
            out = unioned(out, joined(x, y))
    return out


def _agree(a: Rel, b: Rel, v: str) -> Column:
    """Whether a bound variable has one term on both sides, that of the right being renamed."""
    same = F.col(name(v)) == F.col("r" + name(v))
    x, y = a.kinds[v].kind, b.kinds[v].kind
    if "any" not in (x, y):
        return same
    left, right = (term_class(F.col(c)) if k == "any" else F.lit("r") for c, k in ((beside(v), x), ("r" + beside(v), y)))
    return same & (left == right)


def left_joined(a: Rel, b: Rel, condition=None) -> Rel:
    """OPTIONAL: each solution of a with those of b that agree and meet condition(row), or alone."""
    if b.df is None:
        return a
    if a.df is None:
        a = replace(a, df=b.df.sparkSession.range(1).select(F.lit(True).alias("unit")))
    shared = _shared(a, b)
    if any(v in a.maybe | b.maybe for v in shared):
        # bound and unbound values are joined apart; an OR in the condition would leave only a product
        both = joined(a, b)
        if condition is not None:
            both = both.where(F.coalesce(condition(both), F.lit(False)))
        return unioned(both, semi_joined(a, b, False, condition))
    dead = False
    for v in shared:
        dead = dead or apart(a.kinds[v], b.kinds[v])
        a, b = aligned(a, b, v)
    right = _renamed(b, shared)
    on = F.lit(not dead)
    for v in shared:
        on = on & _agree(a, b, v)
    kinds = {**b.kinds, **a.kinds}
    both = Rel(None, kinds, a.maybe | b.maybe)
    if condition is not None:
        scope = Rel(a.df.join(right, F.lit(True)), kinds, both.maybe)  # only its schema is used
        on = on & F.coalesce(condition(scope), F.lit(False))
    df = a.df.join(right, on, "left")
    return Rel(df.select(*both.columns()), kinds, a.maybe | b.maybe | (set(b.kinds) - set(a.kinds)))


def semi_joined(a: Rel, b: Rel, keep: bool, condition=None, minus: bool = False, outer: frozenset[str] = frozenset()) -> Rel:
    """Solutions of a that agree with one of b (keep), or with none. minus: only agreement on a bound
    variable counts, and not on one that stands for a constant of an outer row."""
    spark = (a.df if a.df is not None else b.df).sparkSession if (a.df is not None or b.df is not None) else None
    shared = _shared(a, b)
    if minus and set(shared) <= outer:
        return a
    if spark is None:
        return a if keep else replace(a, df=SparkSession.getActiveSession().range(0).select(F.lit(True).alias("unit")))
    a, b = replace(a, df=a.frame(spark)), replace(b, df=b.frame(spark))
    loose = [v for v in shared if v in a.maybe or v in b.maybe]
    if loose:
        return _semi_split(a, b, keep, condition, minus, loose[0], outer)
    dead = False
    for v in shared:
        dead = dead or apart(a.kinds[v], b.kinds[v])
        a, b = aligned(a, b, v)
    if dead:
        return a.none() if keep else a
    if condition is None:
        b = b.keep(shared) if shared else Rel(b.df.select(F.lit(True).alias("some")).limit(1))
    right = _renamed(b, shared)
    on = F.lit(True)
    for v in shared:
        on = on & _agree(a, b, v)
    if condition is not None:
        scope = Rel(a.df.join(right, F.lit(True)), {**b.kinds, **a.kinds}, a.maybe | b.maybe)
        on = on & F.coalesce(condition(scope), F.lit(False))
    return replace(a, df=a.df.join(right, on, "left_semi" if keep else "left_anti"))


def _semi_split(a: Rel, b: Rel, keep: bool, condition, minus: bool, v: str, outer: frozenset[str]) -> Rel:
    """As _split: bound rows look for equal ones and for unbound ones, unbound rows for any."""

    def apart_by(r: Rel) -> tuple[Rel, Rel | None]:
        if v not in r.maybe:
            return r, None
        rest = r.where(r.col(v).isNull())
        return replace(r.where(r.col(v).isNotNull()), maybe=r.maybe - {v}), rest.keep([x for x in r.kinds if x != v])

    (a1, a2), (b1, b2) = apart_by(a), apart_by(b)
    # once a variable is bound on both sides, agreement on it is agreement
    with_equal = semi_joined(a1, b1, keep, condition, minus and v in outer, outer)
    if b2 is None:
        out = with_equal
    elif keep:
        out = unioned(with_equal, semi_joined(semi_joined(a1, b1, False, condition, minus and v in outer, outer), b2, True, condition, minus, outer))
    else:
        out = semi_joined(with_equal, b2, False, condition, minus, outer)
    if a2 is None:
        return replace(out, maybe=a.maybe)
    alone = semi_joined(a2, b, keep, condition, minus, outer)
    return replace(unioned(out, alone).keep(list(a.kinds)), maybe=a.maybe)
