"""Graphs to query: tables as virtual triples, and plain triples.

A subject map describes the triples of a table: each row is a subject with the IRI prefix + key, its
columns are literals or links to subjects of another prefix. The columns stay native; an IRI becomes a
string only where a query needs one.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Column:
    """A predicate's column. link: prefix of the IRIs it holds the keys of; None: a literal. minted: see Kind."""

    name: str
    link: str | None = None
    nullable: bool = False
    minted: str | None = None


@dataclass(frozen=True)
class SubjectMap:
    """key: the unique column that makes the IRI, a struct if several do; None: rows are subjects that can be
    counted, but not named, joined or grouped. minted: what its IRIs were minted for (see Kind); then no other map and no triple
    has its subjects, and its literals are text without a type."""

    frame: DataFrame
    prefix: str
    key: str | None
    columns: dict[str, Column]  # by predicate IRI
    classes: tuple[str, ...] = ()
    minted: str | None = None


@dataclass
class Graph:
    """Subject maps, and triples (s, p, o, o_kind) with o_kind iri, literal or bnode; a set, so distinct. Triples may have the
    columns o_datatype and o_lang, null where a literal's text has no type, which is then compared as what it looks like.
    said: the only predicates that the triples can have, where these are known."""

    maps: list[SubjectMap] = field(default_factory=list)
    triples: DataFrame | None = None
    strings: bool = False  # literals of tables as strings, as in a store of plain text
    said: frozenset[str] | None = None


#: As a key: the place of a row in its file.
PLACE = ("_metadata.file_path", "_metadata.row_index")
#: Column of a key of several parts.
WHOLE_KEY = "key of the row"


def table_map(frame: DataFrame, prefix: str, key: str | tuple[str, ...] | None, vocabulary: str, links: dict[str, str] | None = None, classes: tuple[str, ...] = (), nullable: tuple[str, ...] = ()) -> SubjectMap:
    """Each column c as predicate vocabulary + c; links: column -> prefix of what it refers to. key: the column
    or columns that are unique together; PLACE for Parquet files where none are, which every scan, whatever
    its filters, gives a row alike."""
    links = links or {}
    columns = {vocabulary + c: Column(c, links.get(c), c in nullable) for c in frame.columns}
    if isinstance(key, tuple):
        frame = frame.select("*", F.struct(*[F.col(k).alias(k.removeprefix("_metadata.")) for k in key]).alias(WHOLE_KEY))
        key = WHOLE_KEY
    return SubjectMap(frame, prefix, key, columns, classes)


def bound(key, t) -> object:
    """Whether a key has all its parts."""
    if not isinstance(t, T.StructType):
        return key.isNotNull()
    out = F.lit(True)
    for f in t.fields:
        out = out & key[f.name].isNotNull()
    return out


def shared_predicates(maps: list[SubjectMap]) -> dict[str, frozenset[str]]:
    """Of each prefix the predicates that several maps give, which may so have one triple twice."""
    from ..plans.terms import RDF_TYPE

    given: dict[str, list[str]] = {}
    for m in maps:
        given.setdefault(m.prefix, []).extend([*m.columns, *([RDF_TYPE] if m.classes and RDF_TYPE not in m.columns else [])])
    return {prefix: frozenset(p for p in ps if ps.count(p) > 1) for prefix, ps in given.items()}


def as_triples(m: SubjectMap, native: bool = False, s=None, o=None, without: frozenset[str] = frozenset(), only: frozenset[str] | None = None, strings: bool = False) -> DataFrame:
    """The map's triples as rows (s, p, o, o_kind, o_datatype), by one scan. native: s is the key. s, o: constants that are
    compared with keys and columns, so that they reach the scan. without: predicates that are left out; only: those that
    are not. strings: literals as strings."""
    from ..functions.expressions import key_equal, literal_equal
    from ..plans.relation import datatype, key_text
    from ..plans.terms import RDF_TYPE, XSD, Iri, Lit, UnsupportedQuery

    def cell(p: str, o, kind: str, type_: str | None):
        return F.struct(F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"), F.lit(type_).cast("string").alias("o_datatype"))

    if only is not None:
        without = without | frozenset([*m.columns, RDF_TYPE]) - only

    if m.key is None:
        raise UnsupportedQuery(f"a variable predicate over rows of {m.prefix}, which have no key")
    key, t = F.col(f"`{m.key}`"), m.frame.schema[m.key].dataType
    df = m.frame.where(bound(key, t))
    if isinstance(s, Iri):
        df = df.where(key_equal(key, t, m.prefix, s.value))
    cells, tests = [], []
    for c in m.classes if RDF_TYPE not in without else ():
        if o is None or o == Iri(c):
            cells.append(cell(RDF_TYPE, F.lit(c), "iri", None))
            tests.append(F.lit(True))
    for p, c in m.columns.items():
        col, kind = F.col(f"`{c.name}`"), m.frame.schema[c.name].dataType
        if p in without or isinstance(o, Iri) and (c.link is None or not o.value.startswith(c.link)) or isinstance(o, Lit) and c.link is not None:
            continue
        v = col.cast("string")
        cells.append(cell(p, F.concat(F.lit(c.link), v), "iri", None) if c.link else cell(p, v, "literal", None if m.minted else XSD + "string" if strings else datatype(kind)))
        # how text without a type is compared is told by who asks
        tests.append(col.isNotNull() if o is None or m.minted and c.link is None else key_equal(col, kind, c.link, o.value) if c.link else literal_equal(v if strings else col, None if strings else kind, o))
    if not cells:
        df, cells = df.where(F.lit(False)), [cell("", F.lit(""), "", None)]
    elif o is not None:
        some = tests[0]
        for x in tests[1:]:
            some = some | x
        df = df.where(some)
    subject = key if native else F.concat(F.lit(m.prefix), key_text(key, t))
    df = df.select(subject.alias("s"), F.explode(F.array(*cells)).alias("x"))
    return df.select("s", "x.p", "x.o", "x.o_kind", "x.o_datatype").where("o IS NOT NULL")
