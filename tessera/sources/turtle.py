"""Turtle: a parser of the common part of the language, and writers of Turtle and N-Triples."""

from __future__ import annotations

import re

from ..plans.sparql import Parser
from ..plans.terms import RDF_TYPE, XSD, BNode, Iri, Lit, UnsupportedQuery, Var

Triple = tuple


class MalformedTurtle(ValueError):
    pass


class _Turtle(Parser):
    def document(self) -> list[Triple]:
        out: list[Triple] = []
        while self.kind() != "end":
            text = self.toks[self.at][1]
            directive = text.lower().lstrip("@")
            if directive in ("prefix", "base") and self.kind() in ("lang", "word"):
                self.at += 1
                if directive == "prefix":
                    name = self.next()
                    self.prefixes[name[:-1]] = self._iri_text()
                else:
                    self.base = self._iri_text()
                if text.startswith("@"):
                    self.need(".")
                continue
            out += [(_plain(t.s), _plain(t.p), _plain(t.o)) for t in self.triples()]
            self.need(".")
        return out


def _plain(t):
    if isinstance(t, Var):
        if not t.name.startswith("."):
            raise MalformedTurtle(f"a variable in Turtle: ?{t.name}")
        return BNode(t.name.strip("."))
    if not isinstance(t, (Iri, Lit, BNode)):
        raise MalformedTurtle("a property path in Turtle")
    return t


def parse(text: str) -> tuple[list[Triple], dict[str, str]]:
    """The distinct triples in the order of the text, and the prefixes."""
    try:
        p = _Turtle(text)
        triples = p.document()
    except UnsupportedQuery as e:
        raise MalformedTurtle(str(e)) from e
    return list(dict.fromkeys(triples)), p.prefixes


def quoted(text: str) -> str:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = text.replace(a, b)
    return f'"{text}"'


def term(t, prefixes: dict[str, str] | None = None) -> str:
    if isinstance(t, Iri):
        for name, ns in sorted((prefixes or {}).items(), key=lambda x: -len(x[1])):
            if ns and t.value.startswith(ns) and re.fullmatch(r"[A-Za-z0-9_][A-Za-z0-9_-]*", t.value[len(ns) :]):
                return f"{name}:{t.value[len(ns) :]}"
        return f"<{t.value}>"
    if isinstance(t, BNode):
        return f"_:{t.value}"
    if t.lang:
        return f"{quoted(t.value)}@{t.lang}"
    if t.datatype in (XSD + "boolean", XSD + "integer") and prefixes is not None and re.fullmatch(r"true|false|[+-]?\d+", t.value):
        return t.value
    return quoted(t.value) + (f"^^{term(Iri(t.datatype), prefixes)}" if t.datatype else "")


def write(triples, prefixes: dict[str, str]) -> str:
    """Turtle, grouped by subject, sorted."""
    by: dict = {}
    for s, p, o in triples:
        by.setdefault(s, {}).setdefault(p, []).append(o)
    lines = [f"@prefix {n}: <{ns}> ." for n, ns in sorted(prefixes.items())] + [""]
    for s in sorted(by, key=lambda x: term(x, {})):
        parts = []
        for p in sorted(by[s], key=lambda x: (x.value != RDF_TYPE, x.value)):
            name = "a" if p.value == RDF_TYPE else term(p, prefixes)
            parts.append(f"    {name} " + " , ".join(sorted({term(o, prefixes) for o in by[s][p]})))
        lines.append(f"{term(s, prefixes)}\n" + " ;\n".join(parts) + " .\n")
    return "\n".join(lines)


#: Escapes of N-Triples beside the code points, \\ being undone before all others.
_ESCAPES = (('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f"))
#: What an IRI may not hold.
_NOT_IN_IRIS = '<>"{}|^`\\ \n\r\t'
COLUMNS = ("s", "p", "o", "o_kind", "o_datatype", "o_lang")


def _code(x: str) -> str:
    return f"\\u{ord(x):04X}"


def _replaced(c, pairs):
    from pyspark.sql import functions as F

    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _escaped(c, pairs):
    """With what is to be replaced looked for at once, as few texts have any."""
    from pyspark.sql import functions as F

    return F.when(c.rlike("[" + "".join(re.escape(a) for a, _ in pairs) + "]"), _replaced(c, pairs)).otherwise(c)


def ntriples_column(columns=COLUMNS):
    """A row (s, p, o, o_kind), with o_datatype and o_lang if it has these, as a line of N-Triples."""
    from pyspark.sql import functions as F

    def iri(c):
        # the backslash first, as all others become one with digits
        return F.concat(F.lit("<"), _escaped(c, [(x, _code(x)) for x in sorted(_NOT_IN_IRIS, key=lambda x: x != "\\")]), F.lit(">"))

    def node(c):
        return F.when(F.col(c).startswith("_:"), F.col(c)).otherwise(iri(F.col(c)))

    text = F.concat(F.lit('"'), _escaped(F.col("o"), [("\\", "\\\\"), *_ESCAPES]), F.lit('"'))
    type_, lang = (F.col(c) if c in columns else F.lit(None).cast("string") for c in ("o_datatype", "o_lang"))
    tail = F.when(lang.isNotNull(), F.concat(F.lit("@"), lang)).when(type_ != XSD + "string", F.concat(F.lit("^^"), iri(type_))).otherwise("")
    return F.concat(node("s"), F.lit(" "), node("p"), F.lit(" "), F.when(F.col("o_kind") == "literal", F.concat(text, tail)).otherwise(node("o")), F.lit(" ."))


def write_ntriples(triples, path: str) -> None:
    triples.select(ntriples_column(triples.columns).alias("value")).write.mode("overwrite").text(path)


def unescaped(c):
    """A text without its escapes, undone in one pass: after a cut at escaped backslashes no other escape is ambiguous."""
    from pyspark.sql import functions as F

    def points(x):
        """Of a piece that begins with an escape of a code point: that, and what follows."""
        one = lambda digits, code: F.concat(F.decode(F.unhex(F.substr(x, F.lit(3), F.lit(digits))), code), F.substr(x, F.lit(3 + digits)))
        return F.when(x.startswith("\\u"), one(4, "UTF-16BE")).when(x.startswith("\\P"), one(8, "UTF-16BE")).when(x.startswith("\\U"), one(8, "UTF-32")).otherwise(x)

    def rare(x):
        x = F.regexp_replace(x, r"\\u([dD][89abAB][0-9a-fA-F]{2})\\u([dD][c-fC-F][0-9a-fA-F]{2})", r"\\P$1$2")  # a pair that is one character
        return F.array_join(F.transform(F.split(x, r"(?=\\[uUP])", -1), points), "")

    def part(x):
        letters = _replaced(x, [(b, a) for a, b in _ESCAPES] + [("\\'", "'")])
        # of code points first those that the writer escapes in IRIs
        usual = F.when(x.contains("\\u00"), _replaced(letters, [(_code(y), y) for y in _NOT_IN_IRIS if y != "\\"])).otherwise(letters)
        return F.when(usual.contains("\\"), rare(usual)).otherwise(usual)

    cut = F.array_join(F.transform(F.split(c, r"\\(?:\\|u005[Cc]|U0000005[Cc])", -1), part), "\\")
    return F.when(~c.contains("\\"), c).when(~c.contains("\\\\") & ~c.contains("005C") & ~c.contains("005c"), part(c)).otherwise(cut)


_NODE = r"<[^>\n]*+>|_:\S*[^\s.]"
#: Subject and predicate, which no other cut of a line gives, and what follows. A label has no "<", with which the predicate begins.
#: Loops are possessive, as Java would otherwise need stack for each character or escape.
_HEAD = r"^\s*+(?:(<[^>\n]*+)>|(_:[^\s<]*[^\s<.]))\s*+<([^>\n]*+)>\s*+(?s:(.*))$"
#: What follows: object that is a node, body of a literal, its tag, its datatype.
_REST = rf'^\s*+(?:({_NODE})|"((?:[^"\\\n]++|\\.)*+)"(?:@([A-Za-z]+(?:-[A-Za-z0-9]+)*)|\^\^<([^>\n]*+)>)?)\s*+\.\s*+(?:#.*)?$(?s:.*)'
_ESCAPE = r"""\\(?:[tbnrf"'\\]|u[0-9A-Fa-f]{4}|U(?:000[0-9A-Fa-f]|0010)[0-9A-Fa-f]{4})"""


def _matched(lines):
    """Of lines of N-Triples but blank ones and comments the cells of a statement, and x, null where there is none."""
    from pyspark.sql import functions as F

    def strays(c):
        return c.contains("\\") & F.regexp_replace(c, _ESCAPE, "").contains("\\")

    value = F.col("value")
    df = lines.select("value").where(value.startswith("<") | ~value.rlike(r"^\s*(#.*)?$"))
    line = F.when(value.contains("\n"), F.regexp_replace("value", r"^\s+|\s+$", "")).otherwise(value)
    # parts stand between separators that they lack, the first one in front, where neither a line nor what follows has it
    usual = value.startswith("<") & ~value.contains("\n") & (F.instr(value, ">") == F.instr(value, "> <"))
    head = F.when(usual, F.split(F.concat(F.lit(">"), value), ">", 4)).otherwise(F.split(F.regexp_replace(line, _HEAD, "\n$1$2\n <$3\n$4"), "\n", 4))
    # exploded, so that filters stand above and a line is cut once, not once for each mention; those on subjects and
    # predicates stand below the second explode, so that only the objects are matched that are asked for
    df = df.select("value", F.explode(F.array(head)).alias("h"))
    s, p, rest = (F.get("h", F.lit(k)) for k in (1, 2, 3))
    df = df.select("value", "h", F.when((F.get("h", F.lit(0)) == "") & rest.isNotNull(), F.regexp_replace(rest, _REST, "\n$1\n$3\n$4\n$2")).alias("parts"))
    good = F.col("parts").startswith("\n") & ~strays(s) & ~strays(p) & ~strays(F.col("parts"))
    df = df.select("value", "h", F.explode(F.array(F.when(good, F.split("parts", "\n", -1)))).alias("x"))
    node, lang, type_, body = (F.col("x")[k] for k in range(1, 5))
    literal = node == ""
    iri = lambda c, end: F.when(c.startswith("_:"), c).otherwise(unescaped(F.substr(c, F.lit(2), F.length(c) - end) if end else F.substr(c, F.lit(2))))
    kind = F.when(literal, "literal").when(node.startswith("_:"), "bnode").otherwise("iri")
    datatype = F.when(literal & (lang == ""), F.when(type_ != "", unescaped(type_)).otherwise(XSD + "string"))
    cells = (iri(s, 0), unescaped(F.substr(p, F.lit(3))), F.when(literal, unescaped(body)).otherwise(iri(node, 2)), kind, datatype, F.when(literal & (lang != ""), lang))
    return df, dict(zip(COLUMNS, cells))


def parsed_ntriples(lines):
    """Rows (value) of N-Triples as rows (s, p, o, o_kind, o_datatype, o_lang, bad): bad is the line where it is no statement,
    and null where it is one. Blank lines and comments give no rows."""
    from pyspark.sql import functions as F

    df, cells = _matched(lines)
    return df.select(*[F.when(F.col("x").isNotNull(), c).alias(n) for n, c in cells.items()], F.when(F.col("x").isNull(), F.col("value")).alias("bad"))


def statements(lines):
    """The statements alone: rows (s, p, o, o_kind, o_datatype, o_lang)."""
    df, cells = _matched(lines)
    return df.where("x IS NOT NULL").select(*[c.alias(n) for n, c in cells.items()])


def read_ntriples(spark, path: str):
    """Rows (s, p, o, o_kind, o_datatype, o_lang) of a dump in N-Triples."""
    return statements(spark.read.text(path))


def bad_ntriples(spark, path: str):
    """The lines of a dump that are no statements: rows (bad)."""
    return parsed_ntriples(spark.read.text(path)).where("bad IS NOT NULL").select("bad")
