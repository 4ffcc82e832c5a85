"""Values of JSON and XML responses, by paths that a mapping gives.

A body is parsed once, with the schema of the mapping's output tree; all values of all outputs come out of one
nested expression and one explode. Each value carries its position: one number for each node of its path, so
that values which share an ancestor are aligned by the positions up to it, whatever is missing elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import documents
from ..sources.mapping import ROOT, Mapping, Node, Service

VALUE = "array<struct<node:string,pos:array<int>,value:string>>"


def wrapped(body: Column) -> Column:
    """A bare array gets a root of its own."""
    return F.when(F.ltrim(body).startswith("["), F.concat(F.lit(f'{{"{ROOT}": '), body, F.lit("}"))).otherwise(body)


def json_type(m: Mapping, n: Node) -> T.DataType:
    inner: T.DataType = T.StringType()
    if n.children:
        inner = T.StructType([T.StructField(m.nodes[c].label, json_type(m, m.nodes[c])) for c in n.children])
    return T.ArrayType(inner) if n.structure == "JSON_Array" else inner


def xml_type(m: Mapping, n: Node, root: bool = False) -> T.DataType:
    if n.attribute:
        return T.StringType()
    inner: T.DataType = T.StringType()
    if n.children:
        fields = [T.StructField(("_" if m.nodes[c].attribute else "") + m.nodes[c].label, xml_type(m, m.nodes[c])) for c in n.children]
        inner = T.StructType([*fields, T.StructField("_VALUE", T.StringType())] if n.data else fields)
    return inner if root else T.ArrayType(inner)


def _cell(n: Node, value: Column, pos: list[Column], null: bool, number: str) -> Column:
    row = F.struct(F.lit(n.uri).alias("node"), F.array(*[p.cast(number) for p in pos]).alias("pos"), (F.coalesce(value, F.lit("null")) if null else value).cast("string").alias("value"))
    return F.array(row) if null else F.when(value.isNotNull(), F.array(row)).otherwise(F.array().cast(_value(number)))


def _value(number: str) -> str:
    return VALUE.replace("pos:array<int>", f"pos:array<{number}>")


def _values(m: Mapping, n: Node, col: Column, pos: list[Column], xml: bool, many: bool, null: bool, at: Column | None = None, number: str = "int") -> Column:
    """All values at or below a node. at: the place of a node that is one of many, but stands alone here. number: the
    type of places."""
    empty = F.array().cast(_value(number))

    def inside(c: Column, pos: list[Column]) -> Column:
        parts = []
        if n.data:
            parts.append(_cell(n, c["_VALUE"] if xml and n.children else c.cast("string") if n.children else c, pos, null, number))
        for k in n.children:
            child = m.nodes[k]
            field = c["_" + child.label if xml and child.attribute else child.label]
            parts.append(_values(m, child, field, pos, xml, not child.attribute if xml else child.structure == "JSON_Array", null, number=number))
        return F.concat(*parts) if parts else empty

    if at is not None:
        return F.when(col.isNotNull(), inside(col, [*pos, at])).otherwise(empty)
    if not many:
        return F.when(col.isNotNull() | F.lit(null), inside(col, [*pos, F.lit(0)])).otherwise(empty)
    return F.coalesce(F.flatten(F.transform(col, lambda x, i: inside(x, [*pos, i + 1]))), empty)


def element_node(m: Mapping, service: Service) -> Node | None:
    """What a document of a service can be split into: the objects of its only JSON array, or the one child of an XML root
    that holds nothing else. None: it has to be read whole."""
    roots = [m.nodes[r] for r in service.roots]
    if len(roots) != 1:
        return None
    root = roots[0]
    if service.language != "xml":
        return root if root.structure == "JSON_Array" and root.children and not root.data else None
    if root.data or len(root.children) != 1 or m.nodes[root.children[0]].attribute:
        return None
    row = m.nodes[root.children[0]]
    below = lambda n: {m.nodes[c].label for c in n.children}.union(*[below(m.nodes[c]) for c in n.children])
    return row if row.label not in below(row) else None


def elements(spark, m: Mapping, service: Service, path: str) -> DataFrame:
    """Rows (ordinal, body) of the elements of a service's document, a folder or file that the executors can read."""
    n = element_node(m, service)
    if n is None:
        raise ValueError(f"the document of {service.uri} has no single array or row that it could be split into")
    found = documents.xml_elements(spark, path, n.label) if service.language == "xml" else documents.json_elements(spark, path, None if n.label == ROOT else n.label)
    return documents.ordinals(found).select("ordinal", "body")


def parsed_elements(m: Mapping, service: Service, rows: DataFrame) -> DataFrame:
    """Rows (call_id, ordinal, doc) of rows (call_id, ordinal, body) of elements."""
    n, xml = element_node(m, service), service.language == "xml"
    if xml:
        t = xml_type(m, n, True)
        doc = F.from_xml(F.col("body"), t if isinstance(t, T.StructType) else T.StructType([T.StructField("_VALUE", T.StringType())]))
    else:
        doc = F.from_json(F.col("body"), json_type(m, n).elementType)
    return rows.select("call_id", "ordinal", doc.alias("doc"))


def single_value(m: Mapping, service: Service, n: Node) -> Column | None:
    """The value of a node in rows of parsed_elements(), if an element has one at most; else None."""
    steps = [m.nodes[u] for u in n.path[1:]]
    if service.language == "xml" or n.children or not n.data or not steps or any(x.structure == "JSON_Array" for x in steps):
        return None
    out = F.col("doc")
    for x in steps:
        out = out[x.label]
    return out


def extracted_elements(m: Mapping, service: Service, rows: DataFrame) -> DataFrame:
    """As extracted(), of rows (call_id, ordinal, body) of elements: positions are as in the whole document."""
    n, xml = element_node(m, service), service.language == "xml"
    df = parsed_elements(m, service, rows)
    cells = _values(m, n, F.col("doc"), [F.lit(0)] if xml else [], xml, False, False, F.col("ordinal"), "bigint")
    return df.select("call_id", F.explode(cells).alias("x")).select("call_id", "x.node", "x.pos", "x.value")


def extracted(m: Mapping, service: Service, responses: DataFrame, null_text: bool = False) -> DataFrame:
    """Rows (call_id, node, pos, value) of responses (call_id, body). null_text: JSON null gives the text."""
    xml = service.language == "xml"
    roots = [m.nodes[r] for r in service.roots]
    if not roots:
        return responses.select("call_id", F.lit(None).cast("string").alias("node"), F.lit(None).cast("array<int>").alias("pos"), F.lit(None).cast("string").alias("value")).where("false")
    if xml:
        root = roots[0]
        t = xml_type(m, root, True)
        if not isinstance(t, T.StructType):
            t = T.StructType([T.StructField("_VALUE", T.StringType())])
        doc = F.from_xml(F.col("body"), t)
        cells = _values(m, root, F.col("doc"), [], True, False, null_text)
    else:
        t = T.StructType([T.StructField(r.label, json_type(m, r)) for r in roots])
        doc = F.from_json(wrapped(F.col("body")), t)
        cells = F.concat(*[_values(m, r, F.col("doc")[r.label], [], False, r.structure == "JSON_Array", null_text) for r in roots])
    df = responses.where("body IS NOT NULL").select("call_id", doc.alias("doc"))
    return df.select("call_id", F.explode(cells).alias("x")).select("call_id", "x.node", "x.pos", "x.value")


def json_values(df: DataFrame, body: str, path: str, key: str) -> DataFrame:
    """Values at a path like $.a[*].b of a column of JSON texts: (key, pos, value)."""
    steps = [s.removesuffix("[*]") for s in path.removeprefix("$.").split(".")]
    many = [s.endswith("[*]") for s in path.removeprefix("$.").split(".")]

    def type_of(k: int) -> T.DataType:
        t: T.DataType = T.StringType() if k == len(steps) - 1 else T.StructType([T.StructField(steps[k + 1], type_of(k + 1))])
        return T.ArrayType(t) if many[k] else t

    out = df.select(F.col(key), F.from_json(wrapped(F.col(body)), T.StructType([T.StructField(steps[0], type_of(0))])).alias("x"), F.array().cast("array<int>").alias("pos"))
    for s, array in zip(steps, many):
        if array:
            out = out.select(key, "pos", F.posexplode(F.col("x")[s]).alias("i", "y")).select(key, F.col("y").alias("x"), F.concat("pos", F.array(F.col("i") + 1)).alias("pos"))
        else:
            out = out.select(key, F.col("x")[s].alias("x"), "pos")
    return out.where(F.col("x").isNotNull()).select(key, "pos", F.col("x").cast("string").alias("value"))


def xml_values(df: DataFrame, body: str, xpath: str, key: str) -> DataFrame:
    """Texts or attributes at a path like /a/b/@c: (key, pos, value)."""
    path = xpath if "/@" in xpath else xpath + "/text()"
    return df.select(F.col(key), F.posexplode(F.xpath(F.col(body), F.lit(path))).alias("pos", "value")).select(key, (F.col("pos") + 1).alias("pos"), "value")
