"""The test tables as a graph under urn:t:."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .graph import PLACE, Graph, table_map

T = "urn:t:"
PREFIXES = {"t": T, "c": T + "class:", "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "rdfs": "http://www.w3.org/2000/01/rdf-schema#", "xsd": "http://www.w3.org/2001/XMLSchema#"}
#: Table: key, columns that refer to another table, and whose rows its subjects are.
TABLES = {
    "region": ("r_regionkey", {}, None),
    "nation": ("n_nationkey", {"n_regionkey": "region"}, None),
    "customer": ("c_custkey", {"c_nationkey": "nation"}, None),
    "supplier": ("s_suppkey", {"s_nationkey": "nation"}, None),
    "part": ("p_partkey", {}, None),
    "orders": ("o_orderkey", {"o_custkey": "customer"}, None),
    "lineitem": (PLACE, {"l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier"}, None),
    "events": ("event_id", {"user_id": "customer"}, None),
    "documents": ("doc_id", {}, None),
    "labels": ("doc_id", {}, "documents"),
    "pages": ("page_id", {}, None),
}


def graph(spark: SparkSession, sf_dir: str, strings: bool = False) -> Graph:
    """Subjects urn:t:<table>/<key>; labels describe the same subjects as documents."""
    maps = []
    for table, (key, links, of) in TABLES.items():
        frame = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        maps.append(table_map(frame, f"{T}{of or table}/", key, T, {c: f"{T}{to}/" for c, to in links.items()}, (f"{T}class:{table}",)))
    return Graph(maps, strings=strings)
