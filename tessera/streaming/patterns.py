"""Patterns over streams.

Patterns of one subject, filters, bindings and joins with tables at rest keep no state, so a subject map may
stand on a streaming DataFrame. Aggregations by a window of event time go through windowed(), with a watermark
that bounds the state kept for late rows.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..engine import Engine
from ..plans.sparql import Group, Select, parse
from ..plans.terms import UnsupportedQuery
from ..sources.graph import Graph, SubjectMap


def streaming_graph(graph: Graph, streams: dict[str, DataFrame]) -> Graph:
    """The graph with the frames of some prefixes replaced by streams of the same columns."""

    def over(m: SubjectMap) -> SubjectMap:
        frame = streams.get(m.prefix, m.frame)
        return replace(m, frame=frame, key=m.key if m.key in frame.columns else None)

    return replace(graph, maps=[over(m) for m in graph.maps])


def _stateless(q: Select) -> None:
    def look(g: Group) -> None:
        for kind, x in g.elements:
            if kind in ("minus", "select"):
                raise UnsupportedQuery(f"{kind} over a stream would keep all of it")
            if kind in ("optional", "group"):
                look(x)
            elif kind == "union":
                for y in x:
                    look(y)

    look(q.where)
    if q.distinct or q.group_by or q.order_by or q.limit is not None or q.offset:
        raise UnsupportedQuery("a query over a stream can't group, order, limit or drop repetitions; use windowed()")


def stream(engine: Engine, sparql: str) -> DataFrame:
    """The solutions as a streaming DataFrame, for any sink in append mode."""
    _stateless(parse(sparql, engine.prefixes))
    return engine.query(sparql)


def windowed(solutions: DataFrame, time: str, width: str, by: list[str], late: str = "10 minutes", **aggregates: Column) -> DataFrame:
    """Aggregates by tumbling windows of a time column; rows later than the watermark are dropped."""
    df = solutions.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    out = df.groupBy(F.window(time, width), *by).agg(*[c.alias(n) for n, c in aggregates.items()])
    return out.select(F.col("window.start").alias("start"), *by, *aggregates)
