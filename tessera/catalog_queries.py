"""Registered queries of the graph engine and their SQL twins."""

from . import service_queries, sparql_queries
from .sparql_queries import flagship

QUERIES: dict = {**sparql_queries.QUERIES, **service_queries.QUERIES}
ORACLES: dict = {**sparql_queries.ORACLES, **service_queries.ORACLES}

__all__ = ["ORACLES", "QUERIES", "flagship"]
