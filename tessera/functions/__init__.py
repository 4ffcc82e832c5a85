"""SPARQL functions as columns."""
