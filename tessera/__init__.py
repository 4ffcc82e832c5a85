"""Virtual knowledge-graph analytics on PySpark."""
