"""Application-graph analytics on PySpark."""
