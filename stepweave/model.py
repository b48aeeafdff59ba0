"""The data model: typed nodes and edges of an application graph."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Kinds, sources, the schema's version, and the names of columns.
NODE_KINDS = ("route", "entity", "page", "action", "permission")
EDGE_KINDS = ("uses_route", "touches_entity", "on_page", "requires_permission", "relates_to", "field_relation")
NODE_SOURCES = ("scan", "agent", "manual")
SCHEMA_VERSION = 3
NODE_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("kind", T.StringType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("label", T.StringType(), False),
        T.StructField("properties", T.StringType(), False),
        T.StructField("source", T.StringType(), False),
        T.StructField("source_file", T.StringType(), True),
        T.StructField("created_at", T.LongType(), False),
        T.StructField("updated_at", T.LongType(), False),
        T.StructField("scan_hash", T.StringType(), True),
    ]
)
EDGE_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("src_id", T.StringType(), False),
        T.StructField("dst_id", T.StringType(), False),
        T.StructField("kind", T.StringType(), False),
        T.StructField("properties", T.StringType(), False),
        T.StructField("source_scanner", T.StringType(), True),
        T.StructField("created_at", T.LongType(), False),
    ]
)
# End of fixed values.


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame
