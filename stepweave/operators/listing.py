"""Point lookups, listings and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepweave.model import NODE_KINDS

NODE_LIMIT, COUNT_CAP = 1000, 100_000


def get_node(nodes: DataFrame, node_id: str) -> DataFrame:
    return nodes.where(F.col("id") == node_id)


def nodes_by_kind(nodes: DataFrame, kind: str, limit: int = NODE_LIMIT, offset: int = 0) -> DataFrame:
    """In order of id. A limit of 0 or less is the default one."""
    return nodes.where(F.col("kind") == kind).orderBy("id").offset(offset).limit(limit if limit > 0 else NODE_LIMIT)


def edges_from(edges: DataFrame, node_id: str, kind: str | None = None) -> DataFrame:
    own = edges.where(F.col("src_id") == node_id)
    return own if kind is None else own.where(F.col("kind") == kind)


def edges_to(edges: DataFrame, node_id: str, kind: str | None = None) -> DataFrame:
    own = edges.where(F.col("dst_id") == node_id)
    return own if kind is None else own.where(F.col("kind") == kind)


def node_refs(nodes: DataFrame, kinds: list[str]) -> DataFrame:
    """What the link phase sees of nodes; no kinds: no rows."""
    return nodes.where(F.col("kind").isin(kinds) if kinds else F.lit(False)).select("id", "kind", "name", "source_file")


def node_listing(nodes: DataFrame, kind: str, limit: int = NODE_LIMIT) -> DataFrame:
    """The columns of a listing, with what is derived from a node's properties."""
    own = nodes_by_kind(nodes, kind, limit)
    fields = F.get_json_object("properties", "$.fields")
    return own.select("id", "name", "label", F.get_json_object("properties", "$.method").alias("method"), F.coalesce(F.json_array_length(fields).cast("string"), fields).alias("fields"), F.get_json_object("properties", "$.path").alias("path"), F.coalesce("source_file", "source").alias("source"))


def stats_by_kind(nodes: DataFrame, cap: int = COUNT_CAP) -> DataFrame:
    """A row for each kind, also for those without nodes; a count stops at the cap."""
    counts = nodes.groupBy("kind").count()
    kinds = nodes.sparkSession.createDataFrame([(k,) for k in NODE_KINDS], "kind string")
    return kinds.join(counts, "kind", "left").select("kind", F.least(F.coalesce("count", F.lit(0)), F.lit(cap)).cast("long").alias("cnt"))


def stats_total(nodes: DataFrame, cap: int = COUNT_CAP) -> DataFrame:
    return stats_by_kind(nodes, cap).agg(F.sum("cnt").alias("total"))
