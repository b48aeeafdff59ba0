"""Bounded reachability over edges taken in both directions, or in one, and the subgraphs it induces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepweave.model import Graph
from stepweave.plans.lineage import written

DEPTH = 2


def reach(edges: DataFrame, start: DataFrame, depth: int, directed: bool = False) -> DataFrame:
    """start(origin, id) -> (origin, id, depth): each node with its least distance from each origin.

    A round joins the frontier with the edges and drops what was reached before, so every node is expanded once;
    it is written down, so that the plan of a later round does not hold the earlier ones again. The edges' ends are written
    once for all rounds. A small frontier is broadcast by Catalyst; a hub's edges, where it is not, are split by AQE.
    """
    step = written(edges.select(F.col("src_id").alias("a"), F.col("dst_id").alias("b")), "ends")
    ways = [step] if directed else [step, step.select(F.col("b").alias("a"), F.col("a").alias("b"))]
    seen = written(start.select("origin", "id", F.lit(0).alias("depth")).distinct(), "reach")
    frontier = seen
    for k in range(1, depth + 1):
        met = [frontier.select("origin", F.col("id").alias("a")).join(w, "a").select("origin", F.col("b").alias("id")) for w in ways]
        near = (met[0] if directed else met[0].unionByName(met[1])).distinct()
        frontier = written(near.join(seen.select("origin", "id"), ["origin", "id"], "left_anti").withColumn("depth", F.lit(k)), "reach")
        seen = seen.unionByName(frontier)
    return seen


def reachable(graph: Graph, node_id: str, depth: int = DEPTH) -> DataFrame:
    """(id, depth) around a node; an id that no node has reaches nothing. Depths of 0 or less are the default."""
    start = graph.nodes.where(F.col("id") == node_id).select(F.col("id").alias("origin"), "id")
    return reach(graph.edges, start, depth if depth > 0 else DEPTH).select("id", "depth")


def connected(graph: Graph, node_id: str, depth: int = DEPTH) -> Graph:
    """The nodes within reach, and the edges that have both ends there, those between nodes of the last depth too."""
    graph = Graph(graph.nodes, written(graph.edges, "edges"))
    ids = reachable(graph, node_id, depth).select("id")
    inner = graph.edges.join(ids.withColumnRenamed("id", "src_id"), "src_id", "left_semi").join(ids.withColumnRenamed("id", "dst_id"), "dst_id", "left_semi")
    return Graph(graph.nodes.join(ids, "id", "left_semi"), inner)
