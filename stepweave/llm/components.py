"""Connected components by alternating large and small stars, all in DataFrame operations.

Each round is two aggregations of minima and two joins; no neighbour list is ever gathered. Minima are summed up before they
move. From ``SPLIT`` edges on they are written before they are joined, so that both sides of a join are plain exchanges: AQE
then splits the edges of a star with very many leaves over tasks. Fewer edges are a few MB in one task at most, and a plan
without the tables between is quicker.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

SPLIT = 1_000_000

def _large_star(edges: DataFrame, split: bool) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    least = written(least, "least") if split else least
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame, split: bool) -> DataFrame:
    """edges: a > b."""
    edges = written(edges, "large") if split else edges
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    least = written(least, "least") if split else least
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges(a, b), any orientation -> (node, root) for every linked node, root being the smallest node of its component.

    No edges: no rows. Repeated edges and self loops change nothing; null ends are left out.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = written(e, "edges")
    mark, split = None, e.count() >= SPLIT
    for _ in range(max_rounds):
        e = written(_small_star(_large_star(e, split), split), "stars")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
