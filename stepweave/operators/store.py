"""Validation of scanner output, idempotent writes, and a versioned store in Parquet."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stepweave.model import EDGE_KINDS, EDGE_SCHEMA, NODE_KINDS, NODE_SCHEMA, NODE_SOURCES, SCHEMA_VERSION, Graph


def _errors(checks: list[tuple[Column, str]]) -> Column:
    return F.array_compact(F.array(*[F.when(bad, F.lit(what)) for bad, what in checks]))


def validate_nodes(nodes: DataFrame) -> DataFrame:
    """(id, error) for each fault of a node: empty fields, an unknown kind, an id that occurs more than once."""
    twice = nodes.groupBy("id").count().where("count > 1").select("id", F.lit(True).alias("twice"))
    empty = lambda c: (F.coalesce(F.col(c), F.lit("")) == "", f"empty {c}")
    own = nodes.join(twice, "id", "left")
    faults = _errors([empty("id"), empty("kind"), empty("name"), empty("label"), (~F.coalesce(F.col("kind").isin(*NODE_KINDS), F.lit(False)), "unknown kind"), (F.coalesce("twice", F.lit(False)), "duplicate id")])
    return own.select("id", F.explode(faults).alias("error"))


def validate_edges(edges: DataFrame, known: DataFrame) -> DataFrame:
    """(id, error): unknown kinds, ends that known(id) lacks."""
    ids = known.select("id").distinct()
    own = edges.join(ids.select(F.col("id").alias("src_id"), F.lit(True).alias("has_src")), "src_id", "left").join(ids.select(F.col("id").alias("dst_id"), F.lit(True).alias("has_dst")), "dst_id", "left")
    faults = _errors([(~F.coalesce(F.col("kind").isin(*EDGE_KINDS), F.lit(False)), "unknown kind"), (F.col("has_src").isNull(), "unknown source"), (F.col("has_dst").isNull(), "unknown target")])
    return own.select("id", F.explode(faults).alias("error"))


def edges_valid(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "src_id"), "src_id", "left_semi").join(ids.withColumnRenamed("id", "dst_id"), "dst_id", "left_semi").select(*edges.columns)


def edges_rejected(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return edges.join(edges_valid(edges, nodes).select("id"), "id", "left_anti").select(*edges.columns)


def cascade_delete(graph: Graph, ids: DataFrame) -> Graph:
    """Without the nodes of ids(id), and without the edges that end at one."""
    gone = ids.select("id").distinct()
    edges = graph.edges.join(gone.withColumnRenamed("id", "src_id"), "src_id", "left_anti").join(gone.withColumnRenamed("id", "dst_id"), "dst_id", "left_anti")
    return Graph(graph.nodes.join(gone, "id", "left_anti").select(*graph.nodes.columns), edges.select(*graph.edges.columns))


def last_of(rows: DataFrame, seq: str | None) -> DataFrame:
    """Of rows with one id the last by seq; without one, one of them, the same each time."""
    if seq is None:
        rest = [c for c in rows.columns if c != "id"]
        return rows.groupBy("id").agg(F.max(F.struct(*rest)).alias("_last")).select("id", "_last.*").select(*rows.columns)
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy("id").orderBy(F.col(seq).desc()))).where("_k = 1").drop("_k", seq)


def _upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """New rows replace old ones of their id but for created_at."""
    created = old.select("id", F.col("created_at").alias("_created"))
    put = new.join(created, "id", "left").withColumn("created_at", F.coalesce("_created", "created_at")).select(*old.columns)
    return old.join(new.select("id"), "id", "left_anti").select(*old.columns).unionByName(put)


def upsert_nodes(nodes: DataFrame, new: DataFrame, now: int, seq: str | None = None) -> DataFrame:
    own = last_of(new, seq).withColumn("updated_at", F.lit(now).cast("long")).withColumn("created_at", F.lit(now).cast("long"))
    return _upsert(nodes, own)


def upsert_edges(edges: DataFrame, new: DataFrame, now: int, seq: str | None = None) -> DataFrame:
    """created_at stays as it was; of repeated ids among the new the last by seq counts."""
    return _upsert(edges, last_of(new, seq).withColumn("created_at", F.lit(now).cast("long")))


def replace_edges(edges: DataFrame, new: DataFrame, nodes: DataFrame, now: int) -> DataFrame:
    """The bulk form: created_at is set anew, edges without both nodes are skipped."""
    own = edges_valid(last_of(new, None).withColumn("created_at", F.lit(now).cast("long")), nodes)
    return edges.join(own.select("id"), "id", "left_anti").select(*edges.columns).unionByName(own.select(*edges.columns))


def replace_scoped(edges: DataFrame, new: DataFrame, nodes: DataFrame, scanner: str, now: int) -> tuple[DataFrame, int, int]:
    """(edges, created, deleted): a scanner's edges give way to its new ones; those without both nodes are skipped and not counted."""
    kept = delete_by_scanner(edges, scanner)
    own = edges_valid(new.withColumn("source_scanner", F.lit(scanner)), nodes)
    return replace_edges(kept, own, nodes, now), own.select("id").distinct().count(), count_by_scanner(edges, scanner)


def count_by_scanner(edges: DataFrame, scanner: str) -> int:
    """How many edges ``delete_by_scanner`` takes away."""
    return edges.where(F.col("source_scanner") == scanner).count()


def count_from(edges: DataFrame, node_id: str, kind: str) -> int:
    """How many edges ``delete_from`` takes away."""
    return edges.where((F.col("src_id") == node_id) & (F.col("kind") == kind)).count()


def insert_node(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """With new nodes; ids that are there, or twice among the new, are an error."""
    twice = new.groupBy("id").count().where("count > 1").select("id").unionByName(new.join(nodes.select("id"), "id", "left_semi").select("id"))
    if bad := twice.limit(3).collect():
        raise ValueError(f"ids that exist: {', '.join(r['id'] for r in bad)}")
    return nodes.unionByName(new.select(*nodes.columns))


def delete_by_scanner(edges: DataFrame, scanner: str) -> DataFrame:
    """What is left; edges without a scanner stay."""
    return edges.where(~F.col("source_scanner").eqNullSafe(F.lit(scanner)))


def delete_from(edges: DataFrame, node_id: str, kind: str) -> DataFrame:
    return edges.where(~((F.col("src_id") == node_id) & (F.col("kind") == kind)))


def dedupe_ids(rows: DataFrame, base: str, position: list[str]) -> DataFrame:
    """id: the base, with #2, #3, ... from its second occurrence on."""
    k = F.row_number().over(Window.partitionBy(base).orderBy(*position))
    return rows.withColumn("_k", k).withColumn("id", F.when(F.col("_k") > 1, F.concat(F.col(base), F.lit("#"), F.col("_k").cast("string"))).otherwise(F.col(base))).drop("_k")


def merge_scans(outputs: list[DataFrame]) -> DataFrame:
    out = outputs[0]
    for o in outputs[1:]:
        out = out.unionByName(o)
    return out


def _fault(graph: Graph) -> str | None:
    """What a graph's tables must not hold, if they do."""
    nodes, edges = graph.nodes, graph.edges
    if not nodes.where(~F.col("kind").isin(*NODE_KINDS) | ~F.col("source").isin(*NODE_SOURCES) | F.col("id").isNull()).isEmpty():
        return "nodes of an unknown kind or source, or without an id"
    if not edges.where(~F.col("kind").isin(*EDGE_KINDS) | F.col("id").isNull()).isEmpty():
        return "edges of an unknown kind, or without an id"
    for what, rows in (("nodes", nodes), ("edges", edges)):
        if not rows.groupBy("id").count().where("count > 1").isEmpty():
            return f"{what} with equal ids"
    return None if edges_rejected(edges, nodes).isEmpty() else "edges with an end that is no node"


class GraphStore:
    """Versions of a graph under one folder: each write makes a new folder, then one small file names it; the highest number is current."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _versions(self) -> list[int]:
        _, fs, at = self._fs()
        names = [str(x.getPath().getName()) for x in fs.listStatus(at)] if fs.exists(at) else []
        return [int(n[8:]) for n in names if n.startswith("CURRENT-")]

    def _current(self) -> dict | None:
        found = self._versions()
        return json.loads(self.spark.read.text(f"{self.path}/CURRENT-{max(found):012d}").first()[0]) if found else None

    def current(self) -> str | None:
        own = self._current()
        return own and own["folder"]

    def schema_versions(self) -> int:
        """How many schema versions the store holds: one, or none before init()."""
        return int(self._current() is not None)

    def init(self) -> Graph:
        """Empty tables, unless a graph of this schema version is there; one of another version is replaced."""
        own = self._current()
        if own and own["version"] == SCHEMA_VERSION:
            return self.read()
        return self.write(Graph(self.spark.createDataFrame([], NODE_SCHEMA), self.spark.createDataFrame([], EDGE_SCHEMA)))

    def read(self) -> Graph:
        folder = self.current()
        if folder is None:
            raise FileNotFoundError(f"{self.path}: no graph; call init()")
        return Graph(self.spark.read.schema(NODE_SCHEMA).parquet(f"{folder}/nodes"), self.spark.read.schema(EDGE_SCHEMA).parquet(f"{folder}/edges"))

    def write(self, graph: Graph) -> Graph:
        """A new version, whole or not at all: its tables are written and checked, then one rename makes it current."""
        folder = f"{self.path}/v-{uuid.uuid4().hex}"
        graph.nodes.select(*NODE_SCHEMA.names).write.parquet(f"{folder}/nodes")
        graph.edges.select(*EDGE_SCHEMA.names).write.parquet(f"{folder}/edges")
        new = Graph(self.spark.read.schema(NODE_SCHEMA).parquet(f"{folder}/nodes"), self.spark.read.schema(EDGE_SCHEMA).parquet(f"{folder}/edges"))
        jvm, fs, _ = self._fs()
        path = jvm.org.apache.hadoop.fs.Path
        if fault := _fault(new):
            fs.delete(path(folder), True)
            raise ValueError(fault)
        # versions are numbered; a name that exists is never replaced, so a reader always finds a whole one
        temp = path(f"{self.path}/.version-{uuid.uuid4().hex}")
        out = fs.create(temp)
        out.write(bytearray(json.dumps({"version": SCHEMA_VERSION, "folder": folder}).encode()))
        out.close()
        number = max([0, *self._versions()]) + 1
        while not fs.rename(temp, path(f"{self.path}/CURRENT-{number:012d}")):
            number += 1
        return new
