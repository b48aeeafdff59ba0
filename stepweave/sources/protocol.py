"""The scanner protocol: one JSON document per scanner, read from files or from commands, checked, and taken or rejected whole."""

from __future__ import annotations

import json
import subprocess
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.model import EDGE_KINDS, NODE_KINDS
from stepweave.plans.lineage import written

VERSION, SCAN_SECONDS, LINK_SECONDS, EXCERPT = 1, 60, 300, 200
SEVERITIES = ("info", "warning", "error")

_node = "struct<id:string,kind:string,name:string,label:string,properties:variant,source:string,sourceFile:string>"
_edge = "struct<id:string,srcId:string,dstId:string,kind:string,properties:variant>"
_warning = "struct<file:string,line:int,message:string,severity:string>"
_stats = "struct<filesScanned:bigint,nodesFound:bigint,edgesFound:bigint,errors:bigint,durationMs:bigint>"
OUTPUT = f"struct<version:int,scanner:struct<id:string,name:string,version:string>,nodes:array<{_node}>,edges:array<{_edge}>,warnings:array<{_warning}>,stats:{_stats}>"


@dataclass
class Merged:
    """What the accepted outputs hold together, and what the others failed of."""

    nodes: DataFrame  # scanner, pos, id, kind, name, label, properties, source, source_file
    edges: DataFrame  # scanner, pos, id, src_id, dst_id, kind, properties
    warnings: DataFrame  # scanner, file, line, message, severity
    stats: DataFrame  # one row
    errors: DataFrame  # scanner, error


def read_outputs(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(scanner, raw): documents of ScanOutput, one a file, named by their file."""
    found = spark.read.text(paths, wholetext=True)
    return found.select(F.regexp_replace(F.substring_index(F.col("_metadata.file_path"), "/", -1), r"\.json$", "").alias("scanner"), F.col("value").alias("raw"))


def parse_outputs(raw: DataFrame) -> DataFrame:
    """(scanner, raw) -> (scanner, raw, out): out is null where raw is no document of the protocol."""
    return raw.select("scanner", "raw", F.from_json("raw", OUTPUT).alias("out"), F.expr("try_parse_json(raw)").alias("doc")).withColumn("out", F.when(F.expr("schema_of_variant(doc) like 'OBJECT%'"), F.col("out"))).drop("doc")


def _named(what: str, pos: str, text: str, *values: Column) -> Column:
    return F.format_string(f"{what}[%d]: {text}", F.col(pos), *values)


def output_nodes(parsed: DataFrame) -> DataFrame:
    own = parsed.where("out is not null").select("scanner", F.posexplode("out.nodes").alias("pos", "n"))
    return own.select("scanner", "pos", *[F.coalesce(F.col(f"n.{c}"), F.lit("")).alias(c) for c in ("id", "kind", "name", "label")], F.coalesce(F.to_json("n.properties"), F.lit("{}")).alias("properties"), F.coalesce("n.source", F.lit("")).alias("source"), F.nullif("n.sourceFile", F.lit("")).alias("source_file"))


def output_edges(parsed: DataFrame) -> DataFrame:
    own = parsed.where("out is not null").select("scanner", F.posexplode("out.edges").alias("pos", "e"))
    return own.select("scanner", "pos", *[F.coalesce(F.col(f"e.{a}"), F.lit("")).alias(b) for a, b in (("id", "id"), ("srcId", "src_id"), ("dstId", "dst_id"), ("kind", "kind"))], F.coalesce(F.to_json("e.properties"), F.lit("{}")).alias("properties"))


def output_errors(parsed: DataFrame, known: DataFrame | None = None, strict: bool = False, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> DataFrame:
    """(scanner, error) of every fault; any of them rejects its whole output. nodes, edges: the outputs' own, where they are at hand.

    known(id): nodes besides the output's own that edges may end at. strict also asks for what the written schema does: ids of
    edges, a source, known severities, counts of 0 or more.
    """
    broken = parsed.where("out is null").select("scanner", F.concat(F.lit("parsing scanner output failed (raw: "), F.substring("raw", 1, EXCERPT), F.when(F.length("raw") > EXCERPT, "...").otherwise(""), F.lit(")")).alias("error"))
    good = parsed.where("out is not null")
    head = [(F.coalesce("out.version", F.lit(0)) != VERSION, F.format_string("version must be 1, got %d", F.coalesce("out.version", F.lit(0)))), (F.coalesce("out.scanner.id", F.lit("")) == "", F.lit("scanner.id must be non-empty"))]
    if strict:
        head += [(F.least(*[F.coalesce(f"out.stats.{c}", F.lit(-1)) for c in ("filesScanned", "nodesFound", "edgesFound", "errors", "durationMs")]) < 0, F.lit("stats must be counts of 0 or more")), (F.exists("out.warnings", lambda w: ~F.coalesce(w["severity"].isin(*SEVERITIES), F.lit(False))), F.lit("a warning's severity is unknown"))]
    errors = lambda checks: F.explode(F.array_compact(F.array(*[F.when(bad, what) for bad, what in checks]))).alias("error")
    nodes = output_nodes(parsed) if nodes is None else nodes
    first = nodes.where("id <> ''").groupBy("scanner", "id").agg(F.min("pos").alias("first"))
    numbered = nodes.join(first, ["scanner", "id"], "left")
    empty = lambda c: (F.col(c) == "", _named("node", "pos", f"{c} must be non-empty"))
    checks = [empty("id"), (F.col("pos") > F.col("first"), _named("node", "pos", 'duplicate node id "%s"', F.col("id"))), empty("kind"), ((F.col("kind") != "") & ~F.col("kind").isin(*NODE_KINDS), _named("node", "pos", 'invalid kind "%s"', F.col("kind"))), empty("name"), empty("label")]
    if strict:
        checks.append(empty("source"))
    edges = output_edges(parsed) if edges is None else edges
    own = nodes.select("scanner", "id").distinct()
    for end in ("src", "dst"):
        edges = edges.join(own.select("scanner", F.col("id").alias(f"{end}_id"), F.lit(True).alias(f"{end}_own")), ["scanner", f"{end}_id"], "left")
        if known is not None:
            edges = edges.join(known.select(F.col("id").alias(f"{end}_id"), F.lit(True).alias(f"{end}_known")).distinct(), f"{end}_id", "left")
        else:
            edges = edges.withColumn(f"{end}_known", F.lit(None).cast("boolean"))
    unknown = lambda end: (F.coalesce(f"{end}_own", f"{end}_known", F.lit(False)) == F.lit(False), _named("edge", "pos", end + 'Id "%s" does not reference a known node', F.col(f"{end}_id")))
    of_edges = [(~F.col("kind").isin(*EDGE_KINDS), _named("edge", "pos", 'invalid kind "%s"', F.col("kind"))), unknown("src"), unknown("dst")]
    if strict:
        of_edges.append((F.col("id") == "", _named("edge", "pos", "id must be non-empty")))
    return broken.unionByName(good.select("scanner", errors(head))).unionByName(numbered.select("scanner", errors(checks))).unionByName(edges.select("scanner", errors(of_edges)))


def merge_outputs(raw: DataFrame, known: DataFrame | None = None, strict: bool = False, failed: DataFrame | None = None) -> Merged:
    """Outputs without a fault together; one with any gives an error row and nothing else. failed(scanner, error): those that gave no output."""
    parsed = parse_outputs(raw)
    # the documents are parsed for these tables once; checks and results read the tables
    nodes, edges = written(output_nodes(parsed), "output-nodes"), written(output_edges(parsed), "output-edges")
    faults = written(output_errors(parsed, known, strict, nodes, edges), "output-errors")
    broken = parsed.where("out is null").select("scanner")
    per = faults.groupBy("scanner").agg(F.array_join(F.sort_array(F.collect_list("error")), "; ").alias("error"))
    per = per.join(broken.withColumn("broken", F.lit(True)).distinct(), "scanner", "left").select("scanner", F.when(F.col("broken"), F.col("error")).otherwise(F.concat(F.lit("scanner output validation failed: "), F.col("error"))).alias("error"))
    errors = per if failed is None else per.unionByName(failed.select("scanner", "error"))
    good = parsed.join(per.select("scanner"), "scanner", "left_anti")
    warnings = good.select("scanner", F.explode("out.warnings").alias("w")).select("scanner", "w.file", "w.line", "w.message", "w.severity")
    total = lambda c: F.coalesce(F.sum(F.coalesce(f"out.stats.{c}", F.lit(0))), F.lit(0)).cast("long")
    of_good = good.agg(total("filesScanned").alias("files_scanned"), total("nodesFound").alias("nodes_found"), total("edgesFound").alias("edges_found"), total("errors").alias("own"), F.count("*").alias("scanners"))
    stats = of_good.crossJoin(errors.agg(F.count("*").alias("failed"))).select("files_scanned", "nodes_found", "edges_found", (F.col("own") + F.col("failed")).alias("errors"), "scanners")  # one row beside one row
    kept = lambda df: df.join(per.select("scanner"), "scanner", "left_anti").select(*df.columns)
    return Merged(kept(nodes), kept(edges), warnings, stats, errors)


@dataclass
class ScanInput:
    root: str
    options: dict = field(default_factory=dict)
    ignore: list[str] = field(default_factory=list)
    nodes: list[dict] | None = None

    def json(self) -> str:
        out: dict = {"version": VERSION, "projectRoot": self.root, "options": self.options}
        if self.ignore:
            out["ignorePaths"] = self.ignore
        if self.nodes:
            out["existingNodes"] = self.nodes
        return json.dumps(out)


def run_command(command: str, given: ScanInput, seconds: float = SCAN_SECONDS) -> tuple[str | None, str | None]:
    """(what a scanner's command printed, None), or (None, why it failed). The command is split at white space; quotes mean nothing."""
    parts = command.split()
    if not parts:
        return None, "empty scanner command"
    try:
        done = subprocess.run(parts, input=given.json(), capture_output=True, text=True, timeout=seconds, check=False)  # noqa: S603
    except subprocess.TimeoutExpired:
        return None, f"scanner timed out after {seconds:g} s"
    except OSError as e:
        return None, f"scanner exited with error: {e}"
    if done.returncode:
        said = done.stderr.strip()
        return None, f"scanner exited with error: exit status {done.returncode}" + (f" (stderr: {said})" if said else "")
    return done.stdout, None


def run_all(spark: SparkSession, commands: dict[str, str], given: dict[str, ScanInput], known: DataFrame | None = None, seconds: float = SCAN_SECONDS) -> Merged:
    """Runs the commands one after another; one that fails gives an error row and the others go on."""
    done, failed = [], []
    for name, command in commands.items():
        out, error = run_command(command, given[name], seconds)
        (done if error is None else failed).append((name, out if error is None else error))
    raw = spark.createDataFrame(done, "scanner string, raw string")
    return merge_outputs(raw, known, failed=spark.createDataFrame(failed, "scanner string, error string"))


def as_nodes(merged: DataFrame, now: int) -> DataFrame:
    """Nodes of outputs as rows of the graph, with seq: of repeated ids the last scanner's and place's counts."""
    seq = F.struct("scanner", "pos")
    return merged.select("id", "kind", "name", "label", "properties", "source", "source_file", F.lit(now).cast("long").alias("created_at"), F.lit(now).cast("long").alias("updated_at"), F.lit(None).cast("string").alias("scan_hash"), seq.alias("seq"))


def as_edges(merged: DataFrame, now: int, scanner: str | None = None) -> DataFrame:
    source = F.lit(scanner).cast("string")
    return merged.select("id", "src_id", "dst_id", "kind", "properties", source.alias("source_scanner"), F.lit(now).cast("long").alias("created_at"), F.struct("scanner", "pos").alias("seq"))


def link_refs(nodes: DataFrame) -> list[dict]:
    """What link scanners are told of nodes: routes and entities without their properties. For a command's input only."""
    rows = nodes.where(F.col("kind").isin("route", "entity")).select("id", "kind", "name", "source_file").toLocalIterator()
    return [{"id": r["id"], "kind": r["kind"], "name": r["name"]} | ({"sourceFile": r["source_file"]} if r["source_file"] else {}) for r in rows]
