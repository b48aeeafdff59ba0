"""The engine as one object: the tools that a client of the graph calls, each a method that gives DataFrames or small results."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.model import Graph
from stepweave.operators import actions, listing, match, search, store, traverse
from stepweave.sources import files, protocol, scanners
from stepweave.sources.project import Config, phases

TOOL_LIMIT = 50


@dataclass
class ScanResult:
    nodes_ingested: int
    edges_created: int
    warnings: list[str]
    errors: list[tuple[str, str]]
    stats: dict[str, int]


class Engine:
    """A graph's store with its search index; a write gives a new version of both."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.store = spark, store.GraphStore(spark, path)
        self.graph: Graph = self.store.init()
        self._index: search.Index | None = None

    @property
    def index(self) -> search.Index:
        """The search index of the present graph, built when first asked for and kept until the next write."""
        if self._index is None:
            self._index = search.index(self.graph.nodes)
        return self._index

    def _keep(self, graph: Graph) -> None:
        self.graph, self._index = self.store.write(graph), None

    # --- listings and search

    def _query(self, kind: str, query: str | None, limit: int) -> DataFrame:
        limit = limit if limit > 0 else TOOL_LIMIT
        if query:
            return search.search(self.index, query, kind, limit)
        return listing.nodes_by_kind(self.graph.nodes, kind, limit)

    def query_routes(self, query: str | None = None, limit: int = TOOL_LIMIT) -> DataFrame:
        return self._query("route", query, limit)

    def query_entities(self, query: str | None = None, limit: int = TOOL_LIMIT) -> DataFrame:
        return self._query("entity", query, limit)

    def query_pages(self, query: str | None = None, limit: int = TOOL_LIMIT) -> DataFrame:
        return self._query("page", query, limit)

    def query_actions(self, query: str | None = None, limit: int = TOOL_LIMIT) -> DataFrame:
        """Actions with their references; those of a search come without."""
        found = self._query("action", query, limit)
        return found if query else found.join(actions.resolved_refs(self.graph), found["id"] == F.col("action_id"), "left").drop("action_id")

    def graph_context(self, node_id: str, max_depth: int = traverse.DEPTH) -> Graph:
        return traverse.connected(self.graph, node_id, max_depth)

    def stats(self) -> DataFrame:
        return listing.stats_by_kind(self.graph.nodes)

    # --- actions

    def create_action(self, name: str, label: str = "", patterns: list[str] | None = None, refs: dict[str, list[str]] | None = None, properties: dict | None = None) -> tuple[str, list[str]]:
        """(id, warnings)."""
        graph, warnings = actions.create_action(self.graph, name, label, patterns, refs, properties)
        self._keep(graph)
        return actions.action_id(name), warnings

    def update_action(self, action_id: str, label: str | None = None, patterns: list[str] | None = None, refs: dict[str, list[str]] | None = None, properties: dict | None = None) -> list[str]:
        graph, warnings = actions.update_action(self.graph, action_id, label, patterns, refs, properties)
        self._keep(graph)
        return warnings

    def delete_action(self, action_id: str) -> None:
        self._keep(actions.delete_action(self.graph, action_id))

    # --- matching

    def match_steps(self, steps: DataFrame, threshold: float = 0.0) -> DataFrame:
        """Of steps(text): tier, the action with its parameters and references, candidates, and a suggestion with its references."""
        return match.match_full(steps, self.graph, self.index, threshold=threshold)

    def match_step(self, text: str, threshold: float = 0.0) -> dict:
        return self.match_scenario([("", text)], threshold)[0]

    def match_scenario(self, steps: list[tuple[str, str]], threshold: float = 0.0) -> list[dict]:
        """A result per step of (keyword, text), in order. Any failure fails them all."""
        own = self.spark.createDataFrame([(k, t) for k, (_, t) in enumerate(steps)], "step_no int, text string")
        found = {r["text"]: r.asDict(recursive=True) for r in self.match_steps(own, threshold).collect()}
        return [found[t] for _, t in steps]

    def create_suggested(self, results: list[dict], fatal: bool = False) -> tuple[list[str], list[str]]:
        """Actions for results of tier suggest, after all were matched: (ids, warnings). fatal: the first that fails raises."""
        made, warnings = [], []
        for r in results:
            if r["tier"] != "suggest":
                continue
            s = r["suggestion"]
            try:
                own, more = self.create_action(s["name"], s["label"], s["patterns"], {k: s[k] for k in ("routes", "entities", "pages")})
            except ValueError as e:
                if fatal:
                    raise
                warnings.append(f"failed to create action: {e}")
            else:
                made.append(own)
                warnings += more
        return made, warnings

    def coverage(self, pattern: str = "**/*.feature") -> tuple[DataFrame, DataFrame]:
        """(per file, total) of the step files that a pattern fits."""
        steps = files.feature_steps(files.feature_files(self.spark, pattern))
        tiers = match.match_tiers(steps, match.explode_patterns(self.graph.nodes), self.index)
        return match.coverage_by_file(steps, tiers), match.coverage_total(steps, tiers)

    # --- scanning

    def ingest(self, merged: protocol.Merged, scanner: str | None = None, now: int | None = None) -> ScanResult:
        """Takes outputs in. Scan phase: nodes and edges are upserted, edges without both nodes become warnings. With a link scanner's id only its edges are taken, in place of those that it gave before."""
        now = now or int(time.time())
        warnings = [r["message"] for r in merged.warnings.select("message").toLocalIterator()]
        new = store.last_of(protocol.as_edges(merged.edges, now, scanner), "seq")
        if scanner is None:
            own = protocol.as_nodes(merged.nodes, now)
            nodes = store.upsert_nodes(self.graph.nodes, own, now, "seq")
            rejected = store.edges_rejected(new, nodes)
            warnings += [f"edge {r['id']}: an end is no node" for r in rejected.select("id").toLocalIterator()]
            valid = store.edges_valid(new, nodes)
            self._keep(Graph(nodes, store.upsert_edges(self.graph.edges, valid, now)))
            ingested, created = own.select("id").distinct().count(), valid.count()
        else:
            edges, created, _ = store.replace_scoped(self.graph.edges, new, self.graph.nodes, scanner, now)
            self._keep(Graph(self.graph.nodes, edges))
            ingested = 0
        stats = merged.stats.first().asDict()
        return ScanResult(ingested, created, warnings, [tuple(r) for r in merged.errors.select("scanner", "error").toLocalIterator()], stats)

    def scan(self, config: Config, only: str | None = None) -> list[ScanResult]:
        """Runs a project's scanners: the scan phase together, then each link scanner on the routes and entities there are."""
        first, second = phases(config, only)
        given = lambda s, refs=None: protocol.ScanInput(config.root, s.options, config.ignore, refs)
        out = []
        if first:
            merged = protocol.run_all(self.spark, {k: s.command for k, s in first.items()}, {k: given(s) for k, s in first.items()})
            out.append(self.ingest(merged))
        for name, s in second.items():
            known = listing.node_refs(self.graph.nodes, ["route", "entity"])
            merged = protocol.run_all(self.spark, {name: s.command}, {name: given(s, protocol.link_refs(known))}, known, protocol.LINK_SECONDS)
            if merged.errors.isEmpty():
                out.append(self.ingest(merged, name))
            else:
                out.append(ScanResult(0, 0, [], [tuple(r) for r in merged.errors.collect()], merged.stats.first().asDict()))
        return out

    def scan_sources(self, root: str, names: list[str], ignore: list[str] | None = None, now: int | None = None) -> ScanResult:
        """The built-in scanners over a project's files, without any command."""
        found = files.project_files(self.spark, root, ignore=ignore)
        rows = None
        for name in names:
            own = scanners.scan_project(found, name, ignore).withColumn("scanner", F.lit(name))
            rows = own if rows is None else rows.unionByName(own)
        return self.ingest(scanners.as_output(rows, found), None, now)
