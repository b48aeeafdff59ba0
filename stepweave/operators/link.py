"""Routes to the entities that their files reach through imports.

Files' facts are rows (scanners.file_facts): what a file imports, which models it uses, whether it implements routes. Imports
are resolved by a join with the files there are; reach is the bounded search of ``traverse`` over them, one way. Each route
gets an edge to each entity at the least depth, and of equal depths by the first path in order of imports. ``search_depth_first``
takes the paths in the order in which imports stand instead, file after file, for one project in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepweave.plans.lineage import written

DEPTH = 8
TEST_FILE = r"(?:\.test\.ts|\.spec\.ts|__tests__/)"
EXTENSIONS = (".ts", ".tsx", ".d.ts")
LINKS = "route string, entity string, depth int, trace array<string>"


def normal(path: Column) -> Column:
    """A path without its . and .. steps; null where it leaves the root."""
    step = lambda acc, x: F.when((x == ".") | (x == ""), acc).when(x == "..", F.when(F.size(acc) > 0, F.slice(acc, 1, F.size(acc) - 1))).otherwise(F.concat(acc, F.array(x)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def resolved(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports(path, pos, name) of files(path) -> (src, pos, dst): the file that a relative import names, as it stands, with an extension, as a folder's index, or with .js for .ts."""
    own = imports.where(F.col("name").startswith(".")).select(F.col("path").alias("src"), "pos", normal(F.concat_ws("/", F.regexp_replace("path", "[^/]*$", ""), "name")).alias("at"))
    bare = F.regexp_replace("at", r"\.(?:js|jsx|mjs|cjs)$", "")
    names = [F.col("at"), *[F.concat("at", F.lit(x)) for x in EXTENSIONS], *[F.when(bare != F.col("at"), F.concat(bare, F.lit(x))) for x in EXTENSIONS], *[F.concat("at", F.lit(f"/index{x}")) for x in EXTENSIONS]]
    tried = own.where("at is not null").select("src", "pos", F.posexplode(F.array(*names)).alias("rank", "dst")).where(F.col("dst").rlike(r"\.tsx?$"))
    found = tried.join(files.select(F.col("path").alias("dst")).distinct(), "dst")
    return found.groupBy("src", "pos").agg(F.min_by("dst", "rank").alias("dst"))


def entities(facts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(path, entity): accesses by the lower-case name of an entity; of names alike the last id counts."""
    named = nodes.where("kind = 'entity'").groupBy(F.lower("name").alias("name")).agg(F.max("id").alias("entity"))
    return facts.where("what = 'access'").select("path", "name").join(named, "name").select("path", "entity").distinct()


def reached(starts: DataFrame, edges: DataFrame, depth: int = DEPTH) -> DataFrame:
    """starts(path) -> (origin, path, depth, trace): files within reach, each by its first way of the least length; test files are not entered."""
    step = written(edges.where(~F.col("dst").rlike(TEST_FILE)).select(F.col("src").alias("path"), "pos", "dst"), "imports")
    seen = written(starts.where(~F.col("path").rlike(TEST_FILE)).select(F.col("path").alias("origin"), "path").distinct().select("origin", "path", F.lit(0).alias("depth"), F.array("path").alias("trace"), F.array().cast("array<int>").alias("places")), "files")
    frontier = seen
    for k in range(1, depth + 1):
        near = frontier.join(step, "path").select("origin", F.col("dst").alias("path"), F.concat("trace", F.array("dst")).alias("trace"), F.concat("places", F.array("pos")).alias("places"))
        near = near.groupBy("origin", "path").agg(F.min(F.struct("places", "trace")).alias("first")).join(seen.select("origin", "path"), ["origin", "path"], "left_anti")
        frontier = written(near.select("origin", "path", F.lit(k).alias("depth"), "first.trace", "first.places"), "files")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def _touched(starts: DataFrame, edges: DataFrame, used: DataFrame, depth: int) -> DataFrame:
    """(origin, entity, depth, trace) of files(path)."""
    found = reached(starts, edges, depth).join(used, "path")
    return found.groupBy("origin", "entity").agg(F.min(F.struct("depth", "places", "trace")).alias("first")).select("origin", "entity", "first.depth", "first.trace")


def handlers(contracts: DataFrame, edges: DataFrame, facts: DataFrame, imports: DataFrame) -> DataFrame:
    """(contract, path): files that implement routes and import the contract(path); where none does, those named after it: break.ts, break.handler*.ts."""
    able = facts.where("what = 'handler'").select("path").distinct()
    bare = lambda c: F.regexp_replace(c, r"\.[^./]+$", "")
    by_import = edges.select(F.col("dst").alias("contract"), F.col("src").alias("path"))
    loose = imports.where(F.col("name").startswith(".")).select("path", bare(normal(F.concat_ws("/", F.regexp_replace("path", "[^/]*$", ""), "name"))).alias("stem"))
    own = contracts.select(F.col("path").alias("contract"), bare(F.col("path")).alias("stem"))
    direct = by_import.join(own.select("contract"), "contract").unionByName(loose.join(own, "stem").select("contract", "path")).distinct().where("contract <> path").join(able, "path").select("contract", "path")
    base = F.regexp_replace(F.regexp_replace("contract", "^.*/", ""), r"\.[^.]+$", "")
    rest = own.join(direct.select("contract").distinct(), "contract", "left_anti").select("contract", base.alias("base")).where("base <> 'index'")
    named = able.withColumn("base", F.regexp_extract(F.regexp_replace("path", "^.*/", ""), r"^(.+?)\.[hH]andler", 1)).where("base <> ''")
    return direct.unionByName(rest.join(named, "base").where("contract <> path").select("contract", "path"))


def link(facts: DataFrame, files: DataFrame, nodes: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Edges (id, src_id, dst_id, kind, properties) from nodes' routes to entities, from facts of files(path).

    First through what a route's own file imports; for routes without an edge from that, through the files that implement
    them (resolvedVia: reverse-import). Routes without a file, and without either, get none.
    """
    facts = written(facts.select("path", "pos", "what", "name"), "facts")
    imports = facts.where("what = 'import'")
    edges = written(resolved(imports, files), "resolved")
    used = entities(facts, nodes)
    routes = written(nodes.where("kind = 'route' and source_file is not null and source_file <> ''").select(F.col("id").alias("route"), F.col("source_file").alias("path")), "routes")
    own = written(_touched(routes.select("path"), edges, used, depth), "touched")
    direct = routes.join(own.withColumnRenamed("origin", "path"), "path").select("route", "entity", "depth", "trace", F.lit(None).cast("string").alias("via"))
    rest = routes.join(direct.select("route").distinct(), "route", "left_anti")
    serving = written(handlers(rest.select("path").distinct(), edges, facts, imports), "handlers")
    far = _touched(serving.select("path"), edges, used, depth).select(F.col("origin").alias("path"), "entity", "depth", "trace")
    reverse = rest.select("route", F.col("path").alias("contract")).join(serving, "contract").join(far, "path")
    reverse = reverse.groupBy("route", "entity").agg(F.min(F.struct("path", "depth", "trace")).alias("first")).select("route", "entity", "first.depth", "first.trace", F.lit("reverse-import").alias("via"))
    out = direct.unionByName(reverse)
    properties = F.to_json(F.struct(F.col("trace").alias("tracePath"), "depth", F.col("via").alias("resolvedVia")))
    return out.select(F.format_string("edge:%s-touches_entity-%s", "route", "entity").alias("id"), F.col("route").alias("src_id"), F.col("entity").alias("dst_id"), F.lit("touches_entity").alias("kind"), properties.alias("properties"))


def link_warnings(facts: DataFrame, files: DataFrame, nodes: DataFrame) -> DataFrame:
    """(file, severity, message): no routes at all, and routes whose files are not there."""
    routes = nodes.where("kind = 'route'")
    none = routes.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("unknown").alias("file"), F.lit("info").alias("severity"), F.lit("No route nodes found: nothing to link").alias("message"))
    lost = routes.where("source_file is not null").select(F.col("source_file").alias("path")).join(files.select("path"), "path", "left_anti")
    return none.unionByName(lost.select(F.col("path").alias("file"), F.lit("warning").alias("severity"), F.lit("Failed to add source file: no such file").alias("message")))


def search_depth_first(routes: list[tuple[str, str]], imports: dict[str, list[str]], used: dict[str, list[str]], depth: int = DEPTH) -> Iterator[tuple[str, str, int, list[str]]]:
    """(route, entity, depth, trace) of routes(id, file) of one project, in the order in which imports stand.

    A file is entered once per route, and not anew where it is met again on a shorter way; what was found below a file for
    an earlier route serves later ones that have no more depth left. The way recorded is the first one found.
    """
    import re

    memo: dict[str, tuple[int, dict[str, None]]] = {}
    for route, start in routes:
        entered: set[str] = set()
        found: dict[str, tuple[int, list[str]]] = {}

        def note(names, at: int, way: list[str]) -> None:
            for name in names:
                found.setdefault(name, (at, way))  # noqa: B023

        def enter(file: str, at: int, way: list[str]) -> dict[str, None]:
            left, way = depth - at, [*way, file]
            if left < 0 or file not in imports:
                return {}
            old = memo.get(file)
            if file in entered or old and left <= old[0]:  # noqa: B023
                names = old[1] if old else {}
                if re.search(TEST_FILE, file):
                    return {}
                entered.add(file)  # noqa: B023
                note(names, at, way)
                return names
            if re.search(TEST_FILE, file):
                return {}
            entered.add(file)  # noqa: B023
            names = dict.fromkeys(used.get(file, ()))
            note(names, at, way)
            for other in imports[file]:
                names |= enter(other, at + 1, way)
            memo[file] = (left, names)
            return names

        enter(start, 0, [])
        for entity, (at, way) in found.items():
            yield route, entity, at, way


def link_depth_first(facts: DataFrame, files: DataFrame, nodes: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(route, entity, depth, trace) by ``search_depth_first``: exact order of imports, at the price of one task for the project."""
    edges, used = resolved(facts.where("what = 'import'"), files), entities(facts, nodes)
    routes = nodes.where("kind = 'route' and source_file is not null").select(F.col("id").alias("a"), F.col("source_file").alias("b"))
    rows = routes.select(F.lit("route").alias("what"), "a", "b", F.lit(0).alias("pos")).unionByName(edges.select(F.lit("import").alias("what"), F.col("src").alias("a"), F.col("dst").alias("b"), "pos"))
    rows = rows.unionByName(used.select(F.lit("use").alias("what"), F.col("path").alias("a"), F.col("entity").alias("b"), F.lit(0).alias("pos"))).unionByName(files.select(F.lit("file").alias("what"), F.col("path").alias("a"), F.lit("").alias("b"), F.lit(0).alias("pos")))

    def run(batches):
        t = pd.concat(list(batches)).sort_values(["what", "a", "pos", "b"])
        of = lambda what: t[t["what"] == what]
        imports: dict[str, list[str]] = {a: [] for a in of("file")["a"]}
        for a, b in zip(of("import")["a"], of("import")["b"], strict=True):
            imports.setdefault(a, []).append(b)
        use = of("use").groupby("a")["b"].apply(list).to_dict()
        out = list(search_depth_first(list(zip(of("route")["a"], of("route")["b"], strict=True)), imports, use, depth))
        yield pd.DataFrame(out, columns=["route", "entity", "depth", "trace"])

    return rows.repartition(1).mapInPandas(run, LINKS)


__all__ = ["DEPTH", "entities", "handlers", "link", "link_depth_first", "link_warnings", "normal", "reached", "resolved", "search_depth_first"]
