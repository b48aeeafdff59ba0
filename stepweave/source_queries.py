"""Registered queries over sources, scanner outputs and links: texts are made of the star schema, and SQL states what must come out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepweave.operators import link, match, search, store
from stepweave.queries import QUERIES, SQL, query
from stepweave.sources import files, protocol, scanners, tables
from stepweave.sources.tables import EDGES_SQL, NODES_SQL

_AT = "nation JOIN region ON n_regionkey = r_regionkey"


def _at(s, d) -> DataFrame:
    return tables.read(s, d, "nation").join(tables.read(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))


def _files(s, d, path: str, line: str, head: str = "", tail: str = "") -> DataFrame:
    """files(path, text): a file per region, a line per nation in order of its key."""
    lines = _at(s, d).select(F.expr(path).alias("path"), "n_nationkey", F.expr(line).alias("line"))
    own = lines.groupBy("path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", "line"))), lambda x: x["line"]), "\n").alias("body"))
    return own.select("path", F.concat(F.lit(head), "body", F.lit(tail)).alias("text"))


# --- scanners

_HANDLED = "CASE n_nationkey % 3 WHEN 0 THEN '[]' WHEN 1 THEN '[\"auth\"]' ELSE '[\"auth\",\"role\"]' END"


@query(f"""SELECT 'src/routes/' || lower(r_name) || '.routes.ts' AS path, 'route:' || CASE n_nationkey % 2 WHEN 0 THEN 'GET' ELSE 'POST' END || '-' || lower(r_name) || ':/' || CASE WHEN n_nationkey % 5 = 0 THEN 'same' ELSE lower(n_name) END || CASE WHEN k > 1 THEN '#' || k ELSE '' END AS id, {_HANDLED} AS middleware, 'h' || CAST(n_nationkey AS VARCHAR) AS handler
FROM (SELECT *, row_number() OVER (PARTITION BY r_name, n_nationkey % 2, CASE WHEN n_nationkey % 5 = 0 THEN 'same' ELSE lower(n_name) END ORDER BY n_nationkey) AS k FROM {_AT})""")
def express_routes(s, d):
    line = """concat('router.', if(n_nationkey % 2 = 0, 'get', 'post'), "('/", if(n_nationkey % 5 = 0, 'same', lower(n_name)), "', ", elt(cast(n_nationkey % 3 as int) + 1, '', 'auth, ', "auth, x.role('a'), "), 'h', n_nationkey, '); // it''s router.get("/no", h)')"""
    own = _files(s, d, "concat('src/routes/', lower(r_name), '.routes.ts')", line, "import express from 'express';\n").unionByName(_files(s, d, "concat('src/', lower(r_name), '.test.ts')", line)).unionByName(_files(s, d, "concat('lib/', lower(r_name), '.ts')", line))
    rows = scanners.scan_project(own, "express", ["lib"])
    return rows.where("what = 'node'").select("path", "id", F.get_json_object("properties", "$.middleware").alias("middleware"), F.get_json_object("properties", "$.handler").alias("handler"))


@query(f"SELECT 'route:PUT-' || lower(r_name) || ':/' || lower(n_name) AS id, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE '[' || lower(r_name) || '] PUT /' || lower(n_name) END AS label, CASE WHEN n_nationkey % 2 = 0 THEN 'In' || CAST(n_nationkey AS VARCHAR) END AS input, 'z.array(Out' || CAST(n_nationkey AS VARCHAR) || ')' AS output, CAST(200 + n_nationkey AS VARCHAR) AS status FROM {_AT}")
def orpc_routes(s, d):
    line = """concat('  n', n_nationkey, ": oc.route({ method: 'PUT', path: '/", lower(n_name), "', successStatus: ", 200 + n_nationkey, if(n_nationkey % 2 = 0, concat(", summary: '", n_name, "'"), ''), ' })', if(n_nationkey % 2 = 0, concat('.input(In', n_nationkey, ')'), ''), '.errors({}).output(z.array(Out', n_nationkey, ')),')"""
    own = _files(s, d, "concat('src/contracts/', lower(r_name), '.contract.ts')", line, "export const c = {\n", "\n};")
    of = lambda k: F.get_json_object("properties", f"$.{k}")
    return scanners.scan_project(own, "orpc").where("what = 'node'").select("id", "label", of("inputSchema").alias("input"), of("outputSchema").alias("output"), of("successStatus").alias("status"))


@query(f"""WITH p AS (SELECT r_name, n_nationkey AS k, lower(r_name) AS up, CASE n_nationkey % 3 WHEN 0 THEN '/' || lower(r_name) WHEN 1 THEN '/' || lower(r_name) || '/' || lower(n_name) ELSE '/abs' END AS path, n_nationkey % 3 = 0 AS idx, n_name FROM {_AT}),
n AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY r_name, k) AS c FROM p) SELECT 'page:' || path || CASE WHEN c > 1 THEN '#' || c ELSE '' END AS id, n_name AS label, CASE WHEN r_name < 'B' THEN 'true' ELSE 'false' END AS protected, CASE WHEN idx THEN 'true' ELSE 'false' END AS is_index, '/' || up AS parent FROM n""")
def react_pages(s, d):
    line = "concat('<Route ', elt(cast(n_nationkey % 3 as int) + 1, 'index', concat('path=\"', lower(n_name), '\"'), 'path=\"/abs\"'), ' element={<', n_name, ' a={1 < 2 ? 3 : 4} />} />')"
    own = _files(s, d, "concat('src/pages/', r_name, '.tsx')", line)
    name = F.lower(F.regexp_extract("path", r"([A-Z ]+)\.tsx$", 1))
    shown = F.concat(F.lit('export const App = () => (<Routes>{/* it\'s */}{user ? (<Route path="/'), name, F.lit('">'), "text", F.lit("</Route>) : "), F.when(name < "b", "<Navigate to='/' />").otherwise("<Login />"), F.lit("}</Routes>);"))
    rows = scanners.scan_project(own.select("path", shown.alias("text")), "react-router").where("what = 'node'")
    of = lambda k: F.get_json_object("properties", f"$.{k}")
    return rows.select("id", "label", of("isProtected").alias("protected"), of("isIndex").alias("is_index"), of("parentPath").alias("parent"))


_MODEL = "'M' || CAST(n_nationkey AS VARCHAR)"


@query(f"""WITH o AS (SELECT n_nationkey AS k, (n_nationkey * 7) % 25 AS t FROM nation) SELECT 'entity:M' || k AS id, '' AS dst, '3' AS fields, CASE WHEN k % 4 = 0 THEN 'table' || k END AS note FROM o
UNION ALL SELECT 'edge:entity:M' || k || '-field_relation:other-entity:M' || t, 'entity:M' || t, '', CASE WHEN k % 3 = 0 THEN 'one-to-one' ELSE 'many-to-one' END FROM o UNION ALL SELECT 'entity:E' || k, '', '', '["A","B' || k || '"]' FROM o""")
def prisma_entities(s, d):
    n = tables.read(s, d, "nation").selectExpr("n_nationkey", "concat('model M', n_nationkey, ' {\n  id Int @id @default(autoincrement())\n  // no Int\n  otherId Int?', if(n_nationkey % 3 = 0, ' @unique', ''), '\n  other M', n_nationkey * 7 % 25, '? @relation(\"r\", fields: [otherId], references: [id])\n', if(n_nationkey % 4 = 0, concat('\n  @@map(\"table', n_nationkey, '\")\n'), ''), '}\nenum E', n_nationkey, ' {\n  A\n  // C\n  B', n_nationkey, '\n}\n') text")
    own = n.groupBy().agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", "text"))), lambda x: x["text"]), "\n").alias("text")).select(F.lit("backend/prisma/schema.prisma").alias("path"), "text")
    rows = scanners.scan_project(own, "prisma")
    of = lambda k: F.get_json_object("properties", f"$.{k}")
    return rows.select("id", F.coalesce("dst_id", F.lit("")).alias("dst"), F.coalesce(F.json_array_length(of("fields")).cast("string"), F.lit("")).alias("fields"), F.coalesce(of("tableName"), of("relationType"), of("values")).alias("note"))


@query("SELECT 'conv-' || CAST(conv_id AS VARCHAR) AS file, CAST(k AS INTEGER) AS step_no, CASE role WHEN 'user' THEN 'When' ELSE 'Then' END AS keyword, 'turn ' || CAST(turn AS VARCHAR) AS text FROM (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) - 1 AS k FROM (SELECT DISTINCT conv_id, turn, role FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND role IN ('user', 'assistant')))")
def feature_steps(s, d):
    c = tables.read(s, d, "conversations").where("conv_id is not null and turn is not null and role in ('user', 'assistant')").select("conv_id", "turn", "role").distinct()
    line = F.concat(F.lit("\t"), F.when(F.col("role") == "user", "When ").otherwise("Then "), F.lit("turn "), F.col("turn").cast("string"), F.lit(" \n  * a bullet\n# When not\n"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", line.alias("line")))), lambda x: x["line"]), "")
    return files.feature_steps(c.groupBy(F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("path")).agg(text.alias("text")))


# --- outputs of the protocol


def _raw(s, d) -> DataFrame:
    """An output per region: AFRICA's is of version 2, AMERICA's has a node without a label, ASIA's an unknown edge end, EUROPE's text is cut."""
    node = F.struct(F.concat(F.lit("entity:"), "n_name").alias("id"), F.lit("entity").alias("kind"), F.col("n_name").alias("name"), F.when((F.col("r_name") == "AMERICA") & (F.col("n_nationkey") == 6), "").otherwise(F.col("n_name")).alias("label"), F.struct(F.col("n_nationkey").alias("key")).alias("properties"), F.lit("scan").alias("source"))
    edge = F.struct(F.concat(F.lit("e"), F.col("n_nationkey").cast("string")).alias("id"), F.concat(F.lit("entity:"), "n_name").alias("srcId"), F.when((F.col("r_name") == "ASIA") & (F.col("n_nationkey") == 12), "entity:none").otherwise(F.concat(F.lit("entity:"), "n_name")).alias("dstId"), F.lit("relates_to").alias("kind"))
    own = _at(s, d).groupBy("r_name").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", node.alias("n"), edge.alias("e")))).alias("x"))
    out = F.to_json(F.struct(F.when(F.col("r_name") == "AFRICA", 2).otherwise(1).alias("version"), F.struct(F.col("r_name").alias("id"), F.lit("").alias("name"), F.lit("").alias("version")).alias("scanner"), F.transform("x", lambda v: v["n"]).alias("nodes"), F.transform("x", lambda v: v["e"]).alias("edges"), F.array(F.struct(F.lit("f").alias("file"), F.col("r_name").alias("message"), F.lit("info").alias("severity"))).alias("warnings"), F.struct(F.lit(1).alias("filesScanned"), F.size("x").alias("nodesFound"), F.size("x").alias("edgesFound"), F.lit(0).alias("errors"), F.lit(5).alias("durationMs")).alias("stats")))
    return own.select(F.col("r_name").alias("scanner"), F.when(F.col("r_name") == "EUROPE", F.substring(out, 1, 30)).otherwise(out).alias("raw"))


@query(f"SELECT r_name AS scanner, 'entity:' || n_name AS id, '{{\"key\":' || CAST(n_nationkey AS VARCHAR) || '}}' AS properties FROM {_AT} WHERE r_name NOT IN ('AFRICA', 'AMERICA', 'ASIA', 'EUROPE')")
def scan_output_nodes(s, d):
    return protocol.merge_outputs(_raw(s, d)).nodes.select("scanner", "id", "properties")


@query(f"""SELECT 'AFRICA' AS scanner, 'scanner output validation failed: version must be 1, got 2' AS error FROM region WHERE r_name = 'AFRICA'
UNION ALL SELECT 'AMERICA', 'scanner output validation failed: node[' || CAST(k AS VARCHAR) || ']: label must be non-empty' FROM (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) - 1 AS k FROM {_AT} WHERE r_name = 'AMERICA') WHERE n_nationkey = 6
UNION ALL SELECT 'ASIA', 'scanner output validation failed: edge[' || CAST(k AS VARCHAR) || ']: dstId "entity:none" does not reference a known node' FROM (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) - 1 AS k FROM {_AT} WHERE r_name = 'ASIA') WHERE n_nationkey = 12
UNION ALL SELECT 'EUROPE', 'parsing scanner output failed (raw: {{"version":1,"scanner":{{"id":")' FROM region WHERE r_name = 'EUROPE'""")
def scan_output_errors(s, d):
    return protocol.merge_outputs(_raw(s, d)).errors


@query(f"WITH m AS (SELECT * FROM {_AT} WHERE r_name NOT IN ('AFRICA', 'AMERICA', 'ASIA', 'EUROPE')) SELECT CAST(count(DISTINCT r_name) AS BIGINT) AS files_scanned, count(*) AS nodes_found, count(*) AS edges_found, CAST(4 AS BIGINT) AS errors, CAST(count(DISTINCT r_name) AS BIGINT) AS scanners FROM m")
def scan_output_stats(s, d):
    return protocol.merge_outputs(_raw(s, d)).stats


@query(f"WITH {NODES_SQL}, {EDGES_SQL}, known AS (SELECT id FROM nodes WHERE kind IN ('route', 'entity')), own AS (SELECT source_scanner || right(id, 2) AS scanner, src_id, dst_id FROM edges), bad AS (SELECT DISTINCT scanner FROM own WHERE src_id NOT IN (SELECT id FROM known) OR dst_id NOT IN (SELECT id FROM known)) SELECT scanner, count(*) AS edges FROM own WHERE scanner NOT IN (SELECT scanner FROM bad) GROUP BY scanner")
def scan_output_known(s, d):
    """Link outputs, many of each scanner, may end at routes and entities that are known; any other end rejects an output whole."""
    n, e = tables.nodes(s, d), tables.edges(s, d)
    out = e.groupBy(F.concat("source_scanner", F.right("id", F.lit(2))).alias("scanner")).agg(F.collect_list(F.struct("id", F.col("src_id").alias("srcId"), F.col("dst_id").alias("dstId"), "kind")).alias("edges"))
    raw = out.select("scanner", F.to_json(F.struct(F.lit(1).alias("version"), F.struct(F.col("scanner").alias("id")).alias("scanner"), "edges")).alias("raw"))
    return protocol.merge_outputs(raw, n.where("kind in ('route', 'entity')").select("id")).edges.groupBy("scanner").agg(F.count("*").alias("edges"))


# --- links and writes

_CHAIN = "n_nationkey % 6"


@query("""WITH RECURSIVE f AS (SELECT 'src/m' || CAST(n_nationkey AS VARCHAR) || '.ts' AS path, n_nationkey AS k FROM nation),
i AS (SELECT k AS a, k + 1 AS b FROM f WHERE k % 6 < 5 UNION SELECT k, k + 2 FROM f WHERE k % 6 = 0), imp AS (SELECT a, b FROM i WHERE b IN (SELECT k FROM f)),
w(o, k, depth) AS (SELECT k, k, 0 FROM f WHERE k % 6 = 0 UNION SELECT o, b, depth + 1 FROM w JOIN imp ON a = k WHERE depth < 3)
SELECT 'edge:route:' || o || '-touches_entity-entity:' || k AS id, CAST(min(depth) AS VARCHAR) AS depth, CAST(min(depth) + 1 AS INTEGER) AS steps FROM w WHERE k % 2 = 1 OR k % 6 = 4 GROUP BY o, k""")
def link_files(s, d):
    """Routes in every sixth file of a chain of imports, some with a short cut; models are used in some files."""
    n = tables.read(s, d, "nation").select(F.col("n_nationkey").alias("k"))
    text = F.concat(F.lit("import { PrismaClient } from '@prisma/client';\nconst db = new PrismaClient();\n"), F.expr("if(k % 6 < 5, concat(\"import x from './m\", k + 1, if(k % 2 = 0, '.js', ''), \"';\n\"), '')"), F.expr("if(k % 6 = 0, concat(\"import y from '../src/m\", k + 2, \"';\n\"), '')"), F.expr("if(k % 2 = 1 or k % 6 = 4, concat('db.Model', k, '.findMany();'), 'other.model1.find();')"))
    own = n.select(F.concat(F.lit("src/m"), F.col("k").cast("string"), F.lit(".ts")).alias("path"), text.alias("text"))
    facts = scanners.scan(own, scanners.file_facts)
    node = lambda kind, name, file: n.select(F.concat(F.lit(f"{kind}:"), F.col("k").cast("string")).alias("id"), F.lit(kind).alias("kind"), F.concat(F.lit(name), F.col("k").cast("string")).alias("name"), file.alias("source_file"), "k")
    nodes = node("entity", "MODEL", F.lit(None).cast("string")).unionByName(node("route", "r", F.concat(F.lit("src/m"), F.col("k").cast("string"), F.lit(".ts"))).where("k % 6 = 0"))
    of = lambda k: F.get_json_object("properties", f"$.{k}")
    return link.link(facts, own, nodes, 3).select("id", of("depth").alias("depth"), F.json_array_length(of("tracePath")).alias("steps"))


@query(f"WITH {NODES_SQL}, {EDGES_SQL}, new AS (SELECT 'new:' || CAST(s_suppkey AS VARCHAR) AS id, 'entity:supplier:' || CAST(s_suppkey AS VARCHAR) AS src_id, CASE WHEN s_suppkey % 3 = 0 THEN 'entity:none' ELSE 'entity:nation:' || CAST(s_nationkey AS VARCHAR) END AS dst_id FROM supplier), ok AS (SELECT id FROM new WHERE dst_id IN (SELECT id FROM nodes)) SELECT id, source_scanner FROM edges WHERE source_scanner IS DISTINCT FROM 'supply' UNION ALL SELECT id, 'supply' FROM ok")
def replace_scoped(s, d):
    new = tables.read(s, d, "supplier").selectExpr("concat('new:', s_suppkey) id", "concat('entity:supplier:', s_suppkey) src_id", "if(s_suppkey % 3 = 0, 'entity:none', concat('entity:nation:', s_nationkey)) dst_id", "'relates_to' kind", "'{}' properties", "cast(null as string) source_scanner", "0L created_at")
    return store.replace_scoped(tables.edges(s, d), new, tables.nodes(s, d), "supply", 1)[0].select("id", "source_scanner")


@query(f"WITH {NODES_SQL}, {EDGES_SQL}, new AS (SELECT s_suppkey % 3 = 0 AS bad FROM supplier) SELECT (SELECT count(*) FROM new WHERE NOT bad) AS created, (SELECT count(*) FROM edges WHERE source_scanner = 'supply') AS deleted")
def replace_scoped_counts(s, d):
    new = tables.read(s, d, "supplier").selectExpr("concat('new:', s_suppkey) id", "concat('entity:supplier:', s_suppkey) src_id", "if(s_suppkey % 3 = 0, 'entity:none', concat('entity:nation:', s_nationkey)) dst_id", "'relates_to' kind", "'{}' properties", "cast(null as string) source_scanner", "0L created_at")
    _, created, deleted = store.replace_scoped(tables.edges(s, d), new, tables.nodes(s, d), "supply", 1)
    return s.createDataFrame([(created, deleted)], "created long, deleted long")


@query(f"""WITH {NODES_SQL}, {EDGES_SQL}, t AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS u, event_type FROM events) SELECT 'user ' || u || ' triggers ' || event_type AS text, 'action:trigger-' || event_type AS action_id, u AS p0, 'route:POST-/events/' || event_type AS routes FROM t WHERE event_type IN ('click', 'view', 'purchase')""")
def match_resolved(s, d):
    """Exact matches with their parameters and the routes that the action uses."""
    g = tables.graph(s, d)
    out = match.match_full(tables.steps(s, d).where("text like 'user % triggers %'"), g, search.index(g.nodes)).where("tier = 'exact'")
    return out.select("text", "action_id", F.col("parameters")["p0"].alias("p0"), F.array_join(F.transform("refs.routes", lambda r: r["id"]), ",").alias("routes"))


__all__ = ["QUERIES", "SQL"]
