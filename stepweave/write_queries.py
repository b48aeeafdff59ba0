"""Registered queries over actions' writes, the store, files, settings of a search, and what matching suggests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepweave.functions import properties
from stepweave.model import Graph
from stepweave.operators import actions, link, match, search, store
from stepweave.plans.lineage import new_dir
from stepweave.queries import _ASKED, _EXACT, _FTS, _NAME, _PATTERN, _RANKED, EDGE, NOW, query
from stepweave.source_queries import QUERIES, SQL
from stepweave.sources import files, scanners, tables
from stepweave.sources.tables import EDGES_SQL, NODES_SQL

_CLICK, _USER = "route:POST-/events/click", "entity:customer:1"

# --- actions


@query(f"""WITH {NODES_SQL}, {EDGES_SQL} SELECT id, 'agent' AS source, '{{"tag": "x", "gherkin_patterns": ["I sign in as {{string}}"]}}' AS properties, CAST({NOW} AS BIGINT) AS created_at, '' AS missing FROM (SELECT 'action:sign-in' AS id) UNION ALL
SELECT 'edge:action:sign-in-' || kind || '-' || ref, NULL, '{{}}', CAST({NOW} AS BIGINT), CASE WHEN ref IN (SELECT id FROM nodes) THEN '' ELSE 'yes' END FROM (VALUES ('uses_route', '{_CLICK}'), ('touches_entity', '{_USER}')) v(kind, ref)""")
def create_action(s, d):
    """A new action with two references that are nodes and one that is none, which gives a warning."""
    g, warned = actions.create_action(tables.graph(s, d), "Sign In!", "Sign in", ["I sign in as {string}"], {"routes": [_CLICK, "route:none"], "entities": [_USER]}, {"tag": "x"}, NOW)
    missing = "" if warned == ["route:none: no such node"] else str(warned)
    nodes = g.nodes.where("id = 'action:sign-in'").select("id", "source", "properties", "created_at", F.lit(missing).alias("missing"))
    return nodes.unionByName(g.edges.where("src_id = 'action:sign-in'").select("id", F.lit(None).cast("string").alias("source"), "properties", "created_at", F.lit(missing).alias("missing")))


@query(f"""WITH {NODES_SQL}, {EDGES_SQL} SELECT id, label, CAST(CASE WHEN id = 'action:trigger-click' THEN {NOW} ELSE {tables.CREATED} END AS BIGINT) AS updated_at FROM (SELECT id, CASE WHEN id = 'action:trigger-click' THEN 'changed' ELSE label END AS label FROM nodes WHERE kind = 'action') UNION ALL
SELECT id, kind, NULL FROM edges WHERE src_id LIKE 'action:%' AND NOT (src_id = 'action:trigger-click' AND kind = 'uses_route') UNION ALL SELECT 'edge:action:trigger-click-uses_route-route:POST-/events/view', 'uses_route', NULL""")
def update_action(s, d):
    """A label and one kind of references replaced; all else stays."""
    g, _ = actions.update_action(tables.graph(s, d), "action:trigger-click", label="changed", refs={"routes": ["route:POST-/events/view"]}, now=NOW)
    nodes = g.nodes.where("kind = 'action'").select("id", "label", "updated_at")
    return nodes.unionByName(g.edges.where("src_id like 'action:%'").select("id", F.col("kind").alias("label"), F.lit(None).cast("long").alias("updated_at")))


@query(f"WITH {NODES_SQL}, {EDGES_SQL} SELECT id FROM nodes WHERE kind = 'action' AND id <> 'action:trigger-click' UNION ALL SELECT id FROM edges WHERE src_id LIKE 'action:%' AND src_id <> 'action:trigger-click' AND dst_id <> 'action:trigger-click'")
def delete_action(s, d):
    g = actions.delete_action(tables.graph(s, d), "action:trigger-click")
    return g.nodes.where("kind = 'action'").select("id").unionByName(g.edges.where("src_id like 'action:%'").select("id"))


@query(f"WITH {NODES_SQL}, {EDGES_SQL} SELECT {', '.join(EDGE)} FROM edges WHERE NOT (src_id = 'entity:supplier:1' AND kind = 'relates_to')")
def delete_from(s, d):
    return store.delete_from(tables.edges(s, d), "entity:supplier:1", "relates_to").select(*EDGE)


@query(f"WITH {NODES_SQL}, {EDGES_SQL} SELECT (SELECT count(*) FROM edges WHERE src_id = 'entity:supplier:1' AND kind = 'relates_to') AS from_node, (SELECT count(*) FROM edges WHERE source_scanner = 'geo') AS by_scanner")
def delete_counts(s, d):
    e = tables.edges(s, d)
    return s.createDataFrame([(store.count_from(e, "entity:supplier:1", "relates_to"), store.count_by_scanner(e, "geo"))], "from_node long, by_scanner long")


@query(f"WITH {NODES_SQL} SELECT id, kind FROM nodes UNION ALL SELECT 'entity:order:' || CAST(o_orderkey AS VARCHAR), 'entity' FROM orders")
def insert_nodes(s, d):
    n = tables.nodes(s, d)
    new = tables.read(s, d, "orders").selectExpr("concat('entity:order:', o_orderkey) id", "'entity' kind", "'o' name", "'' label", "'{}' properties", "'scan' source", "cast(null as string) source_file", "1L created_at", "1L updated_at", "cast(null as string) scan_hash")
    return store.insert_node(n, new).select("id", "kind")


@query(f"""WITH {NODES_SQL}, {EDGES_SQL}, new AS (SELECT id, src_id, CASE WHEN src_id = 'entity:supplier:2' THEN 'entity:none' ELSE dst_id END AS dst_id FROM edges WHERE kind = 'field_relation'), ok AS (SELECT id FROM new WHERE dst_id IN (SELECT id FROM nodes))
SELECT id, CAST({tables.CREATED} AS BIGINT) AS created_at FROM edges WHERE id NOT IN (SELECT id FROM ok) UNION ALL SELECT id, CAST({NOW} AS BIGINT) FROM ok""")
def replace_edges(s, d):
    e = tables.edges(s, d)
    new = e.where("kind = 'field_relation'").withColumn("dst_id", F.when(F.col("src_id") == "entity:supplier:2", "entity:none").otherwise(F.col("dst_id")))
    return store.replace_edges(e, new, tables.nodes(s, d), NOW).select("id", "created_at")


# --- the store


@query(f"WITH {NODES_SQL}, {EDGES_SQL} SELECT kind, count(*) AS cnt, 1 AS versions FROM nodes GROUP BY kind UNION ALL SELECT kind, count(*), 1 FROM edges GROUP BY kind")
def store_round_trip(s, d):
    """A graph written as a store's version and read back; a faulty one after it changes nothing."""
    own = store.GraphStore(s, new_dir(s, "store"))
    own.init()
    g = tables.graph(s, d)
    own.write(g)
    try:
        own.write(Graph(g.nodes.withColumn("source", F.lit("robot")), g.edges))
    except ValueError:
        g = own.init()
    versions = own.schema_versions()
    count = lambda df: df.groupBy("kind").agg(F.count("*").alias("cnt")).withColumn("versions", F.lit(versions))
    return count(g.nodes).unionByName(count(g.edges))


# --- files and facts


def _paths(s, d) -> DataFrame:
    """files(path): one per event and per nation, in folders, some of them tests."""
    n = tables.read(s, d, "nation").select(F.expr("concat(elt(cast(n_nationkey % 5 as int) + 1, 'src/', 'dist/', 'dist2/', 'src/__tests__/', 'a/b/c/'), lower(n_name), elt(cast(n_nationkey % 4 as int) + 1, '.ts', '.js', '.spec.ts', '.tsx'))").alias("path"))
    return n.unionByName(n)


_PATHS = "p AS (SELECT CASE CAST(n_nationkey AS INTEGER) % 5 WHEN 0 THEN 'src/' WHEN 1 THEN 'dist/' WHEN 2 THEN 'dist2/' WHEN 3 THEN 'src/__tests__/' ELSE 'a/b/c/' END || lower(n_name) || CASE CAST(n_nationkey AS INTEGER) % 4 WHEN 0 THEN '.ts' WHEN 1 THEN '.js' WHEN 2 THEN '.spec.ts' ELSE '.tsx' END AS path FROM nation)"


@query(f"WITH {_PATHS} SELECT DISTINCT path FROM p WHERE (path LIKE '%.ts' OR path LIKE 'src/%.js' AND path NOT LIKE 'src/%/%') AND path NOT LIKE 'dist/%'")
def glob_files(s, d):
    return files.file_list(files.kept(_paths(s, d), ["**/*.ts", "src/*.js"], ["dist"]))


@query(f"WITH {_PATHS} SELECT DISTINCT path, regexp_matches('/' || path, '\\.spec\\.|\\.test\\.|__tests__|/tests?/') AS test FROM p")
def test_files(s, d):
    return _paths(s, d).distinct().select("path", F.concat(F.lit("/"), "path").rlike(scanners.TEST_FILE).alias("test"))


@query("""SELECT 'f' || n_nationkey || '.ts' AS path, 'import' AS what, './m' || (n_nationkey + 1) AS name FROM nation UNION ALL SELECT 'f' || n_nationkey || '.ts', 'access', 'model' || (n_nationkey % 7) FROM nation WHERE n_nationkey % 3 > 0
UNION ALL SELECT 'f' || n_nationkey || '.ts', 'handler', NULL FROM nation WHERE n_nationkey % 4 = 0 UNION ALL SELECT 'f' || n_nationkey || '.ts', 'import', '@prisma/client' FROM nation WHERE n_nationkey % 3 = 2""")
def file_facts(s, d):
    """What files import and use: a client declared, or only its package imported."""
    text = F.expr("""concat("import { a } from './m", n_nationkey + 1, "'; // import './no'\n", if(n_nationkey % 3 = 1, 'const db = new PrismaClient();\n', if(n_nationkey % 3 = 2, "import type { X } from '@prisma/client';\n", '')), if(n_nationkey % 3 = 1, 'db', 'prisma'), '.Model', n_nationkey % 7, '.findMany({ x: `${y}` });\n', if(n_nationkey % 4 = 0, 'os.a.handler(f)', ''))""")
    own = tables.read(s, d, "nation").select(F.format_string("f%d.ts", F.col("n_nationkey").cast("int")).alias("path"), text.alias("text"))
    return scanners.scan(own, scanners.file_facts).select("path", "what", "name")


@query("""WITH n AS (SELECT n_nationkey AS k FROM nation) SELECT 'M' || k AS model, 'id' AS name, 'Int' AS kind, 'true,false,true,false,true' AS flags, CAST(k AS VARCHAR) AS fallback FROM n
UNION ALL SELECT 'M' || k, 'tags', 'Tag', 'false,true,false,false,false', NULL FROM n UNION ALL SELECT 'M' || k, 'mail', 'String', CASE WHEN k % 2 = 0 THEN 'false' ELSE 'true' END || ',false,false,true,false', NULL FROM n""")
def entity_fields(s, d):
    """(required, list, id, unique, default) of each field of each model."""
    n = tables.read(s, d, "nation").select(F.lit("schema.prisma").alias("path"), F.expr("concat('model M', n_nationkey, ' {\n  id Int @id @default(', n_nationkey, ')\n  tags Tag[]\n  mail String', if(n_nationkey % 2 = 0, '?', ''), ' @unique\n  @@index([mail])\n\n  // x Int\n}\n')").alias("text"))
    rows = scanners.scan(n, scanners.prisma_entities).where("what = 'node'")
    field = F.explode(F.from_json(F.get_json_object("properties", "$.fields"), "array<struct<name:string,type:string,isRequired:boolean,isList:boolean,isId:boolean,isUnique:boolean,hasDefault:boolean,defaultValue:string>>")).alias("f")
    own = rows.select("name", field)
    return own.select(F.col("name").alias("model"), F.col("f.name").alias("name"), F.col("f.type").alias("kind"), F.concat_ws(",", *[F.col(f"f.{c}").cast("string") for c in ("isRequired", "isList", "isId", "isUnique", "hasDefault")]).alias("flags"), F.col("f.defaultValue").alias("fallback"))


@query(f"WITH {NODES_SQL}, u AS (SELECT DISTINCT user_id AS k FROM events) SELECT 'f' || k AS path, 'entity:customer:' || k AS entity FROM u WHERE 'entity:customer:' || k IN (SELECT id FROM nodes)")
def entity_lookup(s, d):
    """Models to entities by their names in lower case."""
    facts = tables.read(s, d, "events").select("user_id").distinct().join(tables.read(s, d, "customer"), F.col("user_id") == F.col("c_custkey"), "left")
    facts = facts.select(F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("path"), F.lit("access").alias("what"), F.lower(F.coalesce("c_name", F.lit("none"))).alias("name"))
    return link.entities(facts, tables.nodes(s, d).where("id like 'entity:customer:%'"))


@query(f"WITH {NODES_SQL} SELECT id, properties, CASE WHEN properties LIKE '%gherkin%' THEN 'user {{int}} triggers ' || substr(id, 16) END AS patterns FROM nodes WHERE kind IN ('action', 'route')")
def properties_round_trip(s, d):
    own = tables.nodes(s, d).where("kind in ('action', 'route')")
    return own.select("id", properties.encode(properties.decode(F.col("properties"))).alias("properties"), F.array_join(properties.strings(F.col("properties"), "gherkin_patterns"), ",").alias("patterns"))


# --- search and matching


def _fts_leaf(where: str) -> str:
    return f"""WITH {NODES_SQL}, own AS (SELECT id, regexp_extract_all(lower(name), '[\\p{{L}}\\p{{N}}]+') AS a, regexp_extract_all(lower(label), '[\\p{{L}}\\p{{N}}]+') AS b, regexp_extract_all(lower(properties), '[\\p{{L}}\\p{{N}}]+') AS c FROM nodes),
f AS (SELECT id, len(a) + len(b) + len(c) AS dl, {where} AS f FROM own), st AS (SELECT count(*) AS n, avg(dl) AS average, sum(CASE WHEN f > 0 THEN 1 ELSE 0 END) AS df FROM f)
SELECT id, round(-(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END * (f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / average)))), 8) AS rank FROM f, st WHERE f > 0 ORDER BY rank, id LIMIT 50"""


def _found(s, d, q: str) -> DataFrame:
    return search.search(search.index(tables.nodes(s, d)), q).select("id", F.round("rank", 8).alias("rank"))


@query(_fts_leaf("len(list_filter(list_concat(a, b, c), lambda w: starts_with(w, 'even')))"))
def fts_prefix(s, d):
    return _found(s, d, "even*")


@query(_fts_leaf("len(list_filter(b, lambda w: w = 'post'))"))
def fts_column(s, d):
    return _found(s, d, "label:post")


@query(_fts_leaf("len(list_filter(range(1, len(a)), lambda i: a[i] = 'events' AND a[i + 1] = 'click')) + len(list_filter(range(1, len(b)), lambda i: b[i] = 'events' AND b[i + 1] = 'click')) + len(list_filter(range(1, len(c)), lambda i: c[i] = 'events' AND c[i + 1] = 'click'))"))
def fts_phrase(s, d):
    return _found(s, d, '"events click"')


@query(f"""WITH {_FTS}, {_EXACT}, {_ASKED}, fuzzy AS (SELECT DISTINCT text FROM ({_RANKED.format('action', 10)})), none AS (SELECT text FROM t WHERE text NOT IN (SELECT text FROM exact) AND text NOT IN (SELECT text FROM fuzzy)),
refs AS ({' UNION ALL '.join(f"SELECT text, '{k}' AS kind, id, rank FROM ({_RANKED.format(k, 5)})" for k in ("route", "entity", "page"))})
SELECT text, {_NAME} AS name, {_PATTERN} AS pattern, {', '.join(f"coalesce((SELECT string_agg(id, ',' ORDER BY rank, id) FROM refs r WHERE r.text = none.text AND r.kind = '{k}'), '') AS {c}" for k, c in (("route", "routes"), ("entity", "entities"), ("page", "pages")))} FROM none""")
def match_suggestions(s, d):
    """What is suggested for texts that no action fits, with the nodes to refer to."""
    g = tables.graph(s, d)
    out = match.match_full(tables.steps(s, d), g, search.index(g.nodes)).where("tier = 'suggest'")
    return out.select("text", F.col("suggestion.name").alias("name"), F.col("suggestion.patterns")[0].alias("pattern"), *[F.array_join(f"suggestion.{c}", ",").alias(c) for c in ("routes", "entities", "pages")])


__all__ = ["QUERIES", "SQL"]
