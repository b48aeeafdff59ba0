"""Registered queries over the application graph, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.functions import text as fn
from stepweave.functions.text import ACCENTED, KEYWORDS, PLAIN, STOP_WORDS
from stepweave.operators import actions, listing, match, search, store, traverse
from stepweave.sources import tables
from stepweave.sources.tables import EDGES_SQL, NODES_SQL, STEPS_SQL

QUERIES: dict = {}
SQL: dict[str, str] = {}
REGION = "permission:AFRICA"
NODE = ["id", "kind", "name", "label", "properties", "source", "source_file"]
EDGE = ["id", "src_id", "dst_id", "kind", "source_scanner"]
NOW = 1_800_000_000
KNOWN_KINDS = "('route', 'entity', 'page', 'action', 'permission')"


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _nodes(s: SparkSession, d: str) -> DataFrame:
    return tables.nodes(s, d)


# --- lookups, listings, counts


@query(f"WITH {NODES_SQL}, k(kind) AS (VALUES ('route'), ('entity'), ('page'), ('action'), ('permission')) SELECT k.kind AS kind, CAST(least(count(n.id), 100000) AS BIGINT) AS cnt FROM k LEFT JOIN nodes n ON n.kind = k.kind GROUP BY k.kind")
def stats_by_kind(s, d):
    return listing.stats_by_kind(_nodes(s, d))


@query(f"WITH {NODES_SQL}, c AS (SELECT kind, least(count(*), 100000) AS n FROM nodes GROUP BY kind) SELECT CAST(sum(n) AS BIGINT) AS total FROM c")
def stats_total(s, d):
    return listing.stats_total(_nodes(s, d))


@query(f"WITH {NODES_SQL} SELECT {', '.join(NODE)} FROM nodes WHERE id = 'entity:customer:1'")
def get_node(s, d):
    return listing.get_node(_nodes(s, d), "entity:customer:1").select(*NODE)


@query(f"WITH {NODES_SQL} SELECT {', '.join(NODE)} FROM nodes WHERE kind = 'entity' ORDER BY id LIMIT 1000")
def nodes_by_kind(s, d):
    return listing.nodes_by_kind(_nodes(s, d), "entity").select(*NODE)


@query(f"WITH {NODES_SQL} SELECT {', '.join(NODE)} FROM nodes WHERE kind = 'entity' ORDER BY id LIMIT 20 OFFSET 40")
def nodes_by_kind_page(s, d):
    return listing.nodes_by_kind(_nodes(s, d), "entity", 20, 40).select(*NODE)


_LISTED = "SELECT id, name, label, json_extract_string(properties, '$.method') AS method, CAST(json_array_length(json_extract(properties, '$.fields')) AS VARCHAR) AS fields, json_extract_string(properties, '$.path') AS path, coalesce(source_file, source) AS source FROM nodes WHERE kind = "


@query(f"WITH {NODES_SQL} {_LISTED} 'entity' ORDER BY id LIMIT 1000")
def node_listing(s, d):
    return listing.node_listing(_nodes(s, d), "entity")


@query(f"WITH {NODES_SQL} {_LISTED} 'route' ORDER BY id LIMIT 1000")
def node_listing_routes(s, d):
    return listing.node_listing(_nodes(s, d), "route")


@query(f"WITH {NODES_SQL} SELECT id, kind, name, source_file FROM nodes WHERE kind IN ('route', 'entity')")
def node_refs(s, d):
    return listing.node_refs(_nodes(s, d), ["route", "entity"])


@query(f"WITH {NODES_SQL}, {EDGES_SQL} SELECT {', '.join(EDGE)} FROM edges WHERE src_id = 'entity:supplier:1'")
def edges_from(s, d):
    return listing.edges_from(tables.edges(s, d), "entity:supplier:1").select(*EDGE)


@query(f"WITH {NODES_SQL}, {EDGES_SQL} SELECT {', '.join(EDGE)} FROM edges WHERE dst_id = 'entity:nation:3' AND kind = 'field_relation'")
def edges_to(s, d):
    return listing.edges_to(tables.edges(s, d), "entity:nation:3", "field_relation").select(*EDGE)


# --- traversal

_REACH = f"""WITH RECURSIVE {NODES_SQL}, {EDGES_SQL}, both_ways AS (SELECT src_id AS a, dst_id AS b FROM edges UNION SELECT dst_id, src_id FROM edges),
walk(id, depth) AS (SELECT id, 0 FROM nodes WHERE id = '{REGION}' UNION SELECT b, depth + 1 FROM walk JOIN both_ways ON a = id WHERE depth < 2),
reach AS (SELECT id, min(depth) AS depth FROM walk GROUP BY id)"""


@query(f"{_REACH} SELECT id, CAST(depth AS INTEGER) AS depth FROM reach")
def reachable_depth(s, d):
    return traverse.reachable(tables.graph(s, d), REGION)


@query(f"{_REACH} SELECT {', '.join('n.' + c for c in NODE)} FROM nodes n WHERE n.id IN (SELECT id FROM reach)")
def connected_nodes(s, d):
    return traverse.connected(tables.graph(s, d), REGION).nodes.select(*NODE)


@query(f"{_REACH} SELECT {', '.join('e.' + c for c in EDGE)} FROM edges e WHERE e.src_id IN (SELECT id FROM reach) AND e.dst_id IN (SELECT id FROM reach)")
def connected_edges(s, d):
    return traverse.connected(tables.graph(s, d), REGION).edges.select(*EDGE)


# --- actions

_REFS = f"WITH {NODES_SQL}, {EDGES_SQL}, refs AS (SELECT e.src_id AS action_id, e.kind AS ref_kind, e.dst_id AS ref_id FROM edges e JOIN nodes a ON a.id = e.src_id AND a.kind = 'action' JOIN nodes t ON t.id = e.dst_id WHERE e.kind IN ('uses_route', 'touches_entity', 'on_page'))"


@query(f"{_REFS} SELECT * FROM refs")
def action_refs(s, d):
    return actions.action_refs(tables.graph(s, d))


@query(f"{_REFS} SELECT a.id AS action_id, count(CASE WHEN ref_kind = 'uses_route' THEN 1 END) AS routes, count(CASE WHEN ref_kind = 'touches_entity' THEN 1 END) AS entities, count(CASE WHEN ref_kind = 'on_page' THEN 1 END) AS pages FROM nodes a LEFT JOIN refs ON a.id = action_id WHERE a.kind = 'action' GROUP BY a.id")
def action_ref_counts(s, d):
    return actions.action_ref_counts(tables.graph(s, d))


@query(f"WITH {NODES_SQL}, {EDGES_SQL} SELECT id FROM (SELECT id FROM nodes WHERE kind = 'action' ORDER BY id LIMIT 10000) a WHERE id NOT IN (SELECT src_id FROM edges)")
def audit_orphans(s, d):
    return actions.orphans(tables.graph(s, d))


@query(f"WITH {NODES_SQL}, {EDGES_SQL}, kept AS (SELECT id FROM nodes WHERE id <> 'route:POST-/events/view'), own AS (SELECT id FROM kept WHERE id LIKE 'action:%' ORDER BY id LIMIT 10000) SELECT src_id AS action_id, string_agg(DISTINCT dst_id, ',' ORDER BY dst_id) AS missing FROM edges WHERE src_id IN (SELECT id FROM own) AND dst_id NOT IN (SELECT id FROM kept) GROUP BY src_id")
def audit_stale(s, d):
    g = tables.graph(s, d)
    return actions.stale(type(g)(g.nodes.where("id <> 'route:POST-/events/view'"), g.edges)).select("action_id", F.array_join("missing", ",").alias("missing"))


@query(f"{_REFS} SELECT a.id AS action_id, coalesce(string_agg(CASE WHEN ref_kind = 'uses_route' THEN ref_id END, ',' ORDER BY ref_id), '') AS routes, coalesce(string_agg(CASE WHEN ref_kind = 'touches_entity' THEN ref_id END, ',' ORDER BY ref_id), '') AS entities, coalesce(string_agg(CASE WHEN ref_kind = 'on_page' THEN ref_id END, ',' ORDER BY ref_id), '') AS pages FROM nodes a JOIN refs ON a.id = action_id GROUP BY a.id")
def resolved_refs(s, d):
    ids = lambda c: F.array_join(F.transform(c, lambda x: x["id"]), ",").alias(c)
    return actions.resolved_refs(tables.graph(s, d)).select("action_id", ids("routes"), ids("entities"), ids("pages"))


@query(f"WITH {NODES_SQL} SELECT count(*) AS total FROM (SELECT id FROM nodes WHERE kind = 'action' ORDER BY id LIMIT 10000)")
def audit_total(s, d):
    return actions.audit_total(tables.graph(s, d))


@query(f"WITH {NODES_SQL} SELECT n.id AS action_id, 'edge:' || n.id || '-uses_route-' || r.id AS edge_id FROM nodes n JOIN nodes r ON r.id = 'route:POST-/events/' || substr(n.id, 16) WHERE n.id LIKE 'action:trigger-%'")
def action_edge_ids(s, d):
    n = _nodes(s, d)
    own = n.where("id like 'action:trigger-%'").select(F.col("id").alias("action_id"), F.concat(F.lit("route:POST-/events/"), F.expr("substr(id, 16)")).alias("ref"))
    return own.join(n.select(F.col("id").alias("ref")), "ref").select("action_id", actions.edge_id(F.col("action_id"), F.lit("uses_route"), F.col("ref")).alias("edge_id"))


# --- search

_TOKENS = f"regexp_extract_all(regexp_replace(translate(lower(concat_ws(' ', name, label, properties)), '{ACCENTED}', '{PLAIN}'), '\\p{{Mn}}', '', 'g'), '[\\p{{L}}\\p{{N}}]+')"
_FTS = f"""{NODES_SQL}, docs AS (SELECT id, kind, {_TOKENS} AS tokens FROM nodes),
stats AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len(tokens)) AS average FROM docs),
words AS (SELECT id, kind, len(tokens) AS dl, unnest(tokens) AS term FROM docs),
postings AS (SELECT id, kind, dl, term, count(*) AS tf FROM words GROUP BY id, kind, dl, term),
dfs AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
idfs AS (SELECT term, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END AS idf FROM dfs, stats),
scored AS (SELECT id, kind, p.term AS term, idf * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / average))) AS w FROM postings p JOIN idfs i ON i.term = p.term, stats)"""
_OR = "SELECT id, round(-sum(w), 8) AS rank FROM scored WHERE term IN ({}) {} GROUP BY id ORDER BY rank, id LIMIT 50"


def _search(s, d, q, kind=None):
    return search.search(search.index(_nodes(s, d)), q, kind).select("id", F.round("rank", 8).alias("rank"))


@query(f"WITH {_FTS} {_OR.format(chr(39) + 'nation' + chr(39) + ', ' + chr(39) + 'purchase' + chr(39) + ', ' + chr(39) + 'click' + chr(39), '')}")
def fts_search(s, d):
    return _search(s, d, "purchase OR click OR nation")


@query(f"WITH {_FTS} {_OR.format(chr(39) + 'events' + chr(39), 'AND kind = ' + chr(39) + 'route' + chr(39))}")
def fts_search_kind(s, d):
    return _search(s, d, "events", "route")


@query(f"WITH {_FTS} {_OR.format(chr(39) + 'trigger' + chr(39), 'AND kind = ' + chr(39) + 'action' + chr(39))}")
def fts_actions(s, d):
    return _search(s, d, "trigger", "action")


@query(f"WITH {_FTS}, a AS (SELECT id, sum(w) AS w FROM scored WHERE term = 'post' GROUP BY id), b AS (SELECT id, sum(w) AS w FROM scored WHERE term = 'click' GROUP BY id) SELECT a.id AS id, round(-(a.w), 8) AS rank FROM a LEFT JOIN b ON a.id = b.id WHERE b.id IS NULL ORDER BY rank, id LIMIT 50")
def fts_search_not(s, d):
    return _search(s, d, "post NOT click")


_ACCENTS = "SELECT id, kind, name || ' \u010daj ' || substr('a\u0303\u01e7\u011f\u00e9', CAST(length(id) % 4 AS INTEGER) + 1, 2) AS name, label, properties FROM nodes"


@query(f"WITH {_FTS.replace('docs AS (SELECT id', 'marked AS (' + _ACCENTS + '), docs AS (SELECT id').replace('AS tokens FROM nodes)', 'AS tokens FROM marked)')} {_OR.format(chr(39) + 'caj' + chr(39) + ', ' + chr(39) + 'ge' + chr(39), '')}")
def fts_search_accents(s, d):
    n = _nodes(s, d)
    marked = n.withColumn("name", F.concat("name", F.lit(" \u010daj "), F.expr("substr('a\u0303\u01e7\u011f\u00e9', cast(length(id) % 4 as int) + 1, 2)")))
    return search.search(search.index(marked), "\u010daj OR g\u00e9").select("id", F.round("rank", 8).alias("rank"))


@query(f"WITH {_FTS.replace('docs AS (SELECT id', 'changed AS (SELECT id, kind, CASE WHEN id LIKE ' + chr(39) + 'entity:nation:1%' + chr(39) + ' THEN ' + chr(39) + 'realm' + chr(39) + ' ELSE name END AS name, label, properties FROM nodes WHERE kind <> ' + chr(39) + 'permission' + chr(39) + '), docs AS (SELECT id').replace('AS tokens FROM nodes)', 'AS tokens FROM changed)')} {_OR.format(chr(39) + 'realm' + chr(39) + ', ' + chr(39) + 'china' + chr(39) + ', ' + chr(39) + 'asia' + chr(39), '')}")
def fts_index_update(s, d):
    n = _nodes(s, d)
    new = n.where("kind <> 'permission'").withColumn("name", F.when(F.col("id").startswith("entity:nation:1"), "realm").otherwise(F.col("name")))
    ix = search.update(search.index(n), new, n.where("kind = 'permission' or id like 'entity:nation:1%'").select("id"))
    return search.search(ix, "realm OR china OR asia").select("id", F.round("rank", 8).alias("rank"))


# --- text functions


def _words_sql(c: str) -> str:
    stop = ", ".join(f"'{w}'" for w in (*KEYWORDS, *STOP_WORDS))
    return f"list_filter(list_transform(regexp_split_to_array(lower({c}), '\\s+'), lambda w: regexp_replace(w, '[^a-z0-9]', '', 'g')), lambda w: w <> '' AND w NOT IN ({stop}))"


_TEXTS = f"WITH {STEPS_SQL}, t AS (SELECT DISTINCT text FROM steps UNION SELECT DISTINCT chr(9) || 'Given  ' || text || chr(10) FROM steps)"


def _texts(s, d) -> DataFrame:
    own = tables.steps(s, d).select("text").distinct()
    return own.unionByName(own.select(F.concat(F.lit("\tGiven  "), "text", F.lit("\n")).alias("text"))).distinct()


@query(f"{_TEXTS} SELECT text, array_to_string({_words_sql('text')}, ' ') AS words FROM t")
def tokenize(s, d):
    return _texts(s, d).select("text", F.array_join(fn.query_words(F.col("text")), " ").alias("words"))


@query(f"WITH {NODES_SQL} SELECT id, regexp_replace(regexp_replace(lower(trim(name)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM nodes")
def slugify(s, d):
    return _nodes(s, d).select("id", fn.slugify(F.col("name")).alias("slug"))


_NAME = """coalesce(nullif(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g')), '^(given|when|then|and|but) ', ''), '"[^"]*"', '', 'g'), '\\b[0-9]+\\b', '', 'g'), '\\s+', ' ', 'g')), ''), 'unnamed action')"""
_PATTERN = """regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '^(?i)(given|when|then|and|but) ', ''), '"[^"]*"', '{string}', 'g'), '\\b[0-9]+\\b', '{int}', 'g')"""


@query(f"{_TEXTS} SELECT text, {_NAME} AS name FROM t")
def suggest_name(s, d):
    return _texts(s, d).select("text", fn.action_name(F.col("text")).alias("name"))


@query(f"{_TEXTS} SELECT text, {_PATTERN} AS pattern FROM t")
def suggest_pattern(s, d):
    return _texts(s, d).select("text", fn.step_pattern(F.col("text")).alias("pattern"))


_FILES = "f AS (SELECT DISTINCT CASE CAST(n_nationkey AS INTEGER) % 4 WHEN 0 THEN 'src/routes/' WHEN 1 THEN 'backend/' WHEN 2 THEN 'api/' ELSE 'lib/' END || lower(n_name) || CASE CAST(n_nationkey AS INTEGER) % 3 WHEN 0 THEN '.ts.routes.ts' WHEN 1 THEN '/index.js' ELSE '.contract.ts' END AS path FROM nation)"


@query(f"""WITH {_FILES} SELECT path, coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(path, '^(src/|backend/|server/|app/)?(routes/|routers/|api/)?', ''), '\\.(routes|router)\\.(ts|js|mjs|cjs)$', ''), '\\.(ts|js|mjs|cjs)$', ''), '/index$', ''), ''), path) AS router, regexp_replace(regexp_replace(regexp_replace(path, '^(src/|backend/|contracts/|routes/)+', ''), '\\.(ts|js)$', ''), '\\.(contract|routes|router)$', '') AS contract FROM f""")
def derive_router_name(s, d):
    n = tables.read(s, d, "nation")
    path = F.concat(F.expr("case n_nationkey % 4 when 0 then 'src/routes/' when 1 then 'backend/' when 2 then 'api/' else 'lib/' end"), F.lower("n_name"), F.expr("case n_nationkey % 3 when 0 then '.ts.routes.ts' when 1 then '/index.js' else '.contract.ts' end"))
    return n.select(path.alias("path")).distinct().select("path", fn.router_name(F.col("path")).alias("router"), fn.contract_name(F.col("path")).alias("contract"))


@query("""WITH p AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 5 = 0 THEN NULL WHEN n_nationkey % 5 = 1 THEN '' ELSE '/' || lower(r_name) || CASE WHEN n_nationkey % 2 = 0 THEN '//' ELSE '' END END AS parent, CASE n_nationkey % 3 WHEN 0 THEN '/' || n_name WHEN 1 THEN n_name ELSE NULL END AS local, n_nationkey % 7 = 0 AS idx FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT CAST(k AS INTEGER) AS k, CASE WHEN idx OR coalesce(local, '') = '' THEN coalesce(parent, '/') WHEN starts_with(local, '/') THEN local WHEN coalesce(parent, '') = '' THEN local ELSE regexp_replace(parent, '/$', '') || '/' || local END AS path FROM p""")
def compose_path(s, d):
    n = tables.read(s, d, "nation").join(tables.read(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    p = n.select(F.col("n_nationkey").alias("k"), F.expr("case when n_nationkey % 5 = 0 then null when n_nationkey % 5 = 1 then '' else concat('/', lower(r_name), if(n_nationkey % 2 = 0, '//', '')) end").alias("parent"), F.expr("case n_nationkey % 3 when 0 then concat('/', n_name) when 1 then n_name end").alias("local"), F.expr("n_nationkey % 7 = 0").alias("idx"))
    return p.select("k", fn.compose_path(F.col("parent"), F.col("local"), F.col("idx")).alias("path"))


# --- matching

_PATTERNS = "patterns AS (SELECT 'action:trigger-' || event_type AS action_id, 0 AS pattern_no, 'user {int} triggers ' || event_type AS pattern, '^user (-?[0-9]+) triggers ' || event_type || '$' AS regex FROM types WHERE event_type IN ('click', 'view', 'purchase'))"
_EXACT = f"{STEPS_SQL}, t AS (SELECT DISTINCT text FROM steps), {_PATTERNS}, exact AS (SELECT text, min(action_id) AS action_id FROM t JOIN patterns ON regexp_matches(text, regex) GROUP BY text)"


@query(f"WITH {NODES_SQL}, {_PATTERNS} SELECT action_id, CAST(pattern_no AS INTEGER) AS pattern_no, pattern FROM patterns")
def explode_patterns(s, d):
    return match.explode_patterns(_nodes(s, d))


@query(f"WITH {NODES_SQL}, {_EXACT} SELECT text, action_id FROM exact")
def match_exact(s, d):
    return match.match_exact(tables.steps(s, d), match.explode_patterns(_nodes(s, d))).select("text", "action_id")


@query(f"WITH {NODES_SQL}, {_EXACT} SELECT text, regexp_extract(text, '^user (-?[0-9]+) triggers', 1) AS p0 FROM exact")
def match_params(s, d):
    return match.match_exact(tables.steps(s, d), match.explode_patterns(_nodes(s, d))).select("text", F.col("params")["p0"].alias("p0"))


_ASKED = f"asked AS (SELECT DISTINCT text, unnest({_words_sql('text')}) AS term FROM t)"
_RANKED = "SELECT text, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY rank, id) AS k FROM (SELECT text, id, round(-sum(w), 8) AS rank FROM asked a JOIN scored s ON s.term = a.term WHERE kind = '{}' GROUP BY text, id)) WHERE k <= {}"


@query(f"WITH {_FTS}, {_EXACT}, {_ASKED} {_RANKED.format('action', 10)}")
def match_fuzzy(s, d):
    return match.match_fuzzy(tables.steps(s, d), search.index(_nodes(s, d)))


@query(f"WITH {_FTS}, {_EXACT}, {_ASKED} " + " UNION ALL ".join(f"SELECT text, '{k}' AS kind, id, rank FROM ({_RANKED.format(k, 5)})" for k in ("route", "entity", "page")))
def suggest_refs(s, d):
    return match.suggest_refs(tables.steps(s, d), search.index(_nodes(s, d)))


_TIERS = f"{_FTS}, {_EXACT}, {_ASKED}, fuzzy AS (SELECT text, count(*) AS candidates, min_by(id, k) AS best FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY rank, id) AS k FROM ({_RANKED.format('action', 10)})) GROUP BY text), tiers AS (SELECT t.text AS text, CASE WHEN e.action_id IS NOT NULL THEN 'exact' WHEN f.best IS NOT NULL THEN 'fuzzy' ELSE 'suggest' END AS tier, coalesce(e.action_id, f.best) AS action_id, CASE WHEN e.action_id IS NULL THEN coalesce(f.candidates, 0) ELSE 0 END AS candidates FROM t LEFT JOIN exact e ON e.text = t.text LEFT JOIN fuzzy f ON f.text = t.text)"


def _tiers(s, d) -> DataFrame:
    n = _nodes(s, d)
    return match.match_tiers(tables.steps(s, d), match.explode_patterns(n), search.index(n))


@query(f"WITH {_TIERS} SELECT text, tier, action_id, CAST(candidates AS BIGINT) AS candidates, CASE WHEN tier = 'suggest' THEN {_NAME} END AS name, CASE WHEN tier = 'suggest' THEN {_PATTERN} END AS pattern FROM tiers")
def match_tiers(s, d):
    return _tiers(s, d)


@query(f"WITH {_TIERS} SELECT file, count(*) AS steps, count(CASE WHEN tier = 'exact' THEN 1 END) AS exact, round(count(CASE WHEN tier = 'exact' THEN 1 END) * 100.0 / count(*), 6) AS pct FROM steps JOIN tiers ON steps.text = tiers.text GROUP BY file")
def coverage_by_file(s, d):
    return match.coverage_by_file(tables.steps(s, d), _tiers(s, d))


@query(f"WITH {_TIERS} SELECT count(*) AS steps, count(CASE WHEN tier = 'exact' THEN 1 END) AS exact, count(CASE WHEN tier = 'fuzzy' THEN 1 END) AS fuzzy, count(CASE WHEN tier = 'suggest' THEN 1 END) AS suggest, round(count(CASE WHEN tier = 'exact' THEN 1 END) * 100.0 / count(*), 6) AS pct FROM steps JOIN tiers ON steps.text = tiers.text")
def coverage_total(s, d):
    return match.coverage_total(tables.steps(s, d), _tiers(s, d))


@query("SELECT event_id, CASE CAST(event_id AS INTEGER) % 5 WHEN 0 THEN 'Given' WHEN 1 THEN 'When' WHEN 2 THEN 'Then' WHEN 3 THEN 'And' END AS keyword, 'user ' || CAST(user_id AS VARCHAR) || ' triggers ' || event_type AS text FROM events WHERE event_id % 5 < 4")
def parse_steps(s, d):
    e = tables.read(s, d, "events")
    lines = e.select("event_id", F.concat(F.expr("elt(cast(event_id % 5 as int) + 1, '  Given ', '\\t When ', 'Then ', '  And ', '  * ')"), F.lit("user "), F.col("user_id").cast("string"), F.lit(" triggers "), "event_type", F.lit(" \t ")).alias("value"))
    return match.parse_steps(lines).select("event_id", "keyword", "text")


# --- validation and writes

_SCAN = "scan_nodes AS (SELECT 'route:' || event_type AS id, CASE WHEN event_id % 97 = 0 THEN 'widget' ELSE 'route' END AS kind, CASE WHEN event_id % 89 = 0 THEN '' ELSE event_type END AS name, CAST(event_id AS VARCHAR) AS label, event_id AS seq FROM events UNION ALL SELECT 'page:' || CAST(page_id AS VARCHAR), 'page', url, url, page_id FROM pages)"


def _scan_nodes(s, d) -> DataFrame:
    e = tables.read(s, d, "events").selectExpr("concat('route:', event_type) id", "if(event_id % 97 = 0, 'widget', 'route') kind", "if(event_id % 89 = 0, '', event_type) name", "cast(event_id as string) label", "event_id seq")
    return e.unionByName(tables.read(s, d, "pages").selectExpr("concat('page:', page_id) id", "'page' kind", "url name", "url label", "page_id seq"))


@query(f"WITH {_SCAN}, twice AS (SELECT id FROM scan_nodes GROUP BY id HAVING count(*) > 1) SELECT id, 'empty name' AS error FROM scan_nodes WHERE name = '' UNION ALL SELECT id, 'unknown kind' FROM scan_nodes WHERE kind NOT IN {KNOWN_KINDS} UNION ALL SELECT n.id, 'duplicate id' FROM scan_nodes n JOIN twice t ON t.id = n.id")
def validate_nodes(s, d):
    return store.validate_nodes(_scan_nodes(s, d))


_LINKS = "new_edges AS (SELECT 'e' || CAST(event_id AS VARCHAR) AS id, 'action:user-' || CAST(user_id + event_id % 3 AS VARCHAR) AS src_id, 'route:POST-/events/' || event_type AS dst_id, CASE WHEN event_id % 50 = 0 THEN 'calls' ELSE 'uses_route' END AS kind FROM events)"


def _new_edges(s, d) -> DataFrame:
    return tables.read(s, d, "events").selectExpr("concat('e', event_id) id", "concat('action:user-', user_id + event_id % 3) src_id", "concat('route:POST-/events/', event_type) dst_id", "if(event_id % 50 = 0, 'calls', 'uses_route') kind")


@query(f"WITH {NODES_SQL}, {_LINKS} SELECT id, 'unknown kind' AS error FROM new_edges WHERE kind = 'calls' UNION ALL SELECT id, 'unknown source' FROM new_edges WHERE src_id NOT IN (SELECT id FROM nodes) UNION ALL SELECT id, 'unknown target' FROM new_edges WHERE dst_id NOT IN (SELECT id FROM nodes)")
def validate_edges(s, d):
    return store.validate_edges(_new_edges(s, d), _nodes(s, d))


@query(f"WITH {NODES_SQL}, {_LINKS} SELECT id, src_id, dst_id, kind FROM new_edges WHERE src_id IN (SELECT id FROM nodes) AND dst_id IN (SELECT id FROM nodes)")
def edges_valid(s, d):
    return store.edges_valid(_new_edges(s, d), _nodes(s, d))


@query(f"WITH {NODES_SQL}, {_LINKS} SELECT id, src_id, dst_id, kind FROM new_edges WHERE src_id NOT IN (SELECT id FROM nodes) OR dst_id NOT IN (SELECT id FROM nodes)")
def edges_rejected(s, d):
    return store.edges_rejected(_new_edges(s, d), _nodes(s, d))


@query(f"WITH {NODES_SQL}, {EDGES_SQL} SELECT {', '.join(EDGE)} FROM edges WHERE src_id NOT LIKE 'entity:supplier:%' AND dst_id NOT LIKE 'entity:supplier:%'")
def cascade_delete(s, d):
    g = tables.graph(s, d)
    return store.cascade_delete(g, g.nodes.where("id like 'entity:supplier:%'").select("id")).edges.select(*EDGE)


@query(f"WITH {NODES_SQL}, new AS (SELECT * FROM (SELECT 'entity:customer:' || CAST(o_custkey AS VARCHAR) AS id, CAST(o_orderkey AS VARCHAR) AS name, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS k FROM orders) WHERE k = 1) SELECT coalesce(new.id, n.id) AS id, coalesce(new.name, n.name) AS name, CAST(CASE WHEN n.id IS NULL THEN {NOW} ELSE {tables.CREATED} END AS BIGINT) AS created_at, CAST(CASE WHEN new.id IS NULL THEN {tables.CREATED} ELSE {NOW} END AS BIGINT) AS updated_at FROM nodes n FULL OUTER JOIN new ON n.id = new.id")
def upsert_nodes(s, d):
    new = tables.read(s, d, "orders").selectExpr("concat('entity:customer:', o_custkey) id", "'entity' kind", "cast(o_orderkey as string) name", "'' label", "'{}' properties", "'scan' source", "cast(null as string) source_file", "cast(null as string) scan_hash", "o_orderkey seq")
    return store.upsert_nodes(_nodes(s, d), new, NOW, "seq").select("id", "name", "created_at", "updated_at")


@query(f"WITH {NODES_SQL}, {EDGES_SQL} SELECT id, CASE WHEN kind = 'uses_route' THEN '{{\"v\":2}}' ELSE properties END AS properties, CAST({tables.CREATED} AS BIGINT) AS created_at FROM edges")
def upsert_edges(s, d):
    e = tables.edges(s, d)
    return store.upsert_edges(e, e.where("kind = 'uses_route'").withColumn("properties", F.lit('{"v":2}')), NOW).select("id", "properties", "created_at")


@query(f"WITH {NODES_SQL}, {EDGES_SQL} SELECT {', '.join(EDGE)} FROM edges WHERE source_scanner IS DISTINCT FROM 'supply'")
def delete_by_scanner(s, d):
    return store.delete_by_scanner(tables.edges(s, d), "supply").select(*EDGE)


@query("SELECT 'route:' || event_type AS id, 'events' AS scanner FROM (SELECT DISTINCT event_type FROM events) UNION ALL SELECT 'page:' || CAST(page_id AS VARCHAR), 'pages' FROM pages")
def merge_scans(s, d):
    a = tables.read(s, d, "events").select(F.concat(F.lit("route:"), "event_type").alias("id"), F.lit("events").alias("scanner")).distinct()
    return store.merge_scans([a, tables.read(s, d, "pages").select(F.concat(F.lit("page:"), F.col("page_id").cast("string")).alias("id"), F.lit("pages").alias("scanner"))])


@query(f"WITH {NODES_SQL}, {EDGES_SQL}, a AS (SELECT count(DISTINCT source_file) AS files, count(*) AS nodes FROM nodes WHERE source = 'scan'), b AS (SELECT count(*) AS edges, count(DISTINCT source_scanner) AS scanners FROM edges) SELECT files, nodes, edges, scanners FROM a, b")
def scan_stats(s, d):
    g = tables.graph(s, d)
    per_file = g.nodes.where("source = 'scan'").groupBy("source_file").agg(F.count("*").alias("n")).select(F.when(F.col("source_file").isNotNull(), 1).otherwise(0).alias("files"), F.col("n").alias("nodes"), F.lit(0).alias("edges"), F.lit(0).alias("scanners"))
    per_scanner = g.edges.groupBy("source_scanner").agg(F.count("*").alias("n")).select(F.lit(0).alias("files"), F.lit(0).alias("nodes"), F.col("n").alias("edges"), F.lit(1).alias("scanners"))
    return per_file.unionByName(per_scanner).agg(*[F.sum(c).cast("long").alias(c) for c in ("files", "nodes", "edges", "scanners")])


@query("SELECT event_id, 'route:' || event_type || CASE WHEN k > 1 THEN '#' || CAST(k AS VARCHAR) ELSE '' END AS id FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY event_id) AS k FROM events)")
def dedupe_ids(s, d):
    e = tables.read(s, d, "events").select("event_id", F.concat(F.lit("route:"), "event_type").alias("own"), F.concat_ws("/", F.concat(F.lit("route:"), "event_type"), F.to_date("ts").cast("string")).alias("base"))
    out = store.dedupe_ids(e, "base", ["event_id"])
    return out.select("event_id", F.concat("own", F.regexp_extract("id", "(#[0-9]+)$", 1)).alias("id"))


@query(f"WITH RECURSIVE {NODES_SQL}, {EDGES_SQL}, walk(origin, id, depth) AS (SELECT src_id, dst_id, 1 FROM edges WHERE kind = 'field_relation' UNION SELECT origin, e.dst_id, depth + 1 FROM walk JOIN edges e ON e.src_id = walk.id WHERE depth < 3 AND e.kind = 'requires_permission') SELECT 'edge:' || origin || '-touches_entity-' || id AS edge_id, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY origin, id")
def link_routes(s, d):
    e = tables.edges(s, d)
    near = e.where("kind = 'field_relation'").select(F.col("src_id").alias("origin"), F.col("dst_id").alias("id"), F.lit(1).alias("depth"))
    far = traverse.reach(e.where("kind = 'requires_permission'"), near.select("id").distinct().select(F.col("id").alias("origin"), "id"), 2, directed=True)
    out = near.select("origin", F.col("id").alias("via")).join(far.select(F.col("origin").alias("via"), "id", "depth"), "via").groupBy("origin", "id").agg((F.min("depth") + 1).alias("depth"))
    return out.select(F.format_string("edge:%s-touches_entity-%s", "origin", "id").alias("edge_id"), "depth")
