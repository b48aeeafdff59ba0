"""An application graph over star-schema tables: reference data as entities, events as routes and actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.model import Graph

PATTERNED = ("click", "view", "purchase")
#: Written where the engine would write the present; queries stay repeatable.
CREATED = 1_700_000_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _node(df: DataFrame, id_: Column, kind: str, name: Column, label: Column, source_file: str | None, properties: Column | None = None, source: str = "scan") -> DataFrame:
    return df.select(id_.alias("id"), F.lit(kind).alias("kind"), name.alias("name"), F.coalesce(label, F.lit("")).alias("label"), (F.lit("{}") if properties is None else properties).alias("properties"), F.lit(source).alias("source"), F.lit(source_file).cast("string").alias("source_file"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: read(spark, sf_dir, name)
    key = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    types = t("events").select("event_type").distinct()
    path = F.concat(F.lit("/events/"), "event_type")
    patterns = F.when(F.col("event_type").isin(*PATTERNED), F.concat(F.lit('{"gherkin_patterns":["user {int} triggers '), "event_type", F.lit('"]}'))).otherwise("{}")
    parts = [
        _node(t("region"), key("permission:", "r_name"), "permission", F.col("r_name"), F.col("r_name"), "region"),
        _node(t("nation"), key("entity:nation:", "n_nationkey"), "entity", F.col("n_name"), F.col("n_name"), "nation"),
        _node(t("customer"), key("entity:customer:", "c_custkey"), "entity", F.col("c_name"), F.col("c_mktsegment"), "customer"),
        _node(t("supplier"), key("entity:supplier:", "s_suppkey"), "entity", F.col("s_name"), F.lit("supplier"), "supplier"),
        _node(t("part"), key("entity:part:", "p_partkey"), "entity", F.col("p_name"), F.concat_ws(" ", "p_brand", "p_type"), None, F.concat(F.lit('{"fields":["size","price"],"size":'), F.col("p_size").cast("string"), F.lit("}"))),
        _node(types, key("route:POST-/events/", "event_type"), "route", path, F.concat(F.lit("POST "), path), "events", F.concat(F.lit('{"method":"POST","path":"'), path, F.lit('"}'))),
        _node(t("pages"), key("page:", "page_id"), "page", F.col("url"), F.regexp_extract("html", "<title>([^<]*)</title>", 1), "pages", F.concat(F.lit('{"path":"/'), F.col("page_id").cast("string"), F.lit('"}'))),
        _node(t("events").select("user_id").distinct(), key("action:user-", "user_id"), "action", key("User ", "user_id"), key("User ", "user_id"), None, None, "agent"),
        _node(types, key("action:trigger-", "event_type"), "action", key("Trigger ", "event_type"), key("Trigger ", "event_type"), None, patterns, "agent"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("created_at", F.lit(CREATED).cast("long")).withColumn("updated_at", F.lit(CREATED).cast("long")).withColumn("scan_hash", F.lit(None).cast("string"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: read(spark, sf_dir, name)
    key = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))

    def edge(df: DataFrame, src: Column, kind: str, dst: Column, scanner: str) -> DataFrame:
        return df.select(src.alias("src_id"), dst.alias("dst_id"), F.lit(kind).alias("kind"), F.lit(scanner).alias("source_scanner"))

    uses = t("events").select("user_id", "event_type").distinct()
    types = uses.select("event_type").distinct().where("event_type <> 'error'")
    users = uses.select("user_id").distinct()
    parts = [
        edge(t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")), key("entity:nation:", "n_nationkey"), "requires_permission", key("permission:", "r_name"), "geo"),
        edge(t("customer"), key("entity:customer:", "c_custkey"), "field_relation", key("entity:nation:", "c_nationkey"), "geo"),
        edge(t("supplier"), key("entity:supplier:", "s_suppkey"), "field_relation", key("entity:nation:", "s_nationkey"), "geo"),
        edge(t("lineitem").select("l_suppkey", "l_partkey").distinct(), key("entity:supplier:", "l_suppkey"), "relates_to", key("entity:part:", "l_partkey"), "supply"),
        edge(uses, key("action:user-", "user_id"), "uses_route", key("route:POST-/events/", "event_type"), "events"),
        edge(types, key("action:trigger-", "event_type"), "uses_route", key("route:POST-/events/", "event_type"), "events"),
        edge(users.join(t("customer").select("c_custkey"), F.col("user_id") == F.col("c_custkey")), key("action:user-", "user_id"), "touches_entity", key("entity:customer:", "c_custkey"), "events"),
        edge(users.join(t("pages").select("page_id"), F.col("user_id") == F.col("page_id")), key("action:user-", "user_id"), "on_page", key("page:", "page_id"), "events"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    named = F.format_string("edge:%s-%s-%s", "src_id", "kind", "dst_id")
    return out.select(named.alias("id"), "src_id", "dst_id", "kind", F.lit("{}").alias("properties"), "source_scanner", F.lit(CREATED).cast("long").alias("created_at"))


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph(nodes(spark, sf_dir), edges(spark, sf_dir))


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, text): a step per event, in a file per day; and per line of a conversation, in a file per conversation."""
    events = read(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("file"), F.concat(F.lit("user "), F.col("user_id").cast("string"), F.lit(" triggers "), F.col("event_type")).alias("text"))
    lines = read(spark, sf_dir, "conversations").select(F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("file"), F.explode(F.split("text", "\n")).alias("text"))
    return events.unionByName(lines.select("file", F.trim("text").alias("text")).where("text <> ''"))


def _sql_node(id_: str, kind: str, name: str, label: str, file: str, table: str, properties: str = "'{}'", source: str = "scan") -> str:
    return f"SELECT {id_} AS id, '{kind}' AS kind, {name} AS name, coalesce({label}, '') AS label, {properties} AS properties, '{source}' AS source, {file} AS source_file FROM {table}"


#: The same in SQL, as common table expressions.
NODES_SQL = "types AS (SELECT DISTINCT event_type FROM events), users AS (SELECT DISTINCT user_id FROM events), nodes AS (" + " UNION ALL ".join([
    _sql_node("'permission:' || r_name", "permission", "r_name", "r_name", "'region'", "region"),
    _sql_node("'entity:nation:' || CAST(n_nationkey AS VARCHAR)", "entity", "n_name", "n_name", "'nation'", "nation"),
    _sql_node("'entity:customer:' || CAST(c_custkey AS VARCHAR)", "entity", "c_name", "c_mktsegment", "'customer'", "customer"),
    _sql_node("'entity:supplier:' || CAST(s_suppkey AS VARCHAR)", "entity", "s_name", "'supplier'", "'supplier'", "supplier"),
    _sql_node("'entity:part:' || CAST(p_partkey AS VARCHAR)", "entity", "p_name", "concat_ws(' ', p_brand, p_type)", "CAST(NULL AS VARCHAR)", "part", """'{"fields":["size","price"],"size":' || CAST(p_size AS VARCHAR) || '}'"""),
    _sql_node("'route:POST-/events/' || event_type", "route", "'/events/' || event_type", "'POST /events/' || event_type", "'events'", "types", """'{"method":"POST","path":"/events/' || event_type || '"}'"""),
    _sql_node("'page:' || CAST(page_id AS VARCHAR)", "page", "url", "regexp_extract(html, '<title>([^<]*)</title>', 1)", "'pages'", "pages", """'{"path":"/' || CAST(page_id AS VARCHAR) || '"}'"""),
    _sql_node("'action:user-' || CAST(user_id AS VARCHAR)", "action", "'User ' || CAST(user_id AS VARCHAR)", "'User ' || CAST(user_id AS VARCHAR)", "CAST(NULL AS VARCHAR)", "users", source="agent"),
    _sql_node("'action:trigger-' || event_type", "action", "'Trigger ' || event_type", "'Trigger ' || event_type", "CAST(NULL AS VARCHAR)", "types", """CASE WHEN event_type IN ('click', 'view', 'purchase') THEN '{"gherkin_patterns":["user {int} triggers ' || event_type || '"]}' ELSE '{}' END""", "agent"),
]) + ")"
EDGES_SQL = """uses AS (SELECT DISTINCT user_id, event_type FROM events), links AS (
SELECT 'entity:nation:' || CAST(n_nationkey AS VARCHAR) AS src_id, 'requires_permission' AS kind, 'permission:' || r_name AS dst_id, 'geo' AS source_scanner FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'entity:customer:' || CAST(c_custkey AS VARCHAR), 'field_relation', 'entity:nation:' || CAST(c_nationkey AS VARCHAR), 'geo' FROM customer
UNION ALL SELECT 'entity:supplier:' || CAST(s_suppkey AS VARCHAR), 'field_relation', 'entity:nation:' || CAST(s_nationkey AS VARCHAR), 'geo' FROM supplier
UNION ALL SELECT 'entity:supplier:' || CAST(l_suppkey AS VARCHAR), 'relates_to', 'entity:part:' || CAST(l_partkey AS VARCHAR), 'supply' FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)
UNION ALL SELECT 'action:user-' || CAST(user_id AS VARCHAR), 'uses_route', 'route:POST-/events/' || event_type, 'events' FROM uses
UNION ALL SELECT 'action:trigger-' || event_type, 'uses_route', 'route:POST-/events/' || event_type, 'events' FROM (SELECT DISTINCT event_type FROM events) WHERE event_type <> 'error'
UNION ALL SELECT 'action:user-' || CAST(u.user_id AS VARCHAR), 'touches_entity', 'entity:customer:' || CAST(c_custkey AS VARCHAR), 'events' FROM (SELECT DISTINCT user_id FROM events) u JOIN customer ON u.user_id = c_custkey
UNION ALL SELECT 'action:user-' || CAST(u.user_id AS VARCHAR), 'on_page', 'page:' || CAST(page_id AS VARCHAR), 'events' FROM (SELECT DISTINCT user_id FROM events) u JOIN pages ON u.user_id = page_id),
edges AS (SELECT 'edge:' || src_id || '-' || kind || '-' || dst_id AS id, src_id, dst_id, kind, '{}' AS properties, source_scanner FROM links)"""
STEPS_SQL = """steps AS (
SELECT strftime(ts, '%Y-%m-%d') AS file, 'user ' || CAST(user_id AS VARCHAR) || ' triggers ' || event_type AS text FROM events
UNION ALL SELECT file, trim(line) FROM (SELECT 'conv-' || CAST(conv_id AS VARCHAR) AS file, unnest(string_split(text, chr(10))) AS line FROM conversations) WHERE trim(line) <> '')"""
