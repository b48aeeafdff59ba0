"""URL filters: rules first, then trust and distrust spread over the graph of hosts. DataFrame operations only.

Hosts are nodes; a page's absolute links give edges to other hosts, weighted by their number, and each name is
joined both ways with the name that it is a subdomain of, up to the registered domain and whether or not these names
have pages, so siblings are two edges apart. Trust is the personalised
PageRank from hosts with allowed pages; distrust the one from hosts with blocked pages over reversed
edges (who links to blocked hosts is distrusted). A host whose distrust exceeds ``threshold`` times its trust is
blocked. Edges are summed per pair of hosts before any join, so a page count never weighs on a task.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, load, written

#: (host, path, verdict)
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: Most rules that are matched as a literal in each row; more are joined by host.
LITERAL_RULES = 64
DAMPING, THRESHOLD = 0.85, 1.0
#: Ranks have settled when a round changes none by more than this share of it; rounds between two tables of ranks.
TOLERANCE, SPAN = 1e-5, 3
#: Labels under which a country's registry gives out names.
REGISTRY = ("ac", "co", "com", "edu", "gov", "ne", "net", "or", "org")
_LINK = r"""(?i)(?:href|src)\s*=\s*["']?\s*((?:https?:)?//[^\s"'<>]+)"""


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; null or no ://: empty."""
    return F.when(url.contains("://"), ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))).otherwise("")


def path_of(url: Column) -> Column:
    return F.when(url.contains("://"), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)).otherwise("")


def _suffixes(host: Column) -> Column:
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def with_rule(urls: DataFrame, rules=RULES) -> DataFrame:
    """urls(host, path, ...) with rule and rule_verdict of the longest rule that fits (equal lengths: the first in text order), else nulls."""
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))
    if len(ordered) <= LITERAL_RULES:
        rule = verdict = F.lit(None).cast("string")
        for host, path, what in reversed(ordered):
            fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
            rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, what).otherwise(verdict)
        return urls.withColumn("rule", rule).withColumn("rule_verdict", verdict)
    spark = urls.sparkSession
    text = json.dumps([{"suffix": h, "rule_path": p, "rule": h + p, "rule_verdict": v, "rank": -len(h + p)} for h, p, v in ordered])
    rows = F.from_json(F.lit(text), "array<struct<suffix:string,rule_path:string,rule:string,rule_verdict:string,rank:int>>")
    table = spark.range(1).select(F.explode(rows).alias("r")).select("r.*")
    hosts = urls.select("host").distinct()
    fitting = hosts.withColumn("suffix", F.explode(_suffixes(F.col("host")))).join(table, "suffix").groupBy("host").agg(F.sort_array(F.collect_list(F.struct("rank", "rule", "rule_path", "rule_verdict"))).alias("fitting"))
    first = F.get(F.filter("fitting", lambda r: F.col("path").startswith(r["rule_path"])), F.lit(0))
    return urls.join(fitting, "host", "left").withColumn("first", first).withColumn("rule", F.col("first.rule")).withColumn("rule_verdict", F.col("first.rule_verdict")).drop("fitting", "first")


def _parents(hosts: DataFrame) -> DataFrame:
    """(child, parent): each host's chain of names up to its registered domain, names without pages included; an IP address has none.

    Registered domain: the last two labels, or three where the last is a country's and the one before it a common registry label.
    """
    labels = F.split("host", r"\.")
    own = F.when(F.element_at(labels, -1).rlike("^[a-z]{2}(:[0-9]+)?$") & F.coalesce(F.get(F.reverse(labels), F.lit(1)).isin(*REGISTRY), F.lit(False)), 3).otherwise(2)
    named = hosts.where(~F.col("host").rlike(r"^\[|^[0-9.]+(:[0-9]+)?$")).select(_suffixes(F.col("host")).alias("names"), own.alias("own"))
    steps = named.select("names", F.explode(F.expr("filter(sequence(0, greatest(size(names) - own - 1, 0)), i -> i < size(names) - own)")).alias("i"))
    return steps.select(F.get("names", F.col("i")).alias("child"), F.get("names", F.col("i") + 1).alias("parent")).distinct()


def host_edges(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """(src, dst, w): links between different hosts, summed, and each name to its parent up to the registered domain and back."""
    linked = pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(_LINK), F.lit(1))).alias("link"))
    links = linked.select("src", ascii_lower(F.regexp_extract("link", r"//([^/?#]*)", 1)).alias("dst")).where("dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))
    links = written(links, "links")
    family = _parents(hosts.select("host").unionByName(links.select(F.col("dst").alias("host"))).distinct())
    up = family.select(F.col("child").alias("src"), F.col("parent").alias("dst"), F.lit(1.0).alias("w"))
    return links.unionByName(up).unionByName(up.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def spread(edges: DataFrame, trusted: DataFrame, distrusted: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, host_trust, host_distrust): personalised PageRank from trusted(host, s) along edges(src, dst, w), and from distrusted(host, s) against them; s sums to 1.

    Rounds go on until one reaches no new host and changes no rank by more than ``tolerance`` of it; a rank is then within
    about tolerance * damping / (1 - damping) of itself. What ends at hosts without edges is not given back: such ranks
    only matter relative to each other.
    """
    both = edges.select(F.lit(True).alias("trust"), "src", "dst", "w").unionByName(edges.select(F.lit(False).alias("trust"), F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    share = written(both.join(both.groupBy("trust", "src").agg(F.sum("w").alias("all")), ["trust", "src"]).select("trust", "src", "dst", (F.col("w") / F.col("all")).alias("w")), "shares")
    seeds = written(trusted.select(F.lit(True).alias("trust"), "host", F.col("s").alias("r")).unionByName(distrusted.select(F.lit(False).alias("trust"), "host", F.col("s").alias("r"))), "seeds")
    start = seeds.select("trust", "host", (F.col("r") * (1 - damping)).alias("r"))
    rank, moving = seeds, True
    while moving:
        for _ in range(SPAN):
            last = rank
            moved = share.join(rank.withColumnRenamed("host", "src"), ["trust", "src"]).select("trust", F.col("dst").alias("host"), (F.col("w") * F.col("r") * damping).alias("r"))
            rank = moved.unionByName(start).groupBy("trust", "host").agg(F.sum("r").alias("r"))
        rows = rank.withColumn("old", F.lit(None).cast("double")).unionByName(last.select("trust", "host", F.lit(0.0).alias("r"), F.col("r").alias("old")))
        state = written(rows.groupBy("trust", "host").agg(F.sum("r").alias("r"), F.sum("old").alias("old")), "ranks")
        moving = not state.where(F.col("old").isNull() | (F.abs(F.col("r") - F.col("old")) > F.col("r") * tolerance)).isEmpty()
        rank = state.select("trust", "host", "r")
    return rank.groupBy("host").agg(F.sum(F.when(F.col("trust"), F.col("r")).otherwise(0.0)).alias("host_trust"), F.sum(F.when(F.col("trust"), 0.0).otherwise(F.col("r"))).alias("host_distrust"))


def _seeds(judged: DataFrame, verdict: str) -> DataFrame:
    """Hosts with pages of a verdict by rule, weighed by the share of their pages that have it."""
    own = judged.where("pages > 0").select("host", (F.col(verdict) / F.col("pages")).alias("s")).where("s > 0")
    total = own.agg(F.sum("s")).first()[0] or 1.0
    return own.withColumn("s", F.col("s") / total)


def judge_urls(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD, default: str = "allow") -> DataFrame:
    """Per row of pages(page_id, url, html): (page_id, host, path, rule, verdict, host_trust, host_distrust).

    The longest rule that fits decides. Without one the host's score does: blocked if distrust exceeds threshold
    times trust. Rows without a host, and hosts that neither score reaches, get ``default``. Null url: empty host and
    path. Null html: no links. Repeated rows stay repeated; an empty table gives no rows; extra columns are not kept.
    """
    own = pages.select("page_id", host_of(F.col("url").cast("string")).alias("host"), path_of(F.col("url").cast("string")).alias("path"), F.col("html").cast("string").alias("html"))
    ruled = with_rule(own.select("page_id", "host", "path"), rules)
    ruled = ruled.withColumn("host", F.coalesce("host", F.lit(""))).withColumn("path", F.coalesce("path", F.lit("")))
    judged = written(ruled.where("host <> ''").groupBy("host").agg(F.count("*").alias("pages"), F.count_if(F.col("rule_verdict") == "allow").alias("allow"), F.count_if(F.col("rule_verdict") == "block").alias("block")), "hosts")
    edges = written(host_edges(own, judged.select("host")), "edges")
    ranks = spread(edges, _seeds(judged, "allow"), _seeds(judged, "block"))
    scores = judged.select("host").join(ranks, "host", "left").fillna(0.0, ["host_trust", "host_distrust"])
    scores = written(scores.withColumn("by_host", F.when(F.col("host_distrust") > F.col("host_trust") * threshold, "block").when(F.col("host_trust") > 0, "allow").otherwise(default)), "scores")
    out = ruled.join(scores, "host", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", "by_host", F.lit(default)).alias("verdict"), F.round("host_trust", 12).alias("host_trust"), F.round("host_distrust", 12).alias("host_distrust"))


def op9_link_graph_filter(spark, sf_dir: str) -> DataFrame:
    """Every page's url judged by the rules, else by its host's trust and distrust."""
    return judge_urls(load(spark, sf_dir, "pages"))
