"""Fixtures of the graph, search, templates, writes."""

import pytest
from pyspark.sql import functions as F

from stepweave.functions import text as fn
from stepweave.functions.template import match_template
from stepweave.model import EDGE_SCHEMA, NODE_SCHEMA, Graph
from stepweave.operators import actions, listing, match, search, store, traverse

NODE = lambda i, kind="route", name=None, label="", props="{}": (i, kind, name or i, label, props, "scan", None, 1, 1, None)
EDGE = lambda i, a, b, kind="relates_to": (i, a, b, kind, "{}", None, 1)


def graph(spark, nodes, edges):
    return Graph(spark.createDataFrame(nodes, NODE_SCHEMA), spark.createDataFrame(edges, EDGE_SCHEMA))


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_reach(spark):
    g = graph(spark, [NODE(f"n{k}") for k in range(1, 5)], [EDGE("e1", "n1", "n2"), EDGE("e2", "n2", "n3"), EDGE("e3", "n3", "n1")])
    assert ids(traverse.connected(g, "n1", 1).nodes) == ["n1", "n2", "n3"]
    assert len(ids(traverse.connected(g, "n1", 10).edges)) == 3
    assert ids(traverse.connected(g, "none").nodes) == []


def test_search_ranks(spark):
    rows = [("a", "user_profile", "User Profile Page", '{"method":"GET"}'), ("b", "admin_dashboard", "Admin Dashboard", "{}"), ("c", "order_history", "Order History View", "{}"), ("d", "Café users", "User2 list user", '{"k":[1,2]}'), ("e", "x", "y", "{}"), ("g", "z", "w", "{}"), ("h", "q", "r", "{}")]
    nodes = spark.createDataFrame([NODE(i, "page", n, lab, p) for i, n, lab, p in rows], NODE_SCHEMA)
    ix = search.index(nodes)
    want = {
        "user": [("a", -0.9202154868972916), ("d", -0.582082615034025)],
        "method": [("a", -1.1645998380308806)],
        "cafe": [("d", -1.0825307219280333)],
        "user OR dashboard": [("b", -2.054739841621363), ("a", -0.9202154868972916), ("d", -0.582082615034025)],
        "user profile": [("a", -2.631590315197313)],
        "user*": [("d", -1.0449434896393943), ("a", -0.9202154868972916)],
        "name:user": [("a", -1.1645998380308806)],
        '"user profile"': [("a", -1.711374828300021)],
        "user NOT profile": [("d", -0.582082615034025)],
    }
    for q, rank in want.items():
        got = [(r["id"], r["rank"]) for r in search.search(ix, q).collect()]
        assert [i for i, _ in got] == [i for i, _ in rank], q
        assert all(abs(a - b) < 1e-9 for (_, a), (_, b) in zip(got, rank, strict=True)), q
    for q in ("GET /api", "NOT user", "user-profile", ""):
        with pytest.raises(search.QueryError):
            search.parse_query(q)


def test_index_update_and_accents(spark):
    nodes = spark.createDataFrame([NODE("a", "page", "\u010daj g\u0103rden"), NODE("b", "page", "cafe\u0301 noir"), NODE("c", "page", "tea")], NODE_SCHEMA)
    ix = search.index(nodes)
    found = lambda ix, q: ids(search.search(ix, q))
    assert found(ix, "\u010daj") == found(ix, "caj") == ["a"] and found(ix, "caf\u00e9") == ["b"] and found(ix, '"garden caj"') == []
    new = nodes.where("id <> 'b'").withColumn("name", F.when(F.col("id") == "c", "caj tea").otherwise(F.col("name")))
    ix = search.update(ix, new, spark.createDataFrame([("b",), ("c",)], "id string"))
    whole = search.index(new)
    for q in ("caj", "noir", "tea", '"caj tea"', "caj NOT tea", "name:caj", "label:caj", "g*"):
        a, b = ([(r["id"], round(r["rank"], 9)) for r in search.search(x, q).collect()] for x in (ix, whole))
        assert a == b, q


def test_terms_match_brute_force(spark):
    import itertools

    words = ["alpha", "beta", "gamma", "user", "x1", "x2"]
    rows = [NODE(f"n{k:02d}", "action" if k % 3 else "page", " ".join(w for i, w in enumerate(words) if i == 3 or (k >> (i % 4)) & 1)) for k in range(40)]
    nodes = spark.createDataFrame(rows, NODE_SCHEMA)
    ix = search.index(nodes)
    asked = [(" ".join(c), w) for n in (1, 2, 3) for c in itertools.combinations(words, n) for w in c]
    got = {}
    for r in search.search_terms(ix, spark.createDataFrame(asked, "q string, term string"), ["action", "page"], 4).collect():
        got.setdefault((r["q"], r["kind"]), []).append((r["rank"], r["id"]))
    for q in {q for q, _ in asked}:
        for kind in ("action", "page"):
            want = [(round(r["rank"], 8), r["id"]) for r in search.search(ix, " OR ".join(q.split()), kind, 100).collect()]
            assert sorted(got.get((q, kind), [])) == sorted(want)[:4], (q, kind)


def test_terms_of_other_kinds(spark, monkeypatch):
    """The most frequent word of a kind is what its postings are not met for, whatever other kinds hold; an id may be of two kinds."""
    rows = [NODE(f"e{k:03d}", "entity", "box n7") for k in range(300)] + [NODE(f"a{k:03d}", "action", "user") for k in range(400)] + [NODE("x", "entity", "n7 user"), NODE("x", "page", "n7 user")]
    ix = search.index(spark.createDataFrame(rows, NODE_SCHEMA))
    made, write = [], search.written
    monkeypatch.setattr(search, "written", lambda df, what: made.append(write(df, what)) or made[-1])
    asked = spark.createDataFrame([(f"q{k}", w) for k in range(40) for w in ("user", "n7", f"own{k}")], "q string, term string")
    got = {}
    for r in search.search_terms(ix, asked, ["entity", "page"], 3).collect():
        got.setdefault((r["q"], r["kind"]), []).append((r["rank"], r["id"]))
    assert len(got) == 80 and all(sorted(v)[0][1] == "x" and [i for _, i in sorted(v)][1:] == (["e000", "e001"] if k == "entity" else []) for (_, k), v in got.items())
    assert max(t.count() for t in made) < 40 * 300  # 40 queries, 300 entities: no table of pairs


def test_terms_shuffle_no_pairs(spark, monkeypatch):
    """Queries of several frequent words: what is dealt grows with queries and nodes, not with the pairs of them; blocks agree with a search of all."""
    words = [f"w{k}" for k in range(8)]
    rows = [NODE(f"n{k}", "page", " ".join(w for i, w in enumerate(words) if k * 2654435761 % 2**32 >> (3 * i) & 3) + f" own{k}") for k in range(3000)]
    ix = search.index(spark.createDataFrame(rows, NODE_SCHEMA))
    asked = spark.createDataFrame([(f"q{k}", w) for k in range(100) for w in (words[k % 8], words[(k + 3) % 8], words[(k // 8 + 5) % 8], f"own{k}")], "q string, term string")
    monkeypatch.setattr(search, "NODES_OF_BLOCK", 1000, raising=False)
    monkeypatch.setattr(search, "LEAST_HITS", 100_000, raising=False)
    java, store = spark._jvm, spark._jsc.sc().statusStore()

    def stages():
        found = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(java.double, 0), java.java.util.ArrayList())
        return {found.apply(k).stageId(): found.apply(k).shuffleWriteRecords() for k in range(found.size())}

    before = set(stages())
    got = {}
    for r in search.search_terms(ix, asked, ["page"], 5).collect():
        got.setdefault(r["q"], []).append((r["rank"], r["id"]))
    most = max(n for k, n in stages().items() if k not in before)
    assert most < 40_000, most  # 100 queries, each of which some 2900 of 3000 nodes fit
    for k in (0, 13, 77):
        want = [(round(r["rank"], 8), r["id"]) for r in search.search(ix, " OR ".join({words[k % 8], words[(k + 3) % 8], words[(k // 8 + 5) % 8], f"own{k}"}), "page", 5).collect()]
        assert sorted(got[f"q{k}"]) == want and len(got) == 100


def test_best_of_block():
    """Few and many nodes of the other terms, ties, a term held twice, one that the block lacks."""
    import random

    import pyarrow as pa

    from stepweave.operators.rank import best_of_block

    rng = random.Random(3)
    for n, limit in ((6000, 2), (300, 5), (3, 5)):
        held = {f"k{k:05d}": [(t, rng.choice((0.5, 0.25, 1 / 3))) for t in range(6) if rng.random() < (0.6, 0.3, 0.2, 0.01, 0.001, 0.0)[t]] for k in range(n)}
        held["k00001"] = [(0, 0.5), (0, 0.5), (3, 1.0)]
        ids = [i for i in rng.sample(sorted(held), n) if held[i]]
        nodes = pa.table({"id": ids, "t": [[t for t, _ in held[i]] for i in ids], "s": [[s for _, s in held[i]] for i in ids]})
        forms = [[0], [3], [0, 1, 2], [0, 3, 4], [1, 4], [5], [9, 4, 5], [0, 1, 2, 3, 4, 5]]
        got = best_of_block(limit)(pa.table({"form": [b"%d" % k for k in range(len(forms))], "terms": forms}), nodes).to_pylist()
        got = {r["form"]: [(x["rank"], x["id"]) for x in r["best"]] for r in got}
        for k, terms in enumerate(forms):
            score = {i: sum(s for t, s in v if t in terms) for i, v in held.items() if any(t in terms for t, _ in v)}
            want = sorted((round(-x, 8), i) for i, x in score.items())[:limit]
            assert got.get(b"%d" % k, []) == want, (n, terms)


def test_templates():
    assert match_template("I have {int} items in my cart", "I have 5 items in my cart") == {"p0": "5"}
    assert match_template("I see the message {string}", 'I see the message "hello world"') == {"p0": "hello world"}
    assert match_template("I register a new {word}", "I register a new user") == {"p0": "user"}
    assert match_template("I {int", "I 5") is None
    assert match_template("I am/was here(s)", "I was here") == {}


def test_texts(spark):
    df = spark.createDataFrame([('Given I register a new user',), ('"/" "*" "+" "-"',), ('When I have 5 items in "x y"',)], "t string")
    got = df.select(fn.query_words(F.col("t")).alias("w"), fn.action_name(F.col("t")).alias("n"), fn.step_pattern(F.col("t")).alias("p")).collect()
    assert got[0]["w"] == ["register", "new", "user"] and got[1]["w"] == []
    assert got[2]["n"] == "i have items in" and got[2]["p"] == "I have {int} items in {string}" and got[1]["n"] == "unnamed action"


def test_match(spark):
    nodes = spark.createDataFrame([NODE("action:b", "action", props='{"gherkin_patterns":["I login as {string}",7]}'), NODE("action:a", "action", "register", props='{"gherkin_patterns":["I register a new {word}"]}')], NODE_SCHEMA)
    steps = spark.createDataFrame([("f", "I register a new admin"), ("f", 'I login as "x"'), ("f", "please register"), ("g", "xylophone")], "file string, text string")
    patterns, ix = match.explode_patterns(nodes), search.index(nodes)
    tiers = {r["text"]: (r["tier"], r["action_id"]) for r in match.match_tiers(steps, patterns, ix).collect()}
    assert tiers == {"I register a new admin": ("exact", "action:a"), 'I login as "x"': ("exact", "action:b"), "please register": ("fuzzy", "action:a"), "xylophone": ("suggest", None)}
    literal = {r["text"]: r["params"] for r in match.match_exact(steps, patterns).collect()}
    match.LITERAL_TEMPLATES, old = 0, match.LITERAL_TEMPLATES
    try:
        assert {r["text"]: r["params"] for r in match.match_exact(steps, patterns).collect()} == literal
    finally:
        match.LITERAL_TEMPLATES = old
    many = spark.createDataFrame([NODE(f"action:{k:03d}", "action", props='{"gherkin_patterns":["%s"]}' % p) for k, p in enumerate([f"I press key{j} {{int}}" for j in range(70)] + ["{word}", "I press key3 3"])], NODE_SCHEMA)
    got = {r["text"]: (r["action_id"], r["params"]) for r in match.match_exact(spark.createDataFrame([("I press key3 3",), ("I press key69 7",), ("lone",), ("no fit",)], "text string"), match.explode_patterns(many)).collect()}
    assert got == {"I press key3 3": ("action:003", {"p0": "3"}), "I press key69 7": ("action:069", {"p0": "7"}), "lone": ("action:070", {"p0": "lone"})}
    total = match.coverage_total(steps, match.match_tiers(steps, patterns, ix)).first()
    assert (total["steps"], total["exact"], total["pct"]) == (4, 2, 50.0)


def test_suggestions_read_no_edges(spark, tmp_path):
    """Who asks for one tier reads nothing that only others need."""
    nodes = spark.createDataFrame([NODE("action:a", "action", "register", props='{"gherkin_patterns":["I register a {word}"]}'), NODE("route:r", "route", "things"), NODE("page:p", "page", "things")], NODE_SCHEMA)
    spark.createDataFrame([EDGE("e", "action:a", "route:r", "uses_route")], EDGE_SCHEMA).write.parquet(f"{tmp_path}/edges")
    steps = spark.createDataFrame([("I register a user",), ("please register",), ("list things",), ("list things",)], "text string")
    out = match.match_full(steps, Graph(nodes, spark.read.parquet(f"{tmp_path}/edges")), search.index(nodes))
    got = {r["text"]: r for r in out.collect()}
    assert {k: r["tier"] for k, r in got.items()} == {"I register a user": "exact", "please register": "fuzzy", "list things": "suggest"}
    assert [x["id"] for x in got["I register a user"]["refs"]["routes"]] == ["route:r"] and [c["id"] for c in got["please register"]["candidates"]] == ["action:a"]
    own = got["list things"]["suggestion"]
    assert (own["name"], own["routes"], own["entities"], own["pages"]) == ("list things", ["route:r"], [], ["page:p"])
    read = lambda df: any("/edges/" in f for f in df.inputFiles())
    assert read(out) and not read(out.where("tier = 'suggest'"))


def test_suggestions_write_texts_twice(spark, monkeypatch):
    """Of the texts, those without a template and those without an action are written, the others only dealt."""
    nodes = spark.createDataFrame([NODE("action:a", "action", "register", props='{"gherkin_patterns":["I register a {word}"]}'), NODE("page:p", "page", "things")], NODE_SCHEMA)
    made, write = [], match.written
    monkeypatch.setattr(match, "written", lambda df, what: made.append(write(df, what)) or made[-1])
    steps = spark.createDataFrame([(t,) for t in ("I register a user", "I register a page", "please register", "list things", "xylophone") for _ in range(3)], "text string")
    out = match.match_full(steps, Graph(nodes, spark.createDataFrame([], EDGE_SCHEMA)), search.index(nodes))
    assert {r["text"]: r["suggestion"]["pages"] for r in out.where("tier = 'suggest'").collect()} == {"list things": ["page:p"], "xylophone": []}
    assert sorted(t.count() for t in made) == [2, 3]
    assert sorted((r["text"], r["tier"]) for r in out.where("tier <> 'suggest'").collect()) == [("I register a page", "exact"), ("I register a user", "exact"), ("please register", "fuzzy")]


def test_writes(spark, tmp_path):
    g = graph(spark, [NODE("n1"), NODE("n2"), NODE("n3")], [EDGE("e1", "n1", "n2")])
    new = spark.createDataFrame([EDGE("e1", "n1", "n3"), EDGE("e2", "none", "n2"), EDGE("e3", "n2", "n3")], EDGE_SCHEMA)
    assert ids(store.edges_valid(new, g.nodes)) == ["e1", "e3"] and ids(store.edges_rejected(new, g.nodes)) == ["e2"]
    kept = {r["id"]: (r["dst_id"], r["created_at"]) for r in store.upsert_edges(g.edges, new, 9).collect()}
    assert kept["e1"] == ("n3", 1) and kept["e3"] == ("n3", 9)
    assert {r["id"]: r["created_at"] for r in store.replace_edges(g.edges, new, g.nodes, 9).collect()} == {"e1": 9, "e3": 9}
    assert ids(store.cascade_delete(g, spark.createDataFrame([("n2",)], "id string")).edges) == []
    s = store.GraphStore(spark, f"file://{tmp_path}")
    assert s.init().nodes.count() == 0
    s.write(g)
    assert ids(s.init().nodes) == ["n1", "n2", "n3"]
    for bad in (graph(spark, [NODE("x", "widget")], []), graph(spark, [NODE("x"), NODE("x")], []), graph(spark, [NODE("x")], [EDGE("e", "x", "y")]), graph(spark, [NODE("x")], [EDGE("e", "x", "x", "calls")])):
        with pytest.raises(ValueError):
            s.write(bad)
    assert ids(s.read().nodes) == ["n1", "n2", "n3"] and s.schema_versions() == 1
    assert ids(store.delete_from(g.edges, "n1", "relates_to")) == [] and store.count_from(g.edges, "n1", "relates_to") == 1
    with pytest.raises(ValueError):
        store.insert_node(g.nodes, g.nodes.where("id = 'n1'"))
    twice = spark.createDataFrame([NODE("n4", name="a"), NODE("n4", name="b")], NODE_SCHEMA)
    assert ids(store.upsert_nodes(g.nodes, twice, 9)) == ["n1", "n2", "n3", "n4"]
    own = g.edges.withColumn("source_scanner", F.lit("l"))
    edges, created, deleted = store.replace_scoped(own, new, g.nodes, "l", 9)
    assert (created, deleted, ids(edges)) == (2, 1, ["e1", "e3"])


def test_actions(spark):
    g = graph(spark, [NODE("route:r"), NODE("action:old", "action")], [])
    g, warned = actions.create_action(g, "Sign In!", patterns=["I sign in"], refs={"routes": ["route:r", "route:none"]}, now=5)
    assert len(warned) == 1 and [r["ref_id"] for r in actions.action_refs(g).collect()] == ["route:r"]
    assert ids(actions.orphans(g)) == ["action:old"] and actions.audit_total(g).first()[0] == 2
    g, _ = actions.update_action(g, "action:sign-in", patterns=[], refs={"routes": []}, now=6)
    assert actions.action_refs(g).count() == 0 and match.explode_patterns(g.nodes).count() == 0
    with pytest.raises(ValueError):
        actions.create_action(g, "sign in", patterns=["x" * 1001])
    assert {r["kind"]: r["cnt"] for r in listing.stats_by_kind(g.nodes).collect()} == {"route": 1, "action": 2, "entity": 0, "page": 0, "permission": 0}


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
