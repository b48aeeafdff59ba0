"""Scanners, the protocol, settings, links, sinks, and the engine as a whole, on fixtures of their own."""

import io
import json

import pytest
from pyspark.sql import functions as F

from stepweave.api import Engine
from stepweave.model import EDGE_SCHEMA, NODE_SCHEMA, Graph
from stepweave.operators import link
from stepweave.sources import files, project, protocol, scanners, sinks
from stepweave.sources.script import Script, ScriptError


def props(row):
    return json.loads(row["properties"])


def test_express():
    text = """
    import express from 'express'; // it's
    const r = express.Router();
    r.get('/users', auth, requireRole('admin'), ctl.list('x'), getUsers);
    app.post("/a/:id", async (req, res) => { res.send(`x ${y.get('/in', h)}`) });
    router.route('/b').get(a, b).put(c).unknown(d).delete(e);
    foo().get('/skip', h); if (x) { y.DELETE('/d', function (req, res) {}) }
    app.get('/only'); a.get(path, h); const re = /[/"']/g; x.patch<Foo>('/gen', h);
    """
    rows = list(scanners.express_routes("src/routes/users.routes.ts", text))
    assert [r["name"] for r in rows] == ["GET /users", "POST /a/:id", "GET /in", "GET /b", "PUT /b", "DELETE /b", "DELETE /d", "PATCH /gen"]
    assert rows[0]["id"] == "route:GET-users:/users"
    assert props(rows[0]) == {"method": "GET", "path": "/users", "middleware": ["auth", "requireRole", "list"], "handler": "getUsers"}
    assert props(rows[3])["middleware"] == ["a"] and props(rows[6])["handler"] == "function (req, res) {}"


def test_names():
    assert [scanners.router_name(p) for p in ("backend/routes/users.routes.ts", "src/api/x/index.js", "x.ts.routes.ts", "routes/", "lib/a.mjs")] == ["users", "x", "x", "routes/", "lib/a"]
    assert [scanners.contract_name(p) for p in ("src/contracts/user.contract.ts", "backend/src/a.routes.js", "x.ts")] == ["user", "a", "x"]
    assert [scanners.compose_path(*x) for x in ((None, None, True), ("", "a", True), ("/p//", "a", False), ("/p", "/a", False), ("", "a", False), (None, "", False))] == ["/", "", "/p//a", "/a", "a", "/"]


def test_orpc():
    text = """export const c = { list: oc.route({ method: 'GET', path: '/u', summary: "List", tags: ['a', b], successStatus: 201 }).input(z.object({ a: 1 })).output(U),
      x: oc.route({ method: 'POST', 'path': '/v' }).errors({}).input(V), y: oc.route({ method: M, path: '/w' }), z: oc.route() };"""
    rows = list(scanners.orpc_routes("src/contracts/user.contract.ts", text))
    assert [(r["id"], r["name"], r["label"]) for r in rows] == [("route:GET-user:/u", "[user] GET /u", "List"), ("route:POST-user:/v", "[user] POST /v", "[user] POST /v")]
    assert props(rows[0]) == {"method": "GET", "path": "/u", "contractFile": "src/contracts/user.contract.ts", "summary": "List", "tags": ["a", "b"], "successStatus": 201, "inputSchema": "z.object({ a: 1 })", "outputSchema": "U"}
    assert props(rows[1])["inputSchema"] == "V" and "outputSchema" not in props(rows[1])


PAGES = """export default function App() { const a = b < c; return (<Routes>
  {/* don't */}
  <Route path="/login" element={<Login />} />
  {user ? (<Route element={<Layout />}><Route path="/dash" element={<Dash><X/></Dash>}>
     <Route index element={<Home />} /><Route path="sub" element={<Sub a={b ? 1 : 2} />} /></Route></Route>) : (<Route path="*" element={<Navigate to="/login" />} />)}
  {flag ? <Route path="/open" element={<Open/>} /> : null}
  <Route path="none">It's <Route path="deep" element={<Deep/>}/></Route></Routes>) }"""


def test_pages(spark):
    rows = list(scanners.react_pages("src/App.tsx", PAGES))
    got = [(r["id"], r["label"], props(r)["isProtected"], props(r).get("parentPath")) for r in rows]
    assert got == [
        ("page:/login", "Login", False, None), ("page:/dash", "Home", True, "/dash"), ("page:/dash/sub", "Sub", True, "/dash"), ("page:*", "Navigate", True, None),
        ("page:/open", "Open", False, None), ("page:none/deep", "Deep", False, "none"), ("page:/", "Layout", True, None), ("page:/dash", "Dash", True, None),
    ]
    own = spark.createDataFrame([("src/x.tsx", PAGES), ("lib/y.jsx", "<Route path='/z' element={<Z/>} />"), ("build/n.tsx", PAGES), ("src/bad.tsx", "<Route path='/q' element={<Q/>"), ("src/no.ts", PAGES)], "path string, text string")
    got = scanners.scan_project(own, "react-router", ["lib"]).collect()
    assert {r["id"] for r in got if r["what"] == "node"} >= {"page:/dash", "page:/dash#2"} and [r["path"] for r in got if r["severity"] == "error"] == ["src/bad.tsx"]
    assert scanners.scan_project(own, "react-router", ["lib"], {"routeFiles": ["lib/y.jsx"]}).count() == 0
    usual = own.unionByName(spark.createDataFrame([("src/App.jsx", "<Route path='/u' element={<U/>} />")], "path string, text string"))
    assert [r["id"] for r in scanners.scan_project(usual, "react-router").collect()] == ["page:/u"]


SCHEMA = """model User {
  id Int @id @default(autoincrement())
  email String? @unique
  posts Post[]
  done Boolean @default(false)
  updated DateTime @updatedAt
  // c
  @@map("users")
}
model Post {
  authorId Int @unique
  author User @relation("A", fields: [authorId], references: [id])
  editor User? @relation(fields: [editorId], references: [id])
}
enum Role {
  A
  // x
  B
}
"""


def test_prisma(spark):
    rows = {r["id"]: r for r in scanners.prisma_entities("p", SCHEMA)}
    user, post = props(rows["entity:User"]), props(rows["entity:Post"])
    assert user["tableName"] == "users" and [f["name"] for f in user["fields"]] == ["id", "email", "posts", "done", "updated"]
    assert user["fields"][0] | {"defaultValue": ""} == {"name": "id", "type": "Int", "isRequired": True, "isList": False, "isId": True, "isUnique": False, "hasDefault": True, "defaultValue": ""}
    assert not user["fields"][1]["isRequired"] and user["fields"][2]["isList"] and user["fields"][3]["defaultValue"] == "false" and user["fields"][4]["isUpdatedAt"]
    assert [r["fieldName"] for r in post["relations"]] == ["author", "editor"] and post["relations"][0]["relationFields"] == ["authorId"]
    assert props(rows["edge:entity:Post-field_relation:author-entity:User"])["relationType"] == "one-to-one"
    assert props(rows["edge:entity:Post-field_relation:editor-entity:User"])["relationType"] == "many-to-one"
    assert props(rows["entity:Role"]) == {"isEnum": True, "values": ["A", "B"]}
    own = spark.createDataFrame([("server/prisma/schema.prisma", SCHEMA)], "path string, text string")
    assert scanners.scan_project(own, "prisma").where("what = 'node'").count() == 3
    assert scanners.scan_project(own, "prisma", ["server"]).count() == 0
    none = scanners.scan_project(own.where("false"), "prisma").collect()
    assert [(r["what"], r["severity"], r["path"]) for r in none] == [("warning", "error", "prisma/schema.prisma")]


def test_scan_isolates_files(spark):
    own = spark.createDataFrame([("a.ts", "x.get('/a', h); x.get('/a', g)"), ("b.ts", "x.get('/b', 'unclosed)"), ("c.spec.ts", "x.get('/c', h)"), ("tests/d.ts", "x.get('/d', h)"), ("lib/e.ts", "x.get('/e', h)"), ("f.md", "x"), ("g.js", None)], "path string, text string")
    rows = scanners.scan_project(own, "express", ["lib"]).collect()
    assert sorted(r["id"] for r in rows if r["what"] == "node") == ["route:GET-a:/a", "route:GET-a:/a#2"]
    assert [(r["path"], r["severity"]) for r in rows if r["what"] == "warning"] == [("b.ts", "error")]
    assert scanners.scan_project(own.where("false"), "express").count() == 0
    for bad in ("f(", "}", "`${", "'", "f(]"):
        with pytest.raises(ScriptError):
            Script(bad)


def output(**change):
    node = {"id": "route:r", "kind": "route", "name": "r", "label": "r", "properties": {"a": [1, 2.5]}, "source": "scan"}
    return {"version": 1, "scanner": {"id": "s", "name": "S", "version": "1"}, "nodes": [node], "edges": [], "warnings": [], "stats": {"filesScanned": 1, "nodesFound": 1, "edgesFound": 0, "errors": 0, "durationMs": 3}} | change


def test_protocol(spark):
    node = output()["nodes"][0]
    edge = {"id": "e", "srcId": "route:r", "dstId": "entity:x", "kind": "touches_entity"}
    cases = {
        "good": output(), "version": output(version=2), "noid": output(scanner={"id": ""}), "twice": output(nodes=[node, node]), "kind": output(nodes=[node | {"kind": "widget"}]),
        "empty": output(nodes=[node | {"name": "", "label": ""}]), "edge": output(edges=[edge]), "edgekind": output(edges=[edge | {"kind": "calls", "dstId": "route:r"}]),
    }
    raw = spark.createDataFrame([(k, json.dumps(v)) for k, v in cases.items()] + [("broken", "not json" + "x" * 300), ("list", "[1]")], "scanner string, raw string")
    errors = {r["scanner"]: r["error"] for r in protocol.merge_outputs(raw).errors.collect()}
    assert set(errors) == set(cases) - {"good"} | {"broken", "list"}
    assert errors["version"].endswith("version must be 1, got 2") and "duplicate node id" in errors["twice"] and "label must be non-empty; " in errors["empty"] and errors["broken"].endswith("...)")
    known = spark.createDataFrame([("entity:x",)], "id string")
    merged = protocol.merge_outputs(raw, known, failed=spark.createDataFrame([("late", "scanner timed out after 1 s")], "scanner string, error string"))
    assert {r["scanner"] for r in merged.edges.collect()} == {"edge"} and "late" in {r["scanner"] for r in merged.errors.collect()}
    assert merged.nodes.where("scanner = 'good'").first()["properties"] == '{"a":[1,2.5]}'
    assert merged.stats.first().asDict() == {"files_scanned": 2, "nodes_found": 2, "edges_found": 0, "errors": 9, "scanners": 2}
    strict = {r["scanner"] for r in protocol.merge_outputs(spark.createDataFrame([("a", json.dumps(output(warnings=[{"file": "f", "message": "m", "severity": "loud"}]))), ("b", json.dumps(output(nodes=[node | {"source": ""}])))], "scanner string, raw string"), strict=True).errors.collect()}
    assert strict == {"a", "b"}
    assert protocol.merge_outputs(raw.where("false")).stats.first()["scanners"] == 0


def test_commands(spark, tmp_path):
    good = tmp_path / "good.sh"
    good.write_text("#!/bin/sh\ncat > /dev/null\ncat <<'X'\n" + json.dumps(output()) + "\nX\n")
    bad = tmp_path / "bad.sh"
    bad.write_text("#!/bin/sh\necho no >&2\nexit 3\n")
    given = protocol.ScanInput("/p", {"o": 1}, ["dist"])
    assert json.loads(given.json()) == {"version": 1, "projectRoot": "/p", "options": {"o": 1}, "ignorePaths": ["dist"]}
    commands = {"good": f"sh {good}", "bad": f"sh {bad}", "slow": "sleep 5", "none": "", "lost": "/no/such/program"}
    merged = protocol.run_all(spark, commands, dict.fromkeys(commands, given), seconds=0.5)
    errors = {r["scanner"]: r["error"] for r in merged.errors.collect()}
    assert set(errors) == {"bad", "slow", "none", "lost"} and "stderr: no" in errors["bad"] and "timed out" in errors["slow"] and errors["none"] == "empty scanner command"
    assert [r["id"] for r in merged.nodes.collect()] == ["route:r"]


CONFIG = """# settings
version: 1
project:
  name: "shop"
  root: .
  ignorePaths:
    - dist
    - node_modules
scanners:
  express:
    command: node x.js
    options:
      routeGlobs: ["**/*.ts", '**/*.js']
  linker:
    command: node l.js
    phase: link
  odd: {command: run, phase: later}
"""


def test_config(tmp_path):
    for parse in (project.parse_config, lambda t: project.parse_config.__globals__["_simple_yaml"](t)):
        assert parse(CONFIG) is not None
    c = project.parse_config(CONFIG)
    assert (c.name, c.ignore, c.scanners["express"].options) == ("shop", ["dist", "node_modules"], {"routeGlobs": ["**/*.ts", "**/*.js"]})
    simple = project._simple_yaml(CONFIG)
    assert simple["project"]["ignorePaths"] == ["dist", "node_modules"] and simple["scanners"]["odd"] == {"command": "run", "phase": "later"}
    scan, second = project.phases(c)
    assert set(scan) == {"express", "odd"} and set(second) == {"linker"}
    for bad in ("version: 2\nproject:\n  name: x\n", "version: 1\nproject:\n  root: x\n", "", "a: [", "version: 1"):
        with pytest.raises(ValueError):
            project.parse_config(bad)
    with pytest.raises(ValueError):
        project.phases(c, "none")
    with pytest.raises(ValueError):
        project.load_config(str(tmp_path / "none.yaml"))
    at = str(tmp_path / "s" / "config.yaml")
    assert project.write_config(at, c) and not project.write_config(at, c) and project.load_config(at) == c
    assert project.config_path(f"{tmp_path}/s/graph") == at and project.config_path("else") == ".stepweave/config.yaml"
    assert project.ignore_store(str(tmp_path)) and not project.ignore_store(str(tmp_path))
    assert (tmp_path / ".gitignore").read_text().count(".stepweave/graph") == 1


def test_detect(tmp_path, monkeypatch):
    (tmp_path / "go.mod").write_text("module example.org/a/tool\n")
    assert project.detect(str(tmp_path))[:2] == ("tool", "go")
    (tmp_path / "package.json").write_text('{"name": "web", "dependencies": {"express": "1"}, "peerDependencies": {"@orpc/server": "1"}}')
    (tmp_path / "front").mkdir()
    (tmp_path / "front/package.json").write_text('{"devDependencies": {"react-router-dom": "6"}}')
    (tmp_path / "back/prisma").mkdir(parents=True)
    (tmp_path / "back/prisma/schema.prisma").write_text("")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules/package.json").write_text("broken")
    name, kind, found = project.detect(str(tmp_path), "/s")
    assert (name, kind, set(found)) == ("web", "node", {"express", "orpc", "react-router", "prisma"})
    assert found["prisma"].options == {"schemaPath": "back/prisma/schema.prisma"} and found["express"].command == "node /s/express/dist/index.js"
    monkeypatch.setenv(project.SCANNERS_VARIABLE, "/elsewhere")
    assert project.scanners_folder() == "/elsewhere"


def test_files(spark, tmp_path):
    for name, text in {"a.ts": "1", "src/b.ts": "2", "src/dist/c.ts": "3", "src/d e.js": "4", "f/x.feature": "Feature: x\n\tGiven I go \n  * no\n  When \"y\"\n", "f/g/y.feature": "Then z\n"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    found = lambda *a: {r["path"] for r in files.project_files(spark, str(tmp_path), *a).collect()}
    assert found(["**/*.ts"]) == {"a.ts", "src/b.ts", "src/dist/c.ts"} and found(["src/*.{ts,js}"]) == {"src/b.ts", "src/d e.js"}
    assert found(["**/*.ts", "a.*"], ["src/dist"]) == {"a.ts", "src/b.ts"}
    assert [r["path"] for r in files.file_list(files.project_files(spark, str(tmp_path), ["**/*.ts"])).collect()] == ["a.ts", "src/b.ts", "src/dist/c.ts"]
    own = files.feature_files(spark, f"{tmp_path}/**/*.feature")
    steps = sorted((r["file"].split("/")[-1], r["step_no"], r["keyword"], r["text"]) for r in files.feature_steps(own).collect())
    assert steps == [("x.feature", 0, "Given", "I go"), ("x.feature", 1, "When", '"y"'), ("y.feature", 0, "Then", "z")]
    assert files.feature_files(spark, f"{tmp_path}/f/*.feature").count() == 1


LINKED = {
    "src/r.ts": "import './a'; import { b } from './lib';",
    "src/a.ts": "import './b.js'; import 'pkg'; import type { PrismaClient } from '@prisma/client';\nexport function f(db: PrismaClient) { db.user.findMany(); }",
    "src/b.ts": "import './r'; const q = new PrismaClient(); q.Post.create({}); other.tag.x();",
    "src/lib/index.ts": "import '../b'; import './t.spec'",
    "src/lib/t.spec.ts": "const p = new PrismaClient(); p.tag.x()",
    "src/contract.ts": "export const c = 1",
    "src/impl.ts": "import { c } from './contract'; import './b'; os.route.handler(() => 1)",
    "api/break.ts": "export {}",
    "src/break.handlers.ts": "import './a'; x.func(y)",
}


def test_link(spark):
    own = spark.createDataFrame(list(LINKED.items()), "path string, text string")
    facts = scanners.scan(own, scanners.file_facts)
    node = lambda i, kind, name, file=None: (i, kind, name, name, "{}", "scan", file, 1, 1, None)
    nodes = spark.createDataFrame([node("route:1", "route", "r", "src/r.ts"), node("route:2", "route", "c", "src/contract.ts"), node("route:3", "route", "d", "api/break.ts"), node("route:4", "route", "n"), node("entity:U", "entity", "User"), node("entity:P", "entity", "post"), node("entity:T", "entity", "Tag")], NODE_SCHEMA)
    got = {(r["src_id"], r["dst_id"]): props(r) for r in link.link(facts, own, nodes).collect()}
    assert got == {
        ("route:1", "entity:U"): {"tracePath": ["src/r.ts", "src/a.ts"], "depth": 1}, ("route:1", "entity:P"): {"tracePath": ["src/r.ts", "src/a.ts", "src/b.ts"], "depth": 2},
        ("route:2", "entity:P"): {"tracePath": ["src/impl.ts", "src/b.ts"], "depth": 1, "resolvedVia": "reverse-import"},
        ("route:2", "entity:U"): {"tracePath": ["src/impl.ts", "src/b.ts", "src/r.ts", "src/a.ts"], "depth": 3, "resolvedVia": "reverse-import"},
        ("route:3", "entity:U"): {"tracePath": ["src/break.handlers.ts", "src/a.ts"], "depth": 1, "resolvedVia": "reverse-import"},
        ("route:3", "entity:P"): {"tracePath": ["src/break.handlers.ts", "src/a.ts", "src/b.ts"], "depth": 2, "resolvedVia": "reverse-import"},
    }
    deep = {(r["route"], r["entity"]): (r["depth"], r["trace"]) for r in link.link_depth_first(facts, own, nodes).collect()}
    assert deep == {("route:1", "entity:U"): (1, ["src/r.ts", "src/a.ts"]), ("route:1", "entity:P"): (2, ["src/r.ts", "src/a.ts", "src/b.ts"])}
    assert [r["severity"] for r in link.link_warnings(facts, own, nodes.where("kind = 'entity'")).collect()] == ["info"]
    assert link.link(facts, own, nodes.where("kind = 'entity'")).count() == 0


def test_depth_first_order():
    imports = {"r": ["deep", "near"], "deep": ["mid"], "mid": ["near"], "near": ["leaf"], "leaf": []}
    used = {"near": ["N"], "leaf": ["L"]}
    # near is met first behind deep and mid; it is not entered anew on its short way, and the leaf lies out of reach
    assert list(link.search_depth_first([("1", "r")], imports, used, 3)) == [("1", "N", 3, ["r", "deep", "mid", "near"])]
    first, second = (list(link.search_depth_first([("1", "near"), ("2", "r")], imports, used, d)) for d in (8, 1))
    assert [x[1] for x in first] == ["N", "L", "N", "L"] and [x[:3] for x in second] == [("1", "N", 0), ("1", "L", 1), ("2", "N", 1), ("2", "L", 1)]  # the memo serves beyond the depth left


def test_sinks(spark):
    out = io.StringIO()
    sinks.print_json({"a": [1, "é"]}, out)
    assert out.getvalue() == '{\n  "a": [\n    1,\n    "é"\n  ]\n}\n'
    out = io.StringIO()
    df = spark.createDataFrame([("x", 1), ("long", None)], "name string, n int")
    sinks.print_json(df, out)
    assert json.loads(out.getvalue()) == [{"name": "x", "n": 1}, {"name": "long"}]
    out = io.StringIO()
    sinks.print_table(df, out)
    assert out.getvalue() == "NAME  N\nx     1\nlong\n"
    out = io.StringIO()
    sinks.info("hidden", True, out)
    sinks.warn("shown", out)
    assert out.getvalue() == "warning: shown\n" and (sinks.percent(33.333), sinks.score(-1.23456)) == ("33.3%", "-1.2346")


def test_engine(spark, tmp_path):
    p = tmp_path / "app"
    for name, text in {"src/users.ts": "import { PrismaClient } from '@prisma/client'; const db = new PrismaClient(); r.get('/users', list); db.user.findMany()", "prisma/schema.prisma": SCHEMA, "f/a.feature": "Given I list 3 users\nWhen I zap\n"}.items():
        (p / name).parent.mkdir(parents=True, exist_ok=True)
        (p / name).write_text(text)
    e = Engine(spark, f"file://{tmp_path}/graph")
    result = e.scan_sources(str(p), ["express", "prisma"], now=5)
    assert (result.nodes_ingested, result.edges_created, result.errors) == (4, 2, [])
    assert [r["id"] for r in e.query_routes().collect()] == ["route:GET-users:/users"] and [r["id"] for r in e.query_entities("user").collect()]
    own, warnings = e.create_action("List users", patterns=["I list {int} users"], refs={"routes": ["route:GET-users:/users", "route:none"]})
    assert own == "action:list-users" and len(warnings) == 1
    assert e.query_actions().first()["routes"][0]["id"] == "route:GET-users:/users" and {r["id"] for r in e.graph_context(own).nodes.collect()} == {own, "route:GET-users:/users"}
    exact, other, third = e.match_scenario([("Given", "I list 3 users"), ("When", "I list posts"), ("Then", "quux")])
    assert exact["tier"] == "exact" and exact["parameters"] == {"p0": "3"} and exact["refs"]["routes"][0]["id"] == "route:GET-users:/users"
    assert other["tier"] == "fuzzy" and other["candidates"][0]["id"] == own and third["tier"] == "suggest" and third["suggestion"]["patterns"] == ["quux"]
    made, _ = e.create_suggested([exact, other, third])
    assert made == ["action:quux"] and e.create_suggested([third])[1] and e.match_step("quux")["tier"] == "exact"
    with pytest.raises(ValueError):
        e.create_suggested([third], fatal=True)
    per_file, total = e.coverage(f"{p}/**/*.feature")
    assert [(r["steps"], r["exact"]) for r in per_file.collect()] == [(2, 1)] and total.first()["pct"] == 50.0
    e.update_action(own, label="L", refs={"routes": []})
    assert e.query_actions().where(F.col("id") == own).first()["routes"] is None
    e.delete_action(own)
    assert {r["kind"]: r["cnt"] for r in e.stats().collect()}["action"] == 1
    # a link scanner's edges replace those it gave before
    script = tmp_path / "l.sh"
    script.write_text("#!/bin/sh\ncat > /dev/null\necho '" + json.dumps(output(nodes=[], edges=[{"id": "l1", "srcId": "route:GET-users:/users", "dstId": "entity:User", "kind": "touches_entity"}])) + "'\n")
    c = project.Config("x", str(p), [], {"link": project.ScannerConfig(f"sh {script}", {}, "link")})
    assert e.scan(c)[0].edges_created == 1 and e.scan(c)[0].edges_created == 1
    assert e.graph.edges.where("source_scanner = 'link'").count() == 1
    assert Engine(spark, f"file://{tmp_path}/graph").graph.nodes.count() == e.graph.nodes.count()


def test_stream(spark, tmp_path):
    from stepweave.streaming.ingest import follow

    e = Engine(spark, f"file://{tmp_path}/graph")
    (tmp_path / "in").mkdir()
    (tmp_path / "in/one.json").write_text(json.dumps(output()))
    (tmp_path / "in/bad.json").write_text(json.dumps(output(version=9)))
    told = []
    for _ in range(2):
        follow(e, f"{tmp_path}/in", f"{tmp_path}/checkpoint", once=True, told=lambda n, r: told.append((n, r.nodes_ingested, r.errors))).awaitTermination()
        (tmp_path / "in/two.json").write_text(json.dumps(output(nodes=[output()["nodes"][0] | {"label": "new"}, output()["nodes"][0] | {"id": "route:s"}])))
    assert [t[:2] for t in told] == [(0, 1), (1, 2)] and told[0][2][0][0] == "bad"
    assert {r["id"]: r["label"] for r in e.graph.nodes.collect()} == {"route:r": "new", "route:s": "r"}


def test_rejected_source(spark, tmp_path):
    """A node's source is checked when it is taken in, and then nothing is."""
    e = Engine(spark, f"file://{tmp_path}/graph")
    raw = spark.createDataFrame([("s", json.dumps(output(nodes=[output()["nodes"][0] | {"source": "robot"}])))], "scanner string, raw string")
    with pytest.raises(ValueError):
        e.ingest(protocol.merge_outputs(raw))
    assert e.graph.nodes.count() == 0


def test_properties(spark):
    from stepweave.functions import properties

    df = spark.createDataFrame([('{"a": [1, 2.5, "x"], "b": ["p", 3, "q"]}',), (None,), ("",), ("broken{",)], "p string")
    got = df.select(properties.encode(properties.decode(F.col("p"))).alias("e"), properties.strings(F.col("p"), "b").alias("b")).collect()
    assert json.loads(got[0]["e"]) == {"a": [1, 2.5, "x"], "b": ["p", 3, "q"]} and got[0]["b"] == ["p", "q"]
    assert [r["e"] for r in got[1:]] == ["{}"] * 3 and got[1]["b"] is None
    assert df.select(properties.encode(F.lit(None).cast("map<string,string>")).alias("e")).first()["e"] == "{}"


def test_empty_graph(spark):
    g = Graph(spark.createDataFrame([], NODE_SCHEMA), spark.createDataFrame([], EDGE_SCHEMA))
    from stepweave.operators import search

    assert search.search(search.index(g.nodes), "a OR b").count() == 0
