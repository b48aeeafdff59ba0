"""What sources say of an application: routes, entities, pages and what files import, as rows of nodes, edges and warnings.

Each reader is a plain function of one file; ``scan`` runs it over a table of files(path, text), one task's files at a time.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepweave.functions.text import CONTRACT_HEAD, CONTRACT_TAILS, ROUTER_HEAD, ROUTER_TAILS

from .script import Braces, Call, Element, Script, Token, literal

# Methods of routers, where page and schema files usually are, what tells tests and pages, and the patterns of
# names, schema blocks, fields and their attributes.
METHODS = ("get", "post", "put", "delete", "patch", "options", "head", "all")
PAGE_FILES = (
    "src/routes.tsx", "src/routes.ts", "app/routes.tsx", "app/routes.ts", "src/app/routes.tsx", "src/app/routes.ts", "src/App.tsx", "src/App.jsx",
    "src/MainApp.tsx", "src/MainApp.jsx", "frontend/src/App.tsx", "frontend/src/App.jsx", "frontend/src/MainApp.tsx", "frontend/src/MainApp.jsx",
)
SCHEMA_FILES = ("prisma/schema.prisma", "backend/prisma/schema.prisma", "server/prisma/schema.prisma", "api/prisma/schema.prisma", "schema.prisma")
TEST_FILE = r"(\.spec\.|\.test\.|__tests__|/tests?/)"
PAGE_MARKS = ("<Route", "createBrowserRouter", "createRoutesFromElements")
NO_PAGES = r"node_modules|dist/|build/|\.next/"
BLOCK, FIELD = r"^{}\s+(\w+)\s*\{{([\s\S]*?)^\}}", r"^(\w+)\s+(\w+)(\[\])?(\?)?(\[\])?\s*(.*)$"
DEFAULT, RELATION, TABLE = r"@default\(([^)]*(?:\([^)]*\))?[^)]*)\)", r"@relation\(([^)]*)\)", r'@@map\("([^"]+)"\)'
FIELDS, REFERENCES = r"fields:\s*\[([^\]]*)\]", r"references:\s*\[([^\]]*)\]"
# End of fixed values.
ROWS = "path string, pos int, what string, id string, kind string, name string, label string, properties string, src_id string, dst_id string, severity string, message string"
_COLUMNS = [x.split()[0] for x in ROWS.split(", ")]


def _row(path: str, pos: int, what: str, **fields) -> dict:
    if isinstance(fields.get("properties"), dict):
        fields["properties"] = json.dumps(fields["properties"], ensure_ascii=False, separators=(",", ":"))
    return dict.fromkeys(_COLUMNS) | {"path": path, "pos": pos, "what": what} | fields


# --- routes


def router_name(path: str) -> str:
    """A router's name from its file: usual folders, extensions and a last /index are taken off; of nothing left, the path."""
    name = re.sub(ROUTER_HEAD, "", path)
    for tail in ROUTER_TAILS:
        name = re.sub(tail, "", name)
    return name or path


def _argument(script: Script, tokens: list[Token]) -> str:
    """A name for an argument: its own, that of the function it calls, else its source."""
    if tokens[-1].text == ")" and len(tokens) > 1:
        depth = {id(t): k for k, t in enumerate(tokens)}
        opened = next((k for k in range(len(tokens) - 1, -1, -1) if tokens[k].text == "(" and _closed_by(tokens, k, depth)), None)
        if opened and tokens[opened - 1].kind == "word" and all(t.kind == "word" or t.text in (".", "?.") or t.match >= 0 for t in tokens[:opened]):
            if opened == 1 or tokens[opened - 2].text in (".", "?."):
                return tokens[opened - 1].text
    return script.source(tokens)


def _closed_by(tokens: list[Token], k: int, places: dict[int, int]) -> bool:
    """Whether the bracket at k, of a slice of tokens, closes at the slice's end."""
    own, depth = tokens[k], 0
    for t in tokens[k:]:
        depth += (t.kind == "mark" and t.text in "([{") - (t.kind == "mark" and t.text in (")", "]", "}"))
        if not depth:
            return t is tokens[-1] and own is not t
    return False


def _text_of(tokens: list[Token]) -> str | None:
    return literal(tokens[0].text) if len(tokens) == 1 and tokens[0].kind == "string" else None


def _route(script: Script, path: str, pos: int, call: Call, url: str, arguments: list[list[Token]]) -> dict:
    method, names = call.name.upper(), [_argument(script, a) for a in arguments]
    label = f"{method} {url}"
    return _row(path, pos, "node", id=f"route:{method}-{router_name(path)}:{url}", kind="route", name=label, label=label, properties={"method": method, "path": url, "middleware": names[:-1], "handler": names[-1] if names else ""})


def express_routes(path: str, text: str) -> Iterator[dict]:
    """router.get("/path", ..., handler), and router.route("/path").get(...).put(...) of up to 20 calls."""
    script, pos = Script(text), 0
    for call in script.calls():
        if not call.member:
            continue
        arguments = call.arguments()
        url = _text_of(arguments[0]) if arguments else None
        if url is None:
            continue
        if call.name.lower() in METHODS:
            if not call.on_call and len(arguments) > 1:
                yield _route(script, path, pos, call, url, arguments[1:])
                pos += 1
        elif call.name == "route":
            for _ in range(20):
                call = call.chained()
                if call is None:
                    break
                if call.name.lower() in METHODS:
                    yield _route(script, path, pos, call, url, call.arguments())
                    pos += 1


def contract_name(path: str) -> str:
    name = re.sub(CONTRACT_HEAD, "", path)
    for tail in CONTRACT_TAILS:
        name = re.sub(tail, "", name)
    return name


def _members(tokens: list[Token]) -> dict[str, list[Token]]:
    """name: value of an object literal."""
    out = {}
    if tokens and tokens[0].text == "{" and tokens[-1].text == "}":
        for own in _parts(tokens[1:-1]):
            if len(own) > 2 and own[1].text == ":":
                key = literal(own[0].text) if own[0].kind == "string" else own[0].text
                out.setdefault(key, own[2:])
    return out


def _parts(tokens: list[Token], mark: str = ",") -> list[list[Token]]:
    """Like ``split``, of a slice whose brackets are told by their text."""
    out, own, depth = [], [], 0
    for t in tokens:
        if t.kind == "mark" and t.text in ("(", "[", "{"):
            depth += 1
        elif t.kind == "mark" and t.text in (")", "]", "}"):
            depth -= 1
        if not depth and t.kind == "mark" and t.text == mark:
            out.append(own)
            own = []
        else:
            own.append(t)
    return [x for x in [*out, own] if x]


def orpc_routes(path: str, text: str) -> Iterator[dict]:
    """.route({method, path, ...}) with the schemas of .input() and .output() among the five calls after it."""
    script, contract, pos = Script(text), contract_name(path), 0
    for call in script.calls():
        if not call.member or call.name != "route" or not call.arguments():
            continue
        config = _members(call.arguments()[0])
        method, url, summary = (_text_of(config.get(k, [])) if config.get(k) else None for k in ("method", "path", "summary"))
        if not method or not url:
            continue
        properties: dict = {"method": method, "path": url, "contractFile": path}
        if summary is not None:
            properties["summary"] = summary
        tags, status = config.get("tags", []), config.get("successStatus", [])
        if tags and tags[0].text == "[":
            properties["tags"] = [literal(x[0].text) if len(x) == 1 and x[0].kind == "string" else script.source(x) for x in _parts(tags[1:-1])]
        if len(status) == 1 and status[0].kind == "number":
            n = float(status[0].text.replace("_", "")) if not status[0].text[:2].lower() in ("0x", "0b", "0o") else int(status[0].text, 0)
            properties["successStatus"] = int(n) if n == int(n) else n
        schemas, own = {}, call
        for _ in range(5):
            own = own.chained()
            if own is None:
                break
            if own.name in ("input", "output") and own.arguments():
                schemas[f"{own.name}Schema"] = script.source(own.arguments()[0])
        properties |= {k: schemas[k] for k in ("inputSchema", "outputSchema") if k in schemas}
        name = f"[{contract}] {method} {url}"
        yield _row(path, pos, "node", id=f"route:{method}-{contract}:{url}", kind="route", name=name, label=summary or name, properties=properties)
        pos += 1


# --- pages


def compose_path(parent: str | None, local: str | None, index: bool) -> str:
    if index or not local:
        return "/" if parent is None else parent
    if local.startswith("/") or not parent:
        return local
    return f"{parent.removesuffix('/')}/{local}"


def _above(element: Element) -> Iterator[Element | Braces]:
    at = element.inside
    while at is not None:
        yield at
        at = at.owner if isinstance(at, Braces) else at.inside


def _parent_path(element: Element) -> str | None:
    """The path of the nearest Route around an element that has one, with what is around that."""
    for x in _above(element):
        if isinstance(x, Element) and x.tag == "Route" and not x.closed and isinstance(x.attributes.get("path"), str) and x.attributes["path"]:
            own, up = x.attributes["path"], _parent_path(x)
            return f"{up.removesuffix('/')}/{own}" if up and not own.startswith("/") else own
    return None


def _protected(script: Script, element: Element) -> bool:
    """Inside an expression cond ? ... : ... whose second branch names Navigate."""
    for x in _above(element):
        if isinstance(x, Braces):
            halves = _parts(x.tokens, "?")
            if len(halves) > 1:
                rest = [t for t in x.tokens if t.start > halves[0][-1].end]
                depth, nested = 0, 0
                for k, t in enumerate(rest[1:], 1):
                    if t.kind == "mark":
                        depth += (t.text in ("(", "[", "{")) - (t.text in (")", "]", "}"))
                        nested += (not depth and t.text == "?") - (not depth and t.text == ":")
                    if nested < 0:
                        if "Navigate" in script.source(rest[k + 1 :]):
                            return True
                        break
    return False


def react_pages(path: str, text: str) -> Iterator[dict]:
    """<Route element={<Component/>} ...>; those without children come first. Routes without a component are no pages."""
    script, pos = Script(text), 0
    routes = sorted((e for e in script.elements if e.tag == "Route"), key=lambda e: (not e.closed, e.start))
    by_start = {e.start: e for e in script.elements}
    for e in routes:
        shown = e.attributes.get("element")
        if not isinstance(shown, Braces) or len(shown.tokens) != 1 or shown.tokens[0].kind != "jsx" or not by_start[shown.tokens[0].start].tag:
            continue
        local, index, parent = e.attributes.get("path"), "index" in e.attributes, _parent_path(e)
        full, component = compose_path(parent, local if isinstance(local, str) else None, index), by_start[shown.tokens[0].start].tag
        properties = {"path": full, "component": component, "isProtected": _protected(script, e), "isIndex": index} | ({} if parent is None else {"parentPath": parent})
        yield _row(path, pos, "node", id=f"page:{full}", kind="page", name=full, label=component, properties=properties)
        pos += 1


# --- entities

def _names_in(pattern: str, text: str) -> list[str] | None:
    m = re.search(pattern, text)
    return [x.strip() for x in m[1].split(",")] if m else None


def entity_field(line: str) -> dict | None:
    """A line of a model: its name, type and attributes; None for anything else."""
    line = line.strip()
    m = re.match(FIELD, line, re.ASCII) if line and not line.startswith(("//", "@@")) else None
    if not m:
        return None
    name, kind, rest, many = m[1], m[2], m[6], bool(m[3] or m[5])
    optional = bool(re.match(r"^\w+\?", line.split()[1]))
    default, relation = re.search(DEFAULT, rest), re.search(RELATION, rest)
    out = {"name": name, "type": kind, "isRequired": not optional and not many, "isList": many, "isId": "@id" in rest, "isUnique": "@unique" in rest, "hasDefault": "@default" in rest}
    if default:
        out["defaultValue"] = default[1]
    if "@updatedAt" in rest:
        out["isUpdatedAt"] = True
    held = relation[1] if relation else ""
    return {"meta": out, "fields": _names_in(FIELDS, held), "references": _names_in(REFERENCES, held)}


def prisma_entities(path: str, text: str) -> Iterator[dict]:
    """Models with their fields and relations, enums with their values, and an edge for each field that holds a relation's key."""
    blocks = lambda kind: [(m[1], m[2]) for m in re.finditer(BLOCK.format(kind), text, re.M)]
    models = [(name, body, [f for f in map(entity_field, body.split("\n")) if f]) for name, body in blocks("model")]
    known, pos = {name for name, _, _ in models}, 0
    for name, body, fields in models:
        relations = []
        for f in fields:
            meta = f["meta"]
            if meta["type"] in known or f["fields"]:
                own = {"fieldName": meta["name"], "relatedModel": meta["type"], "isList": meta["isList"]}
                relations.append(own | ({"relationFields": f["fields"]} if f["fields"] else {}) | ({"relationReferences": f["references"]} if f["references"] else {}))
            if f["fields"]:
                key = next((x["meta"] for x in fields if x["meta"]["name"] == f["fields"][0]), None)
                relation = "one-to-many" if meta["isList"] else "one-to-one" if key and key["isUnique"] else "many-to-one"
                yield _row(path, pos, "edge", id=f"edge:entity:{name}-field_relation:{meta['name']}-entity:{meta['type']}", src_id=f"entity:{name}", dst_id=f"entity:{meta['type']}", kind="field_relation", properties={"fieldName": meta["name"], "relationType": relation})
                pos += 1
        table = re.search(TABLE, body)
        properties = {"isEnum": False, "fields": [f["meta"] for f in fields], "relations": relations} | ({"tableName": table[1]} if table else {})
        yield _row(path, pos, "node", id=f"entity:{name}", kind="entity", name=name, label=name, properties=properties)
        pos += 1
    for name, body in blocks("enum"):
        values = [x for line in body.split("\n") if (x := line.strip()) and not x.startswith("//")]
        yield _row(path, pos, "node", id=f"entity:{name}", kind="entity", name=name, label=name, properties={"isEnum": True, "values": values})
        pos += 1


# --- what files import and which entities they use


def client_names(script: Script) -> set[str]:
    """Names of variables and parameters that are database clients; where the client's package is imported and none is found, the usual one."""
    names = set()
    for own in script.lists:
        opened: list[int] = []
        for k, t in enumerate(own):
            if t.kind == "mark" and t.text in "([{":
                opened.append(k)
            elif t.kind == "mark" and t.text in (")", "]", "}") and opened:
                opened.pop()
            if t.text != "PrismaClient" or t.kind != "word":
                continue
            if k > 2 and own[k - 1].text == "new" and own[k - 2].text == "=" and own[k - 3].kind == "word" and not (k > 3 and own[k - 4].text in (".", "?.")):
                names.add(own[k - 3].text)
                continue
            n = k - 1  # back over a type to name:, then tell a variable or a parameter from a property
            while n > 0 and own[n].text not in (":", ",", ";", "(", ")", "{", "}", "="):
                n -= 1
            if n > 0 and own[n].text == ":" and own[n - 1].text in ("?", "!"):
                n -= 1
            if n > 0 and own[n].text in (":", "?", "!") and own[n - 1].kind == "word":
                before = own[n - 2].text if n > 1 else ""
                if before in ("const", "let", "var") or opened and own[opened[-1]].text == "(" and before in ("(", ",", "private", "public", "protected", "readonly", "override", "..."):
                    names.add(own[n - 1].text)
    return names or ({"prisma"} if any("@prisma/client" in x for x in script.imports()) else set())


def file_facts(path: str, text: str) -> Iterator[dict]:
    """import rows (name: what is imported) in order, access rows (name: the model, in lower case), and a handler row where routes are implemented."""
    script = Script(text)
    pos = 0
    for pos, name in enumerate(script.imports()):  # noqa: B007
        yield _row(path, pos, "import", name=name)
    clients = client_names(script)
    models = dict.fromkeys(p[1].lower() for c in script.calls() if (p := c.path()) and len(p) == 3 and p[0] in clients)
    for k, name in enumerate(models):
        yield _row(path, k, "access", name=name)
    if ".handler(" in text or ".func(" in text:
        yield _row(path, 0, "handler")


def scan(files: DataFrame, reader: Callable[[str, str], Iterator[dict]]) -> DataFrame:
    """ROWS of files(path, text): what the reader finds in each; a file that it can't read gives one row "warning" of severity error, and the others go on."""

    def run(batches):
        for b in batches:
            out = []
            for path, text in zip(b["path"], b["text"], strict=True):
                try:
                    out += list(reader(path, text or ""))
                except Exception as e:  # any fault of one file must not stop the others
                    out.append(_row(path, 0, "warning", severity="error", message=f"Failed to parse: {e}"))
            yield pd.DataFrame(out, columns=_COLUMNS)

    return files.select("path", "text").mapInPandas(run, ROWS)


def ignored(path: Column, prefixes: list[str]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | (path == p) | path.startswith(p + "/")
    return out


def page_files(files: DataFrame, configured: list[str] | None = None, ignore: list[str] | None = None) -> DataFrame:
    """The configured files; else those in the usual places; else TSX and JSX files that define routes."""
    kept = files.where(~ignored(F.col("path"), ignore or []))
    if configured:
        return kept.where(F.col("path").isin(configured))
    usual = files.where(F.col("path").isin(*PAGE_FILES))
    if not usual.isEmpty():
        return usual.where(~ignored(F.col("path"), ignore or []))
    marked = F.lit(False)
    for m in PAGE_MARKS:
        marked = marked | F.col("text").contains(m)
    return kept.where(F.col("path").rlike(r"\.(tsx|jsx)$") & ~F.col("path").rlike(NO_PAGES) & marked)


def schema_file(files: DataFrame, path: str | None = None, ignore: list[str] | None = None) -> tuple[DataFrame, list[dict]]:
    """The schema's row, the first that is there of the given or default path and the fallbacks; and a warning where none is. An ignored one gives neither."""
    order = [path or SCHEMA_FILES[0], *SCHEMA_FILES[1:]]
    there = {r["path"] for r in files.where(F.col("path").isin(order)).select("path").collect()}
    chosen = next((p for p in order if p in there), order[0])
    if any(chosen == p or chosen.startswith(p + "/") for p in ignore or []):
        return files.where("false"), []
    return files.where(F.col("path") == chosen), [] if there else [_row(chosen, 0, "warning", severity="error", message="Failed to read schema file: no such file")]


SCANNERS = {"express": express_routes, "orpc": orpc_routes, "react-router": react_pages, "prisma": prisma_entities}
_FILES = {"express": r"\.(ts|js)$", "orpc": r"\.ts$"}


def scan_project(files: DataFrame, scanner: str, ignore: list[str] | None = None, options: dict | None = None) -> DataFrame:
    """ROWS of one scanner over files(path, text) of a project, ids made unique where the scanner does: #2, #3, ... in order of path and place."""
    options = options or {}
    if scanner in _FILES:
        own = files.where(F.col("path").rlike(_FILES[scanner]) & ~ignored(F.col("path"), ignore or []))
        own = own.where(~F.concat(F.lit("/"), "path").rlike(TEST_FILE)) if scanner == "express" else own
        if globs := options.get("routeGlobs" if scanner == "express" else "contractGlobs"):
            from .files import glob_regex

            own = own.where(F.col("path").rlike("|".join(map(glob_regex, globs))))
        missing: list[dict] = []
    elif scanner == "react-router":
        own, missing = page_files(files, options.get("routeFiles"), ignore), []
    else:
        own, missing = schema_file(files, options.get("schemaPath"), ignore)
    rows = scan(own, SCANNERS[scanner])
    if missing:
        rows = rows.unionByName(files.sparkSession.createDataFrame([tuple(r[c] for c in _COLUMNS) for r in missing], ROWS))
    if scanner in ("express", "react-router"):
        keys = ["what", "id", "path"] if scanner == "express" else ["what", "id"]
        k = F.row_number().over(Window.partitionBy(*keys).orderBy("path", "pos"))
        rows = rows.withColumn("_k", k).withColumn("id", F.when((F.col("what") == "node") & (F.col("_k") > 1), F.concat("id", F.lit("#"), F.col("_k").cast("string"))).otherwise(F.col("id"))).drop("_k")
    return rows


def as_output(rows: DataFrame, files: DataFrame):
    """ROWS with their scanner as outputs that were accepted."""
    from .protocol import Merged

    text = lambda c: F.coalesce(c, F.lit(""))
    nodes = rows.where("what = 'node'").select("scanner", F.struct("path", "pos").alias("pos"), "id", "kind", "name", "label", "properties", F.lit("scan").alias("source"), F.col("path").alias("source_file"))
    edges = rows.where("what = 'edge'").select("scanner", F.struct("path", "pos").alias("pos"), "id", "src_id", "dst_id", "kind", "properties")
    warnings = rows.where("what = 'warning'").select("scanner", F.col("path").alias("file"), F.lit(None).cast("int").alias("line"), text("message").alias("message"), "severity")
    counts = rows.agg(*[F.count_if(c).alias(n) for n, c in (("nodes_found", F.col("what") == "node"), ("edges_found", F.col("what") == "edge"), ("errors", F.col("severity") == "error"))], F.countDistinct("path").alias("files_scanned"), F.countDistinct("scanner").alias("scanners"))
    return Merged(nodes, edges, warnings, counts, rows.where("false").select("scanner", F.col("message").alias("error")))
