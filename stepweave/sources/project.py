"""A project's settings and what it is made of: driver-side files, small by nature."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field
from pathlib import Path

FOLDER, CONFIG, STORE = ".stepweave", "config.yaml", "graph"
SCANNERS_VARIABLE = "STEPWEAVE_SCANNERS"


@dataclass
class ScannerConfig:
    command: str = ""
    options: dict = field(default_factory=dict)
    phase: str = ""


@dataclass
class Config:
    name: str
    root: str = ""
    ignore: list[str] = field(default_factory=list)
    scanners: dict[str, ScannerConfig] = field(default_factory=dict)


def _scalar(text: str):
    text = text.strip()
    if text[:1] in ("[", "{"):
        inner = text[1:-1].strip()
        if text[0] == "{":
            return {k.strip().strip("\"'"): _scalar(v) for k, _, v in (x.partition(":") for x in re.split(r",\s*", inner) if x)}
        return [_scalar(x) for x in re.split(r",\s*", inner) if x]
    if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'":
        return text[1:-1]
    if text in ("", "~", "null"):
        return None
    if text in ("true", "false"):
        return text == "true"
    return int(text) if re.fullmatch(r"[-+]?\d+", text) else float(text) if re.fullmatch(r"[-+]?\d*\.\d+", text) else text


def _simple_yaml(text: str):
    """Block mappings and lists, scalars and one-line [..] and {..}: what settings are written in."""
    lines = [(len(x) - len(x.lstrip()), x.strip()) for raw in text.split("\n") if (x := re.sub(r"(^|\s)#.*$", "", raw).rstrip()) and x.strip() != "---"]

    def block(at: int, indent: int):
        if lines[at][1].startswith("-"):
            out: list | dict = []
            while at < len(lines) and lines[at][0] == indent and lines[at][1].startswith("-"):
                out.append(_scalar(lines[at][1][1:]))
                at += 1
            return out, at
        out = {}
        while at < len(lines) and lines[at][0] == indent:
            key, colon, value = lines[at][1].partition(":")
            if not colon:
                raise ValueError(f"parsing config: {lines[at][1]!r}")
            key, at = key.strip().strip("\"'"), at + 1
            if value.strip():
                out[key] = _scalar(value)
            elif at < len(lines) and (lines[at][0] > indent or lines[at][0] == indent and lines[at][1].startswith("-")):
                out[key], at = block(at, lines[at][0])
            else:
                out[key] = None
        if at < len(lines) and lines[at][0] > indent:
            raise ValueError(f"parsing config: {lines[at][1]!r}")
        return out, at

    return block(0, lines[0][0])[0] if lines else {}


def parse_config(text: str) -> Config:
    """Settings of version 1 with a project's name; anything else raises ValueError."""
    try:
        import yaml
    except ImportError:
        found = _simple_yaml(text)
    else:
        try:
            found = yaml.safe_load(text)
        except yaml.YAMLError as e:
            raise ValueError(f"parsing config: {e}") from e
    if not isinstance(found, dict | None):
        raise ValueError("parsing config: not a mapping")
    found = found or {}
    if found.get("version") != 1:
        raise ValueError(f"unsupported config version: {found.get('version') or 0} (expected 1)")
    project = found.get("project") or {}
    if not project.get("name"):
        raise ValueError("project.name is required")
    scanners = {k: ScannerConfig((v or {}).get("command") or "", (v or {}).get("options") or {}, (v or {}).get("phase") or "") for k, v in (found.get("scanners") or {}).items()}
    return Config(str(project["name"]), project.get("root") or "", project.get("ignorePaths") or [], scanners)


def load_config(path: str) -> Config:
    try:
        return parse_config(Path(path).read_text())
    except OSError as e:
        raise ValueError(f"reading config: {e}") from e


def config_path(store: str) -> str:
    """Beside a store of the usual name, else the default place."""
    at = Path(store)
    return str(at.parent / CONFIG) if at.name == STORE else f"{FOLDER}/{CONFIG}"


def write_config(path: str, config: Config, force: bool = False) -> bool:
    """Writes settings unless there are some; whether it did. Values are JSON, which settings may be written in."""
    at = Path(path)
    if at.exists() and not force:
        return False
    at.parent.mkdir(parents=True, exist_ok=True)
    q = json.dumps
    lines = ["version: 1", "project:", f"  name: {q(config.name)}", f"  root: {q(config.root)}"]
    lines += [f"  ignorePaths: {q(config.ignore)}"] if config.ignore else []
    lines += ["scanners:"] if config.scanners else ["scanners: {}"]
    for name, s in sorted(config.scanners.items()):
        lines += [f"  {name}:", f"    command: {q(s.command)}", f"    options: {q(s.options)}"] + ([f"    phase: {s.phase}"] if s.phase else [])
    at.write_text("\n".join(lines) + "\n")
    return True


def ignore_store(root: str) -> bool:
    """Names the store in .gitignore, once; whether that changed the file."""
    at, entry = Path(root) / ".gitignore", f"{FOLDER}/{STORE}"
    old = at.read_text() if at.exists() else ""
    if entry in (x.strip() for x in old.split("\n")):
        return False
    head = old if not old or old.endswith("\n") else old + "\n"
    at.write_text((head or "# The graph's store, made anew by a scan\n") + entry + "\n")
    return True


def scanners_folder(beside: str | None = None) -> str:
    """Where scanners are: the variable's folder, else one named scanners beside or above the given file; else nowhere."""
    if found := os.environ.get(SCANNERS_VARIABLE):
        return found
    near = [Path(beside).resolve().parent / x for x in ("scanners", "../scanners")] if beside else []
    return next((str(x.resolve()) for x in near if x.is_dir()), "")


def scanner_command(name: str, folder: str = "") -> str:
    return f"node {folder or 'scanners'}/{name}/dist/index.js"


def dependencies(package: dict) -> set[str]:
    """All names that a package depends on, however."""
    return {name for key in ("dependencies", "devDependencies", "peerDependencies") for name in (package.get(key) if isinstance(package.get(key), dict) else {})}


def _json(path: Path) -> dict | None:
    try:
        found = json.loads(path.read_text())
    except (OSError, ValueError):
        return None
    return found if isinstance(found, dict) else {}


def detect(root: str, folder: str = "") -> tuple[str, str, dict[str, ScannerConfig]]:
    """(name, type, scanners) by a project's files, those of folders one level down too."""
    top = Path(root).resolve()
    name, kind, scanners, needed = top.name or "project", "unknown", {}, set()
    if (module := top / "go.mod").exists():
        kind = "go"
        m = re.search(r"^module (\s*\S+)", module.read_text(), re.M)
        name = m[1].split("/")[-1].strip() if m else name
    if (package := _json(top / "package.json")) is not None or (top / "package.json").exists():
        kind = "node"
        package = package or {}
        name = package["name"] if isinstance(package.get("name"), str) and package["name"] else name
        needed |= dependencies(package)
    below = sorted(x for x in top.iterdir() if x.is_dir() and not x.name.startswith(".") and x.name != "node_modules")
    for x in below:
        if (x / "package.json").exists():
            kind = "node"
            needed |= dependencies(_json(x / "package.json") or {})
    if "express" in needed:
        scanners["express"] = ScannerConfig(scanner_command("express", folder), {"routeGlobs": ["**/*.ts", "**/*.js"]})
    places = [p for x in (top, *below) for p in (x / "prisma/schema.prisma", x / "schema.prisma")]
    if schema := next((p for p in places if p.exists()), None):
        own = schema.relative_to(top).as_posix()
        scanners["prisma"] = ScannerConfig(scanner_command("prisma", folder), {} if own == "prisma/schema.prisma" else {"schemaPath": own})
    if needed & {"react-router", "react-router-dom"}:
        scanners["react-router"] = ScannerConfig(scanner_command("react-router", folder))
    if any(x.startswith("@orpc/") for x in needed):
        scanners["orpc"] = ScannerConfig(scanner_command("orpc", folder), {"contractGlobs": ["**/*.ts"]})
    return name, kind, scanners


def phases(config: Config, only: str | None = None) -> tuple[dict[str, ScannerConfig], dict[str, ScannerConfig]]:
    """(scan phase, link phase) of the scanners, or of one; any phase but link is scan."""
    own = {k: v for k, v in config.scanners.items() if only is None or k == only}
    if not own:
        raise ValueError(f"no scanner found with ID {only!r}" if only else "no scanners configured")
    return {k: v for k, v in own.items() if v.phase != "link"}, {k: v for k, v in own.items() if v.phase == "link"}
