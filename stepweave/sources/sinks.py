"""Results as text: JSON, aligned tables, messages."""

from __future__ import annotations

import json
import sys
from collections.abc import Iterable
from typing import TextIO

from pyspark.sql import DataFrame


def print_json(value, to: TextIO | None = None) -> None:
    """Two spaces of indent; a DataFrame row by row, as an array, without gathering it."""
    to = to or sys.stdout
    if not isinstance(value, DataFrame):
        to.write(json.dumps(value, indent=2, ensure_ascii=False, default=str) + "\n")
        return
    first = True
    for row in value.toJSON().toLocalIterator():
        own = json.dumps(json.loads(row), indent=2, ensure_ascii=False)
        to.write(("[\n" if first else ",\n") + "\n".join("  " + x for x in own.split("\n")))
        first = False
    to.write("[]\n" if first else "\n]\n")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def table(headers: list[str], rows: Iterable[Iterable]) -> str:
    """Columns as wide as their widest value, two spaces apart."""
    own = [headers, *[["" if v is None else str(v) for v in r] for r in rows]]
    widths = [max(len(r[k]) for r in own) for k in range(len(headers))]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(r, widths, strict=True)).rstrip() for r in own)


def print_table(df: DataFrame, to: TextIO | None = None) -> None:
    (to or sys.stdout).write(table([c.upper() for c in df.columns], df.toLocalIterator()) + "\n")


def percent(x: float) -> str:
    return f"{x:.1f}%"


def score(x: float) -> str:
    return f"{x:.4f}"


def info(text: str, quiet: bool = False, to: TextIO | None = None) -> None:
    if not quiet:
        (to or sys.stdout).write(text + "\n")


def warn(text: str, to: TextIO | None = None) -> None:
    """Warnings are said whether or not the rest is quiet."""
    (to or sys.stderr).write(f"warning: {text}\n")
