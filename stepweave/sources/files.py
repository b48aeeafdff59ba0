"""Files of a project as tables: sources by path and text, step files by line, and globs as patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.operators.match import parse_steps


def glob_regex(glob: str) -> str:
    """A glob as an anchored pattern: * and ? within a folder's name, ** over folders, {a,b} either, [...] one of."""
    out, at = [], 0
    while at < len(glob):
        c = glob[at]
        if glob.startswith("**/", at):
            out.append("(?:[^/]+/)*")
            at += 3
            continue
        if glob.startswith("**", at):
            out.append(".*")
            at += 2
            continue
        if c == "[" and (end := glob.find("]", at + 2)) > 0:
            inner = glob[at + 1 : end].replace("\\", "\\\\")
            out.append("[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]")
            at = end + 1
            continue
        if c == "{" and (end := glob.find("}", at)) > 0:
            out.append("(?:" + "|".join(glob_regex(x)[1:-1] for x in glob[at + 1 : end].split(",")) + ")")
            at = end + 1
            continue
        out.append("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c))
        at += 1
    return "^" + "".join(out) + "$"


def _relative(root: str) -> Column:
    """The path below root, of the full name of a file; a scheme and repeated slashes of either do not matter."""
    plain = re.sub(r"^[a-z][a-z0-9+.-]*:/*", "/", root).rstrip("/") + "/"
    full = F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B"))
    return F.substring_index(F.regexp_replace(full, r"^[a-z][a-z0-9+.-]*:/*(?:[^/]+(?=/)(?=.*" + re.escape(plain) + "))?", "/"), plain, -1)


def project_files(spark: SparkSession, root: str, globs: list[str] | None = None, ignore: list[str] | None = None) -> DataFrame:
    """files(path, text) below a root, paths relative to it: those that any glob fits, without the ignored ones, each once."""
    found = spark.read.option("recursiveFileLookup", "true").text(root, wholetext=True)
    return kept(found.select(_relative(root).alias("path"), F.col("value").alias("text")), globs, ignore)


def kept(files: DataFrame, globs: list[str] | None = None, ignore: list[str] | None = None) -> DataFrame:
    """files(path) that any glob fits, without the ignored ones and what lies below them."""
    if globs:
        files = files.where(F.col("path").rlike("|".join(map(glob_regex, globs))))
    for p in ignore or []:
        files = files.where((F.col("path") != p) & ~F.col("path").startswith(p + "/"))
    return files


def file_list(files: DataFrame) -> DataFrame:
    """(path): each once, in order."""
    return files.select("path").distinct().orderBy("path")


def feature_files(spark: SparkSession, pattern: str = "**/*.feature") -> DataFrame:
    """files(path, text) of step files. With ** the pattern is a root and a rest that file names, not paths, are held against."""
    root, wide, rest = pattern.partition("**")
    if wide:
        found = spark.read.option("recursiveFileLookup", "true").text(root.rstrip("/") or ".", wholetext=True)
        name = F.substring_index(F.col("_metadata.file_path"), "/", -1)
        found = found.where(name.rlike(glob_regex(rest.removeprefix("/") or "*")))
    else:
        found = spark.read.text(pattern, wholetext=True)
    return found.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def feature_steps(files: DataFrame) -> DataFrame:
    """(file, step_no, keyword, text) of files(path, text): lines of Given, When, Then, And, But; numbers count within a file from 0."""
    kept = F.filter(F.transform(F.split("text", r"\r?\n"), lambda v, k: F.struct(k.alias("line"), v.alias("value"))), lambda x: x["value"].rlike(r"^\s*(Given|When|Then|And|But)\s+(.+)$"))
    lines = files.select(F.col("path").alias("file"), F.posexplode(kept).alias("step_no", "own")).select("file", "step_no", F.col("own.value").alias("value"))
    return parse_steps(lines).select("file", "step_no", "keyword", "text")
