"""What the operators share: the shared folder, cutting lineage, free column names, text bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.plans.lineage import new_dir, written

__all__ = ["BATCH_BYTES", "LOWER", "arrow_map", "ascii_lower", "each", "fresh", "load", "mounted", "new_dir", "text_or_empty", "written"]

#: A-Z to a-z on UTF-8 bytes; every other byte stays.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Bytes of an Arrow batch that carries texts: bounds a worker's and the JVM's buffers, whatever the texts' lengths (one longer row is a batch alone).
BATCH_BYTES = 4 << 20
UPPER_AZ, LOWER_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def mounted(path: str) -> str:
    """A shared path as the operating system names it; memory maps need a mounted folder."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    if "://" in path:
        raise ValueError(f"{path}: memory-mapped files need a shared folder that is mounted on every node (file://)")
    return path


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df does not have, whatever its extra columns are called."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER_AZ, LOWER_AZ)


def each(column):
    """The values of an Arrow column one at a time, so that a batch is not held twice."""
    return (x.as_py() for x in column)


def arrow_map(df: DataFrame, run, schema) -> DataFrame:
    """mapInArrow in batches of about BATCH_BYTES; the bound is set for the session."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
