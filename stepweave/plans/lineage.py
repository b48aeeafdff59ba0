"""The folder that driver and executors share, and cutting lineage through it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders made by this process, oldest first, by the shared folder they lie in.
_made: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where none is set (local runs)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local[") and master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='stepweave-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_dir(spark: SparkSession, what: str) -> str:
    at = shared_dir(spark)
    path = f"{at}/{what}-{uuid.uuid4().hex}"
    _made.setdefault(at, []).append(path)
    return path


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a table in the shared folder, read back: later plans begin there and survive lost executors."""
    path = new_dir(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Deletes the folder that a written table lies in, once nothing that is still to run reads it."""
    spark = df.sparkSession
    at, files = shared_dir(spark), df.inputFiles()
    path = spark._jvm.org.apache.hadoop.fs.Path
    for x in [x for x in _made.get(at, ()) if any(f"/{x.rsplit('/', 1)[-1]}/" in f for f in files)]:
        path(x).getFileSystem(spark._jsc.hadoopConfiguration()).delete(path(x), True)
        _made[at].remove(x)


def mark(spark: SparkSession) -> int:
    """How many folders were made so far, for ``release``."""
    return len(_made.get(shared_dir(spark), ()))


def release(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> int:
    """Deletes the folders made after a mark but for those that keep reads; how many. DataFrames that were built on them end with that."""
    at = shared_dir(spark)
    kept = [f.split("://", 1)[-1] for f in keep.inputFiles()] if keep is not None else []
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(at).getFileSystem(spark._jsc.hadoopConfiguration())
    old = _made.get(at, [])[since:]
    stays = {x for x in old if any(f"/{x.rsplit('/', 1)[-1]}/" in f for f in kept)}
    for x in old:
        if x not in stays:
            fs.delete(path(x), True)
    _made[at] = [*_made.get(at, [])[:since], *[x for x in old if x in stays]]
    return len(old) - len(stays)
