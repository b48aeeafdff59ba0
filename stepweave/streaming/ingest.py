"""Takes scanner outputs in as they arrive: files of a folder, a batch of them at a time, each checked and upserted like a scan.

A batch that is taken in twice (after a lost driver) changes nothing: nodes and edges are upserted by id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from stepweave.api import Engine, ScanResult
from stepweave.sources.protocol import merge_outputs


def outputs(engine: Engine, folder: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of (scanner, raw): the folder's documents, named by their files."""
    found = engine.spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder, wholetext=True)
    return found.select(F.regexp_replace(F.substring_index(F.col("_metadata.file_path"), "/", -1), r"\.json$", "").alias("scanner"), F.col("value").alias("raw"))


def follow(engine: Engine, folder: str, checkpoint: str, once: bool = False, told: Callable[[int, ScanResult], None] | None = None) -> StreamingQuery:
    """Runs until stopped, or with once until what is there now is taken in. told: gets each batch's number and result."""

    def take(batch: DataFrame, number: int) -> None:
        result = engine.ingest(merge_outputs(batch))
        if told:
            told(number, result)

    writer = outputs(engine, folder).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
