"""New publications and examples as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def new_files(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """A stream of files that weren't there before, each once."""
    return spark.readStream.format("binaryFile").schema(SCHEMA).option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(root)


def first_seen(rows: DataFrame, keys: list[str], time: str | None = None, late: str = "1 day") -> DataFrame:
    """The first row of each key of a stream; with a time column keys are forgotten after ``late``."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(keys) if time else rows.dropDuplicates(keys)


def start(rows: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Writes what is there, batch by batch, and stops; a later start goes on from the checkpoint."""
    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
