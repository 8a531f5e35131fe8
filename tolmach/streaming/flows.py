"""Streams: re-imports of files and latest-wins tables, batch by batch.

The engine has no streaming operators of its own to match; these are the two batch
operations that run naturally on a stream.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.changes import upsert
from ..sources import files
from ..sources.tables import current_version, read_snapshot, write_snapshot


def file_stream(spark: SparkSession, folder: str, project_id: int, per_batch: int = 100) -> DataFrame:
    """Localization files as they arrive in a folder, as rows of the files table."""
    raw = spark.readStream.format("binaryFile").schema(files.BINARY_FILES).option("maxFilesPerTrigger", per_batch).load(folder)
    return files.as_files(raw, project_id)


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Process what is there now and stop; a restart goes on after the last whole batch."""
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def into_snapshot(root: str, keys: list[str], order: list[str]) -> Callable[[DataFrame, int], None]:
    """A batch function that merges changes into a snapshot table, the latest of a key winning.

    A batch that is repeated after a failure finds its version written and does nothing.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        at = current_version(spark, root)
        if at is not None and at >= number:
            return
        known = batch.limit(0) if at is None else read_snapshot(spark, root)
        write_snapshot(upsert(known, batch.select(*known.columns), keys, order), root, number)

    return each
