"""Streams of files: new files of a folder through the verbs, written once each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rasterloom.sources.sink import write_files


def once_each(files: DataFrame, within: str = "1 hour") -> DataFrame:
    """Files of equal content that arrive near each other, once: what is remembered is a digest of each for
    so long after the latest file that was seen."""
    keyed = files.withColumn("_digest", F.sha2("content", 256)).withWatermark("modificationTime", within)
    return keyed.dropDuplicatesWithinWatermark(["_digest"]).drop("_digest")


def written(files: DataFrame, result: Column, name: Column, folder: str, checkpoint: str, failed: Callable[[DataFrame], None] | None = None, **trigger) -> StreamingQuery:
    """Starts a stream that writes result (a struct with content and code) of each file under a name.

    A batch that is run again after a failure writes the same files over themselves. Files that gave a code
    go to `failed` as (path, code), if it is given.
    """

    def batch(rows: DataFrame, _: int) -> None:
        done = rows.select("path", name.alias("name"), result.alias("r")).persist()
        try:
            write_files(done.select("name", F.col("r.content").alias("content")), folder, overwrite=True)
            if failed is not None:
                failed(done.where("r.code IS NOT NULL").select("path", "r.code"))
        finally:
            done.unpersist()

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
