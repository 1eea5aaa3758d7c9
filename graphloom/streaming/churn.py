"""Churn over event streams: windowed counts with late data, and index refreshes."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


KEYS = ("start", "event_type", "user_id")


def user_counts(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(start, event_type, user_id, events): works on a stream and on a table alike.

    The state of a stream is one number for each user of an open window.
    """
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = rows.groupBy(F.window("ts", width, slide) if slide else F.window("ts", width), "event_type", "user_id")
    return grouped.agg(F.count(F.lit(1)).alias("events")).select(F.col("window.start").alias("start"), "event_type", "user_id", "events")


def windows_of(counts: DataFrame) -> DataFrame:
    """(start, event_type, events, users) of a table of user counts."""
    return counts.groupBy("start", "event_type").agg(F.sum("events").alias("events"), F.count("user_id").alias("users"))


def windowed(events: DataFrame, width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """(start, event_type, events, users) of a table of events; users are distinct."""
    return windows_of(user_counts(events, width, slide))


def drain(stream: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Runs a stream over what is there now and returns its result as a table.

    Every batch writes the rows that it changed; the last row of a key holds,
    so windows that still wait for their watermark are complete too.
    """
    spark = stream.sparkSession
    here = f"{shared_dir(spark)}/graphloom/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:  # a batch that is tried again writes the same folder
        batch.write.mode("overwrite").parquet(f"{here}/out/batch={number}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{here}/state").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    columns = [c for c in stream.columns if c not in keys]
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{here}/out")
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], stream.schema)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields) + ", batch bigint"
    rows = spark.read.schema(schema).option("basePath", f"{here}/out").parquet(f"{here}/out")
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), "batch").alias("last")).select(*keys, "last.*").select(*stream.columns)


def on_change(spark: SparkSession, folder: str, refresh: Callable[[], object], checkpoint: str):
    """Starts a query that calls ``refresh`` whenever files under ``folder`` appear or change."""
    seen = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").schema("path string, modificationTime timestamp, length bigint, content binary").load(folder).select("path")

    def each(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            refresh()

    return seen.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
