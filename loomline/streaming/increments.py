"""Incremental and streaming runs over files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Callback = Callable[[DataFrame, int], None]


def read_new_files(spark: SparkSession, folder: str, schema, kind: str = "parquet", files: int | None = None) -> DataFrame:
    """A stream of a folder's files, ``files`` a batch; the checkpoint remembers which have been read."""
    reader = spark.readStream.format(kind).schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).load(folder)


def run_available(stream: DataFrame, checkpoint: str, load: Callback, after: Callback | None = None) -> int:
    """Load all that is there now in micro-batches and stop; a second run goes on behind the first. Number of batches."""
    count = 0

    def each(batch: DataFrame, number: int) -> None:
        nonlocal count
        load(batch, number)
        if after:
            after(batch, number)
        count += 1

    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return count


def append_once(folder: str) -> Callback:
    """A loader that writes each batch to a partition of its number, so that a batch run twice is stored once."""

    def load(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch_id", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(folder)

    return load


def write_by_date(frame: DataFrame, folder: str, time: str) -> None:
    """A folder a day of ``time``."""
    frame.withColumn("date", F.to_date(time)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(folder)


# -- extensions: windows over a stream of events, which behave alike on a table


def _marked(events: DataFrame, late: str) -> DataFrame:
    """A stream with a watermark, which asks for a time with a zone; a table as it is."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count and sum by window and type; a stream forgets windows that are older than its watermark."""
    marked = _marked(events, late)
    return marked.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "2 hours", step: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    marked = _marked(events, late)
    return marked.groupBy(F.window("ts", width, step).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of a user: events no further apart than ``gap``."""
    marked = _marked(events, late)
    return marked.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("session_start"), "n")


def distinct_events(events: DataFrame, key: str = "event_id", late: str = "10 minutes") -> DataFrame:
    """Each key once; a stream remembers keys as long as its watermark allows."""
    return _marked(events, late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])
