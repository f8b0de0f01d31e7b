"""Event-time windows over streams, and the same results from batch tables.

A stream in append mode emits a window once the watermark has passed its end; the batch twins leave out the windows
that a stream would still hold open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latticework.session import materialize, shared_folder

C = F.col


def event_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    """A file stream whose ``ts`` is a timestamp, as watermarks need; a path may be a folder or one file."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    status = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at)
    if status.isFile():  # a file source watches folders
        reader, path = reader.option("pathGlobFilter", at.getName()), at.getParent().toString()
    return reader.parquet(path).withColumn("ts", C("ts").cast("timestamp"))


def windowed(events: DataFrame, key: str, value: str, length: str, slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """(start, stop, key, n, total): tumbling or sliding windows; late rows beyond the delay are dropped in a stream."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    rows = events.withWatermark("ts", delay) if events.isStreaming else events
    g = rows.groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return g.select(C("w.start").alias("start"), C("w.end").alias("stop"), key, "n", "total")


def sessions(events: DataFrame, key: str, gap: str, delay: str = "10 minutes") -> DataFrame:
    """(start, stop, key, n): runs of events no more than ``gap`` apart."""
    rows = events.withWatermark("ts", delay) if events.isStreaming else events
    g = rows.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return g.select(C("w.start").alias("start"), C("w.end").alias("stop"), key, "n")


def closed(windows: DataFrame, events: DataFrame, delay: str) -> DataFrame:
    """The windows whose end the watermark of all ``events`` has reached."""
    mark = events.agg((F.max("ts").cast("timestamp") - F.expr(f"interval {delay}")).alias("m")).scalar()
    return windows.where(C("stop") <= mark)


def first_seen(events: DataFrame, keys: list[str], delay: str = "10 minutes") -> DataFrame:
    """Rows without repeats of ``keys`` within the watermark."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def run_once(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Process all that is there, exactly once, into a table of the shared folder, and read it."""
    import uuid

    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/latticework/{name}-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{base}/data").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/data")


def in_batches(stream: DataFrame, work, checkpoint: str) -> None:
    """Run ``work(batch, number)`` on each micro-batch until all that is there is processed."""
    stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


__all__ = ["Column", "closed", "event_stream", "first_seen", "in_batches", "materialize", "run_once", "sessions", "windowed"]
