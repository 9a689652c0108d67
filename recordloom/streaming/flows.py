"""Streams: records as they become valid, running counts, a ring of recent rows, windows over events."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream_jsonl(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """Lines of JSON, as files come in."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def valid_records(stream: DataFrame, valid: Column, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Write rows that are valid as lines of JSON, each once, as they come; ``once`` stops when there are no more."""
    writer = stream.where(valid).writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def running_counts(stream: DataFrame, valid: Column) -> DataFrame:
    """Successes and failures of all rows so far."""
    return stream.agg(F.count_if(valid).alias("successes"), F.count_if(~F.coalesce(valid, F.lit(False))).alias("failures"))


def recent(df: DataFrame, order: str, n: int = 100) -> DataFrame:
    """The last ``n`` rows."""
    return df.orderBy(F.desc(order)).limit(n)


def each_batch(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Hand each batch to a function; a batch that is repeated after a failure has the same number."""
    writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def run_until(query: StreamingQuery, stop: threading.Event, poll: float = 0.2) -> bool:
    """Wait for a stream to end, or for the event, on which it is stopped; whether it ended by itself. A batch that is under way then is made again when the stream starts next."""
    while not query.awaitTermination(poll):
        if stop.is_set():
            query.stop()
            return False
    return True


def windowed(events: DataFrame, time: str, key: str, length: str, slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Counts by key in tumbling or sliding windows; on streams, rows later than ``delay`` are dropped."""
    stamped = events.withColumn("__t", F.col(time).cast("timestamp"))
    stamped = stamped.withWatermark("__t", delay) if events.isStreaming else stamped
    window = F.window("__t", length, slide) if slide else F.window("__t", length)
    return stamped.groupBy(window.alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def sessions(events: DataFrame, time: str, key: str, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Counts by key in sessions that end after a gap."""
    stamped = events.withColumn("__t", F.col(time).cast("timestamp"))
    stamped = stamped.withWatermark("__t", delay) if events.isStreaming else stamped
    return stamped.groupBy(F.session_window("__t", gap).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), key, "n")


def first_seen(events: DataFrame, time: str, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """Each key once within the watermark; on a batch, each once."""
    stamped = events.withColumn("__t", F.col(time).cast("timestamp"))
    return (stamped.withWatermark("__t", delay).dropDuplicatesWithinWatermark(keys) if events.isStreaming else stamped.dropDuplicates(keys)).drop("__t")
