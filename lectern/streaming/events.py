"""The monitor over a stream of events: the batch operators' twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.monitor import latest_state, rollup, task_progress


def read_events(spark: SparkSession, path: str, schema: str, fmt: str = "json") -> DataFrame:
    """A stream of event files."""
    return spark.readStream.schema(schema).format(fmt).load(path)


def state_stream(events: DataFrame, keys: list[str], seq: str, cols: list[str]) -> DataFrame:
    """Last known values by `seq`, whatever the order of arrival; write in complete or update mode."""
    return latest_state(events, keys, seq, cols)


def rollup_stream(events: DataFrame, key: str, status: str, value: str) -> DataFrame:
    """As rollup(), with a sketch for the distinct statuses, which streams can't count exactly."""
    return events.groupBy(key).agg(F.count("*").alias("n_events"), F.approx_count_distinct(status).alias("n_statuses"), F.sum(value).alias("total"), F.max(value).alias("largest"))


def progress_stream(events: DataFrame, run: str = "run_id") -> DataFrame:
    """The state of each run's tasks as events come in; write in complete mode."""
    return task_progress(events, run)


def windowed(events: DataFrame, at: str, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Events of each window and type; what is later than the watermark is left out."""
    return events.withWatermark(at, late).groupBy(F.window(at, size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def to_memory(df: DataFrame, name: str, mode: str = "complete") -> StreamingQuery:
    """Run on what is there now, to a memory table."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


__all__ = ["progress_stream", "read_events", "rollup", "rollup_stream", "state_stream", "to_memory", "windowed"]
