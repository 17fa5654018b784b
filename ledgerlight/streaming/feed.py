"""The run-event feed: append-only events, each key once for a run, read on from a cursor."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def append(feed: DataFrame, new: DataFrame) -> DataFrame:
    """The feed with the new events whose key its run does not have yet; of equal new keys the first counts."""
    once = new.withColumn("_rn", F.row_number().over(Window.partitionBy("run_id", "event_key").orderBy("event_id"))).filter("_rn = 1").drop("_rn")
    return feed.unionByName(once.join(feed.select("run_id", "event_key"), ["run_id", "event_key"], "left_anti"))


def after(feed: DataFrame, run_id: str, cursor: int) -> DataFrame:
    return feed.filter((F.col("run_id") == run_id) & (F.col("event_id") > cursor)).orderBy("event_id")


def unique_stream(stream: DataFrame, time: str, lateness: str) -> DataFrame:
    """A stream's events, each (run, key) once within the lateness that the watermark allows."""
    return stream.withWatermark(time, lateness).dropDuplicatesWithinWatermark(["run_id", "event_key"])
