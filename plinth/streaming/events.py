"""Structured Streaming over events: windows with watermarks, deduplication, sessions, and a file stream of plans.

An extension: none of this has a batch counterpart in plan pipelines, but every stream here equals its batch form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and value sums per window and type."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "2 hours", slide: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.window("ts", width, slide).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("session_start"), "n")


def fresh(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each event once."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there, then stop; a second run takes up where this one ended."""
    stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def best_so_far(events: DataFrame):
    """Running best value of each user with an own state, as an update stream: user_id, best, rounds."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def update(key, frames, state):
        best, rounds = state.get if state.exists else (float("-inf"), 0)
        for frame in frames:
            best, rounds = max(best, float(frame["value"].max())), rounds + len(frame)
        state.update((best, rounds))
        yield pd.DataFrame({"user_id": [key[0]], "best": [best], "rounds": [rounds]})

    return events.groupBy("user_id").applyInPandasWithState(update, "user_id long, best double, rounds long", "best double, rounds long", "update", GroupStateTimeout.NoTimeout)
