"""Scoring pairs as they arrive. A score depends on its own row only, so the batch projection serves a stream unchanged."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def with_score(df: DataFrame, score: Callable[[Column, Column], Column], threshold: float) -> DataFrame:
    """df (name1, name2) with score and prediction; works on batch and streaming frames. A null name scores null and is no match."""
    return df.withColumn("score", score(F.col("name1"), F.col("name2"))).withColumn("prediction", F.coalesce(F.col("score") > threshold, F.lit(False)))


def score_stream(stream: DataFrame, score: Callable[[Column, Column], Column], threshold: float, path: str, checkpoint: str) -> StreamingQuery:
    """Appends scored pairs to a parquet folder, exactly once; ends when what there is has been read."""
    out = with_score(stream, score, threshold)
    return out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, time: str, size: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(start, matches, pairs): matches an event-time window; rows later than `late` behind the newest are dropped from the state."""
    w = stream.withWatermark(time, late).groupBy(F.window(time, size))
    return w.agg(F.sum(F.col("prediction").cast("int")).alias("matches"), F.count(F.lit(1)).alias("pairs")).select(F.col("window.start").alias("start"), "matches", "pairs")
