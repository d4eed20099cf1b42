"""Streams of frames: windowed track summaries with watermarks; the batch operators are their specification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def frame_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Frames from parquet files as they arrive. [T1]"""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def session_tracks(frames: DataFrame, gap: str = "6 hours", late: str = "1 hour", least_seen: int = 1, video: str = "video", time: str = "ts", score: str = "score") -> DataFrame:
    """One row a track: a video's frames until nothing came for longer than the gap; given out once the watermark is past. [T2, T3, T4]

    Works on a stream (append mode) and on a table alike; frames later than the watermark allows are dropped
    by the stream. State is a pre-aggregate a session, not its frames.
    """
    t = F.col(time).cast("timestamp")
    f = frames.withColumn("_t", t)
    if frames.isStreaming:
        f = f.withWatermark("_t", late)
    g = f.groupBy(video, F.session_window("_t", gap).alias("w")).agg(F.count("*").alias("n_seen"), F.max(score).alias("best_score"), F.max_by("_t", F.struct(F.col(score), -F.unix_micros("_t"))).alias("best_ts"))
    return g.where(F.col("n_seen") >= least_seen).select(video, F.col("w.start").alias("first_ts"), F.col("w.end").alias("closed_at"), "n_seen", "best_score", "best_ts")


def window_counts(frames: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "1 hour", video: str = "video", time: str = "ts") -> DataFrame:
    """Frames of each video by tumbling or sliding windows. [T1]"""
    f = frames.withColumn("_t", F.col(time).cast("timestamp"))
    if frames.isStreaming:
        f = f.withWatermark("_t", late)
    w = F.window("_t", width, slide) if slide else F.window("_t", width)
    return f.groupBy(video, w.alias("w")).agg(F.count("*").alias("n")).select(video, F.col("w.start").alias("start"), "n")


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "append"):
    """Run a stream over what is there into a memory table, to its end. [T5]"""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name), q.lastProgress
