"""Tool reliability over a stream of calls: windows with a watermark, and repeats dropped within it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def call_stream(spark: SparkSession, path: str, schema: str, max_files: int = 1) -> DataFrame:
    """Calls from a folder of Parquet files, as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def windowed_reliability(calls: DataFrame, time: str = "ts", width: str = "1 day", late: str = "2 days") -> DataFrame:
    """(window_start, tool, n, success_rate, mean_latency) by tumbling window; calls later than the watermark are left out.

    Works on a stream and, for the same rows, on a table.
    """
    c = calls.withWatermark(time, late) if calls.isStreaming else calls
    out = c.groupBy(F.window(time, width).alias("w"), "tool").agg(F.count("*").alias("n"), F.round(F.avg(F.col("ok").cast("double")), 6).alias("success_rate"), F.round(F.avg("latency"), 4).alias("mean_latency"))
    return out.select(F.col("w.start").alias("window_start"), "tool", "n", "success_rate", "mean_latency")


def distinct_calls(calls: DataFrame, keys: list[str], time: str = "ts", late: str = "2 days") -> DataFrame:
    """One row for each key: within the watermark on a stream."""
    return calls.withWatermark(time, late).dropDuplicatesWithinWatermark(keys) if calls.isStreaming else calls.dropDuplicates(keys)


def sliding_reliability(calls: DataFrame, time: str = "ts", width: str = "2 days", slide: str = "1 day", late: str = "2 days") -> DataFrame:
    """As ``windowed_reliability`` over sliding windows."""
    c = calls.withWatermark(time, late) if calls.isStreaming else calls
    out = c.groupBy(F.window(time, width, slide).alias("w"), "tool").agg(F.count("*").alias("n"), F.round(F.avg(F.col("ok").cast("double")), 6).alias("success_rate"))
    return out.select(F.col("w.start").alias("window_start"), "tool", "n", "success_rate")


def call_sessions(calls: DataFrame, time: str = "ts", gap: str = "6 hours", late: str = "2 days") -> DataFrame:
    """(trace_id, session_start, n): calls of a trace with no pause of over ``gap``."""
    c = calls.withWatermark(time, late) if calls.isStreaming else calls
    out = c.groupBy("trace_id", F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select("trace_id", F.col("w.start").alias("session_start"), "n")


def run_once(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Process what is there into an in-memory table of the session, for small results, and return it."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
