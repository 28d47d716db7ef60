"""Calls seen before, over a stream: keyed state by trace with a timer, exact across micro-batches and restarts.

A call repeats an earlier one of its trace if tool and arguments are equal. The state of a trace holds the calls seen, and goes ``idle`` after the
watermark has passed the trace's last call by that time; a trace that comes back later than that begins anew. So the flags agree with those of the whole table as long as
no trace pauses for longer, and calls come no later than the watermark allows.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

FLAGGED = "trace_id STRING, ord BIGINT, ts TIMESTAMP, tool STRING, args STRING, ok BOOLEAN, latency DOUBLE, repeated BOOLEAN"


class SeenCalls(StatefulProcessor):
    """Flags each call of a trace that repeats an earlier one."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "tool STRING, args STRING", "n BIGINT")
        self.due = handle.getValueState("due", "ms BIGINT")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        last = -1
        for r in sorted(rows, key=lambda r: (r.ts, r.ord)):
            call = (r.tool, r.args)
            n = self.seen.getValue(call)[0] if self.seen.containsKey(call) else 0
            self.seen.updateValue(call, (n + 1,))
            last = max(last, int(r.ts.timestamp() * 1000))
            yield Row(trace_id=r.trace_id, ord=r.ord, ts=r.ts, tool=r.tool, args=r.args, ok=r.ok, latency=r.latency, repeated=n > 0)
        due, old = last + self.idle_ms, self.due.get()
        if old is None or due > old[0]:
            if old is not None:
                self.handle.deleteTimer(old[0])
            self.handle.registerTimer(due)
            self.due.update((due,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        self.seen.clear()
        self.due.clear()
        return iter(())

    def close(self) -> None:
        pass


def keep_state_in_rocksdb(spark: SparkSession) -> None:
    """What keyed state with timers needs; state beyond memory stays on disk."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def flagged(calls: DataFrame, late: str = "2 days", idle: datetime.timedelta = datetime.timedelta(days=30)) -> DataFrame:
    """``calls`` (trace_id, ord, ts, tool, args, ok, latency) with ``repeated``: whether an earlier call of the trace has the same tool and arguments.

    Works on a stream (calls later than the watermark are left out) and, for the same rows, on a table. Null arguments count as empty. Of calls in one micro-batch the earlier by
    (ts, ord) is first; across batches the one that arrived first: how many repeats a trace has doesn't depend on it.
    """
    own = calls.select(F.col("trace_id").cast("string").alias("trace_id"), F.col("ord").cast("bigint").alias("ord"), F.col("ts").cast("timestamp").alias("ts"), F.col("tool").cast("string").alias("tool"), F.coalesce(F.col("args").cast("string"), F.lit("")).alias("args"), F.col("ok").cast("boolean").alias("ok"), F.col("latency").cast("double").alias("latency"))
    if not own.isStreaming:
        from pyspark.sql import Window as W

        return own.withColumn("repeated", F.row_number().over(W.partitionBy("trace_id", "tool", "args").orderBy("ts", "ord")) > 1)
    keep_state_in_rocksdb(own.sparkSession)
    return own.withWatermark("ts", late).groupBy("trace_id").transformWithState(SeenCalls(int(idle.total_seconds() * 1000)), FLAGGED, "Append", "EventTime")


def appended(stream: DataFrame, folder: str, checkpoint: str) -> DataFrame:
    """Process what is there, appending to Parquet files in ``folder``, and return all that is in it; goes on from ``checkpoint`` when called again.

    Rows are in the folder once, whatever was done again after a failure.
    """
    q = stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(folder)


def repeats(flags: DataFrame) -> DataFrame:
    """(trace_id, n, redundant, success_rate) of flagged calls."""
    return flags.groupBy("trace_id").agg(F.count("*").alias("n"), F.count_if("repeated").alias("redundant"), F.round(F.avg(F.col("ok").cast("double")), 6).alias("success_rate"))
