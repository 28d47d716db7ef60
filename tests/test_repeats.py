"""Keyed state over several micro-batches, restarts, late rows and pauses, against the whole table."""

import datetime
import random

from attestor.streaming import reliability, repeats

SCHEMA = "trace_id string, ord bigint, ts timestamp, tool string, args string, ok boolean, latency double"
START = datetime.datetime(2024, 1, 1)


def call(i, hours, trace="t", tool="a", args="x"):
    return (trace, i, START + datetime.timedelta(hours=hours), tool, args, True, 1.0)


def fed(spark, top, batches, per=1, **more):
    """The flagged rows after feeding each batch as files and going on from the checkpoint."""
    out = None
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{top}/in")
        stream = reliability.call_stream(spark, f"{top}/in", SCHEMA, per)
        out = repeats.appended(repeats.flagged(stream, **more), f"{top}/out", f"{top}/checkpoint")
    return out


def as_set(df):
    return {(r.trace_id, r.ord, r.repeated) for r in df.collect()}


def test_several_batches_and_restarts_give_what_the_table_gives(spark, tmp_path):
    rng = random.Random(1)
    rows = [call(i, i / 4, f"t{rng.randint(0, 4)}", rng.choice("ab"), rng.choice(["x", "y", None])) for i in range(240)]
    batches = [rows[lo : lo + 80] for lo in (0, 80, 160)]
    got = fed(spark, tmp_path, batches)
    table = spark.createDataFrame(rows, SCHEMA)
    assert as_set(got) == as_set(repeats.flagged(table))
    assert sorted(map(tuple, repeats.repeats(got).collect())) == sorted(map(tuple, repeats.repeats(repeats.flagged(table)).collect()))
    again = repeats.appended(repeats.flagged(reliability.call_stream(spark, f"{tmp_path}/in", SCHEMA)), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    assert again.count() == 240  # nothing new, nothing twice


def test_calls_later_than_the_watermark_are_left_out(spark, tmp_path):
    on_time = [call(1, 0), call(2, 100), call(3, 101, args="z")]
    late = [call(4, 1), call(5, 102)]
    got = fed(spark, tmp_path, [on_time, [call(6, 103, "u")], late], late="1 day")
    assert as_set(got) == {("t", 1, False), ("t", 2, True), ("t", 3, False), ("u", 6, False), ("t", 5, True)}


def test_state_goes_after_a_pause(spark, tmp_path):
    day = 24
    first, pushes = [call(1, 0), call(2, 1)], [[call(3, 60 * day, "u")], [call(4, 61 * day, "u")]]
    back = [call(5, 62 * day)]
    got = fed(spark, tmp_path, [first, *pushes, back], late="1 day", idle=datetime.timedelta(days=20))
    assert as_set(got) == {("t", 1, False), ("t", 2, True), ("u", 3, False), ("u", 4, True), ("t", 5, False)}
    kept = fed(spark, tmp_path / "longer", [first, *pushes, back], late="1 day", idle=datetime.timedelta(days=200))
    assert ("t", 5, True) in as_set(kept)


def test_distinct_calls_on_a_table_and_a_stream(spark, tmp_path):
    rows = [call(i, i, "t", "a", "xy"[i % 2]) for i in range(6)]
    table = spark.createDataFrame(rows, SCHEMA)
    assert reliability.distinct_calls(table, ["trace_id", "tool", "args"]).count() == 2
    table.write.parquet(f"{tmp_path}/in")
    stream = reliability.distinct_calls(reliability.call_stream(spark, f"{tmp_path}/in", SCHEMA, 10), ["trace_id", "tool", "args"], late="10 days")
    assert repeats.appended(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint").count() == 2
