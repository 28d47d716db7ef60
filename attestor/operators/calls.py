"""Tool calls that are made: an Arrow table function runs a tool for each row under a timer and a guard."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CALL = "tool STRING, args STRING, ok BOOLEAN, latency DOUBLE, n_results INT, error STRING, results ARRAY<STRING>"


def guarded(fn: Callable[..., object], args: dict, required: Sequence[str]) -> tuple[bool, float, int | None, str | None, list[str]]:
    """(ok, latency in ms, number of results, error, results as JSON) of ``fn(**args)``.

    A required argument that is missing (null) is an error before the tool runs. Whatever the tool raises is logged as its class and message, and the
    result is empty; a result without a length has no number of results and is one result.
    """
    began = time.perf_counter()
    try:
        for name in sorted(required):
            if args.get(name) is None:
                raise ValueError(f"missing argument {name}")
        found = fn(**args)
        took = (time.perf_counter() - began) * 1000
        n = len(found) if hasattr(found, "__len__") else None
        rows = list(found) if n is not None and not isinstance(found, (str, bytes, dict)) else [found]
        return True, took, n, None, [json.dumps(x, default=str, sort_keys=True) for x in rows]
    except Exception as e:  # noqa: BLE001 - a failed call is a row of the log, not the end of the job
        return False, (time.perf_counter() - began) * 1000, None, f"{type(e).__name__}: {e}", []


def call_tool(asked: DataFrame, tool: str, fn: Callable[..., object], args: list[str], keys: list[str], required: list[str] | None = None) -> DataFrame:
    """(keys.., tool, args, ok, latency, n_results, error, results): a call of ``fn`` with the columns ``args`` for each row of ``asked``.

    ``args`` is the canonical JSON of the arguments, keys in order. ``required`` arguments (all, if None) must not be null. The tool runs in the tasks, as many at
    a time as there are cores, and once a row unless a task is run again; what it needs must go with ``fn`` (a small table by a broadcast).
    """
    needed = list(args if required is None else required)
    kinds = {f.name: f.dataType.simpleString() for f in asked.schema.fields}
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), CALL])
    given = asked.select(*(F.col(k).alias(f"key_{i}") for i, k in enumerate(keys)), F.to_json(F.struct(*sorted(args)), {"ignoreNullFields": "false"}).alias("args"), F.struct(*sorted(args)).alias("given"))

    @F.arrow_udtf(returnType=schema)
    class Call:
        def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
            names = rows.schema.names
            log = [guarded(fn, x, needed) for x in rows.column(names.index("given")).to_pylist()]
            ok, took, n, error, found = zip(*log, strict=True) if log else [[]] * 5
            own = [rows.column(names.index(f"key_{i}")) for i in range(len(keys))]
            done = [pa.array([tool] * len(log), pa.string()), rows.column(names.index("args")), pa.array(ok, pa.bool_()), pa.array(took, pa.float64()), pa.array(n, pa.int32()), pa.array(error, pa.string()), pa.array(found, pa.list_(pa.string()))]
            yield pa.table([*own, *done], names=[*keys, "tool", "args", "ok", "latency", "n_results", "error", "results"])

    return Call(given.asTable())
