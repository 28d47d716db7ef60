"""Timed and guarded calls, the median of whole tables, and repeats over a stream."""

import random
import statistics
import time

import pytest

from attestor.operators import calls, metrics, stats
from attestor.session import stored


def lookup(gene, tumor):
    if gene == "slow":
        time.sleep(0.05)
    if gene == "bad":
        raise LookupError("no such gene")
    if gene == "one":
        return 7
    if gene == "text":
        return "abc"
    return [{"b": tumor, "a": 1}] * int(gene)


def test_every_call_is_logged_with_its_time_and_error(spark):
    rows = [(1, "2", "x", "kept"), (2, "0", "x", ""), (3, "bad", "x", ""), (4, "slow", "x", ""), (5, None, "x", ""), (6, "one", None, ""), (7, "text", "y", ""), (8, "1", None, "")]
    asked = spark.createDataFrame(rows, "id int, gene string, tumor string, more string").repartition(3)
    got = {r.id: r for r in calls.call_tool(asked, "lookup", lookup, ["tumor", "gene"], ["id", "more"], required=["gene"]).collect()}
    assert set(got) == set(range(1, 9))
    assert (got[1].ok, got[1].n_results, got[1].error, got[1].more) == (True, 2, None, "kept")
    assert got[1].results == ['{"a": 1, "b": "x"}'] * 2 and got[1].args == '{"gene":"2","tumor":"x"}' and got[8].args == '{"gene":"1","tumor":null}'
    assert (got[2].ok, got[2].n_results, got[2].results) == (True, 0, [])
    assert (got[3].ok, got[3].n_results, got[3].error, got[3].results) == (False, None, "LookupError: no such gene", [])
    assert got[4].error.startswith("ValueError: invalid literal") and got[4].latency > 45
    assert got[5].error == "ValueError: missing argument gene" and not got[5].ok
    assert (got[6].n_results, got[6].results) == (None, ["7"]) and got[7].n_results == 3 and got[7].results == ['"abc"']
    assert all(r.latency >= 0 and r.tool == "lookup" for r in got.values())
    assert calls.call_tool(asked.limit(0), "lookup", lookup, ["gene", "tumor"], ["id"]).collect() == []


def test_reliability_of_calls_that_were_made(spark):
    asked = spark.createDataFrame([(i, ("2", "0", "bad")[i % 3], "x") for i in range(9)], "ord int, gene string, tumor string")
    made = stored(calls.call_tool(asked, "lookup", lookup, ["gene", "tumor"], ["ord"]))
    r = metrics.tool_reliability(made).first()
    assert (r.n, round(r.success_rate, 3), r.redundant, r.empty) == (9, 0.667, 6, 3)
    assert r.median_latency == pytest.approx(statistics.median(x.latency for x in made.collect()), abs=1e-6)
    assert r.errors == ";".join(["LookupError: no such gene"] * 3)


@pytest.mark.parametrize("n", [1, 2, 60])
@pytest.mark.parametrize("few", [0, 3, 10_000])
def test_median_of_a_table(spark, n, few, monkeypatch):
    monkeypatch.setattr(stats, "FEW", few)
    monkeypatch.setattr(stats, "BINS", 8)
    rng = random.Random(n)
    for draw in (lambda: rng.gauss(0, 1), lambda: float(rng.randint(0, 3)), lambda: rng.choice([1e-300, 1.0, 1e300, -1e308, 1e308]), lambda: 10 ** rng.uniform(-9, 9), lambda: rng.choice([-float("inf"), 0.0, 5e-324, float("inf")])):
        values = [draw() for _ in range(n)]
        want = statistics.median(values)
        got = stats.exact_median(spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "v double"), "v")
        assert got == want or (got != got and want != want)


def test_median_without_values(spark):
    assert stats.exact_median(spark.createDataFrame([(None,)], "v double"), "v") is None
