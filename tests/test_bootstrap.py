"""One-pass bootstraps against the same weights drawn row by row, and against what theory says of their spread."""

import hashlib
import math
import random

import numpy as np
import pytest

from attestor.operators import stats


def weight(seed, key, b):
    digest = hashlib.md5(f"{seed}:{key}".encode()).hexdigest()
    u = (int(digest[:8], 16) + b * int(digest[8:16], 16)) % 2**32 >> 16
    return sum(u >= x for x in stats.POISSON_BOUNDS)


def by_hand(rows, resamples, seed=17, alpha=0.05):
    means = []
    for b in range(resamples):
        w = [weight(seed, k, b) for k, _ in rows]
        if sum(w):
            means.append(round(sum(x * v for x, (_, v) in zip(w, rows, strict=True)) / sum(w), 9))
    means.sort()
    m = len(means)
    return (len(rows), sum(v for _, v in rows) / len(rows), means[min(m - 1, int(m * alpha / 2))], means[min(m - 1, math.floor(m * (1 - alpha / 2)))])


def test_weights_are_poisson():
    counts = np.searchsorted(np.array(stats.POISSON_BOUNDS), np.arange(65536), side="right")
    for k in range(7):
        assert (counts == k).mean() == pytest.approx(math.exp(-1) / math.factorial(k), abs=2e-5)
    assert counts.mean() == pytest.approx(1, abs=1e-3)


@pytest.mark.parametrize("parts", [1, 3])
def test_one_pass_equals_drawing_row_by_row(spark, parts, monkeypatch):
    rng = random.Random(2)
    rows = [(i, rng.gauss(3, 2)) for i in range(700)]
    df = spark.createDataFrame(rows + [(9999, None)], "k int, v double").repartition(parts)
    got = stats.bootstrap_mean(df, "k", "v", 120).first()
    assert (got.n, got["mean"], got.lo, got.hi) == tuple(x if i == 0 else round(x, 6) for i, x in enumerate(by_hand(rows, 120)))


def test_groups_have_their_own_intervals(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(f"g{i % 5}" if i % 5 else None, i, rng.random()) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, k int, v double").repartition(2)
    monkeypatch.setattr(stats, "GROUPS", 2)
    got = {r.g: (r.n, r["mean"], r.lo, r.hi) for r in stats.bootstrap_mean(df, "k", "v", 60, by=["g"]).collect()}
    for g in (None, "g1", "g4"):
        want = by_hand([(k, v) for x, k, v in rows if x == g], 60)
        assert got[g] == tuple(x if i == 0 else round(x, 6) for i, x in enumerate(want))


def test_an_interval_has_its_breadth_and_holds_the_mean(spark):
    rng = np.random.default_rng(4)
    values = [float(x) for x in rng.normal(10, 2, 4000)]
    got = stats.bootstrap_mean(spark.createDataFrame(list(enumerate(values)), "k int, v double"), "k", "v", 2000).first()
    half = 1.96 * np.std(values) / math.sqrt(len(values))
    assert got.lo == pytest.approx(np.mean(values) - half, abs=0.1 * half)
    assert got.hi == pytest.approx(np.mean(values) + half, abs=0.1 * half)


def test_single_rows_and_flags(spark):
    one = stats.bootstrap_mean(spark.createDataFrame([(1, 2.5)], "k int, v double"), "k", "v", 50).first()
    assert (one.n, one["mean"], one.lo, one.hi) == (1, 2.5, 2.5, 2.5)
    none = stats.bootstrap_mean(spark.createDataFrame([(1, None)], "k int, v double"), "k", "v", 50).first()
    assert (none.n, none["mean"], none.lo, none.hi) == (0, None, None, None)
    flags = spark.createDataFrame([(i, i % 4 > 0) for i in range(400)] + [(-1, None)], "k int, v boolean")
    r = stats.bootstrap_flag(flags, "v").first()
    drawn = stats.bootstrap_mean(flags, "k", "v").first()
    assert (r.n, r["mean"]) == (400, 0.75) == (drawn.n, drawn["mean"])
    assert (r.lo, r.hi) == (pytest.approx(drawn.lo, abs=0.01), pytest.approx(drawn.hi, abs=0.01))
    e = stats.bootstrap_flag(flags.limit(0), "v").first()
    assert (e.n, e["mean"], e.lo, e.hi) == (0, None, None, None)
    with pytest.raises(Exception, match="other numbers"):
        stats.bootstrap_flag(spark.createDataFrame([(0.5,)], "v double"), "v").collect()


def test_clusters_are_drawn_whole(spark):
    rng = random.Random(6)
    rows = [(c, rng.random() < 0.5, rng.random() < 0.5) for c in range(40) for _ in range(rng.randint(1, 5))]
    got = stats.bootstrap_cluster(spark.createDataFrame(rows, "c int, t boolean, p boolean"), "c", "t", "p", 150).first()

    def value(w):
        n = {(t, p): sum(w[c] for c, x, y in rows if (x, y) == (t, p)) for t in (True, False) for p in (True, False)}
        return (n[True, True] / (n[True, True] + n[True, False]) + n[False, False] / (n[False, False] + n[False, True])) / 2

    drawn = sorted(round(value([weight(17, c, b) for c in range(40)]), 9) for b in range(150))
    assert (got.n_clusters, got.value, got.lo, got.hi) == (40, round(value([1] * 40), 6), round(drawn[3], 6), round(drawn[146], 6))


@pytest.mark.parametrize("small", [200_000, 0])
def test_paired_resamples_draw_as_many_rows_as_there_are(spark, small, monkeypatch):
    monkeypatch.setattr(stats, "SMALL_TABLE", small)
    rng = random.Random(6)
    rows = [(i, rng.gauss(1, 2), rng.random()) for i in range(90)]
    n, md5 = len(rows), lambda *k: hashlib.md5(":".join(map(str, k)).encode()).hexdigest()
    v = [a - b for _, (_, a, b) in sorted((md5(0, r[0]), r) for r in rows)]
    means = sorted(round(sum(v[int(md5(17, b, i)[:8], 16) % n] for i in range(n)) / n, 9) for b in range(80))
    got = stats.bootstrap_paired(spark.createDataFrame([*rows, (999, None, 1.0)], "k int, a double, b double"), "k", "a", "b", 80, draws=True).first()
    assert got.n == n and got["mean"] == pytest.approx(sum(v) / n, abs=1e-6)
    assert (got.lo, got.hi) == (pytest.approx(means[2], abs=1e-6), pytest.approx(means[78], abs=1e-6))
    sums = stats.drawn(spark.createDataFrame(rows, "k int, a double, b double"), "k", ["a"], 20).collect()
    assert len(sums) == 21 and {r.n for r in sums} == {float(n)}
