"""Statistics: percentile bootstraps in one pass by keyed Poisson weights, Bonferroni, point-biserial correlation with its p-value."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.functions.rng import keyed_int, positions
from attestor.session import stored

#: Poisson(1) counts by the upper 16 bits of a keyed 32-bit number: the count is the number of these bounds at or under it.
POISSON_BOUNDS = [math.floor(65536 * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(8)]

#: Rows whose weights are held at a time, and groups whose sums a task holds before it sends them on.
ROWS, GROUPS = 512, 64


def row_keys(seed: int, key: str) -> list[Column]:
    """Two 32-bit numbers from md5(seed:key), by which all of a row's weights are drawn."""
    text = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    return [F.conv(F.substring(text, at, 8), 16, 10).cast("bigint") for at in (1, 9)]


def resampled(rows: DataFrame, key: str, values: list[str], resamples: int, seed: int = 17, by: list[str] | None = None) -> DataFrame:
    """(by.., b, n, sum of each value): Poisson bootstrap sums in one pass over ``rows``; b = -1 has every row once.

    A row counts in resample b as often as a Poisson(1) number from (h1 + b * h2) mod 2^32, h1 and h2 being its ``row_keys``: the weights of different rows are
    independent, those of one row in any two resamples too (multiply-shift hashing). Each task keeps the sums of all resamples, so only
    they are shuffled; rows of one key count together. ``by`` is for few groups; a task that meets more than ``GROUPS`` sends sums on early.
    """
    by = by or []
    kinds = [f.dataType.simpleString() for c in by for f in rows.schema if f.name == c]
    h = row_keys(seed, key)
    own = rows.select(*by, h[0].alias("_h1"), h[1].alias("_h2"), *(F.col(v).cast("double").alias(v) for v in values))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.searchsorted(np.array(POISSON_BOUNDS), np.arange(65536), side="right").astype(np.uint8)
        places = np.arange(resamples, dtype=np.uint32)
        sums: dict[tuple, np.ndarray] = {}

        def sent() -> Iterator[pa.RecordBatch]:
            for group, total in sums.items():
                columns = [pa.array([g] * (resamples + 1), b.schema.field(i).type) for i, g in enumerate(group)]
                yield pa.record_batch([*columns, pa.array(np.arange(-1, resamples, dtype=np.int32)), *(pa.array(x) for x in total)], names=[*by, "b", "n", *values])
            sums.clear()

        for b in batches:
            groups = list(zip(*(b.column(i).to_pylist() for i in range(len(by))), strict=True)) if by else [()] * b.num_rows
            h1, h2 = (b.column(len(by) + i).to_numpy().astype(np.uint32) for i in (0, 1))
            v = np.stack([np.ones(b.num_rows), *(b.column(len(by) + 2 + i).to_numpy() for i in range(len(values)))])
            for group in dict.fromkeys(groups):
                at = np.flatnonzero([g == group for g in groups]) if by else np.arange(b.num_rows)
                total = sums.setdefault(group, np.zeros((len(values) + 1, resamples + 1)))
                for lo in range(0, len(at), ROWS):
                    part = at[lo : lo + ROWS]
                    weights = counts[(h1[part, None] + h2[part, None] * places) >> 16]
                    total[:, 0] += v[:, part].sum(axis=1)
                    total[:, 1:] += v[:, part] @ weights.astype(np.float64)
                if len(sums) > GROUPS:
                    yield from sent()
        yield from sent()

    schema = ", ".join([*(f"`{c}` {k}" for c, k in zip(by, kinds, strict=True)), "b int, n double", *(f"`{v}` double" for v in values)])
    return own.mapInArrow(run, schema).groupBy(*by, "b").agg(*(F.sum(c).alias(c) for c in ("n", *values)))


def percentile_interval(sums: DataFrame, value: Column, resamples: int, alpha: float = 0.05, by: list[str] | None = None) -> DataFrame:
    """(by.., n, value, lo, hi): ``value`` of all rows, and at floor(alpha/2 * m) and floor((1 - alpha/2) * m) of its m sorted resamples, no interpolation.

    ``sums`` as ``resampled`` gives them; resamples in which the value isn't defined don't count. At most ``resamples`` numbers meet in a group.
    """
    m = F.round(value, 9)
    point = F.col("b") == -1
    one = sums.groupBy(*(by or [])).agg(F.max(F.when(point, F.col("n"))).alias("n"), F.max(F.when(point, value)).alias("value"), F.sort_array(F.collect_list(F.when(~point, m))).alias("_m"))
    many = F.size("_m")
    at = lambda share: F.get("_m", F.least(F.floor(many * share), many - 1).cast("int"))
    return one.select(*(by or []), F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n"), "value", at(alpha / 2).alias("lo"), at(1 - alpha / 2).alias("hi"))


def bootstrap_mean(df: DataFrame, key: str, value: str, resamples: int = 2000, seed: int = 17, alpha: float = 0.05, by: list[str] | None = None) -> DataFrame:
    """One row (n, mean, lo, hi) of a numeric column, or one for each group; nulls don't count, and leave nulls with n = 0 where no row is left.

    For a column of 0 and 1 see ``bootstrap_flag``, which needs no resample.
    """
    rows = df.where(F.col(value).isNotNull()).select(*(by or []), key, F.col(value).cast("double").alias("_v"))
    sums = resampled(rows, key, ["_v"], resamples, seed, by)
    out = percentile_interval(sums, F.try_divide("_v", "n"), resamples, alpha, by)
    return out.select(*(by or []), "n", *(F.round(c, 6).alias(name) for c, name in (("value", "mean"), ("lo", "lo"), ("hi", "hi"))))


def bootstrap_flag(df: DataFrame, value: str, resamples: int = 2000, seed: int = 17, alpha: float = 0.05) -> DataFrame:
    """One row (n, mean, lo, hi) of a column of 0 and 1 (or a boolean), from its two counts; see ``rate_interval``."""
    v = F.col(value).cast("double")
    counts = df.agg(F.count(v).alias("n"), F.coalesce(F.sum(v), F.lit(0.0)).cast("bigint").alias("k"), F.count_if(~v.isin(0.0, 1.0)).alias("odd"))
    counts = counts.withColumn("k", F.when(F.col("odd") == 0, F.col("k")).otherwise(F.raise_error(F.lit(f"{value} holds other numbers than 0 and 1"))))
    ends = rate_interval(F.col("n"), F.col("k"), resamples, seed, alpha)
    return counts.withColumn("_ends", ends).select("n", F.round(F.try_divide("k", "n"), 6).alias("mean"), *(F.round(F.when(F.col("n") > 0, F.col(f"_ends.{c}")), 6).alias(c) for c in ("lo", "hi")))


#: Tables of up to so many rows are broadcast to the draws (counted first); larger ones are joined by shuffle.
SMALL_TABLE = 200_000


def drawn(rows: DataFrame, key: str, values: list[str], resamples: int, seed: int = 17) -> DataFrame:
    """(b, n, sum of each value) as ``resampled``, but every resample draws exactly as many rows as there are, with replacement.

    Rows get places in keyed order; draw i of resample b takes the row at place md5(seed:b:i) mod n. Only sums by resample are shuffled
    if the table is small; else draws are counted by (b, place) first.
    """
    placed = stored(positions(rows.select(key, *(F.col(v).cast("double").alias(v) for v in values)), key, 0, "i", "_n")).select("i", "_n", *values)
    draws = placed.select("i", "_n").crossJoin(F.broadcast(rows.sparkSession.range(resamples).select(F.col("id").alias("b"))))  # ``resamples`` rows
    taken = draws.select(F.col("b").cast("int").alias("b"), (keyed_int(seed, "b", "i") % F.col("_n")).alias("i"))
    if placed.count() <= SMALL_TABLE:
        met = taken.join(F.broadcast(placed.drop("_n")), "i").withColumn("c", F.lit(1))
    else:
        met = taken.groupBy("b", "i").agg(F.count("*").alias("c")).join(placed.drop("_n"), "i")
    sums = met.groupBy("b").agg(F.sum("c").cast("double").alias("n"), *(F.sum(F.col("c") * F.col(v)).alias(v) for v in values))
    whole = placed.agg(F.count("*").cast("double").alias("n"), *(F.sum(v).alias(v) for v in values)).select(F.lit(-1).alias("b"), "n", *values)
    return whole.unionByName(sums)


def bootstrap_paired(df: DataFrame, key: str, a: str, b: str, resamples: int = 1000, seed: int = 17, draws: bool = False) -> DataFrame:
    """The bootstrap of the mean difference a - b of each key; with ``draws`` by resamples of as many draws as there are keys (see ``drawn``)."""
    delta = df.withColumn("delta", F.col(a).cast("double") - F.col(b).cast("double"))
    if not draws:
        return bootstrap_mean(delta, key, "delta", resamples, seed)
    out = percentile_interval(drawn(delta.where("delta is not null"), key, ["delta"], resamples, seed), F.try_divide("delta", "n"), resamples)
    return out.select("n", *(F.round(c, 6).alias(name) for c, name in (("value", "mean"), ("lo", "lo"), ("hi", "hi"))))


#: Bins of a pass of ``exact_median``, and values that it sorts at the end.
BINS, FEW = 4096, 10_000


def exact_median(df: DataFrame, value: str) -> float | None:
    """The median of a numeric column of a whole table (the mean of the middle two if their number is even), without gathering its values.

    Each pass counts the values in ``BINS`` bins of the range that holds the middle one, and goes on with its bin, until that holds few values or only one. Nulls and
    NaN don't count; None without values. Passes are about the logarithm of the number of values to the base ``BINS``, more if they are very unevenly spread.
    """
    v = F.col(value).cast("double")
    rows = df.where(v.isNotNull() & ~F.isnan(v)).select(v.alias("v"))
    inf = float("inf")
    finite = (F.col("v") > -inf) & (F.col("v") < inf)
    n, below, finite_n, lo, hi = rows.agg(F.count("*"), F.count_if(F.col("v") == -inf), F.count_if(finite), F.min(F.when(finite, F.col("v"))), F.max(F.when(finite, F.col("v")))).first()
    if not n:
        return None

    def nth(at: int) -> float:
        if at < below or at >= below + finite_n:
            return -inf if at < below else inf
        at, a, b, held = at - below, lo, hi, finite_n
        while a < b and held > FEW:
            h = 1.0 if b - a < inf else 0.5  # any range of doubles has a width
            place = F.least(F.lit(BINS - 1), F.floor((F.col("v") * h - a * h) / (b * h - a * h) * BINS))
            bins = rows.where(F.col("v").between(a, b)).groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
            for r in sorted(bins.collect(), key=lambda r: r.bin):  # BINS rows at most
                if at < r.n:
                    if (r.lo, r.hi, r.n) == (a, b, held):  # neighbouring doubles
                        return _counted(a, b, at)
                    a, b, held = r.lo, r.hi, r.n
                    break
                at -= r.n
        return a if a == b else _counted(a, b, at)

    def _counted(a: float, b: float, at: int) -> float:
        for r in rows.where(F.col("v").between(a, b)).groupBy("v").agg(F.count("*").alias("n")).orderBy("v").collect():  # FEW at most, or two
            if at < r.n:
                return r.v
            at -= r.n
        raise RuntimeError("the table changed between passes")

    first = nth((n - 1) // 2)
    return first if n % 2 else (first + nth(n // 2)) / 2


def balanced_accuracy(tp: Column, fp: Column, tn: Column, fn: Column) -> Column:
    return (F.try_divide(tp, tp + fn) + F.try_divide(tn, tn + fp)) / 2


def bootstrap_cluster(df: DataFrame, cluster: str, truth: str, predicted: str, resamples: int = 1000, seed: int = 17) -> DataFrame:
    """One row (n_clusters, value, lo, hi): balanced accuracy, resampling whole clusters by their confusion counts."""
    t, p = F.col(truth).cast("boolean"), F.col(predicted).cast("boolean")
    cells = {"tp": t & p, "fp": ~t & p, "tn": ~t & ~p, "fn": t & ~p}
    per = df.groupBy(cluster).agg(*(F.count_if(c).cast("double").alias(k) for k, c in cells.items()))
    value = balanced_accuracy(*(F.col(c) for c in ("tp", "fp", "tn", "fn")))
    out = percentile_interval(resampled(per, cluster, list(cells), resamples, seed), value, resamples)
    return out.select(F.col("n").alias("n_clusters"), *(F.round(c, 6).alias(c) for c in ("value", "lo", "hi")))


@lru_cache(maxsize=64)
def keyed_quantiles(resamples: int = 2000, seed: int = 17, alpha: float = 0.05) -> tuple[float, float]:
    """The keyed uniform numbers, one for each resample, at the places that the percentile interval takes in their order."""
    u = sorted((int(hashlib.md5(f"{seed}:{b}".encode()).hexdigest()[:8], 16) + 0.5) / 2**32 for b in range(resamples))
    return u[int(alpha / 2 * resamples)], u[min(resamples - 1, int((1 - alpha / 2) * resamples))]


def binomial_quantiles(n: int, k: int, levels: tuple[float, ...]) -> list[int]:
    """The smallest j at which the distribution of n draws with chance k / n reaches each level."""
    if k <= 0 or k >= n:
        return [max(0, min(n, k))] * len(levels)
    p = k / n
    reach = int(40 + 12 * math.sqrt(n * p * (1 - p)))
    j = np.arange(max(0, k - reach), min(n, k + reach) + 1)
    # from the mean outwards by the ratio of neighbours
    ratio = np.log((n - j[:-1]) / (j[:-1] + 1)) + math.log(p / (1 - p))
    at = int(np.searchsorted(j, k))
    top = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log(1 - p)
    logs = np.concatenate([[0.0], np.cumsum(ratio)])
    total = np.cumsum(np.exp(logs - logs[at] + top))
    return [int(j[min(len(j) - 1, int(np.searchsorted(total, x)))]) for x in levels]


def rate_interval(n: Column, k: Column, resamples: int = 2000, seed: int = 17, alpha: float = 0.05) -> Column:
    """struct(lo, hi): the percentile bootstrap of a rate with ``k`` of ``n``, from those two numbers alone.

    A resample's sum of 0/1 values is binomial and grows with the uniform number that it is drawn by, so the interval's ends
    are the binomial quantiles at the ends of the keyed uniforms: no row is drawn, whatever the size of the table.
    """
    levels = keyed_quantiles(resamples, seed, alpha)

    @F.pandas_udf("lo double, hi double")
    def ends(n: pd.Series, k: pd.Series) -> pd.DataFrame:
        out = [[j / m for j in binomial_quantiles(int(m), int(x), levels)] if m else [0.0, 0.0] for m, x in zip(n, k, strict=True)]
        return pd.DataFrame(out, columns=["lo", "hi"], dtype="float64")

    return ends(n.cast("long"), F.coalesce(k, F.lit(0)).cast("long"))


def correlation(x: Column, y: Column) -> Column:
    """An aggregate: Pearson's correlation, null where one of the columns doesn't vary."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p-value of a correlation of ``n`` pairs, null without one."""

    @F.pandas_udf("double")
    def value(r: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(x) else student_p(float(x), int(m)) for x, m in zip(r, n, strict=True)], dtype="float64")

    return value(r, n.cast("long"))


def bonferroni(df: DataFrame, p: str) -> DataFrame:
    n = df.agg(F.count(p).alias("m"))
    return df.crossJoin(n).withColumn("p_adjusted", F.least(F.lit(1.0), F.col(p) * F.col("m"))).drop("m")


def student_p(r: float, n: int) -> float:
    """Two-sided p-value of a correlation: the t distribution by a continued fraction for the incomplete beta function."""
    if abs(r) >= 1:
        return 0.0
    dof = n - 2
    x = dof / (dof + r * r * dof / (1 - r * r))
    return _incomplete_beta(dof / 2, 0.5, x)


def _incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return min(1.0, max(0.0, x))
    if x > (a + 1) / (a + b + 2):
        return 1 - _incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    # Lentz's algorithm
    tiny, f, c, d = 1e-300, 1.0, 1.0, 0.0
    for i in range(300):
        m = i // 2
        if i == 0:
            term = 1.0
        elif i % 2 == 0:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + term * d or tiny)
        c = 1 + term / (c or tiny)
        f *= c * d
        if abs(1 - c * d) < 1e-12:
            break
    return front * (f - 1)


def point_biserial(df: DataFrame, flag: str, value: str) -> DataFrame:
    """One row (n, r, mean_true, mean_false); r is null under three rows or with one class."""
    f, v = F.col(flag).cast("double"), F.col(value).cast("double")
    s = df.where(F.col(flag).isNotNull() & F.col(value).isNotNull()).agg(F.count("*").alias("n"), correlation(f, v).alias("r"), F.avg(F.when(f > 0, v)).alias("mean_true"), F.avg(F.when(f == 0, v)).alias("mean_false"), F.min(f).alias("lo"), F.max(f).alias("hi"))
    ok = (F.col("n") >= 3) & (F.col("lo") < F.col("hi"))
    return s.select("n", F.round(F.when(ok, F.col("r")), 6).alias("r"), F.round("mean_true", 6).alias("mean_true"), F.round("mean_false", 6).alias("mean_false"))
