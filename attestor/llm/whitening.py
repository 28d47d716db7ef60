"""Embedding whitening from column aggregates over the upper triangle of dimension pairs.

Spark sums the centred products of all dimension pairs in one aggregation of generated expressions, over the distinct
vectors; the driver assembles the d x d covariance, decomposes it with LAPACK, and generates the projections as expressions.
Whatever the size of the table, only d sums, d (d + 1) / 2 products and d * k coefficients pass the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.llm.common import discard, free_name, written

#: Vector entries are held as whole numbers of 1 / SCALE.
SCALE = 256

#: The most products in one aggregation: 90 dimensions go in one; more dimensions read the distinct vectors once for each so many pairs.
PAIRS = 4096

LONG = 2**63


@dataclass
class Whitening:
    """What was learned: ``n`` distinct vectors with sums ``total``; ``vectors`` has one component a column, by falling ``values``."""

    n: int
    total: list[int]
    low: list[int] = field(default_factory=list)
    high: list[int] = field(default_factory=list)
    covariance: np.ndarray | None = None
    values: np.ndarray | None = None
    vectors: np.ndarray | None = None

    @property
    def dimensions(self) -> int:
        return len(self.total)

    def deviation_fits(self) -> bool:
        """Whether the sum of squares of n * x - S fits a long for every vector between the extremes."""
        return sum(max(abs(self.n * a - s), abs(self.n * b - s)) ** 2 for a, b, s in zip(self.low, self.high, self.total, strict=True)) < LONG

    def positive(self, k: int) -> list[int]:
        """Which of the first ``k`` components have variance beyond rounding."""
        if not len(self.values) or self.values[0] <= 0:
            return []
        least = self.values[0] * self.dimensions * np.finfo(float).eps * 8
        return [c for c in range(min(k, self.dimensions)) if self.values[c] > least]


def usable(embedding: Column) -> Column:
    """Whether a vector is there, not empty, and all its entries are finite and, scaled, fit a long."""
    fine = F.forall(embedding, lambda e: F.coalesce(~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < LONG / SCALE), F.lit(False)))
    return embedding.isNotNull() & (F.size(embedding) > 0) & fine


def whole(embedding: Column) -> Column:
    """The entries as whole numbers: floor(SCALE * entry), the entry taken as double."""
    return F.transform(embedding, lambda e: F.floor(F.lit(float(SCALE)) * e.cast("double")).cast("long") + F.lit(0).cast("long"))


def _triangle(d: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(d) for j in range(i, d)]


def covariance(fit: DataFrame, x: str, model: Whitening) -> np.ndarray:
    """Population covariance of ``fit``'s vectors: sums of centred products for all pairs i <= j.

    Entries are centred by the whole number nearest to their mean, so that products and sums are exact and don't depend on
    partitions, and the rest of the mean is taken off in whole numbers; where such sums might not fit a long, entries are centred
    by the mean as doubles.
    """
    n, d = model.n, model.dimensions
    near = [(2 * s + n) // (2 * n) for s in model.total]
    widest = max((max(b - c, c - a) for a, b, c in zip(model.low, model.high, near, strict=True)), default=0)
    exact = widest * widest * n < LONG
    # the entries of the fit list are never null; where Spark knows, it sums twice as fast
    off = [F.coalesce(F.get(x, F.lit(i)), F.lit(0)) - (F.lit(near[i]) if exact else F.lit(model.total[i] / n)) for i in range(d)]
    centred = fit.select(*(c.alias(f"d{i}") for i, c in enumerate(off)))
    out = np.zeros((d, d))
    pairs = _triangle(d)
    for lo in range(0, len(pairs), PAIRS):
        part = pairs[lo : lo + PAIRS]
        sums = centred.selectExpr(*(f"sum(d{i} * d{j}) AS p{i}_{j}" for i, j in part)).first()
        for (i, j), p in zip(part, sums, strict=True):
            rest = (model.total[i] - n * near[i]) * (model.total[j] - n * near[j])
            out[i, j] = out[j, i] = (n * p - rest) / (n * n) if exact else p / n
    return out


def learned(fit: DataFrame, x: str, d: int) -> Whitening:
    """Sums, extremes, covariance and its eigenvectors over ``fit``'s vectors of ``d`` whole numbers."""
    whole_sum = [F.sum(F.col(x)[i].cast("decimal(38,0)")) for i in range(d)]
    row = fit.agg(F.count("*"), *whole_sum, *(F.min(F.col(x)[i]) for i in range(d)), *(F.max(F.col(x)[i]) for i in range(d))).first()
    n, rest = row[0], [int(v) for v in row[1:]] if row[0] else [0] * 3 * d
    model = Whitening(n, rest[:d], rest[d : 2 * d], rest[2 * d :])
    model.covariance = covariance(fit, x, model) if n else np.zeros((d, d))
    values, vectors = np.linalg.eigh(model.covariance)
    model.values, model.vectors = values[::-1], vectors[:, ::-1]
    return model


def projected(x: str, model: Whitening, component: int) -> Column:
    """The whitened value of one component: (x - S / n) along its eigenvector, over the root of its eigenvalue."""
    scale = 1 / np.sqrt(model.values[component])
    return F.expr(" + ".join(f"(get({x}, {i}) - {s / model.n!r}D) * {float(model.vectors[i, component] * scale)!r}D" for i, s in enumerate(model.total)))


def deviation(x: str, model: Whitening) -> Column:
    """Sum over the dimensions of (n * x - S)^2, exact; null where it doesn't fit a long."""
    if model.deviation_fits():
        off = [f"({model.n}L * get({x}, {i}) - ({s}L))" for i, s in enumerate(model.total)]
        return F.expr(" + ".join(f"{o} * {o}" for o in off))
    off = [f"try_subtract(try_multiply({model.n}BD, cast(get({x}, {i}) as decimal(20,0))), cast('{s}' as decimal(38,0)))" for i, s in enumerate(model.total)]
    total = "cast(0 as decimal(38,0))"
    for o in off:
        total = f"try_add({total}, cast(try_multiply({o}, {o}) as decimal(38,0)))"
    return F.expr(f"try_cast({total} as bigint)")


def identity_error(fit: DataFrame, x: str, model: Whitening, k: int) -> float | None:
    """The largest absolute entry of (covariance of the first ``k`` whitened components over ``fit``) - identity; null without one."""
    own = model.positive(k)
    if not own:
        return None
    at = fit.select(*(projected(x, model, c).alias(f"w{c}") for c in own))
    pairs = [(a, b) for a in own for b in own if a <= b]
    row = at.agg(*(F.covar_pop(f"w{a}", f"w{b}").alias(f"p{a}_{b}") for a, b in pairs)).first()
    return max(abs(v - (a == b)) for (a, b), v in zip(pairs, row, strict=True))


def fit_table(vectors: DataFrame, embedding: str = "embedding") -> tuple[DataFrame, int]:
    """(x): each distinct vector of the table's dimension once, written; and that dimension (0: no usable vector)."""
    e = F.col(embedding)
    sizes = vectors.where(usable(e)).groupBy(F.size(e).alias("d")).agg(F.count("*").alias("m"))
    most = sizes.orderBy(F.col("m").desc(), F.col("d").desc()).first()
    d = most.d if most else 0
    return written(vectors.where(usable(e) & (F.size(e) == d)).select(whole(e).alias("x")).distinct()), d


def whitened(vectors: DataFrame, k: int = 4, vec_id: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, Whitening]:
    """(rows, model): each usable row of ``vectors`` with its columns and ``w``, an array of the first ``k`` whitened components, ``x`` and ``deviation``.

    Rows whose vector is null, empty, or holds null or non-finite entries (or entries that don't fit a long after scaling) are left
    out, as are vectors that haven't the most frequent length (ties: the longer). Repeated vectors are fitted once and all returned; a repeated or null vec_id
    is kept as it is; the names x, w and deviation get underscores in front where the table has such columns. Components without variance (all vectors equal, fewer distinct
    vectors than components) have null in ``w``; a deviation beyond a long is null. An empty table gives an empty result and a
    model with n = 0. The sign of a component is such that its largest entry is positive.
    """
    fit, d = fit_table(vectors, embedding)
    model = learned(fit, "x", d)
    flip = np.sign(model.vectors[np.abs(model.vectors).argmax(axis=0), range(d)]) if d else np.ones(0)
    model.vectors = model.vectors * np.where(flip == 0, 1, flip)
    model.error = identity_error(fit, "x", model, k)
    discard(fit)
    e, own = F.col(embedding), model.positive(k)
    x, w, dev = (free_name(vectors, c) for c in ("x", "w", "deviation"))
    fine = usable(e) & (F.size(e) == d)
    rows = vectors.where(fine).withColumn(x, F.when(fine, whole(e)))  # Spark may move what is made of x before the filter
    if not d or not model.n:
        return rows.withColumn(w, F.array().cast("array<double>")).withColumn(dev, F.lit(None).cast("long")), model
    parts = [projected(f"`{x}`", model, c) if c in own else F.lit(None).cast("double") for c in range(min(k, d))]
    return rows.withColumn(w, F.array(*parts)).withColumn(dev, deviation(f"`{x}`", model)), model


def components(vectors: DataFrame, k: int = 4, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """One row for each usable vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    ``explained`` is 0.0 for components of a covariance that is zero. Awkward tables: see ``whitened``.
    """
    plain = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("embedding"))
    rows, model = whitened(plain, k)
    trace = float(np.trace(model.covariance))
    share = [float(v / trace) if trace > 0 else 0.0 for v in model.values[:k]]
    spread = rows.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    explained = F.element_at(F.array(*(F.lit(s) for s in share or [0.0])), F.col("at") + 1)
    return spread.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"),
        F.lit(model.error).cast("double").alias("identity_error"),
    )
