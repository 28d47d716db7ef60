"""Mixing sources to target weights by soft membership, in DataFrame functions only.

A naive Bayes classifier learned from the labels table gives each document a posterior over domains. Nonnegative rates
for the documents are then fitted so that the expected token totals of the domains, sum of rate * tokens * posterior, match target
weights of the budget: projected gradient on the least squares of the totals' errors (each divided by the root of its
domain's natural share, which makes the largest curvature one and the step size known) and a small pull towards rate 1.
The gradient of a document depends on it through its posterior only, so one round is one aggregate of as many numbers as
there are domains, and the rate is a fixed expression of the posterior.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.llm.common import discard, free_name, written

#: Domain of a labelled row, by precedence, and the default share of tokens that each shall have.
DOMAINS = {"toxic": "toxic > 0", "good": "quality > 0", "poor": "true"}
TARGETS = {"good": 0.94, "poor": 0.03, "toxic": 0.03}
MAX_DOCS, LEXICON, RIDGE, ROUNDS = 4000, 64, 1e-3, 40
BINS = 16
#: A word of the lexicon is at least so many times as frequent in documents of one domain as in all.
MIN_LIFT = 3.0
BETWEEN = r"[\x20\x09-\x0D.,;:!?\"'()\[\]|*$%&#<>]+"


def _prepared(docs: DataFrame) -> DataFrame:
    """Add _mix_w (lower-cased words between white space and punctuation; an empty one at a cut end) and counts of characters.

    Regular expressions, since Spark's translate looks up every character as a string.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    n = F.char_length(t)
    left = lambda chars: n - F.char_length(F.regexp_replace(t, chars, ""))
    return docs.withColumns({"_mix_w": F.split(F.lower(t), BETWEEN), "_mix_n": n, "_mix_s": left("[#*$%&|<>!]"), "_mix_u": left("[A-Z]")})


def _features(docs: DataFrame, lexicon: list[str]) -> DataFrame:
    """Add n_tokens, _mix_b (bins, each 0..15) and _mix_hits (words of the lexicon) to ``docs``."""
    known = F.array(*(F.lit(x) for x in lexicon)) if lexicon else F.array().cast("array<string>")
    once = F.transform(F.array("_mix_w"), lambda w: F.struct((F.size(w) - F.when(w[0] == "", 1).otherwise(0) - F.when((F.size(w) > 1) & (F.element_at(w, -1) == ""), 1).otherwise(0)).alias("n"), F.size(F.array_distinct(w)).alias("d"), F.array_intersect(w, known).alias("h"), F.col("_mix_n").alias("c"), F.col("_mix_s").alias("s"), F.col("_mix_u").alias("u")))
    # exploded (to one row): later filters and projections read the struct, they don't evaluate it again
    df = _prepared(docs).select(*docs.columns, F.explode(once).alias("_mix_f"))
    n, size = F.greatest(F.col("_mix_f.n"), F.lit(1)), F.greatest(F.col("_mix_f.c"), F.lit(1))
    capped = lambda x: F.least(F.floor(x), F.lit(BINS - 1)).cast("int")
    bins = F.array(
        capped(F.log2(F.lit(1.0) + F.col("_mix_f.n"))), capped(400 * F.col("_mix_f.s") / size), capped(30 * F.col("_mix_f.u") / size),
        capped(15 * F.col("_mix_f.d") / n), capped(size / n),
    )
    return df.select(*docs.columns, F.col("_mix_f.n").cast("long").alias("n_tokens"), bins.alias("_mix_b"), F.col("_mix_f.h").alias("_mix_hits"))


N_FEATURES = 5


def _added(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def _literal(values: list) -> Column:
    """A constant array, of numbers or of arrays."""
    return F.array(*(_literal(v) if isinstance(v, list) else F.lit(float(v)) for v in values))


@dataclass
class Mixture:
    """What is learned: domains, log priors, log likelihoods by feature and bin, lexicon weights, and the rounds' gradients."""

    domains: list[str]
    prior: list[float]
    bins: list[list[list[float]]]
    words: dict[str, list[float]]
    steps: list[list[float]] = field(default_factory=list)
    ridge: float = RIDGE
    error: float = 0.0

    def posterior(self) -> Column:
        """The domains' posteriors as one array, from _mix_b and _mix_hits: vectors of log likelihoods are added, then normalised."""
        parts = [_literal(table)[F.col("_mix_b")[f]] for f, table in enumerate(self.bins)]
        if self.words:
            weights = F.create_map(*(v for w, p in self.words.items() for v in (F.lit(w), _literal(p))))
            parts.append(F.aggregate("_mix_hits", _literal([0.0] * len(self.domains)), lambda a, w: _added(a, F.try_element_at(weights, w))))
        logs = F.aggregate(F.array(*parts), _literal(self.prior), _added)
        odds = F.transform(F.array(logs), lambda v: F.transform(v, lambda x: F.exp(x - F.array_max(v))))[0]
        return F.transform(F.array(odds), lambda v: F.transform(v, lambda x: x / F.aggregate(v, F.lit(0.0), lambda a, y: a + y)))[0]

    def posteriors(self, df: DataFrame) -> DataFrame:
        """Add p_<domain> to a frame that has the features."""
        df = df.withColumn("_mix_p", self.posterior())
        return df.select("*", *(F.col("_mix_p")[k].alias(f"p_{d}") for k, d in enumerate(self.domains))).drop("_mix_b", "_mix_hits", "_mix_p")

    def rate(self, posterior: Column, start: int = 0, base: Column | None = None) -> Column:
        """The rate after all rounds (from round ``start`` on, given the rate before it): projections onto rate >= 0."""
        first = F.lit(1.0) if base is None else base
        if not self.steps[start:]:
            return first

        def step(p: Column):
            def moved(r: Column, g: Column) -> Column:
                pull = sum((p[k] * g[k] for k in range(1, len(self.domains))), p[0] * g[0])
                return F.greatest(F.lit(0.0), r * (1 - self.ridge) + self.ridge - pull)

            return moved

        return F.transform(F.array(posterior), lambda p: F.aggregate(_literal(self.steps[start:]), first, step(p)))[0]


def classifier(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, lexicon: int = LEXICON) -> Mixture:
    """Learn the posteriors from at most ``max_docs`` labelled documents (in the order of a hash of doc_id)."""
    domain = F.coalesce(*(F.when(F.expr(cond), F.lit(d)) for d, cond in DOMAINS.items()))
    marks = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    marks = marks.select("doc_id", domain.alias("domain"))
    chosen = [r.doc_id for r in marks.orderBy(F.xxhash64(F.col("doc_id").cast("string"))).limit(max_docs).collect()]
    if not chosen:
        return Mixture([], [], [], {})
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isin(chosen))
    marks = marks.where(F.col("doc_id").isin(chosen))
    sample = written(own.join(marks, "doc_id"))
    sizes = {r.domain: r["count"] for r in sample.groupBy("domain").count().collect()}
    domains, total = sorted(sizes), sum(sizes.values())
    if not domains:
        return Mixture([], [], [], {})
    seen = _prepared(sample).select("domain", F.explode(F.array_distinct("_mix_w")).alias("w")).where("w <> ''")
    per = seen.groupBy("w").agg(F.count("*").alias("n"), *(F.count_if(F.col("domain") == d).alias(f"n_{k}") for k, d in enumerate(domains))).where("n >= 5")
    gain = sum((F.when(F.col(f"n_{k}") > 0, F.col(f"n_{k}") * F.log(F.col(f"n_{k}") / F.col("n") / F.lit(sizes[d] / total))).otherwise(0.0) for k, d in enumerate(domains)), F.lit(0.0))
    lift = F.greatest(*(F.col(f"n_{k}") / F.col("n") / F.lit(sizes[d] / total) for k, d in enumerate(domains)), F.lit(0.0))
    best = per.where(lift >= MIN_LIFT).orderBy(gain.desc(), "w").limit(lexicon).collect()
    prior = [math.log(sizes[d] / total) for d in domains]
    words = {}
    for r in best:
        p = [(r[f"n_{k}"] + 0.5) / (sizes[d] + 1) for k, d in enumerate(domains)]
        words[r.w] = [math.log(x / (1 - x)) for x in p]
        prior = [a + math.log(1 - x) for a, x in zip(prior, p, strict=True)]
    counts = _features(sample, []).select("domain", F.posexplode("_mix_b").alias("f", "bin")).groupBy("f", "bin", "domain").count().collect()
    n = {(r.f, r.bin, r.domain): r["count"] for r in counts}
    bins = [[[math.log((n.get((f, b, d), 0) + 0.2) / (sizes[d] + 0.2 * BINS)) for d in domains] for b in range(BINS)] for f in range(N_FEATURES)]
    discard(sample)
    return Mixture(domains, prior, bins, words)


def fitted(members: DataFrame, mix: Mixture, targets: dict[str, float], rounds: int = ROUNDS, tolerance: float = 1e-4, every: int = 8, settled: float = 0.02) -> DataFrame:
    """Run the projected gradient on members (n_tokens, p_...); the rounds are kept in ``mix``. Returns members with rate.

    Domains without a target, or without any expected tokens, are left free. The budget is the table's own tokens. ``rounds`` go on
    (five times as many at most) while they lower the error; rates that still move then, over ``settled`` off a target, raise.
    Targets that nonnegative rates can't meet are warned of. The largest relative error is in ``mix.error``.
    """
    total = lambda df, w: df.agg(F.sum("n_tokens").cast("double").alias("n"), *(F.sum(w * F.col("n_tokens") * F.col(f"p_{d}")).alias(d) for d in mix.domains)).first()
    natural = total(members, F.lit(1.0))
    n = natural.n or 0.0
    share = {d: (natural[d] or 0.0) / n if n else 0.0 for d in mix.domains}
    use = [d for d in mix.domains if share[d] > 1e-9 and targets.get(d, 0) > 0]
    norm = sum(targets[d] for d in use)
    goal = {d: targets[d] / norm * sum(share[x] for x in use) for d in use} if use else {}
    state, done = members.withColumn("rate", F.lit(1.0)), 0
    of = F.array(*(F.col(f"p_{d}") for d in mix.domains))
    got = share
    worst = lambda: max((abs(got[d] - goal[d]) / goal[d] for d in use), default=0.0)
    trail = [worst()]
    for i in range(5 * rounds):
        error = {d: got[d] - goal[d] for d in use}
        # beyond ``rounds`` as long as that still helps; targets out of reach leave an error that no round lowers
        if trail[-1] < tolerance or i >= rounds and trail[-1] > 0.99 * trail[max(0, len(trail) - 6)]:
            break
        mix.steps.append([error[d] / share[d] if d in goal else 0.0 for d in mix.domains])
        if i % every == every - 1:
            new = written(state.withColumn("rate", mix.rate(of, done, F.col("rate"))))
            discard(state)
            state, done = new, len(mix.steps)
        row = total(state, mix.rate(of, done, F.col("rate")))
        got = {d: (row[d] or 0.0) / n for d in mix.domains}
        trail.append(worst())
    else:
        if trail[-1] > settled:
            raise RuntimeError(f"the rates still move after {5 * rounds} rounds, {trail[-1]:.2%} off the targets")
    mix.error = trail[-1]
    if mix.error > settled:
        warnings.warn(f"the targets are out of reach: the nearest rates are {mix.error:.2%} off", stacklevel=2)
    return state.withColumn("rate", mix.rate(of, done, F.col("rate")))


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, **options) -> tuple[DataFrame, Mixture]:
    """((doc_id, n_tokens, p_<domain>..., rate) with one row for each input row, what was learned).

    Input columns: docs (doc_id, text) and labels (doc_id, quality, toxic). Null and empty texts have no tokens and the
    posterior of an empty text. Labels with a null, or of no document, are not learned from; of several labels of a
    document the largest values count. Without labels there are no domains and every rate is 1.
    """
    mix = classifier(docs, labels, **options)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    frame = _features(own, list(mix.words)).drop("text")
    members = written(mix.posteriors(frame) if mix.domains else frame.drop("_mix_b", "_mix_hits"))
    return fitted(members, mix, TARGETS if targets is None else targets), mix


def with_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """``docs`` with a column rate, without rows of rate 0; a column of that name is replaced. The fitted rates are an expression of the text: no join.

    Null and empty texts have the posterior, and so the rate, of an empty text; equal texts have equal rates, so repeated rows and ties are
    alike. A null doc_id or label is not learned from. Other columns, whatever their names and nulls, are passed on. Empty for
    an empty table; without labels every rate is 1.
    """
    _, mix = mixed(docs, labels, targets)
    docs = docs.drop("rate")
    if not mix.domains:
        return docs.withColumn("rate", F.lit(1.0))
    row = free_name(docs, "_mix_row")
    frame = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias(row), docs["text"].alias("text"))
    rated = _features(frame, list(mix.words)).select(row, F.explode(F.array(mix.rate(mix.posterior()))).alias("rate")).where("rate > 0")
    return rated.select(*(F.col(row)[c].alias(c) for c in docs.columns), "rate")
