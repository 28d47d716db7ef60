"""Metrics over traces: concordance, interpretation, step soundness, tool use, grounding, calibration, deferral, information."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestor.functions.text import norm_name
from attestor.operators.stats import bootstrap_mean, correlation, correlation_p, exact_median, rate_interval


def rated(counts: DataFrame, n: str, k: str, rate: str = "rate", lo: str = "lo", hi: str = "hi") -> DataFrame:
    """``counts`` with the rate k / n and its bootstrap interval instead of ``k``; all 0.0 on no rows."""
    ends = rate_interval(F.col(n), F.col(k))
    out = counts.withColumn("_ends", ends).withColumn(rate, F.round(F.coalesce(F.try_divide(F.col(k), F.col(n)), F.lit(0.0)), 6))
    return out.withColumn(lo, F.round("_ends.lo", 6)).withColumn(hi, F.round("_ends.hi", 6)).drop("_ends", *([] if k == n else [k]))


def flag_rate(df: DataFrame, flag: Column, by: list[str] | None = None) -> DataFrame:
    """(n, rate, lo, hi) of a flag over the rows where it isn't null."""
    return rated(df.groupBy(*(by or [])).agg(F.count(flag).alias("n"), F.count_if(flag).alias("k")), "n", "k")


def _clean(names: Column) -> Column:
    return F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda x: norm_name(x))


def first_in(recommendation: Column, gold: Column) -> Column:
    """Whether the first of the (normalised) recommended names is one of the gold names."""
    return F.coalesce(F.array_contains(gold, F.try_element_at(recommendation, F.lit(1))), F.lit(False))


def with_case(traces: DataFrame, cases: DataFrame) -> DataFrame:
    """Traces with their case's columns, by case_id; a trace whose case is unknown keeps nulls."""
    return traces.join(cases, "case_id", "left")


def correct_flags(traces: DataFrame) -> DataFrame:
    """(confidence, correct) of traces (recommendation, gold, confidence) with a gold set and a confidence."""
    t = traces.select(_clean(F.col("recommendation")).alias("r"), _clean(F.col("gold")).alias("g"), F.col("confidence").cast("double").alias("confidence"))
    return t.where((F.size("g") > 0) & F.col("confidence").isNotNull()).select("confidence", first_in(F.col("r"), F.col("g")).alias("correct"))


def concordance(traces: DataFrame) -> DataFrame:
    """One row: n, top1 and any_match with their intervals, skipped: the recommendation against the gold set, names normalised.

    traces (recommendation, gold): arrays; a trace without gold is skipped.
    """
    t = traces.select(_clean(F.col("recommendation")).alias("r"), F.array_distinct(_clean(F.col("gold"))).alias("g"))
    judged = F.size("g") > 0
    c = t.agg(
        F.count_if(judged).alias("n"), F.count_if(judged & first_in(F.col("r"), F.col("g"))).alias("k1"),
        F.count_if(judged & F.coalesce(F.arrays_overlap("r", "g"), F.lit(False))).alias("k2"), F.count_if(~judged).alias("skipped"),
    )
    return rated(rated(c, "n", "k1", "top1", "top1_lo", "top1_hi"), "n", "k2", "any_match", "any_lo", "any_hi")


def interpretation(traces: DataFrame) -> DataFrame:
    """One row: agreement (with its interval) of "recommended and not abstained" with "actionable", and the 2x2 counts.

    traces (actionable boolean, n_recommended, abstained).
    """
    predicted = (F.col("n_recommended") > 0) & ~F.col("abstained")
    a = F.coalesce("actionable", F.lit(False))
    c = traces.agg(
        F.count("*").alias("n"), F.count_if(predicted == a).alias("k"), F.count_if(a).alias("n_actionable"), F.count_if(a & predicted).alias("actionable_recommended"),
        F.count_if(a & ~predicted).alias("actionable_abstained"), F.count_if(~a & predicted).alias("other_recommended"), F.count_if(~a & ~predicted).alias("other_abstained"),
    )
    return rated(c, "n", "k", "agreement")


def step_soundness(steps: DataFrame, label: str = "label_sound") -> DataFrame:
    """One row (n, rate, lo, hi, unlabelled)."""
    c = steps.agg(F.count(label).alias("n"), F.count_if(F.col(label)).alias("k"), F.count_if(F.col(label).isNull()).alias("unlabelled"))
    return rated(c, "n", "k")


def tool_reliability(calls: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(n, success_rate, lo, hi, median_latency, redundant, empty, errors): calls (tool, args, ok, latency, n_results, error, ord).

    Redundant calls repeat (tool, args) of an earlier one; empty ones succeed without results; the first five errors are
    listed in order.
    """
    by = by or []
    median = F.median("latency") if by else F.lit(exact_median(calls, "latency")).cast("double")  # a trace's calls are few, a table's aren't
    out = calls.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if("ok").alias("k"), F.round(median, 6).alias("median_latency"),
        (F.count("*") - F.countDistinct("tool", F.coalesce("args", F.lit("")))).alias("redundant"), F.count_if(F.col("ok") & (F.coalesce("n_results", F.lit(-1)) == 0)).alias("empty"),
    )
    out = rated(out, "n", "k", "success_rate")
    first = calls.where("not ok").withColumn("r", F.row_number().over((W.partitionBy(*by) if by else W.partitionBy(F.lit(0))).orderBy("ord"))).where("r <= 5")
    listed = first.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "error"))), lambda x: x["error"]), ";").alias("errors"))
    return out.join(listed, by, "left") if by else out.crossJoin(listed)


def citation_grounding(citations: DataFrame, known: DataFrame | None, id_col: str = "id") -> DataFrame:
    """One row: with a key set, the share of citations that resolve; without, the share of traces with a citation.

    citations has a row for each citation and, for traces without, one with a null id (trace_id, id). If the key set has a
    boolean column ``supports``, the share of citations whose record supports the claim comes with it.
    """
    if known is None:
        per = citations.groupBy("trace_id").agg((F.count(id_col) > 0).alias("has"))
        return flag_rate(per, F.col("has"))
    support = "supports" in known.columns
    keys = known.groupBy(id_col).agg(*([F.bool_or("supports").alias("supports")] if support else []), F.lit(True).alias("ok")) if support else known.select(id_col).distinct().withColumn("ok", F.lit(True))
    j = citations.where(F.col(id_col).isNotNull()).join(keys, id_col, "left")
    out = flag_rate(j, F.coalesce("ok", F.lit(False)))
    if support:
        s = flag_rate(j, F.coalesce("supports", F.lit(False)))
        out = out.crossJoin(s.select(F.col("rate").alias("supports_rate"), F.col("lo").alias("supports_lo"), F.col("hi").alias("supports_hi")))
    return out


def calibration_bins(df: DataFrame, confidence: str, correct: str, n_bins: int = 5) -> DataFrame:
    """(bin, n, mean_confidence, accuracy) of equal-width bins, the last one closed; empty bins are listed with n = 0."""
    out = _bins(df, confidence, correct, n_bins)
    return out.select("bin", "n", *(F.round(x, 6).alias(x) for x in ("mean_confidence", "accuracy")))


def _bins(df: DataFrame, confidence: str, correct: str, n_bins: int) -> DataFrame:
    c = F.col(confidence)
    edges = [i / n_bins for i in range(n_bins + 1)]
    at = F.lit(n_bins - 1)
    for i in range(n_bins - 2, -1, -1):
        at = F.when(c < F.lit(edges[i + 1]), i).otherwise(at)
    per = df.where(c.isNotNull() & F.col(correct).isNotNull()).groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg(c).alias("mean_confidence"), F.avg(F.col(correct).cast("double")).alias("accuracy"))
    bins = df.sparkSession.range(n_bins).select(F.col("id").cast("int").alias("bin"))
    return bins.join(per, "bin", "left").fillna({"n": 0})


def calibration(df: DataFrame, confidence: str, correct: str, n_bins: int = 5, key: str | None = None) -> DataFrame:
    """One row (n, brier, ece), and with a ``key`` of the rows the bootstrap interval (brier_lo, brier_hi)."""
    f = df.where(F.col(confidence).isNotNull() & F.col(correct).isNotNull())
    error = F.pow(F.col(confidence) - F.col(correct).cast("double"), F.lit(2))
    bins = _bins(df, confidence, correct, n_bins).where("n > 0")
    ece = bins.agg(F.try_divide(F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("mean_confidence"))), F.sum("n")).alias("ece"))
    if key is None:
        brier, ends = f.agg(F.count("*").alias("n"), F.round(F.avg(error), 6).alias("brier")), []
    else:
        brier, ends = bootstrap_mean(f.select(key, error.alias("_error")), key, "_error").withColumnsRenamed({"mean": "brier", "lo": "brier_lo", "hi": "brier_hi"}), ["brier_lo", "brier_hi"]
    return brier.crossJoin(ece).select("n", "brier", F.round("ece", 6).alias("ece"), *ends)


def deferral_curve(df: DataFrame, confidence: str, correct: str, thresholds: tuple[float, ...] = (0.0, 0.3, 0.5, 0.7, 0.9)) -> DataFrame:
    """(threshold, kept, coverage, accuracy, accuracy_lo, accuracy_hi, monotone): confidence >= threshold is kept; accuracy is null where nothing is.

    One pass over the rows: the thresholds are columns of one aggregate.
    """
    f = df.where(F.col(confidence).isNotNull() & F.col(correct).isNotNull())
    ok = F.col(correct).cast("boolean")
    cells = [F.struct(F.lit(t).alias("threshold"), F.count_if(F.col(confidence) >= t).alias("kept"), F.count("*").alias("n"), F.count_if((F.col(confidence) >= t) & ok).alias("k")) for t in thresholds]
    rows = f.agg(F.array(*cells).alias("a")).select(F.explode("a").alias("r")).select("r.*")
    rows = rows.select("threshold", "kept", F.try_divide("kept", "n").alias("coverage"), F.try_divide("k", "kept").alias("exact"), "k")
    rows = rated(rows, "kept", "k", "accuracy", "accuracy_lo", "accuracy_hi")
    before = F.last("exact", ignorenulls=True).over(W.orderBy("threshold").rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("falls", F.coalesce(F.col("exact") < before - 1e-9, F.lit(False)))
    some = lambda c: F.when(F.col("kept") > 0, F.col(c)).alias(c)
    return rows.select("threshold", "kept", F.round("coverage", 6).alias("coverage"), some("accuracy"), some("accuracy_lo"), some("accuracy_hi"), (~F.bool_or("falls").over(W.partitionBy(F.lit(0)))).alias("monotone"))


def evidence_gathered(traces: DataFrame, calls: DataFrame, citations: DataFrame) -> DataFrame:
    """(trace_id, n_evidence): distinct citations and successful calls that found something."""
    c = citations.where("id is not null").groupBy("trace_id").agg(F.countDistinct("id").alias("c"))
    t = calls.where("ok and n_results > 0").groupBy("trace_id").agg(F.count("*").alias("t"))
    return traces.select("trace_id").distinct().join(c, "trace_id", "left").join(t, "trace_id", "left").select("trace_id", (F.coalesce("c", F.lit(0)) + F.coalesce("t", F.lit(0))).alias("n_evidence"))


def information_gathering(traces: DataFrame, calls: DataFrame, citations: DataFrame) -> DataFrame:
    """One row (n, n_correct, n_incorrect, mean_correct, mean_incorrect, r, p, tracks): does more evidence go with being correct?

    traces (trace_id, correct); those with a null flag are left out. The point-biserial correlation of the evidence gathered with
    the flag, and its p-value, are null under three traces or with one outcome; ``tracks`` is r > 0.1.
    """
    t = traces.where("correct is not null")
    j = evidence_gathered(t, calls, citations).join(t.select("trace_id", F.col("correct").cast("boolean").alias("correct")), "trace_id")
    f, v = F.col("correct").cast("double"), F.col("n_evidence").cast("double")
    s = j.agg(F.count("*").alias("n"), F.count_if("correct").alias("n_correct"), F.count_if(~F.col("correct")).alias("n_incorrect"), F.avg(F.when(F.col("correct"), v)).alias("a"), F.avg(F.when(~F.col("correct"), v)).alias("b"), correlation(f, v).alias("c"))
    r = F.when((F.col("n") >= 3) & (F.col("n_correct") > 0) & (F.col("n_incorrect") > 0), F.col("c"))
    s = s.withColumn("r", r)
    return s.select("n", "n_correct", "n_incorrect", F.round("a", 3).alias("mean_correct"), F.round("b", 3).alias("mean_incorrect"), F.round("r", 4).alias("r"), F.round(correlation_p(F.col("r"), F.col("n")), 4).alias("p"), F.coalesce(F.col("r") > 0.1, F.lit(False)).alias("tracks"))


#: Name to function of every metric, in the order of reports.
METRICS: dict[str, Callable[..., DataFrame]] = {
    "guideline_concordance": concordance,
    "molecular_interpretation": interpretation,
    "reasoning_steps": step_soundness,
    "tool_use": tool_reliability,
    "citation_grounding": citation_grounding,
    "calibration": calibration,
    "deferral": deferral_curve,
    "information_gathering": information_gathering,
}
