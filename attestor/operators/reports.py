"""Reports over sampled candidates and relabelled citations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sampling_report(samples: DataFrame, steps: DataFrame) -> DataFrame:
    """One row over samples (case_id, sample, parsed_ok, abstained) and their steps (case_id, sample, sound, cited, unresolvable, off_case)."""
    per = steps.groupBy("case_id", "sample").agg(F.count("*").alias("n"), F.avg(F.col("sound").cast("double")).alias("share"))
    s = samples.join(per, ["case_id", "sample"], "left").withColumn("share", F.coalesce("share", F.lit(0.0))).withColumn("n", F.coalesce("n", F.lit(0)))
    spread = s.groupBy("case_id").agg((F.max("share") - F.min("share")).alias("spread"), F.count("*").alias("k"))
    a = s.agg(F.count("*").alias("n_samples"), F.countDistinct("case_id").alias("n_cases"), F.avg(F.col("parsed_ok").cast("double")).alias("parse"), F.sum("n").alias("n_steps"), F.avg("n").alias("mean_steps"), F.avg(F.col("abstained").cast("double")).alias("abst"))
    some = lambda c: F.count_if(F.size(c) > 0).alias(f"n_{c}")
    u = steps.agg(F.avg((~F.col("sound")).cast("double")).alias("unsound"), some("unresolvable"), some("off_case"), F.count_if(F.size("cited") == 0).alias("uncited_steps"))
    w = spread.where("k > 1").agg(F.avg("spread").alias("within"))
    j = a.crossJoin(u).crossJoin(w)
    r = lambda c, name: F.round(c, 4).alias(name)
    return j.select("n_samples", "n_cases", r("parse", "parse_rate"), "n_steps", r(F.coalesce("unsound", F.lit(0.0)), "unsound_step_rate"), F.col("n_unresolvable").alias("invented_id_steps"), F.col("n_off_case").alias("off_case_id_steps"), "uncited_steps", r("abst", "abstain_rate"), r("within", "mean_within_case_spread"), r("mean_steps", "mean_steps_per_sample"))


def relabel_report(steps: DataFrame, keys: list[str]) -> DataFrame:
    """One row over relabelled steps (see ``labels.relabelled_steps``; ``keys`` name a sample): rates, the counters by kind of fault, distinct invented ids."""
    some = lambda c: F.count_if(F.size(c) > 0)
    s = steps.agg(
        F.count("*").alias("n_steps"), F.avg(F.col("label_sound").cast("double")).alias("s"), F.count_if((F.size("cited") == 0) & (F.size("invented") == 0)).alias("steps_uncited"),
        some("invented").alias("steps_with_invented"), some("prose").alias("steps_with_prose"), some("off_case").alias("steps_off_case"),
    )
    n = steps.select(*keys).distinct().agg(F.count("*").alias("n_samples"))
    i = steps.select(F.explode("invented").alias("t")).agg(F.countDistinct("t").alias("distinct_invented_ids"))
    return n.crossJoin(s).crossJoin(i).select("n_samples", "n_steps", F.round("s", 3).alias("sound_rate"), F.round(1 - F.col("s"), 3).alias("unsound_rate"), "steps_uncited", "steps_with_invented", "steps_with_prose", "steps_off_case", "distinct_invented_ids")


def citation_kinds(tokens: DataFrame) -> DataFrame:
    """Counts by kind of citation token (columns kind, token)."""
    return tokens.groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("token").alias("n_distinct"))


def top_invented(tokens: DataFrame, k: int = 10) -> DataFrame:
    """The most frequent invented strings: a top-k report."""
    return tokens.where("kind = 'invented'").groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(k)


def label_composition(steps: DataFrame) -> DataFrame:
    """Eight conditional counts over steps (structural, semantic, contradicted, therapy_mismatch, disease_mismatch, n_judgeable)."""
    t = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False)))
    return steps.agg(
        F.count("*").alias("n_steps"), t("structural").alias("structural"), t("semantic").alias("semantic"), F.count_if(F.col("structural") & F.col("semantic")).alias("both"),
        t("contradicted").alias("contradicted"), t("therapy_mismatch").alias("therapy_mismatch"), t("disease_mismatch").alias("disease_mismatch"), F.count_if(F.col("n_judgeable") > 0).alias("judgeable"),
    )
