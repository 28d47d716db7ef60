"""Record checks, as rows (study, check, severity, sample, gene, detail), and their summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.functions.text import canonical_build, expected_consequence, protein_consequence


def _findings(df: DataFrame, check: str, severity: str, sample: Column, gene: Column, detail: Column) -> DataFrame:
    return df.select("study", F.lit(check).alias("check"), F.lit(severity).alias("severity"), sample.cast("string").alias("sample"), gene.cast("string").alias("gene"), detail.alias("detail"))


def build_mixed(records: DataFrame) -> DataFrame:
    """Studies with more than one genome build."""
    builds = records.groupBy("study").agg(F.array_sort(F.collect_set(canonical_build("build"))).alias("b")).where(F.size("b") > 1)
    return _findings(builds, "build_mixed", "high", F.lit(None), F.lit(None), F.array_join("b", ","))


def type_vs_protein(records: DataFrame) -> DataFrame:
    """Records whose protein change doesn't look like their mutation type; an empty change is exempt."""
    looks = protein_consequence("change")
    bad = records.where(expected_consequence("mutation_type").isNotNull() & (looks != "empty") & (looks != expected_consequence("mutation_type")))
    return _findings(bad, "type_vs_protein", "medium", F.col("sample"), F.col("gene"), F.concat_ws(" ", F.col("mutation_type"), F.col("change"), looks))


def zero_alt(records: DataFrame) -> DataFrame:
    """Called records without supporting reads; an unknown count is fine."""
    return _findings(records.where("alt_count = 0"), "vaf_zero_alt", "medium", F.col("sample"), F.col("gene"), F.coalesce("change", F.lit("None")))


def duplicate_rows(records: DataFrame) -> DataFrame:
    """One finding for each (sample, gene id, change) that occurs more than once; null changes are a key too."""
    n = records.groupBy("study", "sample", "gene_id", "change").agg(F.count("*").alias("n")).where("n > 1")
    return _findings(n, "duplicate_row", "low", F.col("sample"), F.lit(None), F.concat(F.col("n").cast("string"), F.lit("x "), F.coalesce("change", F.lit("None"))))


def hypermutator(records: DataFrame, threshold: int = 1000) -> DataFrame:
    n = records.groupBy("study", "sample").agg(F.count("*").alias("n")).where(F.col("n") >= threshold)
    return _findings(n, "hypermutator", "low", F.col("sample"), F.lit(None), F.col("n").cast("string"))


def run_qc(records: DataFrame, threshold: int = 1000) -> DataFrame:
    """All findings."""
    out = build_mixed(records)
    for part in (type_vs_protein(records), zero_alt(records), duplicate_rows(records), hypermutator(records, threshold)):
        out = out.unionByName(part)
    return out


def qc_summary(findings: DataFrame) -> DataFrame:
    """Findings by study and severity, with the distinct checks."""
    return findings.groupBy("study", "severity").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("check")), ",").alias("checks"))


def by_severity(findings: DataFrame, severity: str) -> DataFrame:
    return findings.where(F.col("severity") == severity)
