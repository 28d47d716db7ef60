"""Raw answers of public services, landed as JSON files, to typed tables; guards and lookups before a scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.functions.text import claim_text, normalize_missing, origin_is_somatic
from attestor.operators.evidence import accession, canonical_ids, kind

MUTATION = """studyId STRING, sampleId STRING, patientId STRING, gene STRUCT<hugoGeneSymbol: STRING>, entrezGeneId INT, proteinChange STRING, mutationType STRING, chr STRING, startPosition INT,
endPosition INT, referenceAllele STRING, variantAllele STRING, ncbiBuild STRING, tumorAltCount INT, tumorRefCount INT, mutationStatus STRING, validationStatus STRING, hugoGeneSymbol STRING"""
EVIDENCE = """id INT, evidenceType STRING, evidenceLevel STRING, evidenceDirection STRING, significance STRING, evidenceRating INT, status STRING, variantOrigin STRING, therapies ARRAY<STRUCT<name: STRING>>,
disease STRUCT<name: STRING, doid: STRING>, molecularProfile STRUCT<name: STRING, variants: ARRAY<STRUCT<id: INT, name: STRING, alleleRegistryId: STRING, clinvarIds: ARRAY<STRING>, hgvsDescriptions: ARRAY<STRING>>>>, source STRUCT<citationId: STRING, sourceType: STRING>"""
CLINICAL = """uid STRING, accession STRING, title STRING, protein_change STRING, obj_type STRING, genes ARRAY<STRUCT<symbol: STRING, geneid: STRING>>, germline_classification STRUCT<description: STRING, review_status: STRING, last_evaluated: STRING>,
oncogenicity_classification STRUCT<description: STRING>, somatic_clinical_impact STRING"""
STUDY = "studyId STRING, name STRING, sequencedSampleCount INT, allSampleCount INT"


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def allowed(studies: list[str], allowed_studies: list[str], restricted: tuple[str, ...] = ()) -> None:
    """Check study names before any scan: ValueError for restricted ones and for those not on the list."""
    for s in studies:
        if any(r in s.lower() for r in restricted):
            raise ValueError(f"{s}: restricted study")
        if s not in allowed_studies:
            raise ValueError(f"{s}: not an allowed study")


def discovered(studies: DataFrame, keys: list[str], restricted: tuple[str, ...] = (), include_restricted: bool = False) -> DataFrame:
    """(study_id, name, n_samples, restricted) of studies whose id or name has one of the keys, the largest first."""
    text = F.lower(F.concat_ws(" ", "studyId", "name"))
    hit = F.exists(F.array(*(F.lit(k.lower()) for k in keys)), lambda k: F.contains(text, k))
    closed = F.exists(F.array(*(F.lit(r) for r in restricted)).cast("array<string>"), lambda r: F.contains(F.lower("studyId"), r))
    out = studies.where(hit).select(F.col("studyId").alias("study_id"), "name", F.coalesce("sequencedSampleCount", "allSampleCount").alias("n_samples"), closed.alias("restricted"))
    return (out if include_restricted else out.where("not restricted")).orderBy(F.desc("n_samples"), "study_id")


def normalised_mutations(raw: DataFrame, *more: str) -> DataFrame:
    """Nested answers to flat records, with the columns ``more``; placeholders become null."""
    m = lambda c: normalize_missing(c)
    return raw.select(
        F.col("studyId").alias("study_id"), F.col("sampleId").alias("sample_id"), F.col("patientId").alias("patient_id"), F.coalesce("gene.hugoGeneSymbol", "hugoGeneSymbol").alias("gene_symbol"),
        F.col("entrezGeneId").alias("entrez_gene_id"), m("proteinChange").alias("protein_change"), m("mutationType").alias("mutation_type"), F.col("chr").alias("chrom"), F.col("startPosition").alias("start"),
        F.col("endPosition").alias("end"), F.col("referenceAllele").alias("ref"), F.col("variantAllele").alias("alt"), m("ncbiBuild").alias("build"), F.col("tumorAltCount").alias("tumor_alt_count"),
        F.col("tumorRefCount").alias("tumor_ref_count"), m("mutationStatus").alias("mutation_status"), m("validationStatus").alias("validation_status"), *more,
    )


def mutation_records(spark: SparkSession, path: str) -> DataFrame:
    return normalised_mutations(_json(spark, path, MUTATION))


def fetched_mutations(records: DataFrame, study: str, gene_ids: list[int]) -> DataFrame:
    """One study's records of these genes: both conditions reach the scan (partitions by study_id)."""
    return records.where((F.col("study_id") == study) & F.col("entrez_gene_id").isin(gene_ids))


def gene_panels(panels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(distinct panel ids in order, (panel_id, gene)) of a table (panel_id, genes array)."""
    return panels.select("panel_id").distinct().orderBy("panel_id"), panels.select("panel_id", F.explode("genes").alias("gene")).distinct()


def evidence_nodes(spark: SparkSession, path: str) -> DataFrame:
    return normalised_evidence(_json(spark, path, EVIDENCE))


def normalised_evidence(raw: DataFrame, *more: str) -> DataFrame:
    """Evidence rows from nodes, with claim sentence and canonical identifiers, and the columns ``more``."""
    names = F.coalesce(F.transform("therapies", lambda t: t["name"]), F.array().cast("array<string>"))
    variants = F.transform("molecularProfile.variants", lambda v: F.struct(v["alleleRegistryId"].alias("caid"), v["clinvarIds"].alias("clinvar_ids"), v["hgvsDescriptions"].alias("hgvs")))
    ids = canonical_ids(F.coalesce(variants, F.array().cast("array<struct<caid: string, clinvar_ids: array<string>, hgvs: array<string>>>")))
    claim = claim_text(F.col("molecularProfile.name"), F.col("evidenceDirection"), F.col("significance"), names, F.col("disease.name"), F.col("evidenceLevel"), F.coalesce("evidenceRating", F.lit(0)))
    return raw.select(
        F.concat(F.lit("civic:EID"), F.col("id").cast("string")).alias("citation_id"), kind(F.col("evidenceType")).alias("kind"), F.col("evidenceType").alias("evidence_type"), F.col("evidenceLevel").alias("level"),
        F.col("evidenceDirection").alias("direction"), "significance", F.col("evidenceRating").alias("rating"), "status", origin_is_somatic("variantOrigin").alias("is_somatic"), names.alias("therapies"),
        F.col("disease.name").alias("disease"), F.col("disease.doid").alias("doid"), F.col("molecularProfile.name").alias("profile"), F.col("source.citationId").alias("source_citation"), ids.alias("ids"), claim.alias("summary"), F.col("id").alias("ord"), *more,
    )


def clinical_records(spark: SparkSession, path: str) -> DataFrame:
    return normalised_clinical(_json(spark, path, CLINICAL))


def normalised_clinical(raw: DataFrame, *more: str) -> DataFrame:
    """Germline records with the columns ``more``; those without a germline description are dropped."""
    gene = F.get("genes", 0)
    return raw.where(F.coalesce(F.length(F.trim("germline_classification.description")), F.lit(0)) > 0).select(
        F.col("uid").alias("id"), accession(F.when(F.length("accession") > 0, F.col("accession")), F.col("uid")).alias("accession"), "title", "protein_change", gene["symbol"].alias("gene"), gene["geneid"].alias("gene_id"),
        F.col("germline_classification.description").alias("germline"), F.col("germline_classification.review_status").alias("level"), F.col("germline_classification.last_evaluated").alias("last_evaluated"),
        F.col("oncogenicity_classification.description").alias("oncogenicity"), "somatic_clinical_impact", F.lit("pathogenicity").alias("kind"), F.lit(False).alias("is_somatic"), *more,
    )


def request_key(request: Column) -> Column:
    """The first 16 hexadecimal digits of the request's sha1."""
    return F.substring(F.sha1(request.cast("binary")), 1, 16)


def landed(df: DataFrame, path: str, request: Column) -> None:
    """Append raw answers to a landing table under the keys of their requests."""
    df.withColumn("request", request_key(request)).write.mode("append").json(path)


def requested(spark: SparkSession, path: str, requests: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """(answers, missing): the landed answers to the requests (column request), and the requests that have none yet.

    An answer with a field ``errors`` is an error of the service and raises.
    """
    asked = requests.select("request", request_key(F.col("request")).alias("key")).distinct()
    old = spark.read.schema(f"request STRING, errors STRING, {schema}").json(path).withColumnRenamed("request", "key")
    hits = old.join(asked, "key")
    bad = hits.where("errors is not null").select("errors").limit(1).collect()
    if bad:
        raise RuntimeError(f"the service answered with errors: {bad[0].errors}")
    return hits.drop("errors", "key"), asked.join(old.select("key").distinct(), "key", "left_anti").select("request")
