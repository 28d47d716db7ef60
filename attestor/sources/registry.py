"""Named evidence sources: each is a function (spark, root) -> DataFrame of rows; ``retrieve`` answers queries from one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.operators.evidence import retrieved, searched
from attestor.sources.landing import clinical_records, evidence_nodes, mutation_records

Reader = Callable[[SparkSession, str], DataFrame]


class NotConfigured(RuntimeError):
    """A licensed source whose data aren't there."""


def _reserved(name: str) -> Reader:
    """A licensed source: guarded, and without a reader of its own yet."""

    def read(spark: SparkSession, root: str) -> DataFrame:
        require_data(spark, root, name)
        raise NotImplementedError(f"{name}: data found, but no reader is defined for them")

    return read


def require_data(spark: SparkSession, root: str, name: str) -> None:
    """Raise unless root/name exists and isn't empty, wherever root is stored."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
    fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not root or not fs.exists(path) or not fs.listStatus(path):
        raise NotConfigured(f"{name}: no data under {root}/{name}")


PUBLIC: dict[str, Reader] = {"cases": mutation_records, "somatic_evidence": evidence_nodes, "germline_records": clinical_records}
LICENSED: dict[str, Reader] = {n: _reserved(n) for n in ("guideline_network", "licensed_knowledge_base", "institutional")}


def get_source(name: str) -> Reader:
    """The reader of a name; KeyError lists the names there are."""
    every = PUBLIC | LICENSED
    if name not in every:
        raise KeyError(f"unknown source {name!r}: {', '.join(every)}")
    return every[name]


def retrieve(spark: SparkSession, root: str, name: str, queries: DataFrame, k: int = 5) -> DataFrame:
    """Evidence for queries (query_id, gene, variant, tumor) from a named source, the first ``k`` records of each with their rank.

    Somatic evidence is found by the molecular profile "gene variant", germline records by gene and change. The case source is no
    evidence source and raises; licensed sources raise as ``get_source`` has them.
    """
    reader = get_source(name)
    if name == "cases":
        raise TypeError("cases: a source of cases, not of evidence; read its records with get_source")
    rows = reader(spark, root)
    if name == "somatic_evidence":
        asked = queries.select("query_id", F.concat_ws(" ", "gene", "variant").alias("profile"), "tumor")
        return retrieved(rows, asked, k)
    return searched(rows.drop("query_id"), queries.select("query_id", "gene", "variant"), k)


def available_sources(include_licensed: bool = True) -> list[str]:
    """Names, public ones first."""
    return [*PUBLIC, *(LICENSED if include_licensed else ())]
