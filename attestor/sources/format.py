"""The public sources as Spark data sources: landed answers in folders by key, read file by file.

``spark.read.format("attestor_evidence").load(folder)`` reads ``folder/key=.../*.json``. Filters on the key decide which files become partitions at all; equality filters on
other plain columns are applied to the rows of a file before they leave it. Licensed sources are registered too, and raise until their data are there.
"""

from __future__ import annotations

import urllib.parse
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.json
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from attestor.operators.evidence import retrieved, searched
from attestor.sources import landing
from attestor.sources.registry import LICENSED, NotConfigured

#: Bytes of JSON parsed at a time; a longer line can't be read.
BLOCK = 16 << 20

NO_KEY = "__HIVE_DEFAULT_PARTITION__"


@dataclass
class LandedFile(InputPartition):
    path: str
    key: str | None


def _key_of(path: str) -> str | None:
    for part in reversed(path.split("/")[:-1]):
        if part.startswith("key="):
            value = urllib.parse.unquote(part[4:])
            return None if value == NO_KEY else value
    return None


def _passes(f: Filter, value) -> bool:
    if isinstance(f, EqualTo):
        return value is not None and value == f.value
    if isinstance(f, EqualNullSafe):
        return value == f.value
    if isinstance(f, In):
        return value is not None and value in f.value
    return (value is None) == isinstance(f, IsNull)


class LandedReader(DataSourceReader):
    """Reads the files whose key passes the filters on it."""

    def __init__(self, root: str, schema: StructType):
        self.root, self.schema = root, schema
        self.on_key: list[Filter] = []
        self.on_rows: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        plain = {f.name for f in self.schema.fields if f.dataType.simpleString() in ("string", "int", "bigint")}
        for f in filters:
            name = getattr(f, "attribute", ())
            if name == ("key",) and isinstance(f, (EqualTo, EqualNullSafe, In, IsNotNull, IsNull)):
                self.on_key.append(f)
            elif len(name) == 1 and name[0] in plain and isinstance(f, (EqualTo, In)):
                self.on_rows.append(f)
            else:
                yield f

    def partitions(self) -> list[LandedFile]:
        fs, root = pyarrow.fs.FileSystem.from_uri(self.root)
        found = [f.path for f in fs.get_file_info(pyarrow.fs.FileSelector(root, recursive=True)) if f.is_file and f.size and not f.base_name.startswith(("_", "."))]
        files = [LandedFile(p, _key_of(p)) for p in sorted(found)]
        return [f for f in files if all(_passes(x, f.key) for x in self.on_key)]

    def read(self, partition: LandedFile | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no file: Spark asks for one partition all the same
            return
        fs, _ = pyarrow.fs.FileSystem.from_uri(self.root)
        wanted = to_arrow_schema(self.schema)
        own = pa.schema([f for f in wanted if f.name != "key"])
        options = pyarrow.json.ParseOptions(explicit_schema=own, unexpected_field_behavior="ignore")
        with fs.open_input_stream(partition.path) as f, pyarrow.json.open_json(f, pyarrow.json.ReadOptions(block_size=BLOCK, use_threads=False), options) as batches:
            for b in batches:
                for x in self.on_rows:
                    values = x.value if isinstance(x, In) else [x.value]
                    column = b.column(b.schema.get_field_index(x.attribute[0]))
                    b = b.filter(pc.is_in(column, pa.array([v for v in values if v is not None], column.type)))
                columns = {c: b.column(i) for i, c in enumerate(b.schema.names)} | {"key": pa.array([partition.key] * b.num_rows, pa.string())}
                yield pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in wanted], schema=wanted)


class Landed(DataSource):
    """A public source; ``path`` is its folder."""

    raw = ""

    def schema(self) -> str:
        return f"key STRING, {self.raw}"

    def reader(self, schema: StructType) -> LandedReader:
        return LandedReader(self.options["path"], schema)


class Mutations(Landed):
    raw = landing.MUTATION

    @classmethod
    def name(cls) -> str:
        return "attestor_cases"


class Evidence(Landed):
    raw = landing.EVIDENCE

    @classmethod
    def name(cls) -> str:
        return "attestor_evidence"


class Germline(Landed):
    raw = landing.CLINICAL

    @classmethod
    def name(cls) -> str:
        return "attestor_germline"


def _licensed(source: str) -> type[DataSource]:
    class Licensed(DataSource):
        """A licensed slot: it has a name, and no reader of its own yet."""

        @classmethod
        def name(cls) -> str:
            return f"attestor_{source}"

        def schema(self) -> str:
            fs, root = pyarrow.fs.FileSystem.from_uri(self.options.get("path") or "/nowhere")
            found = fs.get_file_info(root)
            if found.type == pyarrow.fs.FileType.NotFound or not fs.get_file_info(pyarrow.fs.FileSelector(root)):
                raise NotConfigured(f"{source}: no data under {root}")
            raise NotImplementedError(f"{source}: data found, but no reader is defined for them")

    return Licensed


FORMATS = {"cases": Mutations, "somatic_evidence": Evidence, "germline_records": Germline}
NORMAL = {"cases": landing.normalised_mutations, "somatic_evidence": landing.normalised_evidence, "germline_records": landing.normalised_clinical}


def register(spark: SparkSession) -> None:
    """Make all formats known to the session, and let it hand filters to them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in [*FORMATS.values(), *(_licensed(n) for n in LICENSED)]:
        spark.dataSource.register(source)


def land(raw: DataFrame, folder: str, key: Column) -> None:
    """Append raw answers to a source's folder under their key: a study for cases, a gene for evidence and germline records."""
    raw.withColumn("key", key).repartition("key").write.partitionBy("key").mode("append").json(folder)


def opened(spark: SparkSession, name: str, folder: str, keys: list[str] | None = None) -> DataFrame:
    """The normalised rows of a public source, with their ``key``; only the files of ``keys`` are read if they are given."""
    register(spark)
    raw = spark.read.format(FORMATS[name].name()).load(folder)
    if keys is not None:
        raw = raw.where(F.col("key").isin(keys))
    return NORMAL[name](raw, "key")


#: So many different genes of the queries are handed to the scan as a filter; with more, all files are read and joined.
FEW_KEYS = 1000


def retrieved_from(spark: SparkSession, name: str, folder: str, queries: DataFrame, k: int = 5) -> DataFrame:
    """The first ``k`` records of a landed source for each query (query_id, gene, variant, tumor), with their rank; see ``registry.retrieve``.

    A null variant asks for the gene's own profile in somatic evidence.
    """
    if name == "cases":
        raise TypeError("cases: a source of cases, not of evidence; read its records with opened")
    genes = [r.gene for r in queries.select("gene").where("gene is not null").distinct().limit(FEW_KEYS + 1).collect()]
    rows = opened(spark, name, folder, genes if len(genes) <= FEW_KEYS else None)
    if name == "somatic_evidence":
        return retrieved(rows, queries.select("query_id", F.concat_ws(" ", "gene", "variant").alias("profile"), "tumor"), k)
    return searched(rows, queries.select("query_id", "gene", "variant"), k)
