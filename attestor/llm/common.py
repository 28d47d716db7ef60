"""Shared pieces of the training-data operators: working folder, written intermediates, components."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def work_dir(spark: SparkSession) -> str:
    """The shared folder for intermediates: ``spark.checkpoint.dir``, or a temporary one where that is unset (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="attestor-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def written(df: DataFrame, partition_by: str | None = None, compression: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: later plans start from files, not from lineage."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/attestor-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)  # an empty table partitioned by a column has no file to infer from
    out._attestor_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a written intermediate that no later plan reads."""
    path = getattr(df, "_attestor_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def input_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of ``df``'s source (file sizes for scans); no job runs."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front as long as ``df`` has such a column (whatever its case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def connected_components(links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Components of an undirected graph by alternating large-star and small-star rounds.

    ``links`` has columns (a, b), any comparable type, self-links and repeats allowed. Returns (node, root) for every
    node of a link, root being the smallest node of its component. Each round is two grouped minima and two joins,
    so no node's neighbours are gathered in one place; rounds are written, and the superseded one is deleted. Rounds are
    about the logarithm of the longest path; not done after ``max_rounds`` it raises.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    state = mark(edges)
    for _ in range(max_rounds):
        if not state[0]:
            break
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        large = written(large)
        # small star: a's smaller neighbours and a itself point to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionAll(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        new = written(small)
        discard(large)
        discard(edges)
        edges, before = new, state
        state = mark(edges)
        if state == before:
            break
    else:
        raise RuntimeError(f"components aren't settled after {max_rounds} rounds")
    roots = edges.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()
