"""Nearest vectors by cosine: an exact join of blocks, and a clustered index with exact scores over the lists that are probed."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.operators.retrieval import top_k
from attestor.session import shared_folder, stored

#: Bytes of a block of vectors or queries as doubles; scores held at a time.
TILE, SCORES = 64 << 20, 4 << 20

#: Vectors of a list that one task compares; a longer list is split, and its queries meet every part.
PART = 50_000

FOUND = "query_id long, doc_id long, score double"


def _rows(column: pa.ChunkedArray, length: int) -> np.ndarray:
    """A column of lists as a matrix of ``length`` columns; null entries are NaN."""
    c = column.combine_chunks()
    return c.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(c), length)


def _by_length(table: pa.Table, ids: str, vectors: str) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """{length: (ids, vectors of length 1)}; those of no length, or with entries that are null or not finite, are left out."""
    lengths = pc.fill_null(pc.list_value_length(table.column(vectors)), 0).to_numpy()
    out = {}
    for n in np.unique(lengths[lengths > 0]):
        own = table.filter(pa.array(lengths == n))
        v = _rows(own.column(vectors), int(n))
        norm = np.sqrt((v * v).sum(axis=1))
        fine = np.isfinite(norm) & (norm > 0)
        out[int(n)] = own.column(ids).to_numpy()[fine], v[fine] / norm[fine, None]
    return out


def best(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query ids, ids, scores) of the ``k`` best rows of ``v`` for each row of ``q``; ties in six places go to the smaller id."""
    out = []
    step = max(1, SCORES // max(1, len(ids)))
    for lo in range(0, len(q_ids), step):
        score = q[lo : lo + step] @ v.T
        rounded = np.round(score, 6)
        if len(ids) > k:
            at, to = np.nonzero(rounded >= np.partition(rounded, -k, axis=1)[:, -k, None])
        else:
            at, to = (x.ravel() for x in np.indices(score.shape))
        order = np.lexsort((ids[to], -rounded[at, to], at))
        at, to = at[order], to[order]
        first = np.searchsorted(at, at)
        keep = np.arange(len(at)) - first < k
        out.append((q_ids[lo + at[keep]], ids[to[keep]], score[at[keep], to[keep]]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _compared(k: int):
    """A function over a block of vectors (doc_id, v) and one of queries (query_id, q) that gives the best of the block."""

    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        own, parts = _by_length(vectors, "doc_id", "v"), []
        for n, (q_ids, q) in _by_length(queries, "query_id", "q").items():
            if n in own:
                parts.append(best(q_ids, q, *own[n], k))
        found = [np.concatenate(x) for x in zip(*parts, strict=True)] or [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"query_id": found[0], "doc_id": found[1], "score": found[2]})

    return run


def _asked(queries: DataFrame, query_id: str, embedding: str) -> DataFrame:
    return queries.where(F.col(embedding).isNotNull() & F.col(query_id).isNotNull()).select(F.col(query_id).cast("long").alias("query_id"), F.col(embedding).cast("array<double>").alias("q"))


def _own(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    return vectors.where(F.col(embedding).isNotNull() & F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("doc_id"), F.col(embedding).cast("array<double>").alias("v"))


def _first(found: DataFrame, k: int) -> DataFrame:
    return top_k(found, "query_id", [F.round("score", 6).desc(), F.col("doc_id")], k)


def exact(vectors: DataFrame, queries: DataFrame, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding", query_id: str = "query_id") -> DataFrame:
    """(query_id, doc_id, score, rank) by cosine: the stated queries against all vectors, block by block.

    Vectors and queries are dealt out to blocks that fit ``TILE``, by their place and not by their value, so that equal ones are parted; each
    block of vectors meets each block of queries in one task, which gives the best ``k`` of each query. Vectors or queries that are null, of length 0 or with
    entries that are null or not finite have no score, and vectors of another length than the query's have none for it.
    """
    own, asked = _own(vectors, vec_id, embedding), _asked(queries, query_id, embedding)
    blocks = []
    for df, c in ((own, "v"), (asked, "q")):
        size = df.agg(F.sum(F.size(c) * 8).alias("bytes")).first().bytes or 0
        blocks.append(max(1, -(-size // TILE)))
    place = lambda n: F.pmod(F.monotonically_increasing_id(), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = own.withColumn("row", place(blocks[0])).withColumn("col", every(blocks[1]))
    right = asked.withColumn("col", place(blocks[1])).withColumn("row", every(blocks[0]))
    return _first(left.groupBy("row", "col").cogroup(right.groupBy("row", "col")).applyInArrow(_compared(k), FOUND), k)


def centroids(sample: np.ndarray, n: int, seed: int = 17, rounds: int = 12) -> np.ndarray:
    """``n`` directions at most: spherical k-means over the rows of ``sample`` (of length 1); empty clusters go."""
    rng = np.random.default_rng(seed)
    own = np.unique(sample, axis=0)
    at = own[rng.permutation(len(own))[:n]]
    for _ in range(rounds):
        near = (sample @ at.T).argmax(axis=1)
        sums = np.zeros_like(at)
        np.add.at(sums, near, sample)
        norm = np.sqrt((sums * sums).sum(axis=1))
        at = sums[norm > 0] / norm[norm > 0, None]
    return at


def probes_needed(sample: np.ndarray, centres: np.ndarray, k: int, recall: float, seed: int = 17, queries: int = 400) -> int:
    """The fewest nearest lists that hold ``recall`` of the ``k`` nearest others of the sample's rows, measured on ``queries`` of them."""
    rng = np.random.default_rng(seed)
    asked = rng.permutation(len(sample))[:queries]
    score = sample[asked] @ sample.T
    score[np.arange(len(asked)), asked] = -np.inf
    m = min(k, len(sample) - 1)
    if m < 1:
        return len(centres)
    nearest = np.argpartition(-score, m - 1, axis=1)[:, :m]
    order = np.argsort(-(sample[asked] @ centres.T), axis=1)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(centres))[None, :].repeat(len(asked), 0), axis=1)
    lists = (sample @ centres.T).argmax(axis=1)
    at = np.take_along_axis(place, lists[nearest], axis=1).ravel()
    return int(np.sort(at)[min(len(at) - 1, int(np.ceil(recall * len(at))) - 1)]) + 1


@dataclass(frozen=True, eq=False)
class VectorIndex:
    """``lists`` (list, doc_id, v) in ``path`` holds every vector that has a direction; ``sizes`` the rows of each list; ``probes`` lists are looked into."""

    spark: SparkSession
    path: str
    centres: np.ndarray
    probes: int

    def lists(self) -> DataFrame:
        return self.spark.read.schema("doc_id long, v array<double>, list int").parquet(f"{self.path}/lists")

    def sizes(self) -> DataFrame:
        return self.spark.read.schema("list int, n long").parquet(f"{self.path}/sizes")

    def search(self, queries: DataFrame, k: int = 10, probes: int | None = None, query_id: str = "query_id", embedding: str = "embedding") -> DataFrame:
        """(query_id, doc_id, score, rank): the best ``k`` by exact cosine among the vectors of each query's ``probes`` nearest lists."""
        near = _nearest_lists(self.spark, self.centres, probes or self.probes)
        asked = _asked(queries, query_id, embedding).mapInArrow(near("q"), "query_id long, q array<double>, list int")
        parts = F.broadcast(self.sizes().select("list", F.ceil(F.col("n") / PART).cast("int").alias("parts")))  # a row for each list
        left = self.lists().join(parts, "list").withColumn("part", F.pmod(F.monotonically_increasing_id(), F.col("parts")).cast("int")).select("list", "part", "doc_id", "v")
        right = asked.join(parts, "list").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(F.col("list").alias("in_list"), F.col("part").alias("in_part"), "query_id", "q")
        return _first(left.groupBy("list", "part").cogroup(right.groupBy("in_list", "in_part")).applyInArrow(_compared(k), FOUND), k)


def _nearest_lists(spark: SparkSession, centres: np.ndarray, n: int):
    """For a column of vectors, a function over batches (id, vector) that gives each usable row with its ``n`` nearest lists, a row each."""
    shared = spark.sparkContext.broadcast(centres)

    def of(column: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at = shared.value
            for b in batches:
                for lo in range(0, b.num_rows, 2048):
                    part = pa.Table.from_batches([b.slice(lo, 2048)]).append_column("_row", pa.array(np.arange(min(2048, b.num_rows - lo))))
                    rows, v = _by_length(part, "_row", column).get(at.shape[1], (np.zeros(0, np.int64), np.zeros((0, at.shape[1]))))
                    m = min(n, len(at))
                    lists = np.argsort(-(v @ at.T), axis=1, kind="stable")[:, :m] if m > 1 else (v @ at.T).argmax(axis=1)[:, None] if len(at) else np.zeros((len(rows), 0), int)
                    out = part.drop(["_row"]).take(pa.array(np.repeat(rows, m))).append_column("list", pa.array(lists.ravel().astype(np.int32)))
                    yield from out.combine_chunks().to_batches()

        return run

    return of


def build(vectors: DataFrame, path: str | None = None, lists: int | None = None, sample: int = 20_000, k: int = 10, recall: float = 0.97, vec_id: str = "vec_id", embedding: str = "embedding") -> VectorIndex:
    """Write the index of ``vectors`` in ``path`` (a new shared folder if None).

    Centres are fitted on at most ``sample`` vectors (first in the order of a hash of their ids), of the sample's most frequent length; ``lists`` centres, by
    default twice the root of the number of rows, 4096 at most. Every vector of that length is put in the list of its nearest centre. The number
    of lists to probe is measured on the sample, for ``recall`` of the ``k`` nearest.
    """
    spark = vectors.sparkSession
    path = path or shared_folder(spark)
    own = _own(vectors, vec_id, embedding)
    total = own.count()
    rows = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).toArrow()
    kinds = _by_length(rows, "doc_id", "v")
    n, (_, drawn) = max(kinds.items(), key=lambda x: (len(x[1][0]), x[0]), default=(0, (None, np.zeros((0, 1)))))
    centres = centroids(drawn, lists or min(4096, max(1, int(2 * np.sqrt(total))))) if len(drawn) else np.zeros((0, max(n, 1)))
    held = own.mapInArrow(_nearest_lists(spark, centres, 1)("v"), "doc_id long, v array<double>, list int")
    # a list's rows are spread over tasks while it is written, and sorted into few row groups
    held.repartition("list", F.pmod(F.xxhash64("doc_id"), F.lit(8))).sortWithinPartitions("list").write.parquet(f"{path}/lists")
    index = VectorIndex(spark, path, centres, min(len(centres), probes_needed(drawn, centres, k, recall)) if len(centres) else 0)
    index.lists().groupBy("list").agg(F.count("*").alias("n")).write.parquet(f"{path}/sizes")
    return index


def recall(found: DataFrame, wanted: DataFrame, k: int = 10) -> float:
    """The share of the exact first ``k`` (wanted: query_id, doc_id, score, rank) whose score an index's results reach: equal scores count."""
    least = wanted.where(F.col("rank") <= k).groupBy("query_id").agg(F.round(F.min("score"), 6).alias("least"), F.count("*").alias("n"))
    hits = least.join(found.where(F.col("rank") <= k), "query_id", "left").groupBy("query_id", "n").agg(F.count_if(F.round("score", 6) >= F.col("least")).alias("hit"))
    r = stored(hits).agg(F.sum("hit").alias("hit"), F.sum("n").alias("n")).first()
    return r.hit / r.n if r.n else 1.0
