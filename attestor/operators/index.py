"""A stored inverted index and exact BM25 search over it.

``postings`` has a row for each term and block of documents (documents and their impacts, their number, the largest impact), ``terms`` each term's document
frequency and largest impact, ``corpus`` one row. A document's impact for a term is its BM25 part without the
idf, so a query's score of a document is the sum of weight times impact over the query's terms.

Texts are dealt to blocks once, and a block's postings are made where its texts are. A search deals the postings of its terms to their blocks once and scores a block's
documents there, so only the first ``k`` of a block are shuffled for a query, not its pairs of query and document.

Search is exact. The champions of some blocks give each query a score that its k-th document reaches at least (the floor). Terms whose largest parts together stay under the floor are weak: a document that
has only such terms can't be among the first k, so they bring no candidates, and a block without candidates doesn't add them up.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from attestor.functions.text import tokenize
from attestor.operators.retrieval import corpus_size, idf, top_k
from attestor.session import shared_folder, stored

#: Documents and words of a block, documents of largest impact that give a term's part of the floor, and the blocks that they are taken from.
BLOCK, BLOCK_WORDS, CHAMPIONS, HEADS = 4096, 2_000_000, 64, 16

#: Blocks that one task holds at most, one after the other.
TASK_BLOCKS = 8

#: Query terms that one task meets at a time: up to so many rows are sent to every task, more are dealt out to parts by query, and each block meets every part.
SMALL_PLAN = 200_000

#: Scores are compared by their first six places, so what is this much under the floor can't tie with it.
MARGIN = 2e-6


def _numbered(ids: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(the number of each id, the distinct ids in ascending order)"""
    own = ids.dictionary_encode(null_encoding="encode")
    order = pc.sort_indices(own.dictionary).to_numpy()
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    return place[own.indices.to_numpy()].astype(np.int64), own.dictionary.take(pa.array(order))


def _first_of(score: np.ndarray, docs: np.ndarray, k: int) -> np.ndarray:
    """``docs`` (ascending) that can be among the first ``k``: whatever rounding to six places may put there, and of equal scores the first ``k``."""
    own = score[docs]
    docs = docs[own >= np.partition(own, -k)[-k] - MARGIN]
    docs = docs[np.argsort(-score[docs], kind="stable")]
    value = -score[docs]
    return docs[np.arange(len(docs)) - np.searchsorted(value, value) < k]


def _scored(postings: pa.Table, asked: pa.Table, k: int | None) -> pa.Table:
    """(query_id, doc_id, score) of the documents of one block that reach a query's floor, the first ``k`` of each query (and ties) if it is stated.

    postings (term, docs, impacts), a row for each term; asked (query_id, term, w, weak, weak_total, floor).
    """
    lists = postings.column("docs").combine_chunks()
    docs, ids = _numbered(lists.flatten())
    impacts = postings.column("impacts").combine_chunks().flatten().to_numpy()
    end = np.cumsum(pc.list_value_length(lists).to_numpy())
    begin = np.concatenate([[0], end[:-1]])
    at = pc.fill_null(pc.index_in(asked.column("term"), postings.column("term").combine_chunks()), -1).to_numpy()
    asked, at = asked.filter(pa.array(at >= 0)), at[at >= 0]
    query, names = _numbered(asked.column("query_id").combine_chunks())
    weight, weak, weak_total, floor = (asked.column(c).to_numpy() for c in ("w", "weak", "weak_total", "floor"))
    order = np.lexsort((at, weak, query))  # a query's terms that aren't weak come first
    query, at, weight, weak, weak_total, floor = (x[order] for x in (query, at, weight, weak, weak_total, floor))
    start, stop = begin[at], end[at]
    found, scores, sizes, last = [], [], [], np.append(np.flatnonzero(np.diff(query, prepend=-1)), len(query))
    for lo, hi in zip(last, last[1:], strict=False):
        strong, score, kept = hi - int(np.count_nonzero(weak[lo:hi])), np.zeros(len(ids)), np.zeros(0, np.int64)
        for r in range(lo, strong):
            score[docs[start[r] : stop[r]]] += weight[r] * impacts[start[r] : stop[r]]
        near = np.flatnonzero((score > 0) & (score + weak_total[lo] >= floor[lo]))
        if len(near):
            for r in range(strong, hi):
                score[docs[start[r] : stop[r]]] += weight[r] * impacts[start[r] : stop[r]]
            kept = near[score[near] >= floor[lo]]
            if k is not None and len(kept) > k:
                kept = _first_of(score, kept, k)
        found.append(kept)
        scores.append(score[kept])
        sizes.append(len(kept))
    none = [np.zeros(0, np.int64)]
    return pa.table({"query_id": names.take(pa.array(np.repeat(np.arange(len(sizes)), sizes))), "doc_id": ids.take(pa.array(np.concatenate(found or none))), "score": np.concatenate(scores or [np.zeros(0)])})


@dataclass(frozen=True, eq=False)
class TextIndex:
    """An index of ``blocks`` blocks in ``path``; tables are read as they are needed."""

    spark: SparkSession
    path: str
    schemas: dict[str, StructType]  # an empty table has no file to read them from
    blocks: int

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.schemas[name]).parquet(f"{self.path}/{name}")

    def plan(self, queries: DataFrame, k: int, query_id: str = "query_id", query_text: str = "text") -> DataFrame:
        """(query_id, term, w, ub, others, weak, weak_total, floor) of each known term of each query.

        ``w``: weight; ``ub``: the largest part that the term can add; ``others``: that of the query's other terms together.
        """
        asked = queries.select(F.col(query_id).alias("query_id"), F.explode(tokenize(query_text)).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qn"))
        weighed = asked.join(self.table("terms"), "term").crossJoin(F.broadcast(self.table("corpus")))  # one row
        weighed = stored(weighed.select("query_id", "term", (F.col("qn") * idf(F.col("n"), F.col("df"))).alias("w"), "largest"))
        first = F.slice(F.reverse(F.sort_array(F.arrays_zip(F.col("impacts").alias("impact"), F.col("docs").alias("doc_id")))), 1, CHAMPIONS)
        champions = self._postings(weighed).where(F.col("block") < HEADS).select("term", F.explode(first).alias("c")).select("term", "c.impact", "c.doc_id")
        champions = top_k(champions, "term", [F.col("impact").desc(), F.col("doc_id")], CHAMPIONS)
        heads = weighed.select("query_id", "term", "w").join(champions, "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("w") * F.col("impact")).alias("score"))
        reached = top_k(heads, "query_id", [F.col("score").desc()], k).where(F.col("rank") == k).select("query_id", (F.col("score") - MARGIN).alias("floor"))
        ub = F.col("w") * F.col("largest")
        rising = W.partitionBy("query_id").orderBy("ub", "term")
        out = weighed.select("query_id", "term", "w", ub.alias("ub")).join(reached, "query_id", "left").fillna({"floor": 0.0})
        out = out.withColumn("weak", F.sum("ub").over(rising.rowsBetween(W.unboundedPreceding, 0)) < F.col("floor"))
        whole = W.partitionBy("query_id")
        return stored(out.select("query_id", "term", "w", "ub", (F.sum("ub").over(whole) - F.col("ub")).alias("others"), "weak", F.coalesce(F.sum(F.when(F.col("weak"), F.col("ub"))).over(whole), F.lit(0.0)).alias("weak_total"), "floor"))

    def _postings(self, wanted: DataFrame) -> DataFrame:
        """The postings of ``wanted``'s terms."""
        terms = wanted.select("term").distinct()
        terms = F.broadcast(terms) if wanted.count() <= SMALL_PLAN else terms
        return self.table("postings").join(terms, "term", "left_semi")

    def candidates(self, plan: DataFrame, k: int | None = None) -> DataFrame:
        """(query_id, doc_id, score): documents that reach a query's floor, with ``k`` those that can be among its first ``k``, block by block."""
        met = self._postings(plan).select("block", "term", "docs", "impacts")
        asked, n = plan.select("query_id", "term", "w", "weak", "weak_total", "floor"), plan.count()
        schema = StructType([plan.schema["query_id"], StructField("doc_id", met.schema["docs"].dataType.elementType), StructField("score", DoubleType())])
        tasks = _tasks(self.spark, self.blocks)
        if n <= SMALL_PLAN:
            shared = self.spark.sparkContext.broadcast(asked.toArrow())  # SMALL_PLAN rows at most
            return met.repartition(tasks, "block").groupBy("block").applyInArrow(lambda postings: _scored(postings, shared.value, k), schema)
        parts = -(-n // max(1, SMALL_PLAN))
        left = met.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        right = asked.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(self.blocks - 1))))
        return left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(lambda postings, own: _scored(postings, own, k), schema)

    def search(self, queries: DataFrame, k: int = 10, query_id: str = "query_id", query_text: str = "text") -> DataFrame:
        """(query_id, doc_id, score, rank): the first ``k`` documents with a score over 0; ties in the score rounded to six places go to the smaller doc_id.

        A term counts as often as the query repeats it. Queries that are null, empty or hold unknown words only have no row.
        """
        found = self.candidates(self.plan(queries, k, query_id, query_text), k)
        return top_k(found, "query_id", [F.round("score", 6).desc(), F.col("doc_id")], k)


def _tasks(spark: SparkSession, blocks: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-blocks // TASK_BLOCKS))


def _lists(k1: float, b: float, avgdl: float):
    """A function over the rows of a block (block, doc_id, words: terms with spaces between) that gives its postings."""

    def run(rows: pa.Table) -> pa.Table:
        docs, ids = _numbered(rows.column("doc_id").combine_chunks())
        words = pc.split_pattern(rows.column("words").combine_chunks(), " ")
        dl = pc.list_value_length(words).to_numpy().astype(np.int64)
        flat = words.flatten().dictionary_encode()
        wide = int(dl.max()) + 1
        own, row = np.unique(docs * wide + dl, return_inverse=True)  # a document's rows of equal length count together
        pair, tf = np.unique(flat.indices.to_numpy().astype(np.int64) * len(own) + np.repeat(row, dl), return_counts=True)
        term, row = np.divmod(pair, len(own))
        doc, dl = np.divmod(own[row], wide)
        first = np.flatnonzero(np.diff(term * len(ids) + doc, prepend=-1))
        impact = np.add.reduceat(tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl)), first)
        term, doc = term[first], doc[first]
        begin = np.flatnonzero(np.diff(term, prepend=-1))
        offsets = pa.array(np.append(begin, len(term)).astype(np.int32))
        return pa.table({
            "term": flat.dictionary.take(pa.array(term[begin])), "block": pa.array(np.full(len(begin), rows.column("block")[0].as_py(), np.int32)),
            "docs": pa.ListArray.from_arrays(offsets, ids.take(pa.array(doc))), "impacts": pa.ListArray.from_arrays(offsets, pa.array(impact)),
            "n": np.diff(offsets.to_numpy()).astype(np.int64), "largest": np.maximum.reduceat(impact, begin),
        })

    return run


def build(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text", k1: float = 1.5, b: float = 0.75, block: int = BLOCK) -> TextIndex:
    """Write the index of ``docs`` in ``path`` (a new shared folder if None). Each doc_id is one document; its rows' terms of equal length count together.

    A block has about ``block`` documents and ``BLOCK_WORDS`` words at most; postings of a common term are as many rows as there are blocks. Null texts count as documents without terms.
    """
    spark = docs.sparkSession
    path = path or shared_folder(spark)
    corpus = corpus_size(docs, text)
    corpus.write.parquet(f"{path}/corpus")
    size = spark.read.parquet(f"{path}/corpus").first()
    blocks = max(1, -(-size.n // block), int(size.n * (size.avgdl or 0.0)) // BLOCK_WORDS)
    dealt = docs.select(F.pmod(F.xxhash64(doc_id), F.lit(blocks)).cast("int").alias("block"), F.col(doc_id).alias("doc_id"), F.array_join(tokenize(text), " ").alias("words")).where("words <> ''")
    lists = StructType([StructField("term", StringType()), StructField("block", IntegerType()), StructField("docs", ArrayType(dealt.schema["doc_id"].dataType)), StructField("impacts", ArrayType(DoubleType())), StructField("n", LongType()), StructField("largest", DoubleType())])
    made = dealt.repartition(_tasks(spark, blocks), "block").groupBy("block").applyInArrow(_lists(k1, b, size.avgdl or 1.0), lists)
    made.sortWithinPartitions("term", "block").write.parquet(f"{path}/postings")
    terms = spark.read.schema(lists).parquet(f"{path}/postings").groupBy("term").agg(F.sum("n").alias("df"), F.max("largest").alias("largest"))
    terms.write.parquet(f"{path}/terms")
    return TextIndex(spark, path, {"corpus": corpus.schema, "postings": lists, "terms": terms.schema}, blocks)


_KNOWN: dict[tuple, TextIndex] = {}


def of_files(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> TextIndex:
    """The index of a table read from files, written once for each application and set of files (by name, length and time)."""
    spark = docs.sparkSession
    files = docs.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    mark = files.agg(F.count("*"), F.sum(F.xxhash64("file_path", "file_size", "file_modification_time").cast("decimal(38,0)"))).first()
    key = (spark.sparkContext.applicationId, doc_id, text, *mark)
    if key not in _KNOWN:
        _KNOWN[key] = build(docs, None, doc_id, text)
    return _KNOWN[key]
