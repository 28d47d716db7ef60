"""Retrieval: corpus statistics, BM25, dense cosine, reciprocal rank fusion, generated queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestor.functions.text import token_set, tokenize


def top_k(df: DataFrame, query: str, order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each query in ``order``, with their rank from 1."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(query).orderBy(*order))).where(F.col("rank") <= k)


def corpus_size(docs: DataFrame, text: str) -> DataFrame:
    """One row (n, avgdl)."""
    return docs.agg(F.count("*").alias("n"), F.avg(F.size(tokenize(text))).alias("avgdl"))


def idf(n: Column, df: Column) -> Column:
    return F.greatest(F.lit(1e-9), F.log(1 + (n - df + 0.5) / (df + 0.5)))


def bm25(docs: DataFrame, queries: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text", query_id: str = "query_id", query_text: str = "text", k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_id, doc_id, score, rank) over an index that is written for this search; see ``index.build`` and ``TextIndex.search``."""
    from attestor.operators.index import build

    return build(docs, None, doc_id, text, k1, b).search(queries, k, query_id, query_text)


def token_matches(left: DataFrame, left_text: str, right: DataFrame, right_text: str) -> DataFrame:
    """Pairs of rows that share a token (over two characters, in any case), by an equi-join on tokens; columns of both sides."""
    a = left.select("*", F.explode(token_set(F.col(left_text))).alias("_token"))
    b = right.select("*", F.explode(token_set(F.col(right_text))).alias("_token"))
    return a.join(b, "_token").drop("_token").distinct()


def dense(vectors: DataFrame, queries: DataFrame, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding", query_id: str = "query_id") -> DataFrame:
    """(query_id, doc_id, score, rank) by cosine, every query against all vectors; see ``vectors.exact``, and ``vectors.build`` for an index."""
    from attestor.operators.vectors import exact

    return exact(vectors, queries, k, vec_id, embedding, query_id)


def fuse(arms: list[DataFrame], k: int = 10, rrf_k: int = 60) -> DataFrame:
    """(query_id, doc_id, score, rank): sum of 1 / (rrf_k + rank from 0) over the arms; ties by first arm, then its rank."""
    all_arms = None
    for i, arm in enumerate(arms):
        part = arm.select("query_id", "doc_id", (1.0 / (rrf_k + F.col("rank") - 1)).alias("part"), (F.lit(i) * 1_000_000 + F.col("rank")).alias("seen"))
        all_arms = part if all_arms is None else all_arms.unionAll(part)
    fused = all_arms.groupBy("query_id", "doc_id").agg(F.sum("part").alias("score"), F.min("seen").alias("seen"))
    return top_k(fused, "query_id", [F.round("score", 9).desc(), F.col("seen")], k).drop("seen")


def hybrid_depth(k: int) -> int:
    return max(4 * k, 20)


def lookup_queries(cases: DataFrame, gene: str = "gene", tumor: str = "tumor") -> DataFrame:
    """Query text "gene tumour" for each row."""
    return cases.withColumn("text", F.concat_ws(" ", gene, tumor))
