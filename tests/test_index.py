"""The stored index against scores of every document by hand, and that it leaves out what it may."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from attestor.operators import index, retrieval


def scores(docs, query, k1=1.5, b=0.75):
    """{doc_id: score} of every document."""
    words = {i: (t or "").lower().split() for i, t in docs}
    n, lengths = len(docs), [len((t or "").split()) for _, t in docs]
    avg = sum(lengths) / len(lengths)
    df = Counter(w for own in words.values() for w in set(own))
    out = Counter()
    for w, q in Counter((query or "").lower().split()).items():
        for i, own in words.items():
            tf = own.count(w)
            if tf:
                idf = max(1e-9, math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)))
                out[i] += q * idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(own) / avg))
    return out


def first(docs, query, k):
    return sorted(scores(docs, query).items(), key=lambda x: (-round(x[1], 6), x[0]))[:k]


def common_words(rng, n):
    """Documents of which most hold a few common words, and few hold rare ones."""
    out = []
    for i in range(n):
        words = [w for w in ("the", "of", "and") if rng.random() < 0.9] * rng.randint(1, 3) + [f"w{int(rng.paretovariate(0.7))}" for _ in range(rng.randint(0, 15))]
        rng.shuffle(words)
        out.append((i, " ".join(words)))
    return [*out, (n, None), (n + 1, "")]


@pytest.fixture(scope="module")
def searched(spark):
    rng = random.Random(11)
    docs = common_words(rng, 400)
    asked = [(q, " ".join(rng.choice(["the", "of", "and", "w1", "w2", "w3", "w9", "w20", f"w{int(rng.paretovariate(0.5))}", "unknown"]) for _ in range(rng.randint(1, 6)))) for q in range(60)]
    asked += [(100, None), (101, ""), (102, "the the of and"), (103, "unknown words")]
    built = index.build(spark.createDataFrame(docs, "doc_id int, text string").repartition(3), block=32)
    return docs, asked, spark.createDataFrame(asked, "query_id int, text string"), built


@pytest.mark.parametrize("k", [1, 7, 90])
def test_search_is_exact(searched, k):
    docs, asked, queries, built = searched
    got = {}
    for r in sorted(built.search(queries, k).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append((r.doc_id, r.score))
    for q, text in asked:
        want = first(docs, text, k)
        assert [i for i, _ in got.get(q, [])] == [i for i, _ in want], text
        assert [s for _, s in got.get(q, [])] == pytest.approx([s for _, s in want])


def test_shuffled_plans_give_the_same(searched, monkeypatch):
    _, _, queries, built = searched
    want = sorted(map(tuple, built.search(queries, 5).select("query_id", "doc_id", "rank").collect()))
    monkeypatch.setattr(index, "SMALL_PLAN", -1)
    assert sorted(map(tuple, built.search(queries, 5).select("query_id", "doc_id", "rank").collect())) == want


def test_documents_with_common_words_only_are_no_candidates(spark, searched):
    docs, _, _, built = searched
    rare = Counter(w for _, t in docs for w in set((t or "").split()))
    word = min(w for w, n in rare.items() if 15 <= n <= 40)
    query = f"the of and {word}"
    plan = built.plan(spark.createDataFrame([(1, query)], "query_id int, text string"), 5)
    assert {r.term for r in plan.where("weak").collect()} >= {"the", "of"}
    holders = sum(word in (t or "").split() for _, t in docs)
    assert len(scores(docs, query)) > 300
    assert built.candidates(plan).count() <= holders


def test_a_common_term_is_many_rows(searched):
    *_, built = searched
    rows = built.table("postings").where("term = 'the'").select(F.size("docs").alias("n")).collect()
    assert len(rows) > 8 and max(r.n for r in rows) < 80
    assert built.table("terms").where("term = 'the'").first().df == sum(r.n for r in rows)


def test_an_index_is_written_once_for_files(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.createDataFrame([(1, "alpha beta"), (2, "beta")], "doc_id int, text string").write.parquet(path)
    one = index.of_files(spark.read.parquet(path))
    assert index.of_files(spark.read.parquet(path)) is one
    spark.createDataFrame([(3, "alpha")], "doc_id int, text string").write.mode("append").parquet(path)
    assert index.of_files(spark.read.parquet(path)) is not one


def test_empty_corpora_and_string_ids(spark):
    none = spark.createDataFrame([], "doc_id string, text string")
    asked = spark.createDataFrame([(1, "alpha")], "query_id int, text string")
    assert retrieval.bm25(none, asked).collect() == []
    docs = spark.createDataFrame([("b", "alpha"), ("a", "alpha"), ("c", "beta")], "doc_id string, text string")
    assert [(r.doc_id, r["rank"]) for r in retrieval.bm25(docs, asked).orderBy("rank").collect()] == [("a", 1), ("b", 2)]
    assert retrieval.bm25(docs, asked.limit(0)).collect() == []


def test_a_block_gives_the_first_of_a_query_only(spark):
    docs = [(i, "alpha beta") for i in range(300)] + [(300 + i, f"alpha x{i}") for i in range(100)]
    asked = spark.createDataFrame([(1, "alpha beta"), (2, "alpha")], "query_id int, text string")
    built = index.build(spark.createDataFrame(docs, "doc_id int, text string").repartition(4), block=50)
    assert built.blocks == 8
    assert built.candidates(built.plan(asked, 5), 5).count() <= 2 * 5 * built.blocks
    got = built.search(asked, 5).orderBy("query_id", "rank").select("query_id", "doc_id").collect()
    assert [tuple(r) for r in got] == [(q, i) for q, text in ((1, "alpha beta"), (2, "alpha")) for i, _ in first(docs, text, 5)]


def test_rows_of_one_document_count_together(spark):
    docs = [("a", "x y"), ("a", "x z"), ("a", "x"), ("b", "x y"), (None, "y")]
    built = index.build(spark.createDataFrame(docs, "doc_id string, text string"))
    held = {r.term: dict(zip(r.docs, r.impacts, strict=True)) for r in built.table("postings").collect()}
    part = lambda tf, dl: tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (8 / 5)))
    assert held["x"] == pytest.approx({"a": part(2, 2) + part(1, 1), "b": part(1, 2)})
    assert held["y"] == pytest.approx({"a": part(1, 2), "b": part(1, 2), None: part(1, 1)})
