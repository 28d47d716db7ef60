"""Exact block joins against numpy; the clustered index holds every vector and reaches its recall."""

import numpy as np
import pytest

from attestor.operators import vectors

SCHEMA = "vec_id long, embedding array<float>"


def rows(matrix, first=0):
    return [(first + i, [float(x) for x in v]) for i, v in enumerate(matrix)]


def by_hand(own, asked, k):
    out = {}
    for q, a in asked:
        a = np.float32(a).astype(float)
        found = []
        for i, v in own:
            v = np.float32(v).astype(float) if v is not None and len(v) == len(a) and None not in v else np.zeros(len(a))
            norm = np.linalg.norm(a) * np.linalg.norm(v)
            if norm > 0 and np.isfinite(norm):
                found.append((i, a @ v / norm))
        out[q] = sorted(found, key=lambda x: (-round(x[1], 6), x[0]))[:k]
    return out


def got(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.doc_id, pytest.approx(r.score, abs=1e-9)))
    return out


def clustered(rng, n, d=16, kinds=12):
    centres = rng.normal(size=(kinds, d))
    return centres[rng.integers(0, kinds, n)] + 0.4 * rng.normal(size=(n, d))


@pytest.mark.parametrize("tile", [64 << 20, 3000])
def test_blocks_give_what_all_pairs_give(spark, tile, monkeypatch):
    rng = np.random.default_rng(1)
    own = rows(clustered(rng, 200)) + rows(np.tile(rng.normal(size=16), (60, 1)), 500)  # copies: ties
    own += [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] + [1.0] * 15), (904, [None] + [1.0] * 15), (905, [1.0] * 3)]
    monkeypatch.setattr(vectors, "TILE", tile)
    monkeypatch.setattr(vectors, "SCORES", 700)
    df = spark.createDataFrame(own, SCHEMA).repartition(3)
    asked = [*own[:40:4], own[210], (905, [1.0] * 3)]
    q = spark.createDataFrame([*asked, (1000, None), (1001, [0.0] * 16)], SCHEMA).withColumnRenamed("vec_id", "query_id")
    want = {q: f for q, f in by_hand(own, asked, 7).items() if f}
    assert got(vectors.exact(df, q, 7)) == want
    assert got(vectors.exact(df, q, 400)) == {q: f for q, f in by_hand(own, asked, 400).items() if f}


def test_nothing_to_compare(spark):
    none = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame([(1, [1.0, 0.0])], SCHEMA)
    ask = lambda df: df.withColumnRenamed("vec_id", "query_id")
    assert vectors.exact(none, ask(some)).collect() == vectors.exact(some, ask(none)).collect() == []
    assert vectors.build(none).search(ask(some)).collect() == []
    assert [r.doc_id for r in vectors.build(some).search(ask(some)).collect()] == [1]


def test_an_index_holds_every_vector_and_reaches_its_recall(spark, monkeypatch):
    monkeypatch.setattr(vectors, "PART", 100)
    rng = np.random.default_rng(2)
    own = rows(clustered(rng, 3000, kinds=40)) + rows(np.tile(rng.normal(size=16), (900, 1)), 5000)  # a list that is split
    df = spark.createDataFrame(own + [(9000, None)], SCHEMA).repartition(4)
    index = vectors.build(df, sample=1500)
    assert index.lists().count() == len(own) == index.sizes().agg({"n": "sum"}).first()[0]
    assert index.lists().select("doc_id").distinct().count() == len(own)
    assert 1 <= index.probes < len(index.centres)
    q = df.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    wanted = vectors.exact(df, q, 10)
    assert vectors.recall(index.search(q, 10), wanted) >= 0.9
    every = index.search(q, 10, probes=len(index.centres))
    assert got(every) == got(wanted)


def test_recall_holds_without_clusters(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame(rows(rng.normal(size=(1200, 24))), SCHEMA)
    q = df.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    index = vectors.build(df)
    assert vectors.recall(index.search(q, 10), vectors.exact(df, q, 10)) >= 0.9
