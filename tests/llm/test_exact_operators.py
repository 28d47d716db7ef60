"""Operators whose whole result is fixed by their contract, against brute force."""

import random

import numpy as np
import pytest

from attestor.llm import line_dedup, simhash, suffix_dedup
from tests.llm.helpers import WORDS, awkward, documents, prose


def corpus(seed):
    rng = random.Random(seed)
    common = [prose(rng, 12).replace("\n", " ") for _ in range(4)]
    rows = []
    for i in range(60):
        lines = [prose(rng, rng.randint(1, 25)) for _ in range(rng.randint(0, 4))]
        lines += [rng.choice((" {}\t", "{}", "{}\r")).format(c.upper() if rng.random() < 0.3 else c) for c in rng.sample(common, rng.randint(0, 3))]
        rng.shuffle(lines)
        rows.append((i * 7 % 61, "\n".join(lines)))
    rows[5] = (100, rows[9][1])
    rows[6] = (101, rows[9][1] + "x")
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup(spark, seed):
    rows = corpus(seed)
    got = line_dedup.digest(line_dedup.line_dedup(documents(spark, rows), n_batches=3)).collect()
    assert sorted(map(tuple, got)) == sorted(line_dedup.brute_force(rows))
    kept = line_dedup.without_common_lines(documents(spark, rows))
    assert kept.columns == documents(spark, rows).columns and kept.count() == len(rows)


def test_line_keys_need_forty_code_points(spark):
    rows = [(i, "é" * 39 + "\n" + "é" * 40) for i in range(5)]
    got = {r.doc_id: r.n_dropped for r in line_dedup.line_dedup(documents(spark, rows)).collect()}
    assert got == {0: 1, 1: 1, 2: 1, 3: 1, 4: 0}


def test_line_dedup_awkward_and_empty(spark):
    got = line_dedup.line_dedup(documents(spark, awkward())).collect()
    assert len(got) == len(awkward()) and sum(r.n_dropped for r in got) == 0
    assert {r.n_lines for r in got if r.doc_id in (1, 2)} == {1}
    assert line_dedup.line_dedup(documents(spark, [])).count() == 0
    assert line_dedup.without_common_lines(documents(spark, awkward())).where("doc_id = 1").first().text is None


def test_runs_level_up(spark):
    runs = line_dedup.LineRuns(fanout=2)
    for i in (3, 2, 1):
        runs.add(spark.createDataFrame([(i, 5, 5), (i, i, 0)], "doc_id long, h1 long, h2 long"))
    assert [len(x) for x in runs.levels] == [1, 1]
    assert {(r.h1, r.n_docs, r.holder) for r in runs.merged().collect()} == {(5, 3, 3), (3, 1, 3), (2, 1, 2), (1, 1, 1)}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_suffix_dedup(spark, seed):
    rng = random.Random(seed)
    base = [prose(rng, 60) for _ in range(6)]
    rows = []
    for i in range(40):
        b = rng.choice(base)
        at, n = rng.randint(0, 200), rng.randint(0, 160)
        rows.append((i * 11 % 41, prose(rng, rng.randint(0, 30)) + b[at : at + n] + prose(rng, rng.randint(0, 10))))
    rows += [(50, "ab" * 80), (51, "ab" * 90), (52, "é" * 60), (53, "é" * 50), (54, rows[3][1]), (55, "x" * 49), (56, "x" * 49), (57, None), (58, "")]
    got = suffix_dedup.digest(suffix_dedup.suffix_dedup(documents(spark, rows), chunk_bytes=4000, bucket_bytes=3000)).collect()
    assert sorted(map(tuple, got)) == sorted(suffix_dedup.brute_force(rows))


def test_suffix_dedup_awkward_and_empty(spark):
    got = suffix_dedup.suffix_dedup(documents(spark, awkward())).collect()
    assert len(got) == len(awkward()) and sum(r.n_removed for r in got) == 0
    assert suffix_dedup.suffix_dedup(documents(spark, [])).count() == 0


def brute_components(prints):
    fp = [p for _, p in prints]
    root = list(range(len(fp)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fp)):
        for j in range(i):
            if bin(fp[i] ^ fp[j]).count("1") <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(prints):
        least[find(i)] = min(d, least.get(find(i), d))
    return {d: least[find(i)] for i, (d, _) in enumerate(prints)}


def slow_fingerprint(text):
    import xxhash

    w = [x for x in text.translate({i: i + 32 for i in range(65, 91)}).replace("\t", " ").replace("\n", " ").split(" ") if x]
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h)) if h else 0


@pytest.mark.parametrize("large", [5000, 1])
def test_simhash(spark, large):
    rng = random.Random(4)
    base = [prose(rng, 150) for _ in range(12)]
    rows = []
    for i in range(80):
        w = rng.choice(base).split(" ")
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        rows.append((i * 13 % 81 + 3, " ".join(w)))
    rows += [(200, ""), (201, " \n"), (1, "one"), (202, "One"), (203, "two words"), (2, "TWO\twords")]
    got = simhash.digest(simhash.simhash_components(documents(spark, rows), large=large)).collect()
    prints = [(d, slow_fingerprint(t)) for d, t in rows]
    assert {r.doc_id: r.fingerprint for r in got} == {d: f"{p:016x}" for d, p in prints}
    assert {r.doc_id: r.component_id for r in got} == brute_components(prints)


def test_golay_keys_meet_for_every_two_bit_difference():
    rng = np.random.default_rng(1)
    for x in rng.integers(0, 1 << 63, 40, dtype=np.uint64):
        flips = [np.uint64(0)] + [np.uint64(1) << np.uint64(i) for i in range(64)]
        ys = np.array([x ^ a ^ b for n, a in enumerate(flips) for b in flips[n:]], dtype=np.uint64)
        own = set(simhash.golay_keys(np.array([x], dtype=np.uint64))[1].tolist())
        rows, keys = simhash.golay_keys(ys)
        assert set(rows[np.isin(keys, list(own))].tolist()) == set(range(len(ys)))


def test_simhash_awkward_and_empty(spark):
    rows = awkward()
    got = simhash.simhash_components(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    of = {r.doc_id: r.component_id for r in got}
    assert of[1] == of[2] == of[3] == 1 and of[6] == of[7] == 6
    kept = simhash.near_duplicates_dropped(documents(spark, rows))
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [-8, 1, 4, 4, 5, 6]
    assert simhash.simhash_components(documents(spark, [])).count() == 0


def test_similar_documents_are_found_and_others_left(spark):
    rng = random.Random(12)
    words = lambda n: [rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n)]
    rows, group = [], {}
    for g in range(30):
        w = words(rng.randint(150, 300))
        for c in range(4):
            v = list(w)
            for _ in range(c):  # each change spoils five shingles at most: Jaccard of 0.8 or more
                v[rng.randrange(len(v))] = "changed" + str(rng.randrange(10**6))
            rows.append((len(rows) * 7 % 121, " ".join(v)))
            group[rows[-1][0]] = g
    rows += [(200 + i, " ".join(words(200))) for i in range(40)]
    rows += [(300, rows[0][1]), (301, None), (302, "")]
    got = {r.doc_id: r.component_id for r in simhash.similar_components(documents(spark, rows)).collect()}
    least = {g: min(d for d, x in group.items() if x == g) for g in range(30)}
    assert sum(got[d] == least[g] for d, g in group.items()) >= 0.97 * len(group)
    assert all(got[d] == d or group[got[d]] == group[d] for d in group)
    assert all(got[200 + i] == 200 + i for i in range(40))
    assert got[300] == got[rows[0][0]] and got[301] == got[302] == 301
    assert simhash.similar_components(documents(spark, [])).count() == 0
