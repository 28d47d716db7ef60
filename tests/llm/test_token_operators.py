"""Whitening against numpy; token files by round trip; alignment against a brute-force version over whole texts."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from attestor.llm import alignment, segments, token_files, whitening
from attestor.llm.common import work_dir
from attestor.llm.queries import vocabulary
from tests.llm.helpers import awkward, documents, prose


@pytest.fixture(scope="module")
def byte_level():
    return vocabulary("byte_bpe_50k.json").decode()


@pytest.fixture(scope="module")
def both(byte_level):
    return alignment.Vocabularies(byte_level, vocabulary("piece_bpe_32k.model"))


SPACES = [
    (20, "foo  bar\n\nbaz\tq \n"), (21, " "), (22, "   "), (23, "\n"), (24, "a  b  c"), (25, "x▁ y"), (26, "<|endoftext|> hi <0x41> <s>"), (27, "1234567890" * 30 + "====" * 50),
    (28, "a\r\nb \r c"), (29, "é ü\U0001f600 ñ　 z​ w"), (30, "foo "), (30, "foo "), (None, "\tfoo"), (31, "\x00a \x1c b\x85 c"), (32, "don't  'll \n\n\n  we've"), (33, "   a \nb"), (34, "a" * 3000 + " " * 3000 + "b"),
]


# whitening


def expected_whitening(rows, k=4):
    """numpy's answer over [(vec_id, vector)]: {vec_id: (deviation, values)}, n, eigenvalues."""
    x = np.array([[math.floor(256 * float(np.float32(v))) for v in vec] for _, vec in rows], dtype=np.int64)
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(axis=0)
    values, vectors = np.linalg.eigh(np.cov(fit.T.astype(float), bias=True))
    w = (x - total / n) @ vectors[:, ::-1][:, :k] / np.sqrt(values[::-1][:k])
    deviation = ((n * x - total) ** 2).sum(axis=1)
    return {i: (int(d), v) for (i, _), d, v in zip(rows, deviation, w, strict=True)}, n, values[::-1]


def test_whitening_against_numpy_with_copies_and_damaged_rows(spark):
    rng = np.random.default_rng(5)
    good = [(i, [float(v) for v in rng.normal(0.5, [1, 0.7, 0.5, 0.3, 0.2, 0.1])]) for i in range(60)]
    good += [(100 + i, good[i % 7][1]) for i in range(50)]
    bad = [(1000, None), (1001, []), (1002, [1.0] * 5), (1003, [None] + [1.0] * 5), (1004, [float("nan")] + [1.0] * 5), (1005, [float("-inf")] + [1.0] * 5), (1006, [1e30] + [1.0] * 5)]
    df = spark.createDataFrame([(i, v, 1, "x", 2.0) for i, v in good + bad], "vec_id long, embedding array<float>, component int, whitened string, n double")
    want, n, values = expected_whitening(good)
    assert n == 60
    for part in (1, 7):
        got = defaultdict(dict)
        for r in whitening.components(df.repartition(part)).collect():
            got[r.vec_id][r.component] = r
        assert set(got) == {i for i, _ in good}
        sign = {c: np.sign(got[0][c].whitened * want[0][1][c - 1]) for c in range(1, 5)}
        for i, own in got.items():
            assert set(own) == {1, 2, 3, 4}
            for c, r in own.items():
                assert (r.n, r.deviation) == (n, want[i][0])
                assert r.whitened * sign[c] == pytest.approx(want[i][1][c - 1], abs=1e-9)
                assert r.explained == pytest.approx(values[c - 1] / values.sum(), rel=1e-9)
                assert r.identity_error < 1e-9


def test_whitening_without_variance_large_entries_and_empty_tables(spark):
    schema = "vec_id long, embedding array<double>"
    flat = whitening.components(spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [1.0, 2.0])], schema)).collect()
    assert [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in sorted(flat, key=lambda r: (r.vec_id is None, r.component))][:2] == [(1, 1, 1, 0, None, 0.0, None)] * 2
    assert len(flat) == 6
    assert whitening.components(spark.createDataFrame([], schema)).collect() == []
    assert whitening.components(spark.createDataFrame([(1, None)], schema)).collect() == []
    far = whitening.components(spark.createDataFrame([(1, [3e15, 0.0]), (2, [-3e15, 1.0]), (3, [0.0, 2.0])], schema)).collect()
    assert {r.deviation for r in far if r.vec_id == 1} == {None}
    assert all(math.isfinite(r.whitened) for r in far if r.component == 1)
    assert {r.whitened for r in far if r.component == 2} == {None}  # its variance is lost beside the first one's


def test_whitening_in_several_aggregations_gives_the_same(spark, monkeypatch):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, [float(v) for v in rng.normal(size=7)]) for i in range(40)], "vec_id long, embedding array<double>")
    fit, d = whitening.fit_table(df)
    one = whitening.learned(fit, "x", d).covariance
    monkeypatch.setattr(whitening, "PAIRS", 5)
    assert (whitening.learned(fit, "x", d).covariance == one).all()


# token files


def test_coding_gives_back_every_number():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        x = (rng.integers(0, 2**32, n, dtype=np.uint64) >> rng.integers(0, 32, n, dtype=np.uint64)).astype(np.uint32)
        control, data = token_files.packed(x)
        assert len(control) == (n + 3) // 4
        assert (token_files.unpacked(n, control, data) == x).all()
    edges = np.array([0, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1], np.uint32)
    control, data = token_files.packed(edges)
    assert len(data) == 1 + 1 + 2 + 2 + 3 + 3 + 4 + 4
    assert (token_files.unpacked(8, control, data) == edges).all()


def test_files_give_back_all_ids_in_order(spark, byte_level, monkeypatch):
    from tokenizers import Tokenizer

    rng = random.Random(3)
    rows = awkward() + SPACES + [(100 + i, prose(rng, rng.randint(0, 60))) for i in range(60)]
    t = Tokenizer.from_str(byte_level)
    monkeypatch.setattr(token_files, "BLOCK", 64)
    for shard in (1 << 30, 3000):
        path = f"{work_dir(spark)}/ids-{shard}"
        token_files.write_ids(documents(spark, rows).repartition(5), path, byte_level, shard_bytes=shard)
        got = sorted(token_files.read_ids(spark, path).collect(), key=lambda r: r.start)
        assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
        at, whole = 0, Counter()
        for r in got:
            assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes()))
            at += r.n_tokens
            whole[r.doc_id, tuple(r.ids)] += 1
        assert whole == Counter((r[0], tuple(t.encode(r[1] or "", add_special_tokens=False).ids + [0])) for r in rows)
        ranks = spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()
        counts = Counter(i for r in got for i in r.ids)
        assert [(r.id, r.n) for r in ranks] == sorted(counts.items(), key=lambda x: (-x[1], x[0]))


def test_no_documents_no_files(spark, byte_level):
    assert token_files.token_files(documents(spark, []), byte_level).collect() == []


def test_a_file_that_was_cut_off_is_refused(tmp_path):
    rank = np.arange(10, dtype=np.uint32)
    w = token_files.Writer(f"{tmp_path}/a", rank)
    w.add(7, np.array([1, 2, 3]))
    w.close()
    assert [(i, np.concatenate(list(p)).tolist()) for i, p in token_files.documents(f"{tmp_path}/a", rank)] == [(7, [1, 2, 3])]
    (tmp_path / "b").write_bytes((tmp_path / "a").read_bytes()[:-9])
    with pytest.raises(ValueError):
        list(token_files.documents(f"{tmp_path}/b", rank))


# segments and alignment


def test_cuts_follow_the_vocabularies(both, byte_level):
    assert both.starts() == " \n\t"
    assert segments.byte_starts([b"a b"]) == "\n\t"
    assert segments.byte_starts([b" \xc2\xa0 ", b"\n\n"]) == " \n\t"
    cut = segments.cutter(" ")
    for text in ("", " ", "a b", "  a\n b  c ", "a\n", "\n\n a"):
        assert "".join(cut(text)) == text
    assert cut(" a  b\n c▁ d ") == [" a", "  b\n c▁ d", " "]
    assert segments.cutter("")("a b") == ["a b"]


@pytest.mark.parametrize("starts", [" \n\t", " ", ""])
@pytest.mark.parametrize("prefix", ["", " "])
def test_columns_are_cut_like_texts(starts, prefix):
    rng = random.Random(8)
    texts = ["".join(rng.choice("ab é \n\t\x00\u00a0\u2581  ") for _ in range(rng.randint(0, 12))) for _ in range(400)] + [None, "", "a b\nc", "x\r y"]
    cutter = segments.Cutter(starts)
    numbers, distinct, bounds = cutter.dictionary(pa.array(texts, pa.string()), prefix)
    distinct = distinct.to_pylist()
    got = [[distinct[i] for i in numbers[lo:hi]] for lo, hi in zip(bounds, bounds[1:], strict=False)]
    assert got == [segments.cutter(starts)(prefix + t) if t else [] for t in texts]
    assert len(set(distinct)) == len(distinct)


def test_a_memo_without_room_gives_the_same_ids(byte_level):
    from tokenizers import Tokenizer

    t, tokens = Tokenizer.from_str(byte_level), segments.byte_tokens(byte_level)
    starts, rng = segments.byte_starts(tokens.values()), random.Random(9)
    cutter = segments.Cutter(starts)
    for most, chars, group in ((400_000, 10**9, 200_000), (20, 10**9, 30), (10**6, 100, 1)):
        memo = segments.Memo(segments.encoder(t, tokens, starts, group), most, chars)
        for _ in range(4):
            texts = [prose(rng, rng.randint(0, 40)) + rng.choice(["", " ", "é\u4e2d\U0001f600", " \n x"]) for _ in range(30)]
            numbers, distinct, bounds = cutter.dictionary(pa.array(texts))
            ids, ends = memo.ids_of(distinct, numbers)
            at = ends[bounds]
            assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [t.encode(x, add_special_tokens=False).ids for x in texts]
            assert len(memo) <= most


def test_a_tokenizer_is_given_few_texts_at_once_and_ids_are_two_bytes(spark, byte_level, monkeypatch):
    from tokenizers import Tokenizer

    t, tokens = Tokenizer.from_str(byte_level), segments.byte_tokens(byte_level)
    given = []

    class Counted:
        def encode_batch_fast(self, texts, **options):
            given.append(len(texts))
            return t.encode_batch_fast(texts, **options)

    words = pa.array([" w%d" % i for i in range(500)])
    sizes, ids = segments.encoder(Counted(), tokens, segments.byte_starts(tokens.values()), 50)(words)
    want = [t.encode(w, add_special_tokens=False).ids for w in words.to_pylist()]
    assert max(given) <= 4 < len(given)
    assert sizes.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])
    monkeypatch.setattr(token_files, "GROUP", 40)  # several groups in a task
    rng = random.Random(3)
    rows = [(i, prose(rng, i % 30) if i else None) for i in range(60)]
    got = {r.doc_id: np.frombuffer(r.ids, "<u2").tolist() for r in token_files.tokenised(documents(spark, rows), byte_level, 0).collect()}
    assert got == {i: [*t.encode(x or "", add_special_tokens=False).ids, 0] for i, x in rows}
    assert (token_files.kind_of(byte_level, 0), token_files.kind_of(byte_level, 1 << 16)) == ("<u2", "<u4")


def test_codes_give_back_shapes_and_ids():
    rows = [([1, 2], [7, 8, 9]), None, ([1, 1, 2, 0], [5, 50_000, 4, 3]), ([1, 1], [65_535, 0])]
    for more in ([], [([1, 1], [65_536, 1])], [([70_000, 1], [9] * 70_001), None]):
        own = rows + more
        ids, id_at, counts, groups = alignment.unpacked(pa.array([None if r is None else alignment.packed(*r) for r in own], pa.binary()))
        for i, r in enumerate(own):
            shape, numbers = r or ([], [])
            assert counts[2 * groups[i] : 2 * groups[i + 1]].tolist() == shape
            assert ids[id_at[i] : id_at[i] + len(numbers)].tolist() == numbers
    assert [x.tolist() for x in alignment.unpacked(pa.array([], pa.binary()))] == [[], [], [], [0]]


def brute_alignment(rows, vocabularies):
    """Whole texts by both tokenizers, byte by byte; every pair of occurrences."""
    aligner = alignment.Aligner(vocabularies)
    docs = []
    for i, text in rows:
        if not text:
            docs.append((i, None))
            continue
        a, b = aligner.a.encode(" " + text, add_special_tokens=False).ids, aligner.b.encode(text)
        av, bv = [aligner.a_bytes[t] for t in a], [aligner.b_bytes[t] for t in b]
        if not b"".join(av) == b"".join(bv) == (" " + text).encode():
            docs.append((i, None))
            continue
        ends_a, ends_b = (np.cumsum([len(x) for x in v]) for v in (av, bv))
        common = np.intersect1d(ends_a, ends_b)
        groups = [([], []) for _ in common]
        for side, (ids, ends) in enumerate(((a, ends_a), (b, ends_b))):
            for t, at in zip(ids, np.searchsorted(common, ends), strict=True):
                groups[at][side].append(t)
        docs.append((i, groups))
    links = [[(x, y) for a, b in g or [] for x in a for y in b] for _, g in docs]
    counts = Counter(p for own in links for p in set(own))
    most = defaultdict(int)
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    out = []
    for (i, g), own in zip(docs, links, strict=True):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g or [])
        best = sum(counts[p] == most[p[0]] for p in own)
        out.append((i, sum(len(a) for a, _ in g or []), sum(len(b) for _, b in g or []), len(g or []), len(own), best, sum(counts[p] for p in own), hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return out


def test_alignment_against_whole_texts(spark, both, monkeypatch):
    rng = random.Random(4)
    rows = awkward() + SPACES + [(100 + i, prose(rng, rng.randint(0, 60)) + rng.choice(["", " ", "\n", " ", " ..", "\t\t"])) for i in range(60)]
    want = Counter(brute_alignment([r[:2] for r in rows], both))
    assert Counter(map(tuple, alignment.digest(documents(spark, rows).repartition(5), both).collect())) == want
    monkeypatch.setattr(alignment, "MANY", 3)  # links by distinct ids
    monkeypatch.setattr(alignment, "PLACES", 7)
    assert Counter(map(tuple, alignment.digest(documents(spark, rows).repartition(2), both).collect())) == want


def test_chunks_do_not_change_an_alignment(spark, both, monkeypatch):
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.randint(0, 80))) for i in range(50)] + [(99, None)]
    docs = documents(spark, rows).coalesce(1)
    want = Counter(brute_alignment([r[:2] for r in rows], both))
    monkeypatch.setattr(alignment.chunked, "__defaults__", (500,))
    monkeypatch.setattr(alignment, "SLICE", 300)
    assert Counter(map(tuple, alignment.digest(docs, both).collect())) == want
    assert alignment.digest(documents(spark, []), both).collect() == []
