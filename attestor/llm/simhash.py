"""SimHash near-dedup by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits. The perfect binary Golay code decodes a 23-bit
segment to the one codeword within distance 3; a segment at distance exactly 3 is also given the five codewords at
distance 4, so two segments that differ in at most one bit always share a codeword index (1 or 6 keys each). With at
most two differing bits in all, some segment i has at most one error while segment i-1 (cyclically) has none
(pigeonhole over the cases 2+0+0 and 1+1+0), so (codeword of segment i, exact segment i-1) is a complete set of join
keys. Pairs that meet are verified by their real distance.

``simhash_components`` is that operator; ``similar_components`` applies the same decoding to wide fingerprints, for
documents whose shingle sets are 0.8 alike or more.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm.common import connected_components, discard, free_name, written

RADIUS = 2
SEGMENTS = ((0, 23), (23, 23), (46, 18))
GENERATOR = 0b101011100011  # generator polynomial of the (23, 12) Golay code


def _syndrome(v: np.ndarray) -> np.ndarray:
    v = v.copy()
    for bit in range(22, 10, -1):
        v = np.where((v >> bit) & 1, v ^ (GENERATOR << (bit - 11)), v)
    return v


def _error_patterns() -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome the error patterns that lead to codewords within distance 4, and how many there are (1 or 6)."""
    table, count = np.zeros((2048, 6), dtype=np.int64), np.zeros(2048, dtype=np.int64)
    for weight in range(5):
        e = np.array([sum(1 << i for i in c) for c in combinations(range(23), weight)], dtype=np.int64)
        for s, x in zip(_syndrome(e), e, strict=True):
            if weight < 4 or count[s]:
                table[s, count[s]] = x
                count[s] += 1
    return table, count


PATTERNS, N_PATTERNS = _error_patterns()


def golay_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for each join key of the uint64 fingerprints."""
    seg = [((fp >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    rows, keys = [], []
    for i in range(3):
        s = _syndrome(seg[i])
        for j in range(6):
            own = np.flatnonzero(N_PATTERNS[s] > j)
            index = (seg[i][own] ^ PATTERNS[s[own], j]) >> 11
            rows.append(own)
            keys.append((np.int64(i) << 36) | (index << 23) | seg[i - 1][own])
    return np.concatenate(rows), np.concatenate(keys)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Bit k is 1 if it is set in over half of the shingles' XXH64 values (seed 42); 0 without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    h = np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in grams), dtype="<u8")
    ones = sum(np.unpackbits(h[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64) for i in range(0, len(h), 65536))
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], dtype=np.uint64)
            yield pa.record_batch([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def _keys(fps: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False)
            rows, keys = golay_keys(fp.view(np.uint64))
            yield pa.record_batch([pa.array(keys), pa.array(fp[rows])], names=["key", "fp"])

    return fps.select("fp").mapInArrow(run, "key long, fp long")


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _bucket_links(fp: np.ndarray, radius: int) -> np.ndarray:
    """Links (a, b) between one bucket's fingerprints that give the same components as all pairs within ``radius``."""
    fp, n = np.unique(fp), 0
    root = np.arange(len(fp))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    u = fp.view(np.uint64)
    out = []
    for n in range(len(fp) - 1):
        for m in np.flatnonzero(_popcount(u[n + 1 :] ^ u[n]) <= radius) + n + 1:
            a, b = find(n), find(int(m))
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((fp[n], fp[m]))
    return np.array(out, dtype=np.int64).reshape(-1, 2)


def _bucket_pairs(keys: DataFrame, radius: int) -> DataFrame:
    """Links within the buckets; a partition is read sorted by key, so only one bucket's fingerprints are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_k, rest_f = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def links(k: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, int)
            sizes = np.diff(np.r_[starts, len(k)])
            two = starts[sizes == 2]
            near = two[_popcount((f[two] ^ f[two + 1]).view(np.uint64)) <= radius]
            found = [np.stack([f[near], f[near + 1]], axis=1)]
            found += [_bucket_links(f[s : s + n], radius) for s, n in zip(starts[sizes > 2], sizes[sizes > 2], strict=True)]
            found = np.concatenate(found)
            return pa.record_batch([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

        for b in batches:
            k = np.concatenate([rest_k, b.column(0).to_numpy()])
            f = np.concatenate([rest_f, b.column(1).to_numpy()])
            cut = int(np.searchsorted(k, k[-1])) if len(k) else 0
            yield links(k[:cut], f[:cut])
            rest_k, rest_f = k[cut:], f[cut:]
        yield links(rest_k, rest_f)

    return keys.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def _masked_links(fps: DataFrame) -> DataFrame:
    """Exact links of radius 2 in linear work, for large buckets: fingerprints that agree but for two masked bits."""
    pairs = F.explode(F.expr("flatten(transform(sequence(0, 62), i -> transform(sequence(i + 1, 63), j -> struct(i, j))))")).alias("p")
    masked = fps.select("fp", pairs).select("fp", F.expr("p.i * 64 + p.j").alias("at"), F.expr("fp & ~(shiftleft(1L, p.i) | shiftleft(1L, p.j))").alias("rest"))
    least = masked.groupBy("at", "rest").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a <> z")
    return masked.join(least, ["at", "rest"]).where("fp <> a").select("a", F.col("fp").alias("b"))


def fingerprint_links(fps: DataFrame, radius: int = RADIUS, large: int = 5000) -> DataFrame:
    """(a, b): links between distinct fingerprints that span the components of "at most ``radius`` differing bits".

    Buckets of over ``large`` fingerprints are linked by masked-bit groups instead, exactly, so that no task compares
    the pairs of a large bucket.
    """
    if not 0 <= radius <= 2:
        raise ValueError("the keys are complete for a radius of 0 to 2")
    keys = written(_keys(fps))
    big = keys.groupBy("key").count().where(F.col("count") > large).select("key")
    links = _bucket_pairs(keys.join(big, "key", "left_anti"), radius)
    if radius == 2 and not big.isEmpty():
        links = links.unionAll(_masked_links(keys.join(big, "key", "left_semi").select("fp").distinct()))
    elif radius < 2:
        links = _bucket_pairs(keys, radius)
    out = written(links.distinct())
    discard(keys)
    return out


def simhash_components(docs: DataFrame, shingle: int = 3, radius: int = RADIUS, large: int = 5000) -> DataFrame:
    """(doc_id, fp, component_id), one row for each input row.

    Input columns doc_id and text. ``component_id`` is the smallest doc_id that links of at most ``radius`` bits reach.
    Null, empty and blank texts have fingerprint 0 and link like any other. Rows with a null doc_id get a component
    (null if all its rows have none). Rows that repeat a doc_id with other texts keep a row each.
    """
    prints = written(fingerprints(docs, shingle))
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    links = fingerprint_links(classes.select("fp"), radius, large)
    roots = written(connected_components(links))
    discard(links)
    named = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = written(named)
    component = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of = named.join(component, "root").select("fp", "component_id")
    return prints.join(of, "fp").select("doc_id", "fp", "component_id")


WIDE, FOUND, BOUND, SMALL = 8, 0.97, 3.5, 16
FIELDS = [f"f{i}" for i in range(WIDE)]
CELLS = 1 << 17  # comparisons of a large bucket that are made at a time


def shingle_hashes(text: str | None, shingle: int = 5) -> np.ndarray:
    """The sorted distinct XXH64 values (seed 42) of the shingles; of fewer words the whole sequence is the shingle."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    grams = [b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in grams), dtype=np.uint64))


def wide_fingerprint(text: str | None, shingle: int = 5) -> np.ndarray:
    """A fingerprint of 64 * WIDE bits over the set of shingles: each XXH64 is mixed with a constant for each 64 bits."""
    h, out = shingle_hashes(text, shingle), np.zeros(WIDE, np.uint64)
    for j in range(WIDE if len(h) else 0):
        x = h + np.uint64(j * 0x9E3779B97F4A7C15 % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        ones = sum(np.unpackbits(x[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64) for i in range(0, len(x), 65536))
        out[j] = int.from_bytes(np.packbits(2 * ones > len(x), bitorder="little").tobytes(), "little")
    return out


def differing_share(similarity: float) -> float:
    """Expected share of differing bits of two sets of about one size: the angle between them over pi."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def same_codeword(p: float) -> float:
    """Chance that two 23-bit segments decode to one codeword if each bit differs with chance ``p``: the first has an error of weight i <= 3, the second may not have more than 3."""
    total = 0.0
    for i in range(4):
        for a in range(i + 1):
            for b in range(24 - i):
                if i - a + b <= 3:
                    total += math.comb(23, i) / 2048 * math.comb(i, a) * math.comb(23 - i, b) * p ** (a + b) * (1 - p) ** (23 - a - b)
    return total


def key_plan(n: int, similarity: float) -> tuple[int, int]:
    """(exact bits of a key, tables) for ``n`` documents.

    The bits grow with log2 of the documents, so that buckets hold few strangers; the tables grow with them, so that a pair of the
    given similarity meets in one of them with a chance of ``FOUND`` at every ``n``. That is about n ** 0.24 tables: at
    similarity 0.8 some 50 for 65 thousand documents, 180 for 16 million, 470 for a billion.
    """
    tail = max(3, math.ceil(math.log2(max(2, n))) - 13)
    p = differing_share(similarity)
    hit = same_codeword(p) * (1 - p) ** tail
    return tail, math.ceil(math.log(1 - FOUND) / math.log(1 - hit))


def wide_keys(fp: np.ndarray, tail: int, tables: int) -> np.ndarray:
    """(rows, tables) keys: in each table 23 drawn bits, decoded to the index of the nearest Golay codeword, and ``tail`` more as they are."""
    bits = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8), axis=1, bitorder="little")
    keys = np.empty((len(fp), tables), np.int64)
    for t in range(tables):
        own = np.random.default_rng([20, t]).permutation(64 * WIDE)[: 23 + tail]
        v = (bits[:, own].astype(np.float64) @ (2.0 ** np.arange(23 + tail))).astype(np.int64)
        index = ((v & 0x7FFFFF) ^ PATTERNS[_syndrome(v & 0x7FFFFF), 0]) >> 11
        key = np.uint64((t + 1) * 0x9E3779B97F4A7C15 % (1 << 64)) ^ ((v >> 23) << 12 | index).astype(np.uint64)
        key = (key ^ (key >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        keys[:, t] = (key ^ (key >> np.uint64(27))).view(np.int64)
    return keys


def most_differing(similarity: float, bits: int, deviations: float) -> int:
    """Differing bits that sets of this Jaccard similarity are expected to have, and so many standard deviations more."""
    p = differing_share(similarity)
    return int(bits * p + deviations * (bits * p * (1 - p)) ** 0.5)


def bucket_candidates(fp: np.ndarray, near: int, sure: int) -> np.ndarray:
    """(i, j) rows of one bucket's fingerprints: all pairs at most ``near`` bits apart, but for those of rows that sure links connect already.

    Pairs at most ``sure`` bits apart are links without a look at their sets. A row follows the first leader that is so near, and is linked with every such
    leader; who has none leads. Rows of leaders whom no sure link connects are all compared, unless the leaders are too far apart for any of them.
    """
    n = len(fp)
    leaders, held, out = np.zeros(n, np.int64), np.empty_like(fp), []
    of, away, up, m = np.zeros(n, np.int64), np.zeros(n, np.int64), list(range(n)), 0

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    for i in range(n):
        d = np.bitwise_count(held[:m] ^ fp[i]).sum(axis=1, dtype=np.int64)
        hit = np.flatnonzero(d <= sure)
        if len(hit):
            of[i], away[i] = hit[0], d[hit[0]]
            out.append(np.stack([np.full(len(hit), i), leaders[hit]], axis=1))
            for j in hit[1:]:
                up[root(int(j))] = root(int(hit[0]))
        else:
            leaders[m], held[m], of[i], m = i, fp[i], m, m + 1
    order = np.argsort(of, kind="stable")
    starts = np.searchsorted(of[order], np.arange(m + 1))
    radius = np.maximum.reduceat(away[order], starts[:-1]) if m else away
    for a in range(1, m):
        d = np.bitwise_count(held[:a] ^ held[a]).sum(axis=1, dtype=np.int64)
        mine = order[starts[a] : starts[a + 1]]
        for b in np.flatnonzero(d <= near + radius[a] + radius[:a]):
            theirs = order[starts[b] : starts[b + 1]]
            step = max(1, CELLS // len(theirs))
            for lo in range(0, len(mine), step):
                if root(a) == root(int(b)):
                    break
                part = mine[lo : lo + step]
                between = np.bitwise_count(fp[part, None] ^ fp[None, theirs]).sum(axis=2, dtype=np.int64)
                i, j = np.nonzero(between <= near)
                out.append(np.stack([part[i], theirs[j]], axis=1))
                if len(i) and between[i, j].min() <= sure:
                    up[root(a)] = root(int(b))
    return np.concatenate([np.zeros((0, 2), np.int64), *out])


def _candidates(table: DataFrame, near: int, sure: int) -> DataFrame:
    """(a, fa, b, fb, d): pairs of each bucket and their differing bits; a partition is read in order of key, so one bucket is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] = []

        def pairs(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            key, node, first = cols[:3]
            fp = np.stack(cols[2:], axis=1).view(np.uint64) if len(key) else np.zeros((0, WIDE), np.uint64)
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, int)
            sizes = np.diff(np.r_[starts, len(key)])
            of = np.repeat(sizes, sizes)

            def batch(i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
                swap = (node[i] > node[j]) | ((node[i] == node[j]) & (first[i] > first[j]))
                i, j = np.where(swap, j, i), np.where(swap, i, j)
                d = np.bitwise_count(fp[i] ^ fp[j]).sum(axis=1, dtype=np.int32)
                return pa.record_batch([pa.array(v) for v in (node[i], first[i], node[j], first[j], d)], names=["a", "fa", "b", "fb", "d"])

            for k in range(1, min(SMALL + 1, int(sizes.max(initial=0)))):  # all pairs of small buckets, each with the row k before
                i = np.flatnonzero((key[k:] == key[:-k]) & (of[k:] <= SMALL)) + k
                i = i[np.bitwise_count(fp[i] ^ fp[i - k]).sum(axis=1) <= near]
                yield batch(i, i - k)
            for s, n in zip(starts[sizes > SMALL], sizes[sizes > SMALL], strict=True):
                # one order in all tables, so that a group of copies has the same leader and links in each
                order = s + np.lexsort((first[s : s + n], node[s : s + n]))
                i, j = order[bucket_candidates(fp[order], near, sure)].T
                for lo in range(0, len(i), 1 << 18):
                    yield batch(i[lo : lo + (1 << 18)], j[lo : lo + (1 << 18)])

        for b in batches:
            if b.num_rows == 0:
                continue
            new = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            cols = [np.concatenate(c) for c in zip(rest, new, strict=True)] if rest else new
            cut = int(np.searchsorted(cols[0], cols[0][-1]))
            yield from pairs([c[:cut] for c in cols])
            rest = [c[cut:] for c in cols]
        if rest:
            yield from pairs(rest)

    return table.select("key", "id", *FIELDS).repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, fa long, b long, fb long, d int")


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(id, f0, shingles): each row's shingle hashes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                own = [shingle_hashes(t.as_py(), shingle).tobytes() for t in part.column(1)]
                yield pa.record_batch([part.column(0), part.column(2), pa.array(own, pa.binary())], names=["id", "f0", "shingles"])

    return docs.mapInArrow(run, "id long, f0 long, shingles binary")


def _jaccard(both: DataFrame, similarity: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(4), b.column(5), strict=True):
                u, v = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                same = len(np.intersect1d(u, v, assume_unique=True))
                keep.append(same >= similarity * (len(u) + len(v) - same) - 1e-9)
            yield pa.record_batch([c.filter(pa.array(keep, pa.bool_())) for c in b.columns[:4]], names=["a", "fa", "b", "fb"])

    return both.mapInArrow(run, "a long, fa long, b long, fb long")


def similar_components(docs: DataFrame, similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """(doc_id, text_hash, component_id), one row for each input row: documents whose sets of shingles are ``similarity`` alike.

    For similarities that are far beyond two differing bits: fingerprints of 512 bits, whose share of differing bits estimates
    the angle between the shingle sets, with as many keys of a decoded segment and a few more bits as ``key_plan`` gives. In
    each bucket all fingerprints are compared, but for those that sure links connect already (see ``bucket_candidates``). Pairs that might be alike by the
    estimate are verified by their shingle sets; those far above (``BOUND`` standard deviations) are taken without. Nothing of this depends on the number
    of documents but the keys, whose chance to find a pair does not.

    Input columns doc_id and text. Null, empty and blank texts have no shingles and are alike. Rows that repeat a doc_id and a
    text are alike; rows that repeat a doc_id with other texts are told apart by ``text_hash`` (Spark's xxhash64 of the
    text). Rows with a null doc_id get a component too (null if all its rows have none). Empty for an empty table.
    """

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([wide_fingerprint(t.as_py(), shingle) for t in b.column(1)], dtype=np.uint64).reshape(-1, WIDE).view(np.int64)
            yield pa.record_batch([b.column(0), b.column(2), *(pa.array(np.ascontiguousarray(fp[:, i])) for i in range(WIDE))], names=["doc_id", "text_hash", *FIELDS])

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            fp = np.stack([b.column(i + 1).to_numpy(zero_copy_only=False) for i in range(WIDE)], axis=1).astype(np.int64)
            for lo in range(0, len(ids), 1000):
                own, rows = ids[lo : lo + 1000], fp[lo : lo + 1000]
                k = wide_keys(rows.view(np.uint64), tail, tables)
                yield pa.record_batch([pa.array(k.ravel()), pa.array(np.repeat(own, tables)), *(pa.array(np.repeat(rows[:, i], tables)) for i in range(WIDE))], names=["key", "id", *FIELDS])

    types = ", ".join(f"{f} long" for f in FIELDS)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    own = written(base.mapInArrow(prints, f"doc_id long, text_hash long, {types}"))
    classes = written(own.groupBy(*FIELDS).agg(F.min("doc_id").alias("id")))
    tail, tables = key_plan(classes.count(), similarity)
    table = classes.where("id is not null").select("id", *FIELDS).mapInArrow(keys, f"key long, id long, {types}")
    least, most = (most_differing(similarity, 64 * WIDE, x) for x in (-BOUND, BOUND))
    near = written(_candidates(table, most, least).distinct())
    sure = F.col("d") <= least
    asked = near.where(~sure)
    # texts of the documents in unsure pairs: the row whose class has that document as its smallest
    wanted = asked.select(F.col("a").alias("id"), F.col("fa").alias("f0")).unionAll(asked.select("b", "fb")).distinct()
    of = own.select("doc_id", "text_hash", "f0").distinct().join(wanted, F.struct("doc_id", own["f0"]) == F.struct("id", wanted["f0"]), "left_semi")
    of = of.groupBy("doc_id", "f0").agg(F.min("text_hash").alias("text_hash"))
    texts = base.join(of, ["doc_id", "text_hash"])
    sets = written(_sets(texts.select(F.col("doc_id").alias("id"), "text", "f0"), shingle).dropDuplicates(["id", "f0"]))
    named = lambda n: sets.select(F.col("id").alias(n), F.col("f0").alias(f"f{n}"), F.col("shingles").alias(f"s{n}"))
    verified = _jaccard(asked.join(named("a"), ["a", "fa"]).join(named("b"), ["b", "fb"]).select("a", "fa", "b", "fb", "d", "sa", "sb").drop("d"), similarity)
    node = lambda n: F.struct(F.col(n).alias("id"), F.col(f"f{n}").alias("f0"))
    links = written(near.where(sure).select("a", "fa", "b", "fb").unionAll(verified).select(node("a").alias("a"), node("b").alias("b")))
    for df in (near, sets):
        discard(df)
    roots = written(connected_components(links))
    discard(links)
    roots = roots.select(F.col("node.id").alias("id"), F.col("node.f0").alias("f0"), F.col("root.id").alias("component_id"))
    full = classes.join(roots, ["id", "f0"], "left").select(*FIELDS, F.coalesce("component_id", "id").alias("component_id"))
    return own.join(full, FIELDS).select("doc_id", "text_hash", "component_id")


def near_duplicates_dropped(docs: DataFrame, similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """``docs`` without the rows whose component has a smaller doc_id, with the same columns.

    Rows that repeat the doc_id that stays stay with it if their text is in its component; those of other texts are judged by
    their own component. Rows with a null doc_id stay. Nulls in other columns play no part. Empty for an empty table.
    """
    of = similar_components(docs, similarity, shingle).where("doc_id <> component_id").select("doc_id", "text_hash").distinct()
    gone = of.select(F.col("doc_id").alias(free_name(docs, "gone_id")), F.col("text_hash").alias(free_name(docs, "gone_text")))
    return docs.join(gone, (docs["doc_id"].cast("long") == gone[gone.columns[0]]) & (F.xxhash64(docs["text"]) == gone[gone.columns[1]]), "left_anti")


def digest(out: DataFrame) -> DataFrame:
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
