"""Suffix-array dedup by bucket-pointer refinement, over sampled suffixes.

Task: remove each byte covered by a 50-byte string that also starts in a document with a smaller id. Suffixes need to be
told apart to a depth of 50 bytes only, and not all of them need be sorted:

1. *Initial buckets.* Every 50-byte window is filed under one of its 16-byte q-grams, the one with the least hash (its
   anchor; equal windows choose the same place). Windows that follow each other share anchors, so a bucket entry is an
   anchor with the run of windows it stands for and the bytes they span (at most 84). Equal entries of one chunk of
   documents are sent once, as hashes.
2. *Finished buckets.* A bucket whose entries are all equal needs no refinement: all but the smallest document's windows
   are copies. A bucket of one entry is unique. Only buckets with different entries go on, now with their bytes.
3. *Refinement.* Within these, windows are first numbered by their 8-byte q-grams; then the number of the string at i and
   the number at i + 8 are sorted as a pair and renumbered (16 bytes), these numbers are used in turn at distance 16 (32
   bytes) and 18 (50 bytes): bucket pointers of later offsets, updated and reused until the depth is reached. Windows
   with the same last number are equal, byte for byte.

Documents are dealt once into chunks by a hash of their id; requests go to the buckets and answers come back to the
chunks as bitmaps. Nothing is collected, and a string that a third of all documents hold is one entry in each chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm.common import input_bytes

DEPTH, Q = 50, 16
SIDE = DEPTH - Q  # bytes that a window may reach beyond its anchor, on either side
SPAN = DEPTH + SIDE  # bytes around an anchor
SEGMENT = 1 << 20
CHUNK_BYTES, BUCKET_BYTES = 6_000_000, 6_000_000
#: The lowest 0 to 8 bytes of a word.
MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=np.uint64)
K1, K2, K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= K1
    x ^= x >> np.uint64(29)
    x *= K2
    x ^= x >> np.uint64(32)
    return x


def _gram_hash(buf: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """The hash of the 16 bytes at each of lo..hi-1."""
    w = np.ndarray((hi - lo + 8,), dtype="<u8", buffer=buf.data, offset=lo, strides=(1,)).copy()
    return _mix(_mix(w[:-8] * K3) + w[8:] * K1)


def _anchors(buf: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, anchor, hash) of each run of windows with one anchor; windows lie within documents.

    ``buf`` has at least 32 bytes after the last document; ``ends`` are the documents' ends, ascending, gapless from 0.
    """
    total = int(ends[-1]) if len(ends) else 0
    n = total - DEPTH + 1
    firsts, lasts, anchors, hashes = [], [], [], []
    width = SIDE + 1
    end_of = np.repeat(ends, np.diff(ends, prepend=0))
    for lo in range(0, max(n, 0), SEGMENT):
        hi = min(n, lo + SEGMENT)
        h = _gram_hash(buf, lo, hi + SIDE)
        key = (h >> np.uint64(24) << np.uint64(24)) | np.arange(len(h), dtype=np.uint64)
        m, size = key, 1
        while size * 2 <= width:
            m = np.minimum(m[:-size], m[size:])
            size *= 2
        m = np.minimum(m[: hi - lo], m[width - size : width - size + hi - lo])
        at = (m & np.uint64((1 << 24) - 1)).astype(np.int64)
        start = np.arange(lo, hi)
        doc_end = end_of[lo:hi]
        ok = start + DEPTH <= doc_end
        new = np.r_[True, (at[1:] != at[:-1]) | (doc_end[1:] != doc_end[:-1]) | (ok[1:] != ok[:-1])]
        run = np.flatnonzero(new)
        last = np.r_[run[1:], len(at)] - 1
        good = ok[run]
        run, last = run[good], last[good]
        firsts.append(run + lo)
        lasts.append(last + lo)
        anchors.append(at[run] + lo)
        hashes.append(_mix(h[at[run]] ^ K3))  # mixed again: anchors have small hashes, buckets need even ones
    if not firsts:
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(np.uint64)
    return tuple(np.concatenate(x) for x in (firsts, lasts, anchors, hashes))


class Chunk:
    """A chunk of documents: its bytes, its anchor runs, and its distinct entries sorted by hash."""

    def __init__(self, ids: list, texts: list[bytes]):
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0))
        self.ids, texts = [ids[i] for i in order], [texts[i] for i in order]
        self.buf = np.frombuffer(b"".join(texts) + bytes(SPAN + 48), dtype=np.uint8)
        self.ends = np.cumsum([len(t) for t in texts]) if texts else np.zeros(0, np.int64)
        self.first, self.last, self.anchor, h = _anchors(self.buf, self.ends)
        row = np.searchsorted(self.ends, self.first, side="right")
        known = np.array([d is not None for d in self.ids], dtype=bool)
        keep = known[row] if len(row) else np.zeros(0, bool)
        self.first, self.last, self.anchor, h, row = self.first[keep], self.last[keep], self.anchor[keep], h[keep], row[keep]
        self.doc = np.array([d or 0 for d in self.ids], dtype=np.int64)[row] if len(row) else np.zeros(0, np.int64)
        ctx = self._context_hash()
        by = np.lexsort((self.doc, ctx, h))
        h, ctx = h[by], ctx[by]
        new = np.r_[True, (h[1:] != h[:-1]) | (ctx[1:] != ctx[:-1])] if len(h) else np.zeros(0, bool)
        self.entry = np.empty(len(h), np.int64)
        self.entry[by] = np.cumsum(new) - 1
        self.sample = by[new]  # the run that stands for each entry, of its smallest document
        self.h, self.ctx = h[new], ctx[new]
        self.least = self.doc[self.sample]

    def _context_hash(self) -> np.ndarray:
        out = np.empty(len(self.first), np.uint64)
        words = -(-SPAN // 8)
        spans = np.lib.stride_tricks.as_strided(self.buf, (len(self.buf) - words * 8 + 1, words * 8), (1, 1))
        for lo in range(0, len(out), 50_000):
            f, a = self.first[lo : lo + 50_000], self.anchor[lo : lo + 50_000]
            n = self.last[lo : lo + 50_000] - f + DEPTH
            w = spans[f].view("<u8")
            x = ((a - f) * 256 + n).astype(np.uint64) * K3
            for i in range(words):
                x = _mix(x + (w[:, i] & MASKS[np.clip(n - 8 * i, 0, 8)]) * K1)
            out[lo : lo + 50_000] = x
        return out

    def around(self, entries: np.ndarray) -> np.ndarray:
        """The bytes around the anchors of these entries; what no window of the entry covers is left as it is."""
        at = self.anchor[self.sample[entries]]
        return self.buf[np.clip(at[:, None] + np.arange(-SIDE, Q + SIDE), 0, len(self.buf) - 1)]

    def windows(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and most offset of the anchor within the entry's windows."""
        s = self.sample[entries]
        return self.anchor[s] - self.last[s], self.anchor[s] - self.first[s]

    def cleaned(self, copied: np.ndarray, bitmaps: np.ndarray) -> Iterator[tuple]:
        """(doc_id, n_bytes, spans, kept) for each document; ``copied`` and ``bitmaps`` (bit o: the window that starts o before the anchor) answer for the entries."""
        total = int(self.ends[-1]) if len(self.ends) else 0
        mark = np.zeros(total + 1, np.int32)
        whole = (self.doc > self.least[self.entry]) | copied[self.entry]
        np.add.at(mark, self.first[whole], 1)
        np.add.at(mark, self.last[whole] + 1, -1)
        part = np.flatnonzero(~whole & (bitmaps[self.entry] != 0))
        if len(part):
            bits, a = bitmaps[self.entry[part]], self.anchor[part]
            for o in range(SIDE + 1):
                on = ((bits >> np.uint64(o)) & np.uint64(1)).astype(bool) & (a - o >= self.first[part]) & (a - o <= self.last[part])
                np.add.at(mark, a[on] - o, 1)
                np.add.at(mark, a[on] - o + 1, -1)
        starts = np.cumsum(mark[:total]) > 0
        c = np.cumsum(np.r_[np.zeros(DEPTH, np.int32), starts])
        gone = c[DEPTH:] > c[: len(c) - DEPTH]
        lo = 0
        for d, hi in zip(self.ids, self.ends.tolist(), strict=True):
            g = gone[lo:hi]
            edge = np.flatnonzero(np.diff(np.r_[False, g, False].astype(np.int8)))
            text = self.buf[lo:hi]
            yield d, hi - lo, edge.reshape(-1, 2), (text[~g] if len(edge) else text).tobytes()
            lo = hi


def refined(rows: np.ndarray, low: np.ndarray, high: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each row (bytes around an anchor) the bitmap of its windows that a smaller document has too."""
    n, out = len(rows), np.zeros(len(rows), np.uint64)
    if not n:
        return out
    width = SPAN - 8 + 1
    grams = np.lib.stride_tricks.as_strided(np.ascontiguousarray(rows), (n, width, 8), (SPAN, 1, 1))
    ids = np.unique(np.ascontiguousarray(grams).view("<u8").reshape(n, width), return_inverse=True)[1].reshape(n, width)

    def paired(ids: np.ndarray, step: int) -> np.ndarray:
        pairs = (ids[:, :-step].astype(np.uint64) << np.uint64(32)) | ids[:, step:].astype(np.uint64)
        return np.unique(pairs, return_inverse=True)[1].reshape(pairs.shape)

    ids = paired(ids, 8)  # 16 bytes
    ids = paired(ids, 16)  # 32
    ids = paired(ids, 18)  # 50: column j is the window that starts at j, that is SIDE - j before the anchor
    offset = SIDE - np.arange(SIDE + 1)
    own = (offset >= low[:, None]) & (offset <= high[:, None])
    r, j = np.nonzero(own)
    key = ids[r, j] * (SIDE + 1) + j
    by = np.lexsort((doc[r], key))
    k, d = key[by], doc[r][by]
    start = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    least = np.repeat(d[start], np.diff(np.r_[start, len(k)]))
    hit = by[d > least]
    np.bitwise_or.at(out, r[hit], np.uint64(1) << (SIDE - j[hit]).astype(np.uint64))
    return out


def _planes(x: np.ndarray) -> bytes:
    """The bytes of the numbers, all lowest bytes first: shuffle compression finds the equal high bytes."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _unplanes(b: bytes, dtype: str) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def _bucket_of(h: np.ndarray, n_buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64)


def _runs(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    if not len(bucket):
        return
    at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    for lo, hi in zip(at.tolist(), [*at[1:].tolist(), len(bucket)], strict=True):
        yield int(bucket[lo]), lo, hi


BLOB = "chunk long, bucket long, payload binary"


def _blobs(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    c = list(zip(*rows, strict=True)) or [(), (), ()]
    return pa.table([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.binary())], names=["chunk", "bucket", "payload"])


def _chunk(t: pa.Table) -> tuple[int, Chunk]:
    texts = [(x.as_py() or "").encode("utf-8", "replace") for x in t.column("text")]
    return t.column("chunk")[0].as_py() if t.num_rows else -1, Chunk(t.column("doc_id").to_pylist(), texts)


def _first_request(n_buckets: int):
    def run(t: pa.Table) -> pa.Table:
        at, c = _chunk(t)
        return _blobs([(at, b, _planes(c.h[lo:hi]) + _planes(c.ctx[lo:hi]) + _planes(c.least[lo:hi])) for b, lo, hi in _runs(_bucket_of(c.h, n_buckets))])

    return run


def _first_answer(t: pa.Table) -> pa.Table:
    """Two bits for each entry: a smaller document has the same entry; it is the first of its kind in a bucket with others."""
    blobs = [x.as_py() for x in t.column("payload")]
    sizes = [len(x) // 24 for x in blobs]
    h, ctx, doc = (np.concatenate([_unplanes(x[8 * i * n : 8 * (i + 1) * n], k) for x, n in zip(blobs, sizes, strict=True)]) for i, k in enumerate(("<u8", "<u8", "<i8")))
    by = np.lexsort((doc, ctx, h))
    h, ctx = h[by], ctx[by]
    new_h = np.r_[True, h[1:] != h[:-1]]
    first = new_h | np.r_[True, ctx[1:] != ctx[:-1]]
    group = np.cumsum(new_h) - 1
    several = np.bincount(group, weights=first)[group] > 1
    copied, open_ = np.empty(len(h), bool), np.empty(len(h), bool)
    # rows that repeat one smallest document in two chunks can't be: a document is in one chunk
    copied[by], open_[by] = ~first, first & several
    rows, at = [], 0
    for chunk, bucket, n in zip(t.column("chunk").to_pylist(), t.column("bucket").to_pylist(), sizes, strict=True):
        rows.append((chunk, bucket, np.packbits(copied[at : at + n]).tobytes() + np.packbits(open_[at : at + n]).tobytes()))
        at += n
    return _blobs(rows)


def _answers(c: Chunk, replies: pa.Table, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    got = dict(zip(replies.column("bucket").to_pylist(), replies.column("payload").to_pylist(), strict=True))
    copied, open_ = np.zeros(len(c.h), bool), np.zeros(len(c.h), bool)
    for b, lo, hi in _runs(_bucket_of(c.h, n_buckets)):
        bits = np.frombuffer(got[b], np.uint8)
        copied[lo:hi] = np.unpackbits(bits[: len(bits) // 2], count=hi - lo)
        open_[lo:hi] = np.unpackbits(bits[len(bits) // 2 :], count=hi - lo)
    return copied, open_


def _second_request(n_buckets: int):
    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        at, c = _chunk(docs)
        entries = np.flatnonzero(_answers(c, replies, n_buckets)[1])
        low, high = c.windows(entries)
        rows = c.around(entries)
        out = []
        for b, lo, hi in _runs(_bucket_of(c.h[entries], n_buckets)):
            out.append((at, b, _planes(c.least[entries[lo:hi]]) + low[lo:hi].astype(np.uint8).tobytes() + high[lo:hi].astype(np.uint8).tobytes() + rows[lo:hi].tobytes()))
        return _blobs(out)

    return run


def _second_answer(t: pa.Table) -> pa.Table:
    blobs = [x.as_py() for x in t.column("payload")]
    size = 8 + 2 + SPAN
    n = [len(x) // size for x in blobs]
    doc = np.concatenate([_unplanes(x[: 8 * k], "<i8") for x, k in zip(blobs, n, strict=True)])
    low, high = (np.concatenate([np.frombuffer(x[(8 + i) * k : (9 + i) * k], np.uint8) for x, k in zip(blobs, n, strict=True)]).astype(np.int64) for i in (0, 1))
    rows = np.concatenate([np.frombuffer(x[10 * k :], np.uint8) for x, k in zip(blobs, n, strict=True)]).reshape(-1, SPAN)
    bits = refined(rows, low, high, doc)
    out, at = [], 0
    for chunk, bucket, k in zip(t.column("chunk").to_pylist(), t.column("bucket").to_pylist(), n, strict=True):
        out.append((chunk, bucket, bits[at : at + k].tobytes()))
        at += k
    return _blobs(out)


def _result(n_buckets: int):
    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        _, c = _chunk(docs)
        kind = np.array(replies.column("round").to_pylist())
        copied, open_ = _answers(c, replies.filter(pa.array(kind == 1, pa.bool_())), n_buckets)
        bitmaps, entries = np.zeros(len(c.h), np.uint64), np.flatnonzero(open_)
        second = replies.filter(pa.array(kind == 2, pa.bool_()))
        got = dict(zip(second.column("bucket").to_pylist(), second.column("payload").to_pylist(), strict=True))
        for b, lo, hi in _runs(_bucket_of(c.h[entries], n_buckets)):
            bitmaps[entries[lo:hi]] = np.frombuffer(got[b], np.uint64)
        rows = []
        for d, n, spans, kept in c.cleaned(copied, bitmaps):
            rows.append((d, n, int((spans[:, 1] - spans[:, 0]).sum()), [{"start": int(a), "end": int(b)} for a, b in spans], hashlib.sha256(kept).hexdigest()))
        cols = list(zip(*rows, strict=True)) or [()] * 5
        spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        kinds = [pa.int64(), pa.int64(), pa.int64(), spans_type, pa.string()]
        return pa.table([pa.array(x, k) for x, k in zip(cols, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "spans", "kept_sha256"])

    return run


def suffix_dedup(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept_sha256), one row for each input row; spans are byte ranges removed.

    Input columns doc_id and text. Null text counts as no bytes. Rows that repeat a doc_id are one document: none of
    them is a smaller document than the other. Rows with a null doc_id are kept whole and are no source of copies.
    """
    size = 2 * input_bytes(docs)
    n_chunks, n_buckets = max(1, size // chunk_bytes), max(1, size // bucket_bytes)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    base = base.withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(n_chunks))).repartition("chunk")
    by_chunk = base.groupBy("chunk")
    first = by_chunk.applyInArrow(_first_request(n_buckets), BLOB).groupBy("bucket").applyInArrow(_first_answer, BLOB)
    second = by_chunk.cogroup(first.groupBy("chunk")).applyInArrow(_second_request(n_buckets), BLOB).groupBy("bucket").applyInArrow(_second_answer, BLOB)
    replies = first.withColumn("round", F.lit(1)).unionAll(second.withColumn("round", F.lit(2)))
    return by_chunk.cogroup(replies.groupBy("chunk")).applyInArrow(_result(n_buckets), "doc_id long, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept_sha256 string")


def digest(out: DataFrame) -> DataFrame:
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def brute_force(rows: list[tuple[int, str | None]]) -> list[tuple]:
    """The contract by a dictionary of all windows, for tests."""
    least: dict[bytes, int] = {}
    data = [(d, (t or "").encode()) for d, t in rows]
    for d, t in data:
        for i in range(len(t) - DEPTH + 1):
            w = t[i : i + DEPTH]
            least[w] = min(d, least.get(w, d))
    out = []
    for d, t in data:
        gone = bytearray(len(t))
        for i in range(len(t) - DEPTH + 1):
            if least[t[i : i + DEPTH]] < d:
                gone[i : i + DEPTH] = b"\x01" * DEPTH
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((d, len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return out
