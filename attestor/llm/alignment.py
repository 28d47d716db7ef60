"""Cross-tokenizer alignment by distinct segments.

Texts are cut before white space where neither vocabulary can merge across, which is read off the vocabularies (``segments``). Documents become
sequences of places in the dictionary of their chunk; the dictionaries' distinct segments are tokenised and aligned once, their alignments are joined back to
the chunks that hold them, and documents are composed from them. No occurrence of a segment is shuffled: only the chunks' dictionaries are.
"""

from __future__ import annotations

import hashlib
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestor.llm.common import discard, release, written
from attestor.llm.segments import CANDIDATES, Cutter, byte_starts, byte_tokens, encoder, piece_starts, piece_tokens, slices

#: Bytes of text of a chunk, which has one dictionary; bytes cut at a time; segments of the documents composed at a time.
CHUNK, SLICE, PLACES = 32_000_000, 3_000_000, 500_000


@dataclass(frozen=True)
class Vocabularies:
    """The files of a byte-level BPE vocabulary (A) and of a piece vocabulary (B), as they are sent to tasks."""

    byte_level: str
    pieces: bytes

    def starts(self) -> str:
        """White space before which both vocabularies allow a cut."""
        a, b = byte_starts(byte_tokens(self.byte_level).values()), piece_starts(self.processor())
        return "".join(c for c in CANDIDATES if c in a and c in b)

    def processor(self):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_proto=self.pieces)


class Aligner:
    """Tokenises segments with both vocabularies and aligns their tokens by bytes."""

    def __init__(self, vocabularies: Vocabularies):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(vocabularies.byte_level)
        self.a.encode_special_tokens = True
        self.b = vocabularies.processor()
        self.a_bytes, self.b_bytes = byte_tokens(vocabularies.byte_level), piece_tokens(self.b)
        self.mark = self.b.piece_to_id("▁")
        self.a_ids = encoder(self.a, self.a_bytes, vocabularies.starts())

    def tokens(self, segments: list[str]) -> tuple[list[list[int]], list[list[int] | None]]:
        """Ids of both; B's are None where its added space doesn't come off as a piece of its own."""
        sizes, flat = self.a_ids(pa.array(segments, pa.string()))
        ends, flat = np.cumsum(sizes).tolist(), flat.tolist()
        a = [flat[lo:hi] for lo, hi in zip([0, *ends], ends, strict=False)]
        # B adds a space in front: it is the segment's own, or comes off again
        own = self.b.encode([s[1:] if s[0] == " " else s for s in segments], num_threads=1)
        b: list[list[int] | None] = []
        for s, ids in zip(segments, own, strict=True):
            if s == " ":
                b.append([self.mark])
            elif s[0] == " ":
                b.append(ids)
            else:
                b.append(ids[1:] if ids[:1] == [self.mark] else None)
        return a, b

    def shape(self, segment: str, a: list[int], b: list[int] | None) -> list[int] | None:
        """How many ids of A and of B each group between common ends has, in turn; None if joined bytes differ from the segment's."""
        whole, av, bv = segment.encode(), self.a_bytes, self.b_bytes
        if b is None or b"".join([av[i] for i in a]) != whole or b"".join([bv[i] for i in b]) != whole:
            return None
        out, j, at_a, at_b, from_a, from_b = [], 0, 0, 0, 0, 0
        for n, i in enumerate(a, 1):
            at_a += len(av[i])
            while at_b < at_a:
                at_b += len(bv[b[j]])
                j += 1
            if at_a == at_b:
                out += [n - from_a, j - from_b]
                from_a, from_b = n, j
        return out


def chunked(docs: DataFrame, starts: str, chunk: int = CHUNK) -> DataFrame:
    """Written rows of two kinds: ``doc`` (chunk, doc_id, places: the numbers of its segments) and ``segment`` (chunk, number, segment).

    A chunk is a run of rows of one task with about ``chunk`` bytes of text; a longer text ends one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Cutter(starts)
        number, at, held = TaskContext.get().partitionId() << 32, {}, 0
        kinds = {"chunk": pa.int64(), "doc_id": pa.int64(), "places": pa.list_(pa.int32()), "number": pa.int32(), "segment": pa.string(), "kind": pa.string()}

        def batch(n: int, **own) -> pa.RecordBatch:
            own["chunk"] = pa.array([number] * n, pa.int64())
            return pa.record_batch([own[c] if c in own else pa.nulls(n, k) for c, k in kinds.items()], names=list(kinds))

        def dictionary() -> Iterator[pa.RecordBatch]:
            segments = list(at)
            for lo in range(0, len(segments), 50_000):
                part = segments[lo : lo + 50_000]
                yield batch(len(part), number=pa.array(np.arange(lo, lo + len(part), dtype=np.int32)), segment=pa.array(part, pa.string()), kind=pa.array(["segment"] * len(part)))

        for b in batches:
            for lo, hi in slices(b.column(1), SLICE):
                texts = b.column(1).slice(lo, hi - lo)
                numbers, distinct, bounds = cut.dictionary(texts, " ")
                own = np.fromiter((at.setdefault(s, len(at)) for s in distinct.to_pylist()), np.int32, len(distinct))
                places = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(own[numbers]))
                yield batch(hi - lo, doc_id=b.column(0).slice(lo, hi - lo), places=places, kind=pa.array(["doc"] * (hi - lo)))
                held += texts.nbytes
                if held >= chunk:
                    yield from dictionary()
                    number, at, held = number + 1, {}, 0
        yield from dictionary()

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return written(own.mapInArrow(run, "chunk long, doc_id long, places array<int>, number int, segment string, kind string"), partition_by="kind", compression="zstd")


def packed(shape: list[int], ids: list[int]) -> bytes:
    """The number of groups, their shape and the ids as 16-bit numbers; as 32-bit numbers after a 0 where one doesn't fit."""
    numbers = [len(shape) // 2, *shape, *ids]
    return struct.pack(f"<{len(numbers)}H", *numbers) if max(numbers) < 65536 else struct.pack(f"<H{len(numbers)}I", 0, *numbers)


def unpacked(codes: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, the place of each segment's first, shapes, the groups before each segment with the total last); null codes have none."""
    size = np.asarray(pc.fill_null(pc.binary_length(codes), 0), np.int64) // 2
    own = codes.drop_null().cast(pa.large_binary())
    ends = np.frombuffer(own.buffers()[1], np.int64)[own.offset : own.offset + len(own) + 1] if len(own) else np.zeros(1, np.int64)
    flat = np.frombuffer(own.buffers()[2], np.uint8)[ends[0] : ends[-1]].copy().view("<u2") if len(own) else np.zeros(0, "<u2")
    start = np.cumsum(size) - size
    held = size > 0
    n = np.zeros(len(size), np.int64)
    n[held] = flat[start[held]]
    if not n[held].all():  # some are wide
        wide = [np.frombuffer(c.as_py() or b"", "<u2").astype(np.uint32) for c in codes]
        wide = [np.frombuffer(w.astype("<u2")[1:].tobytes(), "<u4") if len(w) and not w[0] else w for w in wide]
        size = np.array([len(w) for w in wide], np.int64)
        flat, start = np.concatenate(wide), np.cumsum(size) - size
        n[held] = flat[start[held]]
    n_ids = np.where(held, size - 1 - 2 * n, 0)
    ids = flat[_runs(start + 1 + 2 * n, n_ids)].astype(np.int32)
    return ids, np.cumsum(n_ids) - n_ids, flat[_runs(start + 1, 2 * n)].astype(np.int32), np.concatenate([[0], np.cumsum(n)])


def aligned(segments: DataFrame, vocabularies: Vocabularies) -> DataFrame:
    """(segment, code) of each distinct segment: how many ids of A and of B each group has in turn, A's ids and B's (``packed``); null where bytes differ."""
    shared = segments.sparkSession.sparkContext.broadcast(vocabularies)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(shared.value)
        for b in batches:
            for lo in range(0, b.num_rows, 20_000):
                own = b.column(0).slice(lo, 20_000)
                texts = own.to_pylist()
                shapes = ((aligner.shape(s, x, y), x, y) for s, x, y in zip(texts, *aligner.tokens(texts), strict=True))
                yield pa.record_batch([own, pa.array([None if shape is None else packed(shape, x + y) for shape, x, y in shapes], pa.binary())], names=["segment", "code"])

    return segments.select("segment").distinct().mapInArrow(run, "segment string, code binary")


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (with the end) and the flat values of a list column; null is empty."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(column), 0), np.int64)
    return np.concatenate([[0], np.cumsum(sizes)]), column.flatten().to_numpy(zero_copy_only=False)


def _runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each run, one run after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(size) else 0) + np.repeat(start - (ends - size), size)


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The sum of each run of ``values`` between neighbouring bounds."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


#: Groups of more links than this have theirs counted by distinct ids.
MANY = 4096


class Dictionary:
    """The aligned segments of one chunk, by number, as flat arrays: groups, and links with their pairs (A's id times 2^32 plus B's)."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        order = np.argsort(table.column("number").to_numpy())
        if len(order) and (table.column("number").to_numpy()[order] != np.arange(len(order))).any():
            raise ValueError("a chunk's dictionary isn't whole")
        codes = table.column("code").combine_chunks().take(pa.array(order))
        self.whole = np.asarray(pc.is_valid(codes))
        self._ids, id_at, counts, self.groups = unpacked(codes)
        # the numbers of A's and B's ids of each group; ``groups``: those before each segment
        self.in_a, self.in_b = counts[0::2], counts[1::2]
        self.n_a, self.n_b = _sums(self.in_a, self.groups), _sums(self.in_b, self.groups)
        # where each group's ids begin: A's of all groups of a segment, then B's
        own = np.repeat(np.arange(len(order)), np.diff(self.groups))
        before_a, before_b = np.cumsum(self.in_a) - self.in_a, np.cumsum(self.in_b) - self.in_b
        first = np.minimum(self.groups[:-1], max(len(before_a) - 1, 0))
        self._a = id_at[own] + before_a - before_a[first][own] if len(own) else before_a
        self._b = id_at[own] + self.n_a[own] + before_b - before_b[first][own] if len(own) else before_b
        self._a, self._b = self._a.astype(np.int32), self._b.astype(np.int32)
        del own, before_a, before_b, first, counts, codes
        self._link()
        pa.default_memory_pool().release_unused()

    def _link(self) -> None:
        """``links`` before each segment, and of each its ``pair`` and how often it stands there (``times``)."""
        size = self.in_a.astype(np.int64) * self.in_b
        few = np.where(size > MANY, 0, size)
        group = np.repeat(np.arange(len(size), dtype=np.int32), few)
        place = np.arange(len(group), dtype=np.int32) - np.repeat((np.cumsum(few) - few).astype(np.int32), few)
        in_b = self.in_b[group]
        pair = self._ids[self._a[group] + place // in_b].astype(np.int64) << 32
        pair |= self._ids[self._b[group] + place % in_b]
        del place, in_b
        #: How often each link stands in its segment; None: once.
        self.times = None
        many = np.flatnonzero(size > MANY)
        if len(many):
            self.times = np.ones(len(group), np.int64)
        for g in many:
            (x, m), (y, n) = (np.unique(self._ids[at[g] : at[g] + k[g]], return_counts=True) for at, k in ((self._a, self.in_a), (self._b, self.in_b)))
            few[g] = len(x) * len(y)
            at = np.searchsorted(group, g)
            group = np.insert(group, at, np.full(few[g], g))
            pair = np.insert(pair, at, (x.astype(np.int64)[:, None] << 32 | y[None, :]).ravel())
            self.times = np.insert(self.times, at, (m[:, None] * n[None, :]).ravel())
        del group
        self.links = np.concatenate([[0], np.cumsum(few)])[self.groups]
        self.pairs, at = np.unique(pair, return_inverse=True)
        self.pair = at.astype(np.int32)

    def linked(self, values: np.ndarray | None = None) -> np.ndarray:
        """For each segment, the number of its links, or the sum of their pairs' ``values``."""
        if values is None and self.times is None:
            return np.diff(self.links)
        own = self.times if values is None else values[self.pair] if self.times is None else values[self.pair] * self.times
        return _sums(own, self.links)

    def counted(self, places: pa.ListArray, counts: np.ndarray) -> None:
        """Add the documents of ``places`` to the ``counts`` of the pairs that they hold."""
        bounds, flat = _lists(places)
        size = np.diff(self.links)
        for lo, hi in zip(bounds, bounds[1:], strict=False):
            rows = np.unique(flat[lo:hi])
            if len(rows) and self.whole[rows].all():
                counts[np.unique(self.pair[_runs(self.links[rows], size[rows])])] += 1

    def texts(self) -> pa.Array:
        """Each segment's groups as text."""
        named = pc.cast(pa.array(self._ids), pa.string())

        def side(start: np.ndarray, size: np.ndarray) -> pa.Array:
            flat = named.take(pa.array(_runs(start, size)))
            return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), flat), ",")

        groups = pc.binary_join_element_wise(side(self._a, self.in_a), side(self._b, self.in_b), "|")
        return pc.cast(pc.binary_join(pa.ListArray.from_arrays(pa.array(self.groups.astype(np.int32)), groups), ";"), pa.large_string())


def _chunks(batches: Iterator[pa.RecordBatch], load) -> Iterator[tuple[int, object, pa.RecordBatch]]:
    """(chunk, what ``load`` gives for it, its rows) of batches whose first column is the chunk; a chunk's rows follow each other."""
    chunk, own = None, None
    for b in batches:
        numbers = b.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1), len(numbers)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if hi > lo:
                if numbers[lo] != chunk:
                    chunk, own = int(numbers[lo]), None  # the last one goes before the next is read
                    own = load(chunk)
                yield chunk, own, b.slice(lo, hi - lo)


KINDS = {"number": pa.int32(), "code": pa.binary(), "pair": pa.int64(), "docs": pa.int64(), "best": pa.bool_()}


def _partition(path: str, column: str, value: int, columns: list[str]) -> pa.Table:
    """One partition of a written table; no rows if it has none."""
    fs, root = pyarrow.fs.FileSystem.from_uri(path)
    found = fs.get_file_info(pyarrow.fs.FileSelector(f"{root}/{column}={value}", allow_not_found=True))
    files = [pq.read_table(f.path, columns=columns, filesystem=fs, partitioning=None) for f in found if f.base_name.endswith(".parquet")]
    return pa.concat_tables(files or [pa.table({c: pa.array([], KINDS[c]) for c in columns})])


def pair_counts(documents: DataFrame, dictionary: str) -> DataFrame:
    """(chunk, pair, docs): in how many documents of each chunk an id pair is linked. ``dictionary``: the path of the chunks' aligned segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, counts, pairs = None, None, None

        def sent() -> Iterator[pa.RecordBatch]:
            at = np.flatnonzero(counts) if counts is not None else []
            for lo in range(0, len(at), 100_000):
                part = at[lo : lo + 100_000]
                yield pa.record_batch([pa.array([last] * len(part), pa.int64()), pa.array(pairs[part]), pa.array(counts[part])], names=["chunk", "pair", "docs"])

        for chunk, found, b in _chunks(batches, lambda c: Dictionary(_partition(dictionary, "chunk", c, ["number", "code"]))):
            if chunk != last:
                yield from sent()
                last, pairs, counts = chunk, found.pairs, np.zeros(len(found.pairs), np.int64)
            found.counted(b.column(1), counts)
            del found
        yield from sent()

    return documents.select("chunk", "places").where(F.size("places") > 0).mapInArrow(run, "chunk long, pair long, docs long")


def pair_scores(counts: DataFrame) -> DataFrame:
    """(pair, docs, best): the documents of each pair in all chunks, and whether no other pair of its A id has more."""
    total = counts.groupBy("pair").agg(F.sum("docs").alias("docs"))
    most = F.max("docs").over(W.partitionBy(F.shiftright("pair", 32)))  # as many rows as B has ids at most
    return total.select("pair", "docs", (F.col("docs") == most).alias("best"))


DIGEST = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def composed(documents: DataFrame, dictionary: str, scores: str) -> DataFrame:
    """(doc_id, DIGEST, groups_sha256) of each document, from its chunk's aligned segments and the scores of its pairs."""
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in DIGEST) + ", groups_sha256 string"

    def load(chunk: int) -> tuple[np.ndarray, list[np.ndarray], pa.Array]:
        own = Dictionary(_partition(dictionary, "chunk", chunk, ["number", "code"]))
        docs, best = np.zeros(len(own.pairs), np.int64), np.zeros(len(own.pairs), bool)
        if len(own.pairs):
            known = _partition(scores, "chunk", chunk, ["pair", "docs", "best"]).combine_chunks()
            at = np.searchsorted(own.pairs, known.column("pair").to_numpy())
            docs[at], best[at] = known.column("docs").to_numpy(), known.column("best").to_numpy(zero_copy_only=False)
        sums = [own.n_a, own.n_b, np.diff(own.groups), own.linked(), own.linked(best.astype(np.int32)), own.linked(docs)]
        texts, whole = own.texts(), own.whole
        del own
        pa.default_memory_pool().release_unused()
        return whole, sums, texts

    def digested(whole: np.ndarray, sums: list[np.ndarray], texts: pa.Array, b: pa.RecordBatch) -> pa.RecordBatch:
        bounds, flat = _lists(b.column(2))
        fine = (_sums(~whole[flat], bounds) == 0) & (np.diff(bounds) > 0)
        values = [pa.array(np.where(fine, _sums(v[flat], bounds), 0)) for v in sums]
        joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(bounds), texts.take(pa.array(flat))), pa.scalar(";", pa.large_string()))
        sha = [hashlib.sha256(x.as_buffer()).hexdigest() if ok else "" for x, ok in zip(joined, fine, strict=True)]
        return pa.record_batch([b.column(1), *values, pa.array(sha, pa.string())], names=["doc_id", *DIGEST, "groups_sha256"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (whole, sums, texts), b in _chunks(batches, load):
            ends = _lists(b.column(2))[0]
            lo = 0
            while lo < b.num_rows:
                hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + PLACES, side="right")) - 1)
                yield digested(whole, sums, texts, b.slice(lo, hi - lo))
                lo = hi

    return documents.select("chunk", "doc_id", "places").mapInArrow(run, schema)


@dataclass
class Alignments:
    """``documents`` (chunk, doc_id, places); written by chunk: ``dictionary`` (number, code) and ``scores`` (pair, docs, best)."""

    documents: DataFrame
    dictionary: DataFrame
    scores: DataFrame

    def digest(self) -> DataFrame:
        return composed(self.documents, self.dictionary._attestor_path, self.scores._attestor_path)


def alignments(docs: DataFrame, vocabularies: Vocabularies) -> Alignments:
    """Documents as sequences of segment numbers, and each chunk's segments and id pairs with their alignments and corpus-wide scores.

    Every row of ``docs`` is a document, whatever its doc_id (null and repeated ones too); null and empty texts have no place. Columns other than doc_id and text aren't
    read. A text longer than a chunk is held by one task. An empty table gives empty tables. Dictionaries and scores are written by chunk, and a task
    reads those of the chunks whose documents it has: the sequences are never shuffled.
    """
    spark = docs.sparkSession
    parts = chunked(docs, vocabularies.starts())
    documents = parts.where("kind = 'doc'").select("chunk", "doc_id", "places")
    held = parts.where("kind = 'segment'").select("chunk", "number", "segment")
    segments = written(aligned(held, vocabularies), compression="zstd")
    release(spark)
    routed = written(held.join(segments, "segment").select("chunk", "number", "code"), compression="zstd")
    discard(segments)
    release(spark)
    dictionary = written(routed.repartition("chunk"), partition_by="chunk", compression="zstd")
    discard(routed)
    release(spark)
    counts = written(pair_counts(documents, dictionary._attestor_path), compression="zstd")
    scores = written(counts.select("chunk", "pair").join(pair_scores(counts), "pair").repartition("chunk"), partition_by="chunk", compression="zstd")
    discard(counts)
    return Alignments(documents, dictionary, scores)


def digest(docs: DataFrame, vocabularies: Vocabularies) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each document; see ``alignments``.

    Zeros and '' for texts that are null, empty, or that a vocabulary doesn't give back byte for byte.
    """
    return alignments(docs, vocabularies).digest()
