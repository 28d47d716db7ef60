"""Token ids as files: frequency-ranked, in whole bytes of variable number, lengths in control bytes of their own.

An id's rank by falling corpus frequency takes one to four bytes; four such lengths, less one, share a control byte. A file is the
magic, blocks (numbers of ids and of data bytes as unsigned 32-bit integers, control bytes, data bytes), the index (doc_id, whether there is one,
number of ids, for each document) and a footer (place of the index, documents, ids, magic). Files follow each other in ascending doc_id
order, a manifest has their order and the ids before each; ``ranks`` has the ids by rank. Decoding is a lookup of
the control bytes in a table, a running sum, and a masked read of four bytes at each place.
"""

from __future__ import annotations

import gc
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestor.llm.common import discard, release, work_dir, written
from attestor.llm.segments import Cutter, Memo, byte_starts, byte_tokens, encoder, slices

MAGIC = b"RANKIDS1"
#: Ids in a block.
BLOCK = 1 << 18
#: About so many bytes of text go to one partition, and so to one file.
SHARD = 64 << 20
#: Bytes of text cut at a time, and bytes of text whose distinct segments are looked up and encoded together.
SLICE, GROUP = 4_000_000, 32_000_000

LENGTHS = np.array([[(c >> s & 3) + 1 for s in (0, 2, 4, 6)] for c in range(256)], np.uint8)
MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def packed(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit numbers."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    less = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) <= less[:, None]]
    quads = np.zeros((len(ranks) + 3) // 4 * 4, np.uint8)
    quads[: len(ranks)] = less
    quads = quads.reshape(-1, 4)
    return (quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6).astype(np.uint8).tobytes(), data.tobytes()


def unpacked(n: int, control: bytes, data: bytes) -> np.ndarray:
    """The ``n`` numbers that ``packed`` was given."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    places = np.cumsum(lengths, dtype=np.int64) - lengths
    held = data + b"\0\0\0"
    words = np.ndarray(max(len(data), 1), "<u4", held + b"\0", strides=(1,))  # four bytes from every place on
    return words[places] & MASKS[lengths]


class Writer:
    """One file of documents in order, under a name of its own until it is whole."""

    def __init__(self, path: str, rank: np.ndarray):
        self.fs, self.path = pyarrow.fs.FileSystem.from_uri(path)
        self.own, self.rank = f"{self.path}.{uuid.uuid4().hex}", rank
        self.out = self.fs.open_output_stream(self.own)
        self.out.write(MAGIC)
        self.at, self.ids, self.waiting, self.held = len(MAGIC), 0, [], 0
        self.docs: list[tuple[int, int, int]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id or 0, doc_id is not None, len(ids)))
        for lo in range(0, len(ids), BLOCK):
            self.waiting.append(ids[lo : lo + BLOCK])
            self.held += len(self.waiting[-1])
            if self.held >= BLOCK:
                self._block()

    def _block(self) -> None:
        if self.held:
            control, data = packed(self.rank[np.concatenate(self.waiting)])
            self.out.write(struct.pack("<II", self.held, len(data)) + control + data)
            self.at += 8 + len(control) + len(data)
            self.ids += self.held
            self.waiting, self.held = [], 0

    def close(self) -> tuple[int, int, int]:
        """(documents, ids, bytes)"""
        self._block()
        index = np.array(self.docs, dtype=[("doc_id", "<i8"), ("known", "u1"), ("n", "<i8")]).tobytes()
        self.out.write(index + struct.pack("<QQQ", self.at, len(self.docs), self.ids) + MAGIC)
        self.out.close()
        self.fs.move(self.own, self.path)
        return len(self.docs), self.ids, self.at + len(index) + 32


def documents(path: str, id_at: np.ndarray) -> Iterator[tuple[int | None, Iterator[np.ndarray]]]:
    """(doc_id, parts of its ids) of each document of a file, in order; at most a block of ids is held."""
    fs, at = pyarrow.fs.FileSystem.from_uri(path)
    with fs.open_input_file(at) as f:
        size = f.size()
        f.seek(size - 32)
        place, n_docs, n_ids, magic = struct.unpack("<QQQ8s", f.read(32))
        f.seek(0)
        if magic != MAGIC or f.read(8) != MAGIC:
            raise ValueError(f"{path} isn't a whole file of ids")
        f.seek(place)
        index = np.frombuffer(f.read(size - 32 - place), dtype=[("doc_id", "<i8"), ("known", "u1"), ("n", "<i8")])
        if len(index) != n_docs or index["n"].sum() != n_ids:
            raise ValueError(f"the index of {path} doesn't fit its footer")
        f.seek(len(MAGIC))
        block = np.zeros(0, np.uint32)

        def parts(n: int) -> Iterator[np.ndarray]:
            nonlocal block
            while n:
                if not len(block):
                    ids, data = struct.unpack("<II", f.read(8))
                    control = f.read((ids + 3) // 4)
                    block = id_at[unpacked(ids, control, f.read(data))]
                yield block[:n]
                n, block = n - len(block[:n]), block[n:]

        for doc_id, known, n in index:
            own = parts(int(n))
            yield (int(doc_id) if known else None), own
            for _ in own:  # what the caller hasn't read
                pass


@lru_cache(maxsize=1)
def _worker(tokenizer_json: str) -> tuple[list[str], Cutter, Memo]:
    """The special tokens, the cutter and the memo of a Python worker, which its tasks share."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t, tokens = Tokenizer.from_str(tokenizer_json), byte_tokens(tokenizer_json)
    starts = byte_starts(tokens.values())
    return [a.content for a in t.get_added_tokens_decoder().values()], Cutter(starts), Memo(encoder(t, tokens, starts))


def _done() -> None:
    """Give up what a Python worker holds for encoding: Spark keeps workers for the steps that follow."""
    _worker.cache_clear()
    gc.collect()
    pa.default_memory_pool().release_unused()


def kind_of(tokenizer_json: str, end_id: int) -> str:
    """The unsigned number, of two or four bytes, that holds every id of the vocabulary and ``end_id``."""
    from tokenizers import Tokenizer

    return "<u2" if max(Tokenizer.from_str(tokenizer_json).get_vocab().values(), default=0) <= 0xFFFF and end_id <= 0xFFFF else "<u4"


def _flat(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(where each row's ids begin, and the end; all ids in a row) of a binary column of ids."""
    own = column.cast(pa.large_binary())
    at = np.frombuffer(own.buffers()[1], np.int64)[own.offset : own.offset + len(own) + 1] if len(own) else np.zeros(1, np.int64)
    flat = np.frombuffer(own.buffers()[2], np.uint8)[at[0] : at[-1]].view(kind) if at[-1] > at[0] else np.zeros(0, kind)
    return (at - at[0]) // np.dtype(kind).itemsize, flat


def tokenised(docs: DataFrame, tokenizer_json: str, end_id: int, shard_bytes: int = SHARD) -> DataFrame:
    """(shard, pos, doc_id, ids) written in ascending doc_id order, by ranges of doc_id; equal ids in the order of their texts' hashes.

    ``ids`` are bytes, numbers as ``kind_of`` has them. Texts are cut where no token can reach across, and every distinct segment that a
    task meets is encoded once, up to a bounded memo; segments stay in Arrow.
    """
    kind = kind_of(tokenizer_json, end_id)  # a vocabulary that can't be read fails here rather than in a task
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(tokenizer_json)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = own.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    keys = ["doc_id", "tie", "row"]
    own = own.withColumn("tie", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    ranged = own.repartitionByRange(max(1, -(-size // shard_bytes)), *keys).sortWithinPartitions(*keys).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        special, cut, memo = _worker(shared.value)
        shard, pos, width = TaskContext.get().partitionId(), 0, np.dtype(kind).itemsize

        def numbered(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
            if not any(pc.any(pc.match_substring(texts, s)).as_py() for s in special):
                return cut.dictionary(texts)
            at: dict[str, int] = {}
            parts = [[x] if any(s in x for s in special) else cut.cut(x) for x in texts.to_pylist()]  # a special token may reach across a cut
            numbers = np.array([at.setdefault(x, len(at)) for p in parts for x in p], np.int32)
            return numbers, pa.array(list(at), pa.string()), np.cumsum([0, *map(len, parts)])

        def given(held: list[tuple]) -> Iterator[pa.RecordBatch]:
            nonlocal pos
            of = pa.chunked_array([pa.DictionaryArray.from_arrays(pa.array(numbers), distinct) for _, (numbers, distinct, _) in held]).unify_dictionaries()
            rows = memo.rows_of(of.chunk(0).dictionary)
            for (doc_ids, (_, _, bounds)), numbers in zip(held, of.chunks, strict=True):
                ids, ends = memo.taken(rows[numbers.indices.to_numpy()])
                at, n = ends[bounds], len(doc_ids)
                ids = np.insert(ids.astype(kind), at[1:], end_id)
                offsets = ((at + np.arange(len(at))) * width).astype(np.int32)
                lists = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(ids)])
                yield pa.record_batch([pa.array([shard] * n, pa.int32()), pa.array(np.arange(pos, pos + n)), doc_ids, lists], names=["shard", "pos", "doc_id", "ids"])
                pos += n

        held, size = [], 0
        for b in batches:
            texts = b.column(1).cast(pa.string())
            for lo, hi in slices(texts, SLICE):
                own = texts.slice(lo, hi - lo)
                held.append((b.column(0).slice(lo, hi - lo), numbered(own)))
                size += pc.sum(pc.binary_length(own)).as_py()
                if size >= GROUP:
                    yield from given(held)
                    held, size = [], 0
                    pa.default_memory_pool().release_unused()
        if held:
            yield from given(held)
        pa.default_memory_pool().release_unused()

    return written(ranged.mapInArrow(run, "shard int, pos long, doc_id long, ids binary"), compression="zstd")


def frequencies(ids: DataFrame, kind: str) -> DataFrame:
    """(id, n): how often each id occurs; each task counts before anything is shuffled. ``ids`` are as from ``tokenised``, of ``kind``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _done()
        total = np.zeros(0, np.int64)
        for b in batches:
            new = np.bincount(_flat(b.column(0), kind)[1], minlength=len(total))
            new[: len(total)] += total
            total = new
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["id", "n"])

    return ids.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_ids(docs: DataFrame, path: str, tokenizer_json: str, end_id: int = 0, shard_bytes: int = SHARD) -> None:
    """Tokenise ``docs`` (doc_id, text) and write ``path``: files of ids in ascending doc_id order, ``manifest`` and ``ranks`` as Parquet.

    Every text is encoded whole, without special tokens added, and ends with ``end_id``; null is taken as empty. Null doc_ids come first; repeated
    doc_ids are documents of their own, in the order of a hash of their texts. An empty table gives no file. Other columns are ignored. Names of
    files follow from the shard and the first row, and a file takes its name when it is whole, so a task that runs again replaces it by its like.
    """
    spark = docs.sparkSession
    ids = tokenised(docs, tokenizer_json, end_id, shard_bytes)
    release(spark)
    kind = kind_of(tokenizer_json, end_id)
    counts = frequencies(ids, kind).orderBy(F.col("n").desc(), "id").collect()  # as many rows as the vocabulary has at most
    id_at = np.array([r.id for r in counts], np.int64)
    rank = np.zeros(int(id_at.max()) + 1 if len(id_at) else 0, np.uint32)
    rank[id_at] = np.arange(len(id_at))
    spark.createDataFrame([(i, r.id, r.n) for i, r in enumerate(counts)], "rank int, id int, n long").coalesce(1).write.parquet(f"{path}/ranks")
    shared = spark.sparkContext.broadcast(rank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _done()
        file, first, expected, done = None, None, None, []

        def finish() -> None:
            done.append((*first, f"ids-{first[0]:06d}-{first[1]:012d}", *file.close()))

        for b in batches:
            offsets, flat = _flat(b.column(3), kind)
            for i, (shard, pos, doc_id) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                if (shard, pos) != expected:
                    if file:
                        finish()
                    first = (shard, pos)
                    file = Writer(f"{path}/ids-{shard:06d}-{pos:012d}", shared.value)
                file.add(doc_id, flat[offsets[i] : offsets[i + 1]])
                expected = (shard, pos + 1)
        if file:
            finish()
        yield pa.RecordBatch.from_pylist([dict(zip(("shard", "pos", "name", "docs", "ids", "bytes"), x, strict=True)) for x in done], schema=pa.schema([("shard", pa.int32()), ("pos", pa.int64()), ("name", pa.string()), ("docs", pa.int64()), ("ids", pa.int64()), ("bytes", pa.int64())]))

    files = written(ids.mapInArrow(run, "shard int, pos long, name string, docs long, ids long, bytes long"))
    # one row for each file of some 64 MB of text
    files.withColumn("start", F.sum("ids").over(W.orderBy("shard", "pos")) - F.col("ids")).coalesce(1).write.parquet(f"{path}/manifest")
    discard(files)
    discard(ids)


def read_ids(spark: SparkSession, path: str, whole: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, and ids if ``whole``) of each document of ``path``, from its files, in parallel by file.

    ``start`` counts the ids of all documents before it; ``ids_crc32`` is of the ids as little-endian unsigned 32-bit integers. Without
    ``whole`` a document's ids are never held together.
    """
    ranks = spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()  # the vocabulary at most
    shared = spark.sparkContext.broadcast(np.array([r.id for r in ranks], "<u4"))
    files = spark.read.parquet(f"{path}/manifest").select("name", "start")
    kinds = {"doc_id": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64(), "ids_crc32": pa.int64()} | ({"ids": pa.list_(pa.int32())} if whole else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows, held = [], 0
                for doc_id, parts in documents(f"{path}/{name}", shared.value):
                    crc, n, kept = 0, 0, []
                    for p in parts:
                        crc, n = zlib.crc32(np.ascontiguousarray(p, "<u4").tobytes(), crc), n + len(p)
                        if whole:
                            kept.append(p.astype(np.int32))
                    rows.append((doc_id, start, n, crc, *([np.concatenate(kept) if kept else np.zeros(0, np.int32)] if whole else [])))
                    start, held = start + n, held + (n if whole else 1)
                    if held >= 1 << 20 or len(rows) >= 10_000:
                        yield _batch(rows, kinds)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows, kinds)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if whole else "")
    n = files.count()
    return files.repartition(max(1, min(n, 2 * spark.sparkContext.defaultParallelism))).mapInArrow(run, schema)


def _batch(rows: list[tuple], kinds: dict) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))


def token_files(docs: DataFrame, tokenizer_json: str, end_id: int = 0) -> DataFrame:
    """Write ``docs`` as token files in the shared folder and read their digest back: doc_id, start, n_tokens, ids_crc32."""
    path = f"{work_dir(docs.sparkSession)}/attestor-ids-{uuid.uuid4().hex}"
    write_ids(docs, path, tokenizer_json, end_id)
    return read_ids(docs.sparkSession, path, whole=False)
