"""Line dedup: levelled sorted runs of line hashes; each new batch merge-anti-joins the runs and adds its own.

A run is a table of (h1, h2, n_docs, holder), sorted by hash inside hash partitions: one row for each line key that a
batch of documents holds, the number of documents that hold it and the largest of their ids. Batches go in by falling
doc_id, so a key that the anti-join finds in no run (a fresh key) has its final holder at once; a known key only adds
to the count. ``fanout`` runs of one level are merged into one run of the next.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm.common import discard, free_name, written

MIN_CHARS, MIN_DOCS = 40, 5


def line_key(line: bytes) -> bytes:
    """The line with ASCII white space stripped at both ends and A-Z lower-cased."""
    return line.strip(b" \t\n\x0b\x0c\r").lower()


def _long(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars)


def _hash(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, h1, h2): each document's distinct line keys of at least ``min_chars`` code points, hashed to 128 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, digests = [], []
            for d, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if d is None:
                    continue
                text = t.as_py()
                own = {_hash(k) for x in (text or "").encode("utf-8", "replace").split(b"\n") if len(x) >= min_chars and _long(k := line_key(x), min_chars)}
                ids += [d] * len(own)
                digests += own
            h = np.frombuffer(b"".join(digests), dtype=">i8").reshape(-1, 2).astype("int64")
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(h[:, 0]), pa.array(h[:, 1])], names=["doc_id", "h1", "h2"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, h1 long, h2 long")


class LineRuns:
    """The levelled runs. ``add`` takes a batch of (doc_id, h1, h2); ``merged`` gives (h1, h2, n_docs, holder)."""

    def __init__(self, fanout: int = 2):
        self.fanout, self.levels = fanout, []

    def _runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def _sorted(self, df: DataFrame) -> DataFrame:
        return written(df.sortWithinPartitions("h1", "h2"))

    @staticmethod
    def _merge(runs: list[DataFrame]) -> DataFrame:
        both = runs[0]
        for r in runs[1:]:
            both = both.unionAll(r)
        # one row of each key has a holder: that of the batch in which the anti-join found it fresh
        return both.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.any_value("holder", F.lit(True)).alias("holder"))

    def add(self, batch: DataFrame) -> None:
        own = batch.distinct().groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("holder"))
        if self._runs():
            own = written(own)
            fresh = own
            for r in self._runs():
                fresh = fresh.join(r.select("h1", "h2"), ["h1", "h2"], "left_anti")
            # a known key's holder is in an older run (larger ids): its row only counts
            fresh = written(fresh)
            known = own.join(fresh.select("h1", "h2"), ["h1", "h2"], "left_anti").select("h1", "h2", "n_docs", F.lit(None).cast("long").alias("holder"))
            run = self._sorted(fresh.unionAll(known))
            discard(fresh)
            discard(own)
        else:
            run = self._sorted(own)
        self._put(0, run)

    def _put(self, level: int, run: DataFrame) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            new = self._sorted(self._merge(old))
            for r in old:
                discard(r)
            self._put(level + 1, new)

    def merged(self) -> DataFrame | None:
        return self._merge(self._runs()) if self._runs() else None


def _gone(docs: DataFrame, min_chars: int, min_docs: int, n_batches: int, fanout: int) -> DataFrame:
    """(_gone_id, _h1, _h2): for each document the hashes of the lines that it loses."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    edges = sorted(set(base.select("doc_id").approxQuantile("doc_id", [i / n_batches for i in range(1, n_batches)], 0.01))) if n_batches > 1 else []
    batch = F.lit(0)
    for x in edges:
        batch = batch + F.when(F.col("doc_id") <= F.lit(x), 1).otherwise(0)  # 0: the largest ids
    lines = written(line_hashes(base, min_chars).withColumn("batch", batch), partition_by="batch")
    runs = LineRuns(fanout)
    for i in range(len(edges) + 1):
        runs.add(lines.where(F.col("batch") == i).select("doc_id", "h1", "h2"))
    # written, so that both sides of the join below are plain shuffles and a hot line's partition can be split
    common = written(runs.merged().where(F.col("n_docs") >= min_docs).select("h1", "h2", "holder"))
    gone = lines.select("doc_id", "h1", "h2").join(common, ["h1", "h2"]).where("doc_id <> holder")
    gone = gone.groupBy("doc_id").agg(F.collect_set(F.struct("h1", "h2")).alias("gone"))
    return gone.select(F.col("doc_id").alias("_gone_id"), F.col("gone.h1").alias("_h1"), F.col("gone.h2").alias("_h2"))


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, n_batches: int = 4, fanout: int = 2) -> DataFrame:
    """Drop lines that many documents share, except in the largest doc_id that holds them.

    Input columns doc_id and text (others are ignored). Returns (doc_id, n_lines, n_dropped, kept_text), one row for
    each input row. Null text counts as one empty line. Rows that repeat a doc_id are one document: their lines count
    once and each row is cleaned alike. Rows with a null doc_id hold no lines and keep all of theirs. Result is empty
    for an empty table.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    gone = _gone(base, min_chars, min_docs, n_batches, fanout)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_lines, n_dropped, kept = _kept(b.column(1), b.column(2), b.column(3), min_chars)
            yield pa.record_batch([b.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_text"])

    both = base.join(gone, F.col("doc_id") == F.col("_gone_id"), "left").select("doc_id", "text", "_h1", "_h2")
    return both.mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_text string")


def without_common_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, n_batches: int = 4, fanout: int = 2) -> DataFrame:
    """``docs`` with the same rows and columns, text without the lines that ``line_dedup`` drops, n_chars counted anew.

    Null text stays null, an empty one empty; long texts are read whole. Rows that repeat a doc_id are one document, rows with a null
    doc_id keep all lines. Other columns, whatever their names and nulls, are passed on. Empty for an empty table.
    """
    gone = _gone(docs, min_chars, min_docs, n_batches, fanout)
    for name in ("_gone_id", "_h1", "_h2"):
        gone = gone.withColumnRenamed(name, free_name(docs, name))
    at, schema, (gone_id, *hashes) = docs.columns.index("text"), docs.schema, gone.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_columns
            kept = _kept(b.column(at), b.column(n - 2), b.column(n - 1), min_chars)[2]
            kept = [x if t.is_valid else None for x, t in zip(kept, b.column(at), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(kept, b.column(i).type) if i == at else b.column(i) for i in range(n - 2)], names=docs_names)

    docs_names = docs.columns
    both = docs.join(gone, docs["doc_id"] == gone[gone_id], "left").select(*(docs[c] for c in docs.columns), *hashes)
    out = both.mapInArrow(run, schema)
    return out.withColumn("n_chars", F.char_length("text").cast(schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def _kept(texts: pa.Array, firsts: pa.Array, seconds: pa.Array, min_chars: int) -> tuple[list[int], list[int], list[str]]:
    """(lines, dropped lines, kept text) of each text, given the hashes of the lines that it loses."""
    n_lines, n_dropped, kept = [], [], []
    for text, h1, h2 in zip(texts, firsts, seconds, strict=True):
        rows = (text.as_py() or "").encode("utf-8", "replace").split(b"\n")
        n_lines.append(len(rows))
        if h1.is_valid:
            pairs = np.array([h1.values.to_numpy(), h2.values.to_numpy()]).T.astype(">i8")
            gone = {x.tobytes() for x in pairs}
            rows = [x for x in rows if len(x) < min_chars or not _long(k := line_key(x), min_chars) or _hash(k) not in gone]
        n_dropped.append(n_lines[-1] - len(rows))
        kept.append(b"\n".join(rows).decode("utf-8", "replace"))
    return n_lines, n_dropped, kept


def digest(out: DataFrame) -> DataFrame:
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str | None]], min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> list[tuple]:
    """The same over a list, for tests."""
    held: dict[str, set[int]] = {}
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({i: i + 32 for i in range(65, 91)})
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars:
                held.setdefault(key(x), set()).add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if len(held.get(key(x), ())) < min_docs or max(held[key(x)]) == d]
        out.append((d, len(lines), len(lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    return out
