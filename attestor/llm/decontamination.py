"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may occur with up to k = floor(rate * m) edits. Cut into k + 1 pieces, at least one piece
occurs unchanged (pigeonhole). Exact piece hits come from one Aho-Corasick pass over each whole text; a hit is checked
up the tree of pieces (a node of c pieces may have c - 1 errors, so one of its halves keeps its own budget) with Myers'
bit-parallel distance, at last over the whole item.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATE, MIN_CHARS, BLOCK_CHARS = 0.1, 20, 2_000_000


def normalised(text: str | None) -> str:
    """Lower case, white space runs as one space, none at the ends."""
    return " ".join((text or "").lower().split())


class Pattern:
    """Myers' bit-parallel matcher for one string; Python's integers hold any length."""

    def __init__(self, p: str):
        self.m, self.masks = len(p), {}
        for i, c in enumerate(p):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def best(self, text: str, budget: int) -> tuple[int, int] | None:
        """(distance, end) of the best occurrence anywhere in ``text`` within ``budget`` edits, the earliest of equals."""
        m, masks = self.m, self.masks
        full, top = (1 << m) - 1, 1 << (m - 1)
        pv, mv, score = full, 0, m
        found, at = budget + 1, -1
        for j, c in enumerate(text):
            eq = masks.get(c, 0)
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | ~(xh | pv) & full
            mh = pv & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
            ph = ph << 1 & full
            xv = eq | mv
            mv = ph & xv
            pv = (mh << 1 | ~(xv | ph)) & full
            if score < found:
                found, at = score, j + 1
                if not found:
                    break
        return (found, at) if at >= 0 else None


class Item:
    """A test item, its pieces and the tree over them."""

    def __init__(self, item_id: int, text: str, rate: float):
        self.item_id, self.text = item_id, text
        self.k = int(rate * len(text))
        n = self.k + 1
        self.cuts = [i * len(text) // n for i in range(n + 1)]
        self.patterns: dict[tuple[int, int], Pattern] = {}
        self.backward = None

    def pieces(self) -> list[str]:
        return [self.text[a:b] for a, b in zip(self.cuts, self.cuts[1:], strict=False)]

    def _pattern(self, lo: int, hi: int) -> Pattern:
        if (lo, hi) not in self.patterns:
            self.patterns[lo, hi] = Pattern(self.text[self.cuts[lo] : self.cuts[hi]])
        return self.patterns[lo, hi]

    def path(self, piece: int) -> list[tuple[int, int]]:
        """The nodes (first piece, end) above ``piece``, from the root down."""
        lo, hi, out = 0, self.k + 1, []
        while hi - lo > 1:
            out.append((lo, hi))
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if piece < mid else (mid, hi)
        return out

    def verified(self, text: str, piece: int, at: int) -> tuple[int, int, int] | None:
        """(distance, start, end) of the item around the piece found at ``at``; None beyond the budget."""
        for lo, hi in reversed(self.path(piece)):
            budget = hi - lo - 1
            a = at - (self.cuts[piece] - self.cuts[lo]) - budget
            b = at + (self.cuts[hi] - self.cuts[piece]) + budget
            a = max(0, a)
            if not (hit := self._pattern(lo, hi).best(text[a:b], budget)):
                return None
        if self.k == 0:
            return 0, at, at + len(self.text)
        d, end = hit[0], a + hit[1]
        if self.backward is None:
            self.backward = Pattern(self.text[::-1])
        back = self.backward.best(text[max(0, end - len(self.text) - d) : end][::-1], d)
        return d, end - (back[1] if back else len(self.text)), end


class Matcher:
    """All items of a block behind one automaton."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items = [Item(i, t, rate) for i, t in items]
        by_piece: dict[str, list[tuple[int, int]]] = {}
        for n, item in enumerate(self.items):
            for j, p in enumerate(item.pieces()):
                by_piece.setdefault(p, []).append((n, j))
        self.automaton = ahocorasick.Automaton()
        for p, where in by_piece.items():
            self.automaton.add_word(p, (len(p), where))
        if by_piece:
            self.automaton.make_automaton()

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item number, distance, start, end): each item's best occurrence, the first of equals."""
        best: dict[int, tuple[int, int, int]] = {}
        if len(self.automaton):
            for end, (size, where) in self.automaton.iter(text):
                for n, piece in where:
                    at = end + 1 - size
                    if n in best and best[n][0] == 0:
                        continue
                    if (got := self.items[n].verified(text, piece, at)) and (n not in best or got < best[n]):
                        best[n] = got
        return [(n, *x) for n, x in sorted(best.items())]


def blocks(items: DataFrame, rate: float, min_chars: int, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The items, normalised, in blocks of at most ``block_chars`` characters (or one item)."""
    block, size = [], 0
    for r in items.select(F.col("item_id").cast("long"), "text").where("item_id is not null and text is not null").orderBy("item_id", "text").toLocalIterator():
        t = normalised(r.text)
        if len(t) < min_chars:
            continue
        if block and size + len(t) > block_chars:
            yield block
            block, size = [], 0
        block.append((r.item_id, t))
        size += len(t)
    if block:
        yield block


def contaminated(docs: DataFrame, items: DataFrame, rate: float = RATE, min_chars: int = MIN_CHARS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, distance, item_chars, start, end): the best occurrence of each item in each document.

    Input: docs (doc_id, text) and items (item_id, text). Positions are in the normalised text. Null or empty texts
    and items of under ``min_chars`` normalised characters match nothing; rows with a null doc_id are searched and
    reported with a null id; repeated rows give repeated results. Items go out in blocks of bounded size, one pass over
    the documents for each, so what is broadcast doesn't grow with either table.
    """
    schema = "doc_id long, item_id long, distance int, item_chars int, start int, end int"
    out = None
    for block in blocks(items, rate, min_chars, block_chars):
        part = _pass(docs, block, rate, schema)
        out = part if out is None else out.unionAll(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def _pass(docs: DataFrame, block: list[tuple[int, str]], rate: float, schema: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Matcher(shared.value, rate)
        for b in batches:
            rows = []
            for d, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for n, dist, start, end in m.matches(normalised(t.as_py())):
                    rows.append((d, m.items[n].item_id, dist, len(m.items[n].text), start, end))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "item_id", "distance", "item_chars", "start", "end"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def decontaminated(docs: DataFrame, items: DataFrame, rate: float = RATE, min_chars: int = MIN_CHARS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` without the rows whose text holds a test item; each block filters in the scan, without a shuffle."""
    at, schema = docs.columns.index("text"), docs.schema
    for block in blocks(items, rate, min_chars, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            m = Matcher(shared.value, rate)
            for b in batches:
                yield b.filter(pa.array([not m.matches(normalised(t.as_py())) for t in b.column(at)], pa.bool_()))

        docs = docs.mapInArrow(run, schema)
    return docs
