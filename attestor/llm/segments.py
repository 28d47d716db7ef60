"""Cutting text where tokenizers provably can't merge across, and tokens of the pieces.

A cut stands before a run of white space that begins with one of ``starts`` and follows a character that no tokenizer takes for white
space. Whether a vocabulary allows such a cut is read off its entries: none may hold that white space character behind a character that
isn't white space (``byte_starts``, ``piece_starts``).
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters that some tokenizer may take for white space (with the mark that stands for a space in pieces).
WHITE = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace()) + "᠎​⁠﻿▁"

#: White space before which cuts are tried.
CANDIDATES = " \n\t"

SPACE = "▁"

#: Texts given to a tokenizer at once: what it returns takes some hundred bytes a token.
AT_ONCE = 4


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable Latin-1 for itself, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def byte_tokens(tokenizer_json: str) -> dict[int, bytes]:
    """The bytes of each id of a byte-level vocabulary; special tokens as they are written."""
    spec, alphabet = json.loads(tokenizer_json), byte_alphabet()
    out = {i: bytes(alphabet[c] for c in t) for t, i in spec["model"]["vocab"].items() if all(c in alphabet for c in t)}
    return out | {t["id"]: t["content"].encode() for t in spec["added_tokens"]}


def piece_tokens(processor) -> dict[int, bytes]:
    """The bytes of each piece: byte pieces as that byte, others in UTF-8 with the space mark as a space."""
    out = {}
    for i in range(processor.get_piece_size()):
        p = processor.id_to_piece(i)
        out[i] = bytes([int(p[3:-1], 16)]) if processor.is_byte(i) else p.replace(SPACE, " ").encode()
    return out


def byte_starts(tokens: Iterable[bytes]) -> str:
    """The candidates that no token holds behind a character that isn't white space (part of a character counts as such)."""
    bad = set()
    for t in tokens:
        text = t.decode("utf-8", "replace")
        bad |= {b for a, b in zip(text, text[1:], strict=False) if b in CANDIDATES and a not in WHITE}
    return "".join(c for c in CANDIDATES if c not in bad)


def piece_starts(processor) -> str:
    """The candidates before which pieces never merge: the space if no piece has it behind another character, others if no piece holds them but at its start."""
    bad = set()
    for i in range(processor.get_piece_size()):
        if not (processor.is_byte(i) or processor.is_control(i) or processor.is_unknown(i)):
            p = processor.id_to_piece(i)
            bad |= {" " for a, b in zip(p, p[1:], strict=False) if b == SPACE and a not in WHITE} | {c for c in p[1:] if c in CANDIDATES}
    return "".join(c for c in CANDIDATES if c not in bad)


def cutter(starts: str):
    """A function from a text to its segments; joined, they are the text."""
    if not starts:
        return lambda text: [text] if text else []
    white = re.escape(WHITE)
    held = re.escape("".join(c for c in WHITE if c not in starts))
    return re.compile(f"[{white}]*[^{white}]+(?:[{held}][{white}]*[^{white}]*)*|[{white}]+").findall


class Cutter:
    """Cuts whole columns of texts; ``dictionary`` numbers the distinct segments.

    Texts in which single white space characters stand between others are marked and split by Arrow, others (runs of white space, white
    space at the start, NUL) one by one.
    """

    MARK = "\0"

    def __init__(self, starts: str):
        self.starts, self.cut = starts, cutter(starts)
        white, own = ("[" + "".join(f"\\x{{{ord(c):x}}}" for c in x) + "]" for x in (WHITE, starts or " "))
        self.odd = f"{white}{own}|^{own}|\\x00|^$"

    def lists(self, texts: pa.Array, prefix: str = "") -> pa.ListArray:
        """The segments of each text with ``prefix`` (white space or nothing) before it; null and empty texts have none."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, self.odd) if self.starts else pa.array([True] * len(texts))
        plain = pc.filter(texts, pc.invert(odd))
        for c in self.starts:
            plain = pc.replace_substring(plain, c, self.MARK + c)
        even = pc.split_pattern(pc.binary_join_element_wise(prefix, plain, ""), self.MARK)
        rest = pa.array([self.cut(prefix + t) if t else [] for t in pc.filter(texts, odd).to_pylist()], even.type)
        order = np.argsort(np.asarray(odd), kind="stable")
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return pa.concat_arrays([even, rest]).take(pa.array(back))

    def dictionary(self, texts: pa.Array, prefix: str = "") -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """(numbers of all segments in a row, the distinct segments, the number of segments before each text, with the total last)"""
        lists = self.lists(texts, prefix)
        flat = lists.flatten().dictionary_encode()
        bounds = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(lists), np.int64))]).astype(np.int64)
        return flat.indices.to_numpy(zero_copy_only=False), flat.dictionary, bounds


class Memo:
    """Segments met so far, as one Arrow array, with their ids as rows of one flat array.

    What ``most`` segments and ``chars`` bytes leave no room for is encoded once for each call and not kept; frequent segments come early, and stay.
    """

    def __init__(self, encode, most: int = 1_500_000, chars: int = 20_000_000):
        self.encode, self.most, self.chars = encode, most, chars
        self.known = pa.array([], pa.string())
        self.start, self.size, self.ids = np.zeros(1024, np.int64), np.zeros(1024, np.int32), np.zeros(8192, np.int32)
        self.used, self.held = 0, 0

    def __len__(self) -> int:
        return len(self.known)

    def rows_of(self, distinct: pa.Array) -> np.ndarray:
        """The rows of the segments ``distinct``, good until the next call."""
        rows = pc.fill_null(pc.index_in(distinct, self.known), -1).to_numpy().astype(np.int64)
        unknown = np.flatnonzero(rows < 0)
        if len(unknown):
            new = distinct.take(pa.array(unknown))
            sizes, ids = self.encode(new)
            lo, hi = len(self), len(self) + len(unknown)
            self.start, self.size, self.ids = (_room(a, n) for a, n in ((self.start, hi), (self.size, hi), (self.ids, self.used + len(ids))))
            self.size[lo:hi], self.start[lo:hi] = sizes, self.used + np.cumsum(sizes) - sizes
            self.ids[self.used : self.used + len(ids)] = ids
            rows[unknown] = np.arange(lo, hi)
            if lo < self.most and self.held < self.chars:
                kept = new.slice(0, self.most - lo)
                self.known = pa.concat_arrays([self.known, kept])
                self.held += pc.sum(pc.binary_length(kept)).as_py()
                self.used = int(self.start[len(self) - 1] + self.size[len(self) - 1])
        return rows

    def taken(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the segments of ``rows`` in a row, and the number of ids before each, with the total last."""
        size = self.size[rows]
        ends = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        return self.ids[np.arange(ends[-1]) + np.repeat(self.start[rows] - ends[:-1], size)], ends

    def ids_of(self, distinct: pa.Array, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``taken`` of the segments ``distinct[number]`` in a row."""
        return self.taken(self.rows_of(distinct)[numbers])


def _room(a: np.ndarray, n: int) -> np.ndarray:
    return a if n <= len(a) else np.concatenate([a, np.zeros(max(n, 3 * len(a) // 2) - len(a), a.dtype)])


def encoder(tokenizer, tokens: dict[int, bytes], starts: str, size: int = 200_000):
    """A function from segments to (number of ids of each, all ids in a row) by a byte-level tokenizer of the tokenizers library.

    Segments that can stand next to each other (cut before one of ``starts``, after a character that isn't white space) are encoded as one text
    of about ``size`` bytes, whose ids are dealt out by the bytes they stand for; a segment that can't begins a text of its own.
    """
    length = np.zeros(max(tokens, default=0) + 1, np.int64)
    for i, t in tokens.items():
        length[i] = len(t)
    white = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in WHITE) + "]$"

    def run(segments: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ends = np.cumsum(np.asarray(pc.binary_length(segments), np.int64))
        first = pc.fill_null(pc.index_in(pc.utf8_slice_codeunits(segments, 0, 1), pa.array(list(starts), pa.string())), -1).to_numpy() >= 0
        last = ~np.asarray(pc.match_substring_regex(segments, white))
        apart = np.diff(ends // size, prepend=0) > 0
        apart[0] = True
        apart[1:] |= ~(first[1:] & last[:-1])
        begin = np.append(np.flatnonzero(apart), len(segments)).astype(np.int32)
        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(begin), segments), "").to_pylist()
        sizes, ids = np.zeros(len(segments), np.int64), []
        encoded = (e for i in range(0, len(texts), AT_ONCE) for e in tokenizer.encode_batch_fast(texts[i : i + AT_ONCE], add_special_tokens=False))
        for lo, hi, e in zip(begin, begin[1:], encoded, strict=False):
            own = np.array(e.ids, np.int32)
            ids.append(own)
            sizes[lo:hi] = len(own) if hi == lo + 1 else np.diff(np.searchsorted(np.cumsum(length[own]), ends[lo:hi] - (ends[lo - 1] if lo else 0), side="right"), prepend=0)
        return sizes, np.concatenate(ids)

    return run


def slices(texts, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of an Arrow column, of about ``size`` bytes each."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64))
    lo = 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + size)) + 1)
        yield lo, min(hi, len(ends))
        lo = hi
