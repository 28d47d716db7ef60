"""Language ID with word-first backoff.

A known word adds its per-language log frequency. An unseen word is cut into character n-grams, longest first: at each
place the longest known n-gram adds its log frequency, discounted for each step of backoff (a stupid backoff over
n = ``max_n`` .. 1). The model is a bounded table: the ``max_words`` most frequent words and ``max_grams`` most frequent
n-grams over a bounded sample of labelled documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W\d_]+")
LETTER = regex.compile(r"\p{L}")


class LanguageModel:
    """Per-language log frequencies of words and of character n-grams (with ``^`` and ``$`` at word ends)."""

    def __init__(self, counts: dict[str, Counter], max_words: int, max_grams: int, max_n: int, discount: float = math.log(0.4)):
        self.langs = sorted(counts)
        self.max_n, self.discount = max_n, discount
        grams: dict[str, Counter] = {x: Counter() for x in self.langs}
        for lang, words in counts.items():
            for w, c in words.items():
                for g in self._grams(w):
                    grams[lang][g] += c
        self.words = self._table(counts, max_words)
        self.grams = self._table(grams, max_grams)
        self.none = [math.log(1e-6)] * len(self.langs)

    def _grams(self, word: str) -> list[str]:
        w = f"^{word}$"
        return [w[i : i + n] for n in range(1, self.max_n + 1) for i in range(len(w) - n + 1)]

    def _table(self, counts: dict[str, Counter], most: int) -> dict[str, list[float]]:
        total = Counter()
        for c in counts.values():
            total.update(c)
        keep = [k for k, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:most]]
        size = {lang: sum(counts[lang].values()) + 0.5 * len(keep) for lang in self.langs}
        return {k: [math.log((counts[lang][k] + 0.5) / size[lang]) for lang in self.langs] for k in keep}

    def word(self, word: str) -> list[float]:
        known = self.words.get(word)
        if known:
            return known
        w, i, out = f"^{word}$", 0, [0.0] * len(self.langs)
        while i < len(w):
            for n in range(min(self.max_n, len(w) - i), 0, -1):
                g = self.grams.get(w[i : i + n])
                if g:
                    break
            g, back = g or self.none, self.discount * (self.max_n - n)
            out = [a + b + back for a, b in zip(out, g, strict=True)]
            i += n
        return out

    def scored(self, text: str, rows: WordRows) -> tuple[str, float]:
        total = rows.total(WORD.findall(text.lower()))
        at = int(total.argmax())
        return self.langs[at], float(1 / np.exp(total - total[at]).sum())


class WordRows(dict):
    """Words met so far, as rows of a table of scores; a bounded memo that starts anew when it is full."""

    def __init__(self, model: LanguageModel, most: int = 200_000):
        self.model, self.most = model, most
        self.table = np.zeros((most, len(model.langs)))

    def __missing__(self, word: str) -> int:
        at = len(self)
        self.table[at] = self.model.word(word)
        self[word] = at
        return at

    def total(self, words: list[str]) -> np.ndarray:
        """The sum of the words' scores."""
        out = np.zeros(self.table.shape[1])
        for lo in range(0, len(words), 50_000):
            part = words[lo : lo + 50_000]
            if len(self) + len(part) > self.most:
                self.clear()
            out += self.table[[self[w] for w in part]].sum(axis=0)
        return out


def words_of(text: str) -> Counter:
    return Counter(WORD.findall(text.lower()))


def labelled_sample(docs: DataFrame, keep, max_docs: int, max_chars: int, *label: str) -> list:
    """At most ``max_docs`` rows and ``max_chars`` characters of whole labelled texts, in the order of a hash of doc_id."""
    pool = (docs if keep is None else docs.where(keep)).where("doc_id is not null and text is not null and length(text) > 0")
    order = pool.select("doc_id", F.length("text").alias("n")).orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(max_docs).collect()
    ids, left = [], max_chars
    for r in order:
        if r.n <= left:
            ids.append(r.doc_id)
            left -= r.n
    rows = pool.where(F.col("doc_id").isin(ids)).select("doc_id", "text", *label).collect() if ids else []
    return sorted(rows, key=lambda r: (r.doc_id, r.text))


def train(docs: DataFrame, keep=None, max_docs: int = 3000, max_chars: int = 12_000_000, max_words: int = 40_000, max_grams: int = 60_000, max_n: int = 5) -> LanguageModel:
    """Learn from rows of (doc_id, text, lang) for which ``keep`` holds (all: None) and lang is not null."""
    counts: dict[str, Counter] = {}
    for r in labelled_sample(docs.where("lang is not null"), keep, max_docs, max_chars, "lang"):
        counts.setdefault(r.lang, Counter()).update(words_of(r.text))
    return LanguageModel(counts, max_words, max_grams, max_n)


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang_pred, score) for each row: the most probable language and its posterior under equal priors.

    ``und`` and 0.0 if the text is null, has no letter, or nothing was learned.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        rows = WordRows(model)
        for b in batches:
            out = []
            for t in b.column(1):
                text = t.as_py()
                if text is None or not model.langs or not LETTER.search(text):
                    out.append(("und", 0.0))
                else:
                    out.append(model.scored(text, rows))
            yield pa.record_batch([b.column(0), pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def remainder(modulus: int):
    """crc32 of doc_id as text, modulo ``modulus``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def identified(docs: DataFrame, **bounds: int) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learns from rows whose remainder by 4 is not 2, predicts every row.

    A null doc_id is never learned from and counts as not held out. An empty table gives an empty result.
    """
    out = predict(docs, train(docs, remainder(4) != 2, **bounds))
    return out.select("doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
