"""Compression classifier for quality.

One zstandard dictionary is trained on good and one on bad labelled text. A text is compressed with each, in blocks so
that the dictionary counts throughout a long text; the difference of the compressed sizes, normalised by their sum, and
the sizes normalised by the text's become a probability by logistic calibration on labelled texts that the dictionaries have not seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm.langid import labelled_sample, remainder

BLOCK = 1024
FEATURES = 13


def dictionary(texts: list[bytes], size: int) -> bytes:
    """A trained dictionary; where there is too little text to train on, the text itself."""
    pieces = [t[i : i + BLOCK] for t in texts for i in range(0, len(t), BLOCK)]
    try:
        return zstandard.train_dictionary(size, pieces, k=256, d=8, steps=1).as_bytes() if len(pieces) >= 16 else b"".join(pieces)[-size:]
    except zstandard.ZstdError:
        return b"".join(pieces)[-size:]


class CompressionModel:
    def __init__(self, good: bytes, bad: bytes, level: int = 3):
        self.dictionaries, self.level = (good, bad), level
        self.weights = np.zeros(FEATURES)
        self._tools = None

    def __getstate__(self):
        return self.__dict__ | {"_tools": None}

    def _compressors(self) -> list:
        if self._tools is None:
            dicts = [zstandard.ZstdCompressionDict(d) for d in self.dictionaries]
            for d in dicts:
                if len(d):
                    d.precompute_compress(level=self.level)
            bare = {"level": self.level, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
            self._tools = [zstandard.ZstdCompressor(dict_data=d, **bare) if len(d) else zstandard.ZstdCompressor(**bare) for d in dicts] + [zstandard.ZstdCompressor(**bare)]
        return self._tools

    def sizes(self, text: bytes) -> np.ndarray:
        """A row for each block: its size with the good dictionary, with the bad one, with none, and as it is."""
        blocks = [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)]
        if len(blocks) > 1 and len(blocks[-1]) < BLOCK // 8:
            blocks[-2:] = [blocks[-2] + blocks[-1]]
        return np.array([[*(len(c.compress(b)) for c in self._compressors()), len(b)] for b in blocks], dtype=float)

    def features(self, text: str | None) -> list[float]:
        """A constant, the normalised difference and sizes of the whole text, and those of its worst block."""
        t = (text or "").encode("utf-8", "replace")
        if not t:
            return [1.0] + [0.0] * (FEATURES - 1)
        z = self.sizes(t)
        g, b, n, k = z.sum(axis=0)
        d, n_g, n_b, n_n = (b - g) / (b + g), g / k, b / k, n / k
        worst, least = ((z[:, 1] - z[:, 0]) / (z[:, 0] + z[:, 1])).min(), (z[:, 2] / z[:, 3]).min()
        size = float(np.log1p(k))
        return [1.0, 10 * d, n_g, n_b, n_n, 10 * d * min(1.0, k / 500), 4 * n_g * n_g, 4 * n_n * n_n, 40 * d * n_n, 10 * worst, 4 * least, size / 5, size * d]

    def calibrate(self, texts: list[str], labels: list[int], share: dict[int, float] | None = None, ridge: float = 0.05, rounds: int = 40) -> None:
        """Logistic regression by Newton steps. ``share``: of each class among all labels, which the texts are weighted to."""
        if not texts:
            return
        x, y = np.array([self.features(t) for t in texts]), np.array(labels, dtype=float)
        own = {k: float(np.mean(y == k)) for k in (0, 1)}
        c = np.array([(share or own)[int(k)] / own[int(k)] for k in y])
        w = np.zeros(x.shape[1])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (c * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (c * (y - p)) - ridge * w)
            w += step
            if abs(step).max() < 1e-9:
                break
        self.weights = w

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(np.dot(self.features(text), self.weights), -30, 30))))


def train(docs: DataFrame, labels: DataFrame, keep=None, max_docs: int = 4000, max_chars: int = 16_000_000, dictionary_bytes: int = 131_072) -> CompressionModel:
    """Learn from documents with a quality label for which ``keep`` holds: at most ``max_docs`` and ``max_chars``, up to half
    of them of the rarer class.

    One half of them (by order) goes into the dictionaries, the other calibrates. Of several labels of a document the
    largest counts; null labels are left out.
    """
    marks = labels.where("quality is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
    if keep is not None:
        marks = marks.where(keep)
    marks = marks.groupBy("doc_id").agg((F.max("quality") > 0).cast("int").alias("quality"))
    # the labels' ids come first, so that the documents are only filtered by a bounded list, never joined
    n = {r.quality: r["count"] for r in marks.groupBy("quality").count().collect()}
    chosen: dict[int, int] = {}
    for q in sorted(n, key=n.get):  # the rarer class first; what it leaves of its half goes to the other
        room = max_docs // 2 if len(n) > 1 and not chosen else max_docs - len(chosen)
        order = F.xxhash64(F.col("doc_id").cast("string"))
        chosen |= {r.doc_id: q for r in marks.where(F.col("quality") == q).orderBy(order, "doc_id").limit(room).collect()}
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isin(list(chosen)))
    rows = labelled_sample(own, None, max_docs, max_chars)
    rows.sort(key=lambda r: (r.doc_id * 2654435761 % 4294967296, r.doc_id))
    build, rest = rows[::2], rows[1::2]
    own = [[r.text.encode("utf-8", "replace") for r in build if chosen[r.doc_id] == q] for q in (1, 0)]
    model = CompressionModel(*(dictionary(t, dictionary_bytes) if t else b"" for t in own))
    model.calibrate([r.text for r in rest], [chosen[r.doc_id] for r in rest], {q: v / sum(n.values()) for q, v in n.items()})
    return model


def scored(docs: DataFrame, model: CompressionModel) -> DataFrame:
    """(doc_id, score) for each row; null counts as the empty text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([model.score(t.as_py()) for t in b.column(1)], pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def classified(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **bounds: int) -> DataFrame:
    """(doc_id, held_out, score, predicted): learns where the remainder by 5 is not 0, scores every row.

    A null doc_id is never learned from and counts as not held out; without labels every score is 0.5.
    """
    out = scored(docs, train(docs, labels, remainder(5) != 0, **bounds))
    return out.select("doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **bounds: int) -> DataFrame:
    """``docs`` without the rows that the classifier rejects. The text is scored in the scan: no join, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, remainder(5) != 0, **bounds))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            yield b.filter(pa.array([model.score(t.as_py()) >= threshold for t in b.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
