"""Names of a vocabulary table found in texts, all names at a time: Aho-Corasick automata over blocks of the vocabulary, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.session import stored

#: Characters of a block of names; each block is one automaton and one pass over the texts.
BLOCK = 8_000_000


def _found(names: list[str], spark):
    """A function over batches (key, lower-case text) that gives the names of each text, a row each."""
    shared = spark.sparkContext.broadcast(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for n in shared.value:
            automaton.add_word(n, n)
        automaton.make_automaton()
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                own = [sorted({n for _, n in automaton.iter(t)}) if t else [] for t in b.column(1).slice(lo, 1000).to_pylist()]
                rows = np.repeat(np.arange(len(own)), [len(x) for x in own])
                yield pa.record_batch([b.column(0).slice(lo, 1000).take(pa.array(rows)), pa.array([n for x in own for n in x], pa.string())], names=["key", "low"])

    return run


def names_in_texts(texts: DataFrame, vocabulary: DataFrame, key: str, text: str, name: str = "name", block: int = BLOCK) -> DataFrame:
    """(key, name): each name of ``vocabulary`` that a text contains, in any case; the table form of ``functions.text.names_in``.

    Null and empty names and texts have no match. Names that differ in case only are all found, and a text that holds a name often has it once; rows of one key
    count together. The vocabulary goes in blocks of about ``block`` characters by a hash of the names, so no automaton grows with it; each is one pass over the texts.
    """
    spark = texts.sparkSession
    names = stored(vocabulary.where(F.length(name) > 0).select(F.col(name).alias("name"), F.lower(name).alias("low")).distinct())
    low = names.select("low").distinct()
    blocks = max(1, -(-(low.agg(F.sum(F.length("low"))).first()[0] or 0) // block))
    own = texts.select(F.col(key).alias("key"), F.lower(text).alias("text"))
    kind = own.schema["key"].dataType.simpleString()
    out = None
    for i in range(blocks):
        part = [r.low for r in low.where(F.pmod(F.xxhash64("low"), F.lit(blocks)) == i).collect()]  # about ``block`` characters
        if part:
            found = own.mapInArrow(_found(part, spark), f"key {kind}, low string")
            out = found if out is None else out.unionAll(found)
    if out is None:
        out = own.select("key", F.lit("").alias("low")).limit(0)
    return out.distinct().join(names, "low").select(F.col("key").alias(key), "name")
