"""Small tables for the training-data operators."""

import random

WORDS = [a + b for a in ("ka", "to", "mi", "re", "su", "lo", "ne", "vi") for b in ("ra", "den", "pol", "sek", "tum", "gal")]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, h1 string, rate string, _k int"


def prose(rng, n):
    out = []
    for i in range(n):
        out.append(rng.choice(WORDS) + ("." if rng.random() < 0.1 else ""))
        if rng.random() < 0.05:
            out[-1] += "\n"
    return " ".join(out)


def documents(spark, rows):
    """Rows of (doc_id, text) or (doc_id, text, lang, source), with columns whose names clash with internal ones."""
    full = [(r[0], r[1], *(r[2:4] if len(r) > 2 else ("en", "s")), len(r[1]) if r[1] else 0, "x", "y", 1) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def awkward(rng=None):
    """Null ids and texts, empty and blank texts, ties, repeated rows, a long text, text that isn't ASCII."""
    rng = rng or random.Random(0)
    long = prose(rng, 6000)
    return [(None, "a line of a document without an id, long enough to be kept"), (1, None), (2, ""), (3, " \t\n\x0b "), (4, long), (4, long), (5, "é ü \U0001f600 ñ"), (6, "one"), (7, "one"), (-8, prose(rng, 80))]
