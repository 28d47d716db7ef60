"""Names found by automata against the array form, over one block and several."""

import random

import pytest
from pyspark.sql import functions as F

from attestor.functions import text as T
from attestor.operators import matcher


@pytest.mark.parametrize("block", [8_000_000, 20])
def test_tables_and_arrays_give_the_same(spark, block):
    rng = random.Random(1)
    names = ["ab", "AB", "abc", "bca", "Ünï", "a b", "zzz", "c.c", None, ""] + ["".join(rng.choice("abc") for _ in range(rng.randint(2, 5))) for _ in range(20)]
    texts = [(i, "".join(rng.choice("aAbBcC. ünÏ") for _ in range(rng.randint(0, 40)))) for i in range(120)] + [(900, None), (901, ""), (902, "xx ÜNÏ xx"), (902, "zzz")]
    df = spark.createDataFrame(texts, "id int, text string").repartition(3)
    vocabulary = spark.createDataFrame([(n,) for n in names], "name string")
    got = {(r.id, r.name) for r in matcher.names_in_texts(df, vocabulary, "id", "text", block=block).collect()}
    listed = F.array(*(F.lit(n) for n in sorted({n for n in names if n})))
    want = {(r.id, n) for r in df.where("text is not null").select("id", T.names_in("text", listed).alias("n")).collect() for n in r.n}
    assert got == want and (902, "Ünï") in got and (902, "zzz") in got


def test_nothing_to_find(spark):
    df = spark.createDataFrame([("k", "text")], "id string, text string")
    none = spark.createDataFrame([(None,)], "name string")
    assert matcher.names_in_texts(df, none, "id", "text").collect() == []
    some = spark.createDataFrame([("tex",)], "name string")
    assert matcher.names_in_texts(df.limit(0), some, "id", "text").collect() == []
    assert [tuple(r) for r in matcher.names_in_texts(df, some, "id", "text").collect()] == [("k", "tex")]
