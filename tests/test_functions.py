import pytest
from pyspark.sql import functions as F

from attestor.functions import text as T


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f("v").alias("r")).first().r


@pytest.mark.parametrize(("raw", "want"), [(".", None), (" NA ", None), ("[Not Available]", None), (" Kept ", "Kept"), ("", None), (None, None), (" . ", None)])
def test_normalize_missing(spark, raw, want):
    assert one(spark, raw, T.normalize_missing) == want


@pytest.mark.parametrize(("raw", "want"), [("hg19", "GRCh37"), ("GRCh37 ", "GRCh37"), ("38", "GRCh38"), ("other", "OTHER"), (".", None)])
def test_canonical_build(spark, raw, want):
    assert one(spark, raw, T.canonical_build) == want


@pytest.mark.parametrize(
    ("raw", "want"),
    [(None, "empty"), ("Q5*", "nonsense"), ("R5Ter", "nonsense"), ("K9Vfs*7", "frameshift"), ("X3_SPLICE", "splice"), ("E7del", "indel"), ("K11R", "substitution"), ("M1=", "substitution"), ("amp", "other"), ("K9fs*", "nonsense")],
)
def test_protein_consequence_takes_the_first_rule(spark, raw, want):
    assert one(spark, raw, T.protein_consequence) == want


@pytest.mark.parametrize(
    ("raw", "want"),
    [("p.Leu858Arg", "L858R"), ("p.(Gly12Asp)", "G12D"), ("Leu747_Pro753delinsSer", "L747_P753delinsS"), ("V600E", "V600E"), (" P.Arg5Ter ", "R5*"), ("Alarg", "Arg"), ("Metabolic", "Mabolic")],
)
def test_three_to_one_is_one_pass(spark, raw, want):
    assert one(spark, raw, T.three_to_one) == want
    if raw != "Alarg":
        assert one(spark, want, T.three_to_one) == want.replace("Arg", "R")


def test_one_to_three_only_for_substitutions(spark):
    assert one(spark, "L858R", T.one_to_three) == "p.Leu858Arg"
    assert one(spark, "Q61*", T.one_to_three) == "p.Gln61Ter"
    assert one(spark, "E7del", T.one_to_three) is None
    assert one(spark, "U6R", T.one_to_three) is None
    assert one(spark, "L858R", T.is_substitution) is True


def test_origin_is_three_valued(spark):
    assert [one(spark, x, T.origin_is_somatic) for x in ("GERMLINE_SOMATIC", "Somatic", "unknown", None)] == [False, True, None, None]


def test_claims(spark):
    assert one(spark, "It responds to the drug", T.claim_direction) == "SENSITIVITY"
    assert one(spark, "resistance was seen", T.claim_direction) == "RESISTANCE"
    assert one(spark, "no benefit although effective", T.claim_direction) is None
    assert one(spark, "nothing said", T.claim_direction) is None
    df = spark.createDataFrame([("SENSITIVITYRESPONSE", "DOES_NOT_SUPPORT"), ("RESISTANCE", "SUPPORTS"), ("OTHER", None)], "s string, d string")
    assert [r.x for r in df.select(T.record_direction("s", "d").alias("x")).collect()] == ["RESISTANCE", "RESISTANCE", None]


def test_clean_recommendation(spark):
    df = spark.createDataFrame([(["First-line drug a and consider drug b (daily) [CITE: x:1]", " ; "],)], "r array<string>")
    assert df.select(T.clean_recommendation(F.col("r")).alias("x")).first().x == ["drug a", "drug b"]


def test_tokens(spark):
    assert one(spark, "Ab-c 12, été", T.tokenize) == ["ab", "c", "12", "t"]
    assert set(one(spark, "Lung été of it", T.token_set)) == {"lung", "été"}
    assert one(spark, "a\n b \n\n", T.last_line) == "b"
