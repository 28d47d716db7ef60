"""The registered formats: typed rows of landed answers, files left out by the key, filters on rows, licensed slots."""

import pytest
from pyspark.sql import functions as F

from attestor.sources import format, landing

NODES = [
    {"id": 1, "evidenceType": "PREDICTIVE", "evidenceLevel": "A", "evidenceDirection": "SUPPORTS", "significance": "SENSITIVITY", "evidenceRating": 5, "status": "ACCEPTED", "molecularProfile": {"name": "EGFR L858R"}, "disease": {"name": "Lung cancer"}, "therapies": [{"name": "Drug"}]},
    {"id": 2, "evidenceType": "PROGNOSTIC", "evidenceLevel": "B", "status": "SUBMITTED", "molecularProfile": {"name": "EGFR L858R"}, "more": {"unknown": [1]}},
    {"id": 3, "evidenceType": "PREDICTIVE", "evidenceLevel": "C", "status": "ACCEPTED", "molecularProfile": {"name": "KRAS G12C"}},
    {"id": 4, "evidenceType": "PREDICTIVE", "evidenceLevel": "C", "status": "ACCEPTED", "molecularProfile": {"name": "a/b=c d"}},
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    import json

    top = tmp_path_factory.mktemp("landed")
    (top / "nodes.json").write_text("\n".join(json.dumps(n) for n in NODES))
    raw = spark.read.schema(landing.EVIDENCE + ", more STRUCT<unknown: ARRAY<INT>>").json(str(top / "nodes.json"))
    path = str(top / "evidence")
    format.land(raw, path, F.regexp_extract("molecularProfile.name", r"^([^ ]+)", 1))
    format.register(spark)
    return path


def read(spark, folder):
    return spark.read.format("attestor_evidence").load(folder)


def test_rows_come_back_typed(spark, folder):
    rows = {r.id: r for r in read(spark, folder).collect()}
    assert set(rows) == {1, 2, 3, 4}
    assert rows[1].key == "EGFR" and rows[1].therapies[0].name == "Drug" and rows[1].molecularProfile.name == "EGFR L858R"
    assert rows[2].evidenceRating is None and rows[2].disease is None and rows[4].key == "a/b=c"


def test_filters_on_the_key_leave_files_out(spark, folder):
    parts = lambda df: df.rdd.getNumPartitions()
    whole = read(spark, folder)
    assert parts(whole) == 3
    one = whole.where("key = 'EGFR'")
    assert parts(one) == 1 and {r.id for r in one.collect()} == {1, 2}
    two = whole.where(F.col("key").isin("KRAS", "a/b=c", "none"))
    assert parts(two) == 2 and {r.id for r in two.collect()} == {3, 4}
    assert whole.where("key = 'none'").collect() == [] and whole.where("key is null").collect() == []
    assert {r.id for r in whole.where("key > 'L'").collect()} == {4}  # not pushed: Spark filters


def test_filters_on_rows_are_exact(spark, folder):
    whole = read(spark, folder)
    assert {r.id for r in whole.where("status = 'ACCEPTED' and evidenceLevel = 'C'").collect()} == {3, 4}
    assert {r.id for r in whole.where("id in (1, 3) and key = 'EGFR'").collect()} == {1}
    assert {r.id for r in whole.where("not (status = 'ACCEPTED')").collect()} == {2}
    assert {r.id for r in whole.where("evidenceRating = 5").collect()} == {1}


def test_retrieval_reads_the_genes_asked_for_only(spark, folder):
    asked = spark.createDataFrame([("q", "EGFR", "L858R", "lung"), ("r", "BRAF", "V600E", "lung")], "query_id string, gene string, variant string, tumor string")
    got = format.retrieved_from(spark, "somatic_evidence", folder, asked)
    assert [(r.query_id, r.citation_id, r["rank"]) for r in got.collect()] == [("q", "civic:EID1", 1)]
    assert format.opened(spark, "somatic_evidence", folder, ["EGFR"]).rdd.getNumPartitions() == 1
    with pytest.raises(TypeError):
        format.retrieved_from(spark, "cases", folder, asked)


def test_more_genes_than_a_filter_holds_are_joined(spark, folder, monkeypatch):
    monkeypatch.setattr(format, "FEW_KEYS", 1)
    asked = spark.createDataFrame([("q", "EGFR", "L858R", "lung"), ("r", "KRAS", "G12C", "lung")], "query_id string, gene string, variant string, tumor string")
    assert {r.citation_id for r in format.retrieved_from(spark, "somatic_evidence", folder, asked).collect()} == {"civic:EID1", "civic:EID3"}


def test_cases_and_germline_records(spark, tmp_path):
    raw = spark.createDataFrame([("s1", "x", "EGFR", "[Not Available]"), ("s2", "y", "KRAS", "G12C")], "studyId string, sampleId string, hugoGeneSymbol string, proteinChange string")
    format.land(raw, str(tmp_path / "cases"), F.col("studyId"))
    cases = format.opened(spark, "cases", str(tmp_path / "cases"), ["s1"])
    assert cases.rdd.getNumPartitions() == 1
    assert [(r.study_id, r.gene_symbol, r.protein_change) for r in cases.collect()] == [("s1", "EGFR", None)]
    clinical = spark.sql("SELECT '12' AS uid, '' AS accession, 'EGFR p.Leu858Arg' AS title, array(named_struct('symbol', 'EGFR', 'geneid', '1')) AS genes, named_struct('description', 'Pathogenic') AS germline_classification")
    format.land(clinical, str(tmp_path / "germline"), F.get("genes", 0)["symbol"])
    asked = spark.createDataFrame([("q", "EGFR", "L858R", "lung")], "query_id string, gene string, variant string, tumor string")
    got = format.retrieved_from(spark, "germline_records", str(tmp_path / "germline"), asked).collect()
    assert [(r.query_id, r.accession, r.germline) for r in got] == [("q", "VCV000000012", "Pathogenic")]


def test_licensed_slots_raise(spark, tmp_path):
    format.register(spark)
    with pytest.raises(Exception, match="no data under"):
        spark.read.format("attestor_guideline_network").load(str(tmp_path / "nothing"))
    (tmp_path / "full").mkdir()
    (tmp_path / "full" / "a").write_text("x")
    with pytest.raises(Exception, match="no reader is defined"):
        spark.read.format("attestor_guideline_network").load(str(tmp_path / "full"))


def test_titles_found_by_number_are_those_that_contain_the_term(spark):
    from attestor.operators import evidence

    titles = ["NM(EGFR):c.2573T>G (p.Leu858Arg)", "p.Leu8585Arg", "p.Leu858Argfs", "Leu858 and Leu858Arg 858", "amplification of EGFR", "exon 20 insertion", "20", None, ""]
    records = spark.createDataFrame([(i, g, t) for g in ("EGFR", "KRAS") for i, t in enumerate(titles)], "id int, gene string, title string")
    terms = ["Leu858Arg", "Leu858", "858", "amplification", "exon 20 ins", "exon 20", "L858R", "u8585A"]
    asked = spark.createDataFrame([("EGFR", t) for t in terms], "_gene string, _term string")
    got = sorted((r._term, r.id, r.gene) for r in evidence.titled(records, asked).collect())
    assert got == sorted((t, i, "EGFR") for t in terms for i, x in enumerate(titles) if x and t in x)
    plan = evidence.titled(records, asked.where("_term = 'Leu858Arg'"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan
