import json

import pytest
from pyspark.sql import functions as F

from attestor.sources import files, landing, registry
from attestor.streaming import reliability


def land(tmp_path, name, rows):
    p = tmp_path / name
    p.write_text("\n".join(json.dumps(r) for r in rows))
    return str(p)


def test_mutations_are_flattened(spark, tmp_path):
    raw = [{"studyId": "s", "sampleId": "a", "patientId": "p", "gene": {"hugoGeneSymbol": "G1"}, "entrezGeneId": 7, "proteinChange": "K1R", "mutationType": ".", "ncbiBuild": "GRCh37", "mutationStatus": "."}]
    df = landing.mutation_records(spark, land(tmp_path, "m.json", raw))
    r = df.first()
    assert (r.gene_symbol, r.protein_change, r.mutation_type, r.mutation_status) == ("G1", "K1R", None, None)
    assert landing.fetched_mutations(df, "s", [7]).count() == 1 and landing.fetched_mutations(df, "s", [8]).count() == 0


def test_evidence_and_germline_records(spark, tmp_path):
    node = {"id": 5, "evidenceType": "PREDICTIVE", "evidenceLevel": "A", "evidenceDirection": "SUPPORTS", "significance": "SENSITIVITY_X", "evidenceRating": 4, "status": "ACCEPTED", "variantOrigin": "SOMATIC", "therapies": [{"name": "d1"}, {"name": "d2"}], "disease": {"name": "lung", "doid": "1"}, "molecularProfile": {"name": "G1 K1R", "variants": [{"id": 1, "alleleRegistryId": "CA1", "clinvarIds": ["9", "3"], "hgvsDescriptions": ["h"]}]}}
    r = landing.evidence_nodes(spark, land(tmp_path, "e.json", [node])).first()
    assert r.summary == "G1 K1R: SUPPORTS SENSITIVITY X to d1 + d2 in lung (CIViC level A, rating 4)"
    assert (r.ids.caid, r.ids.clinvar_ids, r.is_somatic, r.kind) == ("CA1", ["3", "9"], True, "predictive")
    rows = [{"uid": "12", "germline_classification": {"description": "Pathogenic"}}, {"uid": "13", "germline_classification": {"description": ""}}]
    got = landing.clinical_records(spark, land(tmp_path, "c.json", rows)).collect()
    assert [(x.id, x.accession) for x in got] == [("12", "VCV000000012")]


def test_guards(spark, tmp_path):
    with pytest.raises(ValueError):
        landing.allowed(["closed_study"], ["closed_study"], ("closed",))
    with pytest.raises(ValueError):
        landing.allowed(["other"], ["one"])
    landing.allowed(["one"], ["one"])
    with pytest.raises(KeyError):
        registry.get_source("nope")
    with pytest.raises(registry.NotConfigured):
        registry.get_source("institutional")(spark, str(tmp_path))
    assert registry.available_sources(False) == list(registry.PUBLIC)


def test_files_round_trip(spark, tmp_path):
    demo = files.demo_cases(spark).withColumn("split", F.lit("train")).withColumn("flags", F.array(F.lit("x")))
    assert files.write_cases(demo, str(tmp_path / "c")) == {"split_train": 3, "cases": 3, "flagged": 3}
    assert [r.case_id for r in files.read_cases(spark, str(tmp_path / "c"), 2).collect()] == ["demo-1", "demo-2"]
    trace = {"case_id": "t", "steps": [{"index": 0, "text": "x", "tool_calls": [{"tool": "a", "ok": False}, {"tool": "a", "ok": True}], "citations": [{"citation_id": "c"}]}]}
    c = files.trace_counts(files.read_traces(spark, land(tmp_path, "t.json", [trace])))
    assert files.trace_markdown(c) == "## t\n1 steps, 2 calls (1 failed), 1 citations"


def test_stream_equals_table(spark, tmp_path):
    df = spark.createDataFrame([(f"2024-01-0{1 + i % 3} 10:00:00", "t", i % 2 == 0, float(i)) for i in range(12)], "ts string, tool string, ok boolean, latency double").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "s"))
    stream = reliability.call_stream(spark, str(tmp_path / "s"), "ts timestamp, tool string, ok boolean, latency double")
    got = reliability.run_once(reliability.windowed_reliability(stream), "test_calls").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, reliability.windowed_reliability(df).collect()))
    assert reliability.sliding_reliability(df).count() == 4
