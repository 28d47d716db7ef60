"""Steps, labels, traces, cases, sources and statistics added for whole runs."""

import json
import random

import pytest
from pyspark.sql import functions as F

from attestor.operators import evidence, fusion, labels, metrics, profiles, reports, retrieval, select, stats, tools, vectors, verifier
from attestor.sources import files, landing, registry


def test_interval_of_a_rate_is_that_of_drawn_resamples(spark):
    rng = random.Random(1)
    for n, k in ((40, 9), (500, 470)):
        means = sorted(sum(rng.random() < k / n for _ in range(n)) / n for _ in range(2000))
        r = spark.createDataFrame([(n, k)], "n long, k long").select(stats.rate_interval(F.col("n"), F.col("k")).alias("i")).first().i
        assert r.lo == pytest.approx(means[50], abs=2.5 / n) and r.hi == pytest.approx(means[1950], abs=2.5 / n)
    edge = spark.createDataFrame([(0, 0), (5, 0), (5, 5)], "n long, k long").select(stats.rate_interval(F.col("n"), F.col("k")).alias("i")).collect()
    assert [(r.i.lo, r.i.hi) for r in edge] == [(0, 0), (0, 0), (1, 1)]
    assert stats.binomial_quantiles(10, 5, (0.5,)) == [5] and stats.binomial_quantiles(10**9, 10**8, (0.5,)) == [10**8]


def test_every_metric_has_its_interval_and_skips_what_is_unlabelled(spark):
    t = spark.createDataFrame([(["Drug-A"], ["drug a"], 0.9), (["x"], ["drug a", "X"], 0.4), (["x"], [], 0.2), (None, ["q"], None)], "recommendation array<string>, gold array<string>, confidence double")
    c = metrics.concordance(t).first()
    assert (c.n, c.skipped, c.top1) == (3, 1, 0.666667) and 0 <= c.top1_lo <= c.top1 <= c.top1_hi <= 1
    assert sorted((r.confidence, r.correct) for r in metrics.correct_flags(t).collect()) == [(0.4, True), (0.9, True)]
    none = metrics.step_soundness(spark.createDataFrame([(None,)], "label_sound boolean")).first()
    assert (none.n, none.rate, none.lo, none.hi, none.unlabelled) == (0, 0.0, 0.0, 0.0, 1)
    known = spark.createDataFrame([("a", True), ("b", False)], "id string, supports boolean")
    g = metrics.citation_grounding(spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, None)], "trace_id int, id string"), known).first()
    assert (g.n, g.rate, g.supports_rate) == (3, 0.666667, 0.333333)


def test_information_gathering_correlates_or_says_why_not(spark):
    t = spark.createDataFrame([(i, i < 3) for i in range(6)], "trace_id int, correct boolean")
    cites = spark.createDataFrame([(i, str(j)) for i in range(6) for j in range(1 + (i < 3) * 2 + i % 2)], "trace_id int, id string")
    calls = spark.createDataFrame([], "trace_id int, ok boolean, n_results int")
    r = metrics.information_gathering(t, calls, cites).first()
    assert r.n == 6 and r.r > 0.8 and 0 < r.p < 0.05 and r.tracks and r.mean_correct == pytest.approx(3.333)
    one = metrics.information_gathering(t.where("correct"), calls, cites).first()
    assert one.r is None and one.p is None and not one.tracks


POOLS = [("c1", "a:1"), ("c1", "a:2"), ("c2", "b:9")]


def test_steps_of_an_answer_know_their_faults(spark):
    pools = spark.createDataFrame(POOLS, "case_id string, id string")
    text = "STEP 1: one [CITE: a:1, a:2]\nstep 2 : two [cite: b:9]\nSTEP 3: three [CITE: z:5]\nSTEP 4: four\nDEFER: no"
    r = labels.parsed_steps(spark.createDataFrame([(1, "c1", text), (2, "c1", None)], "k int, case_id string, t string"), "k", "t", pools).orderBy("pos").collect()
    assert [(x["index"], x.cited, x.unresolvable, x.off_case, x.label_sound) for x in r] == [(1, ["a:1", "a:2"], [], [], True), (2, ["b:9"], [], ["b:9"], False), (3, ["z:5"], ["z:5"], [], False), (4, [], [], [], False)]


def test_prose_is_no_fault_but_ids_of_other_cases_are(spark):
    pools = spark.createDataFrame(POOLS, "case_id string, id string")
    steps = spark.createDataFrame([(1, "c1", "a:1, see the text above"), (2, "c1", "1 and 9"), (3, "c1", "q:7"), (4, "c1", "only words here"), (5, "c2", None)], "s int, case_id string, raw string")
    out = labels.relabelled_steps(steps, pools, ["s"])
    r = {x.s: x for x in out.collect()}
    assert r[1].label_sound and r[1].prose == ["see the text above"]
    assert not r[2].label_sound and r[2].cited == ["a:1", "b:9"] and r[2].off_case == ["b:9"]
    assert r[3].invented == ["q:7"] and not r[3].label_sound and not r[4].label_sound and r[5].cited == []
    s = reports.relabel_report(out, ["s"]).first()
    assert (s.n_steps, s.steps_uncited, s.steps_with_invented, s.steps_with_prose, s.steps_off_case, s.distinct_invented_ids) == (5, 2, 1, 2, 1, 1)


def test_semantic_reasons_come_in_order_and_four_at_most(spark):
    steps = spark.createDataFrame([(1, "the drug x is effective", "lung", ["x"]), (2, "quiet", None, [])], "step_id int, text string, tumor string, named array<string>")
    cites = spark.createDataFrame([(1, "r1", 0), (1, "r2", 1), (1, "nowhere", 2)], "step_id int, id string, pos int")
    recs = spark.createDataFrame([("r1", "RESISTANCE", "SUPPORTS", ["Y"], "Sarcoma"), ("r2", "RESISTANCE", "SUPPORTS", ["Z"], "Sarcoma")], "id string, significance string, direction string, therapies array<string>, disease string")
    r = {x.step_id: x for x in labels.semantic_labels(steps, cites, recs).collect()}
    assert r[1].reasons == ["r1: step claims sensitivity, record says resistance", "r1: step names ['x'], record is about ['Y']", "r1: record disease 'Sarcoma' vs case tumour type 'lung'", "r2: step claims sensitivity, record says resistance"]
    assert (r[1].n_cited, r[1].n_judgeable, r[1].sound) == (3, 2, False) and r[2].reasons == [] and not r[2].sound
    flags = spark.createDataFrame([(True, True, False), (True, True, True), (False, True, False)], "a boolean, b boolean, c boolean")
    assert [x[0] for x in flags.select(labels.combined_label(F.col("a"), F.col("b"), F.col("c"))).collect()] == [True, False, False]


def test_labels_return_to_their_steps_and_are_audited(spark):
    traces = spark.createDataFrame([("c", [("s0", None), ("s1", None)]), ("d", [("t", None)])], "case_id string, steps array<struct<text: string, label_sound: boolean>>")
    own = spark.createDataFrame([("c", 1, True)], "case_id string, step_index int, sound boolean")
    r = {x.case_id: [s.label_sound for s in x.steps] for x in labels.annotated_traces(traces, own).collect()}
    assert r == {"c": [None, True], "d": [None]}
    assert labels.audited(own, own).first().kappa == 1.0
    with pytest.raises(ValueError, match="no step in common"):
        labels.audited(own, own.withColumn("case_id", F.lit("z")))
    ex = spark.createDataFrame([(1, ["a"], True), (2, ["b"], True), (3, [], True)], "example_id int, evidence_ids array<string>, label_sound boolean")
    both = labels.with_negatives(ex, 3).groupBy("strategy").count().collect()
    assert {x.strategy: x["count"] for x in both} == {"own": 3, "strip": 2, "swap": 2}


def test_whole_traces_carry_citations_calls_and_the_decision(spark):
    alts = spark.createDataFrame([("c", 1, "G1", "K1R", "lung"), ("c", 2, "G2", "Q2*", "lung")], "case_id string, alt_ord long, gene string, variant string, tumor string")
    found = spark.createDataFrame([("c", 1, "e:1", "somatic_evidence", "says", "B"), ("c", 1, "VCV1", "germline_records", "title", None)], "case_id string, alt_ord long, citation_id string, source string, claim string, level string")
    picks = spark.createDataFrame([("c", 1, "C1", "use x", "I-A")], "case_id string, alt_ord long, chunk_id string, recommendation string, tier string")
    dec = spark.createDataFrame([("c", ["x", "y"], 0.5, True)], "case_id string, recommendation array<string>, confidence double, abstained boolean")
    t = fusion.traces(alts, found, picks, dec).first()
    assert [s.text for s in t.steps] == [
        "Plan: 2 alteration(s) [G1 K1R; G2 Q2*] in lung. Consult specialists ['variant', 'guideline'], then synthesize.", "Variant G1 K1R: 2 CIViC/ClinVar item(s), best CIViC level B, 1 germline pathogenicity item(s).",
        "Guideline for G1 lung: use x (ESCAT I-A).", "Variant G2 Q2*: 0 CIViC/ClinVar item(s), best CIViC level -, 0 germline pathogenicity item(s).",
        "Synthesis: recommend ['x', 'y'] at confidence 0.50. Low confidence — abstain and defer to clinician.",
    ]
    assert [[c.citation_id for c in s.citations] for s in t.steps] == [[], ["VCV1", "e:1"], ["guideline:C1"], [], []]
    assert t.steps[1].tool_calls[0].n_results == 2 and t.sub_questions == ["G1 K1R", "G2 Q2*"] and t.abstained
    line = fusion.ordered(spark.createDataFrame([("c", "t1", 2), ("c", "t0", 3), ("c", "t1", 1)], "case_id string, timepoint string, ord int")).orderBy("place").collect()
    assert [(r.timepoint, r.ord) for r in line] == [("t0", 3), ("t1", 1), ("t1", 2)]


def test_profiles_become_cases_with_their_evidence(spark):
    rows = [("s", s, p, "G1" if i % 2 else "G2", i % 2, i, f"K{i}R", "Missense_Mutation", 3, "hg19") for s, p, m in ((1, 1, 2), (2, 1, 3), (3, 2, 1), (4, 3, 2)) for i in range(m)]
    recs = spark.createDataFrame(rows, "study string, sample long, patient long, gene string, gene_id int, line int, change string, mutation_type string, alt_count int, build string")
    built = profiles.built(recs, ["s"], ["line"], {"s": "lung carcinoma"}, per_study=5, min_alterations=2, threshold=3)
    r = {x.patient: x for x in built.collect()}
    assert {p: x.sample for p, x in r.items()} == {1: 2, 3: 4} and r[1].flags == ["hypermutator"] and [a.change for a in r[1].alterations] == ["K0R", "K1R", "K2R"]
    ev = spark.createDataFrame([("G1", "e1", "s1", "CA7", ["11"], "ACCEPTED", 3, "A", "Lung cancer", "SUPPORTS", "SENSITIVITY", "PREDICTIVE", 1), ("G1", "e2", "s2", None, None, "REJECTED", 5, "A", None, None, None, None, 2)], "profile string, citation_id string, summary string, caid string, clinvar_ids array<string>, status string, rating int, level string, disease string, direction string, significance string, evidence_type string, ord int")
    germ = spark.createDataFrame([(11, "VCV11", "title")], "id int, accession string, title string")
    each = built.select("tumor_type", F.explode("alterations").alias("a")).select("a.gene", "a.change", "tumor_type")
    c = {x.case_id: x for x in profiles.cases(built, evidence.annotation(each, ev, germ)).collect()}
    assert set(c) == {"s:2", "s:4"} and c["s:2"].context.tumor_type == "lung carcinoma" and c["s:2"].gold is None and c["s:2"].split
    e = json.loads(c["s:2"].provenance.evidence["G1 K1R"])
    assert e["actionable"] and e["caid"] == "CA7" and e["clinvar"] == [{"id": "clinvar:VCV11", "summary": "title"}] and [x["id"] for x in e["civic"]] == ["e1"]
    assert not json.loads(c["s:2"].provenance.evidence["G2 K0R"])["actionable"]
    own = spark.createDataFrame([(i, f"x{j}") for i in range(3) for j in range(i, i + 2)], "case_id int, item string")
    mix = profiles.with_distractors(own, 2, 5).collect()
    assert all(sum(1 for m in mix if m.case_id == i and m.is_own) == 2 for i in range(3)) and len(mix) == 12 and {m.place for m in mix} == {0, 1, 2, 3}


def test_sources_search_fetch_and_guard(spark, tmp_path):
    recs = spark.createDataFrame([(1, "G1", "NM:p.Leu858Arg x", "Pathogenic"), (2, "G1", "p.Leu858Arg", None), (3, "G1", "exon 19 deletion", "Benign"), (4, "G2", "p.Leu858Arg", "Benign")], "id int, gene string, title string, germline string")
    q = spark.createDataFrame([(1, "G1", "L858R"), (2, "G1", "exon 19 deletion")], "query_id int, gene string, variant string")
    assert sorted((r.query_id, r.id, r["rank"]) for r in evidence.searched(recs, q).collect()) == [(1, 1, 1), (2, 3, 1)]
    with pytest.raises(ValueError, match="both"):
        evidence.searched(recs, q.withColumn("gene", F.lit(None).cast("string")))
    asked, cached = spark.createDataFrame([("a",), ("b",)], "id string"), spark.createDataFrame([("a", 1), ("z", 9)], "id string, v int")
    assert sorted(map(tuple, evidence.completed(asked, cached, lambda m: m.withColumn("v", F.lit(2))).collect())) == [("a", 1), ("b", 2)]
    with pytest.raises(TypeError, match="not of evidence"):
        registry.retrieve(spark, str(tmp_path), "cases", q)
    landing.landed(spark.createDataFrame([("u1", 5)], "u string, v int"), str(tmp_path / "raw"), F.col("u"))
    got, missing = landing.requested(spark, str(tmp_path / "raw"), spark.createDataFrame([("u1",), ("u2",)], "request string"), "v INT")
    assert [r.v for r in got.collect()] == [5] and [r.request for r in missing.collect()] == ["u2"]
    (tmp_path / "c.jsonl").write_text("".join(json.dumps({"case_id": c}) + "\n" for c in "zebra yak ant".split()))
    assert [r.case_id for r in files.read_cases(spark, str(tmp_path / "c.jsonl"), 2).collect()] == ["zebra", "yak"]
    (tmp_path / "run.log").write_text('[{"stream_name": "stdout", "data": "one "}\n,{"stream_name": "stderr", "data": "Tesla"}\nbroken\n,{"stream_name": "stdout", "data": "two"}\n')
    log = files.parsed_log(spark, str(tmp_path / "run.log")).first()
    assert (log.stdout, log.gpu, log.error) == ("two", True, False)  # the opening bracket spoils the first line
    with pytest.raises(ValueError, match="missing argument gene"):
        tools.require(q.withColumn("gene", F.lit("")), "query_id", "gene")
    hits = tools.chunk_records(spark.createDataFrame([("C1", "raw"), ("C9", "raw9")], "chunk_id string, text string"), spark.createDataFrame([("C1", "rec", "I-A", ["x"])], "chunk_id string, recommendation string, tier string, therapies array<string>"))
    assert sorted(r.claim for r in hits.collect()) == ["raw9", "rec"]


def test_failed_calls_are_logged_with_their_error(spark):
    asked = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "k int, x string")
    found = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    r = {x.k: (x.ok, x.n_results, x.error) for x in tools.call_log(asked, found, "t", ["k"], ["x"]).collect()}
    assert r == {1: (True, 2, None), 2: (False, 0, "ValueError: missing argument x"), 3: (True, 0, None)}


def test_dense_search_equals_brute_force_in_blocks(spark, monkeypatch):
    rng = random.Random(4)
    v = [(i, [rng.choice([-1.0, 0.0, 1.0]) for _ in range(4)]) for i in range(60)] + [(90, None)]
    df = spark.createDataFrame(v, "vec_id long, embedding array<float>").repartition(3)
    monkeypatch.setattr(vectors, "TILE", 100)
    got = {}
    for r in retrieval.dense(df, df.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), 5).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append(r.doc_id)
    norm = lambda a: sum(x * x for x in a) ** 0.5
    for q, ids in got.items():
        a = dict(v)[q]
        want = sorted((-round(sum(x * y for x, y in zip(a, b, strict=True)) / norm(a) / norm(b), 6), i) for i, b in v if b and norm(b) and norm(a))[:5]
        assert ids == [i for _, i in want]


def test_training_reports_calibrates_and_transfers(spark):
    rows = [(i, i % 12, "good words stay here" if i % 2 else "bad tokens come along", i % 2) for i in range(96)]
    df = spark.createDataFrame(rows, "k long, c long, t string, y int")
    model, report = verifier.trained(df, "k", "t", "y", "c")
    r = report.first()
    assert r.accuracy == 1.0 and r.n_train + r.n_test == 96 and r.n_test_cases == 3 and r.temperature == model.temperature and r.positive_rate == pytest.approx(0.5, abs=0.51)
    assert model.size == model.terms.count() == 14
    arms = {a.arm: a.balanced_accuracy for a in verifier.transfer(df, df.withColumn("k", F.col("k") + 1000), "k", "t", "y", "c").collect()}
    assert set(arms) == {"synthetic_to_real", "real_to_real", "synthetic_to_synthetic"}
    s = model.trace_scores(df.limit(10), "k", "t", ["c"]).collect()
    assert all(0 <= x.score <= 1 for x in s)
    m = {(x.arm, x.metric): x for x in select.arm_metrics(spark.createDataFrame([("a", ["X"], ["x"], 0.8, False, True, 2, 1, 0, 0)], "arm string, recommendation array<string>, gold array<string>, confidence double, abstained boolean, actionable boolean, n_steps int, n_sound int, n_cited int, n_resolved int")).collect()}
    assert m["a", "guideline_concordance_top1"].value == 1.0 and m["a", "step_soundness"].value == 0.5 and m["a", "citation_grounding"].n == 0 and m["a", "brier"].value == pytest.approx(0.04)


def test_pools_take_the_smallest_claim_and_lookups_name_a_record_once(spark):
    c = spark.createDataFrame([(1, "a", "z"), (1, "a", "b"), (1, "a", None), (1, "b", None), (2, "a", "q")], "case_id long, citation_id string, claim string")
    assert {r.case_id: r.pool for r in tools.evidence_pools(c).collect()} == {1: {"a": "b", "b": None}, 2: {"a": "q"}}
    alts = spark.createDataFrame([(1, 1, "P", "lung"), (1, 2, "P", "lung"), (2, 1, "P", None), (3, 1, "Q", "lung")], "case_id long, alt_ord int, profile string, tumor string")
    ev = spark.createDataFrame([("P", f"E{i}", "s", [7, 7], "lung", "A", 1, i) for i in range(7)], "profile string, citation_id string, summary string, ids array<int>, disease string, level string, rating int, ord int")
    got = tools.variant_lookup(alts, ev, spark.createDataFrame([(7, "V7", "t")], "id int, accession string, title string"), 3)
    assert sorted((r.case_id, r.alt_ord, r.citation_id) for r in got.collect()) == [(1, a, c) for a in (1, 2) for c in ("E0", "E1", "E2", "V7")]
    text = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text and "HashAggregate" not in text


def test_rows_dealt_by_case_are_put_together_where_they_are(spark):
    alts = spark.createDataFrame([(c, i, "G1", f"V{i}", "lung", "G1") for c in range(3) for i in (2, 1)], "case_id long, alt_ord int, gene string, variant string, tumor string, profile string")
    found = fusion.answered(spark.createDataFrame([("G1", "E1", "somatic_evidence", "claim", "B"), ("G1", "V1", "germline_records", "title", None)], "profile string, citation_id string, source string, claim string, level string"), ["profile"])
    picks = spark.createDataFrame([("G1", "C1", "drug", "I-A")], "gene string, chunk_id string, recommendation string, tier string").where("chunk_id <> ''")
    decisions = spark.createDataFrame([(c, ["drug"], 0.9, False) for c in range(4)], "case_id long, recommendation array<string>, confidence double, abstained boolean")
    dealt = alts.join(F.broadcast(found), "profile", "left").join(F.broadcast(picks.withColumnRenamed("recommendation", "r")), "gene", "left").withColumnRenamed("r", "recommendation")
    got = fusion.composed(dealt.repartition(4, "case_id"), decisions.repartition(4, "case_id"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(case_id") == 2
    one = got.where("case_id = 1").first()
    assert [s.text.split(":")[0] for s in one.steps] == ["Plan", "Variant G1 V1", "Guideline for G1 lung", "Variant G1 V2", "Guideline for G1 lung", "Synthesis"]
    assert [s["index"] for s in one.steps] == list(range(6)) and one.sub_questions == ["G1 V1", "G1 V2"]
    assert [c.citation_id for c in one.steps[1].citations] == ["E1", "V1"]
    assert got.count() == 3


def test_profiles_are_the_same_from_the_records_of_their_samples(spark):
    rows = [("A", p, p * 10 + s, line, f"G{line % 3}", line % 3, f"c{line % 3}", 1 if line % 5 else 0, "Missense_Mutation", "hg19") for p in range(6) for s in range(2) for line in range(2 + p)]
    r = spark.createDataFrame(rows, "study string, patient long, sample long, line int, gene string, gene_id int, change string, alt_count long, mutation_type string, build string")
    kept = profiles.dropped(r, ["line"]).groupBy("sample").agg(F.array_sort(F.collect_list(F.struct("line", "gene", "change"))).alias("a"))
    want = {x.sample: [(a.gene, a.change) for a in x.a] for x in kept.collect()}
    got = profiles.built(r, ["A"], ["line"], {}, per_study=4, threshold=5)
    assert got.count() == 4
    assert all([(a.gene, a.change) for a in x.alterations] == want[x.sample] and x.n == len(x.alterations) for x in got.collect())


def test_evidence_is_ranked_once_for_an_annotation(spark):
    row = {"profile": "G1", "summary": "s", "status": "ACCEPTED", "disease": "lung carcinoma", "direction": "SUPPORTS", "significance": "SENSITIVITY", "evidence_type": "PREDICTIVE", "rating": 1, "level": "A"}
    ev = spark.createDataFrame([(f"E{i}", "CA1", ["7"], i) for i in range(9)], "citation_id string, caid string, clinvar_ids array<string>, ord long").select("*", *(F.lit(v).alias(k) for k, v in row.items()))
    alts = spark.createDataFrame([("G1", "c1", "lung")], "gene string, change string, tumor_type string")
    got = evidence.annotation(alts, ev, spark.createDataFrame([(7, "VCV7", "title")], "id long, accession string, title string"))
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
    e = got.first().evidence
    assert [c.id for c in e.civic] == [f"E{i}" for i in range(5)] and e.clinvar_ids == ["7"] and e.actionable and e.clinvar[0].id == "clinvar:VCV7"
