import math
import random

import pytest
from pyspark.sql import functions as F

from attestor.functions.rng import positions
from attestor.operators import evidence, fusion, labels, metrics, profiles, qc, retrieval, select, stats, verifier

RECORD = "study string, sample bigint, patient bigint, gene string, gene_id int, line int, change string, mutation_type string, alt_count int, build string"


def record(spark, rows):
    return spark.createDataFrame(rows, RECORD)


def test_checks_find_what_is_planted_and_nothing_in_clean_rows(spark):
    clean = [("s", 1, 1, "G1", 1, 1, "K11R", "Missense_Mutation", 5, "hg19"), ("s", 2, 2, "G1", 1, 1, "K11R", "Missense_Mutation", None, "GRCh37")]
    assert qc.run_qc(record(spark, clean)).count() == 0
    bad = [*clean, ("s", 3, 3, "G1", 1, 1, "Q11*", "Missense_Mutation", 0, "hg38"), ("s", 3, 3, "G2", 2, 2, None, "Nonsense_Mutation", 1, None), ("s", 3, 3, "G2", 2, 3, None, "Nonsense_Mutation", 1, None)]
    found = {r.check: r.severity for r in qc.run_qc(record(spark, bad), 3).collect()}
    assert found == {"build_mixed": "high", "type_vs_protein": "medium", "vaf_zero_alt": "medium", "duplicate_row": "low", "hypermutator": "low"}


def test_a_zero_alt_first_copy_takes_its_twin_along(spark):
    rows = [("s", 1, 1, "G", 1, 1, "K1R", None, 0, None), ("s", 1, 1, "G", 1, 2, "K1R", None, 5, None), ("s", 1, 1, "H", 2, 3, "K1R", None, 5, None), ("s", 1, 1, "H", 2, 4, None, None, 5, None)]
    assert [r.line for r in profiles.dropped(record(spark, rows), ["line"]).collect()] == [3]


def test_richest_sample_and_studies(spark):
    rows = [("b", s, p, "G", 1, i, f"K{i}R", None, 5, None) for s, p, n in ((1, 1, 2), (2, 1, 2), (3, 2, 1)) for i in range(n)] + [("a", 9, 2, "G", 1, 1, "K1R", None, 5, None)]
    rich = profiles.richest_sample(record(spark, rows))
    assert sorted((r.study, r.patient, r.sample) for r in rich.collect()) == [("a", 2, 9), ("b", 1, 2), ("b", 2, 3)]
    assert sorted((r.study, r.patient) for r in profiles.first_study(rich, ["a", "b"]).collect()) == [("a", 2), ("b", 1)]
    dealt = profiles.first_study(profiles.richest_sample(record(spark, rows), parts=37), ["a", "b"])  # as many tasks as asked for, also where patients meet
    assert dealt.rdd.getNumPartitions() == 37 and sorted((r.study, r.patient) for r in dealt.collect()) == [("a", 2), ("b", 1)]


def test_a_patient_past_the_cap_stays_free_for_the_next_study(spark):
    samples = spark.createDataFrame([("a", p, p, 1) for p in range(3)] + [("b", p, p, 1) for p in range(3)], "study string, patient bigint, sample bigint, n bigint")
    got = profiles.capped(samples, ["a", "b"], 2, 7).collect()
    assert sorted(r.study for r in got) == ["a", "a", "b"]
    assert len({r.patient for r in got}) == 3


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_splits_are_disjoint_and_cut_at_cumulative_floors(spark, seed):
    cases = spark.range(23).withColumnRenamed("id", "c")
    n = {r.split: r["count"] for r in profiles.split_cases(cases, "c", seed).groupBy("split").count().collect()}
    assert n == {"train": 16, "val": 2, "test": 2, "generalization": 3}
    t = profiles.split_train_test(cases, "c", seed).collect()
    assert len({r.case_id for r in t}) == len(t) == 23
    assert sum(r.is_test for r in t) == 6
    assert [r.is_test for r in profiles.split_train_test(cases.limit(1), "c", seed).collect()] == [False]


def test_positions_number_every_row_once(spark):
    got = positions(spark.range(5000).withColumnRenamed("id", "k"), "k", 3)
    assert sorted(r.pos for r in got.collect()) == list(range(5000))


def test_distractors_are_foreign(spark):
    own = spark.createDataFrame([(c, f"i{(c * 3 + j) % 11}") for c in range(6) for j in range(3)], "case_id int, item string")
    mine = {(r.case_id, r.item) for r in own.collect()}
    got = [(r.case_id, r.item) for r in profiles.distractors(own, 4, 1).collect()]
    assert len(got) == len(set(got)) == 24
    assert not mine & set(got)


def corpus(spark):
    return spark.createDataFrame([("d1", "alpha beta gamma"), ("d2", "alpha alpha delta"), ("d3", "epsilon zeta"), ("d4", None)], "doc_id string, text string")


def ask(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "query_id int, text string")


def test_bm25(spark):
    got = retrieval.bm25(corpus(spark), ask(spark, "alpha delta", "nothing here"), 3).collect()
    assert [r.doc_id for r in sorted(got, key=lambda r: r["rank"])] == ["d2", "d1"]
    twice = retrieval.bm25(corpus(spark), ask(spark, "alpha alpha"), 3).where("doc_id = 'd1'").first().score
    once = retrieval.bm25(corpus(spark), ask(spark, "alpha"), 3).where("doc_id = 'd1'").first().score
    assert twice == pytest.approx(2 * once)


def test_fusion_of_rankings(spark):
    arm = lambda *d: spark.createDataFrame([(0, x, i + 1) for i, x in enumerate(d)], "query_id int, doc_id string, rank int")
    got = sorted(retrieval.fuse([arm("a", "b"), arm("b", "c")], 3).collect(), key=lambda r: r["rank"])
    assert [r.doc_id for r in got] == ["b", "a", "c"]
    assert got[0].score == pytest.approx(1 / 61 + 1 / 60)


def test_dense(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 2.0]), (2, [1.0, 1.0])], "vec_id int, embedding array<float>")
    got = retrieval.dense(v, v.where("vec_id = 0").withColumnRenamed("vec_id", "query_id"), 2).collect()
    assert [(r.doc_id, round(r.score, 3)) for r in sorted(got, key=lambda r: r["rank"])] == [(0, 1.0), (2, 0.707)]


def test_evidence_order_and_actionable(spark):
    ev = spark.createDataFrame([(0, 1, "B", 5, False), (0, 2, "A", 1, False), (0, 3, None, 5, True), (0, 4, "Z", 5, False)], "query_id int, ord int, level string, rating int, matches boolean")
    assert [r.ord for r in sorted(evidence.ranked(ev, 3).collect(), key=lambda r: r["rank"])] == [3, 2, 1]


def test_fusion_and_abstaining(spark):
    m = "case_id int, therapy string, w double, ord int"
    g = spark.createDataFrame([(1, "Drug A", 0.95, 0), (2, "Drug B", 0.5, 0)], m)
    e = spark.createDataFrame([(1, "drug a", 0.9, 0), (1, "drug c", 0.82, 1)], m)
    cases = spark.createDataFrame([(1,), (2,), (3,)], "case_id int")
    got = {r.case_id: r for r in fusion.decided(cases, fusion.candidates(g, e)).collect()}
    assert got[1].recommendation == ["Drug A", "drug c"] and got[1].confidence == 0.97 and not got[1].abstained
    assert got[2].abstained and got[2].recommendation == ["Drug B"]
    assert got[3].abstained and got[3].confidence == 0.15 and got[3].recommendation == []


def test_pick_prefers_the_gene_then_the_first_generic_chunk(spark):
    chunks = spark.createDataFrame([("g1", "G1", "lung", 0), ("x1", "", "lung adenocarcinoma", 1), ("x2", "", "lung squamous", 2)], "chunk_id string, gene string, tumor_type string, ord int")
    cases = spark.createDataFrame([(1, "G1", "skin"), (2, "G9", "lung squamous"), (3, "G9", "skin")], "case_id int, gene string, tumor string")
    assert {r.case_id: r.chunk_id for r in evidence.picked(cases, chunks).collect()} == {1: "g1", 2: "x1", 3: None}


def test_step_labels_and_negatives(spark):
    df = spark.createDataFrame([(1, []), (2, ["a", "x"]), (3, ["x"])], "i int, cited array<string>")
    got = df.select("i", labels.guideline_label(F.col("cited"), F.array(F.lit("a"))).alias("s")).collect()
    assert {r.i: r.s for r in got} == {1: True, 2: True, 3: False}
    ex = spark.createDataFrame([(i, [f"id{i}", f"id{i + 1}"], True) for i in range(8)] + [(99, [], True), (98, ["id1"], False)], "example_id int, evidence_ids array<string>, label_sound boolean")
    neg = labels.mined_negatives(ex, 5).collect()
    assert sum(r.strategy == "strip" for r in neg) == sum(r.strategy == "swap" for r in neg) == 8
    assert all(r.evidence_ids[0] not in (f"id{r.example_id}", f"id{r.example_id + 1}") for r in neg if r.strategy == "swap")


def test_kappa(spark):
    pairs = lambda *p: spark.createDataFrame(list(p), "a int, b int")
    assert labels.kappa(pairs((1, 1), (0, 0)), "a", "b").first().kappa == 1.0
    assert labels.kappa(pairs((1, 1), (1, 1)), "a", "b").first().kappa == 1.0
    assert labels.kappa(pairs((1, 1), (0, 1), (0, 0)), "a", "b").first().kappa < 1


def test_candidate_lines(spark):
    text = "STEP 1: first [CITE: a:1, b:2]\nstep 2: second\nRECOMMENDATION: x; y ;\nCONFIDENCE: 0.7\nCONFIDENCE: 0.8 or so\nDEFER: yes"
    r = labels.parsed_candidates(spark.createDataFrame([(1, text), (2, None)], "k int, t string"), "k", "t").orderBy("key").collect()
    assert (r[0].n_steps, r[0].n_cited, r[0].recommendation, r[0].confidence, r[0].abstained, r[0].parsed_ok) == (2, 2, "x;y", 0.8, True, True)
    assert (r[1].n_steps, r[1].confidence, r[1].abstained, r[1].parsed_ok) == (0, None, False, False)


def test_bootstrap_interval_holds_the_mean(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(i, float(rng.random() < 0.7)) for i in range(60)], "k int, v double")
    r = stats.bootstrap_mean(df, "k", "v", 400).first()
    assert r.lo <= r["mean"] <= r.hi and r.n == 60
    e = stats.bootstrap_mean(df.limit(0), "k", "v", 50).first()
    assert (e.n, e["mean"]) == (0, None)


def test_correlation_p_value_matches_the_published_example():
    # 48 and 2 cases, r = -0.256: p = 0.0727
    assert stats.student_p(-0.256, 50) == pytest.approx(0.0727, abs=6e-4)
    assert stats.student_p(0.0, 50) == pytest.approx(1.0)
    assert stats.student_p(0.5, 10) == pytest.approx(0.1411, abs=1e-3)


def test_calibration_and_deferral(spark):
    df = spark.createDataFrame([(0.1, False), (0.5, True), (0.5, False), (1.0, True)], "c double, ok boolean")
    bins = {r.bin: r.n for r in metrics.calibration_bins(df, "c", "ok").collect()}
    assert bins == {0: 1, 1: 0, 2: 2, 3: 0, 4: 1}
    curve = {r.threshold: (r.kept, r.accuracy) for r in metrics.deferral_curve(df, "c", "ok", (0.0, 0.5, 1.1)).collect()}
    assert curve == {0.0: (4, 0.5), 0.5: (3, 0.666667), 1.1: (0, None)}


def test_tool_reliability_counts_repeats_globally(spark):
    calls = spark.createDataFrame([(1, "t", "a", True, 1.0, 0, None), (2, "t", "a", True, 3.0, 2, None), (3, "u", None, False, 2.0, None, "boom")], "ord int, tool string, args string, ok boolean, latency double, n_results int, error string")
    r = metrics.tool_reliability(calls).first()
    assert (r.n, r.success_rate, r.median_latency, r.redundant, r.empty, r.errors) == (3, 0.666667, 2.0, 1, 1, "boom")


def test_selection(spark):
    s = spark.createDataFrame([("c", 1, 0.5), ("c", 2, 0.9), ("c", 3, 0.9), ("d", 1, 0.3), ("e", 1, 0.5), ("e", 2, 0.52)], "case_id string, sample int, score double")
    assert {r.case_id: r["sample"] for r in select.best_of_n(s, "case_id", "sample").collect()} == {"c": 2, "d": 1, "e": 2}
    pairs = select.dpo_pairs(s, "case_id", "sample").collect()
    assert [(p.case_id, p.chosen, p.rejected) for p in pairs] == [("c", 2, 1)]
    with pytest.raises(ValueError):
        select.trace_scores(s, ["case_id"], "score", "max")


def test_verifier_learns_and_round_trips(spark, tmp_path):
    rows = [(i, ("cited finding supports drug" if i % 2 else "no record for this claim") + f" n{i % 5}", i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "k int, t string, y int")
    v = verifier.fit(df.where("k < 28"), "k", "t", "y")
    c = verifier.confusion(v.scored(df.where("k >= 28"), "k", "t", "y"), "prob", "label").first()
    assert c.accuracy >= 0.8
    v.save(str(tmp_path / "v"))
    again = verifier.Verifier.load(spark, str(tmp_path / "v"))
    a, b = ({r.key: r.prob for r in m.scored(df, "k", "t", "y").collect()} for m in (v, again))
    assert a == pytest.approx(b)
    with pytest.raises(ValueError):
        verifier.fit(df.where("y = 1"), "k", "t", "y")


def test_splits_cut_at_fractions_as_written(spark):
    from attestor.operators import profiles

    cases = spark.range(90).select(F.col("id").alias("c"))
    sizes = {r.split: r["count"] for r in profiles.split_cases(cases, "c", 17).groupBy("split").count().collect()}
    assert sizes == {"train": 63, "val": 9, "test": 9, "generalization": 9}
    assert profiles.split_train_test(cases.where("c < 90"), "c", 17, 0.7).where("is_test").count() == 63


def test_terms_in_proportion_are_one_feature_and_the_model_stays_the_same(spark):
    from pyspark.ml.classification import LogisticRegression

    rng = random.Random(8)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, i % 6, " ".join([rng.choice(words) for _ in range(9)] + [f"own{i} only{i} own{i}", "always paired"] * (i % 3)), int(rng.random() < 0.5)) for i in range(40)]
    df = spark.createDataFrame(rows, "k long, c long, t string, y int")
    model = verifier.fit(df, "k", "t", "y")
    assert model.model.numFeatures < model.size == model.terms.count() == verifier.tfidf(df, "k", "t").select("term").distinct().count()
    plain = {r.term: i for i, r in enumerate(verifier.tfidf(df, "k", "t").select("term").distinct().collect())}
    numbers = spark.createDataFrame(list(plain.items()), "term string, i int")
    w = verifier.class_weights(df, "y")
    v = verifier.vectors(verifier.tfidf(df, "k", "t").join(numbers, "term").select("key", "i", "weight"), df, "k", "y", len(plain))
    v = v.withColumn("weight", F.when(F.col("label") == 1, w[1]).otherwise(w[0]))
    one = LogisticRegression(maxIter=1000, regParam=1 / 40, standardization=False, weightCol="weight", tol=1e-9).fit(v)
    from pyspark.ml.functions import vector_to_array

    want = {r.key: r.z for r in one.transform(v).select("key", vector_to_array("rawPrediction")[1].alias("z")).collect()}
    got = {r.key: r.logit for r in model.scored(df, "k", "t", "y").collect()}
    assert all(got[k] == pytest.approx(want[k], abs=2e-2) for k in want)


def test_frequencies_count_words_and_pairs_of_all_rows_of_a_key(spark, monkeypatch):
    from collections import Counter

    monkeypatch.setattr(verifier, "EXAMPLES", 2)
    rows = [(1, "Good good words"), (1, "good"), (2, None), (3, "x"), (4, "é_1 ÉCOLE é_1 école, é_1"), (None, "no key"), (5, "")]
    want = Counter()
    for k, t in rows:
        w = [x for x in (t or "").lower().replace(",", "").split() if len(x) > 1]
        want.update([(k, x) for x in w] + [(k, f"{a} {b}") for a, b in zip(w, w[1:])])
    got = {(r.key, r.term): r.tf for r in verifier.frequencies(spark.createDataFrame(rows, "k int, t string"), "k", "t").collect()}
    assert got == dict(want)


def test_records_are_dealt_to_more_tasks_as_they_grow(spark, tmp_path, monkeypatch):
    from attestor.plans import roles

    spark.range(4000).selectExpr("id % 500 l_orderkey", "id % 7 l_partkey", "id % 3 l_suppkey", "int(id % 7) l_linenumber", "'A' l_returnflag", "1.0d l_quantity", "2.0d l_extendedprice").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.range(500).selectExpr("id o_orderkey", "id % 9 o_custkey", "'s' o_orderpriority").write.parquet(str(tmp_path / "orders.parquet"))
    monkeypatch.setattr(roles, "TASK_RECORDS", 100)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        r = roles.records(spark, str(tmp_path))
        assert r.count() == 4000 and r.rdd.getNumPartitions() == 40
        kept = profiles.dropped(r, ["line", "part", "supp", "price"])
        assert kept._jdf.queryExecution().executedPlan().toString().count("Exchange") == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_the_model_is_the_best_one_and_no_coefficient_of_a_term_is_on_the_driver(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("abcdefghij") * 2 for _ in range(rng.randrange(12))), int(rng.random() < 0.3)) for i in range(60)]
    rows += [(100 + i, t.upper(), y) for i, t, y in rows[:20]] + [(i + 200, t, 1 - y) for i, t, y in rows[:5]]
    df = spark.createDataFrame(rows, "k long, t string, y int")
    monkeypatch.setattr(verifier, "BLOCK", 50)
    monkeypatch.setattr(verifier, "SUMS", 0)
    model = verifier.fit(df, "k", "t", "y")
    assert model.model.numFeatures == len({t.lower() for _, t, _ in rows}) < len(rows) and not hasattr(model.model, "coefficients")
    w = {r.term: (r.idf, r.coefficient) for r in model.terms.collect()}
    weight, total, square = verifier.class_weights(df, "y"), {}, sum(c * c for _, c in w.values())
    x = {}
    for r in verifier.tfidf(df, "k", "t").collect():
        x.setdefault(r.key, {})[r.term] = r.weight
    z = {r.key: r.logit for r in model.scored(df, "k", "t", "y").collect()}
    off = 0.0
    for k, _, y in rows:
        assert z[k] == pytest.approx(model.model.intercept + sum(v * w[t][1] for t, v in x.get(k, {}).items()))
        g = weight[y] * (1 / (1 + math.exp(-z[k])) - y)
        off += g
        for t, v in x.get(k, {}).items():
            total[t] = total.get(t, 0.0) + g * v
    assert square > 0.1 and abs(off) < 1e-3 and all(abs(total[t] + w[t][1]) < 1e-3 for t in w)


def test_weights_by_chunks_are_those_of_a_fitted_table_and_each_term_is_shuffled_once_for_a_chunk(spark, monkeypatch):
    monkeypatch.setattr(verifier, "EXAMPLES", 4)
    monkeypatch.setattr(verifier, "CHUNK", 40)
    monkeypatch.setattr(verifier, "TASK_TERMS", 7)
    rows = [(i % 70, " ".join(f"w{(i * j) % 13} é{j % 3}" for j in range(i % 9))) for i in range(90)] + [(900, None), (901, "x"), (None, "no key"), (902, "")]
    df = spark.createDataFrame(rows, "k int, t string")
    of = lambda w: {(r.key, r.term): r.weight for r in w.collect()}
    got, want = of(verifier.tfidf(df, "k", "t")), of(verifier.tfidf(df, "k", "t", vocabulary=verifier.idf_table(df, "k", "t")))
    assert got == pytest.approx(want) and len(got) > 500
    own = verifier.chunks(df, "k", "t")
    assert own.count() > 4 and own.selectExpr("sum(size(terms))").first()[0] < len(got) == own.selectExpr("sum(size(tf))").first()[0]
    assert verifier.tfidf(df.where("t is null"), "k", "t").count() == 0
    assert sorted(r.weight for r in verifier.tfidf(df, "k", "t", named=False).collect()) == pytest.approx(sorted(want.values()))


def test_a_round_of_the_solver_is_one_pass_over_the_different_texts(spark, monkeypatch):
    rows = [(i, f"plan n{i % 4} of n{i % 7} in n{i % 5}", int(i % 7 < 3) ^ int(i % 11 == 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "k long, t string, y int")
    passes, times = [], verifier.Gram.times
    monkeypatch.setattr(verifier.Gram, "times", lambda self, v: passes.append(len(v)) or times(self, v))
    model = verifier.fit(df, "k", "t", "y", max_rounds=3)
    assert passes == [140] * 3 and model.model.numFeatures == 140
    loss = lambda m: m.scored(df, "k", "t", "y").select(F.avg(F.log(1 + F.exp(F.when(F.col("label") == 1, -F.col("logit")).otherwise(F.col("logit")))))).first()[0]
    assert loss(verifier.fit(df, "k", "t", "y")) <= loss(model) + 1e-2 and loss(model) < 0.75
