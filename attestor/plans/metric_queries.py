"""Queries over statistics, metrics, the verifier and selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestor.operators import metrics, select, stats, verifier
from attestor.plans.roles import CALLS, CONFIDENT, HREFS, RESOLVABLE, calls, confident, hrefs, resolvable
from attestor.session import shared_folder, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


# The keyed uniform numbers, one for each of 2000 resamples, at the places that the percentile interval takes in their order.
_LO, _HI = (f"(SELECT u FROM (SELECT u, row_number() OVER (ORDER BY u) - 1 AS place FROM (SELECT (('0x' || substr(md5('17:' || CAST(b AS VARCHAR)), 1, 8))::BIGINT + 0.5) / 4294967296 AS u FROM range(2000) t(b))) WHERE place = {at})" for at in (50, 1950))


def _rated(counts: str, cols: str, n: str = "n", k: str = "k", rate: str = "rate", lo: str = "lo", hi: str = "hi") -> str:
    """SQL of a rate and its interval: ``cols`` of ``counts``, the rate k / n, and the binomial quantiles at the ends of the keyed uniforms."""
    return f"""(WITH z AS (SELECT *, row_number() OVER () AS zid FROM {counts}), zj AS (SELECT zid, {n} AS n, {k} AS k, unnest(range(0, {n} + 1)) AS j FROM z),
zc AS (SELECT zid, n, j, sum(CASE WHEN k = 0 THEN (j = 0)::INT::DOUBLE WHEN k = n THEN (j = n)::INT::DOUBLE ELSE exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(k / n) + (n - j) * ln(1 - k / n)) END) OVER (PARTITION BY zid ORDER BY j) AS c FROM zj),
zi AS (SELECT zid, round(coalesce(min(j) FILTER (c >= {_LO}) / nullif(any_value(n), 0), 0.0), 6) AS lo, round(coalesce(min(j) FILTER (c >= {_HI}) / nullif(any_value(n), 0), 0.0), 6) AS hi FROM zc GROUP BY zid)
SELECT {cols}, round(coalesce({k} / nullif({n}, 0), 0.0), 6) AS {rate}, zi.lo AS {lo}, zi.hi AS {hi} FROM z JOIN zi USING (zid))"""


_POISSON = " + ".join(f"(u >= {x})::INT" for x in (24109, 48218, 60273, 64291, 65296, 65497, 65530, 65535))


def _boot(rows: str, b: int, key: str, cols: str, value: str) -> str:
    """SQL of the keyed Poisson bootstrap: the rows with their weights w in each resample, then the values at the interval's places."""
    return f"""r AS (SELECT *, ('0x' || substr(md5('17:' || CAST({key} AS VARCHAR)), 1, 8))::BIGINT AS h1, ('0x' || substr(md5('17:' || CAST({key} AS VARCHAR)), 9, 8))::BIGINT AS h2 FROM {rows}),
d AS (SELECT *, {_POISSON} AS w FROM (SELECT b, r.*, (h1 + b * h2) % 4294967296 // 65536 AS u FROM r, range({b}) x(b))),
s AS (SELECT b, sum(w)::DOUBLE AS n, {cols} FROM d WHERE w > 0 GROUP BY b), m AS (SELECT round({value}, 9) AS m FROM s), o AS (SELECT m, row_number() OVER (ORDER BY m) - 1 AS k, count(*) OVER () AS z FROM m WHERE m IS NOT NULL),
ci AS (SELECT round(max(m) FILTER (k = floor(0.025 * z)), 6) AS lo, round(max(m) FILTER (k = least(z - 1, floor(0.975 * z))), 6) AS hi FROM o)"""


def _drawn(rows: str, b: int, key: str, cols: str, value: str) -> str:
    """SQL of the keyed bootstrap: resamples of as many draws as there are rows, which are numbered, then the values at the interval's places."""
    return f"""r AS (SELECT row_number() OVER (ORDER BY md5('0:' || CAST({key} AS VARCHAR)), {key}) - 1 AS i, count(*) OVER () AS n, * FROM {rows}),
d AS (SELECT b, ('0x' || substr(md5('17:' || CAST(b AS VARCHAR) || ':' || CAST(i AS VARCHAR)), 1, 8))::BIGINT % n AS i FROM r, range({b}) x(b)),
s AS (SELECT b, count(*) AS n, {cols} FROM d JOIN r USING (i) GROUP BY b), m AS (SELECT round({value}, 9) AS m FROM s), o AS (SELECT m, row_number() OVER (ORDER BY m) - 1 AS k FROM m WHERE m IS NOT NULL),
ci AS (SELECT round(max(m) FILTER (k = {int(0.025 * b)}), 6) AS lo, round(max(m) FILTER (k = {min(b - 1, int(0.975 * b))}), 6) AS hi FROM o)"""


@query("SELECT n, rate AS mean, lo, hi FROM " + _rated("(SELECT count(quality) AS n, count(*) FILTER (quality = 1) AS k FROM labels)", "n"))
def bootstrap_rate(spark, sf_dir):
    return stats.bootstrap_flag(table(spark, sf_dir, "labels"), "quality", 2000)


@query(f"WITH {_boot('(SELECT doc_id, n_chars::DOUBLE AS v FROM documents)', 2000, 'doc_id', 'sum(w * v) AS v', 'v / n')} SELECT (SELECT count(*) FROM r) AS n, round((SELECT avg(v) FROM r), 6) AS mean, lo, hi FROM ci")
def bootstrap_mean(spark, sf_dir):
    return stats.bootstrap_mean(table(spark, sf_dir, "documents"), "doc_id", "n_chars", 2000)


@query(f"WITH {_drawn('(SELECT doc_id, (quality - toxic)::DOUBLE AS v FROM labels)', 1000, 'doc_id', 'sum(v) AS v', 'v / n')} SELECT (SELECT count(*) FROM r) AS n, round((SELECT avg(v) FROM r), 6) AS mean, lo, hi FROM ci")
def bootstrap_paired(spark, sf_dir):
    return stats.bootstrap_paired(table(spark, sf_dir, "labels"), "doc_id", "quality", "toxic", 1000, draws=True)


_CELLS = "(SELECT source, count(*) FILTER (t AND p)::DOUBLE AS tp, count(*) FILTER (NOT t AND p)::DOUBLE AS fp, count(*) FILTER (NOT t AND NOT p)::DOUBLE AS tn, count(*) FILTER (t AND NOT p)::DOUBLE AS fn FROM (SELECT source, quality = 1 AS t, n_chars > 1500 AS p FROM documents JOIN labels USING (doc_id)) GROUP BY source)"
_BA = "(tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2"


@query(f"WITH {_boot(_CELLS, 1000, 'source', 'sum(w * tp) AS tp, sum(w * fp) AS fp, sum(w * tn) AS tn, sum(w * fn) AS fn', _BA)} SELECT c.n AS n_clusters, round({_BA}, 6) AS value, lo, hi FROM (SELECT count(*) AS n, sum(tp) AS tp, sum(fp) AS fp, sum(tn) AS tn, sum(fn) AS fn FROM r) c, ci")
def bootstrap_cluster(spark, sf_dir):
    df = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("source", (F.col("quality") == 1).alias("t"), (F.col("n_chars") > 1500).alias("p"))
    return stats.bootstrap_cluster(df, "source", "t", "p", 1000)


@query("WITH p AS (SELECT source, avg(toxic) AS p FROM documents JOIN labels USING (doc_id) GROUP BY source) SELECT source, round(p, 6) AS p, round(least(1.0, p * (SELECT count(*) FROM p)), 6) AS p_adjusted FROM p")
def bonferroni(spark, sf_dir):
    p = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").groupBy("source").agg(F.avg("toxic").alias("p"))
    return stats.bonferroni(p, "p").select("source", *(F.round(c, 6).alias(c) for c in ("p", "p_adjusted")))


_REC = "(SELECT doc_id, [replace(lower(source), 'src', 'Drug-'), 'drug ' || lang] AS rec, CASE quality WHEN 1 THEN ['drug ' || CAST(doc_id % 20 AS VARCHAR), 'DRUG-en'] ELSE [] END AS gold FROM documents JOIN labels USING (doc_id))"


_CONC = f"""(WITH t AS (SELECT list_transform(rec, lambda x: trim(regexp_replace(replace(lower(x), '-', ' '), '\\s+', ' ', 'g'))) AS r, list_transform(gold, lambda x: trim(regexp_replace(replace(lower(x), '-', ' '), '\\s+', ' ', 'g'))) AS g FROM {_REC})
SELECT count(*) FILTER (len(g) > 0) AS n, count(*) FILTER (len(g) > 0 AND list_contains(g, r[1])) AS k1, count(*) FILTER (len(g) > 0 AND list_has_any(r, g)) AS k2, count(*) FILTER (len(g) = 0) AS skipped FROM t)"""


@query("SELECT * FROM " + _rated(_rated(_CONC, "n, skipped, k2", k="k1", rate="top1", lo="top1_lo", hi="top1_hi"), "n, skipped, top1, top1_lo, top1_hi", k="k2", rate="any_match", lo="any_lo", hi="any_hi"))
def concordance(spark, sf_dir):
    return metrics.concordance(_traces(spark, sf_dir))


def _traces(spark, sf_dir):
    df = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    rec = F.array(F.replace(F.lower("source"), F.lit("src"), F.lit("Drug-")), F.concat(F.lit("drug "), "lang"))
    gold = F.when(F.col("quality") == 1, F.array(F.concat(F.lit("drug "), (F.col("doc_id") % 20).cast("string")), F.lit("DRUG-en"))).otherwise(F.array().cast("array<string>"))
    confidence = F.when(F.col("doc_id") % 7 > 0, F.least(F.lit(0.99), F.col("n_chars") / 5000.0))
    return df.select(rec.alias("recommendation"), gold.alias("gold"), confidence.alias("confidence"))


_INTERP = """(WITH t AS (SELECT quality = 1 AS a, n_chars % 4 > 0 AND toxic = 0 AS p FROM documents JOIN labels USING (doc_id)) SELECT count(*) AS n, count(*) FILTER (a = p) AS k, count(*) FILTER (a) AS n_actionable, count(*) FILTER (a AND p) AS actionable_recommended,
count(*) FILTER (a AND NOT p) AS actionable_abstained, count(*) FILTER (NOT a AND p) AS other_recommended, count(*) FILTER (NOT a AND NOT p) AS other_abstained FROM t)"""


@query("SELECT * FROM " + _rated(_INTERP, "n, n_actionable, actionable_recommended, actionable_abstained, other_recommended, other_abstained", rate="agreement"))
def interpretation_2x2(spark, sf_dir):
    df = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return metrics.interpretation(df.select((F.col("quality") == 1).alias("actionable"), (F.col("n_chars") % 4).alias("n_recommended"), (F.col("toxic") == 1).alias("abstained")))


@query("SELECT * FROM " + _rated("(SELECT count(quality) AS n, count(*) FILTER (quality = 1) AS k, count(*) - count(quality) AS unlabelled FROM documents LEFT JOIN labels USING (doc_id))", "n, unlabelled"))
def step_soundness(spark, sf_dir):
    df = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").select((F.col("quality") == 1).alias("label_sound"))
    return metrics.step_soundness(df)


_TOOL = "count(*) AS n, count(*) FILTER (ok) AS k, round(median(latency), 6) AS median_latency, count(*) - count(DISTINCT (tool, coalesce(args, ''))) AS redundant, count(*) FILTER (ok AND n_results = 0) AS empty, array_to_string((list(error ORDER BY ord) FILTER (NOT ok))[1:5], ';') AS errors"


@query("SELECT * FROM " + _rated(f"(SELECT {_TOOL} FROM {CALLS})", "n, median_latency, redundant, empty, errors", rate="success_rate"))
def tool_reliability(spark, sf_dir):
    return metrics.tool_reliability(calls(spark, sf_dir))


@query("SELECT * FROM " + _rated(f"(SELECT trace_id, {_TOOL} FROM {CALLS} GROUP BY trace_id)", "trace_id, n, median_latency, redundant, empty, errors", rate="success_rate"))
def tool_reliability_by_trace(spark, sf_dir):
    return metrics.tool_reliability(calls(spark, sf_dir), ["trace_id"])


@query("SELECT * FROM " + _rated(f"(SELECT count(*) AS n, count(id) AS k FROM {HREFS} LEFT JOIN {RESOLVABLE} ON id = href)", "n"))
def citation_grounding(spark, sf_dir):
    return metrics.citation_grounding(hrefs(spark, sf_dir).select(F.col("page_id").alias("trace_id"), F.col("href").alias("id")), resolvable(spark, sf_dir))


@query("SELECT * FROM " + _rated(f"(SELECT count(*) AS n, count(*) FILTER (page_id IN (SELECT page_id FROM {HREFS})) AS k FROM pages)", "n"))
def citation_presence(spark, sf_dir):
    h = table(spark, sf_dir, "pages").select("page_id").join(hrefs(spark, sf_dir), "page_id", "left").select(F.col("page_id").alias("trace_id"), F.col("href").alias("id"))
    return metrics.citation_grounding(h, None)


_BINS = f"(SELECT b AS bin, count(confidence) AS n, avg(confidence) AS mean_confidence, avg(correct::INT) AS accuracy FROM range(5) x(b) LEFT JOIN {CONFIDENT} ON confidence >= b / 5.0 AND (confidence < (b + 1) / 5.0 OR b = 4) GROUP BY b)"


@query(f"SELECT CAST(bin AS INT) AS bin, n, round(mean_confidence, 6) AS mean_confidence, round(accuracy, 6) AS accuracy FROM {_BINS}")
def calibration_bins(spark, sf_dir):
    return metrics.calibration_bins(confident(spark, sf_dir), "confidence", "correct")


@query(f"""WITH {_boot(f'(SELECT doc_id, (confidence - correct::INT) ** 2 AS v FROM {CONFIDENT})', 2000, 'doc_id', 'sum(w * v) AS v', 'v / n')} SELECT (SELECT count(*) FROM r) AS n, round((SELECT avg(v) FROM r), 6) AS brier,
round((SELECT sum(n * abs(accuracy - mean_confidence)) / sum(n) FROM {_BINS} WHERE n > 0), 6) AS ece, lo AS brier_lo, hi AS brier_hi FROM ci""")
def calibration_ece(spark, sf_dir):
    return metrics.calibration(confident(spark, sf_dir), "confidence", "correct", key="doc_id")


_KEPT = f"(SELECT t AS threshold, count(*) FILTER (confidence >= t) AS kept, count(*) FILTER (confidence >= t) / count(*) AS coverage, count(*) FILTER (confidence >= t AND correct) AS k FROM {CONFIDENT}, (VALUES (0.0::DOUBLE), (0.3), (0.5), (0.7), (0.9)) v(t) GROUP BY t)"


@query(f"""WITH r AS (SELECT *, k / nullif(kept, 0) AS a FROM {_rated(_KEPT, 'threshold, kept, coverage, k', n='kept', rate='accuracy', lo='accuracy_lo', hi='accuracy_hi')}),
f AS (SELECT *, coalesce(a < lag(a IGNORE NULLS) OVER (ORDER BY threshold) - 1e-9, FALSE) AS falls FROM r)
SELECT threshold, kept, round(coverage, 6) AS coverage, CASE WHEN kept > 0 THEN accuracy END AS accuracy, CASE WHEN kept > 0 THEN accuracy_lo END AS accuracy_lo, CASE WHEN kept > 0 THEN accuracy_hi END AS accuracy_hi, NOT bool_or(falls) OVER () AS monotone FROM f""")
def deferral_curve(spark, sf_dir):
    return metrics.deferral_curve(confident(spark, sf_dir), "confidence", "correct")


@query(f"""WITH t AS (SELECT list_transform(rec, lambda x: trim(regexp_replace(replace(lower(x), '-', ' '), '\\s+', ' ', 'g'))) AS r, list_transform(gold, lambda x: trim(regexp_replace(replace(lower(x), '-', ' '), '\\s+', ' ', 'g'))) AS g, c FROM (SELECT *, CASE WHEN doc_id % 7 > 0 THEN least(0.99, n_chars / 5000.0) END AS c FROM {_REC.replace('SELECT doc_id,', 'SELECT doc_id, n_chars,')}))
SELECT list_contains(g, r[1]) AS correct, count(*) AS n, round(avg(c), 6) AS mean_confidence FROM t WHERE len(g) > 0 AND c IS NOT NULL GROUP BY ALL""")
def correct_flags(spark, sf_dir):
    df = _traces(spark, sf_dir)
    return metrics.correct_flags(df).groupBy("correct").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


@query("SELECT count(*) AS n, round(corr(quality::DOUBLE, n_chars::DOUBLE), 6) AS r, round(avg(n_chars) FILTER (quality = 1), 6) AS mean_true, round(avg(n_chars) FILTER (quality = 0), 6) AS mean_false FROM documents JOIN labels USING (doc_id)")
def point_biserial(spark, sf_dir):
    df = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return stats.point_biserial(df, "quality", "n_chars")


_GATHERED = f"""(SELECT trace_id, coalesce(c, 0) + coalesce(t, 0) AS n_evidence FROM (SELECT DISTINCT trace_id FROM {{}}) LEFT JOIN (SELECT page_id AS trace_id, count(DISTINCT href) AS c FROM {HREFS} GROUP BY 1) USING (trace_id)
LEFT JOIN (SELECT trace_id, count(*) AS t FROM {CALLS} WHERE ok AND n_results > 0 GROUP BY 1) USING (trace_id))"""


def _cited(spark, sf_dir):
    return hrefs(spark, sf_dir).select(F.col("page_id").alias("trace_id"), F.col("href").alias("id"))


@query("SELECT * FROM " + _GATHERED.format("(SELECT user_id AS trace_id FROM events)"))
def evidence_gathered(spark, sf_dir):
    c = calls(spark, sf_dir)
    return metrics.evidence_gathered(c, c, _cited(spark, sf_dir))


# The p-value of a correlation: of the powers of the cosine from asin |r| on, the share of their integral from 0.
_INFO = f"""(WITH j AS (SELECT n_evidence, quality = 1 AS correct FROM {_GATHERED.format('(SELECT doc_id AS trace_id FROM labels)')} JOIN labels ON doc_id = trace_id),
s AS (SELECT count(*) AS n, count(*) FILTER (correct) AS n_correct, count(*) FILTER (NOT correct) AS n_incorrect, avg(n_evidence) FILTER (correct) AS a, avg(n_evidence) FILTER (NOT correct) AS b, corr(correct::INT::DOUBLE, n_evidence::DOUBLE) AS r FROM j),
i AS (SELECT sum(w) FILTER (x >= asin(abs(r)) / (pi() / 2)) / sum(w) AS coarse, r FROM (SELECT x, r, cos(x * pi() / 2) ** (n - 3) AS w FROM s, (SELECT (k + 0.5) / 400000 AS x FROM range(400000) t(k))) GROUP BY r)
SELECT n, n_correct, n_incorrect, round(a, 3) AS mean_correct, round(b, 3) AS mean_incorrect, round(s.r, 4) AS r, round(coarse, 4) AS p, s.r > 0.1 AS tracks FROM s, i)"""


@query(f"SELECT * FROM {_INFO}")
def information_gathering(spark, sf_dir):
    t = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("trace_id"), (F.col("quality") == 1).alias("correct"))
    return metrics.information_gathering(t, calls(spark, sf_dir), _cited(spark, sf_dir))


_SCORE = "(SELECT doc_id, source, quality, (n_chars - 1500) / 800.0 AS logit, round(1 / (1 + exp(-greatest(-30.0, least(30.0, (n_chars - 1500) / 800.0)))), 9) AS prob FROM documents JOIN labels USING (doc_id))"


def _scored(spark, sf_dir):
    from attestor.functions.text import calibrated

    df = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    logit = (F.col("n_chars") - 1500) / F.lit(800.0)
    return df.select("doc_id", "source", "quality", logit.alias("logit"), F.round(calibrated(logit, 1.0), 9).alias("prob"))


@query(f"""WITH g AS (SELECT t / 100.0 AS t, CASE quality WHEN 1 THEN -ln(p) ELSE -ln(1 - p) END AS loss FROM (SELECT t, quality, greatest(1e-9, least(1 - 1e-9, 1 / (1 + exp(-greatest(-30.0, least(30.0, logit / (t / 100.0))))))) AS p FROM {_SCORE}, range(1, 501) x(t)))
SELECT t::DOUBLE AS t, round(nll, 6) AS nll FROM (SELECT t, avg(loss) AS nll FROM g GROUP BY t) ORDER BY nll, t LIMIT 1""")
def temperature_grid(spark, sf_dir):
    return verifier.best_temperature(verifier.temperature_grid(_scored(spark, sf_dir), "logit", "quality"))


_NG = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')"


@query(f"""WITH d AS (SELECT doc_id, {_NG} AS w FROM documents), t AS (SELECT doc_id, unnest(w || [w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) AS term FROM d), f AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
i AS (SELECT term, ln((1 + (SELECT count(*) FROM d)) / (1 + count(*))) + 1 AS idf FROM f GROUP BY term), x AS (SELECT doc_id, term, (1 + ln(tf)) * idf AS w FROM f JOIN i USING (term)), n AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM x GROUP BY doc_id)
SELECT doc_id AS key, count(*) AS n_terms, round(sum(w / norm), 4) AS total, round(max(w / norm), 6) AS top FROM x JOIN n USING (doc_id) GROUP BY doc_id""")
def tfidf_features(spark, sf_dir):
    return verifier.tfidf(table(spark, sf_dir, "documents"), "doc_id", "text", named=False).groupBy("key").agg(F.count("*").alias("n_terms"), F.round(F.sum("weight"), 4).alias("total"), F.round(F.max("weight"), 6).alias("top"))


def _examples(spark, sf_dir):
    """Labelled documents as steps of their source's case, with two ids as evidence; and the same without, as negatives."""
    from attestor.functions.text import featurized

    df = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    ids = F.array(F.concat(F.lit("a:"), F.col("doc_id") % 50), F.lit("b:1"))
    real = df.select("doc_id", "source", featurized(F.col("text"), ids).alias("example"), "quality")
    bare = df.where("quality = 1").select((-F.col("doc_id") - 1).alias("doc_id"), "source", featurized(F.col("text"), F.array().cast("array<string>")).alias("example"), F.lit(0).alias("quality"))
    return real, real.where("quality = 1").unionByName(bare)


@query(None)
def verifier_train_confusion(spark, sf_dir):
    """Trained on 70 % of the sources, reported on the others: no SQL, it is iterative."""
    return verifier.trained(_examples(spark, sf_dir)[0], "doc_id", "example", "quality", "source")[1]


@query(None)
def verifier_transfer(spark, sf_dir):
    """Three arms on one split: no SQL, it is iterative."""
    real, synthetic = _examples(spark, sf_dir)
    return verifier.transfer(real, synthetic, "doc_id", "example", "quality", "source")


# Samples of a case: conversations by their remainder; a step's probability from its length.
_P = "(SELECT conv_id % 20 AS case_id, conv_id AS sample, turn, round(least(1.0, length(text) / 1000.0), 6) AS prob, length(text) AS len, CAST(len(string_split(text, '.')) - 1 AS BIGINT) AS cites FROM conversations)"
_TS = f"(SELECT case_id, sample, min(prob) AS score, sum(len) AS length, sum(cites) AS n_cited FROM {_P} GROUP BY case_id, sample)"


def _steps(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select((F.col("conv_id") % 20).alias("case_id"), F.col("conv_id").alias("sample"), "turn", F.round(F.least(F.lit(1.0), F.length("text") / 1000.0), 6).alias("prob"), F.length("text").alias("len"), (F.size(F.split("text", "[.]")) - 1).alias("cites"))


def _scores(spark, sf_dir):
    return select.trace_scores(_steps(spark, sf_dir), ["case_id", "sample"], "prob")


@query(f"SELECT case_id, sample, score, round((SELECT avg(prob) FROM {_P} p WHERE p.sample = t.sample), 6) AS mean_score FROM {_TS} t")
def trace_score_min(spark, sf_dir):
    mean = select.trace_scores(_steps(spark, sf_dir), ["case_id", "sample"], "prob", "mean").withColumnRenamed("score", "mean_score")
    return _scores(spark, sf_dir).join(mean, ["case_id", "sample"]).withColumn("mean_score", F.round("mean_score", 6))


@query(f"SELECT case_id, sample, score FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, sample) AS r FROM {_TS}) WHERE r = 1")
def best_of_n(spark, sf_dir):
    return select.best_of_n(_scores(spark, sf_dir), "case_id", "sample")


@query(f"SELECT case_id, sample, score FROM {_TS} WHERE score >= 0.1")
def rft_select(spark, sf_dir):
    return select.rft_selected(_scores(spark, sf_dir), 0.1)


_PAIRS = f"""(SELECT case_id, chosen, rejected, chosen_score, rejected_score FROM (SELECT case_id, first(sample ORDER BY score DESC, sample) AS chosen, last(sample ORDER BY score DESC, sample) AS rejected, max(score) AS chosen_score, min(score) AS rejected_score, count(*) AS n FROM {_TS} GROUP BY case_id) WHERE n >= 2 AND chosen_score - rejected_score > 0.05)"""


@query(f"SELECT * FROM {_PAIRS}")
def dpo_pairs(spark, sf_dir):
    return select.dpo_pairs(_scores(spark, sf_dir), "case_id", "sample")


@query(f"""SELECT count(*) AS n_pairs, round(avg((c.length > r.length)::INT), 3) AS chosen_longer_frac, round(avg((c.n_cited > r.n_cited)::INT), 3) AS chosen_more_cited_frac, coalesce(avg((c.length > r.length)::INT) > 0.8 OR avg((c.n_cited > r.n_cited)::INT) > 0.8, FALSE) AS suspicious
FROM {_PAIRS} p JOIN {_TS} c ON c.sample = chosen JOIN {_TS} r ON r.sample = rejected""")
def reward_hacking(spark, sf_dir):
    sizes = _steps(spark, sf_dir).groupBy("case_id", "sample").agg(F.sum("len").alias("length"), F.sum("cites").alias("n_cited"))
    return select.reward_hacking(select.dpo_pairs(_scores(spark, sf_dir), "case_id", "sample"), sizes, "case_id", "sample")


_BON = f"(SELECT case_id, min(q) AS worst, round(avg(q), 6) AS random, first(q ORDER BY score DESC, sample) AS picked, max(q) AS oracle FROM (SELECT *, (sample % 3 = 0)::INT::DOUBLE AS q FROM {_TS}) GROUP BY case_id)"


def _bon(spark, sf_dir):
    return select.bon_experiment(_scores(spark, sf_dir).withColumn("q", F.col("sample") % 3 == 0).withColumn("q", F.col("q").cast("double")), "case_id", "sample", "score", "q")


@query(f"SELECT * FROM {_BON}")
def bon_experiment(spark, sf_dir):
    return _bon(spark, sf_dir)


@query(f"WITH {_boot(f'(SELECT case_id, picked - random AS v FROM {_BON})', 1000, 'case_id', 'sum(w * v) AS v', 'v / n')} SELECT (SELECT count(*) FROM r) AS n, round((SELECT avg(v) FROM r), 6) AS mean, lo, hi FROM ci")
def bon_lift(spark, sf_dir):
    return stats.bootstrap_paired(_bon(spark, sf_dir), "case_id", "picked", "random", 1000)


@query(f"SELECT source AS arm, count(*) AS n, round(avg(correct::INT), 6) AS rate FROM {CONFIDENT} GROUP BY source")
def arms_compared(spark, sf_dir):
    return select.arms_compared(confident(spark, sf_dir).withColumnRenamed("source", "arm"), "arm", "correct")


_ARMT = """(SELECT *, CASE doc_id % 3 WHEN 0 THEN 'scaffold' WHEN 1 THEN 'one_sample' ELSE 'best_of_n' END AS arm, 'drug ' || CAST(doc_id % 4 AS VARCHAR) AS rec, CASE WHEN quality = 1 THEN 'drug ' || CAST(doc_id % 3 AS VARCHAR) END AS gold,
  CASE WHEN doc_id % 7 > 0 THEN least(0.99, n_chars / 5000.0) END AS c, toxic = 1 AS abst, n_chars % 9 AS ns, n_chars % 4 AS so FROM documents JOIN labels USING (doc_id))"""
_ARMC = f"""(SELECT arm, 'guideline_concordance_top1' AS metric, count(gold) AS n, count(*) FILTER (rec = gold) AS k FROM {_ARMT} GROUP BY arm UNION ALL SELECT arm, 'guideline_concordance_any', count(gold), count(*) FILTER (rec = gold OR gold = 'drug 1') FROM {_ARMT} GROUP BY arm
  UNION ALL SELECT arm, 'interpretation_agreement', count(*), count(*) FILTER ((NOT abst) = (quality = 1)) FROM {_ARMT} GROUP BY arm UNION ALL SELECT arm, 'step_soundness', CAST(sum(ns + 4) AS BIGINT), CAST(sum(so) AS BIGINT) FROM {_ARMT} GROUP BY arm
  UNION ALL SELECT arm, 'citation_grounding', CAST(sum(ns) AS BIGINT), CAST(sum(least(ns, so)) AS BIGINT) FROM {_ARMT} GROUP BY arm UNION ALL SELECT arm, 'abstained', count(*), count(*) FILTER (abst) FROM {_ARMT} GROUP BY arm
  UNION ALL SELECT arm, 'kept_at_half_correct', count(*) FILTER (gold IS NOT NULL AND c >= 0.5), count(*) FILTER (gold IS NOT NULL AND c >= 0.5 AND rec = gold) FROM {_ARMT} GROUP BY arm)"""


@query(f"SELECT * FROM {_rated(_ARMC, 'arm, metric, n', rate='value')} UNION ALL SELECT arm, 'brier', count(*), round(avg((c - (rec = gold)::INT) ** 2), 6), NULL, NULL FROM {_ARMT} WHERE gold IS NOT NULL AND c IS NOT NULL GROUP BY arm")
def arm_metrics(spark, sf_dir):
    df = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    arm = F.when(F.col("doc_id") % 3 == 0, "scaffold").when(F.col("doc_id") % 3 == 1, "one_sample").otherwise("best_of_n")
    drug = lambda m: F.concat(F.lit("drug "), (F.col("doc_id") % m).cast("string"))
    gold = F.when(F.col("quality") == 1, F.array(F.initcap(drug(3)))).otherwise(F.array().cast("array<string>"))
    conf = F.when(F.col("doc_id") % 7 > 0, F.least(F.lit(0.99), F.col("n_chars") / 5000.0))
    n, k = F.col("n_chars") % 9, F.col("n_chars") % 4
    return select.arm_metrics(df.select(arm.alias("arm"), F.array(drug(4), F.lit("Drug-1")).alias("recommendation"), gold.alias("gold"), conf.alias("confidence"), (F.col("toxic") == 1).alias("abstained"), (F.col("quality") == 1).alias("actionable"), (n + 4).alias("n_steps"), k.alias("n_sound"), n.alias("n_cited"), F.least(n, k).alias("n_resolved")))


@query(f"SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, tool, count(*) AS n, round(avg(ok::INT), 6) AS success_rate, round(avg(latency), 4) AS mean_latency FROM (SELECT e.ts, c.* FROM {CALLS} c JOIN events e ON e.event_id = c.ord) GROUP BY ALL")
def stream_reliability(spark, sf_dir):
    """The events file as a stream, once through; the result is one row for each day and tool."""
    from attestor.streaming import reliability

    source = table(spark, sf_dir, "events")
    events = spark.readStream.schema(source.schema).parquet(f"{sf_dir}/events.parque[t]")
    c = events.select("ts", F.col("event_type").alias("tool"), (F.col("event_type") != "error").alias("ok"), F.col("value").alias("latency"))
    return reliability.run_once(reliability.windowed_reliability(c.withColumn("ts", F.col("ts").cast("timestamp")), late="60 days"), "attestor_reliability")


@query("SELECT CAST(user_id AS VARCHAR) AS trace_id, count(*) AS n, count(*) - count(DISTINCT (event_type, coalesce(props, ''))) AS redundant, round(avg((event_type <> 'error')::INT), 6) AS success_rate FROM events GROUP BY user_id")
def stream_repeats(spark, sf_dir):
    """The events file as a stream of calls: repeats flagged by keyed state, appended to files, and counted by trace."""
    from attestor.streaming import repeats

    source = table(spark, sf_dir, "events")
    events = spark.readStream.schema(source.schema).parquet(f"{sf_dir}/events.parque[t]")
    c = events.select(F.col("user_id").alias("trace_id"), F.col("event_id").alias("ord"), "ts", F.col("event_type").alias("tool"), F.coalesce("props", F.lit("")).alias("args"), (F.col("event_type") != "error").alias("ok"), F.col("value").alias("latency"))
    folder = shared_folder(spark)
    return repeats.repeats(repeats.appended(repeats.flagged(c, late="60 days"), f"{folder}/flagged", f"{folder}/checkpoint"))


@query("SELECT trace_id, count(*) AS n_sessions, CAST(sum(n) AS BIGINT) AS n FROM (SELECT user_id AS trace_id, s, count(*) AS n FROM (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS f FROM events)) GROUP BY ALL) GROUP BY trace_id")
def call_sessions(spark, sf_dir):
    from attestor.streaming import reliability

    c = table(spark, sf_dir, "events").select(F.col("user_id").alias("trace_id"), F.col("ts").cast("timestamp").alias("ts"))
    return reliability.call_sessions(c).groupBy("trace_id").agg(F.count("*").alias("n_sessions"), F.sum("n").alias("n"))


# Metric to (value, lower and upper end of its interval, which row).
_REPORT = {
    "concordance": ("top1", "top1_lo", "top1_hi", "true"), "interpretation_2x2": ("agreement", "lo", "hi", "true"), "step_soundness": ("rate", "lo", "hi", "true"),
    "tool_reliability": ("success_rate", "lo", "hi", "true"), "citation_grounding": ("rate", "lo", "hi", "true"), "calibration_ece": ("brier", "brier_lo", "brier_hi", "true"),
    "deferral_curve": ("accuracy", "accuracy_lo", "accuracy_hi", "threshold = 0.5"), "information_gathering": ("r", None, None, "true"),
}


def _end(c: str | None) -> str:
    return c or "CAST(NULL AS DOUBLE)"


@query(" UNION ALL ".join(f"SELECT '{m}' AS metric, {'kept' if m == 'deferral_curve' else 'n'} AS n, {v} AS value, {_end(lo)} AS lo, {_end(hi)} AS hi FROM ({ORACLES[m]}) WHERE {cond}" for m, (v, lo, hi, cond) in _REPORT.items()))
def evaluation_report(spark, sf_dir):
    """All eight metrics of a run as rows, with their intervals."""
    out = None
    for m, (v, lo, hi, cond) in _REPORT.items():
        row = QUERIES[m](spark, sf_dir).where(cond)
        n = F.col("kept" if m == "deferral_curve" else "n").cast("bigint").alias("n")
        row = row.select(F.lit(m).alias("metric"), n, F.col(v).alias("value"), F.expr(_end(lo)).alias("lo"), F.expr(_end(hi)).alias("hi"))
        out = row if out is None else out.unionByName(row)
    return out
