"""Queries over labels, negatives, agreement, candidate parsing and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestor.functions import text as T
from attestor.operators import labels, reports
from attestor.plans.roles import HREFS, RESOLVABLE, hrefs, resolvable
from attestor.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
SEED = 17


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return keep


# A page is a trace; its links are cited in steps of two.
_STEPS = f"(SELECT page_id * 1000 + pos // 2 AS step_id, page_id, pos // 2 AS step_index, list(href ORDER BY pos) AS cited FROM {HREFS} GROUP BY ALL)"


def _steps(spark, sf_dir):
    per = hrefs(spark, sf_dir).withColumn("step_index", F.expr("bigint(pos div 2)")).groupBy("page_id", "step_index")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "href"))), lambda x: x["href"])
    return per.agg(ordered.alias("cited")).select((F.col("page_id") * 1000 + F.col("step_index")).alias("step_id"), "page_id", "step_index", "cited")


@query(f"SELECT step_id, len(cited) = 0 OR bool_or(id IS NOT NULL) AS sound FROM (SELECT step_id, cited, unnest(cited) AS c FROM {_STEPS}) LEFT JOIN {RESOLVABLE} ON id = c GROUP BY step_id, cited")
def step_explode_label(spark, sf_dir):
    s = _steps(spark, sf_dir)
    ok = s.select("step_id", F.explode("cited").alias("id")).join(resolvable(spark, sf_dir), "id").groupBy("step_id").agg(F.collect_list("id").alias("ok"))
    return s.join(ok, "step_id", "left").select("step_id", labels.guideline_label(F.col("cited"), F.coalesce("ok", F.array().cast("array<string>"))).alias("sound"))


_SHOWN = "CASE pos % 3 WHEN 0 THEN 'doc:' || href WHEN 1 THEN href ELSE 'some free ' || href END"
_RAW = f"(SELECT page_id, CASE WHEN page_id % 2 = 0 THEN string_agg({_SHOWN}, ', ' ORDER BY pos) ELSE string_agg({_SHOWN}, ' and ' ORDER BY pos) END AS raw FROM {HREFS} GROUP BY page_id)"
_TOKENS = f"""(SELECT page_id, token, CASE WHEN k.id IS NOT NULL THEN 'resolved' WHEN regexp_matches(token, '^[A-Za-z0-9_.\\-]+$') AND s.id IS NOT NULL THEN 'resolved_suffix'
  WHEN regexp_matches(token, '^[A-Za-z_]+:[A-Za-z0-9_.\\-]+$') OR regexp_matches(token, '^[A-Za-z0-9_.\\-]+$') THEN 'invented' ELSE 'prose' END AS kind
  FROM (SELECT page_id, trim(trim(unnest(regexp_split_to_array(raw, '(?i)\\s*(?:,|;|&|\\band\\b)\\s*'))), '.') AS token FROM {_RAW}) t
  LEFT JOIN (SELECT 'doc:' || id AS id FROM {RESOLVABLE}) k ON k.id = t.token LEFT JOIN {RESOLVABLE} s ON s.id = t.token WHERE token <> '')"""


def _tokens(spark, sf_dir):
    h = hrefs(spark, sf_dir)
    shown = F.when(F.col("pos") % 3 == 0, F.concat(F.lit("doc:"), "href")).when(F.col("pos") % 3 == 1, F.col("href")).otherwise(F.concat(F.lit("some free "), "href"))
    per = h.groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", shown.alias("s")))), lambda x: x["s"]).alias("l"))
    raw = per.select("page_id", F.when(F.col("page_id") % 2 == 0, F.array_join("l", ", ")).otherwise(F.array_join("l", " and ")).alias("raw"))
    ids = resolvable(spark, sf_dir).select(F.concat(F.lit("doc:"), "id").alias("id"))
    return labels.normalised_citations(raw, "raw", ids)


@query(f"SELECT page_id, token, kind, count(*) AS n FROM {_TOKENS} GROUP BY ALL")
def citation_normalise(spark, sf_dir):
    return _tokens(spark, sf_dir).groupBy("page_id", "token", "kind").agg(F.count("*").alias("n"))


# A page's own pool: its links but every fifth; the other ids that resolve belong to other pages.
_POOLS = f"(SELECT DISTINCT page_id AS case_id, 'doc:' || href AS id FROM {HREFS} JOIN {RESOLVABLE} ON id = href WHERE pos % 5 <> 0)"
_STEPRAW = f"(SELECT page_id * 1000 + pos // 4 AS step_id, page_id AS case_id, string_agg({_SHOWN}, ', ' ORDER BY pos) AS raw FROM {HREFS} GROUP BY page_id, pos // 4)"
_FOUND = f"""WITH g AS (SELECT DISTINCT id FROM {_POOLS}), b AS (SELECT split_part(id, ':', 2) AS bare, min(id) AS id FROM g GROUP BY 1),
t AS (SELECT step_id, case_id, trim(trim(x), '.') AS token FROM (SELECT step_id, case_id, unnest(regexp_split_to_array(raw, '(?i)\\s*(?:,|;|&|\\band\\b)\\s*')) AS x FROM {_STEPRAW})),
k AS (SELECT t.*, coalesce(g.id, CASE WHEN regexp_matches(token, '^[A-Za-z0-9_.\\-]+$') THEN b.id END) AS rid, regexp_matches(token, '^[A-Za-z_]+:[A-Za-z0-9_.\\-]+$') OR regexp_matches(token, '^[A-Za-z0-9_.\\-]+$') AS formed
  FROM t LEFT JOIN g ON g.id = token LEFT JOIN b ON b.bare = token WHERE token <> ''),
c AS (SELECT k.*, rid IS NOT NULL AND p.id IS NULL AS off FROM k LEFT JOIN {_POOLS} p ON p.case_id = k.case_id AND p.id = rid)"""
_RELABEL = f"""({_FOUND}
SELECT r.step_id, any_value(r.case_id) AS case_id, count(rid) AS n_cited, count(*) FILTER (token IS NOT NULL AND rid IS NULL AND formed) AS n_invented, count(*) FILTER (token IS NOT NULL AND rid IS NULL AND NOT formed) AS n_prose, count(*) FILTER (off) AS n_off_case FROM {_STEPRAW} r LEFT JOIN c USING (step_id) GROUP BY r.step_id)"""


def _relabelled(spark, sf_dir):
    h = hrefs(spark, sf_dir)
    shown = F.when(F.col("pos") % 3 == 0, F.concat(F.lit("doc:"), "href")).when(F.col("pos") % 3 == 1, F.col("href")).otherwise(F.concat(F.lit("some free "), "href"))
    per = h.groupBy("page_id", F.expr("pos div 4").alias("s")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", shown.alias("s")))), lambda x: x["s"]).alias("l"))
    steps = per.select((F.col("page_id") * 1000 + F.col("s")).alias("step_id"), F.col("page_id").alias("case_id"), F.array_join("l", ", ").alias("raw"))
    pools = h.where("pos % 5 <> 0").join(resolvable(spark, sf_dir), F.col("href") == F.col("id")).select(F.col("page_id").alias("case_id"), F.concat(F.lit("doc:"), "id").alias("id")).distinct()
    return labels.relabelled_steps(steps, pools, ["case_id", "step_id"])


@query(f"SELECT step_id, n_cited, n_invented, n_prose, n_off_case, n_cited > 0 AND n_invented = 0 AND n_off_case = 0 AS sound FROM {_RELABEL}")
def structural_label(spark, sf_dir):
    n = lambda c: F.size(c).cast("bigint").alias(f"n_{c}")
    return _relabelled(spark, sf_dir).select("step_id", n("cited"), n("invented"), n("prose"), n("off_case"), F.col("label_sound").alias("sound"))


@query(f"""SELECT count(DISTINCT case_id) AS n_samples, count(*) AS n_steps, round(avg((n_cited > 0 AND n_invented = 0 AND n_off_case = 0)::INT), 3) AS sound_rate, round(1 - avg((n_cited > 0 AND n_invented = 0 AND n_off_case = 0)::INT), 3) AS unsound_rate,
  count(*) FILTER (n_cited = 0 AND n_invented = 0) AS steps_uncited, count(*) FILTER (n_invented > 0) AS steps_with_invented, count(*) FILTER (n_prose > 0) AS steps_with_prose, count(*) FILTER (n_off_case > 0) AS steps_off_case,
  ({_FOUND} SELECT count(DISTINCT token) FROM c WHERE rid IS NULL AND formed) AS distinct_invented_ids FROM {_RELABEL}""")
def relabel_report(spark, sf_dir):
    return reports.relabel_report(_relabelled(spark, sf_dir), ["case_id"])


@query(f"SELECT kind, count(*) AS n, count(DISTINCT token) AS n_distinct FROM {_TOKENS} GROUP BY kind")
def citation_kinds(spark, sf_dir):
    return reports.citation_kinds(_tokens(spark, sf_dir))


@query(f"SELECT token, count(*) AS n FROM {_TOKENS} WHERE kind = 'invented' GROUP BY token ORDER BY n DESC, token LIMIT 10")
def relabel_top_invented(spark, sf_dir):
    return reports.top_invented(_tokens(spark, sf_dir))


# A turn of a conversation is a step; it cites the orders of its number; two words of each language's prose stand for names.
_TURNS = """(SELECT conv_id * 1000 + turn AS step_id, conv_id, turn, CASE conv_id % 4 WHEN 0 THEN 'The drug is effective. ' WHEN 1 THEN 'Avoid: resistant tumour. ' WHEN 2 THEN 'No benefit, not effective. ' ELSE '' END || text AS text, CASE turn % 2 WHEN 0 THEN 'lung' ELSE 'breast cancer' END AS tumor FROM conversations)"""
_RECS = """(SELECT 'r' || CAST(s_suppkey AS VARCHAR) AS id, CASE s_suppkey % 3 WHEN 0 THEN 'SENSITIVITYRESPONSE' WHEN 1 THEN 'RESISTANCE' END AS significance, CASE s_suppkey % 5 WHEN 0 THEN 'DOES_NOT_SUPPORT' ELSE 'SUPPORTS' END AS direction,
  CASE s_suppkey % 4 WHEN 0 THEN 'the' WHEN 1 THEN 'die' ELSE 'que' END AS therapy, CASE s_suppkey % 2 WHEN 0 THEN 'Lung cancer' ELSE 'breast cancer' END AS disease FROM supplier)"""
_B, _R = (p.removeprefix("(?i)") for p in (T.BENEFIT, T.RESISTANCE))
_SEM = f"""(WITH t AS (SELECT *, regexp_matches(text, '(?i){_B}') AS b, regexp_matches(text, '(?i){_R}') AS r FROM {_TURNS}),
s AS (SELECT *, CASE WHEN r AND NOT b THEN 'RESISTANCE' WHEN b AND NOT r THEN 'SENSITIVITY' END AS claim, list_filter(['the', 'die', 'que'], lambda v: contains(lower(text), v)) AS named FROM t),
c AS (SELECT step_id, i AS pos, 'r' || CAST(1 + (step_id * 7 + i * 13) % 120 AS VARCHAR) AS id FROM s, range(2) x(i) WHERE turn % 5 <> 4),
d AS (SELECT *, CASE WHEN direction LIKE 'DOES_NOT%' THEN CASE base WHEN 'SENSITIVITY' THEN 'RESISTANCE' WHEN 'RESISTANCE' THEN 'SENSITIVITY' END ELSE base END AS says FROM (SELECT *, CASE WHEN significance LIKE 'SENSITIVITY%' THEN 'SENSITIVITY' WHEN significance LIKE 'RESISTANCE%' THEN 'RESISTANCE' END AS base FROM {_RECS}))
SELECT step_id, any_value(claim) AS claim, count(c.id) AS n_cited, count(d.id) AS n_judgeable, count(*) FILTER (claim = says) AS n_supporting, coalesce(bool_or(claim <> says), FALSE) AS contradicted,
  coalesce(bool_or(d.id IS NOT NULL AND len(named) > 0 AND NOT list_contains(named, therapy)), FALSE) AS therapy_mismatch, coalesce(bool_or(d.id IS NOT NULL AND NOT contains(lower(disease), lower(tumor))), FALSE) AS disease_mismatch,
  array_to_string(flatten(list([CASE WHEN claim <> says THEN c.id || ': step claims ' || lower(claim) || ', record says ' || lower(says) END, CASE WHEN d.id IS NOT NULL AND len(named) > 0 AND NOT list_contains(named, therapy) THEN c.id || ': step names [''' || array_to_string(list_sort(named), ''', ''') || '''], record is about [''' || therapy || ''']' END,
    CASE WHEN d.id IS NOT NULL AND NOT contains(lower(disease), lower(tumor)) THEN c.id || ': record disease ''' || disease || ''' vs case tumour type ''' || tumor || '''' END] ORDER BY pos))[1:9], '|') AS why
  FROM s LEFT JOIN c USING (step_id) LEFT JOIN d ON d.id = c.id GROUP BY step_id)"""


def _semantic(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations")
    lead = F.when(F.col("conv_id") % 4 == 0, "The drug is effective. ").when(F.col("conv_id") % 4 == 1, "Avoid: resistant tumour. ").when(F.col("conv_id") % 4 == 2, "No benefit, not effective. ").otherwise("")
    s = conv.select((F.col("conv_id") * 1000 + F.col("turn")).alias("step_id"), "turn", F.concat(lead, "text").alias("text"), F.when(F.col("turn") % 2 == 0, "lung").otherwise("breast cancer").alias("tumor"))
    s = s.withColumn("named", T.names_in("text", F.array(F.lit("the"), F.lit("die"), F.lit("que"))))
    c = s.where("turn % 5 <> 4").select("step_id", F.posexplode(F.expr("transform(sequence(0, 1), i -> concat('r', 1 + (step_id * 7 + i * 13) % 120))")).alias("pos", "id"))
    table(spark, sf_dir, "supplier").createOrReplaceTempView("_attestor_supplier")
    r = spark.sql("SELECT * FROM " + _RECS.replace("VARCHAR", "STRING").replace("FROM supplier", "FROM _attestor_supplier"))
    return labels.semantic_labels(s, c, r.select("id", "significance", "direction", F.array("therapy").alias("therapies"), "disease"))


@query(f"SELECT * EXCLUDE (why), coalesce(array_to_string(string_split(why, '|')[1:4], '|'), '') AS reasons, n_cited > 0 AND NOT contradicted AND NOT therapy_mismatch AS sound FROM {_SEM}")
def semantic_label(spark, sf_dir):
    return _semantic(spark, sf_dir).withColumn("reasons", F.array_join("reasons", "|"))


@query(f"SELECT step_id, n_cited > 0 AND NOT contradicted AND NOT therapy_mismatch AND NOT disease_mismatch AND step_id % 3 > 0 AS sound FROM {_SEM}")
def combined_label(spark, sf_dir):
    return _semantic(spark, sf_dir).select("step_id", labels.combined_label(F.col("step_id") % 3 > 0, F.col("sound"), F.col("disease_mismatch")).alias("sound"))


@query(f"""SELECT count(*) AS n_steps, count(*) FILTER (n_cited > 0) AS structural, count(*) FILTER (s) AS semantic, count(*) FILTER (n_cited > 0 AND s) AS "both", count(*) FILTER (contradicted) AS contradicted, count(*) FILTER (therapy_mismatch) AS therapy_mismatch,
  count(*) FILTER (disease_mismatch) AS disease_mismatch, count(*) FILTER (n_judgeable > 0) AS judgeable FROM (SELECT *, n_cited > 0 AND NOT contradicted AND NOT therapy_mismatch AS s FROM {_SEM})""")
def label_composition(spark, sf_dir):
    return reports.label_composition(_semantic(spark, sf_dir).withColumn("structural", F.col("n_cited") > 0).withColumn("semantic", F.col("sound")))


@query(f"""WITH s AS (SELECT step_id, list_distinct(cited) AS own FROM {_STEPS}), ids AS (SELECT id, row_number() OVER (ORDER BY md5('17:' || id), id) - 1 AS pos FROM (SELECT DISTINCT unnest(own) AS id FROM s)),
m AS (SELECT step_id, own, ('0x' || substr(md5('17:' || CAST(step_id AS VARCHAR)), 1, 8))::BIGINT % ((SELECT count(*) FROM ids) - len(own)) AS at_ FROM s), f AS (SELECT step_id, id, row_number() OVER (PARTITION BY step_id ORDER BY pos) - 1 AS k, at_ FROM m, ids WHERE NOT list_contains(own, id))
SELECT step_id AS example_id, '' AS ids, 'strip' AS strategy FROM s UNION ALL SELECT step_id, id, 'swap' FROM f WHERE k = at_""")
def mine_negatives(spark, sf_dir):
    e = _steps(spark, sf_dir).select(F.col("step_id").alias("example_id"), F.col("cited").alias("evidence_ids"), F.lit(True).alias("label_sound"))
    return labels.mined_negatives(e, SEED).select("example_id", F.array_join("evidence_ids", ",").alias("ids"), "strategy")


@query("""WITH c AS (SELECT avg((quality = toxic)::INT) AS po, avg(quality) AS a, avg(toxic) AS b, count(*) AS n FROM labels)
SELECT n, round(po, 6) AS agreement, round(CASE WHEN a * b + (1 - a) * (1 - b) >= 1 THEN 1.0 ELSE (po - (a * b + (1 - a) * (1 - b))) / (1 - (a * b + (1 - a) * (1 - b))) END, 6) AS kappa FROM c""")
def kappa_audit(spark, sf_dir):
    return labels.kappa(table(spark, sf_dir, "labels"), "quality", "toxic")


_ANSWER = """(SELECT conv_id * 1000 + turn AS key, 'STEP 1: ' || replace(text, chr(10), ' ') || ' [CITE: a:1, b:2]' || chr(10) || ' step 2 : second thing' || chr(10) || CASE WHEN turn % 2 = 0 THEN 'Recommendation: drug a; drug b ;' ELSE 'none' END || chr(10) ||
  'CONFIDENCE: about 0.' || CAST(turn % 10 AS VARCHAR) || CASE WHEN turn % 3 = 0 THEN chr(10) || 'confidence: high' ELSE '' END || chr(10) || 'DEFER: ' || CASE WHEN conv_id % 2 = 0 THEN 'Yes' ELSE 'no' END AS raw FROM conversations)"""


@query(f"""WITH l AS (SELECT key, trim(unnest(string_split(raw, chr(10)))) AS line, generate_subscripts(string_split(raw, chr(10)), 1) AS pos FROM {_ANSWER}), s AS (SELECT *, regexp_matches(line, '(?i)^STEP\\s*([0-9]+)\\s*:') AS st FROM l)
SELECT key, count(*) FILTER (st) AS n_steps, CAST(coalesce(sum(CASE WHEN st THEN len(list_filter(string_split(regexp_extract(line, '(?i)\\[CITE:\\s*([^\\]]*)\\]\\s*$', 1), ','), lambda c: trim(c) <> '')) END), 0) AS BIGINT) AS n_cited,
  arg_max(array_to_string(list_filter(list_transform(string_split(line[instr(line, ':') + 1:], ';'), lambda c: trim(c)), lambda c: c <> ''), ';'), pos) FILTER (upper(line) LIKE 'RECOMMENDATION:%') AS recommendation,
  arg_max_null(TRY_CAST(nullif(regexp_extract(line, '[0-9.]+'), '') AS DOUBLE), pos) FILTER (upper(line) LIKE 'CONFIDENCE:%') AS confidence, coalesce(arg_max(lower(line) LIKE '%yes%', pos) FILTER (upper(line) LIKE 'DEFER:%'), FALSE) AS abstained, count(*) FILTER (st) > 0 AS parsed_ok FROM s GROUP BY key""")
def candidate_parse(spark, sf_dir):
    table(spark, sf_dir, "conversations").createOrReplaceTempView("_attestor_conversations")
    raw = spark.sql("SELECT * FROM " + _ANSWER.replace("VARCHAR", "STRING").replace("FROM conversations", "FROM _attestor_conversations"))
    return labels.parsed_candidates(raw, "key", "raw")


# Every case may cite a:1, even ones b:2 as well; the third line cites another id or none.
_POOL2 = "(SELECT DISTINCT conv_id % 20 AS case_id, unnest(CASE WHEN conv_id % 2 = 0 THEN ['a:1', 'b:2'] ELSE ['a:1'] END) AS id FROM conversations)"
_ANSWER2 = _ANSWER.replace("' step 2 : second thing'", "' step 2 : second thing' || CASE turn % 3 WHEN 0 THEN ' [cite: a:1 , c:' || CAST(turn AS VARCHAR) || ']' WHEN 1 THEN ' [CITE: a:1]' ELSE '' END").replace("(SELECT conv_id * 1000 + turn AS key,", "(SELECT conv_id * 1000 + turn AS key, conv_id % 20 AS case_id,")
_CSTEPS = f"""(WITH l AS (SELECT key, case_id, trim(unnest(string_split(raw, chr(10)))) AS line, generate_subscripts(string_split(raw, chr(10)), 1) - 1 AS pos FROM {_ANSWER2}),
s AS (SELECT key, case_id, pos, CAST(regexp_extract(line, '(?i)^STEP\\s*([0-9]+)\\s*:', 1) AS INT) AS index, list_filter(list_transform(string_split(regexp_extract(line, '(?i)\\[CITE:\\s*([^\\]]*)\\]\\s*$', 1), ','), lambda c: trim(c)), lambda c: c <> '') AS cited FROM l WHERE regexp_matches(line, '(?i)^STEP\\s*([0-9]+)\\s*:'))
SELECT key, case_id, pos, index, cited, list_filter(cited, lambda c: NOT list_contains(['a:1', 'b:2'], c)) AS unresolvable, list_filter(cited, lambda c: c = 'b:2' AND case_id % 2 = 1) AS off_case FROM s)"""


def _candidate_steps(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    c.createOrReplaceTempView("_attestor_conversations")
    raw = spark.sql("SELECT * FROM " + _ANSWER2.replace("VARCHAR", "STRING").replace("FROM conversations", "FROM _attestor_conversations"))
    ids = F.when(F.col("conv_id") % 2 == 0, F.array(F.lit("a:1"), F.lit("b:2"))).otherwise(F.array(F.lit("a:1")))
    pools = c.select((F.col("conv_id") % 20).alias("case_id"), F.explode(ids).alias("id")).distinct()
    return labels.parsed_steps(raw, "key", "raw", pools)


@query(f"SELECT key, index, array_to_string(cited, ',') AS cited, array_to_string(unresolvable, ',') AS unresolvable, array_to_string(off_case, ',') AS off_case, len(cited) > 0 AND len(unresolvable) = 0 AND len(off_case) = 0 AS label_sound FROM {_CSTEPS}")
def candidate_steps(spark, sf_dir):
    return _candidate_steps(spark, sf_dir).select("key", "index", *(F.array_join(c, ",").alias(c) for c in ("cited", "unresolvable", "off_case")), "label_sound")


@query(f"SELECT DISTINCT id FROM {_POOL2}")
def global_ids(spark, sf_dir):
    ids = F.when(F.col("conv_id") % 2 == 0, F.array(F.lit("a:1"), F.lit("b:2"))).otherwise(F.array(F.lit("a:1")))
    return labels.global_ids(table(spark, sf_dir, "conversations").select((F.col("conv_id") % 20).alias("case_id"), F.explode(ids).alias("id")))


@query(f"""WITH s AS (SELECT case_id, key // 1000 AS sample, cited, unresolvable, off_case, key % 1000 AS turn, len(cited) > 0 AND len(unresolvable) = 0 AND len(off_case) = 0 AS sound FROM {_CSTEPS}),
p AS (SELECT case_id, sample, count(*) AS n, avg(sound::INT) AS share, max(turn) > 2 AS parsed_ok, sample % 3 = 0 AS abstained FROM s GROUP BY case_id, sample), w AS (SELECT case_id, max(share) - min(share) AS spread FROM p GROUP BY case_id HAVING count(*) > 1)
SELECT count(*) AS n_samples, count(DISTINCT case_id) AS n_cases, round(avg(parsed_ok::INT), 4) AS parse_rate, CAST(sum(n) AS BIGINT) AS n_steps, round((SELECT avg((NOT sound)::INT) FROM s), 4) AS unsound_step_rate, (SELECT count(*) FILTER (len(unresolvable) > 0) FROM s) AS invented_id_steps,
  (SELECT count(*) FILTER (len(off_case) > 0) FROM s) AS off_case_id_steps, (SELECT count(*) FILTER (len(cited) = 0) FROM s) AS uncited_steps, round(avg(abstained::INT), 4) AS abstain_rate, round((SELECT avg(spread) FROM w), 4) AS mean_within_case_spread, round(avg(n), 4) AS mean_steps_per_sample FROM p""")
def sampling_report(spark, sf_dir):
    c = _candidate_steps(spark, sf_dir).withColumnRenamed("label_sound", "sound").withColumn("sample", F.expr("key div 1000")).withColumn("case_id", F.col("sample") % 20)
    samples = c.groupBy("case_id", "sample").agg((F.max(F.col("key") % 1000) > 2).alias("parsed_ok"), (F.first("sample") % 3 == 0).alias("abstained"))
    return reports.sampling_report(samples, c)


@query(f"SELECT page_id AS case_id, step_index, 'step ' || CAST(step_index AS VARCHAR) AS step_text, array_to_string(cited, ' ') AS evidence, bool_or(id IS NOT NULL) AS label_sound FROM (SELECT *, unnest(cited) AS c FROM {_STEPS}) LEFT JOIN {RESOLVABLE} ON id = c GROUP BY ALL")
def prm_examples(spark, sf_dir):
    s = _steps(spark, sf_dir).select(F.col("page_id").alias("case_id"), "step_index", F.concat(F.lit("step "), F.col("step_index").cast("string")).alias("text"), "cited")
    return labels.prm_examples(s, resolvable(spark, sf_dir)).withColumn("evidence", F.array_join("evidence_ids", " ")).drop("evidence_ids")
