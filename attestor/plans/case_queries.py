"""Queries over record checks, profiles, evidence, fusion and timelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestor.functions.text import literal_map
from attestor.operators import calls, evidence, fusion, metrics, profiles, qc, run, tools
from attestor.plans.roles import HREFS, RECORDS, RESOLVABLE, TASK_RECORDS, TASK_WIDE, hrefs, record_parts, records, resolvable
from attestor.plans.text_queries import _CONS, _EXP, _MISSING
from attestor.session import shared_folder, stored, table
from attestor.sources import format

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
STUDIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
SEED, HIGH = 17, 10


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return keep


_BUILD = f"""CASE WHEN lower(trim(build)) IN {_MISSING} THEN NULL WHEN lower(trim(build)) IN ('hg19','grch37','b37','37') THEN 'GRCh37'
  WHEN lower(trim(build)) IN ('hg38','grch38','b38','38') THEN 'GRCh38' ELSE upper(trim(build)) END"""
_Q = {
    "build": f"SELECT study, 'build_mixed' AS \"check\", 'high' AS severity, NULL AS sample, NULL AS gene, string_agg(DISTINCT b, ',' ORDER BY b) AS detail FROM (SELECT study, {_BUILD} AS b FROM {RECORDS}) GROUP BY study HAVING count(DISTINCT b) > 1",
    "type": f"SELECT study, 'type_vs_protein', 'medium', CAST(sample AS VARCHAR), gene, concat_ws(' ', mutation_type, change, {_CONS}) FROM {RECORDS} WHERE {_CONS} <> 'empty' AND {_CONS} <> {_EXP}",
    "zero": f"SELECT study, 'vaf_zero_alt', 'medium', CAST(sample AS VARCHAR), gene, coalesce(change, 'None') FROM {RECORDS} WHERE alt_count = 0",
    "dup": f"SELECT study, 'duplicate_row', 'low', CAST(sample AS VARCHAR), NULL, CAST(count(*) AS VARCHAR) || 'x ' || coalesce(change, 'None') FROM {RECORDS} GROUP BY study, sample, gene_id, change HAVING count(*) > 1",
    "hyper": f"SELECT study, 'hypermutator', 'low', CAST(sample AS VARCHAR), NULL, CAST(count(*) AS VARCHAR) FROM {RECORDS} GROUP BY study, sample HAVING count(*) >= {HIGH}",
}
_HEAD = 'SELECT * FROM ({}) AS t(study, "check", severity, sample, gene, detail)'
_ALL = " UNION ALL ".join(_Q.values())


@query(_HEAD.format(_Q["build"]))
def qc_build_mixed(spark, sf_dir):
    return qc.build_mixed(records(spark, sf_dir))


@query(_HEAD.format(_Q["type"]))
def qc_type_vs_value(spark, sf_dir):
    return qc.type_vs_protein(records(spark, sf_dir))


@query(_HEAD.format(_Q["zero"]))
def qc_zero_alt(spark, sf_dir):
    return qc.zero_alt(records(spark, sf_dir))


@query(_HEAD.format(_Q["dup"]))
def qc_duplicates(spark, sf_dir):
    return qc.duplicate_rows(records(spark, sf_dir))


@query(_HEAD.format(_Q["hyper"]))
def qc_hypermutator(spark, sf_dir):
    return qc.hypermutator(records(spark, sf_dir), HIGH)


@query(f"SELECT study, severity, count(*) AS n, string_agg(DISTINCT \"check\", ',' ORDER BY \"check\") AS checks FROM ({_HEAD.format(_ALL)}) GROUP BY study, severity")
def qc_summary(spark, sf_dir):
    return qc.qc_summary(qc.run_qc(records(spark, sf_dir), HIGH))


@query(f"{_HEAD.format(_ALL)} WHERE severity = 'low'")
def qc_by_severity(spark, sf_dir):
    return qc.by_severity(qc.run_qc(records(spark, sf_dir), HIGH), "low")


_DROPPED = f"""(SELECT r.* FROM (SELECT *, row_number() OVER (PARTITION BY study, sample, gene_id, change ORDER BY line, part, supp, price) AS copy, count(*) OVER (PARTITION BY study, sample, gene_id, change) AS m FROM {RECORDS}) r
  WHERE (copy = 1 OR NOT EXISTS (SELECT 1 FROM (SELECT study, sample FROM {RECORDS} GROUP BY study, sample, gene_id, change HAVING count(*) > 1) d WHERE d.study = r.study AND d.sample = r.sample)) AND coalesce(alt_count, 1) <> 0 AND change IS NOT NULL)"""


def _dropped(spark, sf_dir):
    return profiles.dropped(records(spark, sf_dir), ["line", "part", "supp", "price"])


@query(f"SELECT study, count(*) AS n, count(DISTINCT sample) AS n_samples, CAST(sum(line) AS BIGINT) AS lines FROM {_DROPPED} GROUP BY study")
def profile_drop_rules(spark, sf_dir):
    return _dropped(spark, sf_dir).groupBy("study").agg(F.count("*").alias("n"), F.countDistinct("sample").alias("n_samples"), F.sum("line").alias("lines"))


_RICH = f"(SELECT study, patient, sample, n FROM (SELECT *, row_number() OVER (PARTITION BY study, patient ORDER BY n DESC, sample DESC) AS r FROM (SELECT study, patient, sample, count(*) AS n FROM {_DROPPED} GROUP BY ALL)) WHERE r = 1)"


def _richest(spark, sf_dir):
    return profiles.richest_sample(_dropped(spark, sf_dir), parts=record_parts(spark, sf_dir))


@query(f"SELECT * FROM {_RICH}")
def profile_richest_sample(spark, sf_dir):
    return _richest(spark, sf_dir)


_FIRST = f"(SELECT study, patient, sample, n FROM (SELECT *, row_number() OVER (PARTITION BY patient ORDER BY study) AS r FROM {_RICH}) WHERE r = 1)"


@query(f"SELECT * FROM {_FIRST}")
def profile_cross_study_dedup(spark, sf_dir):
    return profiles.first_study(_richest(spark, sf_dir), STUDIES)


_CAP = ["WITH rich AS (SELECT *, md5('17:' || CAST(patient AS VARCHAR)) AS k FROM " + _RICH + ")"]
for _i, _s in enumerate(STUDIES):
    _not = "".join(f" AND patient NOT IN (SELECT patient FROM c{_j})" for _j in range(_i))
    _CAP.append(f", c{_i} AS (SELECT study, patient, sample, n FROM rich WHERE study = '{_s}'{_not} ORDER BY k, patient LIMIT 20)")


@query("".join(_CAP) + " " + " UNION ALL ".join(f"SELECT * FROM c{i}" for i in range(len(STUDIES))))
def profile_capped(spark, sf_dir):
    return profiles.capped(_richest(spark, sf_dir), STUDIES, 20, SEED).select("study", "patient", "sample", "n")


_TUMORS = {"1-URGENT": "lung carcinoma", "2-HIGH": "sarcoma"}
_FLAGS = f"(SELECT study, sample, string_agg(DISTINCT \"check\", ',' ORDER BY \"check\") AS flags FROM ({_HEAD.format(_ALL)}) WHERE sample IS NOT NULL GROUP BY ALL)"
_CASES = f"""(SELECT f.study || '-' || CAST(f.sample AS VARCHAR) AS case_id, f.patient, f.study, coalesce(g.flags, '') AS flags, (SELECT string_agg(d.gene || ' ' || d.change, ';' ORDER BY d.line, d.gene, d.change) FROM {_DROPPED} d WHERE d.study = f.study AND d.sample = f.sample) AS alterations
  FROM {_FIRST} f LEFT JOIN {_FLAGS} g ON g.study = f.study AND g.sample = CAST(f.sample AS VARCHAR))"""


def _cases(spark, sf_dir):
    kept, parts = _dropped(spark, sf_dir), record_parts(spark, sf_dir)
    return profiles.assembled(profiles.first_study(profiles.richest_sample(kept, parts=parts), STUDIES), kept, profiles.flags(records(spark, sf_dir), HIGH), parts)


@query(f"SELECT * FROM {_CASES}")
def case_assemble_nested(spark, sf_dir):
    c = _cases(spark, sf_dir)
    alts = F.array_join(F.transform("alterations", lambda a: F.concat_ws(" ", a["gene"], a["change"])), ";")
    return c.select("case_id", "patient", F.col("provenance.study").alias("study"), F.array_join("flags", ",").alias("flags"), alts.alias("alterations"))


_BUILT = f"""(SELECT c.study, c.patient, c.sample, c.n, CASE c.study WHEN '1-URGENT' THEN 'lung carcinoma' WHEN '2-HIGH' THEN 'sarcoma' ELSE 'lung' END AS tumor_type, coalesce(g.flags, '') AS flags FROM ({"".join(_CAP)} {" UNION ALL ".join(f"SELECT * FROM c{i}" for i in range(len(STUDIES)))}) c
  LEFT JOIN {_FLAGS} g ON g.study = c.study AND g.sample = CAST(c.sample AS VARCHAR) WHERE c.n >= 2)""".replace("FROM rich WHERE study", "FROM rich WHERE n >= 2 AND study")


def _built(spark, sf_dir):
    return profiles.built(records(spark, sf_dir), STUDIES, ["line", "part", "supp", "price"], _TUMORS, per_study=20, min_alterations=2, seed=SEED, threshold=HIGH, parts=record_parts(spark, sf_dir))


@query(f"""SELECT b.*, (SELECT string_agg(d.gene || ' ' || d.change, ';' ORDER BY d.line, d.part, d.supp, d.price) FROM {_DROPPED} d WHERE d.study = b.study AND d.sample = b.sample) AS alterations FROM {_BUILT} b""")
def build_profiles(spark, sf_dir):
    alts = F.array_join(F.transform("alterations", lambda a: F.concat_ws(" ", a["gene"], a["change"])), ";")
    return _built(spark, sf_dir).withColumn("alterations", alts).withColumn("flags", F.array_join("flags", ","))


_BUCKET = "(SELECT {k}, row_number() OVER (ORDER BY md5('17:' || CAST({k} AS VARCHAR)), {k}) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT {k} FROM {t}))"
_SPLIT = "CASE WHEN pos < floor(n * 0.7) THEN 'train' WHEN pos < floor(n * 0.7) + floor(n * 0.1) THEN 'val' WHEN pos < floor(n * 0.7) + 2 * floor(n * 0.1) THEN 'test' ELSE 'generalization' END"


@query(f"SELECT c_custkey AS case_id, {_SPLIT} AS split FROM {_BUCKET.format(k='c_custkey', t='customer')}")
def split_hash_case(spark, sf_dir):
    return profiles.split_cases(table(spark, sf_dir, "customer"), "c_custkey", SEED)


@query(f"SELECT conv_id AS case_id, pos < CASE WHEN n <= 1 THEN 0 ELSE greatest(1, floor(n * 0.3)) END AS is_test FROM {_BUCKET.format(k='conv_id', t='conversations')}")
def split_train_test(spark, sf_dir):
    return profiles.split_train_test(table(spark, sf_dir, "conversations"), "conv_id", SEED)


@query(f"""WITH c AS (SELECT case_id, study, flags FROM {_CASES}), s AS (SELECT case_id, {_SPLIT} AS split FROM (SELECT case_id, row_number() OVER (ORDER BY md5('17:' || case_id), case_id) - 1 AS pos, count(*) OVER () AS n FROM c))
SELECT study, split, count(*) AS n_cases, count(*) FILTER (flags <> '') AS n_flagged FROM c JOIN s USING (case_id) GROUP BY study, split""")
def case_manifest(spark, sf_dir):
    c = _cases(spark, sf_dir).select("case_id", F.col("provenance.study").alias("study"), "flags")
    return profiles.manifest(c.join(profiles.split_cases(c, "case_id", SEED), "case_id"))


@query(f"""WITH own AS (SELECT DISTINCT page_id AS case_id, href AS item FROM {HREFS}), items AS (SELECT item, row_number() OVER (ORDER BY md5('17:' || item), item) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT item FROM own)),
p AS (SELECT case_id, ('0x' || substr(md5('17:' || CAST(case_id AS VARCHAR)), 1, 8))::BIGINT % (SELECT count(*) FROM items) AS start FROM (SELECT DISTINCT case_id FROM own)),
t AS (SELECT case_id, item, row_number() OVER (PARTITION BY case_id ORDER BY (pos - start + n) % n) AS r FROM p, items WHERE NOT EXISTS (SELECT 1 FROM own WHERE own.case_id = p.case_id AND own.item = items.item))
SELECT case_id, item, r FROM t WHERE r <= 4""")
def distractor_sample(spark, sf_dir):
    own = hrefs(spark, sf_dir).select(F.col("page_id").alias("case_id"), F.col("href").alias("item"))
    return profiles.distractors(own, 4, SEED).select("case_id", "item", F.col("r").cast("bigint").alias("r"))


_EV = """(SELECT o_orderkey AS ord, o_custkey % 50 AS query_id, substr('ABCDEX', 1 + CAST(o_orderkey % 6 AS INT), 1) AS level, CAST(floor(o_totalprice / 1000) AS BIGINT) % 6 AS rating,
  CASE o_orderkey % 4 WHEN 0 THEN 'REJECTED' ELSE 'ACCEPTED' END AS status, CASE o_orderkey % 3 WHEN 0 THEN 'lung carcinoma' WHEN 1 THEN 'sarcoma' END AS disease, 'Lung adenocarcinoma' AS tumor,
  CASE o_orderkey % 7 WHEN 0 THEN 'PROGNOSTIC' WHEN 1 THEN 'FUNCTIONAL' WHEN 2 THEN 'OTHER' ELSE 'PREDICTIVE' END AS evidence_type, CASE o_orderkey % 5 WHEN 0 THEN 'DOES_NOT_SUPPORT' ELSE 'SUPPORTS' END AS direction,
  CASE o_custkey % 2 WHEN 0 THEN 'SENSITIVITYRESPONSE' ELSE 'RESISTANCE' END AS significance, 'G' || CAST(o_custkey % 16 AS VARCHAR) AS profile, 'EID' || CAST(o_orderkey AS VARCHAR) AS citation_id FROM orders)"""


def _evidence(spark, sf_dir):
    table(spark, sf_dir, "orders").createOrReplaceTempView("_attestor_orders")
    return spark.sql("SELECT * FROM " + _EV.replace("VARCHAR", "STRING").replace("FROM orders", "FROM _attestor_orders"))


_LR = "CASE WHEN instr('ABCDE', level) > 0 THEN instr('ABCDE', level) - 1 ELSE 9 END"


@query(f"""SELECT query_id, ord, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN coalesce(disease, '') LIKE '%lung%' OR coalesce(disease, '') LIKE '%adenocarcinoma%' THEN 0 ELSE 1 END, {_LR}, rating DESC, ord) AS rank
  FROM {_EV} WHERE status = 'ACCEPTED' AND rating >= 1) WHERE rank <= 10""")
def evidence_rank_topk(spark, sf_dir):
    ev = evidence.accepted(_evidence(spark, sf_dir), 1)
    ev = ev.withColumn("matches", evidence.disease_matches(F.col("disease"), F.col("tumor")))
    return evidence.ranked(ev, 10).select("query_id", "ord", F.col("rank").cast("bigint").alias("rank"))


_WANT = "(SELECT n_nationkey AS query_id, 'G' || CAST(n_nationkey % 16 AS VARCHAR) AS gene, CAST(NULL AS VARCHAR) AS variant, CASE n_nationkey % 3 WHEN 0 THEN 'lung' WHEN 1 THEN 'adenocarcinoma' ELSE 'breast' END AS tumor FROM nation)"


@query(f"""SELECT query_id, 'civic:' || citation_id AS citation_id, level, rank FROM (SELECT q.query_id, citation_id, level, row_number() OVER (PARTITION BY q.query_id ORDER BY CASE WHEN contains(lower(coalesce(disease, '')), q.tumor) THEN 0 ELSE 1 END, {_LR}, rating DESC, ord) AS rank
  FROM {_WANT} q JOIN (SELECT * EXCLUDE (tumor, query_id) FROM {_EV} WHERE status = 'ACCEPTED') v ON v.profile = q.gene) WHERE rank <= 5""")
def source_retrieve(spark, sf_dir):
    """Evidence landed as nested answers by gene, read through the registered format, and searched for each query."""
    ev, folder = _evidence(spark, sf_dir), shared_folder(spark)
    raw = ev.select(
        F.col("ord").cast("int").alias("id"), F.col("evidence_type").alias("evidenceType"), F.col("level").alias("evidenceLevel"), F.col("direction").alias("evidenceDirection"), "significance",
        F.col("rating").cast("int").alias("evidenceRating"), "status", F.struct(F.col("disease").alias("name")).alias("disease"), F.struct(F.col("profile").alias("name")).alias("molecularProfile"), "profile",
    )
    format.land(raw, folder, F.col("profile"))
    out = format.retrieved_from(spark, "somatic_evidence", folder, _view(spark, sf_dir, "nation", _WANT), 5)
    return out.select("query_id", "citation_id", "level", F.col("rank").cast("bigint").alias("rank"))


@query(f"SELECT CASE evidence_type WHEN 'PREDICTIVE' THEN 'predictive' WHEN 'PROGNOSTIC' THEN 'prognostic' WHEN 'FUNCTIONAL' THEN 'pathogenicity' ELSE 'literature' END AS kind, count(*) AS n FROM {_EV} GROUP BY ALL")
def evidence_kinds(spark, sf_dir):
    return _evidence(spark, sf_dir).groupBy(evidence.kind(F.col("evidence_type")).alias("kind")).agg(F.count("*").alias("n"))


@query(f"""SELECT p.profile, coalesce(n, 0) AS n_evidence, coalesce(actionable, FALSE) AS actionable, best_level, citations FROM (SELECT DISTINCT 'G' || CAST(p_partkey % 20 AS VARCHAR) AS profile FROM part) p LEFT JOIN
  (SELECT profile, count(*) AS n, bool_or(evidence_type = 'PREDICTIVE' AND direction = 'SUPPORTS' AND significance LIKE '%SENSITIVITY%' AND level IN ('A', 'B')) AS actionable, min(level) AS best_level,
   string_agg(citation_id, ',' ORDER BY {_LR}, rating DESC, citation_id) AS citations FROM {_EV} GROUP BY profile) e USING (profile)""")
def annotate_actionable(spark, sf_dir):
    alts = table(spark, sf_dir, "part").select(F.expr("concat('G', p_partkey % 20)").alias("profile")).distinct()
    return evidence.annotated(alts, _evidence(spark, sf_dir)).select("profile", "n_evidence", "actionable", "best_level", F.array_join("citations", ",").alias("citations"))


# Rich sources know an identifier for every third record.
_TOP5 = f"""(SELECT * FROM (SELECT q.gene, q.tumor_type, v.*, row_number() OVER (PARTITION BY q.gene, q.tumor_type ORDER BY CASE WHEN list_has_any([contains(lower(coalesce(disease, '')), w) for w in list_filter(regexp_split_to_array(lower(q.tumor_type), '\\W+'), lambda t: length(t) > 2)], [TRUE]) THEN 0 ELSE 1 END, {_LR}, rating DESC, ord) AS rank
  FROM (SELECT DISTINCT d.gene, b.tumor_type FROM {_BUILT} b JOIN {_DROPPED} d ON d.study = b.study AND d.sample = b.sample) q JOIN (SELECT * FROM {_EV} WHERE status = 'ACCEPTED') v ON v.profile = q.gene) WHERE rank <= 5)"""
_NOTED = f"""(SELECT gene, tumor_type, bool_or(evidence_type = 'PREDICTIVE' AND direction = 'SUPPORTS' AND significance LIKE '%SENSITIVITY%' AND level IN ('A', 'B')) AS actionable, string_agg(citation_id, ',' ORDER BY rank) AS civic, arg_min(CASE WHEN ord % 3 = 0 THEN 'CA' || CAST(ord AS VARCHAR) END, rank) FILTER (ord % 3 = 0) AS caid,
  array_to_string(list_sort(list_distinct(list(CAST(ord % 100 AS VARCHAR)))), ',') AS clinvar_ids FROM {_TOP5} GROUP BY ALL)"""


@query(f"""WITH c AS (SELECT study || ':' || CAST(sample AS VARCHAR) AS case_id, * FROM {_BUILT}), s AS (SELECT case_id, {_SPLIT} AS split FROM (SELECT case_id, row_number() OVER (ORDER BY md5('17:' || case_id), case_id) - 1 AS pos, count(*) OVER () AS n FROM c)),
a AS (SELECT DISTINCT case_id, d.gene, d.change, c.tumor_type FROM c JOIN {_DROPPED} d ON d.study = c.study AND d.sample = c.sample)
SELECT c.case_id, split, c.tumor_type, c.n AS n_alterations, count(a.gene) AS n_evidence, string_agg(a.gene || ' ' || a.change || '=' || coalesce(civic, '') || '/' || coalesce(actionable, FALSE) || '/' || coalesce(caid, '') || '/' || coalesce(clinvar_ids, ''), ';' ORDER BY a.gene || ' ' || a.change) AS evidence
FROM c JOIN s USING (case_id) LEFT JOIN a ON a.case_id = c.case_id LEFT JOIN {_NOTED} e ON e.gene = a.gene AND e.tumor_type = a.tumor_type GROUP BY ALL""")
def assemble_case(spark, sf_dir):
    built = _built(spark, sf_dir)
    each = built.select("tumor_type", F.explode("alterations").alias("a")).select("a.gene", "a.change", "tumor_type")
    ev = _evidence(spark, sf_dir).drop("tumor").withColumn("summary", F.concat(F.lit("claim "), "citation_id")).withColumn("caid", F.expr("CASE WHEN ord % 3 = 0 THEN concat('CA', ord) END")).withColumn("clinvar_ids", F.expr("array(cast(ord % 100 as string))"))
    recs = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.expr("concat('VCV', s_suppkey)").alias("accession"), F.col("s_name").alias("title"))
    c = profiles.cases(built, evidence.annotation(each, ev, recs), SEED)
    shape = "actionable boolean, caid string, clinvar_ids array<string>, civic array<struct<id: string>>"
    parsed = F.transform(F.array_sort(F.map_entries("provenance.evidence")), lambda e: F.struct(e["key"].alias("k"), F.from_json(e["value"], shape).alias("e")))
    shown = F.transform(parsed, lambda p: F.concat(p["k"], F.lit("="), F.array_join(F.transform(p["e"]["civic"], lambda x: x["id"]), ","), F.lit("/"), p["e"]["actionable"].cast("string"), F.lit("/"), F.coalesce(p["e"]["caid"], F.lit("")), F.lit("/"), F.array_join(p["e"]["clinvar_ids"], ",")))
    return c.select("case_id", "split", "context.tumor_type", F.size("alterations").cast("bigint").alias("n_alterations"), F.size("provenance.evidence").cast("bigint").alias("n_evidence"), F.array_join(shown, ";").alias("evidence"))


@query(f"SELECT page_id, id, coalesce(NULL, 'VCV' || lpad(CAST(page_id AS VARCHAR), 9, '0')) AS accession FROM (SELECT DISTINCT page_id, href AS id FROM {HREFS}) JOIN {RESOLVABLE} USING (id)")
def id_join_explode(spark, sf_dir):
    per = hrefs(spark, sf_dir).groupBy("page_id").agg(F.collect_list("href").alias("ids"))
    return evidence.joined_by_id(per, resolvable(spark, sf_dir)).select("page_id", "id", evidence.accession(F.lit(None), F.col("page_id")).alias("accession"))


@query(f"SELECT DISTINCT href AS id FROM {HREFS} WHERE href NOT IN (SELECT id FROM {RESOLVABLE})")
def missing_id_fetch(spark, sf_dir):
    return evidence.missing_ids(hrefs(spark, sf_dir).select(F.col("href").alias("id")), resolvable(spark, sf_dir))


_CHUNK = """(SELECT n_nationkey AS ord, 'C' || CAST(n_nationkey AS VARCHAR) AS chunk_id, CASE WHEN n_nationkey >= 20 THEN '' ELSE 'G' || CAST(n_nationkey % 12 AS VARCHAR) END AS gene, CASE n_nationkey % 2 WHEN 0 THEN 'Lung adenocarcinoma' ELSE 'Breast cancer' END AS tumor_type,
  CASE n_nationkey % 5 WHEN 0 THEN 'I-A' WHEN 1 THEN 'II-B' WHEN 2 THEN 'N/A' WHEN 3 THEN 'I-B' ELSE 'II-A' END AS tier, n_name AS drug FROM nation)"""
_NEED = "(SELECT p_partkey AS case_id, 'G' || CAST(p_partkey % 16 AS VARCHAR) AS gene, CASE p_partkey % 3 WHEN 0 THEN 'lung squamous' WHEN 1 THEN 'breast' ELSE 'skin' END AS tumor FROM part)"


def _view(spark, sf_dir, name, sql):
    table(spark, sf_dir, name).createOrReplaceTempView(f"_attestor_{name}")
    return spark.sql("SELECT * FROM " + sql.replace("VARCHAR", "STRING").replace(f"FROM {name}", f"FROM _attestor_{name}"))


_PICK = f"""(SELECT case_id, gene, tumor, coalesce((SELECT arg_min(chunk_id, ord) FROM {_CHUNK} c WHERE c.gene = n.gene), CASE tumor WHEN 'lung squamous' THEN 'C20' WHEN 'breast' THEN 'C21' END) AS chunk_id FROM {_NEED} n)"""


@query(f"SELECT * FROM {_PICK}")
def pick_with_fallback(spark, sf_dir):
    return evidence.picked(_view(spark, sf_dir, "part", _NEED), _view(spark, sf_dir, "nation", _CHUNK))


_ALT = f"(SELECT sample AS case_id, line AS ord, gene, supp, part, CASE sample % 3 WHEN 0 THEN 'lung' WHEN 1 THEN 'breast' ELSE 'skin' END AS tumor FROM {RECORDS})"
_TW = "CASE tier WHEN 'I-A' THEN 0.95 WHEN 'I-B' THEN 0.88 WHEN 'I-C' THEN 0.80 WHEN 'II-A' THEN 0.75 WHEN 'II-B' THEN 0.70 ELSE 0.50 END::DOUBLE"
_GL = f"(SELECT a.case_id, drug AS therapy, {_TW} AS w, a.ord * 1000 + c.ord AS ord, tier FROM {_ALT} a JOIN {_CHUNK} c ON c.gene = a.gene)"
_EW = """(SELECT case_id, therapy, CASE WHEN same THEN lw ELSE greatest(0.0, lw - 0.30) END AS w, ord FROM (SELECT case_id, CASE WHEN supp % 2 = 0 THEN lower(n_name) ELSE 'drug' || CAST(supp % 7 AS VARCHAR) END AS therapy, CASE supp % 6 WHEN 0 THEN 0.90 WHEN 1 THEN 0.82 WHEN 2 THEN 0.68 WHEN 3 THEN 0.55 ELSE 0.45 END::DOUBLE AS lw,
  tumor = CASE part % 2 WHEN 0 THEN 'lung' ELSE 'breast' END AS same, ord * 100000 + supp AS ord FROM """ + _ALT + """ JOIN nation ON n_nationkey = supp % 25))"""
_FUSE = f"""cand AS (SELECT case_id, lower(therapy) AS key, max(gl) AS gl, max(ev) AS ev, arg_min(therapy, place) AS therapy, min(place) AS first FROM (SELECT case_id, therapy, w AS gl, 0.0::DOUBLE AS ev, ord AS place FROM {_GL} UNION ALL SELECT case_id, therapy, 0.0, w, 1000000000 + ord FROM {_EW}) GROUP BY ALL),
fused AS (SELECT case_id, therapy, first, CASE WHEN gl > 0 AND ev > 0 THEN least(0.97, greatest(gl, ev) + 0.05) ELSE greatest(gl, ev) END AS combined FROM cand),
ranked AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY round(combined, 6) DESC, first) AS rank FROM fused),
decided AS (SELECT c.case_id, coalesce(string_agg(therapy, ';' ORDER BY rank) FILTER (rank <= 5), '') AS recommendation, coalesce(max(combined), 0.15) AS conf, count(therapy) AS m FROM (SELECT DISTINCT o_orderkey AS case_id FROM orders) c LEFT JOIN ranked USING (case_id) GROUP BY c.case_id)"""


def _alterations(spark, sf_dir, task_records=TASK_RECORDS):
    tumor = F.when(F.col("sample") % 3 == 0, "lung").when(F.col("sample") % 3 == 1, "breast").otherwise("skin")
    return records(spark, sf_dir, task_records).select(F.col("sample").alias("case_id"), F.col("line").alias("ord"), "gene", "supp", "part", tumor.alias("tumor"))


def _guideline(spark, sf_dir):
    c = _view(spark, sf_dir, "nation", _CHUNK).select("gene", "tier", F.col("drug").alias("therapy"), F.col("ord").alias("c_ord"))
    return _alterations(spark, sf_dir, TASK_WIDE).join(c, "gene").withColumn("ord", F.col("ord") * 1000 + F.col("c_ord"))


def _decided(spark, sf_dir):
    # an alteration's mentions are made in its row: of its record's therapy, and of its gene's chunks (25 rows in all)
    chunk = F.struct(F.col("tier"), F.col("drug").alias("therapy"), F.col("ord").alias("c_ord"))
    chunks = _view(spark, sf_dir, "nation", _CHUNK).groupBy("gene").agg(F.collect_list(chunk).alias("chunks"))
    level = F.coalesce(F.try_element_at(F.array(*(F.lit(x) for x in "ABCDE")), (F.col("supp") % 6 + 1).cast("int")), F.lit("E"))
    names = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    a = _alterations(spark, sf_dir, TASK_WIDE).join(F.broadcast(names), F.col("supp") % 25 == F.col("n_nationkey"), "left").join(F.broadcast(chunks), "gene", "left")
    name = F.when(F.col("supp") % 2 == 0, F.lower("n_name")).otherwise(F.concat(F.lit("drug"), (F.col("supp") % 7).cast("string")))
    disease = F.when(F.col("part") % 2 == 0, "lung").otherwise("breast")
    own = fusion.mention(name, fusion.level_weight(level, disease, F.col("tumor")), F.col("ord") * 100000 + F.col("supp"), False)
    own = F.when(F.col("n_nationkey").isNotNull(), F.array(own)).otherwise(F.array_remove(F.array(own), own))
    lines = F.transform(F.coalesce("chunks", F.array().cast(chunks.schema["chunks"].dataType)), lambda c: fusion.mention(c["therapy"], fusion.tier_weight(c["tier"]), F.col("ord") * 1000 + c["c_ord"], True))
    cases = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"))
    return fusion.decided(cases, fusion.fused(a.select("case_id", F.explode(F.concat(lines, own)).alias("m"))))


@query(f"WITH {_FUSE} SELECT case_id, recommendation, round(conf, 3) AS confidence, m = 0 OR conf <= 0.5 AS abstained FROM decided")
def fusion_rank_abstain(spark, sf_dir):
    return _decided(spark, sf_dir).withColumn("recommendation", F.array_join("recommendation", ";"))


_TR = "CASE tier WHEN 'I-A' THEN 0 WHEN 'I-B' THEN 1 WHEN 'I-C' THEN 2 WHEN 'II-A' THEN 3 WHEN 'II-B' THEN 4 ELSE 9 END"
_GOLD = f"""gold AS (SELECT case_id, arg_min(tier, r * 1000000000000 + ord) AS tier, list_distinct([arg_min(therapy, r * 1000000000000 + ord)] || list(therapy ORDER BY ord)) AS names, arg_min(therapy, r * 1000000000000 + ord) AS best,
  list(therapy ORDER BY ord) AS l FROM (SELECT *, {_TR} AS r FROM {_GL}) GROUP BY case_id)"""


@query(f"""WITH {_GOLD}, o AS (SELECT case_id, t, min(p) AS p FROM (SELECT case_id, unnest([best] || l) AS t, generate_subscripts([best] || l, 1) AS p FROM gold) GROUP BY ALL)
SELECT c.case_id, tier, recommended FROM (SELECT DISTINCT o_orderkey AS case_id FROM orders) c LEFT JOIN gold USING (case_id) LEFT JOIN (SELECT case_id, string_agg(t, ';' ORDER BY p) AS recommended FROM o GROUP BY case_id) USING (case_id)""")
def gold_outcome(spark, sf_dir):
    g = _guideline(spark, sf_dir).select("case_id", "ord", "tier", F.array("therapy").alias("therapies"))
    cases = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"))
    return fusion.gold(cases, g).withColumn("recommended", F.array_join("recommended", ";"))


@query(f"""WITH a AS (SELECT case_id, gene, row_number() OVER (PARTITION BY case_id ORDER BY ord, gene, part, supp) AS i, CASE WHEN gene IN (SELECT gene FROM {_CHUNK}) THEN 'Guideline for ' || gene END AS g FROM {_ALT}),
s AS (SELECT case_id, i AS o, 0 AS s, 'variant' AS kind, 'Variant ' || gene AS text FROM a UNION ALL SELECT case_id, i, 1, 'guideline', g FROM a WHERE g IS NOT NULL UNION ALL SELECT DISTINCT case_id, -1, 0, 'planner', 'Plan' FROM a UNION ALL SELECT DISTINCT case_id, 2147483647, 0, 'synthesizer', 'Synthesis' FROM a)
SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY o, s) - 1 AS index, kind, text FROM s""")
def trace_assemble(spark, sf_dir):
    from pyspark.sql import Window as W

    has = _view(spark, sf_dir, "nation", _CHUNK).select("gene").distinct().withColumn("known", F.lit(True))
    a = _alterations(spark, sf_dir).join(has, "gene", "left").withColumn("alt_ord", F.row_number().over(W.partitionBy("case_id").orderBy("ord", "gene", "part", "supp")))
    steps = fusion.trace_steps(a, F.lit("Plan"), F.concat(F.lit("Variant "), "gene"), F.when(F.col("known"), F.concat(F.lit("Guideline for "), "gene")), F.lit("Synthesis"))
    return steps.withColumn("index", F.col("index").cast("bigint"))


_TIME = "(SELECT user_id AS case_id, 't' || strftime(ts, '%Y-%m-%d') AS timepoint, event_type, event_id FROM events)"


def _timeline(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("case_id"), F.concat(F.lit("t"), F.date_format("ts", "yyyy-MM-dd")).alias("timepoint"), "event_type", "event_id")


@query(f"SELECT case_id, count(*) AS n, max(timepoint) AS latest FROM {_TIME} WHERE timepoint <= 't2024-01-15' GROUP BY case_id")
def timeline_until(spark, sf_dir):
    return fusion.until(_timeline(spark, sf_dir), F.lit("t2024-01-15")).groupBy("case_id").agg(F.count("*").alias("n"), F.max("timepoint").alias("latest"))


@query(f"SELECT case_id, string_agg(DISTINCT timepoint, ',' ORDER BY timepoint) AS points FROM {_TIME} GROUP BY case_id")
def decision_points(spark, sf_dir):
    return fusion.decision_points(_timeline(spark, sf_dir)).select("case_id", F.array_join("points", ",").alias("points"))


@query(f"SELECT case_id, event_id, timepoint, row_number() OVER (PARTITION BY case_id ORDER BY timepoint, event_id) - 1 AS place FROM {_TIME}")
def timeline_ordered(spark, sf_dir):
    t = fusion.ordered(_timeline(spark, sf_dir).withColumn("ord", F.col("event_id")))
    return t.select("case_id", "event_id", "timepoint", F.col("place").cast("bigint").alias("place"))


@query(f"SELECT tier, count(*) AS n, round(max({_TW}), 2) AS weight FROM {_CHUNK} GROUP BY tier")
def tier_weights(spark, sf_dir):
    c = _view(spark, sf_dir, "nation", _CHUNK)
    return c.groupBy("tier").agg(F.count("*").alias("n"), F.round(F.max(F.coalesce(F.try_element_at(literal_map(fusion.TIER_WEIGHT), F.col("tier")), F.lit(0.5))), 2).alias("weight"))


_LOOK = f"""a AS (SELECT case_id, 'G' || CAST(part % 16 AS VARCHAR) AS profile, tumor, row_number() OVER (PARTITION BY case_id ORDER BY ord, gene, part, supp) AS alt_ord FROM {_ALT}),
e AS (SELECT profile, tumor, citation_id, summary, rid, level FROM (SELECT q.tumor, v.profile, level, citation_id, 'claim ' || citation_id AS summary, ord % 100 AS rid, row_number() OVER (PARTITION BY v.profile, q.tumor
  ORDER BY CASE WHEN contains(lower(coalesce(disease, '')), q.tumor) THEN 0 ELSE 1 END, {_LR}, rating DESC, ord) AS rank FROM (SELECT DISTINCT profile, tumor FROM a) q JOIN (SELECT * EXCLUDE (tumor) FROM {_EV} WHERE status = 'ACCEPTED') v USING (profile)) WHERE rank <= 5),
r AS (SELECT s_suppkey AS id, 'VCV' || CAST(s_suppkey AS VARCHAR) AS accession, s_name AS title FROM supplier),
l AS (SELECT case_id, alt_ord, citation_id, 'somatic_evidence' AS source, summary AS claim, level FROM a JOIN e USING (profile, tumor) UNION ALL SELECT DISTINCT case_id, alt_ord, accession, 'germline_records', title, NULL FROM a JOIN e USING (profile, tumor) JOIN r ON r.id = e.rid)"""


def _asked(spark, sf_dir, task_records=TASK_RECORDS):
    """Alterations with their profile and place, and the evidence and records that are looked through for them."""
    from pyspark.sql import Window as W

    a = _alterations(spark, sf_dir, task_records).withColumn("profile", F.expr("concat('G', part % 16)"))
    a = a.withColumn("alt_ord", F.row_number().over(W.partitionBy("case_id").orderBy("ord", "gene", "part", "supp")))
    e = evidence.accepted(_evidence(spark, sf_dir)).select("profile", "citation_id", F.concat(F.lit("claim "), "citation_id").alias("summary"), F.array(F.col("ord") % 100).alias("ids"), "disease", "level", "rating", "ord")
    r = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.expr("concat('VCV', s_suppkey)").alias("accession"), F.col("s_name").alias("title"))
    return a, e, r


def _looked_up(spark, sf_dir):
    a, e, r = _asked(spark, sf_dir)
    a = a.select("case_id", "alt_ord", "profile", "tumor")
    return a, tools.variant_lookup(a, e, r)


@query(f"WITH {_LOOK} SELECT * FROM l")
def variant_lookup(spark, sf_dir):
    return _looked_up(spark, sf_dir)[1]


# Every ninth alteration is asked without a tumour: a failed call, which is logged like the others.
_ASKED = "(SELECT case_id, alt_ord, profile, CASE WHEN (case_id + alt_ord) % 9 > 0 THEN tumor END AS tumor FROM a)"


@query(f"""WITH {_LOOK} SELECT a.case_id, a.alt_ord, a.tumor IS NOT NULL AS ok, count(l.case_id) FILTER (a.tumor IS NOT NULL) AS n_results, CASE WHEN a.tumor IS NULL THEN 'ValueError: missing argument tumor' END AS error
FROM {_ASKED} a LEFT JOIN l ON l.case_id = a.case_id AND l.alt_ord = a.alt_ord GROUP BY ALL""")
def tool_call_log(spark, sf_dir):
    a, found = _looked_up(spark, sf_dir)
    asked = a.withColumn("tumor", F.when((F.col("case_id") + F.col("alt_ord")) % 9 > 0, F.col("tumor")))
    return tools.call_log(asked, found, "variant_lookup", ["case_id", "alt_ord"], ["profile", "tumor"]).select("case_id", "alt_ord", "ok", "n_results", "error")


_TIMED = f"""(SELECT case_id, gene, CASE WHEN case_id % 9 > 0 THEN tumor END AS tumor FROM {_NEED})"""
_CALLED = f"""(SELECT case_id, a.tumor IS NOT NULL AND c.gene IS NOT NULL AS ok, CASE WHEN a.tumor IS NOT NULL AND c.gene IS NOT NULL THEN len(list_filter(c.found, lambda x: x = a.tumor)) END AS n_results,
CASE WHEN a.tumor IS NULL THEN 'ValueError: missing argument tumor' WHEN c.gene IS NULL THEN 'KeyError: ' || chr(39) || a.gene || chr(39) END AS error, a.gene || '/' || coalesce(a.tumor, '') AS args
FROM {_TIMED} a LEFT JOIN (SELECT gene, list(tumor_type) AS found FROM {_CHUNK} GROUP BY gene) c USING (gene))"""


def _timed(spark, sf_dir):
    """Calls of a tool that looks a gene up among the guideline chunks (25 rows) and raises for one that isn't there."""
    known: dict[str, list[str]] = {}
    for r in _view(spark, sf_dir, "nation", _CHUNK).select("gene", "tumor_type").collect():
        known.setdefault(r.gene, []).append(r.tumor_type)
    return calls.call_tool(_view(spark, sf_dir, "part", _TIMED), "guideline_chunks", lambda gene, tumor: [t for t in known[gene] if t == tumor], ["gene", "tumor"], ["case_id"])


@query(f"SELECT case_id, ok, n_results, error, TRUE AS timed FROM {_CALLED}")
def tool_call_timed(spark, sf_dir):
    return _timed(spark, sf_dir).select("case_id", "ok", F.col("n_results").cast("bigint").alias("n_results"), "error", (F.col("latency") > 0).alias("timed"))


@query(f"SELECT count(*) AS n, round(count(*) FILTER (ok) / count(*), 6) AS success_rate, count(*) - count(DISTINCT args) AS redundant, count(*) FILTER (ok AND n_results = 0) AS empty FROM {_CALLED}")
def tool_use_timed(spark, sf_dir):
    """Reliability of the calls as they were made; the median latency is measured, and left out here."""
    made = stored(_timed(spark, sf_dir)).withColumn("ord", F.col("case_id"))
    return metrics.tool_reliability(made).select("n", "success_rate", "redundant", "empty")


@query(f"WITH {_LOOK} SELECT case_id, count(*) AS n, string_agg(citation_id || '=' || claim, ';' ORDER BY citation_id) AS pool FROM (SELECT case_id, citation_id, min(claim) AS claim FROM l GROUP BY ALL) GROUP BY case_id")
def evidence_pools(spark, sf_dir):
    p = tools.evidence_pools(_looked_up(spark, sf_dir)[1])
    shown = F.array_join(F.transform(F.array_sort(F.map_keys("pool")), lambda k: F.concat(k, F.lit("="), F.element_at("pool", k))), ";")
    return p.select("case_id", F.size("pool").cast("bigint").alias("n"), shown.alias("pool"))


# Whole traces: an alteration's variant is its part; its chunk is picked by gene, else by tumour.
_TRACE = f"""al AS (SELECT case_id, gene, 'P' || CAST(part AS VARCHAR) AS variant, tumor, 'G' || CAST(part % 16 AS VARCHAR) AS profile, row_number() OVER (PARTITION BY case_id ORDER BY ord, gene, part, supp) AS alt_ord FROM {_ALT}),
pk AS (SELECT gene, tumor, coalesce((SELECT arg_min(chunk_id, ord) FROM {_CHUNK} c WHERE c.gene = n.gene), CASE tumor WHEN 'lung' THEN 'C20' WHEN 'breast' THEN 'C21' END) AS chunk_id FROM (SELECT DISTINCT gene, tumor FROM al) n),
pr AS (SELECT case_id, alt_ord, count(*) AS n, min(level) AS best, count(*) FILTER (source = 'germline_records') AS germ FROM l GROUP BY ALL),
st AS (SELECT al.case_id, alt_ord * 2 AS o, 'Variant ' || gene || ' ' || variant || ': ' || coalesce(n, 0) || ' CIViC/ClinVar item(s), best CIViC level ' || coalesce(best, '-') || ', ' || coalesce(germ, 0) || ' germline pathogenicity item(s).' AS text, coalesce(n, 0) AS cites FROM al LEFT JOIN pr USING (case_id, alt_ord)
  UNION ALL SELECT al.case_id, alt_ord * 2 + 1, 'Guideline for ' || al.gene || ' ' || al.tumor || ': ' || drug || ' (ESCAT ' || tier || ').', 1 FROM al JOIN pk ON pk.gene = al.gene AND pk.tumor = al.tumor JOIN {_CHUNK} c ON c.chunk_id = pk.chunk_id
  UNION ALL SELECT case_id, -1, 'Plan: ' || count(*) || ' alteration(s) [' || string_agg(gene || ' ' || variant, '; ' ORDER BY alt_ord) || '] in ' || min(tumor) || '. Consult specialists [''variant'', ''guideline''], then synthesize.', 0 FROM al GROUP BY case_id
  UNION ALL SELECT case_id, 4000000000, 'Synthesis: recommend ' || CASE WHEN recommendation <> '' THEN '[''' || array_to_string(string_split(recommendation, ';')[1:3], ''', ''') || ''']' ELSE '—' END || ' at confidence ' || printf('%.2f', round(conf, 3)) || '.' || CASE WHEN m = 0 OR conf <= 0.5 THEN ' Low confidence — abstain and defer to clinician.' ELSE '' END, 0
    FROM decided WHERE case_id IN (SELECT case_id FROM al))"""


def _picked(spark, sf_dir, a):
    """(gene, tumor, chunk_id, recommendation, tier) of each distinct gene and tumour, written, so that Spark sees how few they are."""
    chunks = _view(spark, sf_dir, "nation", _CHUNK)
    asked = a.select("gene", "tumor").distinct().withColumn("case_id", F.concat_ws("|", "gene", "tumor"))
    picks = evidence.picked(asked, chunks).join(chunks.select("chunk_id", F.col("drug").alias("recommendation"), "tier"), "chunk_id")
    return stored(picks.select("gene", "tumor", "chunk_id", "recommendation", "tier"))


def _whole(spark, sf_dir):
    """Alterations, what was found for them, their guideline chunks and the decisions."""
    from pyspark.sql import Window as W

    a = _alterations(spark, sf_dir).withColumn("alt_ord", F.row_number().over(W.partitionBy("case_id").orderBy("ord", "gene", "part", "supp")))
    a = a.select("case_id", "alt_ord", "gene", F.expr("concat('P', part)").alias("variant"), "tumor")
    picks = _picked(spark, sf_dir, a)
    picks = a.join(picks, ["gene", "tumor"]).select("case_id", "alt_ord", "chunk_id", "recommendation", "tier")
    return a, _looked_up(spark, sf_dir)[1], picks, _decided(spark, sf_dir)


@query(f"""WITH {_LOOK}, {_FUSE}, {_TRACE} SELECT st.case_id, count(*) AS n_steps, CAST(sum(cites) AS BIGINT) AS n_citations, md5(string_agg(text, '|' ORDER BY o)) AS texts, any_value(recommendation) AS recommendation, any_value(round(conf, 3)) AS confidence, any_value(m = 0 OR conf <= 0.5) AS abstained
FROM st JOIN decided USING (case_id) GROUP BY st.case_id""")
def trace_full(spark, sf_dir):
    a, e, r = _asked(spark, sf_dir, TASK_WIDE)
    kinds = _alterations(spark, sf_dir).withColumn("profile", F.expr("concat('G', part % 16)"))
    # answers and chunks are those of a profile or gene and a tumour, so they meet the alterations where they are
    found = stored(fusion.answered(tools.variant_answers(kinds, e, r), ["profile", "tumor"]))
    a = a.withColumn("variant", F.expr("concat('P', part)")).join(found, ["profile", "tumor"], "left").join(_picked(spark, sf_dir, kinds), ["gene", "tumor"], "left")
    t = fusion.composed(a, _decided(spark, sf_dir))
    texts = F.md5(F.array_join(F.transform("steps", lambda x: x["text"]), "|"))
    n = F.size(F.flatten(F.transform("steps", lambda x: x["citations"]))).cast("bigint")
    return t.select("case_id", F.size("steps").cast("bigint").alias("n_steps"), n.alias("n_citations"), texts.alias("texts"), F.array_join("recommendation", ";").alias("recommendation"), "confidence", "abstained")


@query(f"""WITH {_LOOK}, {_FUSE}, {_TRACE}, n AS (SELECT case_id, count(*) AS n, sum(cites) AS c FROM st GROUP BY case_id)
SELECT count(*) AS n_traces, count(*) FILTER (m = 0 OR conf <= 0.5) AS n_abstained, CAST(sum(n) AS BIGINT) AS n_steps, CAST(sum(n) AS BIGINT) AS n_sound, CAST(sum(c) AS BIGINT) AS n_citations, CAST(sum(n - 2) AS BIGINT) AS n_calls FROM n JOIN decided USING (case_id)""")
def run_counts(spark, sf_dir):
    """A composed run over the whole tables, its traces written and read back: the counts of its report. All that its traces cite is known, so every step is sound.

    The verifier's solver has ten rounds here: no count depends on them.
    """
    alterations, found, picks, decisions = _whole(spark, sf_dir)
    cases = decisions.select("case_id", F.slice("recommendation", 1, 1).alias("recommended"), F.lit(True).alias("actionable"))
    report = run.run(alterations, found, picks, decisions, cases, shared_folder(spark), "run", max_rounds=10).report
    return report.select("n_traces", "n_abstained", "n_steps", "n_sound", "n_citations", "n_calls")


_IDX = f"""x AS (SELECT chunk_id AS doc_id, regexp_extract_all(lower(gene || ' ' || tumor_type || ' ' || tier || ' ' || drug), '[A-Za-z0-9]+') AS t FROM {_CHUNK}), corpus AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM x),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM x) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT DISTINCT gene, tumor FROM {_NEED}), w AS (SELECT gene, tumor, term, count(*) AS qn FROM (SELECT gene, tumor, unnest(regexp_extract_all(lower(gene || ' ' || tumor), '[A-Za-z0-9]+')) AS term FROM q) GROUP BY ALL),
s AS (SELECT gene, tumor, doc_id, sum(qn * greatest(1e-9, ln(1 + (n - df + 0.5) / (df + 0.5))) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM w JOIN df USING (term) JOIN tf USING (term), corpus GROUP BY ALL),
h AS (SELECT *, row_number() OVER (PARTITION BY gene, tumor ORDER BY round(score, 6) DESC, doc_id) AS rank FROM s WHERE score > 0)"""


@query(f"WITH {_IDX} SELECT case_id, doc_id AS chunk_id, round(score, 4) AS score, rank FROM {_NEED} n JOIN h USING (gene, tumor) WHERE rank <= 3")
def guideline_lookup(spark, sf_dir):
    c = _view(spark, sf_dir, "nation", _CHUNK).select("chunk_id", "gene", "tumor_type", F.col("tier").alias("recommendation"), F.array("drug").alias("therapies"))
    out = tools.guideline_lookup(_view(spark, sf_dir, "part", _NEED), c)
    return out.select("case_id", "chunk_id", F.round("score", 4).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query(f"""SELECT id, any_value(significance) AS significance, any_value(direction) AS direction, any_value(disease) AS disease FROM (SELECT citation_id AS id, significance, direction, disease FROM {_EV} UNION ALL SELECT 'guideline:' || chunk_id, 'SENSITIVITY', 'SUPPORTS', tumor_type FROM {_CHUNK}) GROUP BY id""")
def record_index(spark, sf_dir):
    c = _view(spark, sf_dir, "nation", _CHUNK).select("chunk_id", "tumor_type", F.array("drug").alias("therapies"))
    return tools.record_index(_evidence(spark, sf_dir).withColumn("therapies", F.array("profile")), c).drop("therapies")
