"""Queries over the scalar functions and the retrieval operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestor.functions import text as T
from attestor.functions.rng import keyed_int
from attestor.operators import index, matcher, retrieval, vectors
from attestor.plans.roles import RECORDS, records
from attestor.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return keep


_MISSING = "('', '.', 'na', 'n/a', 'null', 'none', 'unknown', '[not available]', '[not applicable]', 'not available', 'notavailable')"
_RAW = "CASE p_partkey % 8 WHEN 0 THEN '.' WHEN 1 THEN ' NA ' WHEN 2 THEN '[Not Available]' WHEN 3 THEN NULL WHEN 4 THEN '' ELSE '  ' || p_brand || ' ' END"


@query(f"SELECT p_partkey, CASE WHEN lower(trim(v)) IN {_MISSING} THEN NULL ELSE trim(v) END AS value FROM (SELECT p_partkey, {_RAW} AS v FROM part)")
def missing_norm(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.expr(_RAW).alias("v")).select("p_partkey", T.normalize_missing("v").alias("value"))


@query(f"""SELECT study, b AS build, count(*) AS n FROM (SELECT study, CASE WHEN lower(trim(build)) IN {_MISSING} THEN NULL WHEN lower(trim(build)) IN ('hg19','grch37','b37','37') THEN 'GRCh37'
  WHEN lower(trim(build)) IN ('hg38','grch38','b38','38') THEN 'GRCh38' ELSE upper(trim(build)) END AS b FROM {RECORDS}) GROUP BY study, b""")
def build_canon(spark, sf_dir):
    return records(spark, sf_dir).groupBy("study", T.canonical_build("build").alias("build")).agg(F.count("*").alias("n"))


_CONS = """CASE WHEN change IS NULL OR lower(trim(change)) IN ('', '.', 'na', 'n/a', 'null', 'none', 'unknown') THEN 'empty' WHEN change LIKE '%*' OR change LIKE '%Ter%' THEN 'nonsense' WHEN change LIKE '%fs%' THEN 'frameshift'
  WHEN lower(change) LIKE '%splice%' THEN 'splice' WHEN change LIKE '%del%' OR change LIKE '%ins%' OR change LIKE '%dup%' THEN 'indel'
  WHEN regexp_full_match(change, '[A-Z*][0-9]+=?') OR regexp_full_match(change, '[A-Z][0-9]+[A-Z*]') THEN 'substitution' ELSE 'other' END"""
_EXP = "CASE mutation_type WHEN 'Missense_Mutation' THEN 'substitution' WHEN 'Nonsense_Mutation' THEN 'nonsense' WHEN 'Frame_Shift_Del' THEN 'frameshift' END"


@query(f"SELECT mutation_type, {_CONS} AS consequence, count(*) AS n FROM {RECORDS} GROUP BY ALL")
def consequence_class(spark, sf_dir):
    return records(spark, sf_dir).groupBy("mutation_type", T.protein_consequence("change").alias("consequence")).agg(F.count("*").alias("n"))


_SPELL = """CASE p_partkey % 9 WHEN 0 THEN 'p.Leu' || CAST(p_partkey AS VARCHAR) || 'Arg' WHEN 1 THEN 'p.(Gly' || CAST(p_partkey AS VARCHAR) || 'Asp)' WHEN 2 THEN 'V' || CAST(p_partkey AS VARCHAR) || 'E'
  WHEN 3 THEN 'Leu747_Pro753delinsSer' WHEN 4 THEN ' P.Arg' || CAST(p_partkey AS VARCHAR) || 'Ter ' WHEN 5 THEN 'Alarg' WHEN 6 THEN 'Metabolic' WHEN 7 THEN 'Q61*' ELSE 'amplification' END"""
_BARE = "trim(regexp_replace(regexp_replace(trim(v), '^[pP][.]', ''), '^\\((.*)\\)$', '\\1'))"
_AMINO = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in T.AMINO.items()) + "}"
_ONE = f"array_to_string(list_transform(regexp_extract_all({_BARE}, '{'|'.join(T.AMINO)}|.'), lambda x: coalesce({_AMINO}[x], x)), '')"
_BACK = "MAP {" + ", ".join(f"'{v}': '{k}'" for k, v in T.AMINO.items() if v not in "UX") + "}"


def _spelled(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.expr(_SPELL.replace("VARCHAR", "STRING")).alias("v"))


@query(f"SELECT p_partkey, {_ONE} AS one_letter FROM (SELECT p_partkey, {_SPELL} AS v FROM part)")
def variant_three_to_one(spark, sf_dir):
    return _spelled(spark, sf_dir).select("p_partkey", T.three_to_one("v").alias("one_letter"))


_SUB = "^([ACDEFGHIKLMNPQRSTVWY])([0-9]+)([ACDEFGHIKLMNPQRSTVWY*])$"


@query(f"""SELECT p_partkey, CASE WHEN regexp_matches(o, '{_SUB}') THEN 'p.' || {_BACK}[regexp_extract(o, '{_SUB}', 1)] || regexp_extract(o, '{_SUB}', 2) || {_BACK}[regexp_extract(o, '{_SUB}', 3)] END AS three_letter,
  regexp_matches(o, '{_SUB}') AS is_substitution, upper(p_brand) || ' ' || o AS profile FROM (SELECT p_partkey, p_brand, {_ONE} AS o FROM (SELECT p_partkey, p_brand, {_SPELL} AS v FROM part))""")
def variant_one_to_three(spark, sf_dir):
    df = _spelled(spark, sf_dir).join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_partkey")
    return df.select("p_partkey", T.one_to_three("v").alias("three_letter"), T.is_substitution("v").alias("is_substitution"), T.profile_name("p_brand", "v").alias("profile"))


@query("""WITH t AS (SELECT doc_id, lang, regexp_extract_all(lower(text), '[A-Za-z0-9]+') AS w FROM documents)
SELECT lang, count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_tokens, CAST(sum(len(list_distinct(w))) AS BIGINT) AS n_distinct, CAST(max(len(w)) AS BIGINT) AS longest FROM t GROUP BY lang""")
def tokenize_stats(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("lang", T.tokenize("text").alias("w"))
    return t.groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum(F.size("w")).alias("n_tokens"), F.sum(F.size(F.array_distinct("w"))).alias("n_distinct"), F.max(F.size("w")).cast("bigint").alias("longest"))


_TOK = "list_distinct(list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}_]+'), lambda t: length(t) > 2))"


@query(f"""SELECT p_type, n_name FROM (SELECT DISTINCT p_type FROM part), nation JOIN region ON n_regionkey = r_regionkey
WHERE list_has_any({_TOK.format('p_type')}, {_TOK.format("n_name || ' ' || r_name || CASE WHEN n_nationkey % 5 = 0 THEN ' Small' WHEN n_nationkey % 5 = 1 THEN ' economy, promo' ELSE '' END")})""")
def token_overlap_match(spark, sf_dir):
    extra = F.when(F.col("n_nationkey") % 5 == 0, "Small").when(F.col("n_nationkey") % 5 == 1, "economy, promo")
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", F.concat_ws(" ", "n_name", "r_name", extra).alias("words"))
    p = table(spark, sf_dir, "part").select("p_type").distinct()
    return retrieval.token_matches(p, "p_type", n, "words").select("p_type", "n_name").distinct()


_BM = """terms AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[A-Za-z0-9]+')) AS term FROM documents),
dl AS (SELECT doc_id, len(regexp_extract_all(lower(text), '[A-Za-z0-9]+')) AS dl FROM documents),
corpus AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
tf AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT item_id AS query_id, term, count(*) AS qn FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[A-Za-z0-9]+')) AS term FROM benchmark) GROUP BY ALL),
scored AS (SELECT query_id, doc_id, sum(qn * greatest(1e-9, ln(1 + (n - df + 0.5) / (df + 0.5))) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM q JOIN df USING (term) JOIN tf USING (term) JOIN dl USING (doc_id), corpus GROUP BY ALL),
bm AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM scored WHERE score > 0)"""


def _asked(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query(f"WITH {_BM} SELECT query_id, doc_id, round(score, 4) AS score, rank FROM bm WHERE rank <= 10")
def bm25_topk(spark, sf_dir):
    out = index.of_files(table(spark, sf_dir, "documents")).search(_asked(spark, sf_dir), 10)
    return out.select("query_id", "doc_id", F.round("score", 4).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query("""WITH t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[A-Za-z0-9]+')) AS term FROM documents)
SELECT term, count(*) AS df, round(greatest(1e-9, ln(1 + ((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5))), 6) AS idf FROM t GROUP BY term""")
def bm25_idf(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    df = docs.select(F.explode(F.array_distinct(T.tokenize("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return df.crossJoin(docs.agg(F.count("*").alias("n"))).select("term", "df", F.round(retrieval.idf(F.col("n"), F.col("df")), 6).alias("idf"))


_DENSE = """dn AS (SELECT q.vec_id AS query_id, e.vec_id AS doc_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q),
de AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM dn)"""


@query(f"WITH {_DENSE} SELECT query_id, doc_id, round(score, 5) AS score, rank FROM de WHERE rank <= 10")
def dense_topk(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    out = retrieval.dense(v, v.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), 10)
    return out.select("query_id", "doc_id", F.round("score", 5).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def dense_index_topk(spark, sf_dir):
    """By the clustered index: recall is measured against the exact way in the tests, so there is no SQL."""
    v = table(spark, sf_dir, "embeddings")
    out = vectors.build(v).search(v.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), 10)
    return out.select("query_id", "doc_id", F.round("score", 5).alias("score"), F.col("rank").cast("bigint").alias("rank"))


QUERIES["dense_index_topk"] = dense_index_topk


@query(f"""WITH {_BM}, {_DENSE}, arms AS (SELECT query_id, doc_id, 1.0 / (60 + rank - 1) AS part, rank AS seen FROM bm WHERE rank <= 40
  UNION ALL SELECT query_id, doc_id, 1.0 / (60 + rank - 1), 1000000 + rank FROM de WHERE rank <= 40),
f AS (SELECT query_id, doc_id, sum(part::DOUBLE) AS score, min(seen) AS seen FROM arms GROUP BY ALL)
SELECT query_id, doc_id, round(score, 7) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, seen) AS rank FROM f) WHERE rank <= 10""")
def hybrid_rrf(spark, sf_dir):
    k = 10
    depth = retrieval.hybrid_depth(k)
    q = _asked(spark, sf_dir)
    v = table(spark, sf_dir, "embeddings")
    arms = [index.of_files(table(spark, sf_dir, "documents")).search(q, depth), retrieval.dense(v, v.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), depth)]
    return retrieval.fuse(arms, k).select("query_id", "doc_id", F.round("score", 7).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query("""SELECT doc_id, CAST(('0x' || substr(md5('17:' || CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT AS BIGINT) AS place FROM documents""")
def keyed_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", keyed_int(17, "doc_id").alias("place"))


@query("""SELECT o_orderkey, trim(regexp_replace(replace(lower(o_orderpriority || '  -Plan  B'), '-', ' '), '\\s+', ' ', 'g')) AS norm,
  CASE WHEN upper(o_orderpriority) LIKE '%GERMLINE%' THEN FALSE WHEN upper(o_orderstatus || 'somatic') LIKE '%SOMATIC%' THEN TRUE END AS somatic FROM orders""")
def name_norm(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", T.norm_name(F.concat("o_orderpriority", F.lit("  -Plan  B"))).alias("norm"), T.origin_is_somatic(F.concat("o_orderstatus", F.lit("somatic"))).alias("somatic"))


@query("""SELECT o_orderkey, replace(o_orderpriority || ': ' || CASE WHEN o_orderkey % 5 = 0 THEN 'None' ELSE 'SUPPORTS' END || ' SENSITIVITY_X', '_', ' ') || CASE WHEN o_orderkey % 3 > 0 THEN ' to ' || o_orderstatus || ' + drug_b' ELSE '' END ||
  CASE WHEN o_orderkey % 2 = 0 THEN ' in disease_x' ELSE '' END || ' (CIViC level B, rating ' || CAST(o_orderkey % 5 AS VARCHAR) || ')' AS claim FROM orders""")
def claim_sentence(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    drugs = F.when(F.col("o_orderkey") % 3 > 0, F.array("o_orderstatus", F.lit("drug_b"))).otherwise(F.array().cast("array<string>"))
    return o.select("o_orderkey", T.claim_text(F.col("o_orderpriority"), F.when(F.col("o_orderkey") % 5 != 0, F.lit("SUPPORTS")), F.lit("SENSITIVITY_X"), drugs, F.when(F.col("o_orderkey") % 2 == 0, F.lit("disease_x")), F.lit("B"), F.col("o_orderkey") % 5).alias("claim"))


@query("""SELECT p_partkey, array_to_string(list_filter(list_transform(regexp_split_to_array(regexp_replace(r, '(?i)\\[\\s*CITE:[^\\]]*\\]', ' ', 'g'), '\\s*(?:,|;|/| or | and | then )\\s*'),
  lambda p: trim(regexp_replace(trim(p), '(?i)^(?:first|second|third)[\\s-]line\\s+|^(?:consider|recommend(?:ed)?|prefer(?:red)?|initiate|start|offer)\\s+|\\s*\\(.*?\\)\\s*$', '', 'g'), ' .;:')), lambda p: p <> ''), '|') AS parts
FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'First-line ' || p_name || ' and consider drugb (daily) [CITE: x:1]' WHEN 1 THEN 'start ' || p_name || '; recommended drugc / drugd.' ELSE p_name || ' or  offer druge ;' END AS r FROM part)""")
def recommendation_clean(spark, sf_dir):
    r = F.expr("CASE p_partkey % 3 WHEN 0 THEN concat('First-line ', p_name, ' and consider drugb (daily) [CITE: x:1]') WHEN 1 THEN concat('start ', p_name, '; recommended drugc / drugd.') ELSE concat(p_name, ' or  offer druge ;') END")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(T.clean_recommendation(F.array(r)), "|").alias("parts"))


@query("""SELECT doc_id, text || ' [EVIDENCE] ' || CASE WHEN doc_id % 2 = 0 THEN 'a:1 b:2' ELSE 'NO_EVIDENCE' END AS example, trim(list_filter(list_transform(string_split(text, chr(10)), lambda t: trim(t)), lambda t: t <> '')[-1]) AS last FROM documents""")
def verifier_example(spark, sf_dir):
    ids = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("a:1"), F.lit("b:2"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "documents").select("doc_id", T.featurized(F.col("text"), ids).alias("example"), T.last_line("text").alias("last"))


_NAMES = "(SELECT DISTINCT w AS name FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM benchmark) WHERE length(w) >= 5)"


@query(f"""SELECT conv_id, turn, count(*) AS n, md5(string_agg(name, '|' ORDER BY name)) AS names FROM conversations, {_NAMES} WHERE contains(lower(text), lower(name)) GROUP BY conv_id, turn""")
def names_in_turns(spark, sf_dir):
    """Words of the benchmark, as a vocabulary table, in all turns of conversations."""
    words = F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)))
    vocabulary = table(spark, sf_dir, "benchmark").select(words.alias("name")).where("length(name) >= 5").distinct()
    turns = table(spark, sf_dir, "conversations").withColumn("at", F.concat_ws(":", "conv_id", "turn"))
    found = matcher.names_in_texts(turns, vocabulary, "at", "text")
    per = found.groupBy("at").agg(F.count("*").alias("n"), F.md5(F.array_join(F.array_sort(F.collect_list("name")), "|")).alias("names"))
    part = F.split("at", ":")
    return per.select(part[0].cast("bigint").alias("conv_id"), part[1].cast("bigint").alias("turn"), "n", "names")
