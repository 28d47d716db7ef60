"""Supervision: citation ids from free text, structural and semantic step labels, negatives, agreement, candidate parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.functions.rng import keyed_int, positions
from attestor.functions.text import claim_direction, record_direction

# How citation ids are written and listed, and the lines of a candidate.
ID = r"^[A-Za-z_]+:[A-Za-z0-9_.\-]+$"
BARE = r"^[A-Za-z0-9_.\-]+$"
ID_SPLIT = r"(?i)\s*(?:,|;|&|\band\b)\s*"
STEP = r"(?i)^STEP\s*([0-9]+)\s*:\s*(.*?)\s*(?:\[CITE:\s*([^\]]*)\])?\s*$"


def citation_tokens(df: DataFrame, raw: str) -> DataFrame:
    """A row for each token of a raw citation list, without dots at its ends; empty ones are dropped."""
    parts = F.transform(F.split(F.coalesce(raw, F.lit("")), ID_SPLIT), lambda t: F.btrim(F.trim(t), F.lit(".")))
    return df.select("*", F.posexplode(parts).alias("tok_ord", "token")).where("token <> ''")


def normalised_citations(df: DataFrame, raw: str, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Tokens with class resolved, resolved_suffix (the prefix was dropped), invented or prose, and the id resolved to."""
    tokens = citation_tokens(df, raw)
    known = ids.select(F.col(id_col).alias("token"), F.col(id_col).alias("full")).distinct()
    bare = ids.where(F.col(id_col).contains(":")).groupBy(F.substring_index(id_col, ":", -1).alias("token")).agg(F.min(id_col).alias("by_suffix"))
    out = tokens.join(known, "token", "left").join(bare, "token", "left")
    is_bare = F.col("token").rlike(BARE)
    kind = F.when(F.col("full").isNotNull(), "resolved").when(is_bare & F.col("by_suffix").isNotNull(), "resolved_suffix").when(F.col("token").rlike(ID) | is_bare, "invented").otherwise("prose")
    return out.withColumn("kind", kind).withColumn("resolved_id", F.when(F.col("kind") == "resolved", F.col("full")).when(F.col("kind") == "resolved_suffix", F.col("by_suffix"))).drop("full", "by_suffix")


def exploded_steps(traces: DataFrame, steps: str = "steps") -> DataFrame:
    """One step a row, with its index."""
    return traces.select("*", F.posexplode(steps).alias("step_index", "step")).drop(steps)


def guideline_label(cited: Column, resolvable: Column) -> Column:
    """Sound without citations, or if at least one of them resolves."""
    return (F.size(cited) == 0) | F.coalesce(F.arrays_overlap(cited, resolvable), F.lit(False))


def structural_label(resolved: Column, invented: Column, off_case: Column) -> Column:
    """Counts: something resolves, nothing is invented, nothing belongs to another case."""
    return (resolved > 0) & (invented == 0) & (off_case == 0)


def global_ids(pools: DataFrame) -> DataFrame:
    """(id): every id of any case's pool; pools (case_id, id)."""
    return pools.select("id").distinct()


def relabelled_steps(steps: DataFrame, pools: DataFrame, keys: list[str], raw: str = "raw") -> DataFrame:
    """(keys, cited, invented, prose, off_case, label_sound), a row for each step (keys, case_id, ``raw`` citation list).

    Ids are resolved against all cases' pools (case_id, id). A resolved id that isn't in the step's own case's pool is off-case;
    prose counts as no citation, not as a fault. Sound: something resolves, nothing is invented, nothing is off-case.
    """
    tokens = normalised_citations(steps.select(*keys, "case_id", F.col(raw).alias("_raw")), "_raw", global_ids(pools))
    own = pools.select("case_id", F.col("id").alias("resolved_id"), F.lit(True).alias("_own")).distinct()
    t = tokens.join(own, ["case_id", "resolved_id"], "left")
    listed = lambda cond, c, name: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("tok_ord", F.col(c).alias("v"))))), lambda x: x["v"]).alias(name)
    good = F.col("resolved_id").isNotNull()
    per = t.groupBy(*keys).agg(listed(good, "resolved_id", "cited"), listed(F.col("kind") == "invented", "token", "invented"), listed(F.col("kind") == "prose", "token", "prose"), listed(good & F.col("_own").isNull(), "resolved_id", "off_case"))
    out = steps.select(*keys).join(per, keys, "left")
    none = F.array().cast("array<string>")
    out = out.select(*keys, *(F.coalesce(c, none).alias(c) for c in ("cited", "invented", "prose", "off_case")))
    return out.withColumn("label_sound", structural_label(F.size("cited"), F.size("invented"), F.size("off_case")))


def semantic_labels(steps: DataFrame, citations: DataFrame, records: DataFrame) -> DataFrame:
    """(step_id, claim, n_cited, n_judgeable, n_supporting, contradicted, therapy_mismatch, disease_mismatch, reasons, sound).

    steps (step_id, text, tumor, named array of lower-case therapies in the text), citations (step_id, id, pos),
    records (id, significance, direction, therapies, disease). A citation without a record can't be judged. ``reasons`` are
    the first four faults, in the order of the citations.
    """
    none = F.array().cast("array<string>")
    claim = steps.withColumn("claim", claim_direction("text"))
    says = records.select("id", record_direction("significance", "direction").alias("says"), F.transform("therapies", lambda t: F.lower(t)).alias("about"), F.array_sort("therapies").alias("shown"), F.col("disease").alias("dis"))
    j = claim.join(citations, "step_id", "left").join(says.withColumn("known", F.lit(True)), "id", "left")
    known = F.coalesce("known", F.lit(False))
    both = F.col("claim").isNotNull() & F.col("says").isNotNull() & known
    other = F.coalesce(both & (F.col("claim") != F.col("says")), F.lit(False))
    about = F.coalesce("about", none)
    wrong_therapy = known & (F.size("named") > 0) & (F.size(about) > 0) & ~F.coalesce(F.arrays_overlap("named", about), F.lit(False))
    disease, tumor = F.coalesce("dis", F.lit("")), F.coalesce("tumor", F.lit(""))
    wrong_disease = known & (F.length(disease) > 0) & (F.length(tumor) > 0) & ~F.contains(F.lower(disease), F.lower(tumor))
    names = lambda c: F.when(F.size(c) > 0, F.concat(F.lit("['"), F.array_join(c, "', '"), F.lit("']"))).otherwise("[]")
    why = F.array(
        F.when(other, F.concat("id", F.lit(": step claims "), F.lower("claim"), F.lit(", record says "), F.lower("says"))),
        F.when(wrong_therapy, F.concat("id", F.lit(": step names "), names(F.array_sort("named")), F.lit(", record is about "), names(F.coalesce("shown", none)))),
        F.when(wrong_disease, F.concat("id", F.lit(": record disease '"), disease, F.lit("' vs case tumour type '"), tumor, F.lit("'"))),
    )
    pos = F.col("pos") if "pos" in citations.columns else F.lit(0)
    j = j.withColumn("why", F.struct(pos.alias("pos"), F.col("id"), F.filter(why, lambda x: x.isNotNull()).alias("l")))
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    out = j.groupBy("step_id").agg(
        F.first("claim").alias("claim"), F.count("id").alias("n_cited"), F.count("known").alias("n_judgeable"), F.count_if(both & (F.col("claim") == F.col("says"))).alias("n_supporting"),
        any_(other).alias("contradicted"), any_(wrong_therapy).alias("therapy_mismatch"), any_(wrong_disease).alias("disease_mismatch"),
        F.slice(F.flatten(F.transform(F.array_sort(F.collect_list("why")), lambda x: x["l"])), 1, 4).alias("reasons"),
    )
    return out.withColumn("sound", (F.col("n_cited") > 0) & ~F.col("contradicted") & ~F.col("therapy_mismatch"))


def combined_label(structural: Column, semantic: Column, disease_mismatch: Column) -> Column:
    """Sound in form and in content, and about the case's disease."""
    return structural & semantic & ~disease_mismatch


def mined_negatives(examples: DataFrame, seed: int, ids: str = "evidence_ids") -> DataFrame:
    """Synthetic negatives of cited sound examples: one without ids (strip), one with a foreign id (swap).

    examples (example_id, evidence_ids, label_sound). The foreign id is found by a keyed place among all ids (in keyed
    order), moved on past the example's own ones: ids are numbered once and joined, never held in one array.
    """
    pos = examples.where(F.col("label_sound") & (F.size(ids) > 0))
    out = ["example_id", "evidence_ids", "label_sound", "strategy"]
    strip = pos.select("example_id", F.array().cast("array<string>").alias("evidence_ids"), F.lit(False).alias("label_sound"), F.lit("strip").alias("strategy"))
    flat = pos.select("example_id", F.explode(F.array_distinct(ids)).alias("id"))
    numbered = positions(flat.select("id").distinct(), "id", seed)
    n = numbered.agg(F.count("*").alias("n"))
    numbered = numbered.drop("n")
    own = flat.join(numbered, "id").groupBy("example_id").agg(F.array_sort(F.collect_list(F.col("pos").cast("bigint"))).alias("own")).crossJoin(n).where(F.col("n") > F.size("own"))
    place = own.withColumn("at", keyed_int(seed, "example_id") % (F.col("n") - F.size("own")))
    # the at-th number that isn't among the own ones: each own number up to it moves it on
    at = F.aggregate("own", F.col("at"), lambda a, x: F.when(x <= a, a + 1).otherwise(a))
    swap = place.select("example_id", at.alias("pos")).join(numbered, "pos")
    swap = swap.select("example_id", F.array("id").alias("evidence_ids"), F.lit(False).alias("label_sound"), F.lit("swap").alias("strategy"))
    return strip.select(out).unionByName(swap.select(out))


def with_negatives(examples: DataFrame, seed: int, ids: str = "evidence_ids") -> DataFrame:
    """The examples, strategy "own", and their mined negatives."""
    own = examples.select("example_id", F.col(ids).alias("evidence_ids"), "label_sound", F.lit("own").alias("strategy"))
    return own.unionByName(mined_negatives(examples, seed, ids))


def audited(auto: DataFrame, manual: DataFrame, keys: tuple[str, ...] = ("case_id", "step_index"), label: str = "sound") -> DataFrame:
    """``kappa`` of the automatic and the manual labels of the same steps; raises if they have no step in common."""
    both = auto.select(*keys, F.col(label).cast("int").alias("_auto")).join(manual.select(*keys, F.col(label).cast("int").alias("_manual")), list(keys))
    if both.isEmpty():
        raise ValueError("the labels have no step in common")
    return kappa(both, "_auto", "_manual")


def resolvable_ids(citations: DataFrame, known: DataFrame) -> DataFrame:
    """(id): the distinct cited ids that ``known`` (id) has."""
    return citations.select("id").distinct().join(known.select("id").distinct(), "id", "left_semi")


def annotated_traces(traces: DataFrame, labels: DataFrame) -> DataFrame:
    """Nested traces (case_id, steps array of structs) with each step's label_sound from labels (case_id, step_index, sound), null without one."""
    per = labels.groupBy("case_id").agg(F.map_from_entries(F.collect_list(F.struct("step_index", "sound"))).alias("_sound"))
    steps = F.transform("steps", lambda s, i: s.withField("label_sound", F.try_element_at("_sound", i.cast("int"))))
    return traces.join(per.withColumn("_sound", F.col("_sound").cast("map<int, boolean>")), "case_id", "left").withColumn("steps", steps).drop("_sound")


def kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row (n, agreement, kappa): Cohen's kappa of two 0/1 columns; 1.0 if only one class was ever given."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    s = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).agg(F.count("*").alias("n"), F.avg((x == y).cast("double")).alias("po"), F.avg(x).alias("pa"), F.avg(y).alias("pb"))
    pe = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    return s.select("n", F.round("po", 6).alias("agreement"), F.round(F.when(pe >= 1, 1.0).otherwise((F.col("po") - pe) / (1 - pe)), 6).alias("kappa"))


def parsed_candidates(raw: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n_steps, n_cited, recommendation, confidence, abstained, parsed_ok): lines of a sampled answer by their form.

    STEP lines may carry [CITE: ids]; of RECOMMENDATION, CONFIDENCE and DEFER lines the last counts.
    """
    lines = raw.select(F.col(key).alias("key"), F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("pos", "line")).withColumn("line", F.trim("line"))
    up = F.upper("line")
    step = F.col("line").rlike(STEP)
    cites = F.filter(F.transform(F.split(F.regexp_extract("line", STEP, 3), ","), lambda c: F.trim(c)), lambda c: c != "")
    rest = F.substring_index(F.col("line"), ":", -1)
    after = F.expr("substring(line, instr(line, ':') + 1)")
    kind = F.when(step, "step").when(up.startswith("RECOMMENDATION:"), "rec").when(up.startswith("CONFIDENCE:"), "conf").when(up.startswith("DEFER:"), "defer")
    k = lines.select("key", "pos", kind.alias("kind"), F.when(step, F.size(cites)).alias("n"), "line", after.alias("after"), rest.alias("rest"))
    last = lambda name, value: F.max_by(value, F.when(F.col("kind") == name, F.col("pos")))
    items = F.array_join(F.filter(F.transform(F.split("after", ";"), lambda c: F.trim(c)), lambda c: c != ""), ";")
    number = F.expr("try_cast(nullif(regexp_extract(line, '[0-9.]+', 0), '') AS double)")
    out = k.groupBy("key").agg(
        F.count_if(F.col("kind") == "step").alias("n_steps"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_cited"), last("rec", items).alias("recommendation"),
        last("conf", number).alias("confidence"), F.coalesce(last("defer", F.contains(F.lower("line"), F.lit("yes"))), F.lit(False)).alias("abstained"),
    )
    return out.withColumn("parsed_ok", F.col("n_steps") > 0)


def parsed_steps(raw: DataFrame, key: str, text: str, pools: DataFrame) -> DataFrame:
    """(key, pos, index, text, cited, unresolvable, off_case, label_sound): the STEP lines of sampled answers.

    raw has ``key``, case_id and ``text``; pools (case_id, id) are the cases' ids. An id of no pool is unresolvable, one of other
    cases' pools only is off-case; a step is sound if it cites something and neither occurs.
    """
    lines = raw.select(F.col(key).alias("key"), "case_id", F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("pos", "line")).withColumn("line", F.trim("line"))
    cites = F.filter(F.transform(F.split(F.regexp_extract("line", STEP, 3), ","), lambda c: F.trim(c)), lambda c: c != "")
    steps = lines.where(F.col("line").rlike(STEP)).select("key", "case_id", "pos", F.regexp_extract("line", STEP, 1).cast("int").alias("index"), F.regexp_extract("line", STEP, 2).alias("text"), cites.alias("cited"))
    flat = steps.select("key", "case_id", "pos", F.posexplode("cited").alias("i", "id"))
    known = global_ids(pools).withColumn("_known", F.lit(True))
    own = pools.select("case_id", "id").distinct().withColumn("_own", F.lit(True))
    flat = flat.join(known, "id", "left").join(own, ["case_id", "id"], "left")
    listed = lambda cond, name: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("i", "id")))), lambda x: x["id"]).alias(name)
    per = flat.groupBy("key", "pos").agg(listed(F.col("_known").isNull(), "unresolvable"), listed(F.col("_known") & F.col("_own").isNull(), "off_case"))
    none = F.array().cast("array<string>")
    out = steps.join(per, ["key", "pos"], "left").withColumn("unresolvable", F.coalesce("unresolvable", none)).withColumn("off_case", F.coalesce("off_case", none))
    sound = (F.size("cited") > 0) & (F.size("unresolvable") == 0) & (F.size("off_case") == 0)
    return out.select("key", "pos", "index", "text", "cited", "unresolvable", "off_case", sound.alias("label_sound"))


def prm_examples(steps: DataFrame, resolvable: DataFrame) -> DataFrame:
    """(case_id, step_index, step_text, evidence_ids, label_sound): steps (case_id, step_index, text, cited) labelled by their citations."""
    known = steps.select("case_id", "step_index", F.explode("cited").alias("id")).join(resolvable.select("id").distinct(), "id").groupBy("case_id", "step_index").agg(F.collect_list("id").alias("ok"))
    out = steps.join(known, ["case_id", "step_index"], "left")
    sound = guideline_label(F.col("cited"), F.coalesce("ok", F.array().cast("array<string>")))
    return out.select("case_id", "step_index", F.col("text").alias("step_text"), F.col("cited").alias("evidence_ids"), sound.alias("label_sound"))
