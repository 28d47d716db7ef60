"""Scalar functions over columns: missing values, genome builds, protein changes, tokens, claims, recommendations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Placeholders that mean "missing".
MISSING = ("", ".", "na", "n/a", "null", "none", "unknown", "[not available]", "[not applicable]", "not available", "notavailable")
# Names of the two genome builds.
BUILDS = {"GRCh37": ("hg19", "grch37", "b37", "37"), "GRCh38": ("hg38", "grch38", "b38", "38")}
# The amino-acid code.
AMINO = {
    "Ala": "A", "Arg": "R", "Asn": "N", "Asp": "D", "Cys": "C", "Gln": "Q", "Glu": "E", "Gly": "G", "His": "H", "Ile": "I",
    "Leu": "L", "Lys": "K", "Met": "M", "Phe": "F", "Pro": "P", "Ser": "S", "Thr": "T", "Trp": "W", "Tyr": "Y", "Val": "V",
    "Ter": "*", "Sec": "U", "Xaa": "X",
}
# The consequences that a mutation type allows.
EXPECTED = {
    "Missense_Mutation": "substitution", "Nonsense_Mutation": "nonsense", "In_Frame_Del": "indel", "In_Frame_Ins": "indel",
    "Frame_Shift_Del": "frameshift", "Frame_Shift_Ins": "frameshift",
}
SUBSTITUTION = "^([ACDEFGHIKLMNPQRSTVWY])([0-9]+)([ACDEFGHIKLMNPQRSTVWY*])$"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def literal_map(values: dict[str, str | float]) -> Column:
    return F.create_map(*(F.lit(v) for kv in values.items() for v in kv))


def stripped(x: Column | str) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(F.regexp_replace(_c(x), r"(?U)^\s+", ""), r"(?U)\s+$", "")


def normalize_missing(x: Column | str) -> Column:
    """The trimmed value; null for placeholders."""
    t = stripped(x)
    return F.when(F.lower(t).isin(*MISSING), None).otherwise(t)


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x evaluated once, however often f uses it."""
    return F.transform(F.array(x), f)[0]


def canonical_build(x: Column | str) -> Column:
    def named(v: Column) -> Column:
        out = F.upper(v)
        for name, labels in BUILDS.items():
            out = F.when(F.lower(v).isin(*labels), name).otherwise(out)
        return out

    return bound(normalize_missing(x), named)


def protein_consequence(x: Column | str) -> Column:
    """The first rule that holds, in this order: empty, nonsense, frameshift, splice, indel, substitution, other."""

    def rules(v: Column) -> Column:
        return (
            F.when(v.isNull(), "empty")
            .when(v.endswith("*") | v.contains("Ter"), "nonsense")
            .when(v.contains("fs"), "frameshift")
            .when(F.lower(v).contains("splice"), "splice")
            .when(v.rlike("del|ins|dup"), "indel")
            .when(v.rlike("^[A-Z*][0-9]+=?$") | v.rlike("^[A-Z][0-9]+[A-Z*]$"), "substitution")
            .otherwise("other")
        )

    return bound(normalize_missing(x), rules)


def expected_consequence(mutation_type: Column | str) -> Column:
    return F.try_element_at(literal_map(EXPECTED), _c(mutation_type))


def bare_variant(x: Column | str) -> Column:
    """Without white space, a leading p. and enclosing parentheses."""
    v = F.regexp_replace(stripped(x), "^[pP][.]", "")
    return stripped(F.regexp_replace(v, r"^\((.*)\)$", "$1"))


def three_to_one(x: Column | str) -> Column:
    """Three-letter amino-acid codes as letters, all else kept: one pass over pieces (a code or one character)."""
    pieces = F.regexp_extract_all(bare_variant(x), F.lit(f"((?s){'|'.join(AMINO)}|.)"), F.lit(1))
    return F.array_join(F.transform(pieces, lambda p: F.coalesce(F.try_element_at(literal_map(AMINO), p), p)), "")


def one_to_three(x: Column | str) -> Column:
    """A plain substitution as p.Xxx00Yyy, else null."""
    v = three_to_one(x)
    back = literal_map({one: three for three, one in AMINO.items() if one not in "UX"})
    part = lambda i: F.regexp_extract(v, SUBSTITUTION, i)
    spelled = F.concat(F.lit("p."), F.try_element_at(back, part(1)), part(2), F.try_element_at(back, part(3)))
    return F.when(v.rlike(SUBSTITUTION), spelled)


def is_substitution(x: Column | str) -> Column:
    return three_to_one(x).rlike(SUBSTITUTION)


def profile_name(gene: Column | str, variant: Column | str) -> Column:
    return F.concat_ws(" ", F.upper(stripped(gene)), three_to_one(variant))


def tokenize(x: Column | str) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(_c(x), F.lit(""))), F.lit("[A-Za-z0-9]+"), F.lit(0))


def token_set(x: Column | str) -> Column:
    """Distinct lower-case words of over two characters."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(_c(x), F.lit(""))), r"[^\p{L}\p{N}_]+"), lambda t: F.length(t) > 2))


def token_match(a: Column | str, b: Column | str) -> Column:
    return F.coalesce(F.arrays_overlap(token_set(a), token_set(b)), F.lit(False))


def origin_is_somatic(x: Column | str) -> Column:
    """Three-valued: germline is checked first."""
    u = F.upper(_c(x))
    return F.when(u.contains("GERMLINE"), False).when(u.contains("SOMATIC"), True)


def norm_name(x: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.replace(F.lower(_c(x)), F.lit("-"), F.lit(" ")), r"\s+", " "))


def claim_text(profile: Column, direction: Column, significance: Column, therapies: Column, disease: Column, level: Column, rating: Column) -> Column:
    """The sentence for an evidence record; underscores become spaces in its first part only, nulls print as None."""
    show = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    head = F.replace(F.concat(show(profile), F.lit(": "), show(direction), F.lit(" "), show(significance)), F.lit("_"), F.lit(" "))
    to = F.when(F.size(therapies) > 0, F.concat(F.lit(" to "), F.array_join(therapies, " + "))).otherwise("")
    where = F.when(F.coalesce(F.length(disease), F.lit(0)) > 0, F.concat(F.lit(" in "), disease)).otherwise("")
    return F.concat(head, to, where, F.lit(" (CIViC level "), show(level), F.lit(", rating "), show(rating), F.lit(")"))


# Words that make a sentence claim benefit, or resistance.
BENEFIT = r"(?i)\b(sensitiv\w*|respond\w*|benefit\w*|effective|efficacious|indicated|recommend\w*|should be (?:considered|offered|used)|treat(?:ed|ment)? with|first[- ]line|appropriate|suitable|eligible)\b"
RESISTANCE = r"(?i)\b(resistan\w*|refractory|not effective|ineffective|does not respond|no benefit|lack of (?:response|benefit)|contraindicat\w*|should not be|avoid|unlikely to benefit|progress\w* on)\b"


def claim_direction(x: Column | str, benefit: str = BENEFIT, resistance: str = RESISTANCE) -> Column:
    """SENSITIVITY or RESISTANCE if the text says one and not the other, else null."""
    plus, minus = _c(x).rlike(benefit), _c(x).rlike(resistance)
    return F.when(minus & ~plus, "RESISTANCE").when(plus & ~minus, "SENSITIVITY")


def record_direction(significance: Column | str, direction: Column | str) -> Column:
    """The direction that a record's significance speaks for; evidence that doesn't support it inverts it."""
    s, d = F.upper(F.coalesce(_c(significance), F.lit(""))), F.upper(F.coalesce(_c(direction), F.lit("")))
    base = F.when(s.startswith("SENSITIVITY"), "SENSITIVITY").when(s.startswith("RESISTANCE"), "RESISTANCE")
    other = F.when(base == "SENSITIVITY", "RESISTANCE").when(base == "RESISTANCE", "SENSITIVITY")
    return F.when(d.startswith("DOES_NOT") | d.startswith("DOESNOT"), other).otherwise(base)


def names_in(x: Column | str, vocabulary: Column) -> Column:
    """Names of the vocabulary that the text contains, in any case."""
    low = F.lower(_c(x))
    return F.filter(vocabulary, lambda v: (F.length(v) > 0) & F.contains(low, F.lower(v)))


# What is taken off a recommendation's text.
CITE_BLOCK = r"(?i)\[\s*CITE:[^\]]*\]"
PART_SPLIT = r"\s*(?:,|;|/| or | and | then )\s*"
QUALIFIER = r"(?i)^(?:first|second|third)[\s-]line\s+|^(?:consider|recommend(?:ed)?|prefer(?:red)?|initiate|start|offer)\s+|\s*\(.*?\)\s*$"


def clean_recommendation(items: Column) -> Column:
    """Citation blocks out, lists split, leading qualifiers stripped once, empty parts dropped."""
    parts = F.flatten(F.transform(items, lambda t: F.split(F.regexp_replace(t, CITE_BLOCK, " "), PART_SPLIT)))
    bare = F.transform(parts, lambda p: F.btrim(F.regexp_replace(F.trim(p), QUALIFIER, ""), F.lit(" .;:")))
    return F.filter(bare, lambda p: p != "")


def featurized(text: Column, ids: Column, evidence: Column | None = None) -> Column:
    """A verifier example as text: the step, a marker, its evidence ids (or that there are none) and evidence texts."""
    cited = F.when(F.size(F.coalesce(ids, F.array())) > 0, F.array_join(ids, " ")).otherwise("NO_EVIDENCE")
    return F.concat_ws(" ", text, F.lit("[EVIDENCE]"), cited, *([F.array_join(evidence, " ")] if evidence is not None else []))


def calibrated(logit: Column, temperature: Column | float) -> Column:
    """Sigmoid of logit / temperature, clamped at 30 either way."""
    t = F.lit(float(temperature)) if isinstance(temperature, (int, float)) else temperature
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), logit / t))))


def last_line(prompt: Column | str) -> Column:
    """The last line that isn't blank, trimmed; empty if there is none."""
    lines = F.filter(F.transform(F.split(F.coalesce(_c(prompt), F.lit("")), "\n"), lambda t: F.trim(t)), lambda t: t != "")
    return F.coalesce(F.try_element_at(lines, F.lit(-1)), F.lit(""))
