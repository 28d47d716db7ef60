"""Quality rules: robust multivariate outliers by minimum covariance determinant, in DataFrame functions only.

Each text becomes a vector of transformed statistics. For each language and source the mean and covariance of the
``SUPPORT`` share of documents with the smallest distances are iterated by concentration steps, from several starts (median and
quartile range, moments of all, moments of the documents without symbols or repeats), until no determinant of any group falls
any more; each group's estimate of least determinant is kept and reweighted once. Documents whose Mahalanobis distance exceeds
the cut are rejected.
Steps run over cells of like vectors (``CELLS`` to each least standard deviation) with their counts and sums: a cell is taken or
left whole, its moments are exact. Cells grow with the spread of the statistics, not with the documents.
Quantiles come from histograms of fixed bins, so every aggregate is partial before it is shuffled and a hot group needs
no task of its own. Groups of under ``MIN_GROUP`` documents are fitted with the others of their language, or of all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestor.llm.common import discard, written

SYMBOLS = "#*$%&|<>"  # as a character class
SUPPORT = 0.75
#: Steps end when no group's log determinant falls by more than SETTLED; not done after MAX_STEPS they raise.
SETTLED, MAX_STEPS = 1e-6, 200
CELLS = 6
MIN_GROUP = 50
#: Estimates of up to so many groups (counted) are sent to all tasks; those of more are joined by shuffle.
FEW_GROUPS = 50_000
DIMS = ("x1", "x2", "x3", "x4", "x5")
#: Least standard deviations: what differs by less than a few of these is never an outlier.
FLOORS = (0.06, 0.5, 0.5, 0.5, 0.6)
#: chi-square quantiles and the consistency factor for five dimensions: 0.975, and SUPPORT / P(chi2(7) <= q(5, SUPPORT)).
REWEIGHT, CONSISTENCY = 12.83, 1.41
#: Twice the 0.999 quantile of chi-square(5), 20.5: the statistics have heavier tails than normal ones.
CUT = 40.0
BIN = 0.05

_WORDS = r"filter(split(coalesce(text, ''), r'[\x20\x09-\x0D]+'), x -> x <> '')"
#: Words in five-word windows that occur twice or more; transform(array(x), v -> ...)[0] binds v to x once.
_REPEATS = r"""
transform(array(transform(w, x -> xxhash64(x))), v ->
 transform(array(if(size(v) >= 5, transform(sequence(0, size(v) - 5), i -> xxhash64(v[i], v[i + 1], v[i + 2], v[i + 3], v[i + 4])), array())), s ->
  if(size(array_distinct(s)) = size(s), 0,
   transform(array(array_sort(transform(s, (h, i) -> struct(h, i)))), t ->
    transform(array(array_sort(transform(filter(t, (x, j) -> (j > 0 and get(t, j - 1).h = x.h) or (j + 1 < size(t) and get(t, j + 1).h = x.h)), x -> x.i))), p ->
     aggregate(transform(p, (x, j) -> least(5, if(j + 1 < size(p), get(p, j + 1) - x, 5))), 0, (a, x) -> a + x))[0])[0]))[0])[0]
"""


def base_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper), one row for each row.

    Null text counts as none. Words are split at ASCII white space. Repeats are found by hashes of the words of each
    five-word window (sorted within the row, so time is n log n in a text's length).
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    lines = F.split(t, "\n")
    df = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("lang"), F.lit("")).alias("lang"),
        F.coalesce(F.col("source"), F.lit("")).alias("source"),
        F.expr(f"transform(array({_WORDS}), w -> named_struct('n', bigint(size(w)), 'r', bigint({_REPEATS})))[0]").alias("w"),
        F.char_length(F.regexp_replace(t, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        (F.char_length(t) - F.char_length(F.regexp_replace(t, f"[{SYMBOLS}]", ""))).cast("long").alias("n_symbols"),
        F.transform(F.array(F.filter(lines, lambda x: x.rlike(r"[^\x20\x09-\x0D]"))), lambda x: F.size(x) - F.size(F.array_distinct(x)))[0].cast("long").alias("n_dup_lines"),
        (F.char_length(t) - F.char_length(F.regexp_replace(t, "[A-Z!]", ""))).cast("long").alias("n_upper"),
    )
    return df.select("doc_id", "lang", "source", F.col("w.n").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col("w.r").alias("n_repeat_words"), "n_upper")


def _vector() -> list[Column]:
    words, chars = F.greatest(F.col("n_words"), F.lit(1)).cast("double"), F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    return [
        F.log(chars / words).alias("x1"),
        F.log1p(1000.0 * F.col("n_symbols") / chars).alias("x2"),
        F.log1p(F.col("n_dup_lines").cast("double")).alias("x3"),
        F.log1p(100.0 * F.col("n_repeat_words") / words).alias("x4"),
        F.log1p(100.0 * F.col("n_upper") / chars).alias("x5"),
    ]


def _moments() -> list[Column]:
    n = len(DIMS)
    return [F.count("*").alias("n"), *(F.avg(x).alias(f"m{i}") for i, x in enumerate(DIMS)), *(F.covar_pop(DIMS[i], DIMS[j]).alias(f"c{i}{j}") for i in range(n) for j in range(i + 1))]


def _factors(moments: DataFrame, scale: float) -> DataFrame:
    """Add the Cholesky factor l.. of scale * covariance + diag(floors squared)."""
    n, df = len(DIMS), moments
    for i in range(n):
        for j in range(i + 1):
            s = F.coalesce(F.col(f"c{i}{j}"), F.lit(0.0)) * F.lit(scale) + (FLOORS[i] ** 2 if i == j else 0.0)
            for k in range(j):
                s = s - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            df = df.withColumn(f"l{i}{j}", F.sqrt(F.greatest(s, F.lit(1e-9))) if i == j else s / F.col(f"l{j}{j}"))
    return df.select("g", *(f"m{i}" for i in range(n)), *(f"l{i}{j}" for i in range(n) for j in range(i + 1)))


def _sized(params: DataFrame, groups: int) -> DataFrame:
    """A row for each of ``groups`` groups: broadcast if they are few, so that a hot group's rows are never dealt by group."""
    return F.broadcast(params) if groups <= FEW_GROUPS else params


def _log_determinant() -> Column:
    return sum((2 * F.log(F.col(f"l{i}{i}")) for i in range(1, len(DIMS))), 2 * F.log(F.col("l00")))


def _distances(stats: DataFrame, params: DataFrame, groups: int) -> DataFrame:
    """Add d2, the squared Mahalanobis distance, by forward substitution."""
    n, df = len(DIMS), stats.join(_sized(params, groups), "g", "left")
    for i in range(n):
        y = F.col(DIMS[i]) - F.col(f"m{i}")
        for k in range(i):
            y = y - F.col(f"l{i}{k}") * F.col(f"y{k}")
        df = df.withColumn(f"y{i}", y / F.col(f"l{i}{i}"))
    return df.withColumn("d2", sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(1, n)), F.col("y0") * F.col("y0"))).select(*stats.columns, "d2")


def _cells(fit: DataFrame) -> DataFrame:
    """(g, n, x1.. (means), q.. (mean products)) of the vectors of a group that are alike; zeros have cells of their own."""
    n = len(DIMS)
    cell = [F.ceil(F.col(x) * (CELLS / FLOORS[i])).alias(f"b{i}") for i, x in enumerate(DIMS)]
    products = [F.avg(F.col(DIMS[i]) * F.col(DIMS[j])).alias(f"q{i}{j}") for i in range(n) for j in range(i + 1)]
    cells = fit.groupBy("g", *cell).agg(F.count("*").alias("n"), *(F.avg(x).alias(x) for x in DIMS), *products)
    return written(cells.drop(*(f"b{i}" for i in range(n))))


def _cell_moments() -> list[Column]:
    """The moments of all vectors in a group's cells."""
    n = len(DIMS)
    mean = lambda c: F.sum(F.col("n") * F.col(c)) / F.sum("n")
    return [F.sum("n").alias("n"), *(mean(x).alias(f"m{i}") for i, x in enumerate(DIMS)), *((mean(f"q{i}{j}") - mean(DIMS[i]) * mean(DIMS[j])).alias(f"c{i}{j}") for i in range(n) for j in range(i + 1))]


def _quantile_bins(counts: DataFrame, keys: list[str], shares: dict[str, float]) -> DataFrame:
    """For counts (keys, bin, n): the smallest bin that reaches each share of the group."""
    w = W.partitionBy(*keys)
    cum = counts.withColumn("upto", F.sum("n").over(w.orderBy("bin").rowsBetween(W.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(w))
    return cum.groupBy(*keys).agg(*(F.min(F.when(F.col("upto") >= F.col("all") * q, F.col("bin"))).alias(name) for name, q in shares.items()))


def _start(cells: DataFrame) -> DataFrame:
    """Median and quartile range of each coordinate as means and a diagonal factor."""
    n = len(DIMS)
    long = cells.select("g", "n", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.floor(F.col(x) / BIN).alias("bin")) for i, x in enumerate(DIMS)))).alias("v")).select("g", "n", "v.i", "v.bin")
    q = _quantile_bins(written(long.groupBy("g", "i", "bin").agg(F.sum("n").alias("n"))), ["g", "i"], {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    q = q.select("g", "i", ((F.col("q2") + 0.5) * BIN).alias("m"), ((F.col("q3") - F.col("q1") + 1) * BIN / 1.349).alias("s"))
    of = q.groupBy("g").agg(*(F.max(F.when(F.col("i") == i, F.col("m"))).alias(f"m{i}") for i in range(n)), *(F.max(F.when(F.col("i") == i, F.greatest(F.col("s"), F.lit(FLOORS[i])))).alias(f"l{i}{i}") for i in range(n)))
    return of.select("g", *(f"m{i}" for i in range(n)), *(F.col(f"l{i}{j}") if i == j else F.lit(0.0).alias(f"l{i}{j}") for i in range(n) for j in range(i + 1)))


def _concentrated(cells: DataFrame, params: DataFrame, support: float, groups: int) -> DataFrame:
    """One concentration step: moments of the ``support`` share of each group that is nearest (whole bins of distance)."""
    d = _distances(cells, params, groups).where("d2 is not null").withColumn("bin", F.floor(F.log(F.col("d2") + 1e-6) * 20))
    # written, so that counts are whole before a group's bins meet: a few hundred rows, however large the group
    counts = written(d.groupBy("g", "bin").agg(F.sum("n").alias("n")))
    limit = _quantile_bins(counts, ["g"], {"most": support})
    near = d.join(_sized(limit, groups), "g").where("bin <= most")
    out = written(_factors(near.groupBy("g").agg(*_cell_moments()), CONSISTENCY))
    discard(counts)
    return out


def _least(fit: DataFrame, support: float, max_steps: int, groups: int) -> DataFrame:
    """Each group's estimate of least determinant: steps from every start, together, until no determinant falls."""
    cells = _cells(fit)
    plain = cells.where(f"{DIMS[1]} = 0 and {DIMS[3]} = 0")
    starts = [_start(cells), *(_factors(c.groupBy("g").agg(*_cell_moments()), 1.0) for c in (cells, plain))]
    named = lambda df, i: df.withColumn("g", F.struct(F.lit(i).alias("start"), F.col("g").alias("of")))
    params = named(starts[0], 0)
    for i, start in enumerate(starts[1:], 1):
        params = params.unionAll(named(start, i))
    params = written(params)
    each = written(cells.withColumn("start", F.explode(F.array(*(F.lit(i) for i in range(len(starts)))))).select(F.struct("start", F.col("g").alias("of")).alias("g"), "n", *(c for c in cells.columns if c not in ("g", "n"))))
    cols = [c for c in params.columns if c != "g"]
    for i in range(max_steps):
        new = _concentrated(each, params, support, len(starts) * groups)
        # a group whose determinant doesn't fall has settled: its estimate stays
        old = params.select("g", F.struct(*cols).alias("old"), _log_determinant().alias("before"))
        both = new.select("g", F.struct(*cols).alias("new"), _log_determinant().alias("after")).join(old, "g")
        fell = F.col("before") - F.col("after") > SETTLED
        both = written(both.select("g", F.when(fell | F.lit(i == 0), F.col("new")).otherwise(F.col("old")).alias("p"), fell.alias("fell")))
        moved = i == 0 or both.where("fell").limit(1).count()
        discard(new)
        discard(params)
        params = both.select("g", "p.*")
        params._attestor_path = both._attestor_path
        if not moved:
            break
    else:
        raise RuntimeError(f"determinants still fall after {max_steps} steps")
    best = params.groupBy(F.col("g.of").alias("g")).agg(F.min_by(F.struct(*cols), F.struct(_log_determinant(), "g.start")).alias("p"))
    best = written(best.select("g", "p.*"))
    for df in (params, each, cells):
        discard(df)
    return best


def quality_rules(docs: DataFrame, cut: float = CUT, support: float = SUPPORT, max_steps: int = MAX_STEPS, min_group: int = MIN_GROUP) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, d2), one row for each input row.

    Input columns doc_id, text, lang, source; a null language or source is a group of its own. ``base_failed``: under 10
    words, or over a fifth of the words in repeated five-word windows. ``kept``: not base_failed and a squared distance
    d2 of at most ``cut``. Estimates are made from rows that didn't fail the base rules; d2 is null where none exist.
    """
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    stats = base_statistics(docs).withColumn("base_failed", failed).select("*", *_vector())
    stats = written(stats)
    sizes = stats.where("not base_failed").groupBy("lang", "source").count()
    of_lang = sizes.groupBy("lang").agg(F.sum("count").alias("n_lang"))
    groups = sizes.join(of_lang, "lang").select("lang", "source", F.when(F.col("count") >= min_group, F.concat_ws("|", F.lit("s"), "lang", "source")).when(F.col("n_lang") >= min_group, F.concat_ws("|", F.lit("l"), "lang")).otherwise("all").alias("g"))
    groups = written(groups)
    n_groups = groups.select("g").distinct().count()
    stats_g = stats.join(_sized(groups, groups.count()), ["lang", "source"], "left")
    fit = stats_g.where("not base_failed").select("g", *DIMS)
    params = _least(fit, support, max_steps, n_groups)
    near = _distances(fit, params, n_groups).where(F.col("d2") <= REWEIGHT)
    params = written(_factors(near.groupBy("g").agg(*_moments()), 1.0))
    out = _distances(stats_g, params, n_groups)
    kept = ~F.col("base_failed") & (F.coalesce(F.col("d2"), F.lit(0.0)) <= cut)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "d2")
