"""Quality rules: base limits, then robust multivariate outliers (DataFrame functions only).

Each document gets a vector of transformed statistics. For every language and source the minimum covariance determinant
is estimated over h = (n + d + 1) / 2 of its n documents, so that nearly half of them may be junk. From each of three
starts (medians and absolute deviations; signs and tanh of the distances from these) the h documents nearest to the
current centre give the next mean and covariance until the determinant stops falling (concentration steps, each one
aggregation over the whole table). The least determinant wins; the documents within NEAR of it give the final estimate.
Both covariances are scaled to be consistent for normal data. A document is rejected if its squared Mahalanobis distance
from its group's final estimate exceeds CUT, the chi-square quantile at 1 - TAIL, on the bad side: a statistic lies over
the mean by 3 least spreads (length and length of words: lie off it), so that a text cleaner than its group is kept.

Groups of fewer than LEAST documents within the base limits borrow the pool of their language's small groups, then the
pool of all such; if that is still smaller than LEAST, the estimate of all documents judges them, however few these are.
Every statistic has a least spread, so that a group of equal documents does not reject all others.

Statistics of a text are found within its row: no word, window or text is ever shuffled. Aggregates by group combine
within tasks first, and their results, a few rows a group, are broadcast after a count (class Groups), so that a group
of a third of all documents is spread over all tasks.

Defined cases: a null or empty text has no words and fails the base limits; null language or source is a group named by
the empty string; ties and repeated rows are judged alike; no documents give no rows; extra columns are kept by carry,
whatever their names, and otherwise ignored.
"""

from __future__ import annotations

from functools import reduce
from math import erf, exp, pi, sqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, cut, discard, release, small, words_of

WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
SYMBOLS = "#*$%&|<>"
LEAST, ALL = 100, "**"
#: Concentration ends where the logarithm of the determinant falls by no more than this.
STILL = 1e-3
#: Least spread of each statistic.
STATS = {"length": 0.5, "word_length": 0.15, "symbols": 0.25, "marks": 0.25, "capitals": 0.15, "repeats": 0.15, "dup_lines": 0.15}

#: Statistics that are bad on either side of the mean; the others only above it.
EITHER = ("length", "word_length")


def _let(value: str, name: str, body: str) -> str:
    """SQL for ``body`` with ``value`` computed once and called ``name``."""
    return f"transform(array({value}), {name} -> {body})[0]"


def base_stats(docs: DataFrame, carry: list[str]) -> DataFrame:
    """The carried columns as struct ``row`` (if any), lang, source, the counts of every whole text, base_failed and v."""
    text = F.coalesce(F.col("text"), F.lit(""))
    row = [F.struct(*(F.col(f"`{c}`") for c in carry)).alias("row")] if carry else []
    d = docs.select(*row, F.coalesce(F.col("lang"), F.lit("")).alias("lang"), F.coalesce(F.col("source"), F.lit("")).alias("source"), text.alias("t"))
    # Each word becomes a number; a hash of four neighbours, then of two such four apart, names a window of eight.
    fours = "transform(x, (w, i) -> xxhash64(w, get(x, i + 1), get(x, i + 2), get(x, i + 3)))"
    windows = _let("transform(words, w -> xxhash64(w))", "x", _let(fours, "y", "slice(transform(y, (w, i) -> xxhash64(w, get(y, i + 4))), 1, greatest(size(y) - 7, 0))"))
    # Windows that occur twice: sort (hash, place), keep those with an equal neighbour, and count the words that they cover.
    twice = "transform(filter(sequence(0, size(s) - 1), j -> s[j].a <=> get(s, j - 1).a or s[j].a <=> get(s, j + 1).a), j -> s[j].i)"
    twice = _let("sort_array(transform(v, (a, i) -> struct(a as a, i as i)))", "s", twice)
    covered = f"aggregate(sort_array({twice}), struct(0L as n, -{WINDOW} as p), (c, q) -> struct(c.n + least({WINDOW}, q - c.p) as n, q as p), c -> c.n)"
    repeated = f"CASE WHEN n_words < {WINDOW + 1} THEN 0L ELSE {_let(windows, 'v', f'CASE WHEN size(array_distinct(v)) = size(v) THEN 0L ELSE {covered} END')} END"
    lines = F.filter(F.split(F.col("t"), "\n"), lambda x: F.rlike(x, F.lit(WORD)))

    marks = F.regexp_replace("t", f"[^{SYMBOLS}!]++", "")
    d = d.withColumn("words", words_of(F.col("t"))).withColumn("n_words", F.size("words").cast("long")).withColumn("lines", lines).withColumn("marks", marks).withColumn("n_symbols", F.length(F.replace("marks", F.lit("!"), F.lit(""))).cast("long"))
    d = d.select(
        *(["row"] if carry else []), "lang", "source", "n_words",
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"), "n_symbols", (F.length("marks") - F.col("n_symbols")).cast("long").alias("n_marks"),
        F.size(F.filter("words", lambda w: w == F.upper(w))).cast("long").alias("n_upper"),
        F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(repeated).alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return with_vector(d.withColumn("base_failed", failed))


def with_vector(stats: DataFrame) -> DataFrame:
    """Adds v: array of the transformed statistics, in the order of STATS."""
    w = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    c = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    vector = {
        "length": F.log1p("n_words"), "word_length": F.log(c / w), "symbols": F.log1p(20 * F.col("n_symbols") / w), "marks": F.log1p(20 * F.col("n_marks") / w),
        "capitals": F.col("n_upper") / w, "repeats": F.col("n_repeat_words") / w, "dup_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
    }
    return stats.withColumn("v", F.array(*(vector[k] for k in STATS)))


def _pools(vectors: DataFrame) -> DataFrame:
    """lang and source to g and s, the group whose estimate judges them; ALL in both where any pool is too small."""
    n = vectors.groupBy("lang", "source").agg(F.count_if(~F.col("base_failed")).alias("n"))
    by_lang = n.where(F.col("n") < LEAST).groupBy("lang").agg(F.sum("n").alias("nl"))
    rest = by_lang.where(F.col("nl") < LEAST).agg(F.coalesce(F.sum("nl"), F.lit(0)).alias("na")).scalar()
    own, lang = F.col("n") >= LEAST, F.col("nl") >= LEAST
    pool = F.when(rest >= LEAST, F.lit("*")).otherwise(F.lit(ALL))
    return n.join(by_lang, "lang", "left").select(
        "lang", "source",
        F.when(own | lang, F.concat(F.lit("="), "lang")).otherwise(pool).alias("g"),
        F.when(own, F.concat(F.lit("="), "source")).when(lang, F.lit("*")).otherwise(pool).alias("s"),
    )


def _chi2_cdf(x: float, d: int) -> float:
    """Of d degrees of freedom, d odd."""
    out, term = erf(sqrt(x / 2)), sqrt(2 * x / pi) * exp(-x / 2)
    for k in range(1, d, 2):
        out, term = out - term, term * x / (k + 2)
    return out


def _consistent(share: float) -> tuple[float, float]:
    """The squared distance within which a share of normal data lies, and the factor for the covariance of that share."""
    d, low, high = len(STATS), 0.0, 200.0
    for _ in range(60):
        low, high = (low, (low + high) / 2) if _chi2_cdf((low + high) / 2, d) >= share else ((low + high) / 2, high)
    return high, share / _chi2_cdf(high, d + 2)


#: Shares that the nearest documents can have of a group, with their factors; the distance that the final estimate takes.
SHARES = [i / 200 for i in range(100, 201)]
FACTORS = [_consistent(share)[1] for share in SHARES]
NEAR, NEAR_FACTOR = _consistent(0.975)
#: Squared distance beyond which a document on the bad side is rejected: normal data exceed it once in 1 / TAIL.
TAIL = 1e-10
CUT = _consistent(1 - TAIL)[0]


def _model(rows: DataFrame, keys: list[str], factor: str) -> DataFrame:
    """Mean m_i and Cholesky factor l_i_j of the covariance of v times ``factor`` with the least spreads added, and the
    logarithm of its determinant, by keys."""
    d, floors = len(STATS), list(STATS.values())
    pairs = [(i, j) for i in range(d) for j in range(i + 1)]
    sums = [f"avg(v[{i}]) as m_{i}" for i in range(d)] + [f"avg(v[{i}] * v[{j}]) as p_{i}_{j}" for i, j in pairs]
    factors = []
    for i, j in pairs:  # the factor, entry by entry: each a column of the few rows of this table
        inner = f"({factor}) * (p_{i}_{j} - m_{i} * m_{j})" + (f" + {floors[i] ** 2}D" if i == j else "") + "".join(f" - l_{i}_{k} * l_{j}_{k}" for k in range(j))
        factors.append(f"sqrt(greatest({inner}, {floors[i] ** 2 / 4}D)) as l_{i}_{j}" if i == j else f"({inner}) / l_{j}_{j} as l_{i}_{j}")
    model = rows.groupBy(*keys).agg(*map(F.expr, sums)).selectExpr("*", *factors)
    names = [*keys, *(f"m_{i}" for i in range(d)), *(f"l_{i}_{j}" for i, j in pairs)]
    return model.selectExpr(*names, " + ".join(f"2 * ln(l_{i}_{i})" for i in range(d)) + " as log_det")


def _distances(rows: DataFrame, model: DataFrame) -> DataFrame:
    """Adds d2 (squared Mahalanobis distance) and what else the model says."""
    d = len(STATS)
    ys = [f"(v[{i}] - m_{i}" + "".join(f" - l_{i}_{k} * y_{k}" for k in range(i)) + f") / l_{i}_{i} as y_{i}" for i in range(d)]
    keep = [f"`{c}`" for c in [*rows.columns, *(c for c in model.columns if c not in rows.columns and c[:2] not in ("m_", "l_"))]]
    out = rows.join(model, ["g", "s"]).selectExpr(*keep, *ys)
    return out.selectExpr(*keep, " + ".join(f"y_{i} * y_{i}" for i in range(d)) + " as d2")


def _filtered_distances(rows: DataFrame, model: DataFrame, on: tuple[str, ...]) -> DataFrame:
    """As _distances(), with bad_side, for results that are filtered by d2: the optimiser copies what a filter compares, and copies of
    copies of the terms of a distance would outgrow any compiled method. So it is one expression over arrays here."""
    d = len(STATS)
    of = f"named_struct('v', v, 'm', array({', '.join(f'm_{i}' for i in range(d))}), 'l', array({', '.join(f'l_{i}_{j}' for i in range(d) for j in range(i + 1))}))"
    known = "aggregate(transform(a.y, (q, k) -> q * p.l[i * (i + 1) div 2 + k]), 0D, (t, q) -> t + q)"
    step = _let(f"(p.v[i] - p.m[i] - {known}) / p.l[i * (i + 3) div 2]", "z", "named_struct('y', concat(a.y, array(z)), 's', a.s + z * z)")
    d2 = _let(of, "p", f"aggregate(sequence(0, {d - 1}), named_struct('y', cast(array() as array<double>), 's', 0D), (a, i) -> {step}, a -> a.s)")
    bad = " or ".join(f"abs(v[{i}] - m_{i}) > {3 * floor}D" if k in EITHER else f"v[{i}] - m_{i} > {3 * floor}D" for i, (k, floor) in enumerate(STATS.items()))
    return rows.join(model, list(on), "left").selectExpr(*(f"`{c}`" for c in rows.columns), f"{bad} as bad_side", f"{d2} as d2")


class Groups:
    """Lookup tables with a few rows a group: broadcast to every join if there are at most MOST_GROUPS groups, which is
    counted; a join by (g, s) would else bring a hot group into one task. Keeps what it wrote, to delete it at the end.
    After each table the driver collects its garbage: the plans of a step are large, and the number of steps is not known."""

    MOST_GROUPS = 20_000

    def __init__(self, groups: int):
        self.near = F.broadcast if groups <= self.MOST_GROUPS else (lambda df: df)
        self.written: list[DataFrame] = []

    def cut(self, df: DataFrame, what: str) -> DataFrame:
        self.written.append(cut(df, what))
        release(df.sparkSession)
        return self.written[-1]

    def lookup(self, df: DataFrame, what: str) -> DataFrame:
        return self.near(self.cut(df, what))


def _starts(rows: DataFrame, groups: Groups) -> DataFrame:
    """Distances (g, s, k, v, d2) that the concentration steps of start k begin with: from medians in absolute
    deviations (0), and from the means of the rows drawn in to tanh (1) or the sign (2) of those distances."""
    d, floors = len(STATS), list(STATS.values())
    median = groups.lookup(rows.groupBy("g", "s").agg(*(F.expr(f"percentile_approx(v[{i}], 0.5, 1000) as c_{i}") for i in range(d))), "mcd-medians")
    spread = rows.join(median, ["g", "s"]).groupBy("g", "s").agg(*(F.expr(f"percentile_approx(abs(v[{i}] - c_{i}), 0.5, 1000) as a_{i}") for i in range(d)))
    scales = [f"sqrt(pow(1.4826D * a_{i}, 2) + {floors[i] ** 2}D)" for i in range(d)]
    scaled = groups.lookup(spread.join(median, ["g", "s"]).selectExpr("g", "s", f"array({', '.join(f'c_{i}' for i in range(d))}) as c", f"array({', '.join(scales)}) as a"), "mcd-scales")
    z = rows.join(scaled, ["g", "s"]).selectExpr("g", "s", "v", "c", "a", "transform(v, (x, i) -> (x - c[i]) / a[i]) as z").selectExpr("*", "aggregate(z, 0D, (n, x) -> n + x * x) as d2")
    tanh = z.selectExpr("g", "s", "1 as k", "transform(z, (x, i) -> c[i] + a[i] * tanh(x)) as v")
    sign = z.selectExpr("g", "s", "2 as k", f"transform(z, (x, i) -> c[i] + a[i] * x * sqrt({d}D / greatest(d2, 1e-12D))) as v")
    drawn = groups.lookup(_model(tanh.unionByName(sign), ["g", "s", "k"], "1D"), "mcd-starts")
    return z.selectExpr("g", "s", "0 as k", "v", "d2").unionByName(_distances(rows, drawn).select("g", "s", "k", "v", "d2"))


def _step(near: DataFrame, groups: Groups) -> DataFrame:
    """The model of the h nearest documents of each (g, s, k)."""
    shares = f"array({', '.join(f'{x}D' for x in SHARES)})"
    at = f"cast(least(ceil(100D * (n + {len(STATS) + 1}) / n), 200) - 100 as int)"
    limit = near.groupBy("g", "s", "k").agg(F.expr(f"percentile_approx(d2, {shares}, 1000) as q"), F.expr("count(*) as n"))
    limit = groups.lookup(limit.selectExpr("g", "s", "k", f"q[{at}] as most", f"array({', '.join(f'{x}D' for x in FACTORS)})[{at}] as factor"), "mcd-limits")
    return groups.cut(_model(near.join(limit, ["g", "s", "k"]).where("d2 <= most"), ["g", "s", "k", "factor"], "factor"), "mcd-model")


def robust_model(rows: DataFrame, groups: Groups) -> DataFrame:
    """The reweighted minimum covariance determinant estimate of each (g, s) of rows (g, s, v); that of ALL takes every row."""
    rows = groups.cut(rows.select("g", "s", "v"), "mcd-rows")
    if rows.where(F.col("g") == ALL).head(1):
        rows = rows.unionByName(rows.where(F.col("g") != ALL).select(F.lit(ALL).alias("g"), F.lit(ALL).alias("s"), "v"))
    steps = [_step(_starts(rows, groups), groups)]
    moving = steps[0]
    while moving.head(1):  # each turn lowers a determinant that the least spreads bound from below
        steps.append(_step(_distances(rows, groups.near(moving)).select("g", "s", "k", "v", "d2"), groups))
        before = moving.select("g", "s", "k", F.col("log_det").alias("was"))
        moving = groups.cut(steps[-1].join(before, ["g", "s", "k"]).where(F.col("was") - F.col("log_det") > STILL).drop("was"), "mcd-moving")
    seen = reduce(DataFrame.unionByName, steps)
    best = seen.groupBy("g", "s").agg(F.min_by(F.struct(*(c for c in seen.columns if c not in ("g", "s"))), F.struct("log_det", "k")).alias("x")).select("g", "s", "x.*").drop("k", "factor")
    within = _filtered_distances(rows, groups.lookup(best, "mcd-best"), ("g", "s")).where(F.col("d2") <= NEAR)
    return groups.cut(_model(within.select("g", "s", "v"), ["g", "s"], f"{NEAR_FACTOR}D").drop("log_det"), "mcd-final")


def fit(vectors: DataFrame) -> DataFrame:
    """Rows (lang, source, base_failed, v) to the estimate that judges each (lang, source): a written table."""
    pools = cut(_pools(vectors), "quality-pools")
    groups = Groups(pools.count())
    rows = vectors.where(~F.col("base_failed")).join(groups.near(pools), ["lang", "source"])
    model = cut(pools.join(groups.near(robust_model(rows, groups)), ["g", "s"], "left").drop("g", "s"), "quality-model")
    discard(pools, *groups.written)
    return model


def judge(stats: DataFrame, model: DataFrame) -> DataFrame:
    """Adds kept and d2 to what base_stats() gives, by the estimates of fit()."""
    # A slice is not taken apart by the optimiser, which would put a copy of each statistic's expression at each use of v.
    stats = stats.withColumn("v", F.slice("v", 1, len(STATS)))
    judged = _filtered_distances(stats, small(model, Groups.MOST_GROUPS), ("lang", "source"))
    # One comparison: as a conjunction its first part would be pushed down and count every text twice.
    far = F.when(F.col("base_failed"), F.lit(float("inf"))).when(F.col("bad_side"), F.col("d2"))
    return judged.withColumn("kept", F.coalesce(far, F.lit(0.0)) <= CUT)


def judge_quality(docs: DataFrame, carry: list[str]) -> DataFrame:
    """The carried columns as struct ``row``, the base counts, base_failed, kept and d2, a row per document. What is
    carried is written once beside the statistics: carry keys, not texts."""
    stats = cut(base_stats(docs, carry), "quality-stats")
    return judge(stats, fit(stats.select("lang", "source", "base_failed", "v")))


def good_documents(docs: DataFrame) -> DataFrame:
    """The documents to keep, all columns. The estimate is learnt from written vectors without texts; the texts are then
    read a second time and judged as they pass, so that no text is shuffled or written beside the result."""
    vectors = cut(base_stats(docs, []).select("lang", "source", "base_failed", "v"), "quality-vectors")
    model = fit(vectors)
    discard(vectors)
    return judge(base_stats(docs, docs.columns), model).where("kept").select("row.*")
