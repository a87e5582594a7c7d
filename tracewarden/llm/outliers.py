"""Text statistics and robust multivariate outliers, in DataFrame functions only.

Covariances are minimum-covariance-determinant estimates per language and source:
concentration steps keep the three quarters of a group's rows that lie nearest to the
current centre. They begin at three starts, go on for as long as the determinant falls, and the
smallest determinant stays. Text statistics have many zeros, which would make covariances
singular, so each is shrunk towards a diagonal target (the regularised form of
the estimator).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden.functions.columns import computed_once
from tracewarden.llm.tables import read_table, stored
from tracewarden.llm.words import SPACE_PATTERN

SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
MARKS = "!?"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

# Fixed values of the estimator.
KEPT_SHARE = 0.75
# What the nearest three quarters of a normal sample of six dimensions spread, against all of it.
CONSISTENCY = 0.73
# Steps from every start; the best one then goes on until its determinant falls no more, which takes a few.
FIRST_STEPS = 2
MOST_STEPS = 30
# Relative accuracy of the share that a step keeps; groups of up to about so many rows get it exactly.
ACCURACY = 2000
# Rows of a fitted table, of about 300 bytes, up to which it is broadcast.
BROADCAST_ROWS = 50_000
SHRINKAGE = 0.25
SMALLEST_GROUP = 100
# Squared distance beyond which a row is rejected: one in a million of chi-square with
# six degrees of freedom, as clean texts have heavier tails than a normal sample.
CUTOFF = 38.26

# Transformed statistics, and the standard deviation that each is at least taken to have.
FEATURES: dict[str, tuple[str, float]] = {
    "log_words": ("log1p(n_words)", 0.5),
    "word_length": ("coalesce(log1p(word_chars / nullif(n_words, 0)), 0D)", 0.1),
    "symbols": ("coalesce(sqrt(n_symbols / nullif(word_chars, 0)), 0D)", 0.04),
    "marks": ("coalesce(sqrt(n_marks / nullif(word_chars, 0)), 0D)", 0.04),
    "dup_lines": ("log1p(n_dup_lines)", 0.3),
    "repeats": ("coalesce(sqrt(n_repeat_words / nullif(n_words, 0)), 0D)", 0.08),
}


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words covered by windows of ``window`` words that occur twice or more in the array.

    Windows are compared by their 64-bit hash within one text. Only texts with a
    repeat sort their windows; the next repeated window's distance tells how many words
    each one covers anew.
    """
    starts = F.sequence(F.lit(0), F.size(words) - F.lit(window))
    hashed = F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(window)]))

    def covered(hashes: Column) -> Column:
        places = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            hit = F.filter(
                s,
                lambda e, k: (F.get(s, k + 1)["h"] == e["h"]) | ((k > 0) & (F.get(s, F.greatest(k - 1, F.lit(0)))["h"] == e["h"])),
            )
            return F.sort_array(F.transform(hit, lambda e: e["i"]))

        def width(p: Column) -> Column:
            reach = F.transform(p, lambda at, k: F.least(F.coalesce(F.get(p, k + 1) - at, F.lit(window)), F.lit(window)))
            return F.aggregate(reach, F.lit(0), lambda total, n: total + n)

        many = F.size(F.array_distinct(hashes)) < F.size(hashes)
        return F.when(many, bound(bound(places, twice), width)).otherwise(0)

    return F.when(F.size(words) >= window, bound(hashed, covered)).otherwise(0)


def statistics(documents: DataFrame, keep: Sequence[str] = ("doc_id", "lang", "source")) -> DataFrame:
    """Base statistics of every whole text. A null or empty text has none of anything.

    One row per row of ``documents``, repeated ids included; other columns are left out.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = computed_once(
        documents.select(*keep, text.alias("text")),
        F.filter(F.split("text", SPACE_PATTERN), lambda w: w != "").alias("_words"),
        F.filter(F.split("text", "\n"), lambda x: F.trim(x, F.lit(SPACES)) != "").alias("_lines"),
    )
    return computed_once(
        rows,
        F.size("_words").cast("long").alias("n_words"),
        F.length(without(F.col("text"), SPACES)).cast("long").alias("word_chars"),
        (F.length("text") - F.length(without(F.col("text"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.length("text") - F.length(without(F.col("text"), MARKS))).cast("long").alias("n_marks"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_words")).cast("long").alias("n_repeat_words"),
    ).drop("text", "_words", "_lines")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _pairs(n: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(n) for j in range(i + 1)]


def _factor(covariance: dict[tuple[int, int], Column], n: int) -> list[tuple[str, Column]]:
    """Columns l_i_j of the Cholesky factor, each in terms of the ones before it."""
    found = []
    for j in range(n):
        for i in range(j, n):
            rest = covariance[(i, j)]
            for k in range(j):
                rest = rest - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            value = F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l_{j}_{j}")
            found.append((f"l_{i}_{j}", value))
    return found


def _distance(n: int) -> Column:
    """Squared Mahalanobis distance by forward substitution, one let-binding per unknown."""

    def solve(i: int, known: list[Column]) -> Column:
        if i == n:
            total = F.lit(0.0)
            for y in known:
                total = total + y * y
            return total
        rest = F.col(f"x_{i}") - F.col(f"m_{i}")
        for k, y in enumerate(known):
            rest = rest - F.col(f"l_{i}_{k}") * y
        return bound(rest / F.col(f"l_{i}_{i}"), lambda y: solve(i + 1, [*known, y]))

    return solve(0, [])


def _small(fit: DataFrame) -> DataFrame:
    """A table with few rows by group, broadcast once its rows are counted, so that no hot group is shuffled."""
    return F.broadcast(fit) if fit.count() <= BROADCAST_ROWS else fit


def _values(n: int) -> list[str]:
    return [*[f"m_{i}" for i in range(n)], *[f"l_{i}_{j}" for i, j in _pairs(n)], "log_det"]


def _fitted(rows: DataFrame, n: int, floors: Sequence[float]) -> DataFrame:
    """Centre, factor and log-determinant of the regularised covariance of ``rows``, by group and start."""
    sums = rows.groupBy("grp", "start").agg(
        *[F.avg(f"x_{i}").alias(f"m_{i}") for i in range(n)],
        *[F.covar_pop(f"x_{i}", f"x_{j}").alias(f"c_{i}_{j}") for i, j in _pairs(n)],
    )
    covariance = {
        (i, j): (1 - SHRINKAGE) * F.col(f"c_{i}_{j}") + (SHRINKAGE * F.col(f"c_{i}_{i}") + floors[i] ** 2 if i == j else F.lit(0.0))
        for i, j in _pairs(n)
    }
    for name, value in _factor(covariance, n):
        sums = sums.withColumn(name, value)
    log_det = F.lit(0.0)
    for i in range(n):
        log_det = log_det + 2 * F.ln(f"l_{i}_{i}")
    return sums.withColumn("log_det", log_det).select("grp", "start", *_values(n))


def _nearest(rows: DataFrame, fit: DataFrame, n: int, share: float) -> DataFrame:
    """The ``share`` of each group's rows that lie nearest to each fit's centre; equally near ones all count."""
    near = rows.join(_small(fit), "grp").withColumn("distance", _distance(n)).select("grp", "start", "distance", *[f"x_{i}" for i in range(n)])
    limits = stored(near.groupBy("grp", "start").agg(F.percentile_approx("distance", share, ACCURACY).alias("_limit")), "mcd")
    return near.join(_small(limits), ["grp", "start"]).where("distance <= _limit")


def _starts(rows: DataFrame, n: int, floors: Sequence[float]) -> DataFrame:
    """Three fits of each group: medians with spreads from the quartiles, all rows, and the half nearest to the first.

    None of them is of a subset of the size wanted, so their determinants count as infinite.
    """
    quartiles = rows.groupBy("grp").agg(*[F.percentile_approx(f"x_{i}", [0.25, 0.5, 0.75], ACCURACY).alias(f"q_{i}") for i in range(n)])
    medians = stored(
        quartiles.select(
            "grp",
            F.lit(0).alias("start"),
            *[F.col(f"q_{i}")[1].alias(f"m_{i}") for i in range(n)],
            *[
                (F.sqrt(F.pow((F.col(f"q_{i}")[2] - F.col(f"q_{i}")[0]) / 1.349, 2) + floors[i] ** 2) if i == j else F.lit(0.0)).alias(f"l_{i}_{j}")
                for i, j in _pairs(n)
            ],
            F.lit(0.0).alias("log_det"),
        ),
        "mcd",
    )
    half = _fitted(_nearest(rows, medians, n, 0.5), n, floors).withColumn("start", F.lit(2))
    whole = _fitted(rows.withColumn("start", F.lit(1)), n, floors)
    return medians.unionByName(whole).unionByName(half).withColumn("log_det", F.lit(float("inf")))


def _step(rows: DataFrame, fit: DataFrame, n: int, floors: Sequence[float]) -> DataFrame:
    """One concentration step; ``moved`` tells whether it lowered the determinant, without which the fit stays."""
    new = _fitted(_nearest(rows, fit, n, KEPT_SHARE), n, floors).select("grp", "start", F.struct(*_values(n)).alias("_new"))
    both = fit.select("grp", "start", F.struct(*_values(n)).alias("_old")).join(new, ["grp", "start"])
    moved = F.col("_new.log_det") < F.col("_old.log_det") - 1e-9
    return stored(both.select("grp", "start", F.when(moved, F.col("_new")).otherwise(F.col("_old")).alias("_fit"), moved.alias("moved")), "mcd").select(
        "grp", "start", "_fit.*", "moved"
    )


def minimum_determinants(rows: DataFrame, n: int, floors: Sequence[float]) -> DataFrame:
    """(grp, start, m_i, l_i_j, log_det): for each group, the fit with the smallest determinant that was reached.

    A group of a single row has its own values and the floors. Of equal determinants the earlier start counts.
    """
    fit = stored(_starts(rows, n, floors), "mcd")
    for _ in range(FIRST_STEPS):
        fit = _step(rows, fit, n, floors)
    best = fit.groupBy("grp").agg(F.min_by(F.struct(*fit.columns), F.struct("log_det", "start")).alias("_fit")).select("_fit.*")
    best = stored(best, "mcd")
    done = best.where("NOT moved")
    for _ in range(MOST_STEPS):
        going = best.where("moved")
        if going.isEmpty():
            break
        best = _step(rows, going.drop("moved"), n, floors)
        done = done.unionByName(best.where("NOT moved"))
    else:
        done = done.unionByName(best.where("moved"))
    return done.drop("moved")


def robust_distances(rows: DataFrame, n: int, floors: Sequence[float]) -> DataFrame:
    """Adds ``distance`` to rows (grp, x_0 .. x_n-1, ...) by each group's estimate."""
    fit = stored(minimum_determinants(rows, n, floors).drop("start"), "mcd")
    return rows.join(_small(fit), "grp").withColumn("distance", _distance(n) * CONSISTENCY).drop(*_values(n))


def quality_rules(documents: DataFrame) -> DataFrame:
    """Statistics, ``base_failed`` and ``kept`` of every document.

    Rows that fail the base rules are neither kept nor used for the estimates. The
    others are compared within their language and source; groups of fewer than
    ``SMALLEST_GROUP`` rows are pooled by language, and if that is still too few, all
    together. A pool that is too small for an estimate keeps all its rows. Null
    languages and sources are groups of their own.
    """
    base = stored(statistics(documents).withColumn("base_failed", base_failed()), "statistics")
    level = [
        F.to_json(F.struct("lang", "source"), {"ignoreNullFields": "false"}),
        F.to_json(F.struct("lang"), {"ignoreNullFields": "false"}),
        F.lit("all"),
    ]
    rows = base.where(~F.col("base_failed"))
    sizes = rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n0"))
    small = F.col("n0") < SMALLEST_GROUP
    by_lang = sizes.where(small).groupBy("lang").agg(F.sum("n0").alias("n1"))
    few = small & (F.col("n1") < SMALLEST_GROUP)
    groups = stored(
        sizes.join(by_lang.withColumnRenamed("lang", "_lang"), F.col("lang").eqNullSafe(F.col("_lang")), "left")
        .withColumn("grp", F.when(~small, level[0]).when(~few, level[1]).otherwise(level[2]))
        .select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), "grp"),
        "groups",
    )
    same = F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))
    names = list(FEATURES)
    x = stored(
        base.join(_small(groups), same, "left").select(
            *base.columns, "grp", *[F.expr(FEATURES[name][0]).alias(f"x_{i}") for i, name in enumerate(names)]
        ),
        "features",
    )
    floors = [FEATURES[name][1] for name in names]
    judged = robust_distances(x.where(~F.col("base_failed")), len(names), floors)
    judged = judged.withColumn("kept", F.col("distance") <= CUTOFF)
    failed = x.where("base_failed").withColumn("distance", F.lit(None).cast("double")).withColumn("kept", F.lit(False))
    out = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance"]
    return judged.select(*out).unionByName(failed.select(*out))


def op8_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text statistics and verdicts of every document."""
    return quality_rules(read_table(spark, sf_dir, "documents"))
