"""Quality rules with robust multivariate outliers, in DataFrame functions only.

Base rules reject texts of few words or of much repetition. Of the others, statistics are transformed and held against
a minimum-covariance-determinant estimate of their language and source: from two robust starts, concentration steps
keep the three quarters of a group that lie closest to the current centre, the smaller determinant wins, and one
reweighting step follows. Texts at too large a Mahalanobis distance are rejected. Groups are only ever aggregates,
which are combined before a shuffle, so a source that holds a third of all rows does no harm.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch

LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Texts of smaller groups are pooled by language, then altogether.
LEAST_GROUP = 100
#: The part of a group that the estimate concentrates on.
CORE = 0.75
STEPS = 3
#: Group estimates are broadcast up to this number of groups, else joined on a salted key.
BROADCAST_GROUPS = 50_000
SALTS = 64
#: Each statistic's scale below which differences do not count: mean word length (log), symbols a word, repeated lines, repeated words, capital letters.
FLOORS = {"f_length": 0.10, "f_symbols": 0.30, "f_lines": 0.10, "f_repeats": 0.08, "f_capitals": 0.03}
# Fixed values of the chi-squared law with 5 degrees of freedom: consistency factors of the core and of the reweighted
# rows, the 97.5 % quantile, and the cut-off (99.99 %).
CORE_FACTOR, REWEIGHT_FACTOR, REWEIGHT_CUT, CUT = 1.412, 1.055, 12.83, 25.74

NAMES = list(FLOORS)
P = len(NAMES)
GROUP = ["g_lang", "g_source"]


def _length(text: Column, without: str = "") -> Column:
    return F.char_length(F.translate(text, without, "") if without else text)


def statistics(docs: DataFrame, text: str) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_capitals of the text column; null is empty."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.translate(x, BLANKS, "") != "")
    first = docs.withColumns({"q_words": F.array_remove(F.split(t, "[ \\t-\\r]+"), ""), "q_lines": lines, "word_chars": _length(t, BLANKS).cast("long"), "n_symbols": (_length(t) - _length(t, SYMBOLS)).cast("long"), "n_capitals": (_length(t) - _length(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).cast("long")})
    second = first.withColumns({"q_hashes": F.transform("q_words", lambda w: F.xxhash64(w)), "n_words": F.size("q_words").cast("long"), "n_lines": F.size("q_lines").cast("long"), "n_dup_lines": (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long")}).drop("q_words", "q_lines")
    h = F.col("q_hashes")
    windows = F.transform(F.slice(h, 1, F.greatest(F.size(h) - 2, F.lit(0))), lambda x, i: F.struct(F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)).alias("h"), i.alias("i")))
    third = second.withColumn("q_windows", F.sort_array(windows)).drop("q_hashes")
    w = F.col("q_windows")
    again = F.filter(w, lambda x, j: F.coalesce(x["h"] == F.get(w, j + 1)["h"], F.lit(False)) | ((j > 0) & (x["h"] == F.get(w, F.greatest(j - 1, F.lit(0)))["h"])))
    covered = F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    return third.withColumn("n_repeat_words", F.size(covered).cast("long")).drop("q_windows")


def vectors(rows: DataFrame) -> DataFrame:
    """rows with the transformed statistics in units of their floors, 0 for texts without words."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    symbols = 10 * F.col("n_symbols") / n
    raw = {"f_length": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n), "f_symbols": F.asinh(symbols), "f_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)), "f_repeats": F.col("n_repeat_words") / n, "f_capitals": F.col("n_capitals") / F.greatest(F.col("word_chars"), F.lit(1))}
    return rows.withColumns({k: (x / F.lit(FLOORS[k])).cast("double") for k, x in raw.items()})


def _moments(rows: DataFrame, factor: float) -> DataFrame:
    """For each group n, means m_i and the lower triangle of the covariance (times factor, plus the floor) c_i_j."""
    sums = [F.avg(x).alias(f"m_{i}") for i, x in enumerate(NAMES)] + [F.avg(F.col(NAMES[i]) * F.col(NAMES[j])).alias(f"p_{i}_{j}") for i in range(P) for j in range(i + 1)]
    found = rows.groupBy(*GROUP).agg(F.count("*").alias("n"), *sums)
    cov = [(factor * (F.col(f"p_{i}_{j}") - F.col(f"m_{i}") * F.col(f"m_{j}")) + (1.0 if i == j else 0.0)).alias(f"c_{i}_{j}") for i in range(P) for j in range(i + 1)]
    return _factored(found.select(*GROUP, "n", *(f"m_{i}" for i in range(P)), *cov))


def _factored(stats: DataFrame) -> DataFrame:
    """The Cholesky factor l_i_j in place of the covariance, and the log-determinant."""
    for i in range(P):
        new = {}
        for j in range(i):
            inner = reduce(lambda a, k: a - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}"), range(j), F.col(f"c_{i}_{j}"))
            stats = stats.withColumn(f"l_{i}_{j}", inner / F.col(f"l_{j}_{j}"))
        diagonal = reduce(lambda a, k: a - F.col(f"l_{i}_{k}") * F.col(f"l_{i}_{k}"), range(i), F.col(f"c_{i}_{i}"))
        new[f"l_{i}_{i}"] = F.sqrt(F.greatest(diagonal, F.lit(1e-9)))
        stats = stats.withColumns(new)
    log_det = reduce(lambda a, i: a + 2 * F.log(f"l_{i}_{i}"), range(P), F.lit(0.0))
    return stats.withColumn("log_det", log_det).drop(*(f"c_{i}_{j}" for i in range(P) for j in range(i + 1)))


def _distances(rows: DataFrame) -> DataFrame:
    """rows (joined with their group's estimate) with the squared Mahalanobis distance d2."""
    for i in range(P):
        rest = reduce(lambda a, k: a - F.col(f"l_{i}_{k}") * F.col(f"y_{k}"), range(i), F.col(NAMES[i]) - F.col(f"m_{i}"))
        rows = rows.withColumn(f"y_{i}", rest / F.col(f"l_{i}_{i}"))
    return rows.withColumn("d2", reduce(lambda a, i: a + F.col(f"y_{i}") * F.col(f"y_{i}"), range(P), F.lit(0.0))).drop(*(f"y_{i}" for i in range(P)))


def _by_group(rows: DataFrame, stats: DataFrame, keys: list[str], few: bool) -> DataFrame:
    """A left join with a table of groups that no hot group can hold up."""
    if few:
        return rows.join(F.broadcast(stats), keys, "left")
    salted = stats.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(*(x for x in rows.columns if x not in keys)), F.lit(SALTS)).cast("int")).join(salted, [*keys, "salt"], "left").drop("salt")


def _core(rows: DataFrame, few: bool) -> DataFrame:
    """The CORE part of each group with the smallest d2."""
    limits = rows.groupBy(*GROUP).agg(F.percentile_approx("d2", CORE, 5000).alias("limit"))
    return _by_group(rows, limits, GROUP, few).where("d2 <= limit").drop("limit")


def mcd_estimates(scratch: Scratch, rows: DataFrame, few: bool) -> DataFrame:
    """Robust centre and factored scatter of each group (g_lang, g_source) of rows with the columns NAMES."""
    rows = rows.select(*GROUP, *NAMES)
    middles = rows.groupBy(*GROUP).agg(*(F.percentile_approx(x, 0.5, 2000).alias(f"m_{i}") for i, x in enumerate(NAMES)))
    centred = _by_group(rows, scratch.save(middles, "middles"), GROUP, few)
    apart = [F.abs(F.col(x) - F.col(f"m_{i}")) for i, x in enumerate(NAMES)]
    spreads = centred.groupBy(*GROUP).agg(*(F.greatest(1.4826 * F.percentile_approx(a, 0.5, 2000), F.lit(1.0)).alias(f"s_{i}") for i, a in enumerate(apart)))
    scaled = _by_group(centred, scratch.save(spreads, "spreads"), GROUP, few)
    scaled_apart = [a / F.col(f"s_{i}") for i, a in enumerate(apart)]
    starts = {"sum": reduce(lambda a, b: a + b, (x * x for x in scaled_apart)), "largest": F.greatest(*scaled_apart)}
    found = []
    for name, measure in starts.items():
        stats = scratch.save(_moments(_core(scaled.withColumn("d2", measure).select(*GROUP, *NAMES, "d2"), few), CORE_FACTOR), f"{name}-0")
        for step in range(1, STEPS + 1):
            near = _core(_distances(_by_group(rows, stats, GROUP, few)).select(*GROUP, *NAMES, "d2"), few)
            stats = scratch.save(_moments(near, CORE_FACTOR), f"{name}-{step}")
        found.append(stats)
    both = found[0].unionByName(found[1])
    columns = [x for x in both.columns if x not in GROUP]
    best = both.groupBy(*GROUP).agg(F.min_by(F.struct(*columns), F.struct("log_det", "n")).alias("s")).select(*GROUP, "s.*")
    best = scratch.save(best, "best")
    inner = _distances(_by_group(rows, best, GROUP, few)).where(F.col("d2") <= REWEIGHT_CUT)
    return scratch.save(_moments(inner, REWEIGHT_FACTOR), "estimates")


def quality_rules(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row for each row of docs: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance (squared), kept.

    Null and empty texts have no words and fail the base rules. A null language or source is a group of its own. Groups
    of fewer than LEAST_GROUP texts that pass the base rules are pooled by language, and languages of fewer altogether;
    with no text to estimate from, none is rejected. Repeated rows are judged each. Other columns are not read.
    """
    scratch = Scratch(spark, "quality")
    null = F.lit("\x00null")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(lang_col), null).alias("lang"), F.coalesce(F.col(source_col), null).alias("source"), F.col(text_col).alias("text"))
    counted = vectors(statistics(rows, "text").drop("text"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    base = scratch.save(counted.withColumn("base_failed", failed), "base")
    passed = base.where("not base_failed")

    sizes = scratch.save(passed.groupBy("lang", "source").agg(F.count("*").alias("n")), "sizes")
    few = sizes.count() <= BROADCAST_GROUPS
    small = sizes.where(F.col("n") < LEAST_GROUP).groupBy("lang").agg(F.sum("n").alias("n_small"))
    pooled = F.lit("\x00all")
    named = sizes.join(small, "lang", "left").select(
        "lang",
        "source",
        F.when((F.col("n") >= LEAST_GROUP) | (F.col("n_small") >= LEAST_GROUP), F.col("lang")).otherwise(pooled).alias("g_lang"),
        F.when(F.col("n") >= LEAST_GROUP, F.col("source")).otherwise(pooled).alias("g_source"),
    )
    named = scratch.save(named, "named")
    grouped = _by_group(passed, named, ["lang", "source"], few)
    estimates = mcd_estimates(scratch, scratch.save(grouped.select(*GROUP, *NAMES), "vectors"), few)
    judged = _distances(_by_group(_by_group(base, named, ["lang", "source"], few), estimates, GROUP, few))
    kept = ~F.col("base_failed") & (F.coalesce(F.col("d2"), F.lit(0.0)) <= CUT)
    distance = F.when(~F.col("base_failed"), F.col("d2"))
    return judged.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", distance.alias("distance"), kept.alias("kept"))
