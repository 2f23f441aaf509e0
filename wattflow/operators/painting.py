"""Painting on-intervals onto samples, and scoring what was painted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import chunks

KEYS = ("building", "channel")
THRESHOLD = 80.0


def paint_intervals(samples: DataFrame, pairs: DataFrame, keys: Sequence[str] = KEYS, chunk: float | None = None) -> DataFrame:
    """samples with on = 1 where start <= t <= end of one of the pairs, else 0. Intervals may nest.

    Starts, samples and ends are swept in order of time; what lies at one time is ordered so that both ends belong to
    the interval. There is no join: however long intervals are, no rows multiply. With chunk, a series is cut into
    stretches of so many units of t, each a task, to which the number of intervals open at its beginning is carried;
    samples without a key or a t are left out then.
    """
    names = [c for c in samples.columns if c not in keys and c != "t"]
    rest = F.struct(*(F.col(f"`{c}`") for c in names)) if names else F.struct(F.lit(0).alias("_"))
    events = samples.select(*keys, "t", F.lit(1).alias("kind"), F.lit(0).alias("delta"), rest.alias("rest"))
    empty = F.lit(None).cast(events.schema["rest"].dataType).alias("rest")
    for column, kind, delta in (("start", 0, 1), ("end", 2, -1)):
        events = events.unionByName(pairs.select(*keys, F.col(column).alias("t"), F.lit(kind).alias("kind"), F.lit(delta).alias("delta"), empty))
    if chunk is None:
        opened = F.sum("delta").over(chunks.past(Window.partitionBy(*keys).orderBy("t", "kind")))
    else:
        events = chunks.cut(events, keys, "t", chunk)
        open_in = F.coalesce(F.sum("total").over(chunks.before(chunks.along(keys))), F.lit(0))
        events = chunks.carried(events, keys, [F.sum("delta").alias("total")], {"open_in": open_in}, ["open_in"])
        opened = F.col("open_in") + F.sum("delta").over(chunks.past(chunks.within(keys, ["t", "kind"])))
    painted = events.withColumn("on", (opened > 0).cast("int")).where("kind = 1")
    return painted.select(*keys, "t", *(F.col("rest")[c].alias(c) for c in names), "on")


def score_on_off(submission: DataFrame, truth: DataFrame, thresholds: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """building, channel, n_predicted, n_true, n_hit, precision, recall in percent (null for 0 / 0).

    A sample is truly on above its building's threshold (not at it), predicted on if its value, cut to a whole number,
    is 1. thresholds (building, threshold) is a table of a row for each building; others have the given threshold.
    """
    joined = submission.select("building", "channel", "t", "value").join(truth.select("building", "channel", "t", "watts"), ["building", "channel", "t"])
    if thresholds is not None:
        joined = joined.join(thresholds, "building", "left")
        limit = F.coalesce("threshold", F.lit(threshold))
    else:
        limit = F.lit(threshold)
    predicted, true = F.col("value").cast("int") == 1, F.coalesce(F.col("watts") > limit, F.lit(False))
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    counts = joined.groupBy("building", "channel").agg(count(predicted).alias("n_predicted"), count(true).alias("n_true"), count(predicted & true).alias("n_hit"))
    percent = lambda n: F.try_divide(100.0 * F.col("n_hit"), F.col(n))
    return counts.withColumns({"precision": percent("n_predicted"), "recall": percent("n_true")})


def check_submission(submission: DataFrame, truth: DataFrame) -> DataFrame:
    """building, channel, n_submitted, n_truth, n_only_submitted, n_only_truth, conforms: whether the samples of each channel agree."""
    keys = ["building", "channel", "t"]
    s = submission.groupBy(*keys).agg(F.count("*").alias("s"))
    t = truth.groupBy(*keys).agg(F.count("*").alias("u"))
    both = s.join(t, keys, "full_outer").na.fill(0, ["s", "u"])
    sums = both.groupBy("building", "channel").agg(F.sum("s").alias("n_submitted"), F.sum("u").alias("n_truth"), F.sum(F.when(F.col("u") == 0, F.col("s")).otherwise(0)).alias("n_only_submitted"), F.sum(F.when(F.col("s") == 0, F.col("u")).otherwise(0)).alias("n_only_truth"))
    return sums.withColumn("conforms", (F.col("n_submitted") == F.col("n_truth")) & (F.col("n_only_submitted") == 0) & (F.col("n_only_truth") == 0))
