"""Preparing readings: gaps, thresholds, slices, channel lists and statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import chunks

KEYS = ("building", "channel")


def backfill(readings: DataFrame, keys: Sequence[str] = KEYS, order: Sequence[str] = ("t",), value: str = "watts", chunk: float | None = None) -> DataFrame:
    """Each gap takes the next known value of its series; gaps at the end stay. One shuffle on the keys.

    The window runs backwards in time, so that its frame only grows; the same frame written forwards is quadratic. With
    chunk, a series is cut into stretches of so many units of order's first column, each a task; a chunk needs of later
    ones the first value that is known. Rows without a key or a place are left out then.
    """
    if chunk is not None:
        return chunks.next_known(readings, keys, [F.col(c) for c in order], order[0], chunk, F.col(value), value)
    back = Window.partitionBy(*keys).orderBy(*(F.col(c).desc() for c in order)).rowsBetween(Window.unboundedPreceding, 0)
    return readings.withColumn(value, F.last(value, ignorenulls=True).over(back))


def binarize(readings: DataFrame, threshold: float = 80.0, main: str = "main") -> DataFrame:
    """on = 1 where an appliance draws threshold watts or more, 0 elsewhere and in gaps; the main meter is left out."""
    return readings.where(F.col("channel") != main).withColumn("on", F.coalesce((F.col("watts") >= threshold).cast("int"), F.lit(0)))


def missing_channels(readings: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """(building, channel) of wanted channels that a building has no row of."""
    present = readings.select("building", "channel").where(F.col("channel").isin(list(wanted))).distinct()
    asked = readings.select("building").distinct().withColumn("channel", F.explode(F.array(*map(F.lit, wanted))))
    return asked.join(present, ["building", "channel"], "left_anti")


def slice_time(df: DataFrame, start: int, length: int, t: str = "t", closed: bool = False) -> DataFrame:
    """Rows with start <= t < start + length, or <= if closed."""
    end = F.col(t) <= start + length if closed else F.col(t) < start + length
    return df.where((F.col(t) >= start) & end)


def head_per_building(df: DataFrame, n: int = 1500, keys: Sequence[str] = ("building",), order: Sequence[str] = ("t",)) -> DataFrame:
    """The first n rows of each building. The limit is applied before the shuffle as well."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= n).drop("rank")


def channel_stats(readings: DataFrame, digits: int = 2) -> DataFrame:
    """Mean, smallest and largest reading of each channel."""
    stats = {"mean_watts": F.avg, "min_watts": F.min, "max_watts": F.max}
    return readings.groupBy("building", "channel").agg(*(F.round(f("watts"), digits).alias(name) for name, f in stats.items()))


def resample(readings: DataFrame, seconds: int = 6, keys: Sequence[str] = KEYS) -> DataFrame:
    """Means over a grid of seconds between each series' first and last reading; empty cells are 0. t is in seconds."""
    if seconds < 1:
        raise ValueError("the grid's step must be a second or more")
    cell = (F.floor(F.col("t") / seconds) * seconds).cast("long")
    means = readings.groupBy(*keys, cell.alias("t")).agg(F.avg("watts").alias("watts"))
    grid = means.groupBy(*keys).agg(F.explode(F.sequence(F.min("t"), F.max("t"), F.lit(seconds).cast("long"))).alias("t"))
    return grid.join(means, [*keys, "t"], "left").na.fill(0.0, ["watts"])
