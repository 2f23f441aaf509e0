"""Pairing rising with falling edges into on-intervals."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import direction
from . import chunks

KEYS = ("building", "channel")


def _leveled(edges: DataFrame, keys: Sequence[str], order: str, chunk: float | None = None) -> DataFrame:
    """Edges with the depth of nesting (level) at which they open or close; falls with nothing open are left out.

    With v = 1 for a rise and -1 for a fall, b = running sum and low = running least of b and 0, the number of open
    rises is b - low; a fall that makes a new least of b closes nothing. Of a chunk the sum of v and the least running
    sum are all that later chunks need.
    """
    edges = edges.withColumn("v", direction(F.col("transition")))
    if chunk is None:
        local, offset, low_in = Window.partitionBy(*keys).orderBy(order), F.lit(0), F.lit(0)
        rows = edges.withColumn("own", F.sum("v").over(chunks.past(local)))
    else:
        local, series, offset, low_in = chunks.within(keys, [order]), chunks.along(keys), F.col("offset"), F.col("low_in")
        rows = chunks.cut(edges, keys, order, chunk).withColumn("own", F.sum("v").over(chunks.past(local)))
        totals = [F.sum("v").alias("total"), F.min("own").alias("least")]
        carries = {"offset": F.coalesce(F.sum("total").over(chunks.before(series)), F.lit(0)), "low_in": F.least(F.lit(0), F.coalesce(F.min(F.col("offset") + F.col("least")).over(chunks.before(series)), F.lit(0)))}
        rows = chunks.carried(rows, keys, totals, carries, ["offset", "low_in"])
    rows = rows.withColumn("b", F.col("own") + offset)
    rows = rows.withColumn("low", F.least(low_in, F.min("b").over(chunks.past(local))))
    rows = rows.withColumn("low_before", F.coalesce(F.lag("low").over(local), low_in))
    depth = F.col("b") - F.col("low")
    return rows.where((F.col("v") == 1) | (F.col("b") >= F.col("low_before"))).withColumn("level", F.when(F.col("v") == 1, depth).otherwise(depth + 1))


def _paired(leveled: DataFrame, keys: Sequence[str], order: str, chunked: bool = False) -> DataFrame:
    """Within a level rises and falls alternate, so a fall's partner is the row before it. The level window needs no further shuffle.

    With chunks, pairs inside a chunk are made there. What a chunk leaves open, at most a fall and a rise of each level,
    is shuffled by level and paired in the same way.
    """
    rise = F.struct(F.col("v").alias("v"), F.col("transition").alias("transition"), F.col("start").alias("start"), F.col(order).alias("at"))
    found = lambda rows: rows.where("v = -1 and rise.v = 1").select(*keys, F.col("rise.at").alias("rise_no"), F.col(order).alias("fall_no"), F.col("rise.transition").alias("transition"), (F.col("end") - F.col("rise.start")).alias("duration"), F.col("rise.start").alias("start"), F.col("end").alias("end"))
    if not chunked:
        return found(leveled.withColumn("rise", F.lag(rise).over(Window.partitionBy(*keys, "level").orderBy(order))))
    local = Window.partitionBy(*keys, chunks.CHUNK, "level").orderBy(order)
    rows = leveled.withColumns({"rise": F.lag(rise).over(local), "last": F.lead("v").over(local).isNull()})
    left = rows.where("(v = -1 and rise is null) or (v = 1 and last)").drop("rise", "last")
    return found(rows).unionByName(found(left.withColumn("rise", F.lag(rise).over(Window.partitionBy(*keys, "level").orderBy(order)))))


def pair_edges(edges: DataFrame, keys: Sequence[str] = KEYS, order: str = "edge_no", chunk: float | None = None) -> DataFrame:
    """On-intervals: each fall with the latest rise still open. Falls with none open and rises never closed are left out.

    A series is one task, or, with chunk, one for each stretch of so many units of order; the pairs are the same. order
    is then a number, and rows without it or a key are left out.
    """
    return _paired(_leveled(edges, keys, order, chunk), keys, order, chunk is not None)


def pair_outermost(labelled: DataFrame, keys: Sequence[str] = ("building", "label"), order: str = "edge_no", chunk: float | None = None) -> DataFrame:
    """Of the pairs of each label only those with nothing open around them. chunk: see pair_edges."""
    return _paired(_leveled(labelled, keys, order, chunk).where("level = 1"), keys, order, chunk is not None)


def pair_by_tolerance(edges: DataFrame, buffer_size: int = 20, min_tolerance: float = 100.0, percent_tolerance: float = 0.035, large_transition: float = 1000.0, keys: Sequence[str] = KEYS, order: str = "edge_no", chunk: int = 10_000) -> DataFrame:
    """Rises with later falls of like size: nearest edges first, each edge once. Edges without an end do not count.

    A pair is possible if its edges are fewer than buffer_size apart and their sizes differ by less than min_tolerance,
    or by less than percent_tolerance of the rise if that is large_transition or more. Pairs of one distance cannot share
    an edge, so all of them are settled at once, one distance after another, by window functions. What is settled about
    an edge depends on edges at most 1 + 2 + ... + (buffer_size - 1) places away: a series is cut into chunks of so many
    edges with a rim of that width on both sides, each worked on by itself. order is a number without ties; edges
    without it or a key are left out.
    """
    if buffer_size < 2 or chunk < 1:
        raise ValueError("buffer_size must be 2 or more, chunk positive")
    rim = buffer_size * (buffer_size - 1) // 2
    rows = edges.where("end is not null").select(*keys, order, F.col("transition").alias("w"), "start", "end")
    rows = chunks.numbered(rows, keys, order, chunk, "place").withColumn("own", F.floor(F.col("place") / chunk))
    rows = rows.withColumn(chunks.CHUNK, F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col("place") - rim) / chunk)), F.floor((F.col("place") + rim) / chunk))))
    local = chunks.within(keys, ["place"])
    allowed = F.when(F.col("w") >= large_transition, percent_tolerance * F.col("w")).otherwise(min_tolerance)
    rows = rows.withColumns({"rise": F.col("w") > 0, "allowed": allowed, "used": F.lit(False), "partner": F.lit(None).cast("int")})
    for distance in range(1, buffer_size):
        fall = F.lead(F.when(~F.col("rise") & ~F.col("used"), F.col("w")), distance).over(local)
        rows = rows.withColumn("_take", F.coalesce(F.col("rise") & ~F.col("used") & (F.abs(F.col("w") + fall) < F.col("allowed")), F.lit(False)))
        taken = F.col("used") | F.col("_take") | F.coalesce(F.lag("_take", distance).over(local), F.lit(False))
        rows = rows.withColumns({"partner": F.when(F.col("_take"), F.lit(distance)).otherwise(F.col("partner")), "used": taken})
    partner = F.struct(F.col(order).alias("no"), F.col("w").alias("w"), F.col("end").alias("end"))
    rows = rows.withColumn("fall", F.coalesce(*(F.when(F.col("partner") == d, F.lead(partner, d).over(local)) for d in range(1, buffer_size))))
    found = rows.where(F.col("partner").isNotNull() & (F.col(chunks.CHUNK) == F.col("own")))
    return found.select(*keys, F.col(order).alias("rise_no"), F.col("fall.no").alias("fall_no"), F.col("w").alias("t1_w"), F.col("fall.w").alias("t2_w"), "start", F.col("fall.end").alias("end"))


def pair_shape(pairs: DataFrame) -> DataFrame:
    """height_w, the mean size of both edges, and duration_s, all seconds from the rise to the fall."""
    return pairs.withColumn("height_w", (F.abs("t1_w") + F.abs("t2_w")) / 2).withColumn("duration_s", (F.col("end") - F.col("start")).cast("long"))


def cluster_pairs(pairs: DataFrame, bandwidth: float = 50.0, bin_width: float = 5.0, keys: Sequence[str] = ("building",)) -> DataFrame:
    """keys, center_w, n: clusters of pair heights by mean shift with a flat kernel.

    Heights are first counted in bins, a shuffle of counts only, so each building's mean shift works on a histogram.
    """
    if bandwidth <= 0 or bin_width <= 0:
        raise ValueError("bandwidth and bin_width must be positive")
    bins = pairs.groupBy(*keys, F.floor(F.col("height_w") / bin_width).alias("bin")).agg(F.count("*").alias("n"))

    def shift(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin", ignore_index=True)
        x, n = (pdf["bin"].to_numpy(float) + 0.5) * bin_width, pdf["n"].to_numpy(float)
        at = x.copy()
        for _ in range(300):
            near = abs(at[:, None] - x[None, :]) <= bandwidth
            new = (near * n * x).sum(1) / (near * n).sum(1)
            if abs(new - at).max() < 1e-9:
                break
            at = new
        out: list[list[float]] = []
        for center, count in sorted(zip(at, n, strict=True)):
            if out and center - out[-1][0] <= bandwidth / 2:
                out[-1][1] += count
            else:
                out.append([center, count])
        return pd.DataFrame([(*(pdf[k][0] for k in keys), round(c, 6), int(k)) for c, k in out], columns=[*keys, "center_w", "n"])

    kinds = dict(pairs.dtypes)
    return bins.groupBy(*keys).applyInPandas(shift, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "center_w double", "n long"]))


def edge_counts(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """building, channel, n_edges, n_paired (edges in pairs) with totals in rows whose channel or building is null."""
    left = edges.groupBy("building", "channel").agg(F.count("*").alias("n_edges"))
    right = pairs.groupBy("building", "channel").agg((2 * F.count("*")).alias("n_paired"))
    counts = left.join(right, ["building", "channel"], "left").na.fill(0, ["n_paired"])
    return counts.rollup("building", "channel").agg(F.sum("n_edges").alias("n_edges"), F.sum("n_paired").alias("n_paired"))


def on_time(pairs: DataFrame) -> DataFrame:
    """Number of on-intervals and their total length by building and channel."""
    return pairs.groupBy("building", "channel").agg(F.count("*").alias("n_on"), F.sum("duration").alias("on_time"))
