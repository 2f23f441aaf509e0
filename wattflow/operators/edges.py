"""Steady-state edges of power series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import chunks

KEYS = ("building", "channel")


def _whole(rows: DataFrame, noise_level: float, state_threshold: float, min_n_samples: int, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """What the detector knows at each row (m_before, t_before, x, c_before, emits, mean_before, level, last_change, edge_no), each series in one task."""
    t, m = F.col(order[0]), F.col("watts")
    series = Window.partitionBy(*keys).orderBy(*order)
    past = series.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    recent = series.rowsBetween(1 - min_n_samples, 0)
    rows = rows.withColumns(
        {
            "i": F.row_number().over(series) - 1,
            "m_before": F.lag("watts").over(series),
            "t_before": F.lag(order[0]).over(series),
            "m_first": F.first("watts").over(past),
            "more": F.lead(order[0]).over(series).isNotNull(),
        }
    )
    rows = rows.withColumn("c", F.coalesce(F.abs(m - F.col("m_before")) > state_threshold, F.lit(False)))
    rows = rows.withColumns({"run": F.sum(F.col("c").cast("int")).over(past), "later": F.col("i") > 0, "c_recent": F.max("c").over(recent), "c_before": F.coalesce(F.lag("c").over(series), F.lit(False))})
    stretch = Window.partitionBy(*keys, "later", "run").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("mean", F.avg("watts").over(stretch))
    rows = rows.withColumn("check", (F.col("i") >= min_n_samples) & ~F.col("c_recent") & F.col("more"))
    older = series.rowsBetween(Window.unboundedPreceding, -2)
    rows = rows.withColumns({"level": F.coalesce(F.last(F.when(F.col("check"), F.col("mean")), ignorenulls=True).over(older), F.col("m_first")), "checked": F.coalesce(F.lag("check").over(series), F.lit(False)), "mean_before": F.lag("mean").over(series)})
    rows = rows.withColumns({"x": F.col("later") & (F.abs(m - F.col("level")) > noise_level), "emits": F.col("checked") & (F.abs(F.col("mean_before") - F.col("level")) > noise_level)})
    before = series.rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumns({"edge_no": F.coalesce(F.sum(F.col("emits").cast("int")).over(before), F.lit(0)), "last_change": F.last(F.when(F.col("c"), t), ignorenulls=True).over(before)})


def _by_chunks(rows: DataFrame, noise_level: float, state_threshold: float, min_n_samples: int, keys: Sequence[str], order: Sequence[str], chunk: float) -> DataFrame:
    """The same as _whole, each series in as many tasks as it has chunks.

    Three tables of one row a chunk carry a series' state on: the last reading, and sum and number of the run without
    changes that is still open; the level of the last check with what the detector knew at the last reading; and how
    many edges there were.
    """
    t, m, local, series = F.col(order[0]), F.col("watts"), chunks.within(keys, order), chunks.along(keys)
    past, before, row = chunks.past(local), chunks.before(local), F.struct(*order)
    no = F.lit(False)
    rows = chunks.cut(rows, keys, order[0], chunk).withColumns({"k": F.row_number().over(local), "m_lag": F.lag("watts").over(local), "t_lag": F.lag(order[0]).over(local), "ends": F.lead(order[0]).over(local).isNull()})
    rows = rows.withColumn("inner", F.coalesce(F.abs(m - F.col("m_lag")) > state_threshold, no)).withColumn("inner_run", F.sum(F.col("inner").cast("int")).over(past))
    # The readings after a chunk's last inner change, or all but its first, which may begin a run or the series.
    runs = Window.partitionBy(*keys, chunks.CHUNK, "inner_run").orderBy(*order)
    rows = rows.withColumns({"rest": F.coalesce(F.sum(F.when(F.col("k") > 1, m)).over(chunks.past(runs)), F.lit(0.0)), "n_rest": F.sum((F.col("k") > 1).cast("long")).over(chunks.past(runs))})
    totals = [F.min(F.struct(*order, "watts")).alias("first"), F.max(F.struct(*order, "watts", "inner_run", "rest", "n_rest")).alias("last")]
    first, last = F.col("first.watts"), F.col("last")
    plain, opened = F.col("last.inner_run") == 0, Window.partitionBy(*keys, "part").orderBy(chunks.CHUNK)
    carries = {
        "prior": F.lag("last").over(series),
        "m_first": F.first(first).over(chunks.past(series)),
        "followed": F.lead(chunks.CHUNK).over(series).isNotNull(),
        "begins": F.col("prior").isNull(),
        "c_first": F.coalesce(F.abs(first - F.col("prior.watts")) > state_threshold, no),
        "sum": last["rest"] + F.when(plain & ~F.col("begins"), first).otherwise(0.0),
        "n": last["n_rest"] + (plain & ~F.col("begins")).cast("long"),
        "part": F.sum((~plain | F.col("c_first")).cast("int")).over(chunks.past(series)),
        "sum_to": F.sum("sum").over(chunks.past(opened)),
        "n_to": F.sum("n").over(chunks.past(opened)),
        "sum_in": F.coalesce(F.lag("sum_to").over(series), F.lit(0.0)),
        "n_in": F.coalesce(F.lag("n_to").over(series), F.lit(0)),
        "changed_in": F.coalesce(F.lag("part").over(series) > 0, no),
        "m_prior": F.col("prior.watts"),
        "t_prior": F.col(f"prior.{order[0]}"),
    }
    rows = chunks.carried(rows, keys, totals, carries, ["m_first", "followed", "begins", "c_first", "sum_in", "n_in", "changed_in", "m_prior", "t_prior"])
    starts = F.col("k") == 1
    rows = rows.withColumns({"later": ~(starts & F.col("begins")), "c": F.when(starts, F.col("c_first")).otherwise(F.col("inner")), "m_before": F.coalesce("m_lag", "m_prior"), "t_before": F.coalesce("t_lag", "t_prior"), "more": ~F.col("ends") | F.col("followed")})
    goes_on = (F.col("inner_run") == 0) & ~F.col("c_first")  # the run that was open before the chunk
    with_first = (F.col("inner_run") == 0) & ~F.col("begins")
    rows = rows.withColumn("n_run", F.col("n_rest") + with_first.cast("long") + F.when(goes_on, F.col("n_in")).otherwise(0))
    head = F.first("watts").over(past)
    rows = rows.withColumn("mean", F.try_divide(F.when(goes_on, F.col("sum_in")).otherwise(0.0) + F.when(with_first, head).otherwise(0.0) + F.col("rest"), F.col("n_run")))
    calm = F.col("n_run") - (F.when(goes_on, F.col("changed_in")).otherwise(True)).cast("long")
    rows = rows.withColumn("check", (calm >= min_n_samples) & F.col("more"))

    checks = F.struct(*order, "mean")
    totals = [F.max(F.when(F.col("check"), checks)).alias("at_check"), F.max(F.when(F.col("check") & ~F.col("ends"), checks)).alias("at_inner"), F.max(F.struct(*order, "c", "check", "mean")).alias("final"), F.max(F.when(F.col("c"), t)).alias("changed")]
    carries = {
        "level_in": F.last("at_check.mean", ignorenulls=True).over(chunks.before(series)),
        "level_first": F.coalesce(F.lag("at_inner.mean").over(series), F.lag("level_in").over(series)),  # without the reading before the chunk
        "prior": F.lag("final").over(series),
        "change_in": F.last("changed", ignorenulls=True).over(chunks.before(series)),
    }
    rows = chunks.carried(rows, keys, totals, carries, ["level_in", "level_first", "prior", "change_in"])
    own = F.last(F.when(F.col("check"), F.col("mean")), ignorenulls=True).over(local.rowsBetween(Window.unboundedPreceding, -2))
    rows = rows.withColumn("level", F.coalesce(own, F.when(starts, F.col("level_first")).otherwise(F.col("level_in")), F.col("m_first")))
    prior = lambda c: F.when(starts, F.col(f"prior.{c}")).otherwise(F.lag(c).over(local))
    rows = rows.withColumns({"checked": F.coalesce(prior("check"), no), "mean_before": prior("mean"), "c_before": F.coalesce(prior("c"), no), "last_change": F.coalesce(F.last(F.when(F.col("c"), t), ignorenulls=True).over(before), F.col("change_in"))})
    rows = rows.withColumns({"x": F.col("later") & (F.abs(m - F.col("level")) > noise_level), "emits": F.col("checked") & (F.abs(F.col("mean_before") - F.col("level")) > noise_level)})

    rows = rows.withColumn("own_no", F.coalesce(F.sum(F.col("emits").cast("int")).over(before), F.lit(0)))
    rows = chunks.carried(rows, keys, [F.sum(F.col("emits").cast("int")).alias("n_edges")], {"edges_in": F.coalesce(F.sum("n_edges").over(chunks.before(series)), F.lit(0))}, ["edges_in"])
    return rows.withColumns({"edge_no": F.col("own_no") + F.col("edges_in"), "i": row})


def detect(readings: DataFrame, noise_level: float = 50.0, state_threshold: float = 15.0, min_n_samples: int = 2, keys: Sequence[str] = KEYS, order: Sequence[str] = ("t",), with_sequence: bool = False, chunk: float | None = None) -> DataFrame:
    """All emissions of the detector: keys, edge_no, transition, duration, start, end, active_average, at (and sequence).

    A reading changes if it differs from the one before by more than state_threshold. Within a stretch without changes
    a running mean is kept, in which a series' first reading never enters. After min_n_samples unchanged readings the
    mean is checked, when the next reading is there, against the mean of the last check before: a difference of more
    than noise_level is an edge. duration counts the samples collected on the way, start is where they begin, which
    may be long before the edge if a spike came to nothing; end is the last change, null if there was none. Readings
    that are null are left out. A series has one shuffle, on the keys, and is one task; with chunk, it is as many tasks as
    it has stretches of chunk units of order's first column, which must be a number, with the same edges (means are sums
    of a chunk's sums, so that their last digits may differ). The order has no ties then, and rows without a key or a place
    in it are left out.
    """
    if min_n_samples < 1:
        raise ValueError("min_n_samples must be positive")
    t = F.col(order[0])
    rows = readings.where("watts is not null").select(*keys, *order, "watts")
    if chunk is None:
        rows = _whole(rows, noise_level, state_threshold, min_n_samples, keys, order)
    else:
        rows = _by_chunks(rows, noise_level, state_threshold, min_n_samples, keys, order, chunk)
    aggs = [
        F.max(F.when(F.col("emits"), F.col("mean_before") - F.col("level"))).alias("transition"),
        F.sum(F.col("x").cast("int") + F.col("c_before").cast("int")).cast("int").alias("duration"),
        F.min(F.when(F.col("x"), F.col("t_before"))).alias("first"),
        F.max(F.when(F.col("emits"), F.col("last_change"))).alias("end"),
        F.max(F.when(F.col("emits"), F.col("mean_before"))).alias("active_average"),
        F.max(F.when(F.col("emits"), t)).alias("at"),
    ]
    if with_sequence:
        once = lambda flag: F.when(flag, F.array("m_before")).otherwise(F.array().cast("array<double>"))
        aggs.append(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("i", F.concat(once(F.col("x")), once(F.col("c_before"))).alias("s")))), lambda r: r["s"])).alias("sequence"))
    found = rows.groupBy(*keys, "edge_no").agg(*aggs).where("transition is not null")
    return found.withColumn("start", F.coalesce("first", "end")).drop("first")


def transitions(readings: DataFrame, noise_level: float = 50.0, state_threshold: float = 15.0, **how) -> DataFrame:
    """The edges of each series: keys, edge_no, transition, duration, start, end (and sequence)."""
    return detect(readings, noise_level, state_threshold, **how).drop("active_average", "at")


def steady_states(readings: DataFrame, noise_level: float = 50.0, state_threshold: float = 15.0, keys: Sequence[str] = KEYS, **how) -> DataFrame:
    """The level that each edge led to: keys, t (the edge's end), active_average."""
    return detect(readings, noise_level, state_threshold, keys=keys, **how).select(*keys, F.col("end").alias("t"), "active_average")
