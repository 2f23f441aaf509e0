"""Labelling main-meter edges by the appliance edges they overlap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import overlaps
from . import chunks

TOLERANCE = 2
#: An interval is cut to at most so many buckets; longer ones are joined in a bucket of a coarser grid.
MOST_BUCKETS = 16


def _grids(start: Column, end: Column, width: int) -> Column:
    """The coarseness at which [start, end] lies in at most MOST_BUCKETS buckets, as a power of MOST_BUCKETS."""
    length = F.greatest(end - start, F.lit(0)) / F.lit(width)
    return F.greatest(F.lit(0), F.ceil(F.log(F.greatest(length, F.lit(1.0))) / F.log(F.lit(float(MOST_BUCKETS)))) - 1).cast("int")


def _cells(df: DataFrame, start: Column, end: Column, width: int, grids: Column) -> DataFrame:
    """df with a row for each cell (grid, bucket) that [start, end] touches at each of the grids."""
    with_grid = df.withColumns({"_s": start, "_e": F.greatest(start, end)}).withColumn("grid", F.explode(grids))
    size = F.pow(F.lit(float(MOST_BUCKETS)), F.col("grid").cast("double")) * width
    return with_grid.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("_s") / size), F.floor(F.col("_e") / size)))).drop("_s", "_e")


def candidates(main: DataFrame, app: DataFrame, tolerance: int = TOLERANCE, width: int | None = None) -> DataFrame:
    """building, channel, edge_no, main_edge and both intervals (m_start, m_end, a_start, a_end) of all pairs that share a bucket of time, those that overlap among them.

    Intervals are closed and widened by tolerance at both ends; edges without an end have no interval. Both sides are
    cut into buckets of time, an interval in few buckets of the grid that suits its length. Two joins on (building,
    grid, bucket) find all pairs: main edges on their own grid meet appliance edges of the same or a finer one, which
    are lifted to it, and appliance edges on their own grid meet main edges of a finer one. So a very long interval
    neither multiplies nor makes short ones meet each other on its grid.
    """
    width = width or max(1, 4 * tolerance)
    m = main.where("end is not null").select("building", F.col("edge_no").alias("main_edge"), F.col("start").alias("m_start"), F.col("end").alias("m_end"))
    a = app.where("end is not null").select("building", "channel", "edge_no", F.col("start").alias("a_start"), F.col("end").alias("a_end"))
    m = m.withColumn("own", _grids(F.col("m_start"), F.col("m_end"), width))
    a = a.withColumn("own", _grids(F.col("a_start") - 2 * tolerance, F.col("a_end") + 2 * tolerance, width))
    used = lambda df, name: df.groupBy("building").agg(F.collect_set("own").alias(name))
    m_cells = lambda df, grids: _cells(df, F.col("m_start"), F.col("m_end"), width, grids).drop("own", "grids")
    a_cells = lambda df, grids: _cells(df, F.col("a_start") - 2 * tolerance, F.col("a_end") + 2 * tolerance, width, grids).drop("own", "grids")
    alone = F.array("own")
    coarse = m_cells(m, alone).join(a_cells(a.join(used(m, "grids"), "building"), F.filter("grids", lambda g: g >= F.col("own"))), ["building", "grid", "bucket"])
    fine = m_cells(m.join(used(a, "grids"), "building"), F.filter("grids", lambda g: g > F.col("own"))).join(a_cells(a, alone), ["building", "grid", "bucket"])
    return coarse.unionByName(fine)


def ascending(main: DataFrame) -> bool:
    """Whether by edge_no, in each building, starts ascend and ends do not descend; edges without an end do not count."""
    ranks = Window.partitionBy("building").orderBy("edge_no")
    rows = main.where("end is not null").select("building", "edge_no", "start", "end").withColumns({"s": F.lag("start").over(ranks), "e": F.lag("end").over(ranks)})
    return rows.where("start < s or end < e").limit(1).count() == 0


def sweep(main: DataFrame, app: DataFrame, tolerance: int = TOLERANCE, chunk: float | None = None) -> DataFrame:
    """The matches of match_edges where starts of main edges ascend and ends do not descend (see ascending).

    The first main edge that an appliance edge can overlap is then the first that ends late enough, and if it begins too
    late, so do all after it. Main edges at their end and appliance edges at the least end that they need are put in one
    order of time, and each of these takes the main edge that comes next: one exchange on building, and no row
    multiplies. With chunk, a building is cut into stretches of so many units of time, each a task.
    """
    placed = "building is not null and start is not null and end is not null"
    m = main.where(placed).select("building", F.lit(None).cast("string").alias("channel"), F.lit(None).cast("long").alias("edge_no"), F.lit(None).cast("long").alias("a_end"), F.col("end").cast("long").alias("at"), F.lit(1).alias("kind"), F.col("edge_no").cast("long").alias("main_edge"), F.col("start").cast("long").alias("m_start"))
    a = app.where(placed).select("building", "channel", F.col("edge_no").cast("long"), F.col("end").cast("long").alias("a_end"), (F.col("start") - 2 * tolerance).cast("long").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("main_edge"), F.lit(None).cast("long").alias("m_start"))
    events = m.unionByName(a)
    value = F.when(F.col("kind") == 1, F.struct("main_edge", "m_start"))
    order = [F.col("at"), F.col("kind"), F.coalesce("main_edge", F.lit(0))]
    if chunk is None:
        back = Window.partitionBy("building").orderBy(*(c.desc() for c in order))
        events = events.withColumn("next", F.last(value, ignorenulls=True).over(chunks.past(back)))
    else:
        events = chunks.next_known(events, ["building"], order, "at", chunk, value, "next")
    found = events.where((F.col("kind") == 0) & (F.col("next.m_start") - F.col("a_end") <= 2 * tolerance))
    return found.select("building", "channel", "edge_no", F.col("next.main_edge").alias("main_edge"))


def match_edges(main: DataFrame, app: DataFrame, tolerance: int = TOLERANCE, width: int | None = None, ordered: bool | None = None, chunk: float | None = None) -> DataFrame:
    """building, channel, edge_no, main_edge: for each appliance edge the first main edge (by edge_no) that it overlaps.

    If main edges are ordered, as those of the detector are, one sweep finds them (chunk: see sweep); else buckets of
    time are joined (width: see candidates). Unless it is told, this is looked up by a job of its own.
    """
    if ascending(main) if ordered is None else ordered:
        return sweep(main, app, tolerance, chunk)
    met = candidates(main, app, tolerance, width).where(overlaps(F.col("m_start"), F.col("m_end"), F.col("a_start"), F.col("a_end"), tolerance))
    return met.groupBy("building", "channel", "edge_no").agg(F.min("main_edge").alias("main_edge"))


def unmatched_edges(app: DataFrame, matches: DataFrame) -> DataFrame:
    """Appliance edges that no main edge overlaps."""
    return app.join(matches.select("building", "channel", "edge_no"), ["building", "channel", "edge_no"], "left_anti")


def match_counts(app: DataFrame, matches: DataFrame) -> DataFrame:
    """building, channel, n_edges, n_matched, n_not_found of the appliance edges, with totals in rows whose channel or building is null. Counts are made before and after the shuffle."""
    both = app.groupBy("building", "channel").agg(F.count("*").alias("n_edges"), F.lit(0).cast("long").alias("n_matched"))
    found = matches.groupBy("building", "channel").agg(F.lit(0).cast("long").alias("n_edges"), F.count("*").alias("n_matched"))
    counts = both.unionByName(found).rollup("building", "channel").agg(F.sum("n_edges").alias("n_edges"), F.sum("n_matched").alias("n_matched"))
    return counts.withColumn("n_not_found", F.col("n_edges") - F.col("n_matched"))


def label_main_edges(main: DataFrame, matches: DataFrame, appliances: Sequence[str], unknown: str = "unknown") -> DataFrame:
    """Main edges with a 0/1 column {appliance}_label for each appliance, and label: the first appliance of the list, else unknown."""
    flags = matches.withColumn("flag", F.lit(1)).groupBy("building", F.col("main_edge").alias("edge_no")).pivot("channel", list(appliances)).agg(F.max("flag"))
    flags = flags.select("building", "edge_no", *(F.col(f"`{a}`").alias(f"{a}_label") for a in appliances))
    names = [f"{a}_label" for a in appliances]
    joined = main.join(flags, ["building", "edge_no"], "left").na.fill(0, names)
    return joined.withColumn("label", F.coalesce(*(F.when(F.col(f"`{n}`") == 1, a) for n, a in zip(names, appliances, strict=True)), F.lit(unknown)))
