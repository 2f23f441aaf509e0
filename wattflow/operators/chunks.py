"""Long series cut into chunks, so that one series is worked on by many tasks.

A chunk holds the rows of a series whose first order column lies in one interval of chunk units. Rows are dealt once by
(keys, chunk); what a chunk needs of the others is summed up in one row a chunk, carried along the chunks of a series by
windows over these few rows, and joined back. The rows' exchange serves each of these steps again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

CHUNK = "chunk"


def cut(df: DataFrame, keys: Sequence[str], at: str, length: float) -> DataFrame:
    """df with the number of each row's chunk, dealt by (keys, chunk). Rows without a key or a place have none and are left out."""
    if length <= 0:
        raise ValueError("a chunk's length must be positive")
    return df.dropna(subset=[*keys, at]).withColumn(CHUNK, F.floor(F.col(at) / F.lit(length)).cast("long")).repartition(*keys, CHUNK)


def within(keys: Sequence[str], order: Sequence[str | Column]) -> WindowSpec:
    """A chunk's rows in order."""
    return Window.partitionBy(*keys, CHUNK).orderBy(*order)


def along(keys: Sequence[str]) -> WindowSpec:
    """A series' chunks in order, for tables of one row a chunk."""
    return Window.partitionBy(*keys).orderBy(CHUNK)


def past(window: WindowSpec) -> WindowSpec:
    return window.rowsBetween(Window.unboundedPreceding, 0)


def before(window: WindowSpec) -> WindowSpec:
    return window.rowsBetween(Window.unboundedPreceding, -1)


def carried(rows: DataFrame, keys: Sequence[str], totals: Sequence[Column], carries: dict[str, Column], names: Sequence[str]) -> DataFrame:
    """rows with names, which carries make step by step of a table of totals, one row a chunk."""
    table = rows.groupBy(*keys, CHUNK).agg(*totals)
    for name, carry in carries.items():
        table = table.withColumn(name, carry)
    return rows.join(table.select(*keys, CHUNK, *names), [*keys, CHUNK])


def numbered(df: DataFrame, keys: Sequence[str], order: str, length: float, to: str) -> DataFrame:
    """df with each row's place in its series, from 0 by order, which has no ties."""
    rows = cut(df, keys, order, length).withColumn("_n", F.row_number().over(within(keys, [order])))
    rows = carried(rows, keys, [F.count("*").alias("_size")], {"_off": F.coalesce(F.sum("_size").over(before(along(keys))), F.lit(0))}, ["_off"])
    return rows.withColumn(to, (F.col("_n") + F.col("_off") - 1).cast("long")).drop("_n", "_off", CHUNK)


def next_known(df: DataFrame, keys: Sequence[str], order: Sequence[Column], at: str, length: float, value: Column, to: str) -> DataFrame:
    """df with value of the row itself or else of the next row in order that has one; order ascends, and first by at."""
    back = Window.partitionBy(*keys, CHUNK).orderBy(*(c.desc() for c in order))
    rows = cut(df, keys, at, length).withColumn("_v", value)
    rows = rows.withColumn("_own", F.last("_v", ignorenulls=True).over(past(back)))
    later = Window.partitionBy(*keys).orderBy(F.col(CHUNK).desc())
    first = F.min(F.when(F.col("_v").isNotNull(), F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)), F.col("_v").alias("v"))))
    rows = carried(rows, keys, [first.alias("_first")], {"_next": F.last("_first.v", ignorenulls=True).over(before(later))}, ["_next"])
    return rows.withColumn(to, F.coalesce("_own", "_next")).drop("_v", "_own", "_next", CHUNK)
