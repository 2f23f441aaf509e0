"""Feature statistics, bits, splits and samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import booleanize_array
from ..sources.shared import Scratch


def feature_stats(df: DataFrame, per_feature: bool = False) -> DataFrame:
    """Mean and population deviation over all cells of features, or a row (pos, mean, std) for each feature."""
    if per_feature:
        return df.select(F.posexplode("features").alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))
    return df.select(F.explode("features").alias("x")).agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))


def booleanize_features(df: DataFrame, n_bits: int, mean: float | list[float], std: float | list[float]) -> DataFrame:
    """df with bits: all features standardised, quantized to n_bits and joined."""
    return df.withColumn("bits", booleanize_array(F.col("features"), n_bits, mean, std))


def pseudo_random(seed: int, *columns: str) -> Column:
    """A text that orders rows at random but alike everywhere."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(c).cast("string") for c in columns)))


def global_rank(df: DataFrame, order: Sequence[Column], to: str = "rank") -> DataFrame:
    """Rows numbered from 1 in a total order, without one task for all of them.

    Rows are dealt by ranges of the order and sorted; a row's number within its task is what an ascending id gives. The
    dealt rows are saved once in the shared folder, and a table of a row for each task, its bound, holds what lies
    before it.
    """
    names = [f"_o{i}" for i in range(len(order))]
    keyed = df.withColumns(dict(zip(names, order, strict=True)))
    dealt = keyed.repartitionByRange(*names).sortWithinPartitions(*names).drop(*names).withColumn("_at", F.monotonically_increasing_id())
    dealt = Scratch(df.sparkSession, "rank").save(dealt, "rows")
    part, local = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = dealt.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return dealt.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn(to, F.col("_before") + local + 1).drop("_part", "_before", "_at")


def seeded_shuffle(df: DataFrame, id_col: str, seed: int = 0) -> DataFrame:
    """df with place: its row's number in a seeded random order. Ids must be unique."""
    return global_rank(df, [pseudo_random(seed, id_col), F.col(id_col)], "place")


def train_test_split(df: DataFrame, id_col: str, test_size: float = 0.25, seed: int = 0, exact: bool = True) -> DataFrame:
    """df with is_train. Exact: int(n * (1 - test_size)) rows of a seeded order train; else each row by its own hash, without a shuffle."""
    if not 0 <= test_size <= 1:
        raise ValueError("test_size must be from 0 to 1")
    if not exact:
        share = F.conv(F.substring(pseudo_random(seed, id_col), 1, 8), 16, 10).cast("double") / float(1 << 32)
        return df.withColumn("is_train", share < 1 - test_size)
    n_train = int(df.count() * (1 - test_size))
    return seeded_shuffle(df, id_col, seed).withColumn("is_train", F.col("place") <= n_train).drop("place")


def balance(df: DataFrame, id_col: str, label: str = "label", num_per_class: int = 1000, seed: int = 0) -> DataFrame:
    """num_per_class rows of each label by a seeded order; an error if a label has fewer. The limit works before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(label).orderBy(pseudo_random(seed, id_col), F.col(id_col)))
    found = df.groupBy(label).agg(F.count("*").alias("n")).agg(F.min("n")).first()[0]
    if found is not None and found < num_per_class:
        raise ValueError(f"a class has {found} rows, fewer than {num_per_class}")
    return df.withColumn("rank", rank).where(F.col("rank") <= num_per_class).drop("rank")


def n_classes(df: DataFrame, label: str = "label") -> DataFrame:
    """The number of distinct labels."""
    return df.agg(F.count_distinct(label).alias("n_classes"))


