"""Accuracy, confusion matrix and report of predictions (columns label and pred)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def accuracy(df: DataFrame) -> DataFrame:
    """The part of rows whose label is predicted."""
    return df.agg(F.avg((F.col("pred") == F.col("label")).cast("double")).alias("accuracy"))


def confusion(df: DataFrame, classes: Sequence[int]) -> DataFrame:
    """A row for each label with a column pred_{class} for each class: how often it was predicted."""
    counts = df.groupBy("label").pivot("pred", list(classes)).count().na.fill(0)
    return counts.select("label", *(F.col(f"`{c}`").alias(f"pred_{c}") for c in classes))


def report(df: DataFrame) -> DataFrame:
    """name, precision, recall, f1, support: a row for each class, and accuracy, macro avg and weighted avg.

    All come from the counts by (label, pred), of which there are at most the classes' square. Where a ratio is 0 / 0
    it is 0, and accuracy stands in f1.
    """
    cells = df.groupBy("label", "pred").agg(F.count("*").alias("n"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    by_label = cells.groupBy(F.col("label").alias("class")).agg(F.sum("n").alias("support"), zero(F.sum(F.when(F.col("label") == F.col("pred"), F.col("n")))).alias("hits"))
    by_pred = cells.groupBy(F.col("pred").alias("class")).agg(F.sum("n").alias("predicted"))
    both = by_label.join(by_pred, "class", "full_outer").na.fill(0, ["support", "hits", "predicted"])
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    rows = both.withColumns({"precision": ratio(F.col("hits").cast("double"), F.col("predicted")), "recall": ratio(F.col("hits").cast("double"), F.col("support"))})
    rows = rows.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    measures = ["precision", "recall", "f1"]
    own = rows.select(F.col("class").cast("string").alias("name"), *measures, "support")
    macro = rows.agg(*(F.avg(m).alias(m) for m in measures), F.sum("support").alias("support")).select(F.lit("macro avg").alias("name"), *measures, "support")
    weighted = rows.agg(*(ratio(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(m) for m in measures), F.sum("support").alias("support")).select(F.lit("weighted avg").alias("name"), *measures, "support")
    none = F.lit(None).cast("double")
    exact = rows.agg(ratio(F.sum("hits").cast("double"), F.sum("support")).alias("f1"), F.sum("support").alias("support")).select(F.lit("accuracy").alias("name"), none.alias("precision"), none.alias("recall"), "f1", "support")
    return own.unionByName(macro).unionByName(weighted).unionByName(exact)
