"""Applying clause-voting models."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import clause_output, first_largest, pack_bits
from .model import to_arrays, with_masks


def predict(df: DataFrame, clauses: DataFrame, n_class: int, n_feature: int, return_votes: bool = False) -> DataFrame:
    """df with pred (and votes): the class with most votes, the first on ties. Works on streams as well.

    Rows meet the clauses as matrices in batches: no rows multiply and nothing is shuffled. Null bits give null.
    """
    classes, polarity, positive, negative = to_arrays(clauses, n_feature)
    into = np.zeros((len(classes), n_class), np.float32)
    into[np.arange(len(classes)), classes] = polarity

    @F.arrow_udf("struct<pred: int, votes: array<int>>")
    def vote(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for bits in batches:
            there = bits.is_valid().to_numpy(zero_copy_only=False)
            x = bits.flatten().to_numpy(zero_copy_only=False).reshape(-1, n_feature).astype(np.float32)  # nulls have no items
            broken = (1 - x) @ positive.T + x @ negative.T
            votes = ((broken == 0).astype(np.float32) @ into).astype(np.int32)
            ends = np.concatenate([[0], np.cumsum(there) * n_class]).astype(np.int32)
            pred = np.zeros(len(bits), np.int32)
            pred[there] = votes.argmax(1)
            none = pa.array(~there)
            yield pa.StructArray.from_arrays([pa.array(pred, mask=~there), pa.ListArray.from_arrays(pa.array(ends), pa.array(votes.ravel()), mask=none)], ["pred", "votes"])

    voted = df.withColumn("_v", vote("bits"))
    out = voted.withColumn("pred", F.col("_v.pred"))
    return (out.withColumn("votes", F.col("_v.votes")) if return_votes else out).drop("_v")


def votes_by_join(df: DataFrame, clauses: DataFrame, id_col: str, n_class: int, n_feature: int) -> DataFrame:
    """id, votes, pred with built-in functions: the clauses, packed as masks, come to each row as one bounded array."""
    masked = with_masks(clauses, n_feature).agg(F.collect_list(F.struct("class", "polarity", "p_mask", "n_mask")).alias("clauses"))
    packed = df.select(id_col, pack_bits(F.col("bits"), n_feature).alias("x")).join(F.broadcast(masked))
    vote = lambda c: F.aggregate(F.filter("clauses", lambda k: k["class"] == c), F.lit(0), lambda acc, k: acc + F.when(clause_output(F.col("x"), k["p_mask"], k["n_mask"]), k["polarity"]).otherwise(0))
    return packed.select(id_col, F.array(*(vote(c) for c in range(n_class))).alias("votes")).withColumn("pred", first_largest(F.col("votes")))

