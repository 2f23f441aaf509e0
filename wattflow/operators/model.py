"""Clause-voting models as tables: automaton states (training form) and included literals (inference form)."""

from __future__ import annotations

from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import mask_of

FORMS = ("training", "inference")
#: A model is sent to every task; this bounds its automata (64 MB as numbers of 8 bytes).
MOST_AUTOMATA = 8_000_000
STATES = "class int, clause int, polarity int, state array<int>"
CLAUSES = "class int, clause int, polarity int, n_pos int, n_neg int, position array<int>"


@dataclass(frozen=True)
class Meta:
    """Sizes of a model: n_clause clauses a class, positive and negative in turn; states from 1 to n_state."""

    n_class: int
    n_feature: int
    n_clause: int
    n_state: int

    def __post_init__(self):
        if min(self.n_class, self.n_feature, self.n_clause, self.n_state) < 1:
            raise ValueError("sizes must be positive")
        if self.n_clause % 2 or self.n_state % 2:
            raise ValueError("n_clause and n_state must be even")
        if 2 * self.n_class * self.n_clause * self.n_feature > MOST_AUTOMATA:
            raise ValueError(f"a model has {MOST_AUTOMATA} automata at most")


def init_states(spark: SparkSession, meta: Meta, seed: int = 0) -> DataFrame:
    """Random initial states: of each feature one literal starts just inside the middle and the other just outside.

    The choice is a hash of seed, clause and feature, so it does not depend on partitions.
    """
    middle, n = meta.n_state // 2, meta.n_feature
    bit = lambda i: F.pmod(F.xxhash64(F.lit(seed), F.col("id"), i), F.lit(2)).cast("int")
    features = F.sequence(F.lit(0), F.lit(n - 1))
    state = F.concat(F.transform(features, lambda i: middle + bit(i)), F.transform(features, lambda i: middle + 1 - bit(i)))
    rows = spark.range(meta.n_class * meta.n_clause)
    clause = F.pmod(F.col("id"), F.lit(meta.n_clause))
    return rows.select(F.floor(F.col("id") / meta.n_clause).cast("int").alias("class"), clause.cast("int").alias("clause"), F.when(clause % 2 == 0, 1).otherwise(-1).alias("polarity"), state.alias("state"))


def included(states: DataFrame, meta: Meta) -> DataFrame:
    """The inference form: positions of literals whose state is above the middle, positive ones first."""
    middle, n = meta.n_state // 2, meta.n_feature
    literals = F.filter(F.transform("state", lambda s, i: F.when(s > middle, i)), lambda i: i.isNotNull())
    positive, negative = F.filter(literals, lambda i: i < n), F.transform(F.filter(literals, lambda i: i >= n), lambda i: i - n)
    return states.select("class", "clause", "polarity", F.size(positive).alias("n_pos"), F.size(negative).alias("n_neg"), F.concat(positive, negative).cast("array<int>").alias("position"))


def from_included(clauses: DataFrame, meta: Meta) -> DataFrame:
    """States again: every listed literal just above the middle, every other one at it."""
    middle = meta.n_state // 2
    pos, neg = F.slice("position", F.lit(1), F.col("n_pos")), F.slice("position", F.col("n_pos") + 1, F.col("n_neg"))
    side = lambda own: F.transform(F.sequence(F.lit(0), F.lit(meta.n_feature - 1)), lambda i: middle + F.array_contains(own, i).cast("int"))
    return clauses.select("class", "clause", "polarity", F.concat(side(pos), side(neg)).alias("state"))


def with_masks(clauses: DataFrame, n_feature: int) -> DataFrame:
    """Inference form with p_mask and n_mask, words that agree with packed bits."""
    pos, neg = F.slice("position", F.lit(1), F.col("n_pos")), F.slice("position", F.col("n_pos") + 1, F.col("n_neg"))
    return clauses.withColumns({"p_mask": mask_of(pos, n_feature), "n_mask": mask_of(neg, n_feature)})


def save_model(states: DataFrame, meta: Meta, path: str, form: str = "training") -> None:
    """Write the states, or only the included literals, and the sizes."""
    if form not in FORMS:
        raise ValueError(f"form must be one of {FORMS}")
    table = states if form == "training" else included(states, meta)
    table.write.mode("overwrite").parquet(f"{path}/clauses")
    sizes = asdict(meta) | {"form": form}
    states.sparkSession.createDataFrame([tuple(sizes.values())], "n_class int, n_feature int, n_clause int, n_state int, form string").write.mode("overwrite").parquet(f"{path}/meta")


def load_model(spark: SparkSession, path: str) -> tuple[DataFrame, Meta]:
    """States and sizes of a saved model of either form."""
    row = spark.read.parquet(f"{path}/meta").first()
    meta = Meta(row["n_class"], row["n_feature"], row["n_clause"], row["n_state"])
    table = spark.read.parquet(f"{path}/clauses")
    return (table if row["form"] == "training" else from_included(table, meta)), meta


def model_footprint(clauses: DataFrame) -> DataFrame:
    """Bytes that the inference form takes on a device: a head of 52, 12 a clause and 2 a literal."""
    return clauses.agg((52 + 12 * F.count("*") + 2 * F.coalesce(F.sum(F.size("position")), F.lit(0))).cast("long").alias("n_bytes"), F.count("*").alias("n_clauses"))


def training_footprint(states: DataFrame) -> DataFrame:
    """Bytes that the training form takes on a device: a head of 52, 8 a clause and 4 a state."""
    return states.agg((52 + 8 * F.count("*") + 4 * F.coalesce(F.sum(F.size("state")), F.lit(0))).cast("long").alias("n_bytes"), F.count("*").alias("n_clauses"))


def to_arrays(clauses: DataFrame, n_feature: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """class, polarity and the included positive and negated literals (clauses x features) of a model; a model of more than MOST_AUTOMATA automata is an error."""
    n = clauses.count()
    if 2 * n * n_feature > MOST_AUTOMATA:
        raise ValueError(f"{n} clauses of {n_feature} features are more than {MOST_AUTOMATA} automata")
    rows = clauses.orderBy("class", "clause").select("class", "polarity", "n_pos", "position").collect()
    p, n = np.zeros((len(rows), n_feature), np.float32), np.zeros((len(rows), n_feature), np.float32)
    for i, row in enumerate(rows):
        p[i, row["position"][: row["n_pos"]]] = 1
        n[i, row["position"][row["n_pos"] :]] = 1
    return np.array([r["class"] for r in rows]), np.array([r["polarity"] for r in rows]), p, n
