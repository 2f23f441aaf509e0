"""Training clause-voting models: many exactly, each in its group, or one on all data in batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .features import train_test_split
from .model import Meta, init_states

STATE_ROWS = "class int, clause int, polarity int, state array<int>"


@dataclass(frozen=True)
class Params:
    """What training needs besides sizes: target T, specificity s, epochs, seed."""

    n_clause: int = 100
    n_state: int = 10
    target: int = 30
    specificity: float = 6.0
    epochs: int = 10
    seed: int = 0


def feedback(states: np.ndarray, literals: np.ndarray, label: int, params: Params, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """Changes of the states (class, clause, literal) that one sample calls for, and the other class it was held against.

    The target class is pushed towards T votes and one other class, drawn evenly, towards -T. Type I feedback makes a
    clause that should hold more like the sample, or forgets; type II makes one that should not hold exclude it.
    """
    n_class = states.shape[0]
    middle, top, s = params.n_state // 2, params.n_state, params.specificity
    other = int(rng.integers(n_class - 1))
    other += other >= label
    positive = np.arange(states.shape[1]) % 2 == 0
    change = np.zeros_like(states[:1], shape=(2, *states.shape[1:]))
    for row, (cls, sign) in enumerate(((label, 1), (other, -1))):
        own = states[cls]
        inside = own > middle
        holds = ~(inside & ~literals).any(1)
        votes = np.clip(holds[positive].sum() - holds[~positive].sum(), -params.target, params.target)
        drawn = rng.random(len(own)) < (params.target - sign * votes) / (2 * params.target)
        first = drawn & (positive if sign > 0 else ~positive)
        second = drawn & ~first & holds
        forget, learn = rng.random(own.shape) < 1 / s, rng.random(own.shape) < (s - 1) / s
        up = first[:, None] & holds[:, None] & literals & learn & (own < top)
        down = first[:, None] & ~(holds[:, None] & literals) & forget & (own > 1)
        change[row] = up.astype(change.dtype) - down + (second[:, None] & ~literals & ~inside)
    return change, other


def train_samples(bits: np.ndarray, labels: np.ndarray, states: np.ndarray, params: Params) -> np.ndarray:
    """States after learning sample by sample, in a new order each epoch."""
    if states.shape[0] < 2:
        raise ValueError("training needs two classes at least")
    rng, states = np.random.default_rng(params.seed), states.copy()
    literals = np.concatenate([bits, 1 - bits], axis=1).astype(bool)
    for _ in range(params.epochs):
        for i in rng.permutation(len(labels)):
            change, other = feedback(states, literals[i], int(labels[i]), params, rng)
            states[labels[i]] += change[0]
            states[other] += change[1]
            np.clip(states, 1, params.n_state, out=states)
    return states


def _first_states(n_class: int, n_feature: int, params: Params) -> np.ndarray:
    bit = np.random.default_rng(params.seed + 1).integers(0, 2, (n_class, params.n_clause, n_feature))
    middle = params.n_state // 2
    return np.concatenate([middle + bit, middle + 1 - bit], axis=2).astype(np.int32)


def train_grouped(df: DataFrame, keys: Sequence[str], n_class: int, params: Params) -> DataFrame:
    """A model for each group of keys, learned exactly from its rows (bits, label): keys and the rows of its states.

    A group is one task: this is for many models of moderate data. Rows are put in order first, so that the result does
    not depend on partitions. For one model on all data there is train_batched.
    """
    Meta(n_class, 1, params.n_clause, params.n_state)

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(zip(pdf["label"], (tuple(b) for b in pdf["bits"]), strict=True))
        bits = np.array([b for _, b in rows], np.int8)
        states = train_samples(bits, np.array([y for y, _ in rows]), _first_states(n_class, bits.shape[1], params), params)
        head = [pdf[k].iloc[0] for k in keys]
        out = [(*head, c, j, 1 - 2 * (j % 2), states[c, j].tolist()) for c in range(n_class) for j in range(params.n_clause)]
        return pd.DataFrame(out, columns=[*keys, "class", "clause", "polarity", "state"])

    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), STATE_ROWS])
    return df.where("bits is not null and label is not null").select(*keys, "bits", "label").groupBy(*keys).applyInPandas(learn, schema)


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 bits spread over all (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def keyed(key: np.ndarray, number: np.ndarray) -> np.ndarray:
    """A new key for each number of a key; both are of any shapes that go together."""
    return _mixed(key + (np.atleast_1d(number).astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def uniform(key: np.ndarray) -> np.ndarray:
    """The draw of a key, from 0 to 1."""
    return (key >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def literal_draws(key: np.ndarray, n: int) -> np.ndarray:
    """n draws of 16 bits for each key, four of each number of the key."""
    return keyed(key[:, None], np.arange(-(-n // 4))).astype("<u8").view("<u2")[:, :n]


def _in_order(rows: np.ndarray, clauses: np.ndarray, cls: np.ndarray, n_clause: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of a row and a clause put in order of the clause's place among all, and that place."""
    at = cls[rows] * n_clause + clauses
    order = np.argsort(at, kind="stable")
    return rows[order], clauses[order], at[order]


def _summed(total: np.ndarray, at: np.ndarray, changes: np.ndarray) -> None:
    """Add each row of changes to the row of total that at, which ascends, names."""
    if len(at):
        begins = np.flatnonzero(np.diff(at, prepend=-1))
        total[at[begins]] += np.add.reduceat(changes, begins, axis=0, dtype=np.int32)


def batch_feedback(states: np.ndarray, bits: np.ndarray, labels: np.ndarray, ids: np.ndarray, epoch: int, params: Params) -> np.ndarray:
    """The sum of the changes (class, clause, literal) that a batch of samples calls for, all judged by the same states.

    The rule is that of feedback, on matrices: rows by clauses for votes and draws, and the drawn pairs of a row and a
    clause by literals for changes. Draws are numbered: the key of seed, epoch and id gives the other class by number 0,
    a clause of the target class (row 0) or the other one (row 1) by number 1 + row * clauses + clause, and that key's
    numbers give the literals' draws, by which 1 / s and (s - 1) / s are rounded to 16 bits.
    """
    n_class, n_clause, n_literal = states.shape
    middle, top, s = params.n_state // 2, params.n_state, params.specificity
    flat, total = states.reshape(-1, n_literal), np.zeros((n_class * n_clause, n_literal), np.int64)
    may_rise, may_fall, outside = flat < top, flat > 1, flat <= middle
    learn, forget = (round((1 << 16) * x) for x in ((s - 1) / s, 1 / s))
    literals = np.concatenate([bits, 1 - bits], axis=1).astype(bool)
    key = keyed(keyed(keyed(np.zeros(len(ids), np.uint64), np.uint64(params.seed)), np.uint64(epoch)), ids.astype(np.int64).view(np.uint64))
    other = (uniform(keyed(key, 0)) * (n_class - 1)).astype(np.int64)
    other += other >= labels
    holds = ((~literals).astype(np.float32) @ (~outside).astype(np.float32).T == 0).reshape(-1, n_class, n_clause)
    positive, rows = np.arange(n_clause) % 2 == 0, np.arange(len(ids))
    votes = np.clip(holds @ np.where(positive, 1, -1), -params.target, params.target)
    for row, (cls, sign) in enumerate(((labels.astype(np.int64), 1), (other, -1))):
        own, clause_key = holds[rows, cls], keyed(key[:, None], 1 + row * n_clause + np.arange(n_clause))
        drawn = uniform(clause_key) < ((params.target - sign * votes[rows, cls]) / (2 * params.target))[:, None]
        first = drawn & (positive if sign > 0 else ~positive)
        i, j, at = _in_order(*np.nonzero(first), cls, n_clause)
        like, draws = own[i, j][:, None] & literals[i], literal_draws(clause_key[i, j], n_literal)
        up, down = like & (draws < learn) & may_rise[at], ~like & (draws < forget) & may_fall[at]
        _summed(total, at, up.view(np.int8) - down.view(np.int8))
        i, j, at = _in_order(*np.nonzero(drawn & ~first & own), cls, n_clause)
        _summed(total, at, (~literals[i] & outside[at]).view(np.int8))
    return total.reshape(states.shape)


#: Numbers that a batch of samples holds in memory at once, by literals drawn.
MOST_DRAWS = 4_000_000


def train_batched(df: DataFrame, id_col: str, meta: Meta, params: Params, batches: int = 4, step: int = 1) -> DataFrame:
    """States of one model learned from all rows (id, bits, label) in synchronous batches.

    In a batch every row votes with the same states; changes are summed by automaton, and each automaton moves by the
    sum's sign times step at most. Draws depend on seed, epoch and id alone, so partitions do not matter. A batch sends
    the states (of bounded size) to the tasks, which work on matrices of rows, and shuffles as many sums as there are
    automata a task. Rows without an id, bits or a label are left out.
    """
    if meta.n_class < 2:
        raise ValueError("training needs two classes at least")
    spark = df.sparkSession
    kept = df.select(F.col(id_col).cast("long").alias("id"), F.col("bits").cast("array<tinyint>").alias("bits"), F.col("label").cast("int").alias("label"))
    rows = kept.where("id is not null and bits is not null and label is not null").persist(StorageLevel.DISK_ONLY)
    found = init_states(spark, meta, params.seed).orderBy("class", "clause").collect()
    states = np.array([r["state"] for r in found], np.int32).reshape(meta.n_class, meta.n_clause, -1)
    names = ["class", "clause", "literal", "change"]
    lot = max(1, MOST_DRAWS // (2 * meta.n_clause * meta.n_feature * 2))
    try:
        for epoch in range(params.epochs):
            for batch in range(batches):
                sent = spark.sparkContext.broadcast(states)

                def learn(parts: Iterator[pa.RecordBatch], sent=sent, epoch=epoch) -> Iterator[pa.RecordBatch]:
                    total = np.zeros(sent.value.shape, np.int64)
                    for part in parts:
                        bits = part.column(1).flatten().to_numpy().reshape(part.num_rows, -1)
                        ids, labels = part.column(0).to_numpy(), part.column(2).to_numpy()
                        for at in range(0, part.num_rows, lot):
                            total += batch_feedback(sent.value, bits[at : at + lot], labels[at : at + lot], ids[at : at + lot], epoch, params)
                    at = np.nonzero(total)
                    yield pa.RecordBatch.from_arrays([*(pa.array(x.astype(np.int32)) for x in at), pa.array(total[at])], names)

                chosen = rows.where(F.pmod(F.xxhash64("id", F.lit(epoch)), F.lit(batches)) == batch)
                sums = chosen.mapInArrow(learn, "class int, clause int, literal int, change long").groupBy(*names[:3]).agg(F.sum("change").alias("change")).toPandas()
                states = states.copy()
                states[sums["class"], sums["clause"], sums["literal"]] += np.clip(sums["change"].to_numpy(), -step, step).astype(np.int32)
                np.clip(states, 1, meta.n_state, out=states)
                sent.unpersist()
    finally:
        rows.unpersist()
    out = [(c, j, 1 - 2 * (j % 2), states[c, j].tolist()) for c in range(meta.n_class) for j in range(meta.n_clause)]
    return spark.createDataFrame(out, STATE_ROWS)


def votes_of(states: np.ndarray, bits: np.ndarray, n_state: int) -> np.ndarray:
    """Votes (rows x classes) by states (class, clause, literal)."""
    n_class, n_clause, n_literal = states.shape
    literals = np.concatenate([bits, 1 - bits], axis=1)
    holds = (1 - literals).astype(np.float32) @ (states.reshape(-1, n_literal) > n_state // 2).astype(np.float32).T == 0
    return holds.reshape(-1, n_class, n_clause) @ np.where(np.arange(n_clause) % 2 == 0, 1, -1)


def train_grid(df: DataFrame, keys: Sequence[str], id_col: str, n_class: int, grid: Sequence[Params], test_size: float = 0.2, seed: int = 0) -> DataFrame:
    """Models for each group of keys and each setting of a grid: keys, setting, n_train, n_test, accuracy, best and the rows of states.

    Rows (id, bits, label) of a group are packed once, an array of bytes a row, and go to as many tasks as the grid has
    settings, so that tasks grow with groups times settings. A setting learns exactly, sample by sample, from the rows
    that train_test_split gives for training (by hash of seed and id); accuracy is that of the other rows, null if there
    are none. best marks the setting of the largest accuracy, of equal ones the first. As in train_grouped, a group's
    rows have to fit one task. Rows without bits or a label are left out.
    """
    for params in grid:
        Meta(n_class, 1, params.n_clause, params.n_state)
    rows = df.where("bits is not null and label is not null").select(*keys, F.col(id_col).alias("id"), "bits", F.col("label").cast("int").alias("label"))
    rows = train_test_split(rows, "id", test_size, seed, exact=False)
    packed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("is_train", "label", "id", F.col("bits").cast("array<tinyint>").alias("bits")))).alias("rows"))
    tasks = packed.withColumn("setting", F.explode(F.sequence(F.lit(0), F.lit(len(grid) - 1)))).repartition(*keys, "setting")
    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "setting int, n_train int, n_test int, accuracy double", STATE_ROWS])

    def learn(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for task in pdf.to_dict("records"):
                params, own = grid[task["setting"]], task["rows"]
                trains, labels = np.array([r["is_train"] for r in own]), np.array([r["label"] for r in own])
                bits = np.array([r["bits"] for r in own], np.int8)
                states = train_samples(bits[trains], labels[trains], _first_states(n_class, bits.shape[1], params), params)
                right = votes_of(states, bits[~trains], params.n_state).argmax(1) == labels[~trains]
                head = [*(task[k] for k in keys), task["setting"], int(trains.sum()), len(right), float(right.mean()) if len(right) else None]
                yield pd.DataFrame([(*head, c, j, 1 - 2 * (j % 2), states[c, j].tolist()) for c in range(n_class) for j in range(params.n_clause)], columns=[*keys, "setting", "n_train", "n_test", "accuracy", "class", "clause", "polarity", "state"])

    found = tasks.mapInPandas(learn, schema)
    ahead = F.struct(F.coalesce("accuracy", F.lit(-1.0)), -F.col("setting"))
    return found.withColumn("best", ahead == F.max(ahead).over(Window.partitionBy(*keys)))
