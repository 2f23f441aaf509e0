"""Placement of keys on shards by a permutation-filled lookup table.

Each shard has its own order of preference over the slots of a table of prime size: it starts at an offset and goes on
by a skip, both hashes of its name. Shards take turns; at its turn a shard claims the next free slot of its order. All
shards so get the same number of slots within one, and when a shard comes or goes few other slots change hands. The
table has a fixed size, so it is broadcast, and a key's shard is found by one hash and one look-up.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLE_SIZE = 65_537
#: The table is broadcast: this bounds it.
MOST_SLOTS = 5_000_000
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def _number(name: str, use: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{use}:{name}".encode()).digest()[:8], "big")


def lookup_table(shards: tuple[str, ...] | list[str], size: int = TABLE_SIZE) -> np.ndarray:
    """The shard number of each slot. Shards take turns by name, so their order does not matter."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be named, each once")
    if not _is_prime(size) or not len(shards) <= size <= MOST_SLOTS:
        raise ValueError(f"the table size must be a prime from the number of shards to {MOST_SLOTS}")
    turns = sorted(range(len(shards)), key=lambda i: shards[i])
    at = [_number(shards[i], "offset") % size for i in turns]
    skip = [_number(shards[i], "skip") % (size - 1) + 1 if size > 2 else 1 for i in turns]
    table = [-1] * size
    free = size
    while free:
        for turn, shard in enumerate(turns):
            while table[at[turn]] >= 0:
                at[turn] = (at[turn] + skip[turn]) % size
            table[at[turn]] = shard
            free -= 1
            if not free:
                break
    return np.array(table, np.int32)


def place(spark: SparkSession, rows: DataFrame, key_cols: list[str], shards: tuple[str, ...] | list[str] = SHARDS, size: int = TABLE_SIZE) -> DataFrame:
    """All rows and columns of rows with slot, shard_id and shard of their key.

    The key is the text of the key columns, null being told from every text. Equal keys have the same shard. A column
    of rows that is named slot, shard_id or shard is replaced. There is no shuffle: the table is broadcast.
    """
    table = lookup_table(shards, size)
    kept = rows.drop("slot", "shard_id", "shard")
    slots = spark.createDataFrame([(i, int(s), shards[s]) for i, s in enumerate(table)], "slot int, shard_id int, shard string")
    key = F.concat_ws("\x1f", *(F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("-")) for c in key_cols))
    hashed = F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("long")
    return kept.withColumn("slot", F.pmod(hashed, F.lit(size)).cast("int")).join(F.broadcast(slots), "slot")


def moved(before: np.ndarray, after: np.ndarray, kept_shards: set[int]) -> float:
    """The part of the slots of shards that stay which changes hands between two tables."""
    own = np.isin(before, list(kept_shards))
    return float((before[own] != after[own]).mean()) if own.any() else 0.0


def balance(placed: DataFrame, bytes_col: str) -> DataFrame:
    """Rows and bytes of each shard."""
    return placed.groupBy("shard_id", "shard").agg(F.count("*").alias("n_rows"), F.sum(bytes_col).alias("n_bytes"))
