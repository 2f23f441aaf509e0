"""Best-two-fit packing of tokenised documents into sequences.

Only lengths decide a packing, and there are at most ``capacity`` of them, so the plan is made from a histogram of
lengths, whose size does not grow with the data: a bin is filled greedily, its smallest document is replaced by two
that fit the gap more tightly, and the pattern so found is used as often as its lengths last. The pieces then take the
places planned for their length by their rank within it. Ranks come from counts by (length, salt), so a length that
very many documents share is spread over many tasks.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .encode import encoder
from .scratch import Scratch

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
CAPACITY = 1024


def _largest(left: np.ndarray, upto: int) -> int:
    """The largest length up to a bound of which one is left, or 0."""
    found = np.flatnonzero(left[1 : upto + 1])
    return int(found[-1]) + 1 if len(found) else 0


def _best_two(left: np.ndarray, gap: int, least: int) -> tuple[int, int] | None:
    """Two lengths that are left, together at most gap and more than least, as large as possible; the larger first."""
    lengths = np.flatnonzero(left[: gap + 1])
    lengths = lengths[lengths > 0]
    best, pair, j = least, None, len(lengths) - 1
    for i, a in enumerate(lengths):
        while j >= i and a + lengths[j] > gap:
            j -= 1
        if j < i:
            break
        b = lengths[j] if j > i or left[a] > 1 else (lengths[j - 1] if j - 1 > i else 0)
        if b and a + b > best:
            best, pair = int(a + b), (int(b), int(a))
    return pair


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Patterns (lengths in a sequence) and how many sequences have each; together they use exactly the counts."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        if not 1 <= length <= capacity:
            raise ValueError(f"length {length} is not between 1 and {capacity}")
        left[length] += n
    patterns: list[tuple[list[int], int]] = []
    while left.any():
        unused, room, pattern = left.copy(), capacity, []
        while length := _largest(unused, room):
            pattern.append(length)
            unused[length] -= 1
            room -= length
        if room and len(pattern) > 1:
            smallest = pattern[-1]
            if pair := _best_two(unused, room + smallest, smallest):
                pattern[-1:] = pair
        need = Counter(pattern)
        times = min(int(left[length]) // n for length, n in need.items())
        for length, n in need.items():
            left[length] -= times * n
        patterns.append((pattern, times))
    return patterns


def places(patterns: list[tuple[list[int], int]]) -> tuple[np.ndarray, ...]:
    """For ranks within a length, as parallel arrays in order: (length << 40 | first rank), first sequence, documents of that length in a sequence, offset of the first of them."""
    used: Counter = Counter()
    rows, sequence = [], 0
    for pattern, times in patterns:
        offset = 0
        for length, n in Counter(pattern).items():
            rows.append((length << 40 | used[length], sequence, n, offset))
            used[length] += n * times
            offset += length * n
        sequence += times
    return tuple(np.array(x, np.int64) for x in (zip(*sorted(rows)) if rows else [[]] * 4))


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """Token pieces of every document: id, piece, start, length, ids_crc32. Null texts have only the end id; of a document longer than capacity all pieces but the first are full."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, last = encoder(tokenizer), end_id.to_bytes(4, "little")
        for batch in batches:
            doc, piece, start, length, crc = [], [], [], [], []
            for at, ids in enumerate(known.encode(batch.column(1).to_pylist())):
                ids += last
                n = len(ids) // 4
                stops = range((n - 1) % capacity + 1, n + 1, capacity)
                for number, stop in enumerate(stops):
                    begin = max(0, stop - capacity) if number else 0
                    doc.append(at)
                    piece.append(number)
                    start.append(begin)
                    length.append(stop - begin)
                    crc.append(zlib.crc32(ids[4 * begin : 4 * stop]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], ["id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(cut, f"id {kind}, piece int, start long, length long, ids_crc32 long")


def pack(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """Every piece with the sequence that holds it and its offset there.

    Null and empty texts are packed as their end id. Rows with equal ids are packed each. An empty table gives an empty
    result. Other columns are not read.
    """
    scratch = Scratch(spark, "packing")
    cut = scratch.save(pieces(docs, id_col, text_col, tokenizer, end_id, capacity), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # a row for each length up to capacity
    table = spark.sparkContext.broadcast(places(plan(histogram, capacity)))

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(2 * n)).cast("int"))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "salt").orderBy("id", "piece", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(within) - 1).join(base, ["length", "salt"])
    ranked = ranked.select("id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("rank")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, per, offset = table.value
        for batch in batches:
            length, rank = (batch.column(x).to_numpy() for x in ("length", "rank"))
            at = np.searchsorted(key, length << 40 | rank, "right") - 1
            nth = rank - (key[at] & ((1 << 40) - 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(first[at] + nth // per[at]), pa.array(offset[at] + nth % per[at] * length)], [*batch.schema.names[:-1], "sequence_id", "offset"])

    kind = docs.schema[id_col].dataType.simpleString()
    packed = ranked.mapInArrow(place, f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return packed.withColumnRenamed("id", id_col)
