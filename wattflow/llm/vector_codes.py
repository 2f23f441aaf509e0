"""Codes of vectors by parts: a codebook for each part position, learned on all vectors by exact integer rounds.

A search is exponion: it starts at the entry that the part had before. A nearer entry, or an equally near one, lies at
most twice the distance to the start away from the start, so only the start's neighbours inside that radius are looked
at, in order of their distance to it. All distances are squared and whole, ties go to the lower index.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
#: Sums by label are broadcast up to this number of labels, else joined by salted labels.
BROADCAST_LABELS = 100_000
LABEL_SALTS = 32


class Codebooks:
    """The entries of all part positions (parts x entries x width) with each entry's neighbours in order of distance."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.apart = ((entries[:, :, None, :] - entries[:, None, :, :]) ** 2).sum(-1)
        self.near = np.argsort(self.apart, axis=2, kind="stable")

    def search(self, part: int, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each row of x and the squared distance, from an entry to start at."""
        entries, apart, near = self.entries[part], self.apart[part], self.near[part]
        best, least = start.astype(np.int64), ((x - entries[start]) ** 2).sum(1)
        radius, rows = 4 * least, np.arange(len(x))
        for step in range(len(entries)):
            other = near[start[rows], step]
            inside = apart[start[rows], other] <= radius[rows]
            rows, other = rows[inside], other[inside]
            if not len(rows):
                break
            far = ((x[rows] - entries[other]) ** 2).sum(1)
            better = (far < least[rows]) | ((far == least[rows]) & (other < best[rows]))
            best[rows[better]], least[rows[better]] = other[better], far[better]
        return best, least

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def moved(self, sums: np.ndarray, counts: np.ndarray) -> Codebooks:
        """Each entry at the floor of its parts' mean; entries without parts stay."""
        used = counts > 0
        entries = self.entries.copy()
        entries[used] = sums[used] // counts[used][:, None]
        return Codebooks(entries)


def _flat(column: pa.Array, kind) -> np.ndarray:
    """The values of a column of equally long binaries."""
    return np.frombuffer(b"".join(column.to_pylist()), kind)


STATE = "id {id}, label {label}, v binary, codes binary, sums array<long>"


def _assigned(state: DataFrame, books: Codebooks, schema: str) -> DataFrame:
    """The rows of state with new codes, and a row for each task with the sums and counts of its parts by entry."""
    parts, entries, width = books.entries.shape

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, names = np.zeros((parts, entries, width + 1), np.int64), None
        for batch in batches:
            n, names = batch.num_rows, batch.schema
            v, old = _flat(batch.column(2), np.int32).reshape(n, parts, width).astype(np.int64), _flat(batch.column(3), np.uint8).reshape(n, parts)
            codes = np.empty((n, parts), np.uint8)
            for p in range(parts):
                codes[:, p], _ = books.search(p, v[:, p], old[:, p])
                order = np.argsort(codes[:, p], kind="stable")
                own, begins = np.unique(codes[order, p], return_index=True)
                if len(own):
                    total[p, own, :width] += np.add.reduceat(v[order, p], begins, axis=0)
                    total[p, own, width] += np.diff(np.append(begins, n))
            packed = pa.array([row.tobytes() for row in codes], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), packed, pa.nulls(n, pa.list_(pa.int64()))], ["id", "label", "v", "codes", "sums"])
        if names is not None:
            own = [pa.nulls(1, names.field(i).type) for i in range(4)]
            yield pa.RecordBatch.from_arrays([*own, pa.array([total.ravel()], pa.list_(pa.int64()))], ["id", "label", "v", "codes", "sums"])

    return state.mapInArrow(assign, schema)


def _coded(state: DataFrame, books: Codebooks, kinds: dict[str, str]) -> DataFrame:
    """id, label, code and error of the rows of state."""
    parts, _, width = books.entries.shape

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            v, old = _flat(batch.column(2), np.int32).reshape(n, parts, width).astype(np.int64), _flat(batch.column(3), np.uint8).reshape(n, parts)
            codes, error = np.empty((n, parts), np.uint8), np.zeros(n, np.int64)
            for p in range(parts):
                codes[:, p], far = books.search(p, v[:, p], old[:, p])
                error += far
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([row.tobytes().hex() for row in codes], pa.string()), pa.array(error)], ["id", "label", "code", "error"])

    return state.mapInArrow(code, "id {id}, label {label}, code string, error long".format(**kinds))


def with_label_error(coded: DataFrame, labels: DataFrame) -> DataFrame:
    """coded with label_error of its label (null is a label), from labels (label, label_error), a row for each label.

    Few labels are broadcast. Else they are joined by (label, salt), so that a common label is dealt over LABEL_SALTS tasks.
    """
    if labels.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS:
        other = F.broadcast(labels.withColumnRenamed("label", "_label"))
        return coded.join(other, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
    other = labels.select(F.col("label").alias("_label"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(LABEL_SALTS - 1))).alias("_salt"))
    salted = coded.withColumn("salt", F.pmod(F.xxhash64("id", "code"), F.lit(LABEL_SALTS)).cast("int"))
    return salted.join(other.hint("merge"), F.col("label").eqNullSafe(F.col("_label")) & (F.col("salt") == F.col("_salt"))).drop("_label", "_salt", "salt")


def vector_codes(spark: SparkSession, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """id, label, code, error, label_error and codebooks_sha256 of each vector.

    A component x becomes floor(scale * x), a vector parts equal pieces. The codebooks begin as the pieces of the vectors
    with the least ids (rows without an id last, rows of one id in order of their components; fewer vectors give fewer
    entries) and move in so many rounds over all vectors. Rows whose vector is null, or holds a component that is null or
    not finite, are left out; rows that repeat count each. An empty table gives no rows. Vectors of unequal length, of a
    length that parts do not divide, or with components too large for exact 64-bit distances are an error. Other columns
    are not read. A round reads and writes the rows once; tasks hand over sums of the size of the codebooks.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code is a byte: 1 to 256 entries")
    scratch, x = Scratch(spark, "codes"), F.col(vector_col)
    number = lambda c: c.cast("double")
    bad = lambda c: c.isNull() | F.isnan(number(c)) | (F.abs(number(c)) == F.lit(float("inf")))
    kept = vectors.where(x.isNotNull()).where(~F.exists(x, bad)).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.transform(x, lambda c: number(c) * F.lit(float(scale))).alias("x"))
    kinds = {name: kind for name, kind in kept.dtypes if name != "x"}
    result = ["id", "label", "code", "error", "label_error", "codebooks_sha256"]
    largest = F.aggregate("x", F.lit(0.0), lambda a, c: F.greatest(a, F.abs(c)))
    shortest, longest, most = kept.agg(F.min(F.size("x")), F.max(F.size("x")), F.max(largest)).first()
    if longest is None:
        return spark.createDataFrame([], "id {id}, label {label}, code string, error long, label_error long, codebooks_sha256 string".format(**kinds)).toDF(*result)
    if shortest != longest or longest % parts:
        raise ValueError(f"vectors have {shortest} to {longest} components, but all must have one number of them that {parts} divides")
    width = longest // parts
    if longest * (2 * (most + 1)) ** 2 >= 2**61:
        raise ValueError(f"components up to {most / scale} are too large for exact distances")

    whole = kept.withColumn("x", F.transform("x", lambda c: F.floor(c).cast("int")))
    seeds = whole.orderBy(F.col("id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    books = Codebooks(np.array([r["x"] for r in seeds], np.int64).reshape(len(seeds), parts, width).transpose(1, 0, 2))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            v = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int32).reshape(n, parts * width)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([row.tobytes() for row in v], pa.binary()), pa.array([bytes(parts)] * n, pa.binary()), pa.nulls(n, pa.list_(pa.int64()))], ["id", "label", "v", "codes", "sums"])

    schema = STATE.format(**kinds)
    state = whole.mapInArrow(packed, schema)
    for r in range(rounds):
        both = scratch.save(_assigned(state, books, schema), f"round-{r}")
        state = both.where("sums is null")
        total = np.zeros(books.entries.shape[0] * books.entries.shape[1] * (width + 1), np.int64)
        for row in both.where("sums is not null").select(F.posexplode("sums").alias("pos", "n")).groupBy("pos").agg(F.sum("n").alias("n")).collect():
            total[row["pos"]] = row["n"]  # as many rows as the codebooks have numbers
        total = total.reshape(*books.entries.shape[:2], width + 1)
        books = books.moved(total[..., :width], total[..., width])
        if r:
            scratch.drop(f"round-{r - 1}")
    coded = scratch.save(_coded(state, books, kinds), "coded")
    if rounds:
        scratch.drop(f"round-{rounds - 1}")
    labels = scratch.save(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "labels")
    return with_label_error(coded, labels).withColumn("codebooks_sha256", F.lit(books.digest())).select(*result)
