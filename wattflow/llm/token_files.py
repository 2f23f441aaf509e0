"""A concatenated token-id array in files, with Elias-Fano document boundaries.

Documents are dealt out by ranges of their id, so that the files in order hold all documents in ascending order. Each
task writes shards: ``.ids`` has the ids one after the other, ``.efb`` the Elias-Fano coded document ids and ends.
Names are unique to an attempt and only those in the manifest count, so a lost executor's shards are simply left out.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .elias_fano import EliasFano
from .encode import encoder
from .files import opened, unique
from .scratch import Scratch

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
#: A shard is closed after so many ids.
SHARD_TOKENS = 64_000_000
#: Or after so many documents, which bounds what a task holds of their ids and ends until it codes them.
SHARD_DOCS = 4_000_000
#: Documents that are read at once.
LOT_DOCS = 4096
MANIFEST = "part int, shard int, n_docs long, n_tokens long, ids string, efb string"
HEAD = "<QqB"  # rows without a document id, smallest document id, bytes of an id


class _Shard:
    """One shard while it is written."""

    def __init__(self, folder: str, part: int, number: int, width: int):
        self.system, path = opened(folder)
        self.part, self.number, self.width = part, number, width
        self.ids_name, self.efb_name = (f"{path}/{unique(f'part-{part:06d}-{number:04d}', x)}" for x in (".ids", ".efb"))
        self.out = self.system.open_output_stream(self.ids_name)
        self.nulls, self.docs, self.ends = 0, array("q"), array("q")

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        self.out.write(ids.astype("<u2" if self.width == 2 else "<u4").tobytes())
        if doc is None:
            self.nulls += 1
        else:
            self.docs.append(doc)
        self.ends.append((self.ends[-1] if self.ends else 0) + len(ids))

    def close(self) -> tuple:
        self.out.close()
        known = np.frombuffer(self.docs, np.int64)
        least = int(known[0]) if len(known) else 0
        with self.system.open_output_stream(self.efb_name) as f:
            f.write(struct.pack(HEAD, self.nulls, least, self.width))
            f.write(EliasFano.encode((known - least).astype(np.uint64)).to_bytes())
            f.write(EliasFano.encode(np.frombuffer(self.ends, np.int64).astype(np.uint64)).to_bytes())
        return self.part, self.number, len(self.ends), self.ends[-1] if self.ends else 0, self.ids_name, self.efb_name


def write_token_files(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write the ids of every whole text, each followed by end_id, and return the manifest (lazily: save it once).

    Null texts are empty and have only the end id. Null ids come first. Rows with equal ids stay beside each other.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(tokenizer)
        width = 2 if max(known.tokenizer.get_vocab_size(), end_id) < 1 << 16 else 4
        part, number, shard, done = TaskContext.get().partitionId(), 0, None, []
        last = np.array([end_id], np.uint32)
        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), known.encode(batch.column(1).to_pylist()), strict=True):
                if shard is None:
                    shard, number = _Shard(folder, part, number, width), number + 1
                shard.add(doc, np.concatenate([np.frombuffer(ids, np.uint32), last]))
                if shard.ends[-1] >= shard_tokens or len(shard.ends) >= SHARD_DOCS:
                    done.append(shard.close())
                    shard = None
        if shard is not None:
            done.append(shard.close())
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(list(zip(*done)) or [[]] * 6, [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string()], strict=True)], ["part", "shard", "n_docs", "n_tokens", "ids", "efb"])

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).repartitionByRange(n, "doc").sortWithinPartitions("doc")
    return dealt.mapInArrow(write, MANIFEST)


def documents_of(boundaries: bytes) -> tuple[int, Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]]:
    """Bytes of an id in a shard, and its documents by lots: ids, and the ends before and after each, by select on the coded boundaries."""
    nulls, least, width = struct.unpack_from(HEAD, boundaries)
    ids, at = EliasFano.from_bytes(boundaries, struct.calcsize(HEAD))
    ends, _ = EliasFano.from_bytes(boundaries, at)

    def lots() -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
        for a in range(0, ends.n, LOT_DOCS):
            b = min(ends.n, a + LOT_DOCS)
            stops = ends.between(a, b).astype(np.int64)
            before = np.array([ends.select(a - 1) if a else 0], np.int64)
            known = ids.between(max(0, a - nulls), max(0, b - nulls)).astype(np.int64) + least
            yield [None] * (b - a - len(known)) + known.tolist(), np.concatenate([before, stops[:-1]]), stops

    return width, lots()


def read_token_files(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """From the files: id, start (ids of all documents before it), n_tokens, ids_crc32 of the ids as unsigned 32-bit numbers, ids.

    Each shard is read by one task, document by document. Of its boundaries the task holds the coded bytes and the
    offsets of one lot of documents.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, _ = opened(row["efb"].rpartition("/")[0])
                with system.open_input_stream(row["efb"]) as f:
                    width, lots = documents_of(f.read())
                with system.open_input_stream(row["ids"], buffer_size=1 << 20) as f:
                    for names, starts, stops in lots:
                        crcs = []
                        for n in (stops - starts).tolist():
                            part = np.frombuffer(f.read(n * width), "<u2" if width == 2 else "<u4")
                            if len(part) != n:
                                raise ValueError(f"{row['ids']} is cut short")
                            crcs.append(zlib.crc32(part.astype("<u4").tobytes()))
                        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(starts + row["base"]), pa.array(stops - starts), pa.array(crcs, pa.int64())], ["doc", "start", "n_tokens", "ids_crc32"])

    order = Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard
    based = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)).cast("long"))
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return based.repartition(n, "part", "shard").mapInArrow(read, "doc long, start long, n_tokens long, ids_crc32 long").withColumnRenamed("doc", id_col)


def token_files(spark: SparkSession, docs: DataFrame, **how) -> DataFrame:
    """Write the files into the shared folder and read every document back from them."""
    scratch = Scratch(spark, "token-files")
    manifest = scratch.save(write_token_files(docs, f"{scratch.path}/files", **how), "manifest")
    return read_token_files(manifest, how.get("id_col", "doc_id"))
