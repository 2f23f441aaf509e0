"""WARC archives: deduplicated records, a normaliser for whole-file gzip, and a sidecar offset index.

A crawler's archive is often one gzip stream over all its records, which can only be read from its beginning. The
normaliser inflates such a stream once, cuts it into records by their headers, writes each as a gzip member of its own
and notes the member's place in a sidecar index, so that later readers go straight to a record.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import opened, unique
from .scratch import Scratch

LEAST_BYTES = 0
#: An archive is closed after so many bytes of records.
ARCHIVE_BYTES = 256_000_000
LEVEL = 1
READ_BYTES = 1 << 20
MANIFEST = "archive string, index string, n_records long, n_bytes long"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: int | None, url: str | None, payload: bytes | None, digest: str, n_bytes: int, refers_to: int | None) -> bytes:
    """A response record with its payload, or with refers_to a revisit record without one."""
    kind = "response" if refers_to is None else "revisit"
    block = b"" if refers_to is not None else payload or b""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Bytes: {n_bytes}"]
    if url is not None:
        head.append("WARC-Target-URI: " + " ".join(url.split()))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Cutter:
    """Cuts a stream of bytes into records."""

    def __init__(self):
        self.data, self.at = bytearray(), 0

    def feed(self, data: bytes) -> Iterator[bytes]:
        self.data += data
        while (end := self.data.find(b"\r\n\r\n", self.at)) >= 0:
            size = _content_length(self.data[self.at : end])
            stop = end + 4 + size + 4
            if len(self.data) < stop:
                break
            yield bytes(self.data[self.at : stop])
            self.at = stop
        del self.data[: self.at]
        self.at = 0


def _content_length(head: bytes) -> int:
    for line in head.split(b"\r\n"):
        name, _, value = line.partition(b":")
        if name.lower() == b"content-length":
            return int(value)
    raise ValueError("a record without Content-Length")


def normalise(source, sink, index) -> tuple[int, int]:
    """Rewrite the gzip stream of a source (one member or several) as a member for each record; the index gets a JSON line with offset, length and record id for each. Returns records and bytes written."""
    cutter, inflate, records, offset = _Cutter(), zlib.decompressobj(31), 0, 0
    while data := source.read(READ_BYTES):
        while data:
            for found in cutter.feed(inflate.decompress(data)):
                squeeze = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                member = squeeze.compress(found) + squeeze.flush()
                sink.write(member)
                head = found[: found.index(b"\r\n\r\n")].decode()
                name = next(x.partition(":")[2].strip() for x in head.split("\r\n") if x.startswith("WARC-Record-ID:"))
                index.write(json.dumps({"offset": offset, "length": len(member), "record": name}).encode() + b"\n")
                offset += len(member)
                records += 1
            data = inflate.unused_data
            if data:
                inflate = zlib.decompressobj(31)
    if cutter.data or not inflate.eof and (records or offset):
        raise ValueError("the archive ends inside a record")
    return records, offset


def parse(found: bytes) -> dict:
    """Page, kind, digest, bytes, refers_to and url of a record; a response's payload is checked against its digest."""
    at = found.index(b"\r\n\r\n")
    head = dict(x.split(": ", 1) for x in found[:at].decode().split("\r\n")[1:])
    payload = found[at + 4 : -4]
    kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and sha1_base32(payload) != digest:
        raise ValueError(f"payload of {head['WARC-Record-ID']} does not have its digest")
    number = lambda x: int(x) if (x := x.removeprefix("<urn:page:").removesuffix(">")) else None
    return {"page": number(head["WARC-Record-ID"]), "url": head.get("WARC-Target-URI"), "payload_bytes": int(head["X-Payload-Bytes"]), "payload_digest": digest, "record_type": kind, "refers_to": number(head["WARC-Refers-To"]) if "WARC-Refers-To" in head else None, "payload": payload if kind == "response" else None}


def plan_records(pages: DataFrame, id_col: str = "page_id", text_col: str = "html", url_col: str = "url", least_bytes: int = LEAST_BYTES) -> DataFrame:
    """page, url, payload, n_bytes, digest, refers_to: of equal payloads of at least least_bytes the smallest page is the response.

    Among rows with equal ids and payloads each is a response if the id is the smallest. The aggregate by digest is
    combined before the shuffle, and only digests that occur twice or more come back to the pages.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).alias("url"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("payload"))
    keyed = rows.withColumn("n_bytes", F.octet_length("payload").cast("long")).withColumn("key", F.unhex(F.sha1("payload")))
    groups = keyed.where(F.col("n_bytes") >= least_bytes).groupBy("key").agg(F.min("page").alias("least"), F.count("*").alias("n")).where("n > 1 and least is not null").select("key", "least")
    joined = keyed.join(groups, "key", "left")
    return joined.select("page", "url", "payload", "n_bytes", F.when(F.col("page") != F.col("least"), F.col("least")).alias("refers_to"))


def write_archives(planned: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write records as whole-file gzip archives, normalise each, and return the manifest (lazily: save it once)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = opened(folder)
        part, done, out, raw, size = TaskContext.get().partitionId(), [], None, "", 0

        def close() -> None:
            out.write(squeeze.flush())
            out.close()
            names = [f"{path}/{unique(f'part-{part:06d}', x)}" for x in (".warc.gz", ".index")]
            with system.open_input_stream(raw, compression=None) as source, system.open_output_stream(names[0], compression=None) as sink, system.open_output_stream(names[1]) as index:
                done.append((*names, *normalise(source, sink, index)))
            system.delete_file(raw)

        for batch in batches:
            for lot in range(0, batch.num_rows, 64):
                for row in batch.slice(lot, 64).to_pylist():
                    if out is None:
                        raw, size = f"{path}/{unique(f'raw-{part:06d}', '.warc.gz')}", 0
                        out, squeeze = system.open_output_stream(raw, compression=None), zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                    found = record(row["page"], row["url"], row["payload"], sha1_base32(row["payload"]), row["n_bytes"], row["refers_to"])
                    out.write(squeeze.compress(found))
                    size += len(found)
                    if size >= archive_bytes:
                        close()
                        out = None
        if out is not None:
            close()
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(list(zip(*done)) or [[]] * 4, kinds, strict=True)], ["archive", "index", "n_records", "n_bytes"])

    return planned.select("page", "url", "payload", "n_bytes", "refers_to").mapInArrow(write, MANIFEST)


def read_archives(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """Every record through the sidecar index: page, url, payload_bytes, payload_digest, record_type, refers_to, and payload if asked for."""
    columns = [("page", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())] + [("payload", pa.binary())] * payloads
    schema = pa.schema(columns)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, _ = opened(row["archive"].rpartition("/")[0])
                with system.open_input_stream(row["index"]) as f:
                    places = [json.loads(x) for x in f.read().splitlines()]
                lot, size = [], 0
                with system.open_input_file(row["archive"]) as f:
                    for x in places:
                        found = parse(zlib.decompress(f.read_at(x["length"], x["offset"]), 31))
                        size += found["payload_bytes"] if payloads else 100
                        lot.append({k: found[k] for k in schema.names})
                        if size > 1_000_000:
                            yield pa.RecordBatch.from_pylist(lot, schema)
                            lot, size = [], 0
                yield pa.RecordBatch.from_pylist(lot, schema)

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = "page long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    return manifest.repartition(n, "archive").mapInArrow(read, kinds)


def archives(spark: SparkSession, pages: DataFrame, id_col: str = "page_id", text_col: str = "html", url_col: str = "url", least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Write all pages as archives into the shared folder and read the records back.

    A null or empty payload is an empty one. Rows without an id
    are responses. Rows with equal ids are records each. Other columns are not read.
    """
    scratch = Scratch(spark, "warc")
    manifest = scratch.save(write_archives(plan_records(pages, id_col, text_col, url_col, least_bytes), f"{scratch.path}/archives"), "manifest")
    return read_archives(manifest).withColumnRenamed("page", id_col)
