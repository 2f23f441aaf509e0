"""Archives and shard placement."""

import base64
import gzip
import hashlib
import io

import numpy as np
import pytest

from wattflow.llm import sharding, warc

PAGES = "page_id long, url string, html string, digest string"


def pages(spark, rows):
    return spark.createDataFrame([(i, f"http://x/{i}", h, "d") for i, h in rows], PAGES)


def test_round_trip(spark):
    rows = [(5, "same"), (2, "same"), (9, "same"), (1, None), (3, ""), (4, "é\r\n\r\nContent-Length: 3\r\n\r\n" * 50), (7, "z" * 300_000), (None, "lone")]
    got = {r.page_id: r for r in warc.archives(spark, pages(spark, rows)).collect()}
    for page, html in rows:
        data = (html or "").encode()
        assert (got[page].payload_bytes, got[page].payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
    assert {k: r.refers_to for k, r in got.items() if r.record_type == "revisit"} == {5: 2, 9: 2, 3: 1}
    assert all(r.refers_to is None for r in got.values() if r.record_type == "response")
    assert warc.archives(spark, pages(spark, [])).count() == 0
    same = warc.archives(spark, pages(spark, [(1, "a"), (1, "a"), (2, "a")])).collect()
    assert sorted((r.page_id, r.record_type) for r in same) == [(1, "response"), (1, "response"), (2, "revisit")]
    least = {r.page_id: r.record_type for r in warc.archives(spark, pages(spark, rows), least_bytes=5).collect()}
    assert set(least.values()) == {"response"}


@pytest.mark.parametrize("members", [False, True])
def test_normaliser(members):
    found = [warc.record(i, f"u{i}", bytes([i]) * 5000, warc.sha1_base32(bytes([i]) * 5000), 5000, None) for i in range(20)]
    raw = b"".join(gzip.compress(x) for x in found) if members else gzip.compress(b"".join(found))
    sink, index = io.BytesIO(), io.BytesIO()
    n, size = warc.normalise(io.BytesIO(raw), sink, index)
    places = [eval(x) for x in index.getvalue().splitlines()]  # noqa: S307
    assert n == 20 and size == len(sink.getvalue()) and len(places) == 20
    for x, p in zip(found, places, strict=True):
        assert gzip.decompress(sink.getvalue()[p["offset"] : p["offset"] + p["length"]]) == x
    with pytest.raises(ValueError):
        warc.normalise(io.BytesIO(raw[:-400]), io.BytesIO(), io.BytesIO())


def test_a_wrong_payload_is_found():
    with pytest.raises(ValueError):
        warc.parse(warc.record(1, "u", b"abc", warc.sha1_base32(b"abd"), 3, None))


def plain_table(shards, size):
    order = sorted(range(len(shards)), key=lambda i: shards[i])
    prefer = {i: [(sharding._number(shards[i], "offset") % size + k * (sharding._number(shards[i], "skip") % (size - 1) + 1)) % size for k in range(size)] for i in order}
    table = {}
    while len(table) < size:
        for i in order:
            if len(table) < size:
                table[next(s for s in prefer[i] if s not in table)] = i
    return [table[s] for s in range(size)]


def test_lookup_table():
    shards = [f"s{i}" for i in range(7)]
    table = sharding.lookup_table(shards, 101)
    assert table.tolist() == plain_table(shards, 101)
    assert np.ptp(np.bincount(table)) <= 1
    large = sharding.lookup_table(sharding.SHARDS)
    fewer = sharding.lookup_table(sharding.SHARDS[:-1])
    assert sharding.moved(large, fewer, set(range(63))) < 0.03
    for bad in (([], 101), (["a", "a"], 101), (["a"], 100), (shards, 5)):
        with pytest.raises(ValueError):
            sharding.lookup_table(*bad)


def test_place(spark):
    df = spark.createDataFrame([(1, "a", 0), (1, "b", 1), (None, "c", 2)] + [(i, "t", 3) for i in range(2000)], "doc_id long, text string, slot int")
    rows = sharding.place(spark, df, ["doc_id"]).collect()
    assert len(rows) == 2003 and all(r.shard == sharding.SHARDS[r.shard_id] for r in rows)
    table = sharding.lookup_table(sharding.SHARDS)
    for r in rows[:50]:
        key = "-" if r.doc_id is None else f"={r.doc_id}"
        slot = int(__import__("hashlib").md5(key.encode()).hexdigest()[:12], 16) % sharding.TABLE_SIZE
        assert (r.slot, r.shard_id) == (slot, table[slot])
    assert sharding.place(spark, df.where("false"), ["doc_id"]).count() == 0
    assert sharding.balance(sharding.place(spark, df, ["doc_id"]).withColumn("b", __import__("pyspark.sql.functions", fromlist=["f"]).lit(2)), "b").agg({"n_bytes": "sum"}).first()[0] == 4006
