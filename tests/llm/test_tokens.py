"""Token counts, token files and packing against the tokenizers library."""

import random
import zlib
from array import array

import numpy as np
import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from wattflow.llm import packing, token_counts, token_files
from wattflow.llm.elias_fano import EliasFano
from wattflow.llm.encode import encoder

TEXTS = ["", None, "Hello there, world's end.", "a <|endoftext|> b", "x" * 500, "one two\n\n three  four ", "é ́ \x1c日本語。", "word " * 3000, "Hello there, world's end."]
FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
ids_of = lambda file, text: Tokenizer.from_file(public_tokenizers.path(file)).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("file", FILES)
def test_segments_give_the_ids_of_the_whole(file):
    rnd, known = random.Random(1), encoder(file)
    texts = TEXTS + ["".join(rnd.choice("ab'sS.!1 \n\t é́\x1c<|>endoftext日") for _ in range(rnd.randint(1, 60))) for _ in range(500)]
    for text, got in zip(texts, known.encode(texts), strict=True):
        assert array("I", got).tolist() == known.tokenizer.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab'sS.! \n\té日<|>", max_size=400), st.sampled_from([40, 90]), st.sampled_from([0, 20, 70]))
def test_resynchronised_ids_are_those_of_the_whole(text, chunk, overlap):
    tokenizer = encoder(FILES[0]).tokenizer
    for own in (text, text + "<|endoftext|>" + text, text.replace(" ", "x").replace("\n", "")):
        assert token_counts.encode_resynced(tokenizer, own, chunk, overlap)[0] == tokenizer.encode(own, add_special_tokens=False).ids


def test_counts(spark, make_docs):
    df = make_docs([*TEXTS, (None, "no id")])
    rows = token_counts.token_counts(df, chunk_chars=400, overlap_chars=40, limit=100).collect()
    for text, row in zip([*TEXTS, "no id"], rows, strict=True):
        n = len(ids_of(FILES[0], text))
        assert (row.n_bytes, row.n_tokens, row.over_limit) == (len((text or "").encode()), n, n > 100)
    assert rows[7].n_chunks > 10 and rows[-1].doc_id is None
    assert token_counts.token_counts(df.where("false")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1 << 40), max_size=600))
def test_elias_fano_round_trip(values):
    values = sorted(values)
    coded, end = EliasFano.from_bytes(b"xx" + EliasFano.encode(np.array(values, np.uint64)).to_bytes(), 2)
    assert coded.between(0, len(values)).tolist() == values
    for a in range(0, len(values) + 1, max(1, len(values) // 7)):
        for b in (a, a + 1, a + 255, a + 256, a + 700, len(values)):
            if a <= b <= len(values):
                assert coded.between(a, b).tolist() == values[a:b]
    assert [coded.select(i) for i in range(len(values))] == values
    with pytest.raises(IndexError):
        coded.select(len(values))


def test_elias_fano_packs_in_lots(monkeypatch):
    from wattflow.llm import elias_fano

    values = np.cumsum(np.random.default_rng(4).integers(0, 90, 1000)).tolist()
    whole = EliasFano.encode(np.array(values)).to_bytes()
    monkeypatch.setattr(elias_fano, "LOT", 64)
    assert EliasFano.encode(np.array(values)).to_bytes() == whole


def test_boundaries_are_read_by_lots(monkeypatch):
    """A reader that holds the offsets of one lot of documents, rows without an id first."""
    import struct

    ids, ends = np.arange(0, 3000, 3), np.cumsum(np.random.default_rng(5).integers(1, 60, 1007))
    data = struct.pack(token_files.HEAD, 7, -100, 2) + EliasFano.encode(ids).to_bytes() + EliasFano.encode(ends).to_bytes()
    for lot in (4, 300, 4096):
        monkeypatch.setattr(token_files, "LOT_DOCS", lot)
        width, lots = token_files.documents_of(data)
        rows = [(i, a, b) for names, starts, stops in lots for i, a, b in zip(names, starts.tolist(), stops.tolist(), strict=True)]
        assert width == 2 and [r[0] for r in rows] == [None] * 7 + (ids - 100).tolist()
        assert [r[1:] for r in rows] == list(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True))


def test_elias_fano_is_small():
    ends = np.cumsum(np.random.default_rng(0).integers(1, 1000, 10_000)).astype(np.uint64)
    assert len(EliasFano.encode(ends).to_bytes()) < 10_000 * 12 / 8


def test_token_files(spark, make_docs):
    df = make_docs([*TEXTS, (3, "again"), (None, "no id"), (-5, "below")])
    got = token_files.token_files(spark, df, shard_tokens=50).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, -5, 0, 1, 2, 3, 3, 4, 5, 6, 7, 8]
    start = 0
    for row in got:
        assert row.start == start
        start += row.n_tokens
        if row.doc_id not in (None, 3, -5):
            ids = [*ids_of(FILES[0], TEXTS[row.doc_id]), 1]
            assert (row.n_tokens, row.ids_crc32) == (len(ids), zlib.crc32(array("I", ids).tobytes()))
    assert token_files.token_files(spark, df.where("false")).count() == 0


def test_packing(spark, make_docs):
    df = make_docs([*TEXTS, *(f"some words number {i} " * (i % 40) for i in range(200)), (0, "again")])
    rows = sorted(packing.pack(spark, df, capacity=64).collect(), key=lambda r: (r.sequence_id, r.offset))
    at = {}
    for r in rows:
        assert r.offset == at.get(r.sequence_id, 0) and r.length > 0
        at[r.sequence_id] = r.offset + r.length
    assert max(at.values()) <= 64 and len(at) <= 1.02 * sum(at.values()) / 64 + 2
    ids = [*ids_of(FILES[1], TEXTS[7]), 2]
    own = sorted((r for r in rows if r.doc_id == 7), key=lambda r: r.piece)
    assert [r.piece for r in own] == list(range(len(own))) and all(r.length == 64 for r in own[1:])
    assert all(r.ids_crc32 == zlib.crc32(array("I", ids[r.start : r.start + r.length]).tobytes()) for r in own)
    assert sum(r.length for r in own) == len(ids)
    assert packing.pack(spark, df.where("false")).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 40), max_size=12))
def test_a_plan_uses_every_piece_once(counts):
    used, bins = {}, 0
    for pattern, times in packing.plan(counts, 30):
        assert sum(pattern) <= 30 and times > 0
        bins += times
        for length in pattern:
            used[length] = used.get(length, 0) + times
    assert used == counts
    assert bins <= 2 * sum(k * v for k, v in counts.items()) / 30 + 1  # greedy bins: at most one is no more than half full


def test_best_two_replace_the_smallest():
    assert packing.plan({60: 1, 30: 1, 25: 1, 15: 1}, 100) == [([60, 25, 15], 1), ([30], 1)]
    with pytest.raises(ValueError):
        packing.plan({101: 1}, 100)
