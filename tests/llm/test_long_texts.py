"""Texts longer than what is worked on at once: pieces of batches, stretches of words, chunks of tokens."""

import zlib
from array import array

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from wattflow.llm import decontaminate, jaccard, language, packing, substrings, token_counts, token_files, toxicity

N = 160_000
PASSAGE = [f"p{i}x" for i in range(30)]
LONG = " ".join([*(f"w{i}" for i in range(N)), *PASSAGE, "end"])  # 1.1 MB
SHORT = " ".join([*(f"s{i}" for i in range(40)), *PASSAGE])


@pytest.fixture(scope="module")
def docs(make_docs):
    return make_docs([LONG, SHORT, "a few words", "", None]).cache()


@pytest.fixture(scope="module")
def ids():
    return {file: [Tokenizer.from_file(public_tokenizers.path(file)).encode(t, add_special_tokens=False).ids for t in (LONG, SHORT, "a few words", "", "")] for file in ("word_bpe_49k.json", "byte_bpe_50k.json")}


def test_counts_and_files(spark, docs, ids):
    own = ids["word_bpe_49k.json"]
    assert [r.n_tokens for r in token_counts.token_counts(docs).orderBy("doc_id").collect()] == [len(x) for x in own]
    got = token_files.token_files(spark, docs).orderBy("doc_id").collect()
    crc = lambda x: zlib.crc32(array("I", [*x, 1]).tobytes())
    assert [(r.n_tokens, r.ids_crc32) for r in got] == [(len(x) + 1, crc(x)) for x in own]
    assert [r.start for r in got] == np.cumsum([0] + [len(x) + 1 for x in own[:-1]]).tolist()


def test_packing(spark, docs, ids):
    rows = packing.pack(spark, docs).collect()
    for i, own in enumerate(ids["byte_bpe_50k.json"]):
        pieces = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert [p.start for p in pieces] == np.cumsum([0] + [p.length for p in pieces[:-1]]).tolist()
        assert sum(p.length for p in pieces) == len(own) + 1 and all(p.length <= 1024 for p in pieces)
        assert all(p.ids_crc32 == zlib.crc32(array("I", [*own, 2][p.start : p.start + p.length]).tobytes()) for p in pieces)


def test_shingles_and_passages(spark, docs):
    rows = {r.doc_id: r for r in jaccard.near_duplicates(spark, docs).collect()}
    assert [rows[i].n_shingles for i in range(5)] == [N + 31 - 4, 70 - 4, 1, 0, 0] and all(rows[i].component_id == i for i in range(5))
    found = substrings.repeated_passages(spark, docs).collect()
    assert [(r.doc_id, r.kind, r.first_word, r.n_words, r.kept_ids) for r in found] == [(1, "exact", 40, 30, [0])]


def test_contamination(spark, docs):
    items = spark.createDataFrame([(7, " ".join(PASSAGE[5:20])), (8, " ".join(PASSAGE[:9]) + " other")], "item_id long, text string")
    rows = {r.doc_id: r for r in decontaminate.digest(decontaminate.decontaminate(spark, docs, items)).collect()}
    assert [(rows[i].n_words, rows[i].n_hit, rows[i].n_items) for i in range(3)] == [(N + 31, 15, 1), (70, 15, 1), (3, 0, 0)]


def test_toxicity_and_language(spark, make_docs):
    plain, vile = "calm words of an ordinary text", "vilewort grobian here"
    texts = [f"{plain} " * 100 + (f"{vile} " * 10 if i % 3 == 0 else f"{plain} " * 5) + str(i) for i in range(120)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)], "doc_id long, toxic int")
    df = make_docs([*texts, f"{plain} " * 40_000 + f"{vile} " * 12, f"{plain} " * 40_000])
    rows = {r.doc_id: r for r in toxicity.score_toxicity(spark, df, labels).collect()}
    assert rows[120].n_words == 6 * 40_000 + 36 and rows[120].score > rows[121].score
    assert any(p.first_word >= 240_000 for p in rows[120].passages) and not rows[121].passages
    assert {r.lang_pred for r in language.identify_languages(spark, df).where("doc_id >= 120").collect()} == {"en"}


def test_batches_are_bounded_by_bytes(spark, make_docs):
    from wattflow.llm import memory

    spark.conf.unset(memory.SETTING)
    memory.bound_batches(spark)
    sizes = make_docs(["x" * 100_000] * 400).coalesce(1).select("text").mapInArrow(lambda batches: (b.select([]).from_pydict({"n": [b.nbytes]}) for b in batches), "n long").collect()
    assert len(sizes) > 5 and max(r.n for r in sizes) < 8_000_000
    spark.conf.set(memory.SETTING, "9m")
    memory.bound_batches(spark)
    assert spark.conf.get(memory.SETTING) == "9m"
    spark.conf.unset(memory.SETTING)
