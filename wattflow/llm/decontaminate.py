"""Benchmark decontamination with a distributed positional inverted index.

The training texts are indexed in blocks: for each word of the benchmark a block holds the ascending list of the places
where it stands, counted through all texts of the block. The index is stored in the shared folder. Each block answers
every benchmark phrase by itself: it starts from the list of the phrase's rarest word, shifted by the word's offset in
the phrase, and intersects it with the other shifted lists from rare to frequent until nothing is left. Proximity takes
an item's rarest words, by the counts of the whole index among those that occur, and looks for places where all of them
stand close together. Only these counts are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import words as W
from .scratch import Scratch

WINDOW = 10
NEAR_TERMS = 5
NEAR_SPAN = 50
#: A query block of the benchmark has about so many bytes of text at most; a larger benchmark takes several.
BLOCK_BYTES = 32_000_000
INDEX = "docs array<long>, bounds array<long>, terms array<long>, counts array<int>, gaps binary"


class Phrases:
    """A query block: its words (sorted fingerprints) and its phrases as rows of term numbers, -1 behind the last."""

    def __init__(self, items: pa.Table, window: int):
        ids = items.column(0).combine_chunks()
        texts = items.column(1).combine_chunks()
        self.ids = ids.to_pylist()
        found = W.words(*W.column_bytes(texts.cast(pa.string())), W.ALPHANUMERIC)
        self.vocabulary = np.unique(found.prints)
        terms = np.searchsorted(self.vocabulary, found.prints)
        owners: dict[tuple, set[int]] = {}
        self.words_of: list[np.ndarray] = []
        for i in range(len(self.ids)):
            own = terms[found.bounds[i] : found.bounds[i + 1]]
            self.words_of.append(np.unique(own))
            for at in range(max(1, len(own) - window + 1) if len(own) else 0):
                owners.setdefault(tuple(own[at : at + window].tolist()), set()).add(i)
        self.owners = [np.array(sorted(x), np.int64) for x in owners.values()]
        self.terms = np.full((len(owners), window), -1, np.int64)
        for row, phrase in zip(self.terms, owners, strict=True):
            row[: len(phrase)] = phrase
        self.lengths = (self.terms >= 0).sum(1)
        self.rare: list[np.ndarray] = []

    def choose_rare(self, index: DataFrame, near_terms: int) -> None:
        """Each item's rarest words in the index, rarest first, of those that occur."""
        counts = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy("x.terms").agg(F.sum("x.counts").alias("n")).toArrow()  # at most the vocabulary
        total = np.zeros(len(self.vocabulary), np.int64)
        total[counts.column(0).to_numpy()] = counts.column(1).to_numpy()
        known = [own[total[own] > 0] for own in self.words_of]
        self.rare = [own[np.argsort(total[own], kind="stable")][:near_terms] for own in known]


def index_blocks(docs: DataFrame, vocabulary, id_col: str, text_col: str) -> DataFrame:
    """The positional index, a row for each block of texts: vocabulary is a broadcast of sorted word fingerprints."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        hint = np.zeros(1 << 16, bool)  # by the low bits: most words are none of the benchmark's
        hint[(known & np.uint64(0xFFFF)).astype(np.int64)] = True
        for batch in batches:
            for piece in W.pieces(batch, "text", 4_000_000):
                found = W.words(*W.column_bytes(piece.column(1)), W.ALPHANUMERIC)
                place = np.flatnonzero(hint[(found.prints & np.uint64(0xFFFF)).astype(np.int64)])
                term = np.searchsorted(known, found.prints[place])
                same = known[np.minimum(term, len(known) - 1)] == found.prints[place] if len(known) else np.zeros(len(place), bool)
                place, term = place[same], term[same]
                order = np.argsort(term, kind="stable")
                place, term = place[order], term[order]
                terms, first, counts = np.unique(term, return_index=True, return_counts=True)
                gaps = np.diff(place, prepend=0)
                gaps[first] = place[first]
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (piece.column(0).to_pylist(), found.bounds)] + [pa.array([terms], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int32())), pa.array([gaps.astype("<u4").tobytes()])], schema=schema)

    schema = pa.schema([("docs", pa.list_(pa.int64())), ("bounds", pa.list_(pa.int64())), ("terms", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("gaps", pa.binary())])
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(build, INDEX)


class Block:
    """One block of the index, opened."""

    def __init__(self, row: dict, n_terms: int):
        self.docs = row["docs"]
        self.bounds = np.array(row["bounds"], np.int64)
        self.count = np.zeros(n_terms + 1, np.int64)
        terms, counts = np.array(row["terms"], np.int64), np.array(row["counts"], np.int64)
        self.count[terms] = counts
        stops = np.cumsum(counts)
        self.first = np.zeros(n_terms + 1, np.int64)
        self.first[terms] = stops - counts
        gaps = np.frombuffer(row["gaps"], "<u4").astype(np.int64)
        sums = np.cumsum(gaps)
        self.place = sums - np.repeat(sums[stops - counts] - gaps[stops - counts], counts) if len(counts) else sums

    def at(self, term: int) -> np.ndarray:
        return self.place[self.first[term] : self.first[term] + self.count[term]]

    def phrase(self, terms: np.ndarray) -> np.ndarray:
        """The places where the words stand one after the other in one text."""
        order = np.argsort(self.count[terms], kind="stable")
        found = self.at(terms[order[0]]) - order[0]
        for o in order[1:]:
            if not len(found):
                return found
            other = self.at(terms[o])
            i = np.searchsorted(other, found + o)
            found = found[(i < len(other)) & (other[np.minimum(i, len(other) - 1)] == found + o)] if len(other) else found[:0]
        text = np.searchsorted(self.bounds, found, "right") - 1
        return found[(text >= 0) & (found + len(terms) <= self.bounds[np.minimum(text + 1, len(self.bounds) - 1)])]

    def near(self, terms: np.ndarray, span: int) -> np.ndarray:
        """Places of the first word with all others at most span words away in the same text."""
        found = self.at(terms[0])
        text = np.searchsorted(self.bounds, found, "right") - 1
        low, high = np.maximum(found - span, self.bounds[text]), np.minimum(found + span, self.bounds[text + 1] - 1)
        for term in terms[1:]:
            other = self.at(term)
            keep = np.searchsorted(other, low) < np.searchsorted(other, high, "right")
            found, low, high = found[keep], low[keep], high[keep]
        return found


def matches(index: DataFrame, phrases, near_span: int) -> DataFrame:
    """For each text: n_words, n_hit, hits (from, to: stretches of hit words), items and near_items (positions in the query block)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = phrases.value
        for batch in batches:
            for number in range(batch.num_rows):
                block = Block(batch.slice(number, 1).to_pylist()[0], len(asked.vocabulary))
                block.count[-1] = np.iinfo(np.int64).max  # stands for "no word" behind a short phrase's end
                alive = np.flatnonzero(block.count[asked.terms].min(1) > 0) if len(asked.terms) else []
                edges = np.zeros(int(block.bounds[-1]) + 1, np.int64)
                items: dict[int, set[int]] = {}
                near: dict[int, set[int]] = {}
                for p in alive:
                    n = asked.lengths[p]
                    for place in block.phrase(asked.terms[p, :n]):
                        edges[place] += 1
                        edges[place + n] -= 1
                        items.setdefault(int(np.searchsorted(block.bounds, place, "right")) - 1, set()).update(asked.owners[p].tolist())
                for i, rare in enumerate(asked.rare):
                    if len(rare) and block.count[rare].min() > 0:
                        for place in block.near(rare, near_span):
                            near.setdefault(int(np.searchsorted(block.bounds, place, "right")) - 1, set()).add(i)
                hit = np.cumsum(edges)[:-1] > 0
                sums = np.concatenate([[0], np.cumsum(hit)])
                n_hit = sums[block.bounds[1:]] - sums[block.bounds[:-1]]
                stretches: list[list[dict]] = [[] for _ in block.docs]
                for text in np.flatnonzero(n_hit):
                    a, b = block.bounds[text], block.bounds[text + 1]
                    own = np.concatenate([[False], hit[a:b], [False]]).astype(np.int8)
                    turns = np.diff(own)
                    stretches[text] = [{"from": int(s), "to": int(e)} for s, e in zip(np.flatnonzero(turns == 1), np.flatnonzero(turns == -1), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block.docs, pa.int64()), pa.array(np.diff(block.bounds)), pa.array(n_hit), pa.array(stretches, schema.field("hits").type)]
                    + [pa.array([sorted({asked.ids[i] for i in x.get(t, ())}) for t in range(len(block.docs))], pa.list_(pa.int64())) for x in (items, near)],
                    schema=schema,
                )

    schema = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("hits", pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))), ("items", pa.list_(pa.int64())), ("near_items", pa.list_(pa.int64()))])
    return index.mapInArrow(find, "id long, n_words long, n_hit long, hits array<struct<from:long,to:long>>, items array<long>, near_items array<long>")


def decontaminate(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, near_terms: int = NEAR_TERMS, near_span: int = NEAR_SPAN, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each row of docs: id, n_words, n_hit, hits, items (ids of items with occurring windows), near_items.

    Null and empty texts have no words and no hits. Items without words or without an id match nothing; items with
    equal ids count as one. Rows with equal ids are answered each. hits counts words from 0, to is exclusive; stretches
    ascend and do not touch, whatever block_bytes is. A text of any length is one row of one task.
    """
    if window < 1:
        raise ValueError("a window has one word at least")
    scratch = Scratch(spark, "decontaminate")
    asked = benchmark.select(F.col(item_col).cast("long").alias("item"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text")).where("item is not null")
    size = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    numbered = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    if blocks > 1:
        numbered = scratch.save(numbered.withColumn("row", F.monotonically_increasing_id()), "rows")
    answers = []
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).toArrow()  # at most about block_bytes
        phrases = Phrases(part, window)
        vocabulary = spark.sparkContext.broadcast(phrases.vocabulary)
        index = scratch.save(index_blocks(numbered, vocabulary, "row" if blocks > 1 else "id", "text"), f"index-{b}")
        phrases.choose_rare(index, near_terms)
        answers.append(scratch.save(matches(index, spark.sparkContext.broadcast(phrases), near_span), f"matches-{b}"))
        scratch.drop(f"index-{b}")
    if blocks == 1:
        return answers[0].withColumnRenamed("id", id_col)
    all_rows = scratch.save(reduce(DataFrame.unionByName, answers), "all-matches")
    # The stretches of all query blocks, as one where they touch or overlap.
    order = Window.partitionBy("id").orderBy("from", "to")
    spans = all_rows.select("id", F.explode("hits").alias("h")).select("id", "h.from", "h.to")
    gap = F.col("from") > F.max("to").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = spans.withColumn("gap", F.coalesce(gap, F.lit(True)).cast("int")).withColumn("island", F.sum("gap").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = islands.groupBy("id", "island").agg(F.min("from").alias("from"), F.max("to").alias("to"))
    merged = whole.groupBy("id").agg(F.sum(F.col("to") - F.col("from")).alias("n_hit"), F.array_sort(F.collect_list(F.struct("from", "to"))).alias("hits"))
    lists = all_rows.groupBy("id").agg(F.max("n_words").alias("n_words"), *(F.array_sort(F.array_distinct(F.flatten(F.collect_list(x)))).alias(x) for x in ("items", "near_items")))
    full = lists.join(merged, "id", "left").join(numbered.select(F.col("row").alias("id"), F.col("id").alias("doc")), "id")
    nothing = F.array().cast(all_rows.schema["hits"].dataType)
    return full.select(F.col("doc").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("hits", nothing).alias("hits"), "items", "near_items")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The matches without lists: counts and a SHA-256 of the item ids."""
    ids = F.concat_ws(",", F.array_sort(F.transform("items", lambda x: x.cast("string"))))
    return found.select(id_col, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
