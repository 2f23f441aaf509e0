"""Language of texts by hyperdimensional profiles.

Every letter, and the gap between words, has a random vector of +1 and -1. An n-gram's vector binds those of its letters,
each permuted by its place (rolled by as many components as letters follow), by multiplying them. A text's vector, and a
language's prototype, bundles the vectors of all its n-grams by adding them. A text has the language whose prototype has
the largest cosine with it.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .scratch import Scratch

DIMENSIONS = 1024
GRAM = 3
#: Bytes of text whose n-grams are counted at once, characters of a longer text taken at once, and n-grams that have their vectors in memory at once.
PIECE_BYTES = 250_000
STRETCH = 1 << 18
BLOCK = 8192
#: Letters whose vectors a worker keeps.
KEPT_LETTERS = 4096
#: Prototypes of so many languages go to the tasks; more languages are an error.
MOST_LANGUAGES = 2_000
UNKNOWN = "und"

_kinds: list[np.ndarray] = []
_letters: dict[tuple[int, int], np.ndarray] = {}


def _kind() -> np.ndarray:
    """For each code point 2 if it is a letter, 1 if a mark (part of a word as well), else 0."""
    if not _kinds:
        _kinds.append(np.array([{"L": 2, "M": 1}.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)], np.uint8))
    return _kinds[0]


def letter_vectors(letters: np.ndarray, dimensions: int) -> np.ndarray:
    """A row of +1 and -1 for each letter (0 is the gap), the same in every task."""
    if len(_letters) > KEPT_LETTERS:
        _letters.clear()
    rows = []
    for letter in letters.tolist():
        key = (letter, dimensions)
        if key not in _letters:
            _letters[key] = (np.random.default_rng([11, letter]).integers(0, 2, dimensions, dtype=np.int8) * 2 - 1).astype(np.int8)
        rows.append(_letters[key])
    return np.stack(rows) if rows else np.zeros((0, dimensions), np.int8)


def gram_vectors(grams: np.ndarray, n: int, dimensions: int) -> np.ndarray:
    """The bound vectors of n-grams (packed, 21 bits a letter)."""
    bound = np.ones((len(grams), dimensions), np.int8)
    for place in range(n):  # the last letter is not permuted
        own = (grams >> np.int64(21 * place)) & np.int64((1 << 21) - 1)
        letters, at = np.unique(own, return_inverse=True)
        bound *= np.roll(letter_vectors(letters, dimensions), place, axis=1)[at]
    return bound


def _grams(text: str, n: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """The distinct n-grams of a text, how often each stands there, and whether the text has a letter. Gaps between words count as one letter each, as do the text's ends."""
    kinds, held, seen, has_letter = _kind(), [], np.zeros(1, np.int64), False
    for at in range(0, len(text), STRETCH):
        points = np.frombuffer(text[at : at + STRETCH].lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        has_letter = has_letter or bool((kinds[points] == 2).any())
        points = np.where(kinds[points] > 0, points, 0)
        if at + STRETCH >= len(text):
            points = np.append(points, 0)
        points = np.concatenate([seen, points])
        gap = points == 0
        double = np.zeros(len(points), bool)
        double[1:] = gap[1:] & gap[:-1]
        points = points[~double]
        if len(points) >= n:
            packed = np.zeros(len(points) - n + 1, np.int64)
            for k in range(n):
                packed = (packed << np.int64(21)) | points[k : len(points) - n + 1 + k]
            held.append(np.unique(packed, return_counts=True))
        seen = points[-(n - 1) :] if n > 1 else points[:0]
    if len(held) == 1:
        return *held[0], has_letter
    if not held:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), has_letter
    grams, at = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
    counts = np.zeros(len(grams), np.int64)
    np.add.at(counts, at, np.concatenate([x[1] for x in held]))
    return grams, counts, has_letter


class Profiles:
    """The n-gram counts of some texts: grams, and of each text (owner, in order) which and how many it has."""

    def __init__(self, texts: list[str | None], n: int):
        found = [_grams(t, n) if t else (np.zeros(0, np.int64), np.zeros(0, np.int64), False) for t in texts]
        self.size, self.has_letter = len(texts), np.array([x[2] for x in found], bool)
        self.owner = np.repeat(np.arange(len(texts)), [len(x[0]) for x in found])
        every = np.concatenate([np.zeros(0, np.int64), *(x[0] for x in found)])
        self.grams, self.at = np.unique(every, return_inverse=True)
        self.counts = np.concatenate([np.zeros(0, np.int64), *(x[1] for x in found)])
        self.n = n

    def bundled(self, owner: np.ndarray, size: int, dimensions: int) -> np.ndarray:
        """The sum of the vectors of each owner's n-grams, exact: whole numbers in doubles."""
        total = np.zeros((size, dimensions))
        kind = np.float32 if self.counts.sum() < 1 << 24 else np.float64  # whole numbers stay exact
        for low in range(0, len(self.grams), BLOCK):
            vectors = gram_vectors(self.grams[low : low + BLOCK], self.n, dimensions).astype(kind)
            inside = np.flatnonzero((self.at >= low) & (self.at < low + BLOCK))
            own, at, counts = owner[inside], self.at[inside] - low, self.counts[inside].astype(kind)
            edges = np.flatnonzero(np.diff(own, prepend=-1, append=-1))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                total[own[a]] += counts[a:b] @ vectors[at[a:b]]
        return total

    def by_class(self, classes: np.ndarray, size: int, dimensions: int) -> np.ndarray:
        """The same for classes of texts (-1: none), whose counts are added before their vectors are."""
        own = classes[self.owner]
        keep = own >= 0
        if not keep.any():
            return np.zeros((size, dimensions))
        key, back = np.unique(own[keep] * len(self.grams) + self.at[keep], return_inverse=True)
        counts = np.zeros(len(key), np.int64)
        np.add.at(counts, back, self.counts[keep])
        whole = Profiles([], self.n)
        whole.grams, whole.at, whole.counts = self.grams, key % len(self.grams), counts
        return whole.bundled(key // len(self.grams), size, dimensions)


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether a document's label is not learned: CRC-32 of the id in decimal divisible by folds. Without an id it is neither learned nor held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def prototypes(spark: SparkSession, docs: DataFrame, n: int = GRAM, dimensions: int = DIMENSIONS, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """The bundle of all texts of each language. Rows without a text or a language add nothing.

    A task adds up its own texts and hands over a vector for each language, and sums of those are made before and after
    a shuffle by (language, component); the driver gets one number for each of these.
    """

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for piece in W.pieces(batch, "text", PIECE_BYTES):
                names, classes = np.unique(np.array(piece.column(1).to_pylist(), object), return_inverse=True)
                own = Profiles(piece.column(0).to_pylist(), n).by_class(classes, len(names), dimensions)
                for name, vector in zip(names.tolist(), own, strict=True):
                    total[name] = total[name] + vector if name in total else vector
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([v.astype(np.int64) for v in total.values()], pa.list_(pa.int64()))], ["lang", "bundle"])

    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    sums = rows.mapInArrow(bundle, "lang string, bundle array<long>").select("lang", F.posexplode("bundle").alias("pos", "n")).groupBy("lang", "pos").agg(F.sum("n").alias("n"))
    sums = Scratch(spark, "language").save(sums, "prototypes")
    if (many := sums.where("pos = 0").count()) > MOST_LANGUAGES:
        raise ValueError(f"{many} languages, but prototypes of at most {MOST_LANGUAGES} are held in memory")
    found: dict[str, np.ndarray] = {}
    for r in sums.collect():  # MOST_LANGUAGES * dimensions numbers at most
        found.setdefault(r["lang"], np.zeros(dimensions))[r["pos"]] = r["n"]
    return dict(sorted(found.items()))


def predict_language(docs: DataFrame, known: dict[str, np.ndarray], n: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred and score (the cosine, 0 if negative) of each row; und and 0 without a letter or any prototype. Of equal cosines the first language counts."""
    names = [k for k, v in known.items() if v.any()]
    matrix = np.array([known[k] / np.linalg.norm(known[k]) for k in names])
    kind = dict(docs.dtypes)[id_col]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in W.pieces(batch, "text", PIECE_BYTES):
                profiles = Profiles(piece.column(1).to_pylist(), n)
                langs, scores = np.full(piece.num_rows, UNKNOWN, object), np.zeros(piece.num_rows)
                if names:
                    bundles = profiles.bundled(profiles.owner, profiles.size, matrix.shape[1])
                    norms = np.linalg.norm(bundles, axis=1)
                    cosines = np.round(bundles @ matrix.T / np.where(norms > 0, norms, 1)[:, None], 12)
                    judged = np.flatnonzero(profiles.has_letter & (norms > 0))
                    best = cosines[judged].argmax(1)
                    langs[judged], scores[judged] = np.array(names, object)[best], np.clip(cosines[judged, best], 0, 1)
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(langs.tolist(), pa.string()), pa.array(scores)], ["id", "lang_pred", "score"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(judge, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def identify_languages(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5, n: int = GRAM, dimensions: int = DIMENSIONS) -> DataFrame:
    """id, held_out, lang_pred and score of each row of docs, learned from the rows that are not held out.

    Letters are those of Unicode in lower case, marks belong to words, all else is a gap. A null or empty text, and one
    without letters, is und with score 0, as is every row if nothing could be learned. Rows that repeat count each. Texts
    of any length are read whole, in stretches. Rows without an id are judged and not learned from. An empty table gives
    no rows. Other columns are not read, and no column but the text enters a prediction.
    """
    fold = F.crc32(F.col(id_col).cast("string").cast("binary")) % folds
    known = prototypes(spark, docs.where(fold != 0), n, dimensions, text_col, lang_col)
    judged = predict_language(docs, known, n, id_col, text_col)
    return judged.select(id_col, held_out(F.col(id_col), folds).alias("held_out"), "lang_pred", "score")
