"""Toxicity by maximum-scoring segments.

Tokens (words, and the first 4 or 6 bytes of longer words) get log-odds between toxic and other labelled texts, with a
Dirichlet prior that follows the counts of all documents. A word has the largest odds of its tokens that speak for
toxicity, else the least of those that speak against it; every other word costs a small drift. A linear scan over a
text's words finds all maximal scoring segments. As scores of such segments follow an extreme-value law, a segment's
expected number in other text of that length is K * n * exp(-lambda * score); segments that are unlikely enough are the
toxic passages. A logistic curve over the largest and the summed normalised scores gives the text's score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .jaccard import _isin
from .scratch import Scratch

#: Bound of the sample of labelled rows that tokens are weighed on, taken by hash of the id.
MOST_LABELLED = 100_000
#: Bound of the sample of labelled rows that the curve is fitted on.
MOST_FITTED = 40_000
#: Weights go to the tasks; more tokens than these (32 MB) are an error, never cut. A sample of MOST_LABELLED rows bounds them.
MOST_WEIGHTS = 2_000_000
#: A token that speaks for toxicity must stand in so many toxic labelled texts.
LEAST_SEEN = 3
#: A token's log-odds must be so many standard deviations from 0.
LEAST_Z = 2.5
#: A token must be the most telling one of so many toxic labelled texts, and of so many for each other text.
LEAST_CREDIT, LEAST_SHARE = 2, 0.25
DRIFT = 0.05
#: Expected number of chance segments up to which a segment counts as significant.
SIGNIFICANT = 0.05
THRESHOLD = 0.7
PREFIXES = (4, 6)
SEGMENTS = "array<struct<first_word:int,n_words:int,score:double>>"


def tokens(found: W.Words, data: np.ndarray) -> np.ndarray:
    """For each word its fingerprint and those of its beginnings (0 where it is too short), in rows."""
    out = np.zeros((1 + len(PREFIXES), len(found.prints)), np.uint64)
    out[0] = found.prints
    for row, n in zip(out[1:], PREFIXES, strict=True):
        long = np.flatnonzero(found.ends - found.starts > n)
        own = np.full(len(long), n, np.uint64)
        for k in range(n):
            own = own * np.uint64(0x9E3779B97F4A7C15) + W.ALPHANUMERIC[data[found.starts[long] + k]].astype(np.uint64)
        row[long] = W.mix(own)
    return out


def segments(places: list[int], weights: list[float], drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first place, last place, score) of a sequence whose items cost drift each but for those at the given ascending places. Linear in their number."""
    found: list[tuple[int, int, float, float]] = []  # first, last, sum before, sum behind
    total, before = 0.0, -1
    for place, weight in zip(places, weights, strict=True):
        total -= drift * (place - before - 1)
        before = place
        low, total = total, total + weight
        if weight <= 0:
            continue
        new = (place, place, low, total)
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j -= 1
            if j < 0 or found[j][3] >= new[3]:
                found.append(new)
                break
            new = (found[j][0], place, found[j][2], new[3])
            del found[j:]
    return [(a, b, high - low) for a, b, low, high in found]


def extreme_value_rate(weights: np.ndarray, chances: np.ndarray) -> float:
    """The positive lambda with sum(chances * exp(lambda * weights)) = 1; 1 if there is none."""
    if not (weights > 0).any() or (weights * chances).sum() >= 0:
        return 1.0
    value = lambda x: float((chances * np.exp(np.minimum(x * weights, 700.0))).sum()) - 1.0
    low, high = 0.0, 1.0
    while value(high) < 0 and high < 1e6:
        low, high = high, 2 * high
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 0 else (low, mid)
    return high


def _count(docs: DataFrame, known=None) -> DataFrame:
    """Token counts by label (column y, null: 0): token, in toxic, in others; of the known tokens (a broadcast) or all. Token 0 counts the words.

    A text that has a token n times counts 1 + floor(log2(n)): a word that one text repeats on and on tells less each time.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in W.pieces(batch, "text"):
                data, places = W.column_bytes(piece.column(0))
                found = W.words(data, places, W.ALPHANUMERIC)
                toxic = np.nan_to_num(piece.column(1).to_numpy(zero_copy_only=False).astype(float)) > 0
                rows, texts = tokens(found, data), found.texts()
                values, of_text = np.concatenate(rows), np.tile(texts, len(rows))
                keep = values != 0
                if known is not None:
                    keep &= _isin(values, known.value)
                values, of_text = values[keep], of_text[keep]
                order = np.lexsort((of_text, values))
                values, of_text = values[order], of_text[order]
                fresh = np.ones(len(values), bool)
                fresh[1:] = (values[1:] != values[:-1]) | (of_text[1:] != of_text[:-1])
                begins = np.flatnonzero(fresh)
                worth = np.frexp(np.diff(np.append(begins, len(values))).astype(float))[1].astype(np.int64)  # 1 + floor(log2)
                values, y = values[begins], toxic[of_text[begins]]
                first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
                ys = np.add.reduceat(y * worth, first) if len(first) else np.zeros(0, np.int64)
                all_n = np.add.reduceat(worth, first) if len(first) else np.zeros(0, np.int64)
                names = np.concatenate([values[first].view(np.int64), [0]])
                of = np.repeat(toxic, np.diff(found.bounds))
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.concatenate([ys, [int(of.sum())]])), pa.array(np.concatenate([all_n - ys, [int((~of).sum())]]))], ["token", "toxic", "other"])

    counted = docs.select("text", "y").mapInArrow(count, "token long, toxic long, other long")
    return counted.groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def log_odds(toxic, other, n_toxic, n_other, prior):
    """Log-odds with a Dirichlet prior of n_toxic tokens in all, and their standard score, as columns or arrays."""
    exp = np if isinstance(toxic, np.ndarray) else F
    a, b = toxic + prior, other + prior
    odds = exp.log(a / (2 * n_toxic - a)) - exp.log(b / (n_other + n_toxic - b))
    return odds, odds / exp.sqrt(1 / a + 1 / b)


class Weights:
    """Tokens that tell, their weights, and the law of segment scores."""

    def __init__(self, names: np.ndarray, values: np.ndarray, rate: float):
        order = np.argsort(names)
        self.names, self.values, self.rate = names[order], values[order], rate


def _worth(rows: np.ndarray, known: Weights) -> np.ndarray:
    """For each word the largest weight of its tokens that speak for toxicity, else the least of those against it, 0 without one."""
    most, least = np.zeros(rows.shape[1]), np.zeros(rows.shape[1])
    for row in rows:
        at = np.flatnonzero(_isin(row, known.names))
        own = known.values[np.searchsorted(known.names, row[at])]
        most[at], least[at] = np.maximum(most[at], own), np.minimum(least[at], own)
    return np.where(most > 0, most, least)


def _credit(labelled: DataFrame, weights) -> DataFrame:
    """For each token the number of toxic and of other texts whose most telling word has it."""

    def credit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in W.pieces(batch, "text"):
                data, places = W.column_bytes(piece.column(0))
                found = W.words(data, places, W.ALPHANUMERIC)
                rows = tokens(found, data)
                value, y, best = _worth(rows, weights.value), piece.column(1).to_pylist(), []
                for a, b, toxic in zip(found.bounds[:-1], found.bounds[1:], y, strict=True):
                    if b > a and value[a:b].any():
                        own = rows[:, a + value[a:b].argmax()]
                        best += [(x, int(toxic > 0), int(toxic <= 0)) for x in own[_isin(own, weights.value.names)].view(np.int64).tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*best) if best else [[]] * 3)], ["token", "toxic", "other"])

    return labelled.select("text", "y").mapInArrow(credit, "token long, toxic long, other long").groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def _worths(labelled: DataFrame, weights) -> DataFrame:
    """How many words of other texts have each weight (in thousandths), 0 being those without a token."""

    def worth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in W.pieces(batch, "text"):
                data, places = W.column_bytes(piece.column(0))
                found = W.words(data, places, W.ALPHANUMERIC)
                values, n = np.unique(np.rint(_worth(tokens(found, data), weights.value) * 1000).astype(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(n.astype(np.int64))], ["worth", "n"])

    return labelled.where("y <= 0").select("text").mapInArrow(worth, "worth long, n long").groupBy("worth").agg(F.sum("n").alias("n"))


def learn(spark: SparkSession, docs: DataFrame, labelled: DataFrame) -> Weights:
    """Weigh tokens: labelled (text, y) gives the odds, docs (text) the prior. Only bounded tables come to the driver."""
    counts = _count(labelled)
    total = counts.where("token = 0").first()
    n_toxic, n_other = (total["toxic"], total["other"]) if total else (0, 0)
    if not n_toxic or not n_other:
        return Weights(np.zeros(0, np.uint64), np.zeros(0), 1.0)
    share = (F.col("toxic") + F.col("other")) / F.lit(n_toxic + n_other)
    odds, z = log_odds(F.col("toxic"), F.col("other"), F.lit(float(n_toxic)), F.lit(float(n_other)), F.lit(float(n_toxic)) * share)
    telling = ((F.col("z") >= LEAST_Z / 2) & (F.col("toxic") >= LEAST_SEEN)) | (F.col("z") <= -LEAST_Z / 2)
    best = counts.where("token != 0").withColumn("z", z).where(telling).select("token", "toxic", "other").orderBy("token")
    if (many := best.count()) > MOST_WEIGHTS:
        raise ValueError(f"{many} tokens tell, more than {MOST_WEIGHTS}")
    best = best.toPandas()
    names = best["token"].to_numpy(np.int64).view(np.uint64)
    corpus = _count(docs.withColumn("y", F.lit(0)), spark.sparkContext.broadcast(np.sort(names))).toPandas().set_index("token")["other"]
    n_all = int(corpus.get(0, 0))
    in_all = corpus.reindex(best["token"]).fillna(0).to_numpy(float)
    odds, z = log_odds(best["toxic"].to_numpy(float), best["other"].to_numpy(float), float(n_toxic), float(n_other), np.maximum(n_toxic * in_all / max(n_all, 1), 1e-3))
    against, speaks = (z <= -LEAST_Z) & (odds < 0), (z >= LEAST_Z) & (odds > 0)
    told = Weights(names[speaks], odds[speaks], 1.0)
    credit = _credit(labelled, spark.sparkContext.broadcast(told)).toPandas()  # a row for each weighed token at most
    fair = credit[(credit["toxic"] >= LEAST_CREDIT) & (credit["toxic"] >= LEAST_SHARE * credit["other"])]["token"].to_numpy(np.int64).view(np.uint64)
    keep = against | (speaks & np.isin(names, fair))
    found = Weights(names[keep], odds[keep], 1.0)
    worths = _worths(labelled, spark.sparkContext.broadcast(found)).toPandas()
    values = np.where(worths["worth"] == 0, -DRIFT, worths["worth"] / 1000)
    found.rate = extreme_value_rate(values, (worths["n"] / worths["n"].sum()).to_numpy(float)) if len(worths) else 1.0
    return found


def find_segments(docs: DataFrame, weights) -> DataFrame:
    """id, n_words and segments of each row of docs (id, text)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = weights.value
        for batch in batches:
            for piece in W.pieces(batch, "text"):
                data, places = W.column_bytes(piece.column(1))
                found = W.words(data, places, W.ALPHANUMERIC)
                value = _worth(tokens(found, data), known)
                told = np.flatnonzero(value)
                cuts = np.searchsorted(told, found.bounds)
                out: list[list[dict]] = []
                for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    own = segments((told[a:b] - found.bounds[i]).tolist(), value[told[a:b]].tolist()) if b > a else []
                    out.append([{"first_word": s, "n_words": e - s + 1, "score": x} for s, e, x in own])
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(np.diff(found.bounds)), pa.array(out, kind)], ["id", "n_words", "segments"])

    kind = pa.list_(pa.struct([("first_word", pa.int32()), ("n_words", pa.int32()), ("score", pa.float64())]))
    return docs.select("id", "text").mapInArrow(scan, f"id long, n_words long, segments {SEGMENTS}")


def _curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Coefficients of a logistic curve with a small ridge, by Newton steps."""
    x = np.hstack([np.ones((len(x), 1)), x])
    beta, ridge = np.zeros(x.shape[1]), np.diag([1e-6] + [1e-2] * (x.shape[1] - 1)) * len(x) ** 0.5
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(x.shape[1]), x.T @ (y - p) - ridge @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def score_toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of docs: id, held_out, score (0 to 1), predicted (0 or 1), n_words, passages.

    passages are the significant segments (first_word, n_words, score) among the text's words. A row is held out, and
    never learned from, if crc32 of its id modulo 3 is 1 or it has no id. Null and empty texts have no words and the
    score of a text without segments. Labels that are null are left out; of several for an id the largest holds.
    Without a toxic and another label to learn from, all scores are 0. Other columns are not read.
    """
    scratch = Scratch(spark, "toxicity")
    held = F.coalesce(F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(True))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    own = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("y")).where("id is not null and y is not null")
    own = own.groupBy("id").agg(F.max("y").cast("int").alias("y")).where(~held)
    sample = scratch.save(own.orderBy(F.xxhash64("id"), "id").limit(MOST_LABELLED), "sample")  # bounded, so it may be broadcast
    weights = learn(spark, rows, rows.join(F.broadcast(sample), "id"))
    scanned = scratch.save(find_segments(rows, spark.sparkContext.broadcast(weights)), "scanned")

    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    top = F.coalesce(F.array_max(F.transform("segments", lambda s: s["score"])), F.lit(0.0))
    seen = scanned.join(F.broadcast(sample), "id").orderBy(F.xxhash64("id", F.lit(1)), "id").limit(MOST_FITTED)
    fitted = seen.select("y", n.alias("n"), top.alias("top"), F.transform("segments", lambda s: s["score"]).alias("scores")).toPandas()
    rate, y = weights.rate, fitted["y"].to_numpy(float)
    scale = _scale(fitted["top"].to_numpy(float)[y == 0], fitted["n"].to_numpy(float)[y == 0], rate)
    norm = lambda s: F.lit(rate) * s - F.log(F.lit(scale) * n)
    significant = F.filter("segments", lambda s: norm(s["score"]) >= -math.log(SIGNIFICANT))
    total = F.aggregate("passages", F.lit(0.0), lambda acc, s: acc + norm(s["score"]))
    shaped = scanned.withColumn("passages", significant).withColumn("x1", F.least(F.greatest(norm(top), F.lit(-10.0)), F.lit(30.0))).withColumn("x2", F.log1p(total))
    if len(weights.names) and 0 < y.sum() < len(y):
        log_n = np.log(scale * fitted["n"].to_numpy(float))
        sums = [sum(v for s in own if (v := rate * s - m) >= -math.log(SIGNIFICANT)) for own, m in zip(fitted["scores"], log_n, strict=True)]
        x = np.stack([np.clip(rate * fitted["top"].to_numpy(float) - log_n, -10, 30), np.log1p(sums)], axis=1)
        a, b, c = _curve(x, y)
        score = 1 / (1 + F.exp(-(F.lit(float(a)) + float(b) * F.col("x1") + float(c) * F.col("x2"))))
    else:
        score = F.lit(0.0)
    scored = shaped.withColumn("score", score)
    return scored.select(F.col("id").alias(id_col), held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_words", "passages")


def _scale(top: np.ndarray, n: np.ndarray, rate: float) -> float:
    """K of the extreme-value law from the largest scores of other texts; texts without a segment bound it from above."""
    some = top > 0
    if some.sum() < 20:
        return 0.1
    euler = 0.5772156649
    return float(np.clip(np.exp(np.mean(rate * top[some] - np.log(np.maximum(n[some], 1.0))) - euler) * some.mean(), 1e-6, 1.0))
