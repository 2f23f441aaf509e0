"""Removal of passages that repeat across documents.

Paragraphs are lines of LINE_WORDS words or more. They get MinHash bands; all lines that collide in a band are brought
together, checked by exact Jaccard similarity of their shingles, and linked lines form components. Of each component the
line in the document with the smallest id stays.

Passages inside otherwise different lines are found exactly. Of any PASSAGE_WORDS words in a row the least of their
shingles of ANCHOR words is an anchor, so that equal stretches have an equal anchor at the same place. Documents meet at
equal anchors. Where the words around it, as far as a passage with this anchor can reach, are equal as well, they repeat;
of each different surrounding one document gives all its windows of PASSAGE_WORDS words, and equal windows repeat. What
repeats in a document of a smaller id makes a passage where it touches; passages of PASSAGE_WORDS words or more go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import words as W
from .components import connected_components
from .jaccard import POSTINGS, POSTINGS_LOT, _meet, _near_by, _with_ids, classes_of, linked_roots
from .memory import lean
from .scratch import Scratch

SHINGLE = 5
PERCENT = 80
LINE_WORDS = 20
PASSAGE_WORDS = 20
#: Words of an anchor; of a window's anchors one at least is chosen, in all one place in seven.
ANCHOR = 8
#: Spans and anchors where passages may be, by document, are broadcast up to this number in all, else joined by a shuffle of the texts.
BROADCAST_PLACES = 4_000_000
#: Passages to be cut out are broadcast up to this number, else joined by a shuffle.
BROADCAST_PASSAGES = 500_000
#: Lines of similarity 0.8 meet in a band with a chance of 1 - (1 - 0.8 ** 3) ** 8 = 0.997.
BANDS, ROWS = 8, 3
LINES = "key long, n long, doc long, w0 int, w1 int, b0 int, b1 int"
ANCHORS = "bucket int, codes binary, checks binary, places binary, counts binary, docs binary"
WINDOWS = "key long, doc long, w0 int, w1 int, b0 int, b1 int, kept array<long>, prints array<long>, starts array<int>, stops array<int>"


def _runs(new: np.ndarray) -> np.ndarray:
    """Where runs begin, and the total at the end; new[i] says that a run begins at i."""
    return np.concatenate([np.flatnonzero(new), [len(new)]])


def line_starts(found: W.Words, data: np.ndarray) -> np.ndarray:
    """For each word whether it is the first of a line."""
    breaks = np.flatnonzero(data == 10)
    new = np.zeros(len(found.starts), bool)
    new[found.bounds[:-1][np.diff(found.bounds) > 0]] = True
    if len(new) > 1 and len(breaks):
        new[1:] |= np.searchsorted(breaks, found.starts[1:]) > np.searchsorted(breaks, found.ends[:-1])
    return new


def line_sets(found: W.Words, edges: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of each line (not sorted, with repeats) and where each line's begin."""
    return W.windows(W.Words(found.prints, found.starts, found.ends, edges), shingle)


def _distinct(rolled: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same as sorted sets."""
    rolled = rolled.copy()
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        rolled[a:b].sort()
    first = np.ones(len(rolled), bool)
    first[1:] = rolled[1:] != rolled[:-1]
    first[bounds[:-1][np.diff(bounds) > 0]] = True
    return rolled[first], np.concatenate([[0], np.cumsum(first)])[bounds]


def band_keys(values: np.ndarray, bounds: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A key for each set (none is empty) and band."""
    keys = np.zeros((len(bounds) - 1, bands), np.uint64)
    if len(values):
        seeds = np.random.default_rng(1).integers(0, 1 << 63, (bands, rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for b in range(bands):
            for r in range(rows):
                keys[:, b] = keys[:, b] * np.uint64(0x9E3779B97F4A7C15) + W.mix(np.minimum.reduceat(values * seeds[b, r], bounds[:-1]))
            keys[:, b] = W.mix(keys[:, b] + np.uint64(b))
    return keys.view(np.int64)


def _sums(prints: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(prints * W._power(W._BASE, len(prints) + 1)[:-1], dtype=np.uint64)])


def _prints(sums: np.ndarray, w0: np.ndarray, w1: np.ndarray) -> np.ndarray:
    """Fingerprints of the words w0 to w1, from the _sums of all."""
    return W.mix((sums[w1] - sums[w0]) * W._power(W._INVERSE, len(sums))[w0] + (w1 - w0).astype(np.uint64))


def anchors(found: W.Words, sums: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows that lie inside a text, for each its anchor (the first of its least shingles), and the shingles' fingerprints."""
    size = min(ANCHOR, window)
    if len(found.prints) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), sums[:0]
    at = np.arange(len(found.prints) - size + 1)
    keys = _prints(sums, at, at + size)
    place, span, width = at, 1, window - size + 1
    while span < width:  # the first of the least in twice as many, until in all
        step = min(span, width - span)
        a, b = place[:-step], place[step:]
        place = np.where(keys[b] < keys[a], b, a)
        span += step
    ends = np.repeat(found.bounds[1:], np.diff(found.bounds))
    inside = np.flatnonzero(np.arange(len(place)) + window <= ends[: len(place)])
    return inside, place[inside], keys


def _buckets(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _anchors(docs: DataFrame, window: int, buckets: int) -> DataFrame:
    """The anchors of all texts by bucket of their key: 32 bits of the key, 32 bits that check the words around, the place, and for each document how many are its own."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = min(ANCHOR, window)
        lot, rows, owners = [], 0, 0

        def packed() -> pa.RecordBatch:
            keys, checks, places, owner, docs = (np.concatenate(x) for x in zip(*lot, strict=True))
            bucket = ((keys >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((owner, bucket))
            bucket, codes, checks, places, owner = bucket[order], keys[order].astype(np.uint32), checks[order], places[order], owner[order]
            new = np.diff(bucket, prepend=-1) != 0
            runs = np.flatnonzero(new | (np.diff(owner, prepend=-1) != 0))
            counts, of = np.diff(np.append(runs, len(bucket))).astype(np.uint32), docs[owner[runs]]
            edges = np.append(np.flatnonzero(new), len(bucket))
            inner = np.searchsorted(runs, edges)
            rows_of = [[x[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)] for x in (codes, checks, places)]
            runs_of = [[x[a:b].tobytes() for a, b in zip(inner[:-1], inner[1:], strict=True)] for x in (counts, of)]
            return pa.RecordBatch.from_arrays([pa.array(bucket[edges[:-1]].astype(np.int32)), *(pa.array(x, pa.binary()) for x in (*rows_of, *runs_of))], ["bucket", "codes", "checks", "places", "counts", "docs"])

        for batch in batches:
            for piece in W.pieces(batch, "text"):
                found = W.words(*W.column_bytes(piece.column(1)), W.BLANK_SEPARATED)
                sums = _sums(found.prints)
                _, place, keys = anchors(found, sums, window)
                place = np.unique(place)
                text = found.texts()[place]
                low, high = np.maximum(place - (window - size), found.bounds[text]), np.minimum(place + window, found.bounds[text + 1])
                checks = W.mix(_prints(sums, low, high) + (place - low).astype(np.uint64))
                lot.append((keys[place], checks.astype(np.uint32), (place - found.bounds[text]).astype(np.uint32), text + owners, piece.column(0).to_numpy()))
                rows, owners = rows + len(place), owners + piece.num_rows
                if rows >= POSTINGS_LOT:
                    yield packed()
                    lot, rows, owners = [], 0, 0
        if rows:
            yield packed()

    return docs.mapInArrow(cut, ANCHORS)


def _shared(packed: DataFrame) -> DataFrame:
    """doc and w0 of anchors that stand in several documents: with kept, the document of the smallest id with the same words around, or with null where the windows are to be compared."""

    def meet(table: pa.Table) -> pa.Table:
        codes, checks, places, counts = (np.frombuffer(b"".join(table.column(x).to_pylist()), np.uint32) for x in ("codes", "checks", "places", "counts"))
        docs = np.repeat(np.frombuffer(b"".join(table.column("docs").to_pylist()), np.int64), counts)
        order = np.lexsort((docs, checks, codes))
        codes, checks, places, docs = codes[order], checks[order], places[order].astype(np.int32), docs[order]
        new = np.diff(codes.astype(np.int64), prepend=-1) != 0
        inner = new | (np.diff(checks.astype(np.int64), prepend=-1) != 0)
        starts, group = np.flatnonzero(new), np.cumsum(new) - 1
        several = (np.minimum.reduceat(docs, starts) < np.maximum.reduceat(docs, starts))[group]
        kept = docs[np.flatnonzero(inner)][np.cumsum(inner) - 1]
        covered = several & (docs != kept)
        asked = several & ~covered & (np.add.reduceat(inner.astype(np.int64), starts) > 1)[group]  # a document may have the same words around at several places
        rows = np.concatenate([np.flatnonzero(covered), np.flatnonzero(asked)])
        return pa.table([pa.array(docs[rows]), pa.array(places[rows]), pa.array(kept[rows], mask=np.arange(len(rows)) >= covered.sum())], ["doc", "w0", "kept"])

    return packed.groupBy("bucket").applyInArrow(lean(meet), "doc long, w0 int, kept long")


def _islands(spans: DataFrame, kept, *more) -> DataFrame:
    """Spans (doc, w0, w1, and what the aggregates kept and more need) that touch or overlap, as one."""
    before = Window.partitionBy("doc").orderBy("w0", "w1")
    gap = F.col("w0") > F.max("w1").over(before.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("gap", F.coalesce(gap, F.lit(True)).cast("int")).withColumn("island", F.sum("gap").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("doc", "island").agg(F.min("w0").alias("w0"), F.max("w1").alias("w1"), kept.alias("kept"), *more).drop("island")


def _places(shared: DataFrame, window: int) -> DataFrame:
    """For each document (id) the spans that repeat for certain and the anchors (asked) of windows to be compared."""
    size = min(ANCHOR, window)
    covered = shared.where("kept is not null").select("doc", F.greatest(F.col("w0") - (window - size), F.lit(0)).alias("w0"), (F.col("w0") + window).alias("w1"), "kept")
    spans = _islands(covered, F.collect_set("kept")).select("doc", F.struct("w0", "w1", "kept").alias("span"), F.lit(None).cast("int").alias("asked"))
    asked = shared.where("kept is null").select("doc", F.lit(None).cast(spans.schema["span"].dataType).alias("span"), F.col("w0").alias("asked"))
    return spans.unionByName(asked).groupBy(F.col("doc").alias("id")).agg(F.collect_list("span").alias("spans"), F.collect_set("asked").alias("asked"))


def _windows(docs: DataFrame, window: int) -> DataFrame:
    """Of docs (id, text, spans, asked): each span with its bytes and kept; and for each anchor that is asked for its key, w0 of the first window that has it, and the prints (of all words), first and last bytes of this and the next windows that have it."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in W.pieces(batch, "text"):
                data, places = W.column_bytes(piece.column(1))
                found = W.words(data, places, W.BLANK_SEPARATED)
                sums, lists = _sums(found.prints), piece.column(3)
                text = np.repeat(np.arange(piece.num_rows), np.diff(lists.offsets.to_numpy()))
                at = lists.flatten().to_numpy().astype(np.int64) + found.bounds[text]
                asked = np.zeros(len(found.prints) + 1, bool)
                asked[at[at < found.bounds[text + 1]]] = True
                w0, place, keys = anchors(found, sums, window)
                w0, place = w0[asked[place]], place[asked[place]]
                edges = _runs(np.diff(place, prepend=-1) != 0).astype(np.int32)
                first, text = w0[edges[:-1]], found.texts()[w0]
                whole = _prints(sums, w0, w0 + window).view(np.int64), (found.starts[w0] - places[text]).astype(np.int32), (found.ends[w0 + window - 1] - places[text]).astype(np.int32)
                own, nothing = text[edges[:-1]], pa.nulls(len(first), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[place[edges[:-1]]].view(np.int64)), piece.column(0).take(pa.array(own)), pa.array((first - found.bounds[own]).astype(np.int32)), nothing, nothing, nothing, pa.nulls(len(first), pa.list_(pa.int64()))]
                    + [pa.ListArray.from_arrays(pa.array(edges), pa.array(x)) for x in whole],
                    schema=schema,
                )
                spans = piece.column(2)
                text = np.repeat(np.arange(piece.num_rows), np.diff(spans.offsets.to_numpy()))
                inner = spans.flatten()
                low, high = (inner.field(x).to_numpy().astype(np.int64) + found.bounds[text] for x in ("w0", "w1"))
                high = np.minimum(high, found.bounds[text + 1])
                keep = np.flatnonzero(low < high)
                low, high, text = low[keep], high[keep], text[keep]
                columns = [pa.array(x.astype(np.int32)) for x in (low - found.bounds[text], high - found.bounds[text], found.starts[low] - places[text], found.ends[high - 1] - places[text])]
                nothing = [pa.nulls(len(keep), k) for k in (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([nothing[0], piece.column(0).take(pa.array(text)), *columns, inner.field("kept").take(pa.array(keep)), *nothing[1:]], schema=schema)

    kinds = {"key": pa.int64(), "doc": pa.int64(), **{x: pa.int32() for x in ("w0", "w1", "b0", "b1")}, "kept": pa.list_(pa.int64()), "prints": pa.list_(pa.int64()), "starts": pa.list_(pa.int32()), "stops": pa.list_(pa.int32())}
    schema = pa.schema(list(kinds.items()))
    return docs.select("id", "text", "spans", "asked").mapInArrow(cut, WINDOWS)


def _stretches(windows: DataFrame, window: int) -> DataFrame:
    """For each anchor the words of its windows that a document of a smaller id has as well; they all overlap. The sort and the counts need no further shuffle."""
    each = windows.repartition("key").select("key", "doc", F.col("w0").alias("first"), F.posexplode(F.arrays_zip("prints", "starts", "stops")).alias("at", "of"))
    each = each.select("key", "doc", "first", (F.col("first") + F.col("at")).alias("w0"), "of.*")
    kept = each.withColumn("kept", F.min("doc").over(Window.partitionBy("key", "prints"))).where("doc != kept")
    span = [F.min("w0").alias("w0"), (F.max("w0") + F.lit(window)).alias("w1"), F.min("starts").alias("b0"), F.max("stops").alias("b1"), F.collect_set("kept").alias("kept")]
    return kept.groupBy("key", "doc", "first").agg(*span).drop("key", "first")


class _LineSets:
    """The long lines of a piece of a batch: first and last words, sorted shingle sets and their fingerprints."""

    def __init__(self, texts: pa.Array, shingle: int, least: int):
        self.data, self.places = W.column_bytes(texts)
        self.found = W.words(self.data, self.places, W.BLANK_SEPARATED)
        edges = _runs(line_starts(self.found, self.data))
        rolled, bounds = line_sets(self.found, edges, shingle)
        long = np.diff(edges) >= least
        self.values, self.bounds = _distinct(rolled[np.repeat(long, np.diff(bounds))], np.concatenate([[0], np.cumsum(np.diff(bounds)[long])]))
        self.w0, self.w1 = edges[:-1][long], edges[1:][long]
        self.keys = classes_of(self.values, self.bounds)
        self.text = self.found.texts()[self.w0]


def _lines(docs: DataFrame, shingle: int, least: int, buckets: int) -> DataFrame:
    """The long lines of all texts: fingerprint and size of the shingle set, document, words and bytes; and, with a bucket, their band keys as postings, of copies in a piece once."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in W.pieces(batch, "text"):
                x = _LineSets(piece.column(1), shingle, least)
                first, start = x.found.bounds[x.text], x.places[x.text]
                spans = [x.w0 - first, x.w1 - first, x.found.starts[x.w0] - start, x.found.ends[x.w1 - 1] - start]
                own = [pa.array(x.keys), pa.array(np.diff(x.bounds)), piece.column(0).take(pa.array(x.text)), *(pa.array(y.astype(np.int32)) for y in spans)]
                yield pa.RecordBatch.from_arrays([*own, *(pa.nulls(len(x.keys), k) for k in kinds[7:])], names)

                keys = band_keys(x.values, x.bounds).view(np.uint64)
                fresh = np.unique(x.keys, return_index=True)[1]
                codes, line = keys[fresh].ravel(), np.repeat(fresh, BANDS)
                bucket = ((codes >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                bucket, codes, line = bucket[order], codes[order].astype(np.uint32), line[order]
                edges = np.append(np.flatnonzero(np.diff(bucket, prepend=-1) != 0), len(bucket))
                parts = (codes, np.ones(len(codes), np.uint32), x.keys[line], np.diff(x.bounds)[line].astype(np.uint32))
                packed = [[y[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)] for y in parts]
                n = len(edges) - 1
                yield pa.RecordBatch.from_arrays([*(pa.nulls(n, k) for k in kinds[:7]), pa.array(bucket[edges[:-1]].astype(np.int32)), pa.array(np.zeros(n, bool)), *(pa.array(y, pa.binary()) for y in packed)], names)

    names = [x.split()[0] for x in f"{LINES}, {POSTINGS}".split(", ")]
    kinds = [pa.int64()] * 3 + [pa.int32()] * 5 + [pa.bool_()] + [pa.binary()] * 4
    return docs.mapInArrow(cut, f"{LINES}, {POSTINGS}")


class _LineTexts:
    """Finds a line of each of some classes again."""

    def __init__(self, scratch: Scratch, rows: DataFrame, lines: DataFrame, shingle: int, least: int):
        self.scratch, self.rows, self.lines, self.shingle, self.least = scratch, rows, lines, shingle, least

    def built(self, classes: DataFrame, name: str, made: dict) -> DataFrame:
        first = self.lines.select(F.col("key").alias("class"), "doc").join(_near_by(self.scratch.save(classes, f"{name}-classes")), "class").groupBy("class").agg(F.min("doc").alias("id"))
        wanted = self.scratch.save(first, name)
        shingle, least = self.shingle, self.least

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for piece in W.pieces(batch, "text"):
                    x = _LineSets(piece.column(1), shingle, least)
                    data = [[f(x.values[a:b]).tobytes() for a, b in zip(x.bounds[:-1], x.bounds[1:], strict=True)] for f in made.values()]
                    yield pa.RecordBatch.from_arrays([pa.array(x.keys), piece.column(0).take(pa.array(x.text)), pa.array(np.diff(x.bounds)), *(pa.array(y, pa.binary()) for y in data)], ["class", "id", "n", *made])

        found = _with_ids(self.rows, wanted.select("id")).select("id", "text").mapInArrow(build, "class long, id long, n long" + "".join(f", {x} binary" for x in made))
        return found.join(_near_by(wanted), ["class", "id"], "left_semi").drop("id")  # a line that stands twice in a text comes twice, to no effect


def repeated_passages(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, passage_words: int = PASSAGE_WORDS, line_words: int = LINE_WORDS) -> DataFrame:
    """A row for each passage to be removed: id, kind (exact or near), first_word, n_words, first_byte, n_bytes, kept_ids.

    first_word and first_byte count from 0 in the text (bytes of UTF-8); kept_ids are the documents where the passage's
    paragraphs stay. Passages of the two kinds may overlap. Null and empty texts have none, nor has an empty table. Rows
    without an id are left out. Rows with equal ids are one document, taken to have one text, so their common passages
    are no repeats. Of ties in id order there are none: the smallest id keeps a passage. A text of any length is one
    row of one task. Ids are integers. Other columns are not read. Lines of fewer than line_words words are compared by
    their exact passages alone.
    """
    scratch = Scratch(spark, "substrings")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    buckets = _buckets(spark)

    shared = scratch.save(_shared(_anchors(rows, passage_words, buckets)), "shared")
    places = scratch.save(_places(shared, passage_words), "places")
    held = places.agg(F.sum(F.size("spans") + F.size("asked"))).first()[0] or 0
    few = held <= BROADCAST_PLACES
    cut = scratch.save(_windows(rows.join(F.broadcast(places) if few else places.hint("merge"), "id"), passage_words), "windows")
    columns = ["doc", "w0", "w1", "b0", "b1", "kept"]
    spans = cut.where("key is null").select(*columns).unionByName(_stretches(cut.where("key is not null").select("key", "doc", "w0", "prints", "starts", "stops"), passage_words).select(*columns))
    exact = _islands(spans, F.array_sort(F.array_distinct(F.flatten(F.collect_set("kept")))), F.min("b0").alias("b0"), F.max("b1").alias("b1")).where(F.col("w1") - F.col("w0") >= passage_words).withColumnRenamed("kept", "kept_ids")
    exact = scratch.save(exact, "exact")
    scratch.drop("shared", "places", "windows")

    both = scratch.save(_lines(rows, shingle, line_words, buckets), "lines")
    lines = both.where("bucket is null").select("key", "n", "doc", "w0", "w1", "b0", "b1")
    found = scratch.save(_meet(both.where("bucket is not null").select("bucket", "hot", "codes", "counts", "classes", "sizes"), percent), "found")
    roots = linked_roots(spark, scratch, found, _LineTexts(scratch, rows, lines, shingle, line_words), percent)
    alike = lines.join(_near_by(roots.withColumnRenamed("node", "key")), "key")
    kept = scratch.save(alike.groupBy("root").agg(F.min("doc").alias("kept")), "kept")
    near = alike.join(_near_by(kept), "root").where("doc != kept").select("doc", "w0", "w1", "b0", "b1", F.array("kept").alias("kept_ids")).where(F.col("w1") - F.col("w0") >= passage_words)

    both = exact.withColumn("kind", F.lit("exact")).unionByName(near.withColumn("kind", F.lit("near")))
    result = scratch.save(both.select(F.col("doc").alias(id_col), "kind", F.col("w0").alias("first_word"), (F.col("w1") - F.col("w0")).alias("n_words"), F.col("b0").alias("first_byte"), (F.col("b1") - F.col("b0")).alias("n_bytes"), "kept_ids"), "result")
    scratch.drop("exact", "lines", "found", "roots", "kept")
    return result


def remove_passages(docs: DataFrame, passages: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the passages cut out of their texts, and the blanks before each; all other columns and rows stay."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, spans = (batch.schema.get_field_index(x) for x in (text_col, "__spans"))
            texts = batch.column(at).to_pylist()
            for i, own in enumerate(batch.column(spans).to_pylist()):
                if own and texts[i] is not None:
                    data, out, done = texts[i].encode(), [], 0
                    for s in sorted(own, key=lambda s: s["b0"]):
                        if s["b0"] > done:
                            out.append(data[done : s["b0"]].rstrip())
                        done = max(done, s["b1"])
                    texts[i] = (b"".join(out) + data[done:]).decode().strip()
            kept = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(batch.num_columns) if i != spans]
            yield pa.RecordBatch.from_arrays(kept, [x for i, x in enumerate(batch.schema.names) if i != spans])

    few = passages.count() <= BROADCAST_PASSAGES
    spans = passages.groupBy(F.col(id_col).alias("__id")).agg(F.collect_list(F.struct(F.col("first_byte").alias("b0"), (F.col("first_byte") + F.col("n_bytes")).alias("b1"))).alias("__spans"))
    joined = docs.join(F.broadcast(spans) if few else spans.hint("merge"), docs[id_col] == spans["__id"], "left").drop("__id")
    return joined.mapInArrow(cut, docs.schema)
