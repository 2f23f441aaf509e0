"""Exact join of texts whose sets of word shingles overlap by a Jaccard similarity or more.

Texts with equal sets are one class. Two classes can only link if they share one of the first few shingles of their
sets in a common order (as many as a linked set may lack, and one). The order is by fingerprint, but the most frequent
shingles of the corpus stand last, so that a passage that very many texts share is not what brings texts together.
Shingles so shared by few classes give pairs. Where many classes share one, each is paired with three of them. Pairs
that may link by the bit counts of hashed bitmap signatures, which bound the overlap from above, form groups. Of a group
that fits a tile all classes are compared by their sorted sets; of larger ones each class is, with its most paired
partner and what else that one draws, and then the pairs that this leaves open are. Classes that share a shingle and that all this leaves in different components meet in tiles of two blocks of classes in the same or
neighbouring size bands: first by signatures alone, then, where a partner is possible, by their sorted sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .components import connected_components
from .memory import lean
from .scratch import Scratch

SHINGLE = 5
PERCENT = 80
#: A shingle is a candidate for the frequent ones if a task sees it so often in one lot of shingles.
OFTEN = 4
LOT_SHINGLES = 4_000_000
#: So many of the most frequent shingles stand last in the order. This bounds a broadcast; the result does not depend on it.
FREQUENT = 131_072
#: Up to so many classes that share a shingle are paired directly.
FEW = 8
#: Classes in a block of a tile.
BLOCK = 512
#: Ids are broadcast up to this number, else joined by a shuffle.
BROADCAST_IDS = 2_000_000
POSTINGS_LOT = 500_000
#: Classes whose number of pairs is broadcast, where others are dealt by class.
MOST_HUBS = 20_000
#: Bits of a signature for sets of much the same size.
BITS = 2048
#: Bits for each shingle of a signature that is shuffled, made up to a power of two. Sets of a similarity under 0.6 rarely pass.
WIDE = 1
#: The same within a tile that has the sets.
SHARP = 16


def sets_of(texts: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingles of each text and where each set begins (n + 1 places)."""
    rolled, bounds = W.windows(W.words(*W.column_bytes(texts), W.BLANK_SEPARATED), shingle)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        rolled[a:b].sort()
    first = np.ones(len(rolled), bool)
    first[1:] = rolled[1:] != rolled[:-1]
    first[bounds[:-1][np.diff(bounds) > 0]] = True
    return rolled[first], np.concatenate([[0], np.cumsum(first)])[bounds]


def classes_of(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A fingerprint of each set."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(W.mix(values), dtype=np.uint64)])
    return W.mix(sums[bounds[1:]] - sums[bounds[:-1]] + np.diff(bounds).astype(np.uint64)).view(np.int64)


def _least(n: np.ndarray, percent: int) -> np.ndarray:
    """The overlap that a linked set of n has at least: ceil(n * percent / 100)."""
    return -(-n * percent // 100)


def linked(n_a, n_b, overlap, percent: int):
    return 100 * overlap >= percent * (n_a + n_b - overlap)


def signature(values: np.ndarray) -> np.ndarray:
    """A bitmap of BITS bits with a bit for each shingle, as 64-bit numbers."""
    bits = np.zeros(BITS, np.uint8)
    bits[(values >> np.uint64(20)).astype(np.int64) % BITS] = 1
    return np.packbits(bits).view(np.uint64)


def wide_signature(values: np.ndarray, wide: int = WIDE) -> np.ndarray:
    """The same with bits in proportion to the set; a longer one folds onto a shorter one."""
    n = max(64, 1 << (wide * max(1, len(values)) - 1).bit_length())
    bits = np.zeros(n, np.uint8)
    bits[((values >> np.uint64(20)) & np.uint64(n - 1)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.uint64)


def folded(signs: np.ndarray) -> np.ndarray:
    """Signatures (in rows) of half the bits."""
    half = signs.shape[-1] // 2
    return signs[..., :half] | signs[..., half:]


def overlap_bound(n_a, n_b, sig_a: np.ndarray, sig_b: np.ndarray):
    """At most so many shingles are common: each bit that only one signature has stands for one that the other set lacks."""
    return np.minimum(n_a - np.bitwise_count(sig_a & ~sig_b).sum(-1, dtype=np.int64), n_b - np.bitwise_count(sig_b & ~sig_a).sum(-1, dtype=np.int64))


def _survey(docs: DataFrame, shingle: int) -> DataFrame:
    """Rows of kind 0: id, n, class and key of each text; of kind 1: shingles that a task saw often, with the number of texts."""

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lot, size = [], 0

        def often() -> pa.RecordBatch:
            values = np.concatenate(lot)
            lot.clear()
            values.sort()
            begins = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
            counts = np.diff(np.append(begins, len(values)))
            begins, counts = begins[counts >= OFTEN], counts[counts >= OFTEN]
            values = values[begins]
            n = len(values)
            return pa.RecordBatch.from_arrays([pa.array(np.ones(n, np.int32)), pa.nulls(n, pa.int64()), pa.array(counts.astype(np.int64)), pa.array(values.view(np.int64)), pa.nulls(n, pa.int64())], names)

        for batch in batches:
            for piece in W.pieces(batch, "text"):
                values, bounds = sets_of(piece.column(1), shingle)
                sizes = np.diff(bounds)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(sizes), np.int32)), piece.column(0), pa.array(sizes), pa.array(classes_of(values, bounds), mask=sizes == 0), piece.column(2)], names)
                lot.append(values)
                size += len(values)
                if size >= LOT_SHINGLES:
                    yield often()
                    size = 0
        if size:
            yield often()

    names = ["kind", "id", "n", "code", "key"]
    return docs.mapInArrow(survey, "kind int, id long, n long, code long, key long")


def _isin(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are among a sorted array; most are not, which a small table of low bits tells quickly."""
    out = np.zeros(len(values), bool)
    if len(known):
        hint = np.zeros(1 << 20, bool)
        hint[(known & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        maybe = np.flatnonzero(hint[(values & np.uint64((1 << 20) - 1)).astype(np.int64)])
        out[maybe] = known[np.minimum(np.searchsorted(known, values[maybe]), len(known) - 1)] == values[maybe]
    return out


def prefixes(values: np.ndarray, bounds: np.ndarray, frequent: np.ndarray, percent: int) -> np.ndarray:
    """Which shingles stand so early in their set's order that two linked sets must share one of them."""
    sizes = np.diff(bounds)
    take = np.where(sizes > 0, sizes - _least(sizes, percent) + 1, 0)
    late = _isin(values, frequent)
    sums = np.concatenate([[0], np.cumsum(~late)])
    early_n = sums[bounds[1:]] - sums[bounds[:-1]]
    early_rank = sums[:-1] - np.repeat(sums[bounds[:-1]], sizes)
    late_rank = np.arange(len(values)) - np.repeat(bounds[:-1], sizes) - early_rank
    return np.where(late, late_rank < np.repeat(np.maximum(take - early_n, 0), sizes), early_rank < np.repeat(take, sizes))


POSTINGS = "bucket int, hot boolean, codes binary, counts binary, classes binary, sizes binary"


def _postings(docs: DataFrame, frequent, shingle: int, percent: int, buckets: int) -> DataFrame:
    """Prefix shingles by bucket: for each class its size and how many of the codes are its own.

    A frequent shingle's rows are spread over all buckets, with whole codes. Of the others a bucket tells codes by 32
    bits; the few that so look alike are compared in vain.
    """

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = frequent.value
        lot, size, owners = [], 0, 0

        def packed() -> Iterator[pa.RecordBatch]:
            codes, owner, classes, sizes = (np.concatenate(x) for x in zip(*lot, strict=True))
            hot = _isin(codes, often)
            spread = np.where(hot, W.mix(codes ^ classes[owner].view(np.uint64)), codes)
            bucket = ((spread >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((owner, hot, bucket))
            bucket, codes, owner, hot = bucket[order], codes[order], owner[order], hot[order]
            new = np.ones(len(bucket), bool)
            new[1:] = (bucket[1:] != bucket[:-1]) | (hot[1:] != hot[:-1])
            runs = np.flatnonzero(new | (np.diff(owner, prepend=-1) != 0))
            counts, of = np.diff(np.append(runs, len(bucket))).astype(np.uint32), owner[runs]
            first = np.flatnonzero(new)
            out: list[list[bytes]] = [[], [], [], []]
            for a, b, i, j in zip(first, [*first[1:], len(bucket)], *(np.searchsorted(runs, x) for x in (first, [*first[1:], len(bucket)])), strict=True):
                own = codes[a:b] if hot[a] else codes[a:b].astype(np.uint32)
                for column, data in zip(out, (own, counts[i:j], classes[of[i:j]], sizes[of[i:j]]), strict=True):
                    column.append(data.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(bucket[first].astype(np.int32)), pa.array(hot[first]), *(pa.array(x, pa.binary()) for x in out)], ["bucket", "hot", "codes", "counts", "classes", "sizes"])

        for batch in batches:
            for piece in W.pieces(batch, "text"):
                values, bounds = sets_of(piece.column(1), shingle)
                keep = prefixes(values, bounds, often, percent)
                classes, sizes = classes_of(values, bounds), np.diff(bounds)
                new = np.zeros(len(classes), bool)
                new[np.unique(classes, return_index=True)[1]] = True  # copies in this piece give the same rows
                keep &= np.repeat(new, sizes)
                lot.append((values[keep], np.repeat(np.arange(owners, owners + len(sizes)), sizes)[keep], classes, sizes.astype(np.uint32)))
                size, owners = size + int(keep.sum()), owners + len(sizes)
                if size >= POSTINGS_LOT:
                    yield from packed()
                    lot, size, owners = [], 0, 0
        if size:
            yield from packed()

    return docs.select("id", "text").mapInArrow(post, POSTINGS)


FOUND = "kind int, a long, b long, n_a long, n_b long"


def _meet(postings: DataFrame, percent: int) -> DataFrame:
    """Rows of kind 0: pairs of classes that share a shingle with few others; of kind 1: shingle (a), class (b) and size (n_b) where many do, and of kind 2: the same of frequent shingles."""

    def rows_of(table: pa.Table, kind: type) -> tuple[np.ndarray, ...]:
        joined = [np.frombuffer(b"".join(table.column(c).to_pylist()), k) for c, k in (("codes", kind), ("counts", np.uint32), ("classes", np.int64), ("sizes", np.uint32))]
        codes, classes, sizes = joined[0].astype(np.int64), np.repeat(joined[2], joined[1]), np.repeat(joined[3], joined[1]).astype(np.int64)
        order = np.lexsort((classes, sizes, codes))
        codes, classes, sizes = codes[order], classes[order], sizes[order]
        new = np.ones(len(codes), bool)
        new[1:] = (codes[1:] != codes[:-1]) | (classes[1:] != classes[:-1])
        return codes[new], classes[new], sizes[new]

    def meet(table: pa.Table) -> pa.Table:
        hot = np.array(table.column("hot").to_pylist(), bool)
        codes, classes, sizes = rows_of(table.filter(pa.array(~hot)), np.uint32)
        starts = np.flatnonzero(np.diff(codes, prepend=-1))
        stops = np.append(starts[1:], len(codes)) if len(starts) else starts
        group = np.repeat(stops - starts, stops - starts)
        # Of codes with the same classes, which copies have in great number, one stands for all.
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(W.mix(classes.view(np.uint64)), dtype=np.uint64)])
        same = np.stack([(sums[stops] - sums[starts]).view(np.int64), stops - starts])
        fresh = np.zeros(len(starts), bool)
        if len(starts):
            fresh[np.unique(same, axis=1, return_index=True)[1]] = True
        many = (group > FEW) & np.repeat(fresh, stops - starts)
        some = (group > 1) & (group <= FEW)
        c, k, n = codes[some], classes[some], sizes[some]
        pairs = []
        for step in range(1, FEW):
            if step >= len(c):
                break
            at = np.flatnonzero((c[step:] == c[:-step]) & (100 * n[:-step] >= percent * n[step:]))
            if not len(at):
                continue
            flip = k[at] > k[at + step]
            pairs.append(np.stack([np.where(flip, k[at + step], k[at]), np.where(flip, k[at], k[at + step]), np.where(flip, n[at + step], n[at]), np.where(flip, n[at], n[at + step])]))
        both = np.unique(np.concatenate(pairs, axis=1), axis=1) if pairs else np.zeros((4, 0), np.int64)
        named = codes[many] | np.int64(table.column("bucket")[0].as_py()) << 32
        shared = [(named, classes[many], sizes[many]), rows_of(table.filter(pa.array(hot)), np.int64)]
        rows = [np.vstack([np.zeros((1, both.shape[1]), np.int64), both])]
        rows += [np.stack([np.full(len(a), kind), a, b, np.zeros(len(a), np.int64), n]) for kind, (a, b, n) in enumerate(shared, 1)]
        rows = np.concatenate(rows, axis=1)
        return pa.table([pa.array(rows[0].astype(np.int32)), *(pa.array(x) for x in rows[1:])], ["kind", "a", "b", "n_a", "n_b"])

    return postings.groupBy("bucket").applyInArrow(lean(meet), FOUND)


def _with_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose id is in ids (saved): by broadcast where there are few, else by a shuffle."""
    few = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids.hint("merge"), "id", "left_semi")


def _built(docs: DataFrame, shingle: int, made: dict) -> DataFrame:
    """class, n and, by the functions given, binary columns of the sorted set of each text."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in W.pieces(batch, "text"):
                values, bounds = sets_of(piece.column(1), shingle)
                data = [[f(values[a:b]).tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] for f in made.values()]
                yield pa.RecordBatch.from_arrays([pa.array(classes_of(values, bounds)), pa.array(np.diff(bounds)), *(pa.array(x, pa.binary()) for x in data)], ["class", "n", *made])

    return docs.select("id", "text").mapInArrow(build, "class long, n long" + "".join(f", {x} binary" for x in made))


SET = {"set": lambda values: values}


def _hubs(possible: DataFrame, large: DataFrame) -> DataFrame:
    """Tiles (code, class) for the classes of large groups: each with its partner of most pairs, a partner's many classes in several tiles."""
    pairs = possible.join(_near_by(large.select(F.col("class").alias("a"))), "a", "left_semi")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degrees = both.groupBy("b").agg(F.count("*").alias("degree"))
    # Degrees of the classes with the most pairs, fewer than MOST_HUBS by what they sum up to, are broadcast; no key of the others is long.
    most = F.lit(both.count() / MOST_HUBS)
    top = F.broadcast(degrees.where(F.col("degree") > most))
    with_degree = both.join(top, "b").unionByName(both.join(top, "b", "left_anti").join(degrees.where(F.col("degree") <= most), "b"))
    own = with_degree.groupBy("a").agg(F.max(F.struct("degree", "b")).alias("hub"))
    own = own.select(F.col("a").alias("class"), F.col("hub.b").alias("hub"), F.pmod(F.xxhash64("a"), F.ceil(F.col("hub.degree") / F.lit(BLOCK))).alias("salt"))
    tiles = own.unionByName(own.select(F.col("hub").alias("class"), "hub", "salt").distinct())
    return tiles.select(F.xxhash64("hub", "salt").alias("code"), "class").distinct()


class _Texts:
    """Finds a text of each of some classes again. Classes that only rows without an id have are told by the class itself."""

    def __init__(self, scratch: Scratch, rows: DataFrame, members: DataFrame, shingle: int):
        self.scratch, self.rows, self.shingle = scratch, rows, shingle
        named = members.where("class is not null").groupBy("class").agg(F.min("id").alias("least"))
        self.first = scratch.save(named, "first")
        self.nameless = not self.first.where("least is null").isEmpty()

    def built(self, classes: DataFrame, name: str, made: dict) -> DataFrame:
        """_built of a text of each of the classes (distinct). A class that two rows of one id have stands twice, to no effect."""
        wanted = self.scratch.save(classes.join(self.first, "class"), name)
        found = _built(_with_ids(self.rows, wanted.where("least is not null").select(F.col("least").alias("id"))), self.shingle, made)
        if self.nameless:
            without = _built(self.rows.where("id is null"), self.shingle, made).join(wanted.where("least is null").select("class"), "class", "left_semi")
            found = found.unionByName(without.dropDuplicates(["class"]))
        return found


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())


def _near_by(table: DataFrame) -> DataFrame:
    """A saved table to join with: by broadcast where its rows are few, else by a shuffle."""
    return F.broadcast(table) if table.count() <= BROADCAST_IDS else table.hint("merge")


def _both(pairs: DataFrame, sets: DataFrame, column: str) -> DataFrame:
    """The pairs with n and a column of each side."""
    side = lambda c: sets.select(F.col("class").alias(c), F.col("n").alias(f"n_{c}"), F.col(column).alias(f"x_{c}")).hint("merge")
    return pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "x_a", "x_b")


def _possible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that may link by their signatures."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b = (batch.column(i).to_numpy() for i in (2, 3))
            signs = [[np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(i)] for i in (4, 5)]
            lengths = np.array([[len(x) for x in own] for own in signs], np.int64).reshape(2, -1)
            keep = np.zeros(batch.num_rows, bool)
            for la, lb in np.unique(lengths, axis=1).T.tolist() if batch.num_rows else []:
                own = np.flatnonzero((lengths[0] == la) & (lengths[1] == lb))
                a, b = (np.stack([x[k] for k in own]) for x in signs)
                while a.shape[1] > b.shape[1]:
                    a = folded(a)
                while b.shape[1] > a.shape[1]:
                    b = folded(b)
                keep[own] = linked(n_a[own], n_b[own], overlap_bound(n_a[own], n_b[own], a, b), percent)
            kept = batch.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays(kept.columns[:2], ["a", "b"])

    return _both(pairs, sets, "sign").mapInArrow(check, "a long, b long")


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that link, by exact intersection."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(4), batch.column(5), strict=True):
                u, v = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                keep.append(linked(len(u), len(v), overlap(u, v), percent))
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays(kept.columns[:2], ["a", "b"])

    return _both(pairs, sets, "set").mapInArrow(check, "a long, b long")


def _within(groups: DataFrame, percent: int) -> DataFrame:
    """Links of each group (code, class, set), as few as join what they join."""

    def within(table: pa.Table) -> pa.Table:
        classes, first = np.unique(table.column("class").to_numpy(), return_index=True)
        table = table.take(pa.array(first))
        ones = pa.array(np.ones(len(classes), bool))
        return compare_sets(pa.table([table.column("class"), table.column("class"), table.column("set"), ones, ones], ["class", "root", "set", "left", "right"]), percent)

    return groups.select("code", "class", "set").groupBy("code").applyInArrow(within, "a long, b long")


def _tiles(rows: DataFrame) -> DataFrame:
    """Rows of (code, class, n, root), each in every tile where it meets classes of its own or the neighbouring size bands. A group that fits a block is one tile."""
    small = rows.groupBy("code").agg((F.count("*") <= BLOCK).alias("small"))
    band = F.when(F.col("small"), 0).otherwise(F.floor(F.log("n") / F.log(F.lit(1.25)))).cast("int")
    banded = rows.join(small, "code").withColumn("band", band).drop("small")
    blocks = banded.groupBy("code", "band").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    near = [blocks.select("code", (F.col("band") + d).alias("band"), F.col("blocks").alias(name)) for d, name in ((1, "lower"), (-1, "upper"))]
    sized = banded.join(blocks, ["code", "band"]).join(near[0], ["code", "band"], "left").join(near[1], ["code", "band"], "left")
    own = sized.withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    key = lambda b1, k1, b2, k2: F.struct(b1.alias("band_1"), k1.alias("block_1"), b2.alias("band_2"), k2.alias("block_2"))
    upto = lambda c: F.when(F.coalesce(c, F.lit(0)) > 0, F.sequence(F.lit(0), c - 1)).otherwise(F.array().cast("array<int>"))
    band, block = F.col("band"), F.col("block")
    same = F.transform(upto(F.col("blocks")), lambda i: key(band, F.least(i, block), band, F.greatest(i, block)))
    below = F.transform(upto(F.col("lower")), lambda i: key(band - 1, i, band, block))
    above = F.transform(upto(F.col("upper")), lambda i: key(band, block, band + 1, i))
    return own.select("code", "class", "root", "band", "block", F.explode(F.concat(same, below, above)).alias("tile")).select("code", "tile.*", "class", "root", (F.struct("band", "block") == F.struct("tile.band_1", "tile.block_1")).alias("left"), (F.struct("band", "block") == F.struct("tile.band_2", "tile.block_2")).alias("right"))


def _forest(table: pa.Table, partners, by_root: bool) -> pa.Table:
    """Pairs of classes of different components in a tile that partners(i, others) finds, as few as join what they join.

    By root, a pair joins the whole components of its classes; else only the two classes, as for pairs that may turn
    out not to link and so must not stand for other pairs of their components.
    """
    classes, roots = table.column("class").to_numpy(), table.column("root").to_numpy()
    now = roots.copy() if by_root else np.unique(classes, return_inverse=True)[1]
    right = np.flatnonzero(table.column("right").to_numpy(zero_copy_only=False))
    a, b = [], []
    for i in np.flatnonzero(table.column("left").to_numpy(zero_copy_only=False)):
        for j in partners(i, right[(roots[right] != roots[i]) & (now[right] != now[i])]):
            if now[i] != now[j]:
                a.append(classes[i])
                b.append(classes[j])
                now[now == now[j]] = now[i]
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


TILE = ["code", "band_1", "block_1", "band_2", "block_2"]


class Signed:
    """The wide signatures of the sets of a tile."""

    def __init__(self, sizes: np.ndarray, data: list[np.ndarray]):
        self.sizes, self.lengths = sizes, np.array([len(x) for x in data], np.int64)
        self.at, self.signs, self.halves = np.zeros(len(data), np.int64), {}, {}
        for length in np.unique(self.lengths).tolist():
            own = np.flatnonzero(self.lengths == length)
            self.at[own] = np.arange(len(own))
            self.signs[length] = np.stack([data[k] for k in own])
            self.halves[length] = folded(self.signs[length])

    def possible(self, i: int, others: np.ndarray, percent: int) -> np.ndarray:
        """Those of the others that may link with i. Sets of so different sizes that their signatures lie more than a fold apart cannot."""
        sizes = self.sizes
        others = others[linked(sizes[i], sizes[others], np.minimum(sizes[i], sizes[others]), percent)]
        length, found = int(self.lengths[i]), []
        for other, mine, theirs in ((length, self.signs, self.signs), (2 * length, self.signs, self.halves), (length // 2, self.halves, self.signs)):
            own = others[self.lengths[others] == other]
            if len(own):
                bound = overlap_bound(sizes[i], sizes[own], mine[length][self.at[i]], theirs[other][self.at[own]])
                found.append(own[linked(sizes[i], sizes[own], bound, percent)])
        rest = others[(self.lengths[others] > 2 * length) | (2 * self.lengths[others] < length)]  # none at 50 percent or more
        return np.concatenate([*found, rest]) if found else rest


def _near_tiles(tiles: DataFrame, percent: int) -> DataFrame:
    """Pairs of each tile (with columns n and wide) that join all that may link by their signatures."""

    def near(table: pa.Table) -> pa.Table:
        signed = Signed(table.column("n").to_numpy(), [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("wide")])
        return _forest(table, lambda i, others: signed.possible(i, others, percent), by_root=False)

    return tiles.groupBy(*TILE).applyInArrow(near, "a long, b long")


def compare_sets(table: pa.Table, percent: int) -> pa.Table:
    """Links between classes of different roots in a tile (with column set), as few as join what they join."""
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("set")]
    sizes = np.array([len(x) for x in sets])
    signed = Signed(sizes, [wide_signature(x, SHARP) for x in sets])

    def partners(i: int, others: np.ndarray) -> Iterator[int]:
        return (j for j in signed.possible(i, others, percent) if linked(sizes[i], sizes[j], overlap(sets[i], sets[j]), percent))

    return _forest(table, partners, by_root=True)


def _compare(tiles: DataFrame, percent: int) -> DataFrame:
    """Links of each tile (with column set), as few as join what they join."""
    return tiles.groupBy(*TILE).applyInArrow(lambda table: compare_sets(table, percent), "a long, b long")


def linked_roots(spark: SparkSession, scratch: Scratch, found: DataFrame, texts, percent: int) -> DataFrame:
    """node, root for each class that links with another, of the classes that found (_meet's rows, saved) brings together. texts.built gives the sets of classes."""
    many = found.where("kind > 0").select(F.col("a").alias("code"), F.col("b").alias("class"), F.col("n_b").alias("n"), (F.col("kind") == 2).alias("hot"))
    seeds = [F.min_by(F.struct("class", "n"), F.struct(F.xxhash64(F.lit(k), "class"), "class")) for k in range(3)]
    leaders = many.groupBy("hot", "code").agg(F.array_distinct(F.array(*seeds)).alias("leaders"))
    near_by = F.broadcast(leaders.where("hot").drop("hot"))  # at most FREQUENT rows
    starred = many.where("hot").join(near_by, "code").unionByName(many.where("not hot").join(leaders.where("not hot").drop("hot"), "code"))
    starred = starred.select("class", "n", F.explode("leaders").alias("l")).where(f"l.class != class and 100 * least(n, l.n) >= {int(percent)} * greatest(n, l.n)")
    pairs = scratch.save(found.where("kind = 0").select("a", "b").unionByName(starred.select(F.least("class", "l.class").alias("a"), F.greatest("class", "l.class").alias("b"))).distinct(), "pairs")

    signs = scratch.save(texts.built(pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct(), "paired", {"sign": wide_signature}), "signs")
    possible = scratch.save(_possible(pairs, signs, percent), "possible")
    scratch.drop("signs", "paired", "pairs")
    groups = scratch.save(connected_components(spark, possible).select(F.col("node").alias("class"), F.col("root").alias("code")), "possible-groups")
    sizes = scratch.save(groups.groupBy("code").agg(F.count("*").alias("size")), "possible-sizes")
    small = scratch.save(groups.join(_near_by(sizes.where(F.col("size") <= BLOCK).select("code")), "code"), "small")
    large = scratch.save(groups.join(_near_by(sizes.where(F.col("size") > BLOCK).select("code")), "code"), "large")
    tiles = small.select("code", "class")
    if not large.isEmpty():
        tiles = scratch.save(tiles.unionByName(_hubs(possible, large)), "tiles")
    sets = texts.built(tiles.select("class").distinct(), "in-groups", SET)
    links = scratch.save(_within(sets.join(_near_by(tiles), "class"), percent), "tile-links")
    settled = small.select("class", F.col("code").alias("root"))  # classes of a small group have all been compared
    if not large.isEmpty():  # of larger ones the pairs that the tiles leave open follow
        roots = scratch.save(connected_components(spark, links), "first-roots").join(_near_by(large.select(F.col("class").alias("node"))), "node", "left_semi")
        side = lambda c: _near_by(roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")))
        pairs = possible.join(_near_by(large.select(F.col("class").alias("a"))), "a", "left_semi").join(side("a"), "a", "left").join(side("b"), "b", "left")
        pairs = scratch.save(pairs.where("not coalesce(root_a, a) <=> coalesce(root_b, b)").select("a", "b"), "open-pairs")
        sets = scratch.save(texts.built(pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct(), "in-pairs", SET), "sets")
        links = scratch.save(links.unionByName(_verify(pairs, sets, percent)), "links")
        settled = settled.unionByName(roots.select(F.col("node").alias("class"), "root"))
        scratch.drop("sets", "open-pairs", "in-pairs")

    joined = many.drop("hot").join(_near_by(scratch.save(settled, "settled")), "class", "left").withColumn("root", F.coalesce("root", "class"))
    # A code stands for all codes with the same classes.
    whole = joined.groupBy("code").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"), F.sum(F.xxhash64("class").cast("decimal(38,0)")).alias("sum")).where("low != high")
    open_codes = scratch.save(whole.groupBy("n", "sum").agg(F.min("code").alias("code")).select("code"), "open-codes")
    unsettled = scratch.save(joined.join(_near_by(open_codes), "code", "left_semi"), "unsettled")
    if not unsettled.isEmpty():
        wide = texts.built(unsettled.select("class").distinct(), "in-tiles", {"wide": wide_signature})
        near = scratch.save(_near_tiles(_tiles(unsettled).join(wide, "class"), percent), "near")
        if not near.isEmpty():
            close = connected_components(spark, near).select(F.col("node").alias("class"), F.col("root").alias("code"))
            close = scratch.save(close.join(unsettled.select("class", "n").distinct(), "class").withColumn("root", F.col("class")), "close")
            sets = texts.built(close.select("class").distinct(), "in-close", SET).drop("n")
            links = scratch.save(links.unionByName(_compare(_tiles(close).join(sets, "class"), percent)), "all-links")
    roots = scratch.save(connected_components(spark, links), "roots")
    scratch.drop("pairs", "possible", "possible-groups", "possible-sizes", "small", "large", "tiles", "in-groups", "tile-links", "first-roots", "links", "settled", "open-codes", "unsettled", "in-tiles", "near", "close", "in-close", "all-links")
    return roots


def near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row for each row of docs: id, n_shingles, component_id (the smallest id reachable by links).

    Words are told apart by blanks, A-Z in lower case. A text of fewer words than a shingle has one of all its words.
    Null texts and texts without words have no shingles, link with nothing and are their own component. Rows without an
    id take part in links but name no component unless all its rows lack one. Ids are integers; rows with equal ids
    are answered each. A text of any length is one row of one task. Other columns are not read. Two more columns tell
    rows of one id apart: text_key (xxhash64 of the text) and component_key (equal where rows are linked; null without
    shingles).
    """
    scratch = Scratch(spark, "jaccard")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("key"))
    survey = scratch.save(_survey(rows, shingle), "survey")
    members = survey.where("kind = 0").select("id", "n", F.col("code").alias("class"), "key")
    top = survey.where("kind = 1").groupBy("code").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "code").limit(FREQUENT).select("code").toArrow()
    frequent = spark.sparkContext.broadcast(np.sort(top.column(0).to_numpy().astype(np.int64).view(np.uint64)))

    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = scratch.save(_meet(_postings(rows, frequent, shingle, percent, buckets), percent), "found")
    texts = _Texts(scratch, rows, members, shingle)
    roots = linked_roots(spark, scratch, found, texts, percent)

    named = texts.first.join(_near_by(roots.withColumnRenamed("node", "class")), "class", "left").withColumn("root", F.coalesce("root", "class"))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = named.join(names, "root").select("class", "component_id", "root")
    answer = members.join(of_class, "class", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"), F.col("key").alias("text_key"), F.col("root").alias("component_key"))
    result = scratch.save(answer, "result")
    scratch.drop("survey", "found", "first", "roots")
    return result
