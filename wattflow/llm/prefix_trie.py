"""The trie of conversations that begin alike, as intervals of preorder ranks.

A node is known by a 128-bit fingerprint of its turns. Distinct nodes are ranked lexicographically (turns compare by
their fingerprints): a node's rank is the sum, over the turns that lead to it, of one and the sizes of the subtrees of
earlier siblings. A subtree is then the interval from its node's rank to rank + size, and what it holds of leaves and
savings is the difference of two sums over all nodes in order of rank.

Every step is a sum in a global order (``running_sums``) or a grouping that combines before it shuffles: a conversation,
a first turn or a group of copies of any size spans as many tasks as its rows need. No row holds a whole conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scan import running_sums
from .scratch import Scratch

NODE = ["n1", "n2"]
#: Own turns are joined with their conversation in lots of so many turns.
LOT_TURNS = 4096
#: Numbers of conversations that one row carries towards a digest.
LOT_ENDS = 4096


def crc32_of(number: Column) -> Column:
    return F.crc32(number.cast("string").cast("binary"))


def rebuilt(scratch: Scratch, conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", group: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations with the first turns of another: turns (conv, pos from 1, f1, f2, points, last) and conversations (conv, length).

    Conversation c takes the first h turns of c - c % group, h being the CRC-32 of c in decimal modulo most, and goes on
    with its own turns after its first h. f1 and f2 are fingerprints of role and text, points the text's code points,
    last is 1 for a conversation's last turn.
    """
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = conversations.select(F.col(id_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text")).where("conv is not null")
    rows = rows.withColumns({"f1": F.xxhash64("role", "text"), "f2": F.xxhash64("text", "role"), "points": F.char_length("text").cast("long"), "one": F.lit(1).cast("long")})
    turns = running_sums(scratch, rows, "turns", ["conv"], ["turn", "role", "text"], ["one"], ["conv", "f1", "f2", "points"]).drop("one_before").withColumnRenamed("one_to", "pos")

    h = (crc32_of(F.col("conv")) % most).cast("long")
    own = turns.groupBy("conv").agg(F.max("pos").alias("n")).withColumns({"h": h, "base": F.col("conv") - F.col("conv") % group})
    own = scratch.save(own, "own")
    taken = F.least("h", F.coalesce("n_base", F.lit(0).cast("long")))
    convs = own.join(own.select(F.col("conv").alias("base"), F.col("n").alias("n_base")), "base", "left").withColumn("taken", taken)
    convs = scratch.save(convs.withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "convs")

    heads = turns.where(F.col("pos") < most).select(F.col("conv").alias("base"), "pos", "f1", "f2", "points")
    lent = convs.where("taken > 0").select("conv", "base", "taken", "length").join(heads, "base").where("pos <= taken")
    lots = convs.where("n > h").select("conv", "taken", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / LOT_TURNS))).alias("lot"))
    kept = turns.where(F.col("pos") > h).withColumns({"lot": F.floor(F.col("pos") / LOT_TURNS), "h": h}).join(lots, ["conv", "lot"]).withColumn("pos", F.col("pos") - F.col("h") + F.col("taken"))
    names = ["conv", "pos", "f1", "f2", "points", (F.col("pos") == F.col("length")).cast("long").alias("last")]
    both = scratch.save(lent.select(*names).unionByName(kept.select(*names)), "rebuilt")
    scratch.drop("turns")
    return both, convs.select("conv", "length")


def _digests(scratch: Scratch, ends: DataFrame) -> DataFrame:
    """n1, n2 and the SHA-256 of the numbers conv, in order and joined by commas, of each node that has any.

    Numbers are joined to lots in parallel; one task then only feeds a node's lots to the digest, one after another.
    """
    dealt = ends.repartitionByRange(*NODE, "conv").sortWithinPartitions(*NODE, "conv")

    def lots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, at = [], None
            for a, b, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if at != (a, b) or len(out[-1][3]) >= LOT_ENDS:
                    at = (a, b)
                    out.append((a, b, c, []))
                out[-1][3].append(str(c))
            yield pa.RecordBatch.from_pydict({"n1": pa.array([x[0] for x in out], pa.int64()), "n2": pa.array([x[1] for x in out], pa.int64()), "conv": pa.array([x[2] for x in out], pa.int64()), "part": pa.array([",".join(x[3]) for x in out], pa.string())})

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            done = []
            for a, b, part in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
                if at == (a, b):
                    state.update(b"," + part.encode())
                else:
                    if at is not None:
                        done.append((*at, state.hexdigest()))
                    at, state = (a, b), hashlib.sha256(part.encode())
            yield pa.RecordBatch.from_pydict(_columns(done))
        if at is not None:
            yield pa.RecordBatch.from_pydict(_columns([(*at, state.hexdigest())]))

    joined = scratch.save(dealt.select(*NODE, "conv").mapInArrow(lots, "n1 long, n2 long, conv long, part string"), "lots")
    return joined.repartition(*NODE).sortWithinPartitions(*NODE, "conv").mapInArrow(digest, "n1 long, n2 long, ends_sha256 string")


def _columns(rows: list[tuple[int, int, str]]) -> dict:
    return {"n1": pa.array([r[0] for r in rows], pa.int64()), "n2": pa.array([r[1] for r in rows], pa.int64()), "ends_sha256": pa.array([r[2] for r in rows], pa.string())}


def prefix_trie(spark: SparkSession, conversations: DataFrame, **how) -> DataFrame:
    """A row for each distinct sequence of first turns of the rebuilt conversations (``how``: see ``rebuilt``).

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, and the
    interval of the node's subtree: rank (0 for the root) and rank_end, one past its last node. Null roles and texts are
    empty, turns without a number come first, and turns with one number are ordered by role, then text; rows that repeat
    are turns of their own. Rows without a conversation's number are left out; numbers are integers. A conversation
    that has no turn left is a member of the root only. An empty table has no nodes. Other columns are not read.
    """
    scratch, zero = Scratch(spark, "trie"), F.lit(0).cast("long")
    turns, convs = rebuilt(scratch, conversations, **how)
    n_convs, least = convs.agg(F.count("*"), F.min("conv")).first()

    # Nodes: the fingerprint of a prefix is a sum over its turns.
    marked = turns.withColumns({"g1": F.xxhash64("pos", "f1", "f2"), "g2": F.xxhash64("f2", "f1", "pos"), "one": F.lit(1).cast("long")})
    placed = running_sums(scratch, marked, "placed", ["conv"], ["pos"], ["g1", "g2"], ["conv", "pos", "f1", "f2", "points", "last", "one"])
    named = placed.withColumnsRenamed({"g1_to": "n1", "g2_to": "n2", "g1_before": "p1", "g2_before": "p2"})
    members = running_sums(scratch, named, "members", NODE, ["conv"], ["one"], ["conv", "pos", *NODE, "p1", "p2", "f1", "f2", "points", "last"])
    members = members.withColumn("new", (F.col("one_to") == 1).cast("long")).drop("one_to", "one_before")  # 1 in the node's smallest member
    # A member adds to a node's subtree the nodes from there on that it is the smallest member of.
    members = running_sums(scratch, members.withColumn("back", -F.col("pos")), "suffixes", ["conv"], ["back"], ["new"], ["conv", "pos", *NODE, "p1", "p2", "f1", "f2", "points", "last", "new"]).drop("new_before")
    same = [F.first(c).alias(c) for c in ("pos", "p1", "p2", "f1", "f2", "points")]
    nodes = scratch.save(members.groupBy(*NODE).agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.sum("new_to").alias("size"), *same), "nodes")
    scratch.drop("rebuilt", "placed", "members")

    # Siblings in order: the sizes before each, and the parent's smallest member, who stands first.
    root = spark.range(0 if least is None else 1).select(zero.alias("n1"), zero.alias("n2"), F.lit(least).cast("long").alias("conv_id"))
    tops = nodes.select(*NODE, "conv_id").unionByName(root).select(F.col("n1").alias("p1"), F.col("n2").alias("p2"), F.lit(0).alias("kind"), zero.alias("f1"), zero.alias("f2"), zero.alias("n1"), zero.alias("n2"), zero.alias("size"), F.col("conv_id").alias("parent"))
    kin = tops.unionByName(nodes.select("p1", "p2", F.lit(1).alias("kind"), "f1", "f2", *NODE, "size", zero.alias("parent")))
    kin = running_sums(scratch, kin, "kin", ["p1", "p2"], ["kind", "f1", "f2", *NODE], ["size", "parent"], [*NODE, "kind"]).where("kind = 1")
    kin = kin.select(*NODE, (F.col("size_before") + 1).alias("offset"), F.col("parent_to").alias("parent_conv_id"))
    children = nodes.groupBy(F.col("p1").alias("n1"), F.col("p2").alias("n2")).agg(F.count("*").alias("n_children"))
    nodes = scratch.save(nodes.select(*NODE, "conv_id", "n_convs", "size", "points", F.col("pos").alias("depth")).join(kin, NODE).join(children, NODE, "left").na.fill(0, ["n_children"]), "kinned")
    scratch.drop("nodes", "kin")

    # Ranks: offsets go from the smallest member to all members, then add up along each conversation.
    news = members.where("new = 1").select("conv", "pos", *NODE, "new").join(nodes.select(*NODE, "offset"), NODE)
    filled = news.unionByName(members.where("new = 0").select("conv", "pos", *NODE, "new", zero.alias("offset")))
    filled = running_sums(scratch, filled, "filled", NODE, ["conv"], ["offset"], ["conv", "pos", *NODE, "new"]).drop("offset_before").withColumnRenamed("offset_to", "offset")
    ranked = running_sums(scratch, filled, "ranked", ["conv"], ["pos"], ["offset"], [*NODE, "new"]).where("new = 1").select(*NODE, F.col("offset_to").alias("rank"))
    nodes = nodes.drop("offset").join(ranked, NODE)
    first = convs.agg(F.lit(n_convs).cast("long").alias("n_convs")).where(F.lit(least is not None))
    n_nodes = scratch.save(nodes, "numbered").count()
    nodes = spark.read.parquet(f"{scratch.path}/numbered")
    below = F.lit(nodes.where("depth = 1").count()).cast("long")
    top = first.select(zero.alias("n1"), zero.alias("n2"), F.lit(least).cast("long").alias("conv_id"), "n_convs", F.lit(n_nodes + 1).cast("long").alias("size"), zero.alias("points"), zero.alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), below.alias("n_children"), zero.alias("rank"))
    nodes = scratch.save(nodes.unionByName(top), "ranked-nodes")
    scratch.drop("filled", "ranked", "kinned", "numbered")

    # Leaves and savings up to each rank; a subtree has what lies between its two ends.
    starts = nodes.select("rank", F.col("rank").alias("at"), F.lit(1).alias("kind"), (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("points")).alias("saved"))
    stops = nodes.select("rank", (F.col("rank") + F.col("size")).alias("at"), F.lit(0).alias("kind"), zero.alias("leaf"), zero.alias("saved"))
    sums = running_sums(scratch, starts.unionByName(stops).withColumn("all", zero), "sums", ["all"], ["at", "kind", "rank"], ["leaf", "saved"], ["rank", "kind"])
    sign = F.when(F.col("kind") == 0, 1).otherwise(-1)
    spans = sums.groupBy("rank").agg(F.sum(sign * F.col("leaf_before")).alias("n_leaves"), F.sum(sign * F.col("saved_before")).alias("saved_tokens"))

    ends = members.where("last = 1").select(*NODE, "conv").unionByName(convs.where("length = 0").select(zero.alias("n1"), zero.alias("n2"), "conv"))
    digests = scratch.save(_digests(scratch, ends), "digests")
    found = nodes.join(spans, "rank").join(digests, NODE, "left").withColumns({"ends_sha256": F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())), "rank_end": F.col("rank") + F.col("size")})
    result = scratch.save(found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "rank", "rank_end"), "result")
    scratch.drop("suffixes", "sums", "ranked-nodes", "lots", "digests")
    return result
