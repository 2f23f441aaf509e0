"""Connected components of a graph given as edges: forests of bounded lots of edges, then alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch

#: Edges that a task joins at once. It bounds a task's memory; the result does not depend on it.
LOT_EDGES = 1_000_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some edges and for each the least node that they join it with."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        u, v = root[u], root[v]
        apart = u != v
        if not apart.any():
            return nodes, nodes[root]
        u, v = u[apart], v[apart]
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while not np.array_equal(up := root[root], root):
            root = up


def _forests(edges: DataFrame, lots: int, lot_edges: int) -> DataFrame:
    """The edges (u, v) in so many tasks, each lot of them as stars around its least nodes; a node alone gives an edge to itself."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def joined() -> pa.RecordBatch:
            nodes, roots = forest(*(np.concatenate(x) for x in zip(*held, strict=True)))
            alone = np.bincount(np.searchsorted(nodes, roots), minlength=len(nodes)) == 1
            keep = (nodes != roots) | alone
            return pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(roots[keep])], ["u", "v"])

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            size += batch.num_rows
            if size >= lot_edges:
                yield joined()
                held, size = [], 0
        if size:
            yield joined()

    return edges.coalesce(lots).mapInArrow(join, "u long, v long")


def _to_least(pairs: DataFrame) -> DataFrame:
    """For each u with its neighbours v: the pairs (v, least of u and all v). The minimum is combined before the shuffle."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def _are_stars(edges: DataFrame) -> bool:
    """Whether each edge (u, v) leads from a leaf of its own to a centre that is no leaf."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("leaf")), F.struct(F.col("v").alias("node"), F.lit(0).alias("leaf")))).alias("e")).select("e.*")
    wrong = ends.groupBy("node").agg(F.sum("leaf").alias("leaves"), F.min("leaf").alias("low")).where("leaves > 1 or leaves = 1 and low = 0")
    return wrong.isEmpty()


def connected_components(spark: SparkSession, edges: DataFrame, lot_edges: int = LOT_EDGES) -> DataFrame:
    """node, root (the component's smallest node) for each node of edges (a, b: long; best a saved table). Loops and repeated edges are allowed; edges with a null are left out.

    Edges are first joined within lots of lot_edges, which leaves few of them and mostly stars; what one lot holds is
    answered by that. Rounds of stars join the lots. Every round is written to the shared folder. A star with very many
    points is never gathered in one place: its centre's minimum is a combined aggregate and the join back to its points
    can be split.
    """
    scratch = Scratch(spark, "components")
    nodes = edges.where("a is not null and b is not null").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    lots = max(1, -(-nodes.count() // lot_edges))
    nodes = scratch.save(_forests(nodes, lots, lot_edges), "forests")
    if lots == 1:
        return nodes.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(nodes.where("u != v").select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    now, n = nodes.where("u != v"), 0
    loops = nodes.where("u = v").select(F.col("u").alias("node"))
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _to_least(large)
        stars = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        n += 1
        now = scratch.save(stars, f"round-{n}")
        if n > 1:
            scratch.drop(f"round-{n - 1}")
        if _are_stars(now):
            break
    roots = now.select(F.col("v").alias("node")).unionByName(loops)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.distinct().join(now.select(F.col("u").alias("node")), "node", "left_anti").select("node", F.col("node").alias("root")))
