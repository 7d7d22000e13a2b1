"""Connected components of an edge table: contraction within parts, then alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored

#: Edges that one task contracts, about.
EDGES_A_TASK = 1_000_000


def least_labels(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges (u, v), and the smallest node that each reaches."""
    nodes, ends = np.unique(np.concatenate((u, v)), return_inverse=True)
    label, a, b = np.arange(len(nodes)), ends[: len(u)], ends[len(u) :]
    while (label[a] != label[b]).any():
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label = label[label]
    return nodes, nodes[label]


def _contracted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [batch for batch in it if len(batch)]
    if held:
        edges = pa.Table.from_batches(held)
        nodes, roots = least_labels(edges.column("u").to_numpy(), edges.column("v").to_numpy())
        yield pa.RecordBatch.from_pydict({"u": nodes, "v": roots})


def _all_stars(edges: DataFrame) -> bool:
    """True if every node of edges (u, v) either has one edge to a smaller node, or is such a node itself."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("out")))
    odd = ends.groupBy("node").agg(F.sum("out").alias("out"), F.min("out").alias("least")).where("out > 1 or (out = 1 and least = 0)")
    return odd.agg(F.count(F.lit(1))).first()[0] == 0


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (u, v), a stored table: root is the smallest node it reaches.

    Parts of EDGES_A_TASK edges are contracted first, each by itself. Where there are several, rounds join edges with
    each node's smallest neighbour until all are stars; every round is stored."""
    parts = -(-edges.count() // EDGES_A_TASK)
    stars = stored(edges.coalesce(max(1, parts)).mapInArrow(_contracted, "u long, v long"), "edges")
    if parts <= 1:
        return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
    edges = stored(stars.where("u != v").distinct(), "edges")
    while not _all_stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # now u > v in every row; each u's neighbours hang on its smallest one
        small = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
        moved = large.join(small, F.col("u") == F.col("w")).select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        edges = stored(moved.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u != v").distinct(), "edges")
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return ends.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
