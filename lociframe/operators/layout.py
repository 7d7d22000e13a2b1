"""A layout of cells in the plane: a fuzzy graph of neighbours, pulled together along its edges and pushed apart elsewhere, in rounds of
partition sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import materialized
from . import algebra, neighbors

#: Rounds of the bandwidth search, and cells of a random bucket, which repel each other.
SEARCH = 64
BUCKET = 8


def curve(min_dist: float, spread: float = 1.0) -> tuple[float, float]:
    """a and b for which 1 / (1 + a d^2b) is near 1 up to min_dist and falls off as exp(-(d - min_dist) / spread) from there: least squares
    by damped Newton steps on their logarithms."""
    d = np.linspace(0, 3 * spread, 300)[1:]
    want = np.where(d < min_dist, 1.0, np.exp(-(d - min_dist) / spread))
    at, damp = np.zeros(2), 1e-3

    def off(x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(x[0]) * d ** (2 * np.exp(x[1]))) - want

    for _ in range(200):
        r, f = off(at), 1e-6
        j = np.stack([(off(at + f * e) - r) / f for e in np.eye(2)], 1)
        step = np.linalg.solve(j.T @ j + damp * np.eye(2), j.T @ r)
        better = (off(at - step) ** 2).sum() < (r**2).sum()
        at, damp = (at - step, damp / 3) if better else (at, damp * 5)
    return float(np.exp(at[0])), float(np.exp(at[1]))


def fuzzy_graph(near: DataFrame, k: int) -> DataFrame:
    """src < dst, weight: how far two cells count as neighbours, of near (src, dst, dist) with k rows a cell.

    A cell's nearest has weight 1; others fall off by a bandwidth for which all weights sum to log2(k), searched by halving. The weights
    that two cells give each other are joined as probabilities of either."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in it:
            for n, some in rows.groupby(rows["dist"].map(len)):
                d = np.stack(some["dist"].to_numpy()).astype(float)
                rho = np.where((d > 0).any(1), np.where(d > 0, d, np.inf).min(1), 0.0)
                low, high = np.zeros(len(d)), np.full(len(d), np.inf)
                mid = np.ones(len(d))
                for _ in range(SEARCH):
                    total = np.exp(-np.maximum(d - rho[:, None], 0) / mid[:, None]).sum(1)
                    low, high = np.where(total < np.log2(k), mid, low), np.where(total < np.log2(k), high, mid)
                    mid = np.where(np.isinf(high), mid * 2, (low + high) / 2)
                mid = np.maximum(mid, 1e-3 * np.maximum(d.mean(1), 1e-12))
                w = np.exp(-np.maximum(d - rho[:, None], 0) / mid[:, None])
                yield pd.DataFrame({"src": np.repeat(some["src"].to_numpy(), n), "dst": np.concatenate(some["dst"].to_numpy()), "w": w.ravel()})

    lists = near.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("dist", "dst"))).alias("l")).select("src", F.col("l.dist").alias("dist"), F.col("l.dst").alias("dst"))
    given = lists.mapInPandas(run, "src long, dst long, w double").where("src != dst")
    a, b = F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")
    joined = given.select(a, b, "w").groupBy("a", "b").agg(F.sum("w").alias("s"), F.product(F.col("w")).alias("p"), F.count(F.lit(1)).alias("n"))
    return joined.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.when(F.col("n") == 2, F.col("s") - F.col("p")).otherwise(F.col("s")).alias("weight"))


def _clipped(x: Column) -> Column:
    return F.greatest(F.lit(-4.0), F.least(F.lit(4.0), x))


def place(emb: DataFrame, k: int = 15, min_dist: float = 0.1, spread: float = 1.0, rounds: int = 30, negatives: int = 2, near: DataFrame | None = None) -> DataFrame:
    """cell_id, x, y: cells of emb (cell_id, vec) in the plane, so that neighbours (cosine, or those given) stay together.

    It begins with two principal components. In each round every cell moves along its edges, by their weights, and away from the
    others of a random bucket of BUCKET cells, drawn anew by hash, as from that many samples of all cells; steps shrink to nothing. A round
    is two joins by cell and one by bucket, whatever the number of cells."""
    near = near or neighbors.knn_pruned(emb, emb, k, exclude_self=True)
    edges = materialized(fuzzy_graph(materialized(near.select("src", "dst", "dist"), "near"), k), "fuzzy")
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    both = materialized(both.join(both.groupBy("src").agg(F.sum("weight").alias("all")), "src").select("src", "dst", (F.col("weight") / F.col("all")).alias("share")), "fuzzy")
    a, b = curve(min_dist, spread)
    flat = algebra.dense_pca(emb, 2)[0].select("cell_id", F.col("vec")[0].alias("x"), F.col("vec")[1].alias("y"))
    size = flat.agg(F.max(F.greatest(F.abs("x"), F.abs("y"))).alias("most"), F.count(F.lit(1)).alias("n")).first()
    scale = 10.0 / size.most if size.most else 1.0
    buckets = max(1, size.n // BUCKET)
    at = materialized(flat.select(F.col("cell_id").alias("node"), (F.col("x") * scale).alias("x"), (F.col("y") * scale).alias("y")), "layout")
    dx, dy = F.col("x") - F.col("x2"), F.col("y") - F.col("y2")
    d2 = F.greatest(dx * dx + dy * dy, F.lit(1e-12))
    pull = -2 * a * b * F.pow(d2, b - 1) / (1 + a * F.pow(d2, b))
    push = 2 * b / ((0.001 + d2) * (1 + a * F.pow(d2, b)))
    for turn in range(rounds):
        here, there = at, at.select(F.col("node").alias("dst"), F.col("x").alias("x2"), F.col("y").alias("y2"))
        met = both.join(here, F.col("src") == F.col("node")).join(there, "dst")
        drawn = met.groupBy(F.col("src").alias("node")).agg(F.sum(F.col("share") * _clipped(pull * dx)).alias("gx"), F.sum(F.col("share") * _clipped(pull * dy)).alias("gy"))
        dealt = at.withColumn("bucket", F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(buckets)))
        other = dealt.select("bucket", F.col("node").alias("dst"), F.col("x").alias("x2"), F.col("y").alias("y2"))
        pushed = dealt.join(other, "bucket").where("node != dst").groupBy("node").agg(F.avg(_clipped(push * dx)).alias("rx"), F.avg(_clipped(push * dy)).alias("ry"))
        step = 1.0 - turn / rounds
        moved = at.join(drawn, "node", "left").join(pushed, "node", "left")
        move = lambda g, r: step * (F.coalesce(g, F.lit(0.0)) + negatives * F.coalesce(r, F.lit(0.0)))
        at = materialized(moved.select("node", (F.col("x") + move("gx", "rx")).alias("x"), (F.col("y") + move("gy", "ry")).alias("y")), "layout")
    return at.select(F.col("node").alias("cell_id"), "x", "y")
