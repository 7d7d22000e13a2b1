"""Nearest neighbours and what is built on them: shared-neighbour graphs, merging of modalities, votes, weights."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import blocks_of, materialized

BLOCK = 4096
#: Rows of (group, query, vector) that a task makes at once.
VISITS = 16_384
#: A row that is dealt out costs about as much as so many distances.
ROW = 200


def _nearest(metric: str, k: int, exclude_self: bool):
    """For a block of queries and one of the base: each query's k nearest, ties to the smaller id.

    Single precision finds which rows can be among them, with room for its error; distances are those of double precision."""

    def exact(q: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Distances of the rows of q from those of b, row by row."""
        if metric == "cosine":
            size = np.linalg.norm(q, axis=1) * np.linalg.norm(b, axis=1)
            dist = np.where(size > 0, 1 - np.einsum("ij,ij->i", q, b) / np.where(size > 0, size, 1), 1.0)
        else:
            dist = np.maximum((q * q).sum(1) + (b * b).sum(1) - 2 * np.einsum("ij,ij->i", q, b), 0) if q.shape[1] > 8 else ((q - b) ** 2).sum(1)
        return np.round(dist, 12)

    def unit(x: np.ndarray) -> np.ndarray:
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        return (x / np.where(norm > 0, norm, 1)).astype(np.float32)

    def run(queries: pd.DataFrame, base: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(base):
            return pd.DataFrame({"src": [], "dst": [], "dist": []})
        b = np.stack(base["vec"].to_numpy()).astype(float)
        names = base["id"].to_numpy()
        order = np.argsort(names, kind="stable")
        b, names = b[order], names[order]
        cosine = metric == "cosine"
        rough = unit(b) if cosine else b.astype(np.float32)
        square = None if cosine else (rough * rough).sum(1)
        top = 1.0 if cosine else 2 * float(np.abs(b).max(initial=0)) ** 2 * b.shape[1]
        out = []
        for low in range(0, len(queries), 256):
            some = queries.iloc[low : low + 256]
            q = np.stack(some["vec"].to_numpy()).astype(float)
            ids = some["id"].to_numpy()
            fair = cosine or top + 2 * float(np.abs(q).max(initial=0)) ** 2 * b.shape[1] < 1e30
            if k < len(names) and fair and np.isfinite(q).all() and np.isfinite(rough).all():
                far = -(unit(q) @ rough.T) if cosine else square - 2 * (q.astype(np.float32) @ rough.T)  # all a query's by one constant less
                if exclude_self:
                    far[ids[:, None] == names] = np.inf
                nth = np.partition(far, k - 1, axis=1)[:, k - 1, None]
                scale = 1.0 if cosine else np.maximum((q * q).sum(1).max(), (b * b).sum(1).max())
                at, of = np.nonzero(far <= nth + np.float32(4e-7 * scale * (q.shape[1] + 8)))
            else:
                at, of = np.divmod(np.arange(len(q) * len(names)), len(names))
            if exclude_self:
                other = ids[at] != names[of]
                at, of = at[other], of[other]
            dist = np.concatenate([exact(q[at[i : i + 65_536]], b[of[i : i + 65_536]]) for i in range(0, max(1, len(at)), 65_536)])
            ranked = np.lexsort((of, dist, at))
            at, of, dist = at[ranked], of[ranked], dist[ranked]
            first = np.searchsorted(at, np.arange(len(q)))
            kept = (np.arange(len(at)) - first[at] < k) & (dist < np.inf)
            out.append(pd.DataFrame({"src": ids[at[kept]], "dst": names[of[kept]], "dist": dist[kept]}))
        return pd.concat(out)

    return run


def knn(queries: DataFrame, base: DataFrame, k: int, metric: str = "cosine", exclude_self: bool = False) -> DataFrame:
    """src, rank (from 1), dst, dist: for each query (cell_id, vec) the k nearest rows of base, ties to the smaller id.

    Exact. Base and queries are dealt out in blocks; each pair of blocks is one matrix product in one task, from
    which k rows a query come back. Blocks grow with their side, up to four times BLOCK, so rows go to fewer of them. Cosine distance is 1 where a norm is 0; 'euclidean' is squared."""
    nb, nq = (blocks_of(n, min(4 * BLOCK, max(BLOCK, n // 16))) for n in (base.count(), queries.count()))
    b = base.select(F.col("cell_id").alias("id"), "vec").withColumn("bb", F.pmod(F.xxhash64("id"), F.lit(nb)).cast("int"))
    b = b.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))
    q = queries.select(F.col("cell_id").alias("id"), "vec").withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(nq)).cast("int"))
    q = q.withColumn("bb", F.explode(F.sequence(F.lit(0), F.lit(nb - 1))))
    found = q.groupBy("bb", "qb").cogroup(b.groupBy("bb", "qb")).applyInPandas(_nearest(metric, k, exclude_self), "src long, dst long, dist double")
    rank = F.row_number().over(Window.partitionBy("src").orderBy("dist", "dst"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("src", "rank", "dst", "dist")


def _unit(column: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """The vectors at length 1, and which of them have a length at all."""
    x = np.stack(column.to_numpy()).astype(float)
    norm = np.linalg.norm(x, axis=1)
    return x / np.where(norm > 0, norm, 1)[:, None], norm > 0


def _angles(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Straight distances of unit vectors."""
    return np.sqrt(np.maximum(2 - 2 * x @ p.T, 0))


def knn_pruned(queries: DataFrame, base: DataFrame, k: int, exclude_self: bool = False, pivots: int = 512, first: int = 4) -> DataFrame:
    """src, rank (from 1), dst, dist: the k nearest of base for each query (cell_id, vec) by cosine distance, ties to the smaller id: what knn()
    gives, without comparing all with all where the vectors lie in groups.

    Base rows go to the nearest of so many pivots, base rows of the smallest hashes. A query first meets the groups of its `first` nearest
    pivots, which bounds its k-th distance; then only groups that may hold something nearer: those whose pivot isn't farther from it than
    that bound and the group's radius together (distances of unit vectors obey the triangle inequality). Vectors without a length have
    distance 1 to all and a group of their own. Groups are dealt out in blocks of BLOCK rows by BLOCK queries. A base of no more rows than
    pivots has nothing to leave out and goes to knn(); so do queries whose bounds leave so many groups that to deal them out there is
    more work than blocks of all."""
    n_base = base.count()
    if n_base <= pivots:
        return knn(queries, base, k, exclude_self=exclude_self)
    chosen = base.select("vec", F.xxhash64("cell_id").alias("h")).where(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x) > 0).orderBy("h").limit(pivots).collect()
    p = _unit(pd.Series([r.vec for r in chosen]))[0] if chosen else np.zeros((0, 1))

    def placed(it):
        for rows in it:
            if len(rows):
                x, real = _unit(rows["vec"])
                far = _angles(x, p) if len(p) else np.zeros((len(x), 1))
                yield pd.DataFrame({"pivot": np.where(real, far.argmin(1), -1).astype(np.int64), "id": rows["cell_id"], "vec": rows["vec"], "r": far.min(1)})

    held = materialized(base.select("cell_id", "vec").mapInPandas(placed, "pivot long, id long, vec array<double>, r double"), "pivots")
    groups = held.groupBy("pivot").agg(F.max("r").alias("radius"), F.count(F.lit(1)).alias("n")).toPandas().sort_values("pivot")  # a row for each pivot
    names, radius, sizes = groups["pivot"].to_numpy(), groups["radius"].to_numpy(), groups["n"].to_numpy()
    inner = names >= 0

    def visits(bounded: bool, counted: bool = False):
        """(group, id, vec) of each query's groups: its nearest ones, or those that its bound leaves; or how many visits and distances these are."""

        def run(it):
            for rows in it:
                step = max(1, VISITS // max(1, len(names)))  # a query may visit every group
                for low in range(0, len(rows), step):
                    some = rows.iloc[low : low + step]
                    x, real = _unit(some["vec"])
                    far = np.full((len(x), len(names)), np.inf)
                    if inner.any():
                        far[:, inner] = _angles(x, p[names[inner]])
                    nearest = np.argsort(far, axis=1, kind="stable")
                    seen = np.zeros(far.shape, bool)
                    np.put_along_axis(seen, nearest[:, :first], True, axis=1)
                    if bounded:
                        most = np.sqrt(2 * np.nan_to_num(some["most"].to_numpy(float), nan=np.inf))[:, None] + 1e-6
                        seen = np.where(inner, far <= most + radius, most >= np.sqrt(2) - 1e-6) & ~seen | (~real[:, None] & ~seen)
                    if counted:
                        yield pd.DataFrame({"visits": [int(seen.sum())], "met": [int((seen @ sizes).sum())]})
                        continue
                    at, of = np.nonzero(seen)
                    yield pd.DataFrame({"pivot": names[of], "id": some["cell_id"].to_numpy()[at], "vec": some["vec"].to_numpy()[at]})

        return run

    many = {int(name): blocks_of(int(n), BLOCK) for name, n in zip(names, sizes, strict=True) if n > BLOCK}
    blocks = F.coalesce(F.create_map(*[F.lit(x).cast("long") for pair in many.items() for x in pair])[F.col("pivot")], F.lit(1).cast("long")) if many else F.lit(1).cast("long")

    def met(asked: DataFrame) -> DataFrame:
        turns = asked.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("turns"))  # a row for each pivot
        b = held.select("pivot", "id", "vec", F.pmod(F.xxhash64("id"), blocks).alias("bb")).join(F.broadcast(turns), "pivot").withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1))).drop("turns")
        q = asked.join(F.broadcast(turns), "pivot").select("pivot", "id", "vec", F.pmod(F.xxhash64("id"), F.col("turns")).alias("qb")).withColumn("bb", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
        keys = ("pivot", "bb", "qb")
        return q.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInPandas(_nearest("cosine", k, exclude_self), "src long, dst long, dist double")

    nearest = Window.partitionBy("src").orderBy("dist", "dst")
    shape = "pivot long, id long, vec array<double>"
    asked = queries.select("cell_id", "vec")
    near = materialized(met(materialized(asked.mapInPandas(visits(False), shape), "visits")), "near")
    most = near.withColumn("nth", F.row_number().over(nearest)).where(F.col("nth") == k).select(F.col("src").alias("cell_id"), F.col("dist").alias("most"))
    bounds = materialized(asked.join(most, "cell_id", "left"), "bounds")
    left = bounds.mapInPandas(visits(True, True), "visits long, met long").agg(F.sum("visits").alias("visits"), F.sum("met").alias("met"), F.lit(bounds.count()).alias("n")).first()
    dealt = left.n * blocks_of(n_base, BLOCK) + n_base * blocks_of(left.n, BLOCK)
    if left.n and left.met + ROW * left.visits > left.n * n_base + ROW * dealt:
        return knn(queries, base, k, exclude_self=exclude_self)
    again = materialized(bounds.mapInPandas(visits(True), shape), "visits")
    found = near.unionByName(met(again))
    return found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k).select("src", "rank", "dst", "dist")


def snn(neighbors: DataFrame, prune: float = 0.0) -> DataFrame:
    """src < dst, weight: one edge for each unordered neighbour pair, weighted by the Jaccard index of their neighbour
    lists (which do not hold the nodes themselves), kept if over prune."""
    sets = neighbors.groupBy("src").agg(F.collect_list("dst").alias("ns"))  # k ids a node
    pairs = neighbors.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).where("a != b").distinct()
    joined = pairs.join(sets.select(F.col("src").alias("a"), F.col("ns").alias("na")), "a").join(sets.select(F.col("src").alias("b"), F.col("ns").alias("nb")), "b")
    weight = F.size(F.array_intersect("na", "nb")) / F.size(F.array_union("na", "nb"))
    return joined.select(F.col("a").alias("src"), F.col("b").alias("dst"), weight.alias("weight")).where(F.col("weight") > prune)


def modality_weights(first: DataFrame, second: DataFrame) -> DataFrame:
    """src, w_first, w_second: inverse mean neighbour distance, normalised; a mean of 1e-12 or less counts as 1e12."""
    def inverse(n: DataFrame, name: str) -> DataFrame:
        mean = F.avg("dist")
        return n.groupBy("src").agg(F.when(mean <= 1e-12, F.lit(1e12)).otherwise(1 / mean).alias(name))

    both = inverse(first, "a").join(inverse(second, "b"), "src")
    return both.select("src", (F.col("a") / (F.col("a") + F.col("b"))).alias("w_first"), (F.col("b") / (F.col("a") + F.col("b"))).alias("w_second"))


def merge_neighbors(first: DataFrame, second: DataFrame, weights: DataFrame, k: int) -> DataFrame:
    """src, rank, dst, dist: round(k w_first) neighbours of the first list and the rest of the second; distances average
    where both hold one; short lists are filled with (src, 1.0)."""
    share = weights.select("src", F.floor(F.col("w_first") * k + 0.5).cast("int").alias("ka"))
    a = first.join(share, "src").where("rank <= ka").select("src", "dst", F.col("dist").alias("da"))
    b = second.join(share, "src").where(F.col("rank") <= k - F.col("ka")).select("src", "dst", F.col("dist").alias("db"))
    merged = a.join(b, ["src", "dst"], "full").select("src", "dst", F.when(F.col("da").isNull(), F.col("db")).when(F.col("db").isNull(), F.col("da")).otherwise((F.col("da") + F.col("db")) / 2).alias("dist"))
    ranked = merged.withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy(F.round("dist", 9), "dst"))).where(F.col("rank") <= k)
    places = weights.select("src", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("rank"))
    return places.join(ranked, ["src", "rank"], "left").select("src", "rank", F.coalesce("dst", "src").alias("dst"), F.coalesce("dist", F.lit(1.0)).alias("dist"))


def vote(neighbors: DataFrame, labels: DataFrame) -> DataFrame:
    """src, label: the majority label of a node's neighbours, ties to the label whose nearest neighbour is nearer."""
    found = neighbors.join(labels.select(F.col("cell_id").alias("dst"), "label"), "dst").groupBy("src", "label").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("nearest"))
    return found.groupBy("src").agg(F.min_by("label", F.struct(-F.col("n"), "nearest")).alias("label"))


def imputation_weights(neighbors: DataFrame) -> DataFrame:
    """src, dst, weight for imputing from neighbours of distance under 1: none, all alike; one, it alone; else
    (1 - d / sum d) / (n - 1), or 1 / n where the sum is under 1e-12."""
    own = Window.partitionBy("src")
    valid = F.col("dist") < 1
    step = neighbors.select("src", "dst", "dist", F.count_if(valid).over(own).alias("n"), F.sum(F.when(valid, F.col("dist")).otherwise(0.0)).over(own).alias("s"), F.count(F.lit(1)).over(own).alias("all"))
    weight = F.when(F.col("n") == 0, 1 / F.col("all")).when(~valid, F.lit(None)).when(F.col("n") == 1, F.lit(1.0)).when(F.col("s") < 1e-12, 1 / F.col("n")).otherwise(F.try_divide(1 - F.try_divide(F.col("dist"), F.col("s")), F.col("n") - 1))
    return step.select("src", "dst", weight.alias("weight")).where("weight is not null")


def weighted_values(weights: DataFrame, values: DataFrame) -> DataFrame:
    """src, feature_id, value: weighted sums over neighbours of values(cell_id, feature_id, value)."""
    joined = weights.join(values.withColumnRenamed("cell_id", "dst"), "dst")
    return joined.groupBy("src", "feature_id").agg(F.sum(F.col("weight") * F.col("value")).alias("value"))


def leverage(emb: DataFrame) -> DataFrame:
    """cell_id, score: squared length of the embedding."""
    return emb.select("cell_id", F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x).alias("score"))


def proportional_sample(scores: DataFrame, n: int, seed: int = 42, guaranteed: float = 0.25) -> DataFrame:
    """cell_id, guaranteed of a sample of n: the top quarter by score, then rows drawn with chances by score
    (the largest keys -ln(u) / w lose; u is a hash of id and seed, so a rerun draws the same)."""
    if scores.count() <= n:
        return scores.select("cell_id", F.lit(True).alias("guaranteed"))
    top = scores.orderBy(F.desc(F.round("score", 9)), "cell_id").limit(int(np.ceil(guaranteed * n))).select("cell_id", F.lit(True).alias("guaranteed"))
    u = (F.pmod(F.xxhash64("cell_id", F.lit(seed)), F.lit(1 << 30)) + 1) / float((1 << 30) + 1)
    rest = scores.join(top, "cell_id", "left_anti").withColumn("key", -F.ln(u) / F.greatest("score", F.lit(1e-300)))
    return top.unionByName(rest.orderBy("key", "cell_id").limit(n - int(np.ceil(guaranteed * n))).select("cell_id", F.lit(False).alias("guaranteed")))


def soft_assignment(emb: DataFrame, centroids: list[list[float]], sigma: float = 0.1) -> DataFrame:
    """cell_id, cluster, weight: softmax over clusters of -d / sigma with d = 2 (1 - cos)."""
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    cast = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in centroids])
    rows = emb.select("cell_id", "vec", F.posexplode(cast).alias("cluster", "c"))
    cos = F.aggregate(F.zip_with("vec", "c", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) / (norm(F.col("vec")) * norm(F.col("c")))
    step = rows.select("cell_id", "cluster", (-2 * (1 - cos) / sigma).alias("z"))
    own = Window.partitionBy("cell_id")
    e = F.exp(F.col("z") - F.max("z").over(own))
    return step.withColumn("e", e).select("cell_id", "cluster", (F.col("e") / F.sum("e").over(own)).alias("weight"))


def gaussian_weights(neighbors: DataFrame) -> DataFrame:
    """src, dst, weight: exp(-d / m) over its sum, d squared distances and m the value at place floor(k / 2) of a node's
    sorted distances (0 counts as 1e-10); a sum of 1e-12 or less gives 0."""
    own = Window.partitionBy("src")
    middle = F.max(F.when(F.col("rank") == F.floor(F.col("k") / 2) + 1, F.col("dist"))).over(own)
    step = neighbors.withColumn("k", F.count(F.lit(1)).over(own)).withColumn("m", middle)
    step = step.withColumn("e", F.exp(-F.col("dist") / F.when(F.col("m") == 0, F.lit(1e-10)).otherwise(F.col("m"))))
    total = F.sum("e").over(own)
    return step.select("src", "dst", F.when(total <= 1e-12, F.lit(0.0)).otherwise(F.col("e") / total).alias("weight"))


def zscore_columns(values: DataFrame, group: str, col: str, population: bool = False) -> DataFrame:
    """col as a z-score within group: sample spread (under 1e-10 counts as 1), or population spread (1e-12 or less gives 0)."""
    spread = (F.stddev_pop if population else F.stddev_samp)(col)
    stats = values.groupBy(group).agg(F.avg(col).alias("__mean"), F.coalesce(spread, F.lit(0.0)).alias("__sd"))
    rows = values.join(stats, group)
    centred, sd = F.col(col) - F.col("__mean"), F.col("__sd")
    score = F.when(sd <= 1e-12, F.lit(0.0)).otherwise(F.try_divide(centred, sd)) if population else centred / F.when(sd < 1e-10, F.lit(1.0)).otherwise(sd)
    return rows.select(*[score.alias(col) if c == col else F.col(c) for c in values.columns])


def banksy_matrix(values: DataFrame, neighbors: DataFrame, lam: float = 0.3) -> DataFrame:
    """cell_id, feature (own_f or nbr_f), value: z-scored own and neighbourhood expression, weighted sqrt(1 - lam) and sqrt(lam).

    values(cell_id, feature_id, value) must be dense."""
    nbr = weighted_values(gaussian_weights(neighbors), values).withColumnRenamed("src", "cell_id")
    own = zscore_columns(values, "feature_id", "value").select("cell_id", F.concat(F.lit("own_"), F.col("feature_id").cast("string")).alias("feature"), (F.col("value") * float(np.sqrt(1 - lam))).alias("value"))
    near = zscore_columns(nbr, "feature_id", "value").select("cell_id", F.concat(F.lit("nbr_"), F.col("feature_id").cast("string")).alias("feature"), (F.col("value") * float(np.sqrt(lam))).alias("value"))
    return own.unionByName(near)
