"""Decompositions of long matrices: randomised SVD and PCA, principal vectors, imputation across data sets.

Long sides stay in Spark as (id, vec) rows; the driver sees matrices of the sketch's width only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import materialized
from . import neighbors

VEC = "id long, vec array<double>"
#: Numbers of the dense rows that a task holds in a pass over a matrix, entries of a feature in one row, and entries met at once.
HELD = 1 << 25
PIECE = 4096
MET = 1 << 10
#: Rows of a block file of harmony().
BLOCK_ROWS = 1 << 16
#: Numbers of vectors and clusters' shares up to which all rounds of a batch correction run in one task.
HARMONY_NUMBERS = 1 << 23


def _stack(col: pd.Series) -> np.ndarray:
    return np.stack(col.to_numpy()).astype(float)


def partial_sums(rows: DataFrame, f) -> list[np.ndarray]:
    """Sums over all rows of the arrays that f makes of a matrix of vec: one fixed-size partial sum from each partition."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for part in parts:
            if len(part):
                made = f(_stack(part["vec"]))
                total = made if total is None else [a + b for a, b in zip(total, made, strict=True)]
        if total is not None:
            yield pd.DataFrame({"k": range(len(total)), "a": [x.tobytes() for x in total], "shape": [list(x.shape) for x in total]})

    out: dict[int, np.ndarray] = {}
    for r in rows.select("vec").mapInPandas(run, "k int, a binary, shape array<int>").toLocalIterator():
        x = np.frombuffer(r.a).reshape(r.shape)
        out[r.k] = out[r.k] + x if r.k in out else x
    return [out[k] for k in sorted(out)]


def linear(rows: DataFrame, matrix: np.ndarray, shift: np.ndarray | float = 0.0) -> DataFrame:
    """vec @ matrix + shift for every row."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                yield pd.DataFrame({"id": part["id"], "vec": list(_stack(part["vec"]) @ matrix + shift)})

    return rows.select("id", "vec").mapInPandas(run, VEC)


def _packed(counts: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """The matrix by ranges of features: (block, feature_id, cells, values) in pieces of a feature, the blocks that each cell_id
    meets, and the number of blocks. All are stored."""
    n = counts.sparkSession.sparkContext.defaultParallelism
    entries = counts.where("value is not null and feature_id is not null and cell_id is not null").select("feature_id", "cell_id", F.col("value").cast("double").alias("value"))
    lists = entries.repartitionByRange(n, "feature_id").groupBy("feature_id").agg(F.collect_list(F.struct("cell_id", "value")).alias("row"))
    starts = F.sequence(F.lit(0), F.floor((F.size("row") - 1) / PIECE).cast("int"))
    pieces = lists.select(F.spark_partition_id().alias("block"), "feature_id", F.explode(F.transform(starts, lambda i: F.slice("row", i * PIECE + 1, PIECE))).alias("row"))
    matrix = materialized(pieces.select("block", "feature_id", F.col("row.cell_id").alias("cells"), F.col("row.value").alias("numbers")), "matrix")
    meets = matrix.select("block", F.explode("cells").alias("id")).groupBy("id").agg(F.collect_set("block").alias("blocks"))
    return matrix, materialized(meets, "meets"), n


def _passed(packed: tuple[DataFrame, DataFrame, int], dense: DataFrame | None, width: int, n_cells: int, center: bool, seed: int = 0, heaviest: bool = False) -> DataFrame:
    """One pass over the matrix A of cells by features: (id, vec) of A A' dense, or of A times random rows if dense is None.

    A task takes a range of features, by columns if HELD numbers don't suffice for its cells' rows. These come first and are held; the
    features stream past, each one's row of A' dense is used as soon as it is made and never leaves the task. With center the feature
    means are subtracted as a rank-one correction. With heaviest, one row: A' dense's entry of largest size in each column."""
    matrix, meets, n = packed
    per = max(1, min(width, HELD // max(1, n_cells)))
    slices, drawn = -(-width // per), dense is None
    asked = meets.withColumn("vec", F.array().cast("array<double>")) if dense is None else meets.join(dense, "id")
    total = partial_sums(dense, lambda x: [x.sum(0)])[0] if center and dense is not None else np.zeros(width)
    task = lambda block, s: (block * slices + s).alias("task")
    every = F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice")
    held = asked.select(F.explode("blocks").alias("block"), "id", "vec").select("*", every).select(
        task(F.col("block"), F.col("slice")), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("feature"), F.array("id").alias("cells"), F.slice("vec", F.col("slice") * per + 1, F.lit(per)).alias("numbers"))
    streamed = matrix.select("*", every).select(task(F.col("block"), F.col("slice")), F.lit(1).alias("kind"), F.col("feature_id").cast("long").alias("feature"), "cells", "numbers")
    dealt = held.unionByName(streamed).repartitionById(n * slices, F.col("task")).sortWithinPartitions("task", "kind", "feature")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, rows, early, late = [], [], None, None
        made = shift = best = q = None
        columns = slice(0, 0)

        def add(features: np.ndarray, cells: np.ndarray, values: np.ndarray) -> None:
            nonlocal best
            starts = np.flatnonzero(np.r_[True, features[1:] != features[:-1]])
            lengths = np.diff(np.r_[starts, len(features)])
            at = np.searchsorted(names, cells)
            mu = np.add.reduceat(values, starts)[:, None] / n_cells if center else None
            if q is None:
                z = np.stack([np.random.default_rng((seed, int(i) & (1 << 62) - 1)).normal(size=width)[columns] for i in features[starts]])
            else:
                z = np.add.reduceat(values[:, None] * q[at], starts, axis=0)
                if center:
                    z -= mu * total[columns]
            if heaviest:
                x = z if best is None else np.vstack([best, z])
                best = x[np.abs(x).argmax(0), np.arange(x.shape[1])][None]
                return
            order = np.argsort(at, kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(at[order]) != 0])
            made[at[order[first]]] += np.add.reduceat((values[:, None] * np.repeat(z, lengths, axis=0))[order], first, axis=0)
            if center:
                shift[:] += (mu * z).sum(0)

        def parts(x: tuple, last: bool) -> tuple | None:
            """Adds whole features, MET entries or more at once; gives back what may go on."""
            features = x[0]
            ends = np.r_[np.flatnonzero(features[1:] != features[:-1]) + 1, *([len(features)] if last else [])].astype(np.int64)
            low = 0
            while len(ends):
                k = min(int(np.searchsorted(ends, low + MET)), len(ends) - 1)
                add(*[y[low : ends[k]] for y in x])
                low, ends = ends[k], ends[k + 1 :]
            return tuple(y[low:] for y in x) if low < len(features) else None

        def told() -> Iterator[pa.RecordBatch]:
            s = pa.array([columns.start // per], pa.int32())
            if heaviest:
                if best is not None:
                    yield _batch(s, [None], best)
                return
            if center:
                yield _batch(s, [None], shift[None])
            for low in range(0, len(names), 1000):
                yield _batch(s, names[low : low + 1000], made[low : low + 1000])

        for batch in batches:
            kinds = batch.column("kind").to_numpy()
            k = int(np.searchsorted(kinds, 1))
            if k:
                some = batch.slice(0, k)
                early = batch.column("task")[0].as_py() % slices
                names.append(some.column("cells").flatten().to_numpy())
                rows.append(some.column("numbers").flatten().to_numpy().reshape(k, -1))
            if k == len(kinds):
                continue
            if made is None:
                columns = slice(early * per, min(width, (early + 1) * per))
                names = np.concatenate(names)
                order = np.argsort(names)
                names, q = names[order], None if drawn else np.concatenate(rows)[order]
                rows, made, shift = [], np.zeros((len(names) if not heaviest else 0, columns.stop - columns.start)), np.zeros(columns.stop - columns.start)
            some = batch.slice(k)
            lists = some.column("cells")
            new = np.repeat(some.column("feature").to_numpy(), lists.value_lengths().to_numpy()), lists.flatten().to_numpy(), some.column("numbers").flatten().to_numpy()
            late = parts(new if late is None else tuple(np.concatenate(y) for y in zip(late, new, strict=True)), False)
        if late is not None:
            parts(late, True)
        if made is not None:
            yield from told()

    found = dealt.mapInArrow(run, "slice int, id long, vec array<double>")
    if heaviest:
        return found
    whole = found.groupBy("id", "slice").agg(*[F.sum(F.get("vec", F.lit(i))).alias(f"b{i}") for i in range(per)])
    whole = whole.select("id", "slice", F.array_compact(F.array(*[f"b{i}" for i in range(per)])).alias("vec"))
    if slices > 1:
        whole = whole.groupBy("id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("slice", "vec"))), lambda x: x.vec)).alias("vec"))
    whole = materialized(whole.select("id", "vec"), "sketch")
    rows = whole.where("id is not null")
    return linear(rows, np.eye(width), -np.array(whole.where("id is null").first().vec)) if center else rows


def _batch(number: pa.Array, ids, rows: np.ndarray) -> pa.RecordBatch:
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(rows).ravel()))
    return pa.RecordBatch.from_arrays([pa.array(number.to_pylist() * len(rows), pa.int32()), pa.array(ids, pa.int64()), lists], names=["slice", "id", "vec"])


def _orthonormal(rows: DataFrame) -> DataFrame:
    """rows times the inverse of its Gram matrix's Cholesky factor; directions without weight become zeros."""
    gram = partial_sums(rows, lambda y: [y.T @ y])[0]
    value, vector = np.linalg.eigh(gram)
    keep = value > value.max() * 1e-12
    return linear(rows, vector @ np.diag(np.where(keep, 1 / np.sqrt(np.where(keep, value, 1)), 0.0)))


def embed(counts: DataFrame, n_cells: int, n_features: int, k: int = 10, over: int = 6, iterations: int = 2, center: bool = False, scale: bool = True, seed: int = 42) -> tuple[DataFrame, np.ndarray]:
    """(cell_id, vec) of the k leading components of cells by features, and their standard deviations.

    Randomised range finding with power iterations; center subtracts feature means as a rank-one correction, so the matrix
    stays sparse. Components are left singular vectors without singular values, z-scored if scale; each one's sign makes its
    heaviest loading positive. sdev divides by sqrt(features - 1)."""
    width = min(k + over, n_cells, n_features)
    packed = _packed(counts)
    q = _orthonormal(_passed(packed, None, width, n_cells, center, seed))
    for _ in range(iterations):
        q = _orthonormal(_passed(packed, q, width, n_cells, center))
    q = materialized(q, "range")
    both = _passed(packed, q, width, n_cells, center).withColumnRenamed("vec", "made").join(q, "id")
    inner = partial_sums(both.select(F.concat("vec", "made").alias("vec")), lambda x: [x[:, :width].T @ x[:, width:]])[0]
    value, u = np.linalg.eigh((inner + inner.T) / 2)
    order = np.argsort(-value)[:k]
    value, u = np.maximum(value[order], 0), u[:, order]
    best: dict[int, list[np.ndarray]] = {}
    for r in _passed(packed, materialized(linear(q, u), "turned"), len(order), n_cells, center, heaviest=True).toLocalIterator():  # a row for each task
        best.setdefault(r.slice, []).append(np.array(r.vec))
    heaviest = np.concatenate([np.stack(x)[np.abs(np.stack(x)).argmax(0), np.arange(len(x[0]))] for _, x in sorted(best.items())])
    u = u * np.where(heaviest < 0, -1.0, 1.0)
    emb = linear(q, u)
    if scale:
        total, square, n = partial_sums(emb, lambda x: [x.sum(0), (x * x).sum(0), np.array([float(len(x))])])
        mean = total / n
        sd = np.sqrt(np.maximum(square - n * mean * mean, 0) / max(n[0] - 1, 1))
        sd = np.where(sd < 1e-12, 1.0, sd)
        emb = linear(emb, np.diag(1 / sd), -mean / sd)
    return emb.withColumnRenamed("id", "cell_id"), np.sqrt(value) / np.sqrt(max(1, n_features - 1))


def dense_pca(rows: DataFrame, k: int) -> tuple[DataFrame, np.ndarray]:
    """(cell_id, vec) of dense rows' k principal components, scaled by singular values, and the loadings (k by width)."""
    named = rows.select(F.col("cell_id").alias("id"), "vec")
    gram, total, n = partial_sums(named, lambda x: [x.T @ x, x.sum(0), np.array([float(len(x))])])
    mean = total / n
    value, vector = np.linalg.eigh(gram - n * np.outer(mean, mean))
    v = vector[:, np.argsort(-value)[:k]]
    v = v * np.where(v[np.abs(v).argmax(0), np.arange(v.shape[1])] < 0, -1.0, 1.0)
    return linear(named, v, -mean @ v).withColumnRenamed("id", "cell_id"), v.T


def principal_vectors(source: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The source loadings rotated to principal vectors (rows), and the cosines between both spans."""
    qs, qt = np.linalg.qr(source.T)[0], np.linalg.qr(target.T)[0]
    u, s, _ = np.linalg.svd(qs.T @ qt)
    return (qs @ u).T, s


def impute(source: DataFrame, target: DataFrame, values: DataFrame, n_pv: int = 8, most_neighbors: int = 50, cosine: float = 0.3) -> DataFrame:
    """src, feature_id, value: values(cell_id, feature_id, value) of source cells carried to target cells.

    source and target have (cell_id, vec) over the same common features. Both are z-scored, projected on the principal
    vectors whose cosine exceeds the bound (one at least), and met by cosine neighbours."""
    def standard(rows: DataFrame) -> DataFrame:
        named = rows.select(F.col("cell_id").alias("id"), "vec")
        total, square, n = partial_sums(named, lambda x: [x.sum(0), (x * x).sum(0), np.array([float(len(x))])])
        mean = total / n
        sd = np.sqrt(np.maximum(square / n - mean * mean, 0))
        inverse = np.where(sd <= 1e-12, 0.0, 1 / np.where(sd <= 1e-12, 1, sd))
        return linear(named, np.diag(inverse), -mean * inverse).withColumnRenamed("id", "cell_id")

    a, b = standard(source), standard(target)
    pv, cos = principal_vectors(dense_pca(a, n_pv)[1], dense_pca(b, n_pv)[1])
    pv = pv[: max(1, int((cos[: len(pv)] > cosine).sum()))]
    project = lambda rows: linear(rows.select(F.col("cell_id").alias("id"), "vec"), pv.T).withColumnRenamed("id", "cell_id")
    near = neighbors.knn(project(b), project(a), min(most_neighbors, max(1, source.count() - 1)))
    near = near.withColumn("dist", F.greatest("dist", F.lit(0.0)))
    return neighbors.weighted_values(neighbors.imputation_weights(near), values)


def kmeans(emb: DataFrame, k: int, iterations: int = 25, seed: int = 42) -> tuple[DataFrame, np.ndarray]:
    """(cell_id, cluster) and the centres of k clusters of directions: seeds drawn by squared distance in parallel rounds, then
    up to so many rounds of assignment and means, each a pass over partitions."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = emb.select("cell_id", array_to_vector("vec").alias("features"))
    model = KMeans(k=k, maxIter=iterations, seed=seed, distanceMeasure="cosine", initMode="k-means||").fit(rows)
    return model.transform(rows).select("cell_id", F.col("prediction").alias("cluster")), np.array(model.clusterCenters())


def harmony(emb: DataFrame, batches: list, k: int | None = None, theta: float = 2.0, sigma: float = 0.1, ridge: float = 1.0, rounds: int = 20, inner: int = 20, seed: int = 42) -> tuple[DataFrame, list[float]]:
    """(cell_id, vec, batch) with batch effects removed, and the objective after each round.

    Soft k-means on unit vectors with a diversity penalty (E / (O + E))^theta, then a ridge correction of the original
    vectors for each cluster. Inner rounds end when the objective's sum over three changes by under 1e-5 of itself, outer
    ones when a round gains under 1e-6; rounds and inner are the most there can be.
    Every step is one pass of partition sums of clusters by batches by dimensions; the driver holds those only. Rows lie in blocks, as the
    bytes of their matrices, so a pass makes no object for each row. Up to HARMONY_NUMBERS numbers all passes run in one task, where jobs would cost more
    than their work."""
    n = emb.count()
    k = k or max(1, min(round(n / 30), 100))
    place = {b: i for i, b in enumerate(batches)}
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)
    centers = unit(kmeans(emb, k, seed=seed)[1]) if k > 1 else unit(np.array([emb.select("vec").first().vec]))
    k = len(centers)

    def packed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                x = _stack(part["vec"]).tobytes()
                yield pd.DataFrame({"n": [len(part)], "id": [part["cell_id"].to_numpy(np.int64).tobytes()], "batch": [part["batch"].map(place).to_numpy(np.int64).tobytes()], "vec": [x], "orig": [x]})

    tasks = max(emb.sparkSession.sparkContext.defaultParallelism, -(-n // BLOCK_ROWS))
    current = materialized(emb.select("cell_id", "vec", "batch").repartition(tasks).mapInPandas(packed, "n long, id binary, batch binary, vec binary, orig binary"), "harmony")

    def blocks(parts: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        """A row for each block, its vectors, the places of their batches, and the vectors as they were."""
        for part in parts:
            for r in part.itertuples(index=False):
                yield r, np.frombuffer(r.vec).reshape(r.n, -1), np.frombuffer(r.batch, np.int64), np.frombuffer(r.orig).reshape(r.n, -1)

    def soft(x: np.ndarray, b: np.ndarray, centers: np.ndarray, penalty: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = 2 * (1 - unit(x) @ centers.T)
        r = np.exp(-(d - d.min(1, keepdims=True)) / sigma) * penalty[:, b].T
        return r / np.maximum(r.sum(1, keepdims=True), 1e-300), d

    def advanced(sums, corrected, centers: np.ndarray) -> list[float]:
        """The objective after each round; sums(f) adds up f(x, b, orig) of all blocks, corrected(f) gives each the vectors f(x, b, orig)."""
        penalty = np.ones((k, len(batches)))
        objective: list[float] = []
        for _ in range(rounds):
            costs: list[float] = []
            for _ in range(inner):
                def step(x: np.ndarray, b: np.ndarray, orig: np.ndarray, centers=centers, penalty=penalty) -> list[np.ndarray]:
                    r, d = soft(x, b, centers, penalty)
                    return [r.T @ unit(x), r.T @ np.eye(len(batches))[b], np.array([(r * d).sum() + sigma * (r * np.log(np.maximum(r, 1e-300))).sum()])]

                c, o, cost = sums(step)
                centers, o = unit(c.reshape(k, -1)), o.reshape(k, -1)
                expected = o.sum(1, keepdims=True) * o.sum(0) / max(o.sum(), 1e-300)
                penalty = (expected / np.maximum(o + expected, 1e-300)) ** theta
                mixed = sigma * theta * (o * np.log((np.maximum(o, 1e-8) + np.maximum(expected, 1e-8)) / np.maximum(expected, 1e-8))).sum()
                costs.append(float(cost.ravel()[0] + mixed) * 2000 / n)
                if len(costs) > 4 and abs(sum(costs[-4:-1]) - sum(costs[-3:])) < 1e-5 * abs(sum(costs[-4:-1])):
                    break
            objective.append(costs[-1])

            def design(x: np.ndarray, b: np.ndarray, orig: np.ndarray, centers=centers, penalty=penalty) -> list[np.ndarray]:
                r, _ = soft(x, b, centers, penalty)
                one = np.eye(len(batches))[b]
                return [r.T @ one, np.stack([(one * r[:, [j]]).T @ orig for j in range(k)])]

            mass, moment = sums(design)
            mass, moment = mass.reshape(k, -1), moment.reshape(k, len(batches), -1)
            shift = np.zeros((k, len(batches), moment.shape[2]))
            for j in range(k):
                phi = np.zeros((len(batches) + 1, len(batches) + 1))
                phi[0, 0], phi[0, 1:], phi[1:, 0] = mass[j].sum(), mass[j], mass[j]
                phi[1:, 1:] = np.diag(mass[j] + ridge)
                w = np.linalg.pinv(phi) @ np.vstack([moment[j].sum(0), moment[j]])
                shift[j] = w[1:]  # the intercept isn't taken out

            def correct(x: np.ndarray, b: np.ndarray, orig: np.ndarray, centers=centers, penalty=penalty, shift=shift) -> np.ndarray:
                r, _ = soft(x, b, centers, penalty)
                made = orig.copy()
                for j in range(k):
                    made -= r[:, [j]] * shift[j][b]
                return made

            corrected(correct)
            if len(objective) > 1 and 0 <= (objective[-2] - objective[-1]) / max(abs(objective[-2]), 1e-300) < 1e-6:
                break
        return objective

    def added(made: Iterator[list[np.ndarray]]) -> list[np.ndarray]:
        total = None
        for x in made:
            total = x if total is None else [p + q for p, q in zip(total, x, strict=True)]
        return total

    def in_one_task(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [list(x) for x in blocks(parts)]
        if not held:
            return

        def corrected(f) -> None:
            for x in held:
                x[1] = f(*x[1:])

        objective = advanced(lambda f: added(f(*x[1:]) for x in held), corrected, centers)
        for row, x, *_ in held:
            yield pd.DataFrame([row._replace(vec=x.tobytes())]).assign(objective=np.array(objective).tobytes())

    def by_jobs(f) -> list[np.ndarray]:
        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = added(f(*x[1:]) for x in blocks(parts))
            if total is not None:
                yield pd.DataFrame({"k": range(len(total)), "a": [np.asarray(x, float).tobytes() for x in total]})

        out: dict[int, np.ndarray] = {}
        for r in current.mapInPandas(run, "k int, a binary").toLocalIterator():
            x = np.frombuffer(r.a)
            out[r.k] = out[r.k] + x if r.k in out else x
        return [out[i] for i in sorted(out)]

    def corrected_by_jobs(f) -> None:
        nonlocal current

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for row, x, b, orig in blocks(parts):
                yield pd.DataFrame([row._replace(vec=f(x, b, orig).tobytes())])

        current = materialized(current.mapInPandas(run, current.schema), "harmony")

    if n * (centers.shape[1] + k) <= HARMONY_NUMBERS:
        shape = "n long, id binary, batch binary, vec binary, orig binary, objective binary"
        current = materialized(current.repartition(1).mapInPandas(in_one_task, shape), "harmony")
        objective = list(np.frombuffer(current.first().objective)) if n else []
        current = current.drop("objective")
    else:
        objective = advanced(by_jobs, corrected_by_jobs, centers)

    def told(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for row, x, b, _ in blocks(parts):
            yield pd.DataFrame({"cell_id": np.frombuffer(row.id, np.int64), "vec": list(x), "batch": pd.Series([batches[i] for i in b])})

    return current.mapInPandas(told, f"cell_id long, vec array<double>, batch {emb.schema['batch'].dataType.simpleString()}"), objective


def fit_softmax(rows: DataFrame, n_classes: int, rounds: int = 60, penalty: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights (classes by width) and biases of a linear softmax scorer, learnt from vec with the class number as its last component.

    Each round is one gradient, summed over partitions; steps have the length that the largest eigenvalue of the inputs allows, with
    Nesterov's momentum."""
    gram, n = partial_sums(rows, lambda x: [np.c_[x[:, :-1], np.ones(len(x))].T @ np.c_[x[:, :-1], np.ones(len(x))], np.array([float(len(x))])])
    width = len(gram)
    step = 1 / (0.5 * np.linalg.eigvalsh(gram / n)[-1] + penalty)
    w, ahead, turn = np.zeros((n_classes, width)), np.zeros((n_classes, width)), 1.0
    for _ in range(rounds):

        def gradient(x: np.ndarray, at: np.ndarray = ahead) -> list[np.ndarray]:
            z = np.c_[x[:, :-1], np.ones(len(x))]
            p = z @ at.T
            p = np.exp(p - p.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(x)), x[:, -1].astype(int)] -= 1
            return [p.T @ z]

        (g,) = partial_sums(rows, gradient)
        new, later = ahead - step * (g / n + penalty * ahead), (1 + np.sqrt(1 + 4 * turn * turn)) / 2
        ahead, w, turn = new + (turn - 1) / later * (new - w), new, later
    return w[:, :-1], w[:, -1]


def softmax_scores(rows: DataFrame, weights: np.ndarray, biases: np.ndarray) -> DataFrame:
    """id, best (class number) and confidence: the largest share of exp(Wx + b) of rows (id, vec)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                z = _stack(part["vec"]) @ weights.T + biases
                p = np.exp(z - z.max(1, keepdims=True))
                yield pd.DataFrame({"id": part["id"], "best": p.argmax(1), "confidence": p.max(1) / p.sum(1)})

    return rows.select("id", "vec").mapInPandas(run, "id long, best int, confidence double")
