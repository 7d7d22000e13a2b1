import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lociframe.operators import algebra, graph, neighbors, spatial
from lociframe.plans import analysis_queries

E = "cell_id long, vec array<double>"


def test_knn_cosine_with_ties(spark):
    emb = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 1.0])], E)
    found = {r.src: (r.dst, r.dist) for r in neighbors.knn(emb, emb, 1, exclude_self=True).collect()}
    assert {k: v[0] for k, v in found.items()} == {1: 2, 3: 2, 2: 1}
    assert found[1][1] == pytest.approx(1 - 1 / 2**0.5)


def test_knn_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(90, 5))
    emb = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], E)
    monkeypatch.setattr(neighbors, "BLOCK", 20)
    d = ((x[:, None] - x) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    want = {(i, k + 1, int(j)) for i in range(90) for k, j in enumerate(np.argsort(d[i])[:4])}
    found = neighbors.knn(emb, emb, 4, "euclidean", True).collect()
    assert {(r.src, r["rank"], r.dst) for r in found} == want


def test_few_rows_give_few_neighbours(spark):
    emb = spark.createDataFrame([(1, [1.0]), (2, [2.0])], E)
    assert neighbors.knn(emb, emb, 5, exclude_self=True).count() == 2


def test_snn(spark, rows):
    n = spark.createDataFrame([(0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1)], "src long, dst long")
    assert rows(neighbors.snn(n)) == [(0, 1, 1 / 3), (0, 2, 1 / 3), (1, 2, 1 / 3)]


def test_modality_weights(spark):
    a = spark.createDataFrame([(0, 0.1)], "src long, dist double")
    b = spark.createDataFrame([(0, 0.3)], "src long, dist double")
    r = neighbors.modality_weights(a, b).first()
    assert (r.w_first, r.w_second) == pytest.approx((0.75, 0.25))


def test_imputation_weights(spark):
    n = spark.createDataFrame([(0, 1, 0.1), (0, 2, 0.3), (0, 3, 1.5), (1, 1, 0.2), (1, 2, 1.0), (2, 1, 1.0), (2, 2, 2.0)], "src long, dst long, dist double")
    found = {(r.src, r.dst): r.weight for r in neighbors.imputation_weights(n).collect()}
    assert found == pytest.approx({(0, 1): 0.75, (0, 2): 0.25, (1, 1): 1.0, (2, 1): 0.5, (2, 2): 0.5})


def test_soft_assignment_sums_to_one(spark):
    emb = spark.createDataFrame([(0, [1.0, 0.2]), (1, [0.0, 1.0])], E)
    sums = neighbors.soft_assignment(emb, [[1.0, 0.0], [0.0, 1.0]]).groupBy("cell_id").agg(F.sum("weight").alias("s")).collect()
    assert [r.s for r in sums] == pytest.approx([1.0, 1.0])


def test_sample_size_and_determinism(spark, rows):
    scores = spark.range(100).select(F.col("id").alias("cell_id"), (F.col("id") % 7 + 1).cast("double").alias("score"))
    a = neighbors.proportional_sample(scores, 20)
    assert a.count() == 20 and a.where("guaranteed").count() == 5
    assert rows(a) == rows(neighbors.proportional_sample(scores.repartition(3), 20))


@pytest.mark.parametrize("cell", [0.02, 0.5])
def test_spatial_knn_is_exact(spark, cell):
    rng = np.random.default_rng(2)
    x = rng.random((60, 2))
    pts = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "cell_id long, x double, y double")
    d = ((x[:, None] - x) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    want = {(i, int(j)) for i in range(60) for j in np.argsort(d[i])[:4]}
    assert {(r.src, r.dst) for r in spatial.spatial_knn(pts, 4, cell).collect()} == want


def test_spatial_knn_of_dense_and_equal_places(spark):
    """The pairs met don't grow with density or with copies: a coarse cell holds all points here."""
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(size=(300, 2)) * 1e-4, np.repeat(rng.normal(size=(4, 2)), 60, axis=0), [[50.0, 50.0]]])
    pts = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "cell_id long, x double, y double")
    d = ((x[:, None] - x) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    want = {(i, n + 1, int(j)) for i in range(len(x)) for n, j in enumerate(np.argsort(d[i], kind="stable")[:5])}
    found = spatial.spatial_knn(pts, 5, 100.0)
    assert {(r.src, r["rank"], r.dst) for r in found.collect()} == want
    assert found.dtypes == [("src", "bigint"), ("rank", "int"), ("dst", "bigint"), ("dist", "double")]


def test_polygon(spark):
    square = [(0, 0), (4, 0), (4, 4), (0, 4)]
    pts = spark.createDataFrame([(2.0, 2.0), (5.0, 2.0)], "x double, y double")
    assert [r.x for r in pts.where(spatial.in_polygon(F.col("x"), F.col("y"), square)).collect()] == [2.0]


def test_affine_inverse():
    m = spatial.read_affine("2 0 5\n0,4,1\n0 0 1\n")
    a, b, c, d, e, f = spatial.inverse(m)
    assert (a * 7 + b * 9 + c, d * 7 + e * 9 + f) == (1.0, 2.0)
    with pytest.raises(ValueError, match="no inverse"):
        spatial.inverse((0, 0, 1, 0, 0, 1))


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(5)
    centres = np.eye(6)[:3] * 6
    x = np.vstack([rng.normal(size=(30, 6)) * 0.4 + c for c in centres])
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], E)


def test_louvain_finds_blobs(spark, blobs):
    _, emb = blobs
    edges = neighbors.snn(neighbors.knn(emb, emb, 10, exclude_self=True)).persist()
    nodes = emb.select(F.col("cell_id").alias("node"))
    found = graph.louvain(nodes, edges)
    groups = found.toPandas()
    assert all(groups[groups.node // 30 == k].cluster.nunique() == 1 for k in range(3)) and groups.cluster.nunique() == 3
    single = nodes.withColumn("cluster", F.col("node"))
    assert graph.modularity(found, edges).first()[0] > graph.modularity(single, edges).first()[0]


def test_louvain_goes_on_until_nothing_merges(spark):
    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(299)], "src long, dst long, weight double")
    nodes = spark.range(300).select(F.col("id").alias("node"))
    assert graph.louvain(nodes, edges, 0.0).select("cluster").distinct().count() == 1  # at resolution 0 all merges gain


def test_connected_path(spark, rows):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(30, 31)], "src long, dst long")
    nodes = spark.createDataFrame([(i,) for i in [*range(21), 30, 31, 40]], "node long")
    found = dict(rows(graph.connected(nodes, edges)))
    assert {found[i] for i in range(21)} == {0} and found[31] == 30 and found[40] == 40


def test_svd_matches_numpy(spark):
    rng = np.random.default_rng(7)
    a = rng.poisson(1.0, (40, 25)).astype(float) * rng.gamma(2.0, 2.0, 25)
    counts = spark.createDataFrame([(int(j), int(i), float(a[i, j])) for i, j in zip(*np.nonzero(a), strict=True)], "feature_id long, cell_id long, value double")
    for centre in (False, True):
        emb, sdev = algebra.embed(counts, 40, 25, 4, 21, 2, center=centre, scale=False)
        u, s, _ = np.linalg.svd(a - a.mean(0) * centre, full_matrices=False)
        assert sdev == pytest.approx(s[:4] / 24**0.5, rel=1e-6)
        x = np.stack([r.vec for r in emb.orderBy("cell_id").collect()])
        assert np.abs(np.linalg.svd(u[:, :4].T @ x)[1] - 1).max() < 1e-6
        assert np.all(np.diff(sdev) <= 0)


@pytest.mark.parametrize("centre", [False, True])
def test_svd_stores_no_dense_row_a_feature(spark, monkeypatch, centre):
    """With many features and few cells only rows of the cells are stored and dealt out; columns and features may be cut for that."""
    stored = {}

    def materialized(df, name):
        made = model.materialized(df, name)
        if "vec" in made.columns:
            stored[name] = max(made.count(), stored.get(name, 0))
        return made

    from lociframe import model

    for name, value in (("materialized", materialized), ("HELD", 60), ("PIECE", 4), ("MET", 7)):
        monkeypatch.setattr(algebra, name, value, raising=False)
    rng = np.random.default_rng(9)
    a = rng.poisson(0.7, (12, 300)) * rng.gamma(2.0, 2.0, 300)
    counts = spark.createDataFrame([(int(j), int(i), float(a[i, j])) for i, j in zip(*np.nonzero(a), strict=True)], "feature_id long, cell_id long, value double")
    emb, sdev = algebra.embed(counts, 12, 300, 4, 8, 1, center=centre, scale=False)
    u, s, v = np.linalg.svd(a - a.mean(0) * centre, full_matrices=False)
    x = np.stack([r.vec for r in emb.orderBy("cell_id").collect()])
    assert max(stored.values()) <= 13  # the cells and one row of sums
    assert np.abs(np.linalg.svd(u[:, :4].T @ x)[1] - 1).max() < 1e-6
    w = (a - a.mean(0) * centre).T @ x
    assert (w[np.abs(w).argmax(0), range(4)] > 0).all() and sdev == pytest.approx(np.linalg.norm(w, axis=0) / 299**0.5)


def test_harmony_moves_batches_together(spark, blobs):
    x, _ = blobs
    shifted = [(i, (v + (i % 2) * np.array([0, 0, 0, 0, 0, 2.0])).tolist(), i % 2) for i, v in enumerate(x)]
    emb = spark.createDataFrame(shifted, "cell_id long, vec array<double>, batch int")
    fixed, objective = algebra.harmony(emb, [0, 1], k=3, rounds=3)
    gap = lambda rows: abs(np.mean([r.vec[5] for r in rows if r.batch]) - np.mean([r.vec[5] for r in rows if not r.batch]))
    assert gap(fixed.collect()) < gap(emb.collect()) / 2
    assert np.isfinite(objective).all()


def test_harmony_of_few_cells_is_one_task(spark, blobs, monkeypatch):
    """As by jobs for each pass, but with two stored tables whatever the number of rounds."""
    x, _ = blobs
    emb = spark.createDataFrame([(i, (v + (i % 2) * np.array([0, 0, 0, 0, 0, 2.0])).tolist(), i % 2) for i, v in enumerate(x)], "cell_id long, vec array<double>, batch int")
    stored, keep = [], algebra.materialized
    monkeypatch.setattr(algebra, "materialized", lambda df, name: stored.append(name) or keep(df, name))
    made = []
    for most in (algebra.HARMONY_NUMBERS, 0):
        monkeypatch.setattr(algebra, "HARMONY_NUMBERS", most)
        stored.clear()
        fixed, objective = algebra.harmony(emb, [0, 1], k=3, rounds=3)
        made.append((np.array([r.vec for r in fixed.orderBy("cell_id").collect()]), objective))
        assert not most or len(stored) == 2
    assert made[0][0] == pytest.approx(made[1][0], abs=1e-8) and made[0][1] == pytest.approx(made[1][1])


def test_multi_sample_steps(spark, tmp_path, monkeypatch):
    """Top features before TF-IDF, 50 components less the first, 20 by 20 rounds at most, 20 neighbours."""
    orders = [(i, 22 * i, f"1992-01-{1 + i % 28:02d}") for i in range(1, 41)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(i,) for i in range(30)], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    items = [(i, j, 1.0) for i in range(1, 41) for j in range(30) if (i > 1 or j == 0) and (i * j) % 3 < 2 and i != 29]
    spark.createDataFrame(items, "l_orderkey long, l_suppkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    seen = {}

    def embed(rows, cells, features, **more):
        seen.update(more, features=features, used=rows.select("feature_id").distinct().count())
        return rows.select("cell_id", F.array(*[F.lit(float(i)) for i in range(50)]).alias("vec")).distinct(), None

    def harmony(emb, batches, **more):
        seen.update(first=list(emb.first().vec), harmony=more)
        return emb, []

    def knn(a, b, k, **more):
        seen["k"] = k
        return spark.createDataFrame([], "src long, dst long")

    monkeypatch.setattr(algebra, "embed", embed)
    monkeypatch.setattr(algebra, "harmony", harmony)
    monkeypatch.setattr(neighbors, "knn", knn)
    unified = []
    top = analysis_queries.matrix.top_features
    monkeypatch.setattr(analysis_queries.matrix, "top_features", lambda c, f, cut: unified.append(f.count()) or top(c, f, cut))
    analysis_queries.multi_sample_pipeline(spark, str(tmp_path))
    assert seen["features"] == seen["used"] <= unified[0]
    assert seen["first"] == [float(i) for i in range(1, 50)] and seen["harmony"] == {}
    assert (seen["k"], seen["over"], seen["iterations"]) == (20, 20, 5)


def test_imputation_recovers_values(spark, blobs):
    x, emb = blobs
    source, target = emb.where("cell_id % 2 = 0"), emb.where("cell_id % 2 = 1")
    values = source.select("cell_id", F.lit(0).alias("feature_id"), F.floor(F.col("cell_id") / 30).cast("double").alias("value"))
    found = algebra.impute(source, target, values, 3, 5).collect()
    assert len(found) == 45 and all(abs(r.value - r.src // 30) < 0.01 for r in found)


def test_projected_neighbours(spark, monkeypatch):
    from lociframe.operators import neighbors

    monkeypatch.setattr(neighbors, "BLOCK", 50)
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(6, 5))
    emb = spark.createDataFrame([(i, (centers[i % 6] + rng.normal(size=5) * 0.2).tolist()) for i in range(300)], "cell_id long, vec array<double>").repartition(3)
    asked = emb.where("cell_id % 4 = 0")
    exact = sorted(map(tuple, neighbors.knn(asked, emb, 5, exclude_self=True).collect()))
    assert sorted(map(tuple, neighbors.knn_pruned(asked, emb, 5, exclude_self=True, pivots=12).collect())) == exact and len(exact) == 5 * 75


def test_pruned_neighbours_of_odd_rows(spark, monkeypatch):
    """Ties, vectors of no length, fewer rows than asked, blocks of few rows: what comparing all with all gives."""
    rng = np.random.default_rng(4)
    x = [[float(a) for a in v] for v in rng.normal(size=(90, 4))] + [[0.0] * 4] * 3 + [[1.0, 0.0, 0.0, 0.0]] * 9
    emb = spark.createDataFrame(list(enumerate(x)), "cell_id long, vec array<double>")
    for size in (4096, 8):
        monkeypatch.setattr(neighbors, "BLOCK", size)
        for base in (emb, emb.limit(0), emb.where("cell_id < 3"), emb.where("cell_id between 90 and 92")):
            want = sorted(map(tuple, neighbors.knn(emb, base, 6).collect())) if base.count() else []
            assert sorted(map(tuple, neighbors.knn_pruned(emb, base, 6, pivots=7, first=2).collect())) == want


def test_kmeans_finds_directions(spark):
    from lociframe.operators import algebra

    rng = np.random.default_rng(1)
    centers = np.eye(4) * 3
    emb = spark.createDataFrame([(i, (centers[i % 4] + rng.normal(size=4) * 0.1).tolist()) for i in range(120)], "cell_id long, vec array<double>")
    labels = {r.cell_id: r.cluster for r in algebra.kmeans(emb, 4)[0].collect()}
    assert len(set(labels.values())) == 4 and all(labels[i] == labels[i % 4] for i in labels)


def test_pruned_neighbours_visit_in_small_batches(spark, monkeypatch):
    """A task never makes the visits of a whole block of queries at once; a base as small as the pivots isn't dealt out by them."""
    rng = np.random.default_rng(6)
    emb = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(200, 6)))], E)
    monkeypatch.setattr(neighbors, "VISITS", 64)
    want = sorted(map(tuple, neighbors.knn(emb, emb, 3, exclude_self=True).collect()))
    assert sorted(map(tuple, neighbors.knn_pruned(emb, emb, 3, exclude_self=True, pivots=40).collect())) == want
    monkeypatch.setattr(neighbors, "materialized", None)  # what pivots would need
    assert sorted(map(tuple, neighbors.knn_pruned(emb, emb, 3, exclude_self=True, pivots=200).collect())) == want


def test_pruned_neighbours_of_vectors_without_groups(spark, monkeypatch):
    """Where bounds leave out next to nothing, visits aren't dealt out: blocks of all serve. Where they do, pivots go on."""
    plain, calls = neighbors.knn, []
    monkeypatch.setattr(neighbors, "knn", lambda *a, **b: calls.append(1) or plain(*a, **b))
    rng = np.random.default_rng(8)
    loose = rng.normal(size=(150, 30))
    tight = np.eye(30)[np.arange(150) % 15] * 9 + rng.normal(size=(150, 30)) * 0.01
    for x, times in ((loose, 1), (tight, 0)):
        emb = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], E).repartition(2)
        calls.clear()
        found = sorted(map(tuple, neighbors.knn_pruned(emb, emb, 4, exclude_self=True, pivots=40).collect()))
        assert len(calls) == times and found == sorted(map(tuple, plain(emb, emb, 4, exclude_self=True).collect()))


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_few_pairs_are_ranked_in_double_precision(monkeypatch, metric):
    """Of a block of all pairs only those that single precision can't tell from the nearest are rounded and sorted; ties go by id."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1200, 16))
    x[600:800] = x[:200] * (1 + 1e-9)  # nearer than single precision tells
    x[800:810], x[900] = x[0], 0
    rows = pd.DataFrame({"id": rng.permutation(5000)[:1200], "vec": list(x)})
    seen, rounds = [], np.round
    monkeypatch.setattr(neighbors.np, "round", lambda a, *more: seen.append(np.size(a)) or rounds(a, *more))
    found = neighbors._nearest(metric, 6, True)(rows, rows)
    assert sum(seen) < 1200 * 1200 / 5
    monkeypatch.undo()
    norm = np.linalg.norm(x, axis=1)
    size = norm[:, None] * norm
    dist = np.where(size > 0, 1 - (x @ x.T) / np.where(size > 0, size, 1), 1.0) if metric == "cosine" else ((x[:, None] - x) ** 2).sum(2)
    for i in rng.permutation(1200)[:200]:
        near = found[found["src"] == rows["id"][i]]
        want = sorted((round(dist[i, j], 10), rows["id"][j]) for j in range(1200) if j != i)[:6]
        assert sorted(near["dst"]) == sorted(d for _, d in want) and sorted(near["dist"]) == pytest.approx([d for d, _ in want], abs=1e-9)
