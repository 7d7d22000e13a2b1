"""Clusterings of graphs and layouts: known groups, connected clusters, modularity, places that keep neighbours."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociframe.operators import graph, layout, neighbors


@pytest.fixture(scope="module")
def groups(spark):
    """Five groups of twelve nodes, dense inside, linked in a ring by single edges; and a node alone."""
    rng = np.random.default_rng(1)
    edges = [(g * 12 + i, g * 12 + j, 1.0) for g in range(5) for i in range(12) for j in range(i) if rng.random() < 0.7]
    edges += [(g * 12, (g + 1) % 5 * 12 + 3, 0.5) for g in range(5)]
    nodes = spark.createDataFrame([(i,) for i in range(61)], "node long")
    return nodes, spark.createDataFrame(edges, "src long, dst long, weight double")


@pytest.mark.parametrize("find", [graph.louvain, graph.leiden, graph.walktrap])
def test_groups_are_found(groups, find):
    nodes, edges = groups
    found = {r.node: r.cluster for r in find(nodes, edges).collect()}
    assert len(found) == 61 and all(len({found[g * 12 + i] for i in range(12)}) == 1 for g in range(5)) and len(set(found.values())) == 6
    assert sorted(set(found.values())) == list(range(6))


def test_walktrap_weighs_all_stages(spark):
    """Two linked pairs among many nodes without links: the clusters never are half as many as the nodes."""
    edges = spark.createDataFrame([(1, 2, 1.0), (3, 4, 1.0)], "src long, dst long, weight double")
    found = {r.node: r.cluster for r in graph.walktrap(spark.range(1, 13).withColumnRenamed("id", "node"), edges).collect()}
    assert found[1] == found[2] != found[3] == found[4] and len(set(found.values())) == 10


def test_small_graphs_go_through_one_task(spark, monkeypatch):
    """The rounds of one task give the clusters of the rounds of jobs, and store a few tables whatever the number of rounds."""
    rng = np.random.default_rng(2)
    edges = [(g * 8 + i, g * 8 + j, float(rng.integers(1, 4))) for g in range(3) for i in range(8) for j in range(i) if rng.random() < 0.6] + [(0, 11, 1.0), (8, 19, 2.0), (5, 4, 1.0), (3, 3, 1.0)]
    nodes, edges = spark.range(-1, 24).withColumnRenamed("id", "node"), spark.createDataFrame(edges, "src long, dst long, weight double")
    stored, keep = [], graph.materialized
    monkeypatch.setattr(graph, "materialized", lambda df, name: stored.append(name) or keep(df, name))
    made = {}
    for small in (graph.SMALL, 0):
        monkeypatch.setattr(graph, "SMALL", small)
        for find in (graph.louvain, graph.walktrap):
            stored.clear()
            made[find, small] = sorted(tuple(r) for r in find(nodes, edges).collect())
            assert not small or len(stored) < 10
    assert all(made[f, small] == made[f, 0] for f, small in made)


def test_leiden_is_connected_and_no_worse(spark, groups):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(150, 4))
    emb = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "cell_id long, vec array<double>")
    edges = neighbors.snn(neighbors.knn(emb, emb, 8, exclude_self=True)).cache()
    nodes = emb.select(F.col("cell_id").alias("node"))
    a, b = (f(nodes, edges, 1.0).cache() for f in (graph.louvain, graph.leiden))
    assert graph.modularity(b, edges).first()[0] > graph.modularity(a, edges).first()[0] - 0.02
    assert graph.split_disconnected(b, edges).select("cluster").distinct().count() == b.select("cluster").distinct().count()


def test_graphs_without_edges(spark):
    nodes = spark.createDataFrame([(3,), (5,)], "node long")
    none = spark.createDataFrame([], "src long, dst long, weight double")
    for find in (graph.louvain, graph.leiden, graph.walktrap):
        assert sorted(tuple(r) for r in find(nodes, none).collect()) == [(3, 0), (5, 1)]


def test_curve():
    for least, want in ((0.1, (1.577, 0.895)), (0.5, (0.583, 1.334))):  # values that are widely known
        assert np.allclose(layout.curve(least), want, atol=2e-3)


def test_fuzzy_graph(spark):
    near = [(i, j, abs(i - j) / 10) for i in range(12) for j in range(12) if 0 < abs(i - j) <= 3]
    found = {(r.src, r.dst): r.weight for r in layout.fuzzy_graph(spark.createDataFrame(near, "src long, dst long, dist double"), 6).collect()}
    assert set(found) == {(i, j) for i, j, _ in near if i < j} and all(0 < w <= 1 + 1e-9 for w in found.values())
    assert all(abs(found[i, i + 1] - 1) < 1e-9 for i in range(11)) and found[4, 5] > found[4, 6] > found[4, 7]


def test_layout_keeps_groups(spark):
    """Cells of one group end up together; a larger min_dist spreads them."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(4, 10)) * 3
    emb = spark.createDataFrame([(i, (centres[i % 4] + rng.normal(size=10)).tolist()) for i in range(160)], "cell_id long, vec array<double>").cache()
    near, spread = neighbors.knn(emb, emb, 10, exclude_self=True).cache(), {}
    for least in (0.05, 0.9):
        at = {r.cell_id: (r.x, r.y) for r in layout.place(emb, 10, least, rounds=20, near=near).collect()}
        y = np.array([at[i] for i in range(160)])
        far = np.linalg.norm(y[:, None] - y, axis=2)
        np.fill_diagonal(far, np.inf)
        spread[least] = np.median(far.min(1))
        nearest = far.argsort(1)[:, :5]
        assert (nearest % 4 == np.arange(160)[:, None] % 4).mean() > 0.95
    assert spread[0.9] > 1.3 * spread[0.05]


def test_umap_query_compares_all_cells_once(spark, monkeypatch):
    """All pairs of cells meet for the neighbours only: these serve the layout too, and neighbours in the plane come from grids."""
    from lociframe.plans import display_queries as queries

    seen, keep = [], neighbors.knn
    monkeypatch.setattr(neighbors, "knn", lambda *a, **more: seen.append(a[3:] + tuple(more)) or keep(*a, **more))
    emb = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(np.random.default_rng(4).normal(size=(60, 5)))], "cell_id long, vec array<double>")
    given = {}

    def run(data, name, **more):
        given.update(more)
        return emb.select("cell_id", F.col("vec")[2].alias("x"), F.when(F.col("cell_id") == 7, F.lit(float("nan"))).otherwise(F.col("vec")[3]).alias("y"))

    monkeypatch.setattr(queries.commands, "run", run)
    monkeypatch.setattr(queries.commands, "update", lambda data, **more: type("Data", (), {"embedding": emb}))
    monkeypatch.setattr(queries, "_data", lambda *a: None)
    (row,) = queries.command_umap(spark, "").collect()
    assert row.n_cells == 60 and row.finite is False and len(seen) == 1 and given["near"].count() == 900
