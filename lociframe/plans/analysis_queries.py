"""Iterative analyses: checked by their row counts here and by invariants in the tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import model as m
from ..operators import algebra, graph, matrix, neighbors, spatial
from ..operators import intervals as iv


def _sizes(spark, sf):
    return m.table(spark, sf, "supplier").count(), m.table(spark, sf, "part").count()


def _components(rows, cells, features, **more):
    """The survey's decomposition: 50 components, 20 more in the sketch, 5 power iterations."""
    return algebra.embed(rows, cells, features, k=50, over=20, iterations=5, **more)[0]


def _flat(emb):
    return emb.select("cell_id", F.posexplode("vec").alias("component", "value"))


def lsi_embedding(spark, sf):
    cells, features = _sizes(spark, sf)
    return _flat(_components(matrix.tfidf(m.counts(spark, sf), cells), cells, features))


def pca_embedding(spark, sf):
    cells, features = _sizes(spark, sf)
    return _flat(_components(matrix.log_normalize(m.counts(spark, sf)), cells, features, center=True))


def _snn(emb, k=15):
    return neighbors.snn(neighbors.knn(emb, emb, k, exclude_self=True), 1 / 15)


def _nodes(emb):
    return emb.select(F.col("cell_id").alias("node"))


def louvain(spark, sf):
    emb = m.embedding(spark, sf)
    return graph.louvain(_nodes(emb), m.materialized(_snn(emb), "snn"), 0.8)


def _quality(spark, sf, find):
    """One row: the nodes, whether every cluster is connected, and whether modularity is above that of the given labels."""
    emb = m.embedding(spark, sf)
    edges, nodes = m.materialized(_snn(emb), "snn"), _nodes(emb)
    found = m.materialized(find(nodes, edges), "clusters")
    parts = graph.split_disconnected(found, edges).select("cluster").distinct().count() == found.select("cluster").distinct().count()
    given = emb.select(F.col("cell_id").alias("node"), "cluster")
    above = graph.modularity(found, edges).first()[0] > graph.modularity(given, edges).first()[0]
    return found.agg(F.count(F.lit(1)).alias("n_nodes"), F.count_distinct("node").alias("n_distinct")).withColumns({"connected": F.lit(parts), "above_labels": F.lit(above)})


def leiden(spark, sf):
    return _quality(spark, sf, lambda nodes, edges: graph.leiden(nodes, edges, 1.0))


def walktrap(spark, sf):
    return _quality(spark, sf, graph.walktrap)


def connected_split(spark, sf):
    emb = m.embedding(spark, sf)
    return graph.split_disconnected(emb.select(F.col("cell_id").alias("node"), "cluster"), m.materialized(_snn(emb), "snn"))


def harmony(spark, sf):
    emb = m.embedding(spark, sf).select("cell_id", "vec", (F.col("cell_id") % 3).cast("int").alias("batch"))
    return _flat(algebra.harmony(emb, [0, 1, 2])[0])


def spage_impute(spark, sf):
    emb = m.embedding(spark, sf, 1, 40)
    source, target = emb.where("cell_id % 2 = 0"), emb.where("cell_id % 2 = 1")
    values = m.embedding(spark, sf, 41, 10).where("cell_id % 2 = 0").select("cell_id", F.posexplode("vec").alias("feature_id", "value"))
    return algebra.impute(source, target, values)


def single_sample_pipeline(spark, sf):
    """Top features, TF-IDF on the whole matrix, SVD without its first component, neighbours, clusters."""
    cells, features = _sizes(spark, sf)
    counts = m.materialized(m.counts(spark, sf), "counts")
    top = matrix.top_features(counts, m.features(spark, sf), 0.05).select("feature_id")
    rows = matrix.tfidf(counts, cells).join(top, "feature_id", "left_semi")
    emb = _components(rows, cells, features).select("cell_id", F.slice("vec", 2, 49).alias("vec"))
    emb = m.materialized(emb, "embedding")
    return graph.louvain(_nodes(emb), m.materialized(neighbors.snn(neighbors.knn(emb, emb, 20, exclude_self=True)), "snn"), 0.8)


def multi_sample_pipeline(spark, sf):
    """Two samples' peaks unified, counts mapped onto them and set side by side, top features, TF-IDF of
    these, SVD without its first component, batch correction, neighbours, clusters."""
    n = m.table(spark, sf, "supplier").count()
    peaks = m.intervals(spark, sf)
    unified = m.materialized(iv.numbered(iv.unify(peaks)).withColumn("feature_id", F.xxhash64("unified_id")), "unified")
    mapping = iv.map_to(peaks, unified).join(unified.select("unified_id", "feature_id"), "unified_id").select("peak_id", F.col("feature_id").alias("new_id"))
    mapping = m.materialized(mapping.withColumnRenamed("peak_id", "feature_id"), "mapping")
    items = m.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("feature_id"), F.col("l_suppkey").alias("cell_id")).agg(F.sum("l_quantity").alias("value"))
    parts = [(matrix.remap(items.where(F.col("feature_id") % 2 == s), mapping), n) for s in (0, 1)]
    counts = m.materialized(matrix.concat_cells(parts), "counts")
    top = m.materialized(matrix.top_features(counts, unified, 0.05).select("feature_id"), "top")
    rows = m.materialized(matrix.tfidf(counts.join(top, "feature_id", "left_semi"), 2 * n), "tfidf")
    emb = _components(rows, 2 * n, top.count()).select("cell_id", F.slice("vec", 2, 49).alias("vec"))
    emb = m.materialized(emb.withColumn("batch", (F.col("cell_id") >= n).cast("int")), "embedding")
    fixed = algebra.harmony(emb, [0, 1])[0]
    return graph.louvain(_nodes(fixed), m.materialized(neighbors.snn(neighbors.knn(fixed, fixed, 20, exclude_self=True)), "snn"), 0.6)


def wnn_pipeline(spark, sf):
    a, b = m.embedding(spark, sf, 1, 32), m.embedding(spark, sf, 33, 32)
    na, nb = (m.materialized(neighbors.knn(x, x, 15, exclude_self=True), "knn") for x in (a, b))
    merged = neighbors.merge_neighbors(na, nb, neighbors.modality_weights(na, nb), 15).where("src != dst")
    return graph.louvain(_nodes(a), m.materialized(neighbors.snn(merged), "snn"), 0.3)


def sketch_clustering(spark, sf):
    """Clusters of a leverage sample, split where disconnected, carried to the other cells by their nearest sample cells."""
    emb = m.embedding(spark, sf)
    chosen = m.materialized(neighbors.proportional_sample(neighbors.leverage(emb), 300), "sketch")
    sample = m.materialized(emb.join(chosen.select("cell_id"), "cell_id", "left_semi"), "sketch")
    edges = m.materialized(_snn(sample), "snn")
    labels = m.materialized(graph.split_disconnected(graph.louvain(_nodes(sample), edges, 1.8), edges), "labels")
    labels = labels.select(F.col("node").alias("cell_id"), F.col("cluster").alias("label"))
    near = neighbors.knn_pruned(emb.join(chosen, "cell_id", "left_anti"), sample, 5)
    return labels.unionByName(neighbors.vote(near, labels).withColumnRenamed("src", "cell_id"))


def knn_projected(spark, sf):
    """The five nearest of each fifth row among all, by pivots: exact."""
    emb = m.embedding(spark, sf)
    found = neighbors.knn_pruned(emb.where("cell_id % 5 = 0"), emb, 5, exclude_self=True)
    return found.select("src", "rank", "dst", m.rounded(F.col("dist")).alias("dist"))


def kmeans_clusters(spark, sf):
    return algebra.kmeans(m.embedding(spark, sf), 10)[0]


def banksy_regions(spark, sf):
    """Neighbourhood-augmented features, their principal components, and clusters of these."""
    pts = m.points(spark, sf).withColumnRenamed("id", "cell_id")
    values = m.embedding(spark, sf).select("cell_id", F.posexplode(F.slice("vec", 3, 10)).alias("feature_id", "value"))
    near = m.materialized(spatial.spatial_knn(pts, 15, 0.05), "spatial")
    rows = neighbors.banksy_matrix(values, near).groupBy("cell_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("feature", "value"))), lambda x: x.value).alias("vec"))
    emb = m.materialized(algebra.dense_pca(m.materialized(rows, "banksy"), 8)[0], "embedding")
    return graph.louvain(_nodes(emb), m.materialized(_snn(emb), "snn"), 0.8)


QUERIES = {
    f.__name__: (f, None)
    for f in (lsi_embedding, pca_embedding, louvain, connected_split, harmony, spage_impute, single_sample_pipeline, multi_sample_pipeline, wnn_pipeline, sketch_clustering, banksy_regions, kmeans_clusters)
}
QUERIES["knn_projected"] = (knn_projected, """WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), d AS (SELECT a.id AS src, b.id AS dst, round(1 - list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 12) AS dist FROM e a, e b WHERE a.id % 5 = 0 AND a.id <> b.id)
    SELECT src, CAST(rank AS INTEGER) AS rank, dst, round(dist, 6) + 0.0 AS dist FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS rank FROM d) WHERE rank <= 5""")
_QUALITY = "SELECT count(*) AS n_nodes, count(DISTINCT vec_id) AS n_distinct, true AS connected, true AS above_labels FROM embeddings"
QUERIES |= {"leiden": (leiden, _QUALITY), "walktrap": (walktrap, _QUALITY)}
QUERIES["connected_split"] = (connected_split, """WITH RECURSIVE e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings),
    d AS (SELECT a.id AS src, b.id AS dst, round(1 - list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 12) AS dist FROM e a, e b WHERE a.id <> b.id),
    knn AS (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS r FROM d) WHERE r <= 15), pr AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM knn),
    sh AS (SELECT pr.a AS a, pr.b AS b, count(*) AS n FROM pr JOIN knn x ON x.src = pr.a JOIN knn y ON y.src = pr.b AND y.dst = x.dst GROUP BY 1, 2),
    ed AS (SELECT a, b FROM sh JOIN e x ON x.id = a JOIN e y ON y.id = b WHERE n / CAST(30 - n AS DOUBLE) > 1 / 15.0::DOUBLE AND x.label = y.label), both_ AS (SELECT a AS src, b AS dst FROM ed UNION ALL SELECT b, a FROM ed),
    reach(node, root) AS (SELECT id, id FROM e UNION SELECT dst, root FROM reach JOIN both_ ON src = node), r AS (SELECT node, min(root) AS root FROM reach GROUP BY 1)
    SELECT node, CAST(dense_rank() OVER (ORDER BY label, root) - 1 AS INTEGER) AS cluster FROM r JOIN e ON id = node""")
