"""Queries on nearest neighbours, graphs' weights and space, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import model as m
from ..model import rounded
from ..operators import neighbors as nb
from ..operators import spatial as sp

K = 10
BOX = (-1.0, 1.0, -1.0, 1.0)
POLYGON = [(-0.1, -0.1), (0.12, -0.08), (0.15, 0.1), (0.0, 0.02), (-0.08, 0.12)]
AFFINE = (1.5, 0.2, 3.0, -0.1, 0.8, -2.0)
MAPS = {"identity": (100, 0, 50, 0, 100, 50), "flip_x": (-100, 0, 50, 0, 100, 50), "flip_y": (100, 0, 200, 0, -100, 50), "turn": (0, 100, 10, 100, 0, 0)}
CENTROIDS = [[1.0 if (i + c) % 4 == 0 else -0.25 for i in range(64)] for c in range(4)]


def _knn_sql(name: str, vec: str, k: int, kind: str = "cosine", other: str | None = None, table: str = "embeddings") -> str:
    v = f"{name}_v AS (SELECT vec_id AS id, {vec} AS v FROM {table})"
    w = f"{name}_w AS (SELECT vec_id AS id, {other or vec} AS v FROM {table})"
    dist = "CASE WHEN sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)) > 0 THEN 1 - list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) ELSE 1.0 END"
    if kind != "cosine":
        dist = "(a.v[1] - b.v[1]) * (a.v[1] - b.v[1]) + (a.v[2] - b.v[2]) * (a.v[2] - b.v[2])"
    return f"{v}, {w}, {name} AS (SELECT src, CAST(rank AS INTEGER) AS rank, dst, dist FROM (SELECT src, dst, dist, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS rank FROM (SELECT a.id AS src, b.id AS dst, round({dist}, 12) AS dist FROM {name}_v a JOIN {name}_w b ON a.id <> b.id)) WHERE rank <= {k})"


FULL = "embedding::DOUBLE[]"
HEAD, TAIL = "embedding[1:32]::DOUBLE[]", "embedding[33:64]::DOUBLE[]"
KNN = _knn_sql("knn", FULL, K)
KNN_A, KNN_B = _knn_sql("ka", HEAD, K), _knn_sql("kb", TAIL, K)
SPATIAL = _knn_sql("sk", "embedding[1:2]::DOUBLE[]", K, "euclidean")


def _knn(spark, sf):
    emb = m.embedding(spark, sf)
    return nb.knn(emb, emb, K, exclude_self=True)


def knn_cosine(spark, sf):
    return _knn(spark, sf).withColumn("dist", rounded(F.col("dist")))


def knn_two_sets(spark, sf):
    found = nb.knn(m.embedding(spark, sf, 1, 32), m.embedding(spark, sf, 33, 32), K, exclude_self=True)
    return found.withColumn("dist", rounded(F.col("dist")))


def snn_jaccard(spark, sf):
    return nb.snn(_knn(spark, sf)).withColumn("weight", rounded(F.col("weight")))


def _modalities(spark, sf):
    a, b = m.embedding(spark, sf, 1, 32), m.embedding(spark, sf, 33, 32)
    return nb.knn(a, a, K, exclude_self=True), nb.knn(b, b, K, exclude_self=True)


def wnn_weights(spark, sf):
    w = nb.modality_weights(*_modalities(spark, sf))
    return w.select("src", rounded(F.col("w_first")).alias("w_first"), rounded(F.col("w_second")).alias("w_second"))


def wnn_merge(spark, sf):
    a, b = _modalities(spark, sf)
    merged = nb.merge_neighbors(a, b, nb.modality_weights(a, b), K)
    return merged.withColumn("dist", rounded(F.col("dist")))


def soft_assignment(spark, sf):
    return nb.soft_assignment(m.embedding(spark, sf), CENTROIDS, 0.5).withColumn("weight", rounded(F.col("weight")))


def knn_vote(spark, sf):
    labels = m.embedding(spark, sf).select("cell_id", F.col("cluster").alias("label"))
    return nb.vote(_knn(spark, sf), labels)


def imputation_weights(spark, sf):
    return nb.imputation_weights(_knn(spark, sf)).withColumn("weight", rounded(F.col("weight")))


def leverage_scores(spark, sf):
    return nb.leverage(m.embedding(spark, sf)).withColumn("score", rounded(F.col("score")))


def guaranteed_sketch(spark, sf):
    scores = nb.leverage(m.embedding(spark, sf))
    return nb.proportional_sample(scores, 200).where("guaranteed").select("cell_id")


def sketch_sample(spark, sf):
    return nb.proportional_sample(nb.leverage(m.embedding(spark, sf)), 200)


def _points(spark, sf):
    return m.points(spark, sf).withColumnRenamed("id", "cell_id")


def _spatial(spark, sf):
    return sp.spatial_knn(_points(spark, sf), K, 0.05)


def spatial_knn(spark, sf):
    return _spatial(spark, sf).select("src", "rank", "dst", rounded(F.col("dist"), 7).alias("dist"))


def gaussian_weights(spark, sf):
    return nb.gaussian_weights(_spatial(spark, sf)).withColumn("weight", rounded(F.col("weight")))


def _values(spark, sf):
    return m.embedding(spark, sf).select("cell_id", F.posexplode(F.slice("vec", 3, 6)).alias("feature_id", "value"))


def neighbor_mean(spark, sf):
    found = nb.weighted_values(nb.gaussian_weights(_spatial(spark, sf)), _values(spark, sf))
    return found.withColumn("value", rounded(F.col("value")))


def zscore_columns(spark, sf):
    sample = nb.zscore_columns(_values(spark, sf), "feature_id", "value")
    pop = nb.zscore_columns(_values(spark, sf), "feature_id", "value", True).select("cell_id", "feature_id", rounded(F.col("value")).alias("population"))
    return sample.withColumn("value", rounded(F.col("value"))).join(pop, ["cell_id", "feature_id"])


def banksy_matrix(spark, sf):
    return nb.banksy_matrix(_values(spark, sf), _spatial(spark, sf)).withColumn("value", rounded(F.col("value"), 4))


def spatial_extent(spark, sf):
    return sp.extent(m.points(spark, sf))


def tile_pyramid(spark, sf):
    found = sp.pyramid(m.points(spark, sf), BOX)
    return found.select("level", "tx", "ty", "n", rounded(F.col("cx")).alias("cx"), rounded(F.col("cy")).alias("cy"))


def tile_sample(spark, sf):
    return sp.tile_sample(m.points(spark, sf), BOX)


def tile_sample_sizes(spark, sf):
    """How many points each tile's sample holds."""
    return sp.tile_sample(m.points(spark, sf), BOX).groupBy("level", "tx", "ty").agg(F.count_distinct("id").alias("n"))


def viewport_level(spark, sf):
    found = sp.viewport_level(sp.pyramid(m.points(spark, sf), BOX), BOX, (-0.1, 0.1, -0.1, 0.1), 150)
    return found.select("level", "n")


def point_in_polygon(spark, sf):
    return m.points(spark, sf).where(sp.in_polygon(F.col("x"), F.col("y"), POLYGON)).select("id", "x", "y")


def affine_points(spark, sf):
    x, y = sp.transform(F.col("x"), F.col("y"), AFFINE)
    moved = m.points(spark, sf).select("id", x.alias("x"), y.alias("y"))
    bx, by = sp.transform(F.col("x"), F.col("y"), sp.inverse(AFFINE))
    return moved.select("id", rounded(F.col("x")).alias("x"), rounded(F.col("y")).alias("y"), rounded(bx, 5).alias("back_x"), rounded(by, 5).alias("back_y"))


def orientation_search(spark, sf):
    return sp.orientation(m.points(spark, sf), (100.0, 100.0), MAPS).select("name", rounded(F.col("score")).alias("score"), "rank")


def image_tile_grid(spark, sf):
    return sp.image_tiles(spark, 3000, 1300, 512, AFFINE).select("col", "row", *[rounded(F.col(c)).alias(c) for c in ("x0", "x1", "y0", "y1")])


def grid_density(spark, sf):
    return sp.grid_density(m.points(spark, sf), 0.05, F.lit(1.0))


def _polygon_sql() -> str:
    terms = []
    for (xi, yi), (xj, yj) in zip(POLYGON, [POLYGON[-1], *POLYGON[:-1]], strict=True):
        rise = yj - yi if yj != yi else 1e-12
        terms.append(f"(CASE WHEN (CAST({yi} AS DOUBLE) > y) <> (CAST({yj} AS DOUBLE) > y) AND x < CAST({xj - xi} AS DOUBLE) * (y - CAST({yi} AS DOUBLE)) / CAST({rise} AS DOUBLE) + CAST({xi} AS DOUBLE) THEN 1 ELSE 0 END)")
    return f"({' + '.join(terms)}) % 2 = 1"


def _affine_sql(m, x, y):
    a, b, c, d, e, f = m
    return f"({a} * {x} + {b} * {y} + {c})", f"({d} * {x} + {e} * {y} + {f})"


_P = "p AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, label AS cluster FROM embeddings)"
_WNN = f"{KNN_A}, {KNN_B}, wa AS (SELECT src, CASE WHEN avg(dist) <= 1e-12 THEN 1e12 ELSE 1 / avg(dist) END AS a FROM ka GROUP BY 1), wb AS (SELECT src, CASE WHEN avg(dist) <= 1e-12 THEN 1e12 ELSE 1 / avg(dist) END AS b FROM kb GROUP BY 1), w AS (SELECT src, a / (a + b) AS w_first, b / (a + b) AS w_second FROM wa JOIN wb USING (src))"
_GAUSS = f"{SPATIAL}, md AS (SELECT src, max(CASE WHEN rank = {K // 2 + 1} THEN dist END) AS m FROM sk GROUP BY 1), ex AS (SELECT src, dst, exp(-dist / CASE WHEN m = 0 THEN 1e-10 ELSE m END) AS e FROM sk JOIN md USING (src)), gw AS (SELECT src, dst, CASE WHEN sum(e) OVER (PARTITION BY src) <= 1e-12 THEN 0.0 ELSE e / sum(e) OVER (PARTITION BY src) END AS weight FROM ex)"
_VAL = "val AS (SELECT vec_id AS cell_id, CAST(f AS INTEGER) AS feature_id, embedding[3 + f]::DOUBLE AS value FROM embeddings, (SELECT unnest(range(0, 6)) AS f))"
_NM = "nm AS (SELECT src, feature_id, sum(weight * value) AS value FROM gw JOIN val ON cell_id = dst GROUP BY 1, 2)"
_Z = "(value - avg(value) OVER (PARTITION BY feature_id)) / stddev_samp(value) OVER (PARTITION BY feature_id)"
_PYR = "t AS (SELECT CAST(level AS INTEGER) AS level, CAST(greatest(0, least(floor((x + 1.0) / 2.0 * pow(2.0, level)), pow(2.0, level) - 1)) AS INTEGER) AS tx, CAST(greatest(0, least(floor((y + 1.0) / 2.0 * pow(2.0, level)), pow(2.0, level) - 1)) AS INTEGER) AS ty, x, y FROM p, (SELECT unnest(range(0, 9)) AS level)), pyr AS (SELECT level, tx, ty, count(*) AS n, avg(x) AS cx, avg(y) AS cy FROM t GROUP BY 1, 2, 3)"
_AX, _AY = _affine_sql(AFFINE, "x", "y")
_BX, _BY = _affine_sql(sp.inverse(AFFINE), _AX, _AY)


def _orient_sql() -> str:
    parts = []
    for k, (name, mp) in enumerate(MAPS.items()):
        x, y = _affine_sql(mp, "x", "y")
        parts.append(f"SELECT '{name}' AS name, {k} AS k, avg(CASE WHEN {x} BETWEEN -25.0 AND 125.0 AND {y} BETWEEN -25.0 AND 125.0 THEN 1.0 ELSE 0.0 END) AS score FROM p")
    return f"WITH {_P}, s AS ({' UNION ALL '.join(parts)}) SELECT name, round(score, 6) + 0.0 AS score, CAST(row_number() OVER (ORDER BY score DESC, k) AS INTEGER) AS rank FROM s"


_CENT = "[" + ", ".join("[" + ", ".join(map(str, c)) + "]" for c in CENTROIDS) + "]"

QUERIES = {
    "knn_cosine": (knn_cosine, f"WITH {KNN} SELECT src, rank, dst, round(dist, 6) + 0.0 AS dist FROM knn"),
    "knn_two_sets": (knn_two_sets, f"WITH {_knn_sql('knn', HEAD, K, other=TAIL)} SELECT src, rank, dst, round(dist, 6) + 0.0 AS dist FROM knn"),
    "snn_jaccard": (snn_jaccard, f"WITH {KNN}, pr AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM knn), sh AS (SELECT pr.a AS a, pr.b AS b, count(*) AS n FROM pr JOIN knn x ON x.src = pr.a JOIN knn y ON y.src = pr.b AND y.dst = x.dst GROUP BY 1, 2) SELECT a AS src, b AS dst, round(n / CAST({2 * K} - n AS DOUBLE), 6) + 0.0 AS weight FROM sh"),
    "wnn_weights": (wnn_weights, f"WITH {_WNN} SELECT src, round(w_first, 6) + 0.0 AS w_first, round(w_second, 6) + 0.0 AS w_second FROM w"),
    "wnn_merge": (wnn_merge, f"WITH {_WNN}, sa AS (SELECT ka.src AS src, dst, dist FROM ka JOIN w ON w.src = ka.src WHERE rank <= floor(w_first * {K} + 0.5)), sb AS (SELECT kb.src AS src, dst, dist FROM kb JOIN w ON w.src = kb.src WHERE rank <= {K} - floor(w_first * {K} + 0.5)), mg AS (SELECT src, dst, avg(dist) AS dist FROM (SELECT * FROM sa UNION ALL SELECT * FROM sb) GROUP BY 1, 2), rk AS (SELECT src, dst, dist, row_number() OVER (PARTITION BY src ORDER BY round(dist, 9), dst) AS rank FROM mg), pl AS (SELECT src, rank FROM w, (SELECT unnest(range(1, {K + 1})) AS rank)) SELECT pl.src AS src, CAST(pl.rank AS INTEGER) AS rank, coalesce(dst, pl.src) AS dst, round(coalesce(dist, 1.0), 6) + 0.0 AS dist FROM pl LEFT JOIN rk ON rk.src = pl.src AND rk.rank = pl.rank"),
    "soft_assignment": (soft_assignment, f"WITH e AS (SELECT vec_id AS cell_id, {FULL} AS v FROM embeddings), c AS (SELECT CAST(i - 1 AS INTEGER) AS cluster, cs[i]::DOUBLE[] AS c FROM (SELECT {_CENT} AS cs, unnest([1, 2, 3, 4]) AS i)), z AS (SELECT cell_id, cluster, -2 * (1 - list_dot_product(v, c) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(c, c)))) / 0.5 AS z FROM e, c), x AS (SELECT cell_id, cluster, exp(z - max(z) OVER (PARTITION BY cell_id)) AS x FROM z) SELECT cell_id, cluster, round(x / sum(x) OVER (PARTITION BY cell_id), 6) + 0.0 AS weight FROM x"),
    "knn_vote": (knn_vote, f"WITH {KNN}, v AS (SELECT src, label, count(*) AS n, min(rank) AS nearest FROM knn JOIN embeddings ON vec_id = dst GROUP BY 1, 2) SELECT src, label FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY n DESC, nearest) AS k FROM v) WHERE k = 1"),
    "imputation_weights": (imputation_weights, f"WITH {KNN}, v AS (SELECT *, count(CASE WHEN dist < 1 THEN 1 END) OVER (PARTITION BY src) AS n, sum(CASE WHEN dist < 1 THEN dist ELSE 0.0 END) OVER (PARTITION BY src) AS s, count(*) OVER (PARTITION BY src) AS al FROM knn) SELECT src, dst, round(CASE WHEN n = 0 THEN 1.0 / al WHEN n = 1 THEN 1.0 WHEN s < 1e-12 THEN 1.0 / n ELSE (1 - dist / s) / (n - 1) END, 6) + 0.0 AS weight FROM v WHERE n = 0 OR dist < 1"),
    "leverage_scores": (leverage_scores, f"SELECT vec_id AS cell_id, round(list_dot_product({FULL}, {FULL}), 6) + 0.0 AS score FROM embeddings"),
    "guaranteed_sketch": (guaranteed_sketch, f"SELECT vec_id AS cell_id FROM embeddings ORDER BY round(list_dot_product({FULL}, {FULL}), 9) DESC, vec_id LIMIT 50"),
    "sketch_sample": (sketch_sample, None),
    "spatial_knn": (spatial_knn, f"WITH {SPATIAL} SELECT src, rank, dst, round(dist, 7) + 0.0 AS dist FROM sk"),
    "gaussian_weights": (gaussian_weights, f"WITH {_GAUSS} SELECT src, dst, round(weight, 6) + 0.0 AS weight FROM gw"),
    "neighbor_mean": (neighbor_mean, f"WITH {_GAUSS}, {_VAL}, {_NM} SELECT src, feature_id, round(value, 6) + 0.0 AS value FROM nm"),
    "zscore_columns": (zscore_columns, f"WITH {_VAL} SELECT cell_id, feature_id, round({_Z}, 6) + 0.0 AS value, round((value - avg(value) OVER (PARTITION BY feature_id)) / stddev_pop(value) OVER (PARTITION BY feature_id), 6) + 0.0 AS population FROM val"),
    "banksy_matrix": (banksy_matrix, f"WITH {_GAUSS}, {_VAL}, {_NM} SELECT cell_id, 'own_' || CAST(feature_id AS VARCHAR) AS feature, round(sqrt(0.7) * ({_Z}), 4) + 0.0 AS value FROM val UNION ALL SELECT src AS cell_id, 'nbr_' || CAST(feature_id AS VARCHAR) AS feature, round(sqrt(0.3) * ({_Z}), 4) + 0.0 AS value FROM nm"),
    "spatial_extent": (spatial_extent, f"WITH {_P} SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p"),
    "tile_pyramid": (tile_pyramid, f"WITH {_P}, {_PYR} SELECT level, tx, ty, n, round(cx, 6) + 0.0 AS cx, round(cy, 6) + 0.0 AS cy FROM pyr"),
    "tile_sample": (tile_sample, None),
    "tile_sample_sizes": (tile_sample_sizes, f"WITH {_P}, {_PYR} SELECT level, tx, ty, CAST(least(n, 64, round(4 * pow(1.5, level))) AS BIGINT) AS n FROM pyr"),
    "viewport_level": (viewport_level, f"WITH {_P}, {_PYR}, l AS (SELECT level, CAST(sum(least(n, 32)) AS BIGINT) AS n FROM pyr WHERE -1 + tx * (2.0 / pow(2.0, level)) <= 0.1 AND -1 + (tx + 1) * (2.0 / pow(2.0, level)) >= -0.1 AND -1 + ty * (2.0 / pow(2.0, level)) <= 0.1 AND -1 + (ty + 1) * (2.0 / pow(2.0, level)) >= -0.1 GROUP BY 1) SELECT level, n FROM l WHERE level = (SELECT coalesce(max(CASE WHEN n <= 150 THEN level END), min(level)) FROM l)"),
    "point_in_polygon": (point_in_polygon, f"WITH {_P} SELECT id, x, y FROM p WHERE {_polygon_sql()}"),
    "affine_points": (affine_points, f"WITH {_P} SELECT id, round({_AX}, 6) + 0.0 AS x, round({_AY}, 6) + 0.0 AS y, round({_BX}, 5) + 0.0 AS back_x, round({_BY}, 5) + 0.0 AS back_y FROM p"),
    "orientation_search": (orientation_search, _orient_sql()),
    "image_tile_grid": (image_tile_grid, "WITH g AS (SELECT c AS col, r AS row, CAST(c * 512 AS DOUBLE) AS x0, CAST(least(c * 512 + 512, 3000) AS DOUBLE) AS x1, CAST(r * 512 AS DOUBLE) AS y0, CAST(least(r * 512 + 512, 1300) AS DOUBLE) AS y1 FROM (SELECT unnest(range(0, 6)) AS c), (SELECT unnest(range(0, 3)) AS r)) SELECT col, row, round(1.5 * x0 + 0.2 * y0 + 3.0, 6) + 0.0 AS x0, round(1.5 * x1 + 0.2 * y1 + 3.0, 6) + 0.0 AS x1, round(-0.1 * x1 + 0.8 * y0 - 2.0, 6) + 0.0 AS y0, round(-0.1 * x0 + 0.8 * y1 - 2.0, 6) + 0.0 AS y1 FROM g"),
    "grid_density": (grid_density, f"WITH {_P} SELECT CAST(floor(x / 0.05) AS BIGINT) AS gx, CAST(floor(y / 0.05) AS BIGINT) AS gy, CAST(count(*) AS DOUBLE) AS weight FROM p GROUP BY 1, 2"),
}
