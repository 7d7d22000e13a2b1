"""Queries on counts, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import model as m
from ..model import rounded
from ..operators import matrix, summaries

C = "counts AS (SELECT l_partkey AS feature_id, l_suppkey AS cell_id, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2)"
SC = "counts AS (SELECT l_partkey AS feature_id, o_custkey AS cell_id, sum(l_quantity) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"
CELLS = "cells AS (SELECT s_suppkey AS cell_id, s_nationkey AS cluster, n_name AS label, n_regionkey AS sample FROM supplier JOIN nation ON s_nationkey = n_nationkey)"
SCELLS = "cells AS (SELECT c_custkey AS cell_id, c_nationkey AS cluster, n_name AS label, n_regionkey AS sample FROM customer JOIN nation ON c_nationkey = n_nationkey)"
TOTALS = "bc AS (SELECT cell_id, sum(value) AS c FROM counts GROUP BY 1), br AS (SELECT feature_id, sum(value) AS r FROM counts GROUP BY 1), nn AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM supplier)"
LOGN = "bc AS (SELECT cell_id, sum(value) AS c FROM counts GROUP BY 1), ln_ AS (SELECT feature_id, cell_id, CASE WHEN c = 0 THEN 0.0 ELSE ln(1 + value * 10000.0 / c) END AS value FROM counts JOIN bc USING (cell_id))"


def _n(spark, sf, name):
    return m.table(spark, sf, name).count()


def col_sums(spark, sf):
    return matrix.axis_sums(m.counts(spark, sf), "cell_id", m.cells(spark, sf)).select("cell_id", "total")


def row_sums(spark, sf):
    return matrix.axis_sums(m.counts(spark, sf), "feature_id", m.features(spark, sf)).select("feature_id", "total")


def nnz_per_cell(spark, sf):
    return matrix.axis_sums(m.counts(spark, sf), "cell_id", m.cells(spark, sf)).select("cell_id", "nnz")


def filter_cells_min_features(spark, sf):
    return matrix.filter_axis_min_entries(m.sparse_counts(spark, sf), "cell_id", 40)


def filter_features_min_cells(spark, sf):
    return matrix.filter_axis_min_entries(m.sparse_counts(spark, sf), "feature_id", 30)


def top_features_q5(spark, sf):
    return matrix.top_features(m.counts(spark, sf), m.features(spark, sf), 0.05).select("feature_id", "total", rounded(F.col("percentile"), 9).alias("percentile"))


def _tfidf(method):
    def query(spark, sf):
        return matrix.tfidf(m.counts(spark, sf), _n(spark, sf, "supplier"), method).select("feature_id", "cell_id", rounded(F.col("value")).alias("value"))

    return query


def tfidf_top_features(spark, sf):
    """Flagship: features over the q5 cutoff, TF-IDF on the whole matrix, the 50 of largest sum."""
    counts = m.counts(spark, sf)
    top = matrix.top_features(counts, m.features(spark, sf), 0.05).select("feature_id")
    scored = matrix.tfidf(counts, _n(spark, sf, "supplier"), 1).join(top, "feature_id", "left_semi")
    sums = scored.groupBy("feature_id").agg(rounded(F.sum("value"), 4).alias("weight"))
    return sums.orderBy(F.desc("weight"), "feature_id").limit(50)


def log_normalize(spark, sf):
    return matrix.log_normalize(m.counts(spark, sf)).select("feature_id", "cell_id", rounded(F.col("value")).alias("value"))


def hvg_dispersion(spark, sf):
    top = matrix.highly_variable(matrix.log_normalize(m.counts(spark, sf)), _n(spark, sf, "supplier"), 100)
    return top.select("feature_id", rounded(F.col("mean")).alias("mean"), rounded(F.col("variance")).alias("variance"), rounded(F.col("dispersion")).alias("dispersion"))


def hvg_raw_counts(spark, sf):
    top = matrix.highly_variable(m.counts(spark, sf), _n(spark, sf, "supplier"), 100)
    return top.select("feature_id", rounded(F.col("mean")).alias("mean"), rounded(F.col("variance")).alias("variance"), rounded(F.col("dispersion")).alias("dispersion"))


def streaming_hvg_matrix(spark, sf):
    rows = matrix.streaming_pipeline(m.sparse_counts(spark, sf), 200, 40)
    return rows.select("feature_id", "cell_id", rounded(F.col("value")).alias("value"))


def gene_vector_dense(spark, sf):
    return matrix.feature_vector(matrix.log_normalize(m.counts(spark, sf)), m.cells(spark, sf), 7).select("cell_id", rounded(F.col("value")).alias("value"))


def subset_rows(spark, sf):
    order = m.features(spark, sf).where(F.col("feature_id") % 10 == 3).select(F.col("feature_id").alias("id"), (1_000_000 - F.col("feature_id")).alias("new_id"))
    return matrix.subset(m.counts(spark, sf), "feature_id", order)


def subset_cols(spark, sf):
    order = m.cells(spark, sf).where(F.col("cluster") < 5).select(F.col("cell_id").alias("id"), (F.col("cell_id") * 2).alias("new_id"))
    return matrix.subset(m.counts(spark, sf), "cell_id", order)


def hconcat_samples(spark, sf):
    n = _n(spark, sf, "supplier")
    counts = m.counts(spark, sf)
    parts = [(counts.where(F.col("feature_id") % 2 == 0), n), (counts.where(F.col("feature_id") % 2 == 1), n)]
    return matrix.concat_cells(parts)


def unpivot_wide(spark, sf):
    wide = m.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("cell_id")).pivot("l_returnflag", ["A", "N", "R"]).agg(F.sum("l_quantity"))
    wide = wide.withColumnRenamed("R", "NegPrb1")
    return matrix.wide_to_long(wide, "cell_id")


def spmm(spark, sf):
    dense = m.cells(spark, sf).select("cell_id", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), ((F.col("cell_id") * (k + 1)) % 7).cast("double").alias("weight")) for k in range(4)])).alias("e")).select("cell_id", "e.k", "e.weight")
    return matrix.times_dense(m.counts(spark, sf), dense, "feature_id", "cell_id")


def qc_metrics(spark, sf):
    found = summaries.qc_metrics(m.counts(spark, sf), m.cells(spark, sf), F.col("feature_id") % 20 == 0)
    return found.withColumn("mito_pct", rounded(F.col("mito_pct")))


def qc_filter(spark, sf):
    found = summaries.qc_metrics(m.sparse_counts(spark, sf), m.sparse_cells(spark, sf), F.col("feature_id") % 20 == 0)
    return summaries.qc_filter(found, 30, 500, 8).select("cell_id", "n_features", "total")


def qc_histogram(spark, sf):
    return summaries.histogram(matrix.axis_sums(m.sparse_counts(spark, sf), "cell_id", m.sparse_cells(spark, sf)), "total")


def _dots(spark, sf, group="cluster"):
    return summaries.dot_plot(m.counts(spark, sf), m.cells(spark, sf), group)


def dotplot_stats(spark, sf):
    return _dots(spark, sf).select("cluster", "feature_id", "n_cells", rounded(F.col("pct")).alias("pct"), rounded(F.col("avg")).alias("avg"))


def dotplot_merge_samples(spark, sf):
    cells = m.cells(spark, sf).select("cluster", "sample").distinct()
    merged = summaries.dot_plot_merge(_dots(spark, sf).join(cells, "cluster"), "sample")
    return merged.select("sample", "feature_id", "n_cells", rounded(F.col("pct")).alias("pct"), rounded(F.col("avg")).alias("avg"))


def dotplot_merge_labels(spark, sf):
    stats = _dots(spark, sf).withColumn("label", F.concat(F.lit("L"), (F.col("cluster") % 6).cast("string")))
    merged = summaries.dot_plot_merge(stats, "label", True)
    return merged.select("label", "feature_id", "n_cells", rounded(F.col("pct")).alias("pct"), rounded(F.col("avg")).alias("avg"))


def dotplot_scaled(spark, sf):
    return summaries.dot_plot_scaled(_dots(spark, sf)).select("cluster", "feature_id", rounded(F.col("scaled"), 5).alias("scaled"))


def _values(spark, sf):
    return m.table(spark, sf, "orders").select(F.col("o_orderstatus").alias("grp"), F.col("o_totalprice").alias("v"))


def violin_summary(spark, sf):
    found = summaries.violin(_values(spark, sf), "grp", "v")
    return found.select("grp", "n", *[rounded(F.col(c), 4).alias(c) for c in ("min", "max", "mean", "q1", "median", "q3")])


def violin_summary_ranked(spark, sf):
    found = summaries.violin_ranked(_values(spark, sf), "grp", "v")
    return found.select("grp", "n", *[rounded(F.col(c), 4).alias(c) for c in ("q1", "median", "q3")])


def violin_kde(spark, sf):
    found = summaries.density(_values(spark, sf).withColumn("v", F.col("v") / 1000), "grp", "v")
    return found.select("grp", "step", rounded(F.col("x")).alias("x"), rounded(F.col("density")).alias("density"))


def cell_fraction(spark, sf):
    return summaries.composition(m.sparse_cells(spark, sf), "sample", "cluster").select("sample", "cluster", "n", rounded(100 * F.col("fraction")).alias("pct"))


def region_composition(spark, sf):
    pts = m.points(spark, sf).withColumn("region", F.when(F.col("x") >= 0, "east").otherwise("west"))
    return summaries.composition(pts, "region", "cluster").withColumn("fraction", rounded(F.col("fraction")))


def cluster_info(spark, sf):
    return summaries.cluster_info(m.sparse_cells(spark, sf)).withColumn("fraction", rounded(F.col("fraction")))


def merge_clusters(spark, sf):
    nation = m.table(spark, sf, "nation").orderBy("n_nationkey").limit(2).collect()
    return summaries.merge_clusters(m.cells(spark, sf), {nation[0].n_name: nation[1].n_name}).select("cell_id", "cluster", "label")


def annotate_cells(spark, sf):
    labels = m.table(spark, sf, "nation").where("n_nationkey % 3 = 0").select(F.col("n_nationkey").alias("cluster"), F.concat(F.lit("type "), "n_name").alias("name"))
    return summaries.annotate(m.cells(spark, sf), labels).select("cell_id", "cluster", "annotation")


def paged_listing(spark, sf):
    return summaries.page(m.features(spark, sf), "feature_id", 40, 25).select("feature_id", "name")


def _tf_sql(expr):
    return f"WITH {C}, {TOTALS} SELECT feature_id, cell_id, round({expr}, 6) + 0.0 AS value FROM counts JOIN bc USING (cell_id) JOIN br USING (feature_id), nn"


_HVG = "SELECT feature_id, round(mean, 6) + 0.0 AS mean, round(variance, 6) + 0.0 AS variance, round(dispersion, 6) + 0.0 AS dispersion FROM (SELECT *, CASE WHEN mean > 1e-12 THEN variance / mean ELSE variance END AS dispersion FROM (SELECT feature_id, s / n AS mean, ss / n - (s / n) * (s / n) AS variance FROM (SELECT feature_id, sum(value) AS s, sum(value * value) AS ss FROM {src} GROUP BY 1), nn)) ORDER BY round(CASE WHEN mean > 1e-12 THEN variance / mean ELSE variance END, 9) DESC, feature_id LIMIT {n}"
_NN = "nn AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM supplier)"
_DOTS = "sz AS (SELECT cluster, count(*) AS n_cells FROM cells GROUP BY 1), dots AS (SELECT cluster, feature_id, n_cells, ne / CAST(n_cells AS DOUBLE) AS pct, s / ne AS avg FROM (SELECT cluster, feature_id, count(*) AS ne, sum(value) AS s FROM counts JOIN cells USING (cell_id) WHERE value > 0 GROUP BY 1, 2) JOIN sz USING (cluster))"
_MERGE = "SELECT {g}, feature_id, CAST(sum(n_cells) AS BIGINT) AS n_cells, round(sum(d) / sum(n_cells), 6) + 0.0 AS pct, round(sum(d * avg) / sum(d), 6) + 0.0 AS avg FROM ({src}) GROUP BY 1, 2"

QUERIES = {
    "col_sums": (col_sums, f"WITH {C} SELECT s_suppkey AS cell_id, coalesce(sum(value), 0.0) AS total FROM supplier LEFT JOIN counts ON cell_id = s_suppkey GROUP BY 1"),
    "row_sums": (row_sums, f"WITH {C} SELECT p_partkey AS feature_id, coalesce(sum(value), 0.0) AS total FROM part LEFT JOIN counts ON feature_id = p_partkey GROUP BY 1"),
    "nnz_per_cell": (nnz_per_cell, f"WITH {C} SELECT s_suppkey AS cell_id, count(value) AS nnz FROM supplier LEFT JOIN counts ON cell_id = s_suppkey GROUP BY 1"),
    "filter_cells_min_features": (filter_cells_min_features, f"WITH {SC} SELECT cell_id, count(*) AS nnz FROM counts GROUP BY 1 HAVING count(*) >= 40"),
    "filter_features_min_cells": (filter_features_min_cells, f"WITH {SC} SELECT feature_id, count(*) AS nnz FROM counts GROUP BY 1 HAVING count(*) >= 30"),
    "top_features_q5": (top_features_q5, f"WITH {C}, t AS (SELECT p_partkey AS feature_id, coalesce(sum(value), 0.0) AS total FROM part LEFT JOIN counts ON feature_id = p_partkey GROUP BY 1) SELECT feature_id, total, round(p, 9) + 0.0 AS percentile FROM (SELECT *, cume_dist() OVER (ORDER BY total) AS p FROM t) WHERE p > 0.05"),
    "tfidf_m1": (_tfidf(1), _tf_sql("ln(1 + value / c * (n / r) * 10000.0)")),
    "tfidf_m2": (_tfidf(2), _tf_sql("value / c * ln(1 + n / r)")),
    "tfidf_m3": (_tfidf(3), _tf_sql("ln(1 + value / c * 10000.0) * ln(1 + n / r)")),
    "tfidf_m4": (_tfidf(4), _tf_sql("n / r")),
    "tfidf_top_features": (tfidf_top_features, f"WITH {C}, {TOTALS}, t AS (SELECT feature_id, sum(value) AS total FROM counts GROUP BY 1 UNION ALL SELECT p_partkey, 0.0 FROM part WHERE p_partkey NOT IN (SELECT feature_id FROM counts)), top AS (SELECT feature_id FROM (SELECT feature_id, cume_dist() OVER (ORDER BY total) AS p FROM t) WHERE p > 0.05) SELECT feature_id, round(sum(ln(1 + value / c * (n / r) * 10000.0)), 4) + 0.0 AS weight FROM counts JOIN bc USING (cell_id) JOIN br USING (feature_id), nn WHERE feature_id IN (SELECT feature_id FROM top) GROUP BY 1 ORDER BY weight DESC, feature_id LIMIT 50"),
    "log_normalize": (log_normalize, f"WITH {C}, {LOGN} SELECT feature_id, cell_id, round(value, 6) + 0.0 AS value FROM ln_"),
    "hvg_dispersion": (hvg_dispersion, f"WITH {C}, {LOGN}, {_NN} " + _HVG.format(src="ln_", n=100)),
    "hvg_raw_counts": (hvg_raw_counts, f"WITH {C}, {_NN} " + _HVG.format(src="counts", n=100)),
    "streaming_hvg_matrix": (streaming_hvg_matrix, f"WITH {SC}, kept AS (SELECT cell_id FROM counts GROUP BY 1 HAVING count(*) >= 40), k AS (SELECT * FROM counts WHERE cell_id IN (SELECT cell_id FROM kept)), nn AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM kept), top AS (SELECT feature_id FROM (" + _HVG.format(src="k", n=200) + ")), bc AS (SELECT cell_id, sum(value) AS c FROM k GROUP BY 1) SELECT feature_id, cell_id, round(ln(1 + value * 10000.0 / c), 6) + 0.0 AS value FROM k JOIN bc USING (cell_id) WHERE feature_id IN (SELECT feature_id FROM top)"),
    "gene_vector_dense": (gene_vector_dense, f"WITH {C}, {LOGN} SELECT s_suppkey AS cell_id, round(coalesce(value, 0.0), 6) + 0.0 AS value FROM supplier LEFT JOIN (SELECT * FROM ln_ WHERE feature_id = 7) ON cell_id = s_suppkey"),
    "subset_rows": (subset_rows, f"WITH {C} SELECT 1000000 - feature_id AS feature_id, cell_id, value FROM counts WHERE feature_id % 10 = 3"),
    "subset_cols": (subset_cols, f"WITH {C}, {CELLS} SELECT cell_id * 2 AS cell_id, feature_id, value FROM counts JOIN cells USING (cell_id) WHERE cluster < 5"),
    "hconcat_samples": (hconcat_samples, f"WITH {C}, nn AS (SELECT count(*) AS n FROM supplier) SELECT feature_id, cell_id, value FROM counts WHERE feature_id % 2 = 0 UNION ALL SELECT feature_id, cell_id + n AS cell_id, value FROM counts, nn WHERE feature_id % 2 = 1"),
    "unpivot_wide": (unpivot_wide, "SELECT l_suppkey AS cell_id, l_returnflag AS feature, sum(l_quantity) AS value FROM lineitem WHERE l_returnflag IN ('A', 'N') GROUP BY 1, 2 HAVING sum(l_quantity) > 0"),
    "spmm": (spmm, f"WITH {C}, {CELLS}, k AS (SELECT unnest([0, 1, 2, 3]) AS k) SELECT feature_id, CAST(k AS INTEGER) AS k, sum(value * CAST((cell_id * (k + 1)) % 7 AS DOUBLE)) AS value FROM counts, k GROUP BY 1, 2"),
    "qc_metrics": (qc_metrics, f"WITH {C} SELECT s_suppkey AS cell_id, count(CASE WHEN value > 0 THEN 1 END) AS n_features, coalesce(sum(value), 0.0) AS total, round(coalesce(100 * sum(CASE WHEN feature_id % 20 = 0 THEN value ELSE 0.0 END) / nullif(sum(value), 0), 0.0), 6) + 0.0 AS mito_pct FROM supplier LEFT JOIN counts ON cell_id = s_suppkey GROUP BY 1"),
    "qc_filter": (qc_filter, f"WITH {SC} SELECT cell_id, count(*) AS n_features, sum(value) AS total FROM counts WHERE value > 0 GROUP BY 1 HAVING count(*) >= 30 AND sum(value) >= 500 AND 100 * sum(CASE WHEN feature_id % 20 = 0 THEN value ELSE 0.0 END) / sum(value) <= 8"),
    "qc_histogram": (qc_histogram, f"WITH {SC}, t AS (SELECT c_custkey AS cell_id, coalesce(sum(value), 0.0) AS v FROM customer LEFT JOIN counts ON cell_id = c_custkey GROUP BY 1), top AS (SELECT v AS top FROM (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i, count(*) OVER () AS n FROM t) WHERE i = CAST(floor(n * 0.95) AS BIGINT)) SELECT CAST(least(floor(least(v, top) / (top / 30)), 29) AS INTEGER) AS bin, count(*) AS n FROM t, top GROUP BY 1"),
    "dotplot_stats": (dotplot_stats, f"WITH {C}, {CELLS}, {_DOTS} SELECT cluster, feature_id, n_cells, round(pct, 6) + 0.0 AS pct, round(avg, 6) + 0.0 AS avg FROM dots"),
    "dotplot_merge_samples": (dotplot_merge_samples, f"WITH {C}, {CELLS}, {_DOTS} " + _MERGE.format(g="sample", src="SELECT sample, feature_id, n_cells, pct * n_cells AS d, avg FROM dots JOIN (SELECT DISTINCT cluster, sample FROM cells) USING (cluster)")),
    "dotplot_merge_labels": (dotplot_merge_labels, f"WITH {C}, {CELLS}, {_DOTS} " + _MERGE.format(g="label", src="SELECT 'L' || CAST(cluster % 6 AS VARCHAR) AS label, feature_id, n_cells, floor(pct * n_cells + 0.5) AS d, avg FROM dots")),
    "dotplot_scaled": (dotplot_scaled, f"WITH {C}, {CELLS}, {_DOTS}, z AS (SELECT *, avg(avg) OVER (PARTITION BY feature_id) AS mu, stddev_samp(avg) OVER (PARTITION BY feature_id) AS sd FROM dots) SELECT cluster, feature_id, round(greatest(-4.0, least(4.0, (avg - mu) / CASE WHEN sd IS NULL OR sd < 1e-12 THEN 1.0 ELSE sd END)), 5) + 0.0 AS scaled FROM z"),
    "violin_summary": (violin_summary, "SELECT o_orderstatus AS grp, count(*) AS n, round(min(o_totalprice), 4) + 0.0 AS min, round(max(o_totalprice), 4) + 0.0 AS max, round(avg(o_totalprice), 4) + 0.0 AS mean, round(quantile_cont(o_totalprice, 0.25), 4) + 0.0 AS q1, round(quantile_cont(o_totalprice, 0.5), 4) + 0.0 AS median, round(quantile_cont(o_totalprice, 0.75), 4) + 0.0 AS q3 FROM orders GROUP BY 1"),
    "violin_summary_ranked": (violin_summary_ranked, "WITH r AS (SELECT o_orderstatus AS grp, o_totalprice AS v, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice) - 1 AS i, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders) SELECT grp, max(n) AS n, round(max(CASE WHEN i = floor(n * 0.25) THEN v END), 4) + 0.0 AS q1, round((max(CASE WHEN i = floor((n - 1) / 2.0) THEN v END) + max(CASE WHEN i = floor(n / 2.0) THEN v END)) / 2, 4) + 0.0 AS median, round(max(CASE WHEN i = floor(n * 0.75) THEN v END), 4) + 0.0 AS q3 FROM r GROUP BY 1"),
    "violin_kde": (violin_kde, "WITH v AS (SELECT o_orderstatus AS grp, o_totalprice / 1000 AS v FROM orders), s AS (SELECT grp, min(v) AS lo, (max(v) - min(v)) / 30 AS dx, greatest((max(v) - min(v)) / 30, 0.1) AS bw, count(*) AS n FROM v GROUP BY 1), g AS (SELECT *, unnest(range(0, 31)) AS step FROM s) SELECT g.grp AS grp, CAST(step AS INTEGER) AS step, round(any_value(lo + step * dx), 6) + 0.0 AS x, round(coalesce(sum(CASE WHEN abs((lo + step * dx - v) / bw) <= 1 THEN 0.75 * (1 - ((lo + step * dx - v) / bw) * ((lo + step * dx - v) / bw)) / (n * bw) END), 0.0), 6) + 0.0 AS density FROM g JOIN v ON v.grp = g.grp GROUP BY 1, 2"),
    "cell_fraction": (cell_fraction, f"WITH {SCELLS} SELECT sample, cluster, count(*) AS n, round(100.0 * (count(*) / CAST(sum(count(*)) OVER (PARTITION BY sample) AS DOUBLE)), 6) + 0.0 AS pct FROM cells GROUP BY 1, 2"),
    "region_composition": (region_composition, "WITH p AS (SELECT CASE WHEN embedding[1] >= 0 THEN 'east' ELSE 'west' END AS region, label AS cluster FROM embeddings) SELECT region, cluster, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY region) AS DOUBLE), 6) + 0.0 AS fraction FROM p GROUP BY 1, 2"),
    "cluster_info": (cluster_info, f"WITH {SCELLS} SELECT cluster, count(*) AS n_cells, CAST(sum(count(*)) OVER () AS BIGINT) AS total_cells, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) + 0.0 AS fraction FROM cells GROUP BY 1"),
    "merge_clusters": (merge_clusters, f"WITH {CELLS}, ren AS (SELECT cell_id, cluster, CASE WHEN label = (SELECT n_name FROM nation ORDER BY n_nationkey LIMIT 1) THEN (SELECT n_name FROM nation ORDER BY n_nationkey LIMIT 1 OFFSET 1) ELSE label END AS label FROM cells) SELECT cell_id, min(cluster) OVER (PARTITION BY label) AS cluster, label FROM ren"),
    "annotate_cells": (annotate_cells, f"WITH {CELLS} SELECT cell_id, cluster, CASE WHEN cluster % 3 = 0 THEN 'type ' || label ELSE label END AS annotation FROM cells"),
    "paged_listing": (paged_listing, "SELECT p_partkey AS feature_id, p_name AS name FROM part ORDER BY p_partkey LIMIT 25 OFFSET 40"),
}
