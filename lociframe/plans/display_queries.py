"""Queries on what is shown, on commands and on their answers, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import commands
from .. import model as m
from ..model import rounded
from ..operators import display, neighbors, spatial, stats
from .interval_queries import _BAND, COV, FRAG, IV, TSS, _cov, _sizes
from .matrix_queries import _DOTS, CELLS, LOGN, SC, SCELLS, C
from .stats_queries import _KIND, _rank_sql


def _data(spark, sf, sparse=False):
    counts, cells = (m.sparse_counts(spark, sf), m.sparse_cells(spark, sf)) if sparse else (m.counts(spark, sf), m.cells(spark, sf))
    return commands.Dataset(counts, cells.withColumn("barcode", F.concat(F.lit("AA-"), F.col("cell_id").cast("string"))), m.features(spark, sf), m.embedding(spark, sf).select("cell_id", "vec"), m.points(spark, sf))


def _name(spark, sf, k):
    return m.features(spark, sf).where(F.col("feature_id") == k).first().name


# ---- what is shown ------------------------------------------------------------------------------------------


def expression_range(spark, sf):
    """Ends of the display range by clusters: of the data shown, of the whole, and given ones."""
    rows, whole = m.table(spark, sf, "orders").where("o_orderstatus = 'F'"), m.table(spark, sf, "orders")
    col = "o_totalprice"
    kinds = {"shown": {}, "whole": {"whole": whole}, "given": {"low": 10.0, "high": 10.0}, "half": {"low": -1.0, "whole": whole}}
    out = None
    for kind, more in kinds.items():
        one = display.display_range(rows, col, **more).select(F.lit(kind).alias("kind"), rounded(F.col("low")).alias("low"), rounded(F.col("high")).alias("high"))
        out = one if out is None else out.unionByName(one)
    return out


def violin_guards(spark, sf):
    rows = m.table(spark, sf, "customer").select(F.col("c_nationkey").alias("cluster"), F.when(F.col("c_custkey") % (F.col("c_nationkey") + 1) == 0, F.col("c_acctbal")).otherwise(0.0).alias("value"))
    return display.violin_guards(rows, "cluster", "value").select("cluster", "n", rounded(F.col("nonzero")).alias("nonzero"), "drawn", rounded(F.col("width")).alias("width"))


def coverage_completed(spark, sf):
    signal = _cov(spark, sf).withColumn("sample", F.when(F.col("cluster") % 3 == 0, "a").otherwise("b"))
    groups = _sizes(spark, sf).select(F.when(F.col("cluster") % 3 == 0, "a").otherwise("b").alias("sample"), "cluster", "n_cells")
    samples = spark.createDataFrame([("a",), ("b",)], "sample string")
    return display.complete_coverage(signal, groups, samples, 24).groupBy("sample", "cluster").agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("value")).alias("total"), F.max("n_cells").alias("n_cells"))


def links_ordered(spark, sf):
    rows = m.table(spark, sf, "part").select((F.col("p_size") % 7).alias("gene"), F.col("p_partkey").alias("peak_id"), (F.col("p_partkey") % 101 - 50).alias("score"), (F.col("p_partkey") % 37 / 37).alias("pvalue"))
    out = None
    for how in ("score", "display", "draw"):
        one = display.link_order(rows, how).where("place <= 20").select(F.lit(how).alias("how"), "place", "gene", "peak_id")
        out = one if out is None else out.unionByName(one)
    return out


def clusters_ordered(spark, sf):
    from pyspark.sql import Window

    rows = m.table(spark, sf, "nation").select(F.when(F.col("n_nationkey") % 3 == 0, F.col("n_name")).otherwise(F.col("n_nationkey").cast("string")).alias("cluster"))
    return rows.select("cluster", F.row_number().over(Window.orderBy(display.cluster_order(F.col("cluster")))).alias("place"))


def tracks_ordered(spark, sf):
    out = None
    for how in ("id", "signal", "cells"):
        one = display.track_order(_cov(spark, sf), _sizes(spark, sf), how, 4).select(F.lit(how).alias("how"), "cluster", "place")
        out = one if out is None else out.unionByName(one)
    return out


def _motifs(spark, sf):
    part = m.table(spark, sf, "part")
    return part.select(F.col("p_brand").alias("motif"), F.col("p_partkey").alias("peak_id")), part.where("p_size <= 15").select(F.col("p_partkey").alias("peak_id")), part.select(F.col("p_partkey").alias("peak_id"))


def motif_enrichment(spark, sf):
    found = stats.motif_enrichment(*_motifs(spark, sf))
    return found.select("motif", "query_hits", "background_hits", rounded(F.col("fold")).alias("fold"), F.col("p_val").between(0, 1).alias("sound"))


def motifs_top(spark, sf):
    rows = stats.motif_enrichment(*_motifs(spark, sf)).select("motif", F.round("fold", 9).alias("fold"), F.lit(None).cast("double").alias("score"))
    return display.top_motifs(rows, 10).select("motif", rounded(F.col("fold")).alias("fold"))


def interactions_top(spark, sf):
    rows = m.table(spark, sf, "orders").select(F.concat(F.lit("s"), (F.col("o_custkey") % 5).cast("string")).alias("source"), F.concat(F.lit("t"), (F.col("o_orderkey") % 6).cast("string")).alias("target"), F.col("o_orderkey").cast("string").alias("pair"), (F.col("o_orderkey") % 16 / 16.0).alias("probability"))
    head, routes = display.interaction_head(rows)
    return head.select("source", "target", "pair", "probability").unionByName(routes.select("source", "target", F.lit(None).cast("string").alias("pair"), F.col("strength").alias("probability")))


def drawn_last(spark, sf):
    """The ten rows that are drawn last, over all others."""
    rows = m.table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    n = rows.count()
    return display.draw_order(rows, "c_acctbal", "c_custkey").offset(max(0, n - 10))


def listing_page(spark, sf):
    out = None
    for offset, limit in ((0, 10), (40, 500), (1_000_000, 10)):
        one = display.page(m.features(spark, sf), "feature_id", offset, limit).select(F.lit(offset).alias("offset"), F.size("items").alias("shown"), F.array_join(F.slice("items", 1, 3), ",").alias("first"), "total", "has_more", F.coalesce("next_offset", F.lit(-1).cast("long")).alias("next_offset"))
        out = one if out is None else out.unionByName(one)
    return out


def labels_by_appearance(spark, sf):
    return display.relabel_by_first(m.cells(spark, sf).select("cell_id", "cluster")).select("cell_id", F.col("new_label").cast("long").alias("new_label"))


def weights_running(spark, sf):
    cents = m.table(spark, sf, "orders").select("o_orderkey", F.round(F.col("o_totalprice") * 100).alias("cents"))
    return display.running_weights(cents, "o_orderkey", "cents").select("o_orderkey", "running")


def features_shared(spark, sf):
    """Names that two lists share in any case, of which the first holds each in upper case and every fifth again."""
    rows = m.features(spark, sf).select("feature_id", F.concat_ws(" ", "name", (F.col("feature_id") % 400).cast("string")).alias("name"))
    left = rows.where("feature_id % 2 = 0").select("feature_id", F.upper("name").alias("name"))
    return display.common_features(left, rows.where("feature_id % 3 = 0"))


def cells_aligned(spark, sf):
    view = lambda keep, shift: m.sparse_cells(spark, sf).where(keep).select((F.col("cell_id") + shift).alias("cell_id"), F.concat(F.lit("AA-"), F.col("cell_id").cast("string")).alias("barcode"))
    return display.aligned_cells(view("cell_id % 2 = 0", 10), view("cell_id % 3 = 0", 1000))


def population_zscore(spark, sf):
    rows = m.embedding(spark, sf).select("cell_id", F.posexplode("vec").alias("feature_id", "value")).where("feature_id < 8")
    return neighbors.zscore_columns(rows, "feature_id", "value", population=True).select("cell_id", "feature_id", rounded(F.col("value")).alias("value"))


def hvg_capped(spark, sf):
    """Variable features where their entries would be too many."""
    data = commands.update(_data(spark, sf), n_top=200)
    return commands.variable_features(data, m.counts(spark, sf), 2500).select("feature_id")


def gates(spark, sf):
    from ..functions import text as tx

    rows = m.table(spark, sf, "part").select("p_partkey", (F.col("p_partkey") % 11 / 10).alias("c"), (F.col("p_size") % 2 == 0).alias("has"))
    return rows.select("p_partkey", rounded(tx.gate(F.col("c"), F.col("has"))).alias("confidence"), tx.gated(F.lit("find_markers"), F.col("c"), F.col("has")).alias("action"))


#: Requests and what they ask for: text, highlight, direction, cluster summary, against the rest, settings, group of parameters.
REQUESTS = (
    ("Highlight cluster 3", "highlight", None, False, False, False, "clustering"),
    ("please show only the tubule cells.", "highlight", None, False, False, False, None),
    ("show markers of cluster 2 only", None, None, False, False, False, "clustering"),
    ("Clear the highlight!", "clear", None, False, False, False, None),
    ("show all clusters", "clear", None, False, False, False, "clustering"),
    ("clear the rna highlight", None, None, False, False, False, None),
    ("show RNA cluster 4 on the ATAC view", None, "rna_on_atac", False, False, False, "clustering"),
    ("select these on the rna", "highlight", "atac_on_rna", False, False, False, None),
    ("how many cells are in cluster 5?", None, None, True, False, False, "clustering"),
    ("how big is the podocyte region", None, None, False, False, False, None),
    ("markers of cluster 3 versus the rest", None, None, False, True, False, "clustering"),
    ("degs of podocytes compared to all other cells", None, None, False, True, False, None),
    ("podocytes vs the rest", None, None, False, False, False, None),
    ("which resolution are you using", None, None, False, False, True, "clustering"),
    ("set the resolution parameter", None, None, False, False, False, "clustering"),
    ("current umap settings", None, None, False, False, True, "umap"),
    ("number of variable genes and gene filter", None, None, False, False, False, "featureSelection"),
    ("gene filter thresholds", None, None, False, False, False, "geneFiltering"),
    ("mito cutoff and qc", None, None, False, False, False, "cellFiltering"),
    ("principal components", None, None, False, False, False, "pca"),
)


def requests(spark, sf):
    from ..functions import text as tx

    t = F.col("text")
    pick = F.element_at(F.array(*[F.lit(r[0]) for r in REQUESTS]), ((F.col("conv_id") * 7 + F.col("turn")) % len(REQUESTS) + 1).cast("int"))
    rows = m.table(spark, sf, "conversations").select("conv_id", "turn", pick.alias("text"))
    return rows.select("conv_id", "turn", "text", tx.highlight_request(t).alias("highlight"), tx.highlight_direction(t).alias("direction"), tx.asks_cluster_summary(t).alias("summary"), tx.compares_with_rest(t).alias("rest"), tx.asks_settings(t).alias("settings"), tx.parameter_group(t).alias("grp"))


def input_confidences(spark, sf):
    from ..functions import text as tx

    return m.table(spark, sf, "conversations").groupBy(rounded(tx.input_confidence(F.col("text"))).alias("confidence")).agg(F.count(F.lit(1)).alias("n"))


# ---- commands -----------------------------------------------------------------------------------------------


def command_gene(spark, sf):
    return commands.run(_data(spark, sf), "plot_gene_expression", gene=_name(spark, sf, 7).upper()).select("cell_id", rounded(F.col("value")).alias("value"))


def command_spatial_gene(spark, sf):
    found = commands.run(_data(spark, sf), "plot_spatial_gene", gene=_name(spark, sf, 7))
    return found.select("cell_id", rounded(F.col("value")).alias("value"), rounded(F.col("x"), 5).alias("x"))


def command_violin(spark, sf):
    return commands.run(_data(spark, sf), "plot_gene_violin", gene=_name(spark, sf, 7)).select("cluster", "n", rounded(F.col("max"), 5).alias("max"), rounded(F.col("median"), 5).alias("median"))


def command_dotplot(spark, sf):
    names = [_name(spark, sf, k) for k in (3, 7, 11)]
    return commands.run(_data(spark, sf), "plot_gene_dotplot", genes=names).select("cluster", "feature_id", rounded(F.col("scaled"), 5).alias("scaled"))


def command_find_markers(spark, sf):
    found = commands.run(_data(spark, sf), "find_markers", cluster=3)
    return found.select("feature_id", rounded(F.col("p_val"), 5).alias("p_val"), rounded(F.col("pct1")).alias("pct1"), rounded(F.col("pct2")).alias("pct2"))


def command_region_markers(spark, sf):
    chosen = m.sparse_cells(spark, sf).where("cluster in (1, 2, 5, 8)").select("cell_id")
    return commands.run(_data(spark, sf, True), "spatial_region_markers", selected=chosen).select("feature_id", rounded(F.col("p_val"), 5).alias("p_val"), rounded(F.col("p_val_adj"), 5).alias("p_val_adj"))


def command_deg(spark, sf):
    found = commands.run(_data(spark, sf, True), "deg_between_samples", cluster=3, sample1=0, sample2=1)
    return found.agg(F.count(F.lit(1)).alias("n"))


def command_cluster_info(spark, sf):
    return commands.run(_data(spark, sf), "cluster_info", cluster=3).select("cluster", "n_cells", "total_cells", rounded(F.col("fraction")).alias("fraction"))


def command_cell_types(spark, sf):
    names = [r.name for r in m.features(spark, sf).where("collection = 'Brand#7'").select("name").collect()]
    return commands.run(_data(spark, sf), "identify_cell_type_clusters", marker_genes=names).select("cluster", "n_expressed", "n_strong")


def command_parameters(spark, sf):
    data = commands.update(_data(spark, sf), min_features=30, resolution=1.2)
    shown = commands.run(data, "show_parameters", step="qc").unionByName(commands.run(data, "show_parameters", step="clustering"))
    left = commands.run(data, "run_qc").where(F.col("n_features") >= data.settings["min_features"]).agg(F.count(F.lit(1)).alias("n_left"))  # what a setting leaves
    return shown.crossJoin(F.broadcast(left))


def command_filter(spark, sf):
    """Settings act: cells and features that they let through."""
    data = commands.update(_data(spark, sf, True), min_features=35, min_total=500, max_mito_pct=100, min_cells=20)
    return commands.run(data, "filter_cells").select("cell_id", "nnz", "total")


def command_fraction(spark, sf):
    return commands.run(_data(spark, sf, True), "plot_cell_fraction").select("sample", "cluster", "n", rounded(F.col("fraction")).alias("fraction"))


def command_region_composition(spark, sf):
    regions = m.sparse_cells(spark, sf).where("cell_id % 4 < 2").select("cell_id", F.concat(F.lit("r"), (F.col("cell_id") % 2).cast("string")).alias("grp"))
    return commands.run(_data(spark, sf, True), "region_composition", regions=regions).select("grp", "cluster", "n")


def command_rename(spark, sf):
    first = m.table(spark, sf, "nation").orderBy("n_nationkey").first().n_name
    return commands.run(_data(spark, sf), "rename_cluster", old=first, new="Tubule").select("cell_id", "cluster", "label")


def command_highlight(spark, sf):
    label = m.table(spark, sf, "nation").orderBy("n_nationkey").first().n_name.lower()
    return commands.run(_data(spark, sf), "highlight_cluster", cluster=label)


def command_highlight_across(spark, sf):
    other = m.cells(spark, sf).where("cell_id % 2 = 0").select((F.col("cell_id") + 5000).alias("cell_id"), F.concat(F.lit("AA-"), F.col("cell_id").cast("string")).alias("barcode"))
    return commands.run(_data(spark, sf), "highlight_across", cluster=3, other_cells=other)


def command_list_clusters(spark, sf):
    return commands.run(_data(spark, sf), "list_dataset_items", kind="clusters", offset=3, limit=4)


def command_annotations(spark, sf):
    labels = m.table(spark, sf, "nation").where("n_nationkey % 3 = 0").select(F.col("n_nationkey").alias("cluster"), F.concat(F.lit("type "), "n_name").alias("name"))
    return commands.run(_data(spark, sf), "show_annotation_table", labels=labels).select("cell_id", "annotation")


def command_gene_info(spark, sf):
    return commands.run(_data(spark, sf), "gene_info", gene=_name(spark, sf, 7)).select("feature_id", "n_cells", "total", rounded(F.col("mean")).alias("mean"))


def command_links(spark, sf):
    from .interval_queries import DISTANCE, iv

    data = _data(spark, sf)
    data.links = iv.band_join(m.intervals(spark, sf), m.tss(spark, sf), DISTANCE)
    gene = iv.linked_genes(m.intervals(spark, sf), m.tss(spark, sf), DISTANCE).agg(F.min("gene")).first()[0]
    return commands.run(data, "show_peak_gene_links", gene=gene).select("peak_id", "distance")


def command_umap(spark, sf):
    """The layout against two components of the embedding: all cells have a place, and more of a cell's neighbours stay among its nearest."""
    data = commands.update(_data(spark, sf), n_neighbors=15, min_dist=0.1)
    near = m.materialized(neighbors.knn_pruned(data.embedding, data.embedding, 15, exclude_self=True).select("src", "dst", "dist"), "near")
    at = m.materialized(commands.run(data, "run_umap", near=near), "layout")
    finite = ~F.isnan("x") & ~F.isnan("y") & (F.abs("x") < 1e6) & (F.abs("y") < 1e6)

    def kept(places):
        return spatial.spatial_knn(places, 15, 1.0).join(near, ["src", "dst"]).count()

    closer = kept(at.where(finite)) > kept(data.embedding.select("cell_id", F.col("vec")[0].alias("x"), F.col("vec")[1].alias("y")))
    return at.agg(F.count(F.lit(1)).alias("n_cells"), F.every(finite).alias("finite")).withColumn("closer", F.lit(closer))


def command_update_cells(spark, sf):
    """A changed threshold of cells gives the cells that are left."""
    data = commands.update(_data(spark, sf, True), min_total=500, max_mito_pct=100, min_cells=20)
    return commands.run(data, "update_cell_filtering", min_features=35).select("cell_id", "nnz", "total")


def command_update_genes(spark, sf):
    data = commands.update(_data(spark, sf, True), min_features=35, min_total=500, max_mito_pct=100)
    return commands.run(data, "update_gene_filtering", min_cells=20).select("feature_id", "nnz", "total")


def command_find_several(spark, sf):
    """Markers of two clusters: how many each has, and how many lie in over half of its cells."""
    found = commands.run(_data(spark, sf), "find_markers", cluster=[3, 4, 3])
    return found.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("pct1") > 0.5).alias("n_half"))


_SEVEN = "seven AS (SELECT s_suppkey AS cell_id, s_nationkey AS cluster, coalesce(value, 0.0) AS value FROM supplier LEFT JOIN (SELECT * FROM ln_ WHERE feature_id = (SELECT min(p_partkey) FROM part WHERE lower(p_name) = (SELECT lower(p_name) FROM part WHERE p_partkey = 7))) ON cell_id = s_suppkey)"
_CN = "CASE WHEN cluster % 3 = 0 THEN 'a' ELSE 'b' END"
_SIZES = "sz AS (SELECT cluster, count(*) AS n_cells FROM cl GROUP BY 1)"
_TRACK = "SELECT * FROM (SELECT '{how}' AS how, cluster, CAST(row_number() OVER (ORDER BY {order}cluster) AS INTEGER) AS place FROM sz LEFT JOIN sig USING (cluster)) WHERE place <= 4"
_LINK = "SELECT * FROM (SELECT '{how}' AS how, CAST(row_number() OVER (ORDER BY {order}, gene, peak_id) AS INTEGER) AS place, gene, peak_id FROM l) WHERE place <= 20"
_PAGE = "SELECT {o} AS \"offset\", CAST(greatest(0, least({n}, total - {o})) AS INTEGER) AS shown, coalesce((SELECT string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_partkey) FROM (SELECT p_partkey FROM part ORDER BY p_partkey LIMIT 3 OFFSET {o})), '') AS first, total, total > {o} + {n} AS has_more, CAST(CASE WHEN total > {o} + {n} THEN {o} + {n} ELSE -1 END AS BIGINT) AS next_offset FROM c"
_NAMED = "nm AS (SELECT p_partkey AS id, p_name || ' ' || CAST(p_partkey % 400 AS VARCHAR) AS name FROM part)"

def _literal(x):
    return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else f"'{x}'"


QUERIES = {
    "requests": (requests, "SELECT conv_id, turn, text, highlight, direction, summary, rest, settings, grp FROM (SELECT conv_id, turn, (conv_id * 7 + turn) % " + str(len(REQUESTS)) + " AS k FROM conversations) JOIN (VALUES " + ", ".join(f"({k}, {', '.join(map(_literal, r))})" for k, r in enumerate(REQUESTS)) + ") AS v(k, text, highlight, direction, summary, rest, settings, grp) USING (k)"),
    "input_confidences": (input_confidences, f"WITH k AS (SELECT {_KIND} AS kind FROM conversations) SELECT CASE kind WHEN 'navigation' THEN 0.95::DOUBLE WHEN 'question' THEN 0.85 WHEN 'command' THEN 0.6 ELSE 0.3 END AS confidence, count(*) AS n FROM k GROUP BY 1"),
    "expression_range": (expression_range, "WITH f AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders WHERE o_orderstatus = 'F'), w AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders), u AS (SELECT 'shown' AS kind, lo, hi FROM f UNION ALL SELECT 'whole', lo, hi FROM w UNION ALL SELECT 'given', 10.0, 10.0 UNION ALL SELECT 'half', -1.0, hi FROM w) SELECT kind, round(lo, 6) + 0.0 AS low, round(CASE WHEN lo = hi THEN lo + 1e-6 ELSE hi END, 6) + 0.0 AS high FROM u"),
    "violin_guards": (violin_guards, "WITH v AS (SELECT c_nationkey AS cluster, CASE WHEN c_custkey % (c_nationkey + 1) = 0 THEN c_acctbal ELSE 0.0 END AS v FROM customer), g AS (SELECT cluster, count(*) AS n, avg(CASE WHEN v <> 0 THEN 1.0 ELSE 0.0 END) AS nz FROM v GROUP BY 1) SELECT cluster, n, round(nz, 6) + 0.0 AS nonzero, nz >= 0.2 AS drawn, round(greatest(0.4, sqrt(n / CAST(max(n) OVER () AS DOUBLE))), 6) + 0.0 AS width FROM g"),
    "coverage_completed": (coverage_completed, f"WITH {FRAG}, {COV}, {_SIZES}, k AS (SELECT DISTINCT cluster FROM sz), s AS (SELECT unnest(['a', 'b']) AS sample), v AS (SELECT cluster, sum(value) AS total FROM cov WHERE bin < 24 GROUP BY 1) SELECT sample, k.cluster AS cluster, CAST(24 AS BIGINT) AS n, round(coalesce(CASE WHEN sample = CASE WHEN k.cluster % 3 = 0 THEN 'a' ELSE 'b' END THEN total END, 0.0), 6) + 0.0 AS total, CAST(CASE WHEN sample = CASE WHEN k.cluster % 3 = 0 THEN 'a' ELSE 'b' END THEN n_cells ELSE 0 END AS BIGINT) AS n_cells FROM k CROSS JOIN s LEFT JOIN v ON v.cluster = k.cluster LEFT JOIN sz ON sz.cluster = k.cluster"),
    "links_ordered": (links_ordered, "WITH l AS (SELECT p_size % 7 AS gene, p_partkey AS peak_id, p_partkey % 101 - 50 AS score, (p_partkey % 37) / 37.0::DOUBLE AS pvalue FROM part) " + " UNION ALL ".join(_LINK.format(how=h, order=o) for h, o in (("score", "abs(score) DESC"), ("display", "pvalue"), ("draw", "abs(score)")))),
    "clusters_ordered": (clusters_ordered, "WITH c AS (SELECT CASE WHEN n_nationkey % 3 = 0 THEN n_name ELSE CAST(n_nationkey AS VARCHAR) END AS cluster FROM nation) SELECT cluster, CAST(row_number() OVER (ORDER BY TRY_CAST(cluster AS DOUBLE) IS NULL, TRY_CAST(cluster AS DOUBLE), cluster) AS INTEGER) AS place FROM c"),
    "tracks_ordered": (tracks_ordered, f"WITH {FRAG}, {COV}, {_SIZES}, sig AS (SELECT cluster, sum(value) AS total FROM cov GROUP BY 1) " + " UNION ALL ".join(_TRACK.format(how=h, order=o) for h, o in (("id", ""), ("signal", "coalesce(total, 0.0) DESC, "), ("cells", "n_cells DESC, ")))),
    "motif_enrichment": (motif_enrichment, "WITH t AS (SELECT CAST(count(CASE WHEN p_size <= 15 THEN 1 END) AS DOUBLE) AS nq, CAST(count(*) AS DOUBLE) AS nb FROM part), r AS (SELECT p_brand AS motif, count(CASE WHEN p_size <= 15 THEN 1 END) AS q, count(*) AS b FROM part GROUP BY 1) SELECT motif, q AS query_hits, b AS background_hits, round((q / nq) / (b / nb), 6) + 0.0 AS fold, true AS sound FROM r, t"),
    "motifs_top": (motifs_top, "WITH t AS (SELECT CAST(count(CASE WHEN p_size <= 15 THEN 1 END) AS DOUBLE) AS nq, CAST(count(*) AS DOUBLE) AS nb FROM part), r AS (SELECT p_brand AS motif, count(CASE WHEN p_size <= 15 THEN 1 END) AS q, count(*) AS b FROM part GROUP BY 1), f AS (SELECT motif, round((q / nq) / (b / nb), 9) AS fold FROM r, t) SELECT motif, round(fold, 6) + 0.0 AS fold FROM f ORDER BY f.fold DESC, motif LIMIT 10"),
    "interactions_top": (interactions_top, "WITH i AS (SELECT 's' || CAST(o_custkey % 5 AS VARCHAR) AS source, 't' || CAST(o_orderkey % 6 AS VARCHAR) AS target, CAST(o_orderkey AS VARCHAR) AS pair, (o_orderkey % 16) / 16.0::DOUBLE AS probability FROM orders) SELECT * FROM (SELECT * FROM i ORDER BY probability DESC, source, target, pair LIMIT 20) UNION ALL SELECT * FROM (SELECT source, target, CAST(NULL AS VARCHAR) AS pair, sum(probability) AS probability FROM i GROUP BY 1, 2 ORDER BY round(sum(probability), 9) DESC, source, target LIMIT 12)"),
    "drawn_last": (drawn_last, "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey DESC LIMIT 10"),
    "listing_page": (listing_page, "WITH c AS (SELECT count(*) AS total FROM part) " + " UNION ALL ".join(_PAGE.format(o=o, n=n) for o, n in ((0, 10), (40, 100), (1_000_000, 10)))),
    "labels_by_appearance": (labels_by_appearance, f"WITH {CELLS}, f AS (SELECT cluster, min(cell_id) AS first FROM cells GROUP BY 1), n AS (SELECT cluster, row_number() OVER (ORDER BY first) - 1 AS k FROM f) SELECT cell_id, k AS new_label FROM cells JOIN n USING (cluster)"),
    "weights_running": (weights_running, "SELECT o_orderkey, sum(round(o_totalprice * 100)) OVER (ORDER BY o_orderkey) AS running FROM orders"),
    "features_shared": (features_shared, f"WITH {_NAMED}, a AS (SELECT lower(name) AS key, max(id) AS left_id FROM nm WHERE id % 2 = 0 GROUP BY 1), b AS (SELECT lower(name) AS key, max(id) AS right_id FROM nm WHERE id % 3 = 0 GROUP BY 1) SELECT key, left_id, right_id FROM a JOIN b USING (key)"),
    "cells_aligned": (cells_aligned, "SELECT 'AA-' || CAST(c_custkey AS VARCHAR) AS barcode, c_custkey + 10 AS first_id, c_custkey + 1000 AS second_id FROM customer WHERE c_custkey % 6 = 0"),
    "population_zscore": (population_zscore, "WITH v AS (SELECT vec_id AS cell_id, CAST(k AS INTEGER) AS feature_id, embedding[k + 1]::DOUBLE AS v FROM embeddings, (SELECT unnest(range(0, 8)) AS k)), s AS (SELECT feature_id, avg(v) AS mu, stddev_pop(v) AS sd FROM v GROUP BY 1) SELECT cell_id, feature_id, round(CASE WHEN sd <= 1e-12 THEN 0.0 ELSE (v - mu) / sd END, 6) + 0.0 AS value FROM v JOIN s USING (feature_id)"),
    "hvg_capped": (hvg_capped, f"WITH {C}, nn AS (SELECT CAST(count(DISTINCT cell_id) AS DOUBLE) AS n FROM counts), d AS (SELECT feature_id, s / n AS mean, ss / n - (s / n) * (s / n) AS variance FROM (SELECT feature_id, sum(value) AS s, sum(value * value) AS ss FROM counts GROUP BY 1), nn), r AS (SELECT feature_id, row_number() OVER (ORDER BY round(CASE WHEN mean > 1e-12 THEN variance / mean ELSE variance END, 9) DESC, feature_id) AS k FROM d), z AS (SELECT count(*) AS nnz FROM counts JOIN r USING (feature_id) WHERE k <= 200) SELECT feature_id FROM r, z WHERE k <= CASE WHEN nnz <= 2500 THEN 200 ELSE greatest(50, 200 * 2500 // nnz) END"),
    "gates": (gates, "WITH p AS (SELECT p_partkey, (p_partkey % 11) / 10.0::DOUBLE AS c, p_size % 2 = 0 AS has FROM part), g AS (SELECT *, CASE WHEN has THEN greatest(c, 0.75) ELSE least(c, 0.3) END AS g FROM p) SELECT p_partkey, round(g, 6) + 0.0 AS confidence, CASE WHEN c < 0.3 OR g < 0.5 THEN 'NONE' ELSE 'find_markers' END AS action FROM g"),
    "command_gene": (command_gene, f"WITH {C}, {LOGN}, {_SEVEN} SELECT cell_id, round(value, 6) + 0.0 AS value FROM seven"),
    "command_spatial_gene": (command_spatial_gene, f"WITH {C}, {LOGN}, {_SEVEN} SELECT cell_id, round(value, 6) + 0.0 AS value, round(embedding[1]::DOUBLE, 5) + 0.0 AS x FROM seven JOIN embeddings ON vec_id = cell_id"),
    "command_violin": (command_violin, f"WITH {C}, {LOGN}, {_SEVEN} SELECT cluster, count(*) AS n, round(max(value), 5) + 0.0 AS max, round(quantile_cont(value, 0.5), 5) + 0.0 AS median FROM seven GROUP BY 1"),
    "command_dotplot": (command_dotplot, f"WITH {C}, {CELLS}, {_DOTS}, ids AS (SELECT min(p_partkey) AS feature_id FROM part WHERE lower(p_name) IN (SELECT lower(p_name) FROM part WHERE p_partkey IN (3, 7, 11)) GROUP BY lower(p_name)), z AS (SELECT *, avg(avg) OVER (PARTITION BY feature_id) AS mu, stddev_samp(avg) OVER (PARTITION BY feature_id) AS sd FROM dots SEMI JOIN ids USING (feature_id)) SELECT cluster, feature_id, round(greatest(-4.0, least(4.0, (avg - mu) / CASE WHEN sd IS NULL OR sd < 1e-12 THEN 1.0 ELSE sd END)), 5) + 0.0 AS scaled FROM z"),
    "command_find_markers": (command_find_markers, _rank_sql("true", "cluster = 3").replace(SC, C).replace(SCELLS, CELLS) + " SELECT feature_id, p_val, pct1, pct2 FROM mk WHERE x1 > 0.2 OR x2 > 0.2"),
    "command_region_markers": (command_region_markers, _rank_sql("true", "cluster IN (1, 2, 5, 8)") + " SELECT feature_id, p_val, p_val_adj FROM mk"),
    "command_deg": (command_deg, f"WITH {SC}, {SCELLS} SELECT count(DISTINCT feature_id) AS n FROM counts JOIN cells USING (cell_id) WHERE value > 0 AND cluster = 3 AND sample IN (0, 1)"),
    "command_cluster_info": (command_cluster_info, f"WITH {CELLS} SELECT cluster, count(*) AS n_cells, (SELECT count(*) FROM cells) AS total_cells, round(count(*) / (SELECT count(*) FROM cells)::DOUBLE, 6) + 0.0 AS fraction FROM cells WHERE cluster = 3 GROUP BY 1"),
    "command_cell_types": (command_cell_types, f"WITH {C}, {CELLS}, {_DOTS}, ids AS (SELECT p_partkey AS feature_id FROM part WHERE lower(p_name) IN (SELECT lower(p_name) FROM part WHERE p_brand = 'Brand#7')) SELECT cluster, count(CASE WHEN pct >= 0.1 THEN 1 END) AS n_expressed, count(CASE WHEN pct >= 0.5 THEN 1 END) AS n_strong FROM dots SEMI JOIN ids USING (feature_id) GROUP BY 1"),
    "command_parameters": (command_parameters, f"WITH {C} SELECT name, value, (SELECT count(*) FROM (SELECT cell_id FROM counts WHERE value > 0 GROUP BY 1 HAVING count(*) >= 30)) AS n_left FROM (VALUES ('min_features', 30.0::DOUBLE), ('min_total', 0.0), ('max_mito_pct', 100.0), ('resolution', 1.2), ('lambda', 0.3)) AS v(name, value)"),
    "command_filter": (command_filter, f"WITH {SC}, k AS (SELECT cell_id FROM counts WHERE value > 0 GROUP BY 1 HAVING count(*) >= 35 AND sum(value) >= 500), f AS (SELECT * FROM counts SEMI JOIN k USING (cell_id)), g AS (SELECT feature_id FROM f GROUP BY 1 HAVING count(*) >= 20) SELECT cell_id, count(*) AS nnz, sum(value) AS total FROM f SEMI JOIN g USING (feature_id) GROUP BY 1"),
    "command_update_cells": (command_update_cells, f"WITH {SC}, k AS (SELECT cell_id FROM counts WHERE value > 0 GROUP BY 1 HAVING count(*) >= 35 AND sum(value) >= 500), f AS (SELECT * FROM counts SEMI JOIN k USING (cell_id)), g AS (SELECT feature_id FROM f GROUP BY 1 HAVING count(*) >= 20) SELECT cell_id, count(*) AS nnz, sum(value) AS total FROM f SEMI JOIN g USING (feature_id) GROUP BY 1"),
    "command_update_genes": (command_update_genes, f"WITH {SC}, k AS (SELECT cell_id FROM counts WHERE value > 0 GROUP BY 1 HAVING count(*) >= 35 AND sum(value) >= 500), f AS (SELECT * FROM counts SEMI JOIN k USING (cell_id)), g AS (SELECT feature_id FROM f GROUP BY 1 HAVING count(*) >= 20) SELECT feature_id, count(*) AS nnz, sum(value) AS total FROM f SEMI JOIN g USING (feature_id) GROUP BY 1"),
    "command_fraction": (command_fraction, f"WITH {SCELLS} SELECT sample, cluster, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY sample) AS DOUBLE), 6) + 0.0 AS fraction FROM cells GROUP BY 1, 2"),
    "command_region_composition": (command_region_composition, f"WITH {SCELLS} SELECT 'r' || CAST(cell_id % 2 AS VARCHAR) AS grp, cluster, count(*) AS n FROM cells WHERE cell_id % 4 < 2 GROUP BY 1, 2"),
    "command_rename": (command_rename, f"WITH {CELLS} SELECT cell_id, cluster, CASE WHEN cluster = (SELECT min(n_nationkey) FROM nation) THEN 'Tubule' ELSE label END AS label FROM cells"),
    "command_highlight": (command_highlight, f"WITH {CELLS} SELECT cell_id, cluster = (SELECT min(n_nationkey) FROM nation) AS highlighted FROM cells"),
    "command_highlight_across": (command_highlight_across, f"WITH {CELLS} SELECT cell_id + 5000 AS cell_id, cluster = 3 AS highlighted FROM cells WHERE cell_id % 2 = 0"),
    "command_list_clusters": (command_list_clusters, f"WITH {CELLS} SELECT DISTINCT cluster FROM cells ORDER BY cluster LIMIT 4 OFFSET 3"),
    "command_annotations": (command_annotations, f"WITH {CELLS} SELECT cell_id, CASE WHEN cluster % 3 = 0 THEN 'type ' || label ELSE label END AS annotation FROM cells"),
    "command_gene_info": (command_gene_info, f"WITH {C} SELECT feature_id, count(*) AS n_cells, sum(value) AS total, round(avg(value), 6) + 0.0 AS mean FROM counts WHERE feature_id = (SELECT min(p_partkey) FROM part WHERE lower(p_name) = (SELECT lower(p_name) FROM part WHERE p_partkey = 7)) AND value > 0 GROUP BY 1"),
    "command_links": (command_links, f"WITH {IV}, {TSS}, {_BAND} SELECT peak_id, distance FROM band WHERE gene = (SELECT min(gene) FROM band)"),
    "command_umap": (command_umap, "SELECT count(*) AS n_cells, true AS finite, true AS closer FROM embeddings"),
    "command_find_several": (command_find_several, f"WITH {C}, {CELLS}, " + "g AS (SELECT cell_id, k AS cluster, cluster = k AS one FROM cells, (VALUES (3), (4)) AS v(k)), sz AS (SELECT cluster, count(CASE WHEN one THEN 1 END) AS n1, count(CASE WHEN NOT one THEN 1 END) AS n2 FROM g GROUP BY 1), x AS (SELECT g.cluster AS cluster, feature_id, count(CASE WHEN one THEN 1 END) AS p1, count(CASE WHEN NOT one THEN 1 END) AS p2 FROM counts JOIN g USING (cell_id) WHERE value > 0 GROUP BY 1, 2) SELECT CAST(cluster AS INTEGER) AS cluster, count(*) AS n, count(CASE WHEN p1 / CAST(n1 AS DOUBLE) > 0.5 THEN 1 END) AS n_half FROM x JOIN sz USING (cluster) WHERE p1 / CAST(n1 AS DOUBLE) > 0.2 OR p2 / CAST(n2 AS DOUBLE) > 0.2 GROUP BY 1"),
}
