"""The command catalogue: actions with typed parameters, and the operators that answer them."""

from __future__ import annotations

import dataclasses
import functools
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import graph, intervals, matrix, neighbors, stats, summaries


@dataclasses.dataclass
class Dataset:
    """What commands work on; parts that a data set lacks are None."""

    counts: DataFrame
    cells: DataFrame
    features: DataFrame
    embedding: DataFrame | None = None
    points: DataFrame | None = None
    links: DataFrame | None = None
    fragments: DataFrame | None = None
    settings: dict = dataclasses.field(default_factory=lambda: dict(DEFAULTS))

    def n_cells(self) -> int:
        return self.cells.count()

    def feature(self, name: str) -> int:
        """The id of the first feature of a name, without regard to case."""
        hit = self.features.where(F.lower("name") == name.lower()).orderBy("feature_id").select("feature_id").first()
        if hit is None:
            raise KeyError(f"no feature is called {name}")
        return hit.feature_id


#: Parameters by step and their defaults.
DEFAULTS = {"min_features": 200, "min_total": 0, "max_mito_pct": 100.0, "min_cells": 3, "n_top": 2000, "n_components": 50, "n_neighbors": 20, "min_dist": 0.3, "resolution": 0.8, "lambda": 0.3}
STEPS = {
    "qc": ("min_features", "min_total", "max_mito_pct"), "filtering": ("min_cells",), "normalization": ("n_top",),
    "pca": ("n_components",), "umap": ("n_neighbors", "min_dist"), "clustering": ("resolution", "lambda"),
}

Action = Callable[..., DataFrame]
ACTIONS: dict[str, tuple[Action, tuple[str, ...]]] = {}


def action(*required: str) -> Callable[[Action], Action]:
    def put(f: Action) -> Action:
        ACTIONS[f.__name__] = (f, required)
        return f

    return put


def run(data: Dataset, name: str, **params) -> DataFrame:
    """The answer of an action; unknown actions and missing parameters (0 is none of them) raise."""
    if name not in ACTIONS:
        raise KeyError(f"no action is called {name}")
    f, required = ACTIONS[name]
    missing = [p for p in required if params.get(p) is None]
    if missing:
        raise ValueError(f"{name} needs {', '.join(missing)}")
    return f(data, **params)


def _one_group(data: Dataset, chosen) -> DataFrame:
    return data.cells.select("cell_id", chosen.alias("one"))


@action("gene")
def plot_gene_expression(data: Dataset, gene: str) -> DataFrame:
    return matrix.feature_vector(matrix.log_normalize(data.counts), data.cells, data.feature(gene))


@action("gene")
def plot_spatial_gene(data: Dataset, gene: str) -> DataFrame:
    return plot_gene_expression(data, gene).join(data.points.withColumnRenamed("id", "cell_id"), "cell_id")


@action("gene")
def plot_gene_violin(data: Dataset, gene: str) -> DataFrame:
    return summaries.violin(plot_gene_expression(data, gene).join(data.cells, "cell_id"), "cluster", "value")


@action("genes")
def plot_gene_dotplot(data: Dataset, genes: list[str]) -> DataFrame:
    ids = [data.feature(g) for g in genes]
    return summaries.dot_plot_scaled(summaries.dot_plot(data.counts.where(F.col("feature_id").isin(ids)), data.cells, "cluster"))


@action("cluster")
def find_markers(data: Dataset, cluster: int | list[int]) -> DataFrame:
    """Markers of a cluster against all others; of several, one after another under their cluster."""
    if not isinstance(cluster, list):
        return stats.expressed_filter(stats.markers(data.counts, _one_group(data, F.col("cluster") == cluster)))
    each = [find_markers(data, c).withColumn("cluster", F.lit(c)) for c in dict.fromkeys(cluster)]
    return functools.reduce(DataFrame.unionByName, each)


@action("selected")
def spatial_region_markers(data: Dataset, selected: DataFrame) -> DataFrame:
    """selected: cell_id of three cells at least."""
    if selected.limit(3).count() < 3:
        raise ValueError("a region needs three cells")
    groups = data.cells.select("cell_id").join(selected.select("cell_id", F.lit(True).alias("one")), "cell_id", "left").select("cell_id", F.coalesce("one", F.lit(False)).alias("one"))
    return stats.markers(data.counts, groups)


@action("regions", "pairs")
def spatial_cell_interaction(data: Dataset, regions: DataFrame, pairs: DataFrame) -> DataFrame:
    return stats.interactions(matrix.log_normalize(data.counts), regions, pairs)


@action("cluster")
def cluster_info(data: Dataset, cluster: int) -> DataFrame:
    return summaries.cluster_info(data.cells).where(F.col("cluster") == cluster)


@action("marker_genes")
def identify_cell_type_clusters(data: Dataset, marker_genes: list[str]) -> DataFrame:
    panel = data.features.where(F.lower("name").isin([g.lower() for g in marker_genes])).select("feature_id")
    return stats.cell_type_search(summaries.dot_plot(data.counts, data.cells, "cluster"), panel)


@action()
def show_parameters(data: Dataset, step: str | None = None) -> DataFrame:
    names = STEPS[step] if step else tuple(data.settings)
    return data.cells.sparkSession.createDataFrame([(n, float(data.settings[n])) for n in names], "name string, value double")


@action("regions")
def region_composition(data: Dataset, regions: DataFrame) -> DataFrame:
    return summaries.composition(regions.join(data.cells, "cell_id"), "grp", "cluster")


@action()
def plot_cell_fraction(data: Dataset) -> DataFrame:
    return summaries.composition(data.cells, "sample", "cluster")


@action("cluster", "sample1", "sample2")
def deg_between_samples(data: Dataset, cluster: int, sample1, sample2) -> DataFrame:
    cells = data.cells.where((F.col("cluster") == cluster) & F.col("sample").isin(sample1, sample2))
    return stats.markers(data.counts, cells.select("cell_id", (F.col("sample") == sample1).alias("one")))


@action("gene")
def show_peak_gene_links(data: Dataset, gene) -> DataFrame:
    return data.links.where(F.col("gene") == gene)


@action("peaks", "genes", "peak_counts")
def link_peaks(data: Dataset, peaks: DataFrame, genes: DataFrame, peak_counts: DataFrame, distance: int = 500_000, **more) -> DataFrame:
    """genes' names are feature ids of data.counts; peak_counts: peak_id, cell_id, value over the same cells."""
    return intervals.link_peaks(peak_counts, data.counts.withColumnRenamed("feature_id", "gene"), peaks, genes, data.n_cells(), distance, **more)


@action()
def cluster_and_visualize(data: Dataset, resolution: float | None = None, method: str = "louvain", pruned: bool = False) -> DataFrame:
    """node, cluster by louvain (multilevel), leiden or walktrap, over neighbours that share neighbours. pruned looks for them by pivots: the
    same ones, with less work where cells lie in groups."""
    from .model import materialized

    k, nodes = int(data.settings["n_neighbors"]), data.embedding.select(F.col("cell_id").alias("node"))
    find = neighbors.knn_pruned if pruned else neighbors.knn
    edges = materialized(neighbors.snn(find(data.embedding, data.embedding, k, exclude_self=True)), "snn")
    if method == "walktrap":
        return graph.walktrap(nodes, edges)
    if method not in ("louvain", "multilevel", "leiden"):
        raise ValueError(f"no clustering is called {method}")
    return (graph.leiden if method == "leiden" else graph.louvain)(nodes, edges, resolution or data.settings["resolution"])


@action("old", "new")
def rename_cluster(data: Dataset, old: str, new: str) -> DataFrame:
    return summaries.merge_clusters(data.cells, {old: new})


@action("source", "target")
def merge_clusters(data: Dataset, source: str, target: str) -> DataFrame:
    return summaries.merge_clusters(data.cells, {source: target})


@action("cluster")
def highlight_cluster(data: Dataset, cluster) -> DataFrame:
    """cell_id, highlighted; a text names labels without regard to case."""
    hit = F.lower("label") == cluster.lower() if isinstance(cluster, str) else F.col("cluster") == cluster
    return data.cells.select("cell_id", hit.alias("highlighted"))


@action()
def clear_cluster_highlight(data: Dataset) -> DataFrame:
    return data.cells.select("cell_id", F.lit(False).alias("highlighted"))


@action("kind")
def list_dataset_items(data: Dataset, kind: str, offset: int = 0, limit: int = 50) -> DataFrame:
    rows, order = {"genes": (data.features, "feature_id"), "cells": (data.cells, "cell_id"), "clusters": (data.cells.select("cluster").distinct(), "cluster")}[kind]
    return summaries.page(rows, order, offset, limit)


@action("labels")
def show_annotation_table(data: Dataset, labels: DataFrame) -> DataFrame:
    return summaries.annotate(data.cells, labels)


@action()
def run_qc(data: Dataset, mito_prefix: str = "mt-") -> DataFrame:
    mito = data.features.where(F.lower("name").startswith(mito_prefix)).select("feature_id", F.lit(True).alias("mito"))
    return summaries.qc_metrics(data.counts.join(mito, "feature_id", "left"), data.cells, F.coalesce("mito", F.lit(False)))


def filtered(data: Dataset, mito_prefix: str = "mt-") -> DataFrame:
    """The counts of the cells and features that the settings let through: thresholds of the QC step, then min_cells."""
    s = data.settings
    kept = summaries.qc_filter(run_qc(data, mito_prefix), int(s["min_features"]), s["min_total"], s["max_mito_pct"])
    counts = data.counts.join(kept.select("cell_id"), "cell_id", "left_semi")
    wide = matrix.filter_axis_min_entries(counts, "feature_id", int(s["min_cells"]))
    return counts.join(wide.select("feature_id"), "feature_id", "left_semi")


@action()
def filter_cells(data: Dataset, mito_prefix: str = "mt-") -> DataFrame:
    """What the settings leave of the counts, by cell."""
    return matrix.axis_sums(filtered(data, mito_prefix), "cell_id")


@action()
def normalize(data: Dataset) -> DataFrame:
    return matrix.log_normalize(data.counts)


def variable_features(data: Dataset, counts: DataFrame, most: int | None = None) -> DataFrame:
    """The settings' number of variable features of counts; with most, fewer where their entries would be more than that."""
    n_cells = counts.select("cell_id").distinct().count()
    top = matrix.highly_variable(counts, n_cells, int(data.settings["n_top"]))
    if most is None:
        return top
    nnz = counts.join(top.select("feature_id"), "feature_id", "left_semi").count()
    return top.limit(matrix.memory_capped_top(int(data.settings["n_top"]), nnz, most))


@action()
def run_pca(data: Dataset) -> DataFrame:
    """cell_id, vec: the settings' number of components of the filtered, normalised, variable features."""
    from .operators import algebra

    rows = matrix.log_normalize(filtered(data))
    top = variable_features(data, rows).select("feature_id")
    return algebra.embed(rows.join(top, "feature_id", "left_semi"), data.n_cells(), data.features.count(), k=int(data.settings["n_components"]), center=True)[0]


@action()
def run_umap(data: Dataset, near: DataFrame | None = None) -> DataFrame:
    """cell_id, x, y: the layout of the embedding by the settings' n_neighbors and min_dist; near (src, dst, dist) has the neighbours, if they are known."""
    from .operators import layout

    return layout.place(data.embedding.select("cell_id", "vec"), int(data.settings["n_neighbors"]), float(data.settings["min_dist"]), near=near)


@action("gene")
def gene_info(data: Dataset, gene: str) -> DataFrame:
    """One row: the feature, its cells, total and mean over the cells that express it."""
    own = data.counts.where(F.col("feature_id") == data.feature(gene))
    return own.agg(F.first("feature_id").alias("feature_id"), F.count_if(F.col("value") > 0).alias("n_cells"), F.sum("value").alias("total"), F.avg(F.when(F.col("value") > 0, F.col("value"))).alias("mean"))


@action("reference", "reference_values")
def impute_gene(data: Dataset, reference: DataFrame, reference_values: DataFrame) -> DataFrame:
    """Values of the data set's cells from a reference: embeddings (cell_id, vec) of the shared features and values
    (cell_id, feature_id, value) to impute."""
    from .operators import algebra

    return algebra.impute(reference, data.embedding, reference_values)


@action("other")
def wnn_integrate(data: Dataset, other: DataFrame, k: int | None = None) -> DataFrame:
    """node, cluster over both modalities' neighbours: other(cell_id, vec) holds the same cells."""
    from .model import materialized

    k = int(k or data.settings["n_neighbors"])
    first, second = (materialized(neighbors.knn(x, x, k, exclude_self=True), "knn") for x in (data.embedding, other))
    merged = neighbors.merge_neighbors(first, second, neighbors.modality_weights(first, second), k).where("src != dst")
    return graph.louvain(data.embedding.select(F.col("cell_id").alias("node")), materialized(neighbors.snn(merged), "snn"), data.settings["resolution"])


@action()
def region_segmentation(data: Dataset, k: int = 15, cell: float = 50.0, components: int = 20) -> DataFrame:
    """node, cluster of regions: own and neighbourhood expression of dense values, weighed by lambda, and their components."""
    from .model import materialized
    from .operators import algebra, spatial

    rows = matrix.log_normalize(data.counts)
    top = variable_features(data, rows).select("feature_id")
    cells = data.points.select(F.col("id").alias("cell_id"), "x", "y")
    # dense over the variable features, whose number the settings bound
    grid = cells.select("cell_id").join(F.broadcast(top), F.lit(True)).join(rows, ["cell_id", "feature_id"], "left").select("cell_id", "feature_id", F.coalesce("value", F.lit(0.0)).alias("value"))
    near = materialized(spatial.spatial_knn(cells, k, cell), "spatial")
    wide = neighbors.banksy_matrix(grid, near, data.settings["lambda"]).groupBy("cell_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("feature", "value"))), lambda x: x.value).alias("vec"))
    emb = materialized(algebra.dense_pca(materialized(wide, "banksy"), components)[0], "embedding")
    edges = materialized(neighbors.snn(neighbors.knn(emb, emb, k, exclude_self=True)), "snn")
    return graph.louvain(emb.select(F.col("cell_id").alias("node")), edges, data.settings["resolution"])


@action("motifs", "peaks", "background")
def tf_motif_analysis(data: Dataset, motifs: DataFrame, peaks: DataFrame, background: DataFrame) -> DataFrame:
    """motif, fold, p_val, p_val_adj, .. of motifs(motif, peak_id) in peaks against background (peak_id each), the best first."""
    from .operators import display

    return display.top_motifs(stats.motif_enrichment(motifs, peaks, background).withColumn("score", -F.log10(F.greatest("p_val", F.lit(1e-320)))))


@action("cluster", "other_cells")
def highlight_across(data: Dataset, cluster, other_cells: DataFrame) -> DataFrame:
    """cell_id, highlighted in another modality's view: the cells that are the highlighted ones here, by barcode."""
    from .operators import display

    own = highlight_cluster(data, cluster).join(data.cells.select("cell_id", "barcode"), "cell_id")
    pairs = display.aligned_cells(own.where("highlighted"), other_cells)
    return other_cells.select("cell_id").join(pairs.select(F.col("second_id").alias("cell_id"), F.lit(True).alias("hit")), "cell_id", "left").select("cell_id", F.coalesce("hit", F.lit(False)).alias("highlighted"))


def update(data: Dataset, **changes: float) -> Dataset:
    """The data set with changed parameters; a result depends on them when it is asked for again."""
    unknown = set(changes) - set(DEFAULTS)
    if unknown:
        raise KeyError(f"no parameter is called {', '.join(sorted(unknown))}")
    return dataclasses.replace(data, settings={**data.settings, **changes})


# ---- changed parameters: each gives what its step then makes -----------------------------------------------


@action()
def update_cell_filtering(data: Dataset, **changes: float) -> DataFrame:
    """min_features, min_total, max_mito_pct: the cells that are left."""
    return filter_cells(_changed(data, "qc", changes))


@action("min_cells")
def update_gene_filtering(data: Dataset, min_cells: float) -> DataFrame:
    """The features that are left, by their sums."""
    return matrix.axis_sums(filtered(update(data, min_cells=min_cells)), "feature_id")


@action("n_top")
def update_variable_genes(data: Dataset, n_top: int) -> DataFrame:
    changed = update(data, n_top=n_top)
    return variable_features(changed, matrix.log_normalize(filtered(changed)))


@action("resolution")
def update_clustering_resolution(data: Dataset, resolution: float, method: str = "louvain") -> DataFrame:
    return cluster_and_visualize(update(data, resolution=resolution), method=method)


@action("n_components")
def update_pca_for_umap(data: Dataset, n_components: int) -> DataFrame:
    """The layout of that many components of the counts."""
    changed = update(data, n_components=n_components)
    return run_umap(dataclasses.replace(changed, embedding=run_pca(changed)))


@action()
def update_umap_parameters(data: Dataset, **changes: float) -> DataFrame:
    """n_neighbors, min_dist: the layout by them."""
    return run_umap(_changed(data, "umap", changes))


def _changed(data: Dataset, step: str, changes: dict) -> Dataset:
    """data with changed parameters of one step; there must be some, and no others."""
    if not changes or set(changes) - set(STEPS[step]):
        raise ValueError(f"{step} takes {', '.join(STEPS[step])}")
    return update(data, **changes)
