"""Readers of whole folders: a data set's matrix, cells, features, places, projection and clusters, joined by cell.

Each reader returns a Layout. Files are found by their names under the folder, its outs folder or the usual subfolders; what
a folder lacks is None. Matrices must be text or Parquet, as Spark has no HDF5 reader."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import readers

ANALYSIS = ("", "analysis/", "outs/", "outs/analysis/")
PROJECTIONS = ("umap/gene_expression_2_components/projection.csv", "umap/2_components/projection.csv", "dimensionality_reduction/gex/umap_projection.csv", "umap_projection.csv", "projection.csv")
CLUSTERS = ("clustering/gene_expression_graphclust/clusters.csv", "clustering/graphclust/clusters.csv", "clustering/gex/graphclust/clusters.csv", "clusters.csv")
#: Bin sizes of a binned layout, the preferred one first.
BINS = ("square_008um", "square_016um", "square_002um")


@dataclasses.dataclass
class Layout:
    kind: str
    counts: DataFrame | None = None  # feature_id, cell_id (places) or feature, cell (names), value
    features: DataFrame | None = None  # id, name
    cells: DataFrame | None = None  # cell, and what is known of it: x, y, cluster, ux, uy
    peaks: DataFrame | None = None  # chr, start, end, gene
    polygons: DataFrame | None = None
    transcripts: DataFrame | None = None
    genome: str | None = None


def first_path(spark: SparkSession, folder: str, *names: str) -> str | None:
    """The first of these paths under the folder that exists, gzipped or not."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return next((f"{folder}/{n}{end}" for n in names for end in ("", ".gz") if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}{end}"))), None)


def _analysed(spark: SparkSession, folder: str, cells: DataFrame | None) -> DataFrame | None:
    """cells with ux, uy of the projection and cluster of the clusters file, where there are such; these files' cells where
    there is no list of cells."""
    for names, read, renamed in ((PROJECTIONS, readers.projection, {"x": "ux", "y": "uy"}), (CLUSTERS, readers.cluster_file, {})):
        path = first_path(spark, folder, *[a + n for n in names for a in ANALYSIS])
        if path:
            rows = read(spark, path).withColumnsRenamed(renamed)
            cells = rows if cells is None else cells.join(rows, "cell", "left")
    return cells


def _matrix(spark: SparkSession, folder: str, *names: str) -> tuple[DataFrame, DataFrame, DataFrame] | tuple[None, None, None]:
    path = first_path(spark, folder, *[o + n for o in ("", "outs/") for n in names])
    return readers.tenx_folder(spark, path) if path else (None, None, None)


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """transcript, cell, feature, x, y, z, qv of a transcripts table (CSV or Parquet); rows without place go."""
    rows = spark.read.parquet(path) if path.endswith(".parquet") else readers.csv(spark, path)
    text, num = lambda *c: readers.first_of(rows, *c), lambda *c: readers.first_of(rows, *c).try_cast("double")
    made = rows.select(text("transcript_id").alias("transcript"), text("cell_id").alias("cell"), text("feature_name").alias("feature"), num("x_location").alias("x"), num("y_location").alias("y"), num("z_location").alias("z"), num("qv").alias("qv"))
    return made.where("x is not null and y is not null")


def atac(spark: SparkSession, folder: str) -> Layout:
    """Peaks matrix, peaks (annotated where there is an annotation), and the assembly that the summary names."""
    counts, features, barcodes = _matrix(spark, folder, "filtered_peak_bc_matrix", "raw_peak_bc_matrix")
    annotation = first_path(spark, folder, "peak_annotation.tsv", "outs/peak_annotation.tsv", "atac_peak_annotation.tsv", "outs/atac_peak_annotation.tsv")
    plain = first_path(spark, folder, "peaks.bed", "outs/peaks.bed", "filtered_peak_bc_matrix/peaks.bed", "outs/filtered_peak_bc_matrix/peaks.bed")
    peaks = readers.peak_annotation(spark, annotation) if annotation else readers.bed(spark, plain).withColumn("gene", F.lit(None).cast("string")) if plain else None
    summary = first_path(spark, folder, "summary.csv", "outs/summary.csv")
    cells = barcodes.select(F.col("id").alias("cell")) if barcodes is not None else None
    return Layout("atac", counts, features, _analysed(spark, folder, cells), peaks, genome=readers.genome(spark, summary) if summary else None)


def multiome(spark: SparkSession, folder: str) -> Layout:
    """The joint matrix with its cells' projection and clusters (old and new folder names), and the annotated peaks."""
    counts, features, barcodes = _matrix(spark, folder, "filtered_feature_bc_matrix", "raw_feature_bc_matrix")
    own = atac(spark, folder)
    cells = barcodes.select(F.col("id").alias("cell")) if barcodes is not None else None
    return Layout("multiome", counts, features, _analysed(spark, folder, cells), own.peaks, genome=own.genome)


def xenium(spark: SparkSession, folder: str) -> Layout:
    """Cells with place, projection and cluster, matrix, and transcripts."""
    counts, features, _ = _matrix(spark, folder, "cell_feature_matrix")
    path = first_path(spark, folder, "cells.parquet", "cells.csv", "outs/cells.parquet", "outs/cells.csv")
    if path is None:
        raise FileNotFoundError(f"{folder} has no cells table")
    molecules = first_path(spark, folder, "transcripts.parquet", "transcripts.csv", "outs/transcripts.parquet", "outs/transcripts.csv")
    return Layout("xenium", counts, features, _analysed(spark, folder, readers.xenium_cells(spark, path)), transcripts=transcripts(spark, molecules) if molecules else None)


def positions(spark: SparkSession, path: str) -> DataFrame:
    """cell, x, y (pixels) of tissue positions (CSV or Parquet): those in the tissue, where the file tells."""
    rows = spark.read.parquet(path) if path.endswith(".parquet") else readers.csv(spark, path)
    num = lambda c: readers.first_of(rows, c).try_cast("double")
    inside = F.coalesce(readers.first_of(rows, "in_tissue").try_cast("int"), F.lit(1)) == 1
    return rows.where(inside).select(readers.first_of(rows, "barcode").alias("cell"), num("pxl_col_in_fullres").alias("x"), num("pxl_row_in_fullres").alias("y")).where("cell is not null and x is not null and y is not null")


def visium_hd(spark: SparkSession, folder: str) -> Layout:
    """Segmented cells where there are polygons, else the preferred bin size: matrix and places."""
    shapes = first_path(spark, folder, *[o + s + "cell_segmentations.geojson" for o in ("", "outs/") for s in ("", "segmented_outputs/")])
    if shapes:
        counts, features, _ = _matrix(spark, folder, "segmented_outputs/filtered_feature_cell_matrix", "filtered_feature_cell_matrix")
        polygons = readers.cell_polygons(spark, shapes)
        cells = polygons.select("cell", "x", "y")
        mapped = first_path(spark, folder, "barcode_mappings.parquet", "outs/barcode_mappings.parquet")
        if mapped:  # barcodes of a cell, by its number
            pairs = spark.read.parquet(mapped)
            cells = cells.join(pairs.select(readers.first_of(pairs, "cell_id").cast("string").alias("cell"), readers.first_of(pairs, "barcode", "square_008um").alias("barcode")), "cell", "left")
        return Layout("visium_hd", counts, features, _analysed(spark, folder, cells), polygons=polygons)
    bins = [o + "binned_outputs/" + b for o in ("", "outs/") for b in BINS]
    path = first_path(spark, folder, *[f"{b}/spatial/tissue_positions.{end}" for b in [*bins, ""] for end in ("parquet", "csv")], "tissue_positions.parquet", "tissue_positions.csv")
    if path is None:
        raise FileNotFoundError(f"{folder} has neither cell polygons nor tissue positions")
    counts, features, _ = _matrix(spark, folder, *[f"{b}/filtered_feature_bc_matrix" for b in bins], "filtered_feature_bc_matrix")
    return Layout("visium_hd", counts, features, _analysed(spark, folder, positions(spark, path)))


def merfish(spark: SparkSession, folder: str) -> Layout:
    """Matrix by names, and cells with the metadata's place and the columns of the category files."""
    matrix, meta = first_path(spark, folder, "cell_by_gene.csv"), first_path(spark, folder, "cell_metadata.csv")
    if matrix is None or meta is None:
        raise FileNotFoundError(f"{folder} lacks cell_by_gene.csv or cell_metadata.csv")
    rows = readers.csv(spark, meta)
    first, *rest = rows.columns
    num = lambda *c: readers.first_of(rows, *c).try_cast("double")
    cells = rows.select(F.col(f"`{first}`").alias("cell"), num("center_x", "x").alias("x"), num("center_y", "y").alias("y"))
    for name, kind in (("cell_categories.csv", "string"), ("cell_numeric_categories.csv", "double")):
        if path := first_path(spark, folder, name):
            more = readers.csv(spark, path)
            cells = cells.join(more.select(F.col(f"`{more.columns[0]}`").alias("cell"), *[F.col(f"`{c}`").try_cast(kind).alias(c) for c in more.columns[1:]]), "cell", "left")
    return Layout("merfish", readers.merfish_matrix(spark, matrix), None, cells)


LOADERS = {"multiome": multiome, "atac": atac, "xenium": xenium, "visium_hd": visium_hd, "merfish": merfish}


def integrated(parts: dict[str, Layout]) -> Layout:
    """Two or three samples as one, with a sample column; exactly two for spatial layouts. Cells are told apart by sample."""
    kinds = {p.kind for p in parts.values()}
    if len(kinds) != 1:
        raise ValueError("samples of one kind only can be set side by side")
    kind = kinds.pop()
    if len(parts) not in ((2,) if kind in ("xenium", "merfish", "visium_hd") else (2, 3)):
        raise ValueError(f"{len(parts)} samples of {kind} can't be set side by side")

    def side_by_side(name: str) -> DataFrame | None:
        found = {k: getattr(p, name) for k, p in parts.items()}
        return None if any(v is None for v in found.values()) else readers.samples(found)

    return Layout(kind, side_by_side("counts"), side_by_side("features"), side_by_side("cells"), side_by_side("peaks"))
