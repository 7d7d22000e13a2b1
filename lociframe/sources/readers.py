"""Readers of single-cell and spatial file layouts, as DataFrames of the data model.

Readers take explicit schemas and work on splittable text wherever the format allows it. HDF5 files have a source of their own (hdf5),
and so have fragment files with an index (tabix).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.genomic import genome_of

MICRONS_PER_PIXEL = 0.2125


#: Begins the comment in which our writer repeats the size line, as a folder's parts have no first line.
SIZE_COMMENT = "%%size "


def matrix_market_shape(spark: SparkSession, path: str) -> tuple[int, int, int]:
    """Rows, columns and entries: from our writer's comment, or else the first line that is no comment."""
    lines = spark.read.text(path)
    # a foreign file holds its comments in front; only a folder of parts is searched as a whole
    line = lines.where(F.col("value").startswith(SIZE_COMMENT)).select(F.substring("value", len(SIZE_COMMENT) + 1, 100).alias("value")).first() if _is_folder(spark, path) else None
    line = line or lines.where(~F.col("value").startswith("%") & (F.trim("value") != "")).first()
    rows, cols, entries = (int(x) for x in line.value.split()[:3])
    return rows, cols, entries


def matrix_market(spark: SparkSession, path: str) -> DataFrame:
    """feature_id, cell_id (both from 0), value of a MatrixMarket coordinate file (.gz too), decimals included.

    The order of entries is free. The size line looks like an entry; it is taken out by its value, once."""
    rows, cols, entries = matrix_market_shape(spark, path)
    parts = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).where(~F.col("value").startswith("%") & (F.trim("value") != ""))
    made = lines.select((parts[0].cast("long") - 1).alias("feature_id"), (parts[1].cast("long") - 1).alias("cell_id"), parts[2].cast("double").alias("value"))
    size_line = (F.col("feature_id") == rows - 1) & (F.col("cell_id") == cols - 1) & (F.col("value") == float(entries))
    twin = made.where(size_line).limit(2).count() == 2
    kept = made.where(~size_line)
    return kept.unionByName(made.where(size_line).limit(1)) if twin else kept


def named_lines(spark: SparkSession, path: str) -> DataFrame:
    """id and name of a features or genes file (tab-separated: id, name, type), or of a file of one name a line."""
    parts = F.split("value", "\t")
    return spark.read.text(path).where(F.trim("value") != "").select(parts[0].alias("id"), F.coalesce(F.get(parts, F.lit(1)), parts[0]).alias("name"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()


def _listing(spark: SparkSession, path: str) -> list[str]:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in fs.listStatus(where)) if fs.exists(where) else []


def find_file(names: list[str], *patterns: str) -> str | None:
    """The first name that matches the first pattern that any name matches."""
    return next((n for p in patterns for n in names if re.search(p, n)), None)


def detect_layout(spark: SparkSession, path: str) -> str | None:
    """xenium, visium_hd, cosmx, merfish, h5, mtx or fragments by the names in a folder; null if none fits."""
    names = _listing(spark, path)
    rules = (("xenium", r"^experiment\.xenium$|^cells\.(csv|parquet)"), ("visium_hd", r"tissue_positions|cell_segmentations\.geojson|^binned_outputs$"), ("cosmx", r"exprMat_file"), ("merfish", r"cell_by_gene\.csv"), ("mtx", r"matrix\.mtx"), ("h5", r"\.h5$"), ("fragments", r"fragments\.tsv"))
    return next((name for name, pattern in rules if find_file(names, pattern)), None)


def tenx_folder(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """counts, features and barcodes of a folder with matrix, features (or genes) and barcodes files, gzipped or not."""
    names = _listing(spark, path)
    found = [find_file(names, p) for p in (r"matrix\.mtx(\.gz)?$", r"(features|genes|peaks)\.(tsv|bed)(\.gz)?$", r"barcodes\.tsv(\.gz)?$")]
    if None in found:
        raise FileNotFoundError(f"{path} lacks a matrix, features or barcodes file; sources.hdf5 reads .h5 files")
    m, f, b = (f"{path}/{n}" for n in found)
    return matrix_market(spark, m), named_lines(spark, f), named_lines(spark, b)


def bed(spark: SparkSession, path: str) -> DataFrame:
    """chr, start, end of a BED file."""
    parts = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("#"))
    return rows.select(parts[0].alias("chr"), F.get(parts, F.lit(1)).try_cast("long").alias("start"), F.get(parts, F.lit(2)).try_cast("long").alias("end")).where("start is not null and end is not null")


def peak_annotation(spark: SparkSession, path: str) -> DataFrame:
    """chr, start, end, gene of a tab-separated annotation with a header (end may be called stop)."""
    rows = csv(spark, path, "\t")
    return rows.select(first_of(rows, "chrom", "chr").alias("chr"), first_of(rows, "start").try_cast("long").alias("start"), first_of(rows, "end", "stop").try_cast("long").alias("end"), first_of(rows, "gene", "gene_name").alias("gene"))


def fragments(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start, end, barcode, count (1 if missing) of a fragments file; # starts a comment."""
    parts = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & (F.size(parts) >= 4))
    return rows.select(parts[0].alias("chrom"), parts[1].try_cast("long").alias("start"), parts[2].try_cast("long").alias("end"), parts[3].alias("barcode"), F.coalesce(F.get(parts, F.lit(4)).try_cast("long"), F.lit(1).cast("long")).alias("count")).where("start is not null and end is not null")


def csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """All columns as strings, with the header's names; quotes are handled."""
    return spark.read.option("header", True).option("sep", sep).csv(path)


def first_of(rows: DataFrame, *names: str) -> Column:
    """The first column of these names that rows has, without regard to case; null if none."""
    have = {c.lower(): c for c in rows.columns}
    hit = next((have[n.lower()] for n in names if n.lower() in have), None)
    return F.col(f"`{hit}`") if hit else F.lit(None).cast("string")


def projection(spark: SparkSession, path: str) -> DataFrame:
    """cell, x, y of a projection file under either tool's header."""
    rows = csv(spark, path)
    return rows.select(first_of(rows, "Barcode", "cell_id").alias("cell"), first_of(rows, "UMAP-1", "umap_1").try_cast("double").alias("x"), first_of(rows, "UMAP-2", "umap_2").try_cast("double").alias("y"))


def cluster_file(spark: SparkSession, path: str) -> DataFrame:
    rows = csv(spark, path)
    return rows.select(first_of(rows, "Barcode", "cell_id").alias("cell"), first_of(rows, "Cluster", "cluster").alias("cluster"))


def xenium_cells(spark: SparkSession, path: str) -> DataFrame:
    """cell, x, y (pixels), transcripts, cell_area, nucleus_area of a cells table (CSV or Parquet); rows without place go."""
    rows = spark.read.parquet(path) if path.endswith(".parquet") else csv(spark, path)
    num = lambda c: first_of(rows, c).try_cast("double")
    made = rows.select(first_of(rows, "cell_id").alias("cell"), (num("x_centroid") / MICRONS_PER_PIXEL).alias("x"), (num("y_centroid") / MICRONS_PER_PIXEL).alias("y"), num("transcript_counts").alias("transcripts"), num("cell_area").alias("cell_area"), num("nucleus_area").alias("nucleus_area"))
    sound = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
    return made.where(sound("x") & sound("y"))


def cell_polygons(spark: SparkSession, path: str) -> DataFrame:
    """cell, x, y (vertex means, the closing vertex included), vertices of a GeoJSON file's polygons with 3 vertices or more."""
    shape = "struct<features:array<struct<geometry:struct<type:string,coordinates:array<array<array<double>>>>,properties:struct<cell_id:string>>>>"
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.explode(F.from_json("value", shape).features).alias("f")).where("f.geometry.type = 'Polygon'").select(F.col("f.properties.cell_id").alias("cell"), F.col("f.geometry.coordinates")[0].alias("ring")).where(F.size("ring") >= 3)
    mean = lambda i: F.aggregate("ring", F.lit(0.0), lambda s, p: s + p[i]) / F.size("ring")
    return rows.select("cell", mean(0).alias("x"), mean(1).alias("y"), F.transform("ring", lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))).alias("vertices"))


def cosmx_matrix(spark: SparkSession, path: str) -> DataFrame:
    """cell (fov_cellID), feature, value of a wide expression file; control columns and values under 1 are left out."""
    rows = csv(spark, path)
    have = {c.lower(): c for c in rows.columns}
    genes = [c for c in rows.columns if c.lower() not in ("fov", "cell_id") and not c.startswith("NegPrb")]
    cell = F.concat_ws("_", F.col(have["fov"]), F.col(have["cell_id"])).alias("cell")
    cast = rows.select(cell, *[F.col(f"`{c}`").try_cast("double").alias(c) for c in genes])
    return cast.unpivot(["cell"], [F.col(f"`{c}`") for c in genes], "feature", "value").where(F.col("value") >= 1)


def merfish_matrix(spark: SparkSession, path: str) -> DataFrame:
    """cell, feature, value of a cell_by_gene file: the first column names the cell."""
    rows = csv(spark, path)
    cell, genes = rows.columns[0], rows.columns[1:]
    cast = rows.select(F.col(f"`{cell}`").alias("cell"), *[F.col(f"`{c}`").try_cast("double").alias(c) for c in genes])
    return cast.unpivot(["cell"], [F.col(f"`{c}`") for c in genes], "feature", "value").where(F.col("value") > 0)


def genome(spark: SparkSession, path: str) -> str | None:
    """The assembly that a summary file names."""
    text = spark.read.text(path, wholetext=True).select(genome_of(F.col("value")).alias("g")).first()
    return text.g if text else None


def samples(parts: dict[str, DataFrame]) -> DataFrame:
    """The rows of two or three samples with a sample column."""
    out = None
    for name, rows in parts.items():
        tagged = rows.withColumn("sample", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged)
    return out
