"""Queries on sources and sinks: tables are written in a format of the field, read again and held against SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import model as m
from ..functions import genomic
from ..model import rounded
from ..operators import spatial
from ..sources import folders, hdf5, readers, results, tabix
from ..streaming import coverage
from .interval_queries import FRAG, IV
from .matrix_queries import CELLS, SCELLS, C


def _write_csv(rows, path, sep=","):
    rows.write.option("header", True).option("sep", sep).csv(path)
    return path


def _folder(spark, name):
    return m.shared_path(spark, name)


def _put(spark, path, *lines):
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.text(path)


def matrix_market_round_trip(spark, sf):
    path = _folder(spark, "mtx")
    results.write_matrix_market(m.counts(spark, sf), m.table(spark, sf, "part").count() + 1, m.table(spark, sf, "supplier").count() + 1, path)
    return readers.matrix_market(spark, path)


def _hdf5(spark, sf):
    """A folder of HDF5 files of the counts, 40 cells in each, and the first cell of every file."""
    path = _folder(spark, "hdf5")
    files = m.materialized(hdf5.write_counts(m.counts(spark, sf), m.table(spark, sf, "part").count() + 1, path, cells_per_file=40), "files")
    return path, files


def hdf5_counts(spark, sf):
    """All counts, written to HDF5 files and read back by their chunks."""
    path, files = _hdf5(spark, sf)
    return hdf5.counts(spark, path, cells=15).join(files, "file").select("feature_id", (F.col("cell_id") + F.col("first")).alias("cell_id"), "value")


def hdf5_features(spark, sf):
    """Totals by name of every fiftieth feature: only chunks that hold one are read of the values."""
    path, files = _hdf5(spark, sf)
    wanted = [r[0] for r in m.features(spark, sf).where("feature_id % 50 = 0").select("feature_id").collect()]
    names = hdf5.column(spark, files.first().file, "names").select(F.col("pos").alias("feature_id"), F.col("value").alias("name"))
    n_cells = hdf5.column(spark, path, "barcodes").agg(F.count_distinct("value").alias("n_barcodes"))
    found = hdf5.counts(spark, path, features=wanted).groupBy("feature_id").agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("n"))
    return found.join(names, "feature_id").crossJoin(F.broadcast(n_cells)).select("feature_id", "name", "total", "n", "n_barcodes")


#: Regions that are read by index: chromosome, first and last place.
REGIONS = (("chr1", 0, 10**9), ("2", 86_400, 400_000), ("CHR3", 1_000_000, 1_200_000), ("chr4", 5_000_000, 5_000_000))


def indexed_fragments(spark, sf):
    """Fragments of some regions, read from block files by their indexes, and the blocks that this took."""
    path = _folder(spark, "tabix")
    m.materialized(tabix.write_indexed(m.fragments(spark, sf), path, 4), "files")
    out = None
    for k, region in enumerate(REGIONS):
        one = tabix.region(spark, path, *region).groupBy("chrom").agg(F.count(F.lit(1)).alias("n"), F.sum("start").alias("starts"), F.count_distinct("barcode").alias("n_barcodes"), (F.count_distinct("file", "block") > 0).alias("read")).withColumn("region", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out


def matrix_market_size(spark, sf):
    path = _folder(spark, "mtx")
    results.write_matrix_market(m.counts(spark, sf), m.table(spark, sf, "part").count(), m.table(spark, sf, "supplier").count(), path)
    return spark.createDataFrame([readers.matrix_market_shape(spark, path)], "n_features long, n_cells long, n_entries long")


def _tenx(spark, sf, path, counts, features, cells):
    results.write_matrix_market(counts, m.table(spark, sf, "part").count() + 1, cells.count() + 1, f"{path}/matrix.mtx.gz")
    results.write_names(features, f"{path}/features.tsv.gz")
    cells.select("cell").write.text(f"{path}/barcodes.tsv")


def _barcodes(spark, sf):
    return m.cells(spark, sf).select("cell_id", F.concat(F.lit("AA-"), F.col("cell_id").cast("string")).alias("cell"), "cluster")


def tenx_folder(spark, sf):
    """Totals by cell of a folder's matrix, with the numbers of its features and barcodes."""
    path = _folder(spark, "tenx")
    _tenx(spark, sf, path, m.counts(spark, sf), m.features(spark, sf).select(F.col("feature_id").cast("string").alias("id"), "name"), _barcodes(spark, sf))
    counts, features, barcodes = readers.tenx_folder(spark, path)
    return counts.groupBy("cell_id").agg(F.sum("value").alias("total")).withColumns({"n_features": F.lit(features.count()), "n_barcodes": F.lit(barcodes.count())})


def _peaks(spark, sf):
    return m.intervals(spark, sf).select("chr", "start", "end", F.concat(F.lit("G"), (F.col("peak_id") % 50).cast("string")).alias("gene"))


def bed_peaks(spark, sf):
    path = _folder(spark, "bed")
    _peaks(spark, sf).select(F.concat_ws("\t", "chr", "start", "end")).write.option("compression", "gzip").text(path)
    return readers.bed(spark, path).groupBy("chr").agg(F.count(F.lit(1)).alias("n"), F.sum("start").alias("starts"), F.sum("end").alias("ends"))


def _analysis_files(spark, sf, path):
    cells = _barcodes(spark, sf)
    _write_csv(cells.select(F.col("cell").alias("Barcode"), (F.col("cell_id") / 4).alias("UMAP-1"), (F.col("cell_id") % 10).alias("UMAP-2")), f"{path}/analysis/umap/2_components/projection.csv")
    _write_csv(cells.select(F.col("cell").alias("Barcode"), F.col("cluster").alias("Cluster")), f"{path}/outs/analysis/clustering/graphclust/clusters.csv")


def atac_folder(spark, sf):
    """Annotated peaks of a folder by gene, with the assembly that its summary names."""
    path = _folder(spark, "atac")
    _write_csv(_peaks(spark, sf).select(F.col("chr").alias("chrom"), "start", F.col("end").alias("stop"), "gene"), f"{path}/outs/peak_annotation.tsv", "\t")
    _put(spark, f"{path}/summary.csv", "Sample,Genome", "a,GRCh38")
    found = folders.atac(spark, path)
    return found.peaks.groupBy("gene").agg(F.count(F.lit(1)).alias("n"), F.max("end").alias("last")).withColumn("genome", F.lit(found.genome))


def multiome_folder(spark, sf):
    """Cells of a folder with projection, cluster and total of its matrix."""
    path = _folder(spark, "multiome")
    _tenx(spark, sf, f"{path}/filtered_feature_bc_matrix", m.counts(spark, sf), m.features(spark, sf).select(F.col("feature_id").cast("string").alias("id"), "name"), _barcodes(spark, sf))
    _analysis_files(spark, sf, path)
    found = folders.multiome(spark, path)
    totals = found.counts.groupBy(F.concat(F.lit("AA-"), F.col("cell_id").cast("string")).alias("cell")).agg(F.sum("value").alias("total"))
    return found.cells.join(totals, "cell", "left").select("cell", "ux", "uy", "cluster", "total")


def _place_table(spark, sf):
    return _barcodes(spark, sf).select(F.col("cell").alias("cell_id"), (F.col("cell_id") / 8).alias("x_centroid"), F.when(F.col("cell_id") % 9 > 0, F.col("cell_id") * 2).alias("y_centroid"), F.lit(5).alias("transcript_counts"))


def xenium_folder(spark, sf):
    path = _folder(spark, "xenium")
    _write_csv(_place_table(spark, sf), f"{path}/outs/cells.csv")
    _analysis_files(spark, sf, path)
    molecules = m.table(spark, sf, "lineitem").select(F.monotonically_increasing_id().alias("transcript_id"), F.concat(F.lit("AA-"), F.col("l_suppkey").cast("string")).alias("cell_id"), F.col("l_partkey").alias("feature_name"), F.col("l_quantity").alias("x_location"), F.col("l_tax").alias("y_location"), F.lit(0).alias("z_location"), F.lit(40).alias("qv"))
    molecules.write.parquet(f"{path}/transcripts.parquet")
    found = folders.xenium(spark, path)
    spots = found.transcripts.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("x_sum"))
    return found.cells.join(spots, "cell", "left").select("cell", rounded(F.col("x"), 4).alias("x"), rounded(F.col("y"), 4).alias("y"), "transcripts", "ux", "cluster", "n", "x_sum")


def transcript_sample(spark, sf):
    """Every k-th transcript in the order of its number, 500 at most and more than half of that."""
    from ..operators import intervals

    rows = m.table(spark, sf, "events").select("event_id", "value")
    return intervals.stride_sample(rows, "event_id", 500).agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))


def visium_bins(spark, sf):
    """Places of the preferred bin size of three, in the tissue only."""
    path = _folder(spark, "visium")
    rows = _barcodes(spark, sf).select(F.col("cell").alias("barcode"), (F.col("cluster") % 2).alias("in_tissue"), (F.col("cell_id") * 3).alias("pxl_row_in_fullres"), (F.col("cell_id") + 1).alias("pxl_col_in_fullres"))
    rows.write.parquet(f"{path}/outs/binned_outputs/square_008um/spatial/tissue_positions.parquet")
    rows.limit(1).write.parquet(f"{path}/outs/binned_outputs/square_002um/spatial/tissue_positions.parquet")
    rows.limit(2).write.parquet(f"{path}/outs/binned_outputs/square_016um/spatial/tissue_positions.parquet")
    return folders.visium_hd(spark, path).cells.select("cell", "x", "y")


def visium_cells(spark, sf):
    """Polygons of a segmented folder with their middle."""
    path = _folder(spark, "visium")
    corner = lambda dx, dy: F.array((F.col("cell_id") + dx).cast("double"), (F.col("cell_id") * 2 + dy).cast("double"))
    ring = F.array(corner(0, 0), corner(4, 0), corner(4, 3), corner(0, 0))
    shapes = m.cells(spark, sf).select(F.struct(F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"), F.struct(F.col("cell_id").cast("string").alias("cell_id")).alias("properties")).alias("f"))
    shapes.agg(F.to_json(F.struct(F.collect_list("f").alias("features"))).alias("value")).coalesce(1).write.text(f"{path}/segmented_outputs/cell_segmentations.geojson")
    return folders.visium_hd(spark, path).polygons.select("cell", "x", "y", F.size("vertices").alias("n_vertices"))


def merfish_folder(spark, sf):
    path = _folder(spark, "merfish")
    cells = m.cells(spark, sf)
    wide = m.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("cell")).pivot("l_returnflag", ["A", "N", "R"]).agg(F.sum("l_quantity"))
    _write_csv(wide, f"{path}/cell_by_gene.csv")
    _write_csv(cells.select("cell_id", (F.col("cell_id") / 2).alias("center_x"), F.col("cluster").alias("center_y")), f"{path}/cell_metadata.csv")
    _write_csv(cells.where("cell_id % 2 = 0").select("cell_id", "label"), f"{path}/cell_categories.csv")
    _write_csv(cells.select("cell_id", (F.col("cell_id") * 1.5).alias("volume")), f"{path}/cell_numeric_categories.csv")
    found = folders.merfish(spark, path)
    totals = found.counts.groupBy("cell").agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("n"))
    return found.cells.join(totals, "cell", "left").select("cell", "x", "y", "label", "volume", "total", "n")


def cosmx_matrix(spark, sf):
    path = _folder(spark, "cosmx")
    wide = m.table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 5).alias("fov"), F.col("l_suppkey").alias("cell_ID")).pivot("l_returnflag", ["A", "N", "R"]).agg(F.sum("l_quantity")).withColumnRenamed("R", "NegPrb1")
    _write_csv(wide, f"{path}/x_exprMat_file.csv")
    return readers.cosmx_matrix(spark, f"{path}/x_exprMat_file.csv")


def integrated_samples(spark, sf):
    """Two samples' cells side by side."""
    cells = _barcodes(spark, sf)
    parts = {name: folders.Layout("multiome", cells=cells.where(F.col("cell_id") % 2 == k).select("cell", "cluster")) for k, name in enumerate(("a", "b"))}
    return folders.integrated(parts).cells.groupBy("sample", "cluster").agg(F.count(F.lit(1)).alias("n"))


def layouts(spark, sf):
    """What kind of data set a folder of the cells is taken for, by the names in it, and the rows it holds."""
    names = ("cells.csv", "tissue_positions.csv", "a_exprMat_file.csv", "cell_by_gene.csv", "matrix.mtx", "x.h5", "fragments.tsv", "notes.txt")
    found = []
    for name in names:
        path = _folder(spark, "layout")
        m.cells(spark, sf).select("cell_id", "cluster", "label").write.csv(f"{path}/{name}")
        found.append((name, readers.detect_layout(spark, path), spark.read.text(f"{path}/{name}").count()))
    return spark.createDataFrame(found, "file string, layout string, n_rows long")


def genome_names(spark, sf):
    texts = ("Genome,GRCh38", "Reference,hg19", "a,mm10", "GRCm39,x", "mouse", "Human", "zebrafish")
    pick = F.element_at(F.array(*[F.lit(t) for t in texts]), (F.col("p_partkey") % len(texts) + 1).cast("int"))
    return m.table(spark, sf, "part").select("p_partkey", genomic.genome_of(pick).alias("genome"))


def fragment_file(spark, sf):
    """Fragments of a region, from a compressed file with comments and lines without a count."""
    path = _folder(spark, "fragments")
    rows = m.fragments(spark, sf)
    line = F.when(F.col("start") % 3 == 0, F.concat_ws("\t", "chrom", "start", "end", "barcode")).otherwise(F.concat_ws("\t", "chrom", "start", "end", "barcode", F.lit(2)))
    rows.select(F.when(F.col("start") % 11 == 0, F.concat(F.lit("# "), line)).otherwise(line)).write.option("compression", "gzip").text(path)
    from ..operators import intervals

    found = intervals.in_region(readers.fragments(spark, path), "CHR2", 0, 900_000)
    return found.groupBy("barcode").agg(F.count(F.lit(1)).alias("n"), F.sum("count").alias("counted"), F.min("start").alias("first"))


def projection_file(spark, sf):
    path = _folder(spark, "projection")
    _analysis_files(spark, sf, path)
    return readers.projection(spark, f"{path}/analysis/umap/2_components/projection.csv")


def quoted_csv(spark, sf):
    """Any CSV file, quotes, commas and line breaks in its values included."""
    path = _folder(spark, "csv")
    rows = m.table(spark, sf, "part").select("p_partkey", F.concat("p_name", F.lit(', "so"')).alias("note"))
    _write_csv(rows, path)
    return readers.csv(spark, path).select(F.col("p_partkey").cast("long").alias("p_partkey"), F.length("note").alias("size"))


def affine_file(spark, sf):
    """Points through the affine map of a file of three lines, and back."""
    path = _folder(spark, "affine")
    _put(spark, path, "2, 0.5, 10", "0 4 -3", "0,0,1")
    there = spatial.read_affine("\n".join(r.value for r in spark.read.text(path).collect()))
    x, y = spatial.transform(F.col("x"), F.col("y"), there)
    back = spatial.transform(x, y, spatial.inverse(there))
    return m.points(spark, sf).select("id", rounded(x, 5).alias("x"), rounded(y, 5).alias("y"), (F.abs(back[0] - F.col("x")) < 1e-9).alias("same"))


def saved_analysis(spark, sf):
    """An analysis saved, saved again with one table changed, and loaded; written_again tells which tables the second save wrote."""
    path = _folder(spark, "saved")
    cells, genes = m.cells(spark, sf), m.features(spark, sf)
    results.save(spark, path, {"cells": cells, "genes": genes}, {"k": 1})
    again = results.save(spark, path, {"cells": cells.repartition(3), "genes": genes.where("feature_id % 2 = 0")}, {"k": 2})
    tables, settings = results.load(spark, path)
    sizes = [(name, df.count(), name in again, settings["k"]) for name, df in tables.items()]
    return spark.createDataFrame(sizes, "name string, n long, written_again boolean, k long")


def cached_rows(spark, sf):
    """Rows built from a source once: the second call reads what the first kept."""
    path, source = _folder(spark, "cache"), f"{sf}/supplier.parquet"
    built = lambda k: lambda: m.cells(spark, sf).groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).withColumn("build", F.lit(k))
    results.cached(spark, source, path, built(1))
    return results.cached(spark, source, path, built(2))


def annotation_file(spark, sf):
    path = _folder(spark, "annotations")
    results.export_annotations(m.sparse_cells(spark, sf), path)
    return readers.csv(spark, path).groupBy("label", "sample").agg(F.count(F.lit(1)).alias("n"))


def stream_counts(spark, sf):
    """Events counted by hour and type from a stream over the table's files, to the end of what there is."""
    events = m.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    folder, out = _folder(spark, "stream"), _folder(spark, "streamed")
    events.repartition(4).write.parquet(folder)
    stream = coverage.stream_table(spark, folder, events.schema).withColumn("__one", F.lit(1))
    counted = coverage.windowed_counts(stream.drop("__one")).select("window_start", "key", "n")

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/rows")

    counted.writeStream.outputMode("complete").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return spark.read.parquet(f"{out}/rows").select(F.unix_timestamp("window_start").alias("hour"), "key", "n")


_T = "t AS (SELECT cell_id, sum(value) AS total FROM counts GROUP BY 1)"
_GENOMES = "CASE CAST(p_partkey % 7 AS INTEGER) WHEN 0 THEN 'hg38' WHEN 1 THEN 'hg19' WHEN 2 THEN 'mm10' WHEN 3 THEN 'mm39' WHEN 4 THEN 'mm10' WHEN 5 THEN 'hg38' END"

QUERIES = {
    "matrix_market_round_trip": (matrix_market_round_trip, f"WITH {C} SELECT feature_id, cell_id, value FROM counts"),
    "hdf5_counts": (hdf5_counts, f"WITH {C} SELECT feature_id, cell_id, value FROM counts"),
    "hdf5_features": (hdf5_features, f"WITH {C} SELECT feature_id, 'Gene' || CAST(feature_id AS VARCHAR) AS name, sum(value) AS total, count(*) AS n, (SELECT CAST(sum(n) AS BIGINT) FROM (SELECT max(cell_id) - min(cell_id // 40 * 40) + 1 AS n FROM counts GROUP BY cell_id // 40)) AS n_barcodes FROM counts WHERE feature_id % 50 = 0 GROUP BY 1, 2"),
    "indexed_fragments": (indexed_fragments, f"WITH {FRAG}, g AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, 'chr{c.lower().removeprefix('chr')}', {a}, {b})" for k, (c, a, b) in enumerate(REGIONS)) + ") AS v(region, chrom, a, b)) SELECT region, f.chrom AS chrom, count(*) AS n, CAST(sum(s) AS BIGINT) AS starts, count(DISTINCT barcode) AS n_barcodes, true AS read FROM frag f JOIN g ON g.chrom = f.chrom AND f.e >= a AND f.s <= b GROUP BY 1, 2"),
    "matrix_market_size": (matrix_market_size, f"WITH {C} SELECT (SELECT count(*) FROM part) AS n_features, (SELECT count(*) FROM supplier) AS n_cells, count(*) AS n_entries FROM counts"),
    "tenx_folder": (tenx_folder, f"WITH {C}, {_T} SELECT cell_id, total, (SELECT count(*) FROM part) AS n_features, (SELECT count(*) FROM supplier) AS n_barcodes FROM t"),
    "bed_peaks": (bed_peaks, f"WITH {IV} SELECT chr, count(*) AS n, CAST(sum(s) AS BIGINT) AS starts, CAST(sum(e) AS BIGINT) AS ends FROM iv GROUP BY 1"),
    "atac_folder": (atac_folder, f"WITH {IV} SELECT 'G' || CAST(peak_id % 50 AS VARCHAR) AS gene, count(*) AS n, CAST(max(e) AS BIGINT) AS last, 'hg38' AS genome FROM iv GROUP BY 1"),
    "multiome_folder": (multiome_folder, f"WITH {C}, {CELLS}, {_T} SELECT 'AA-' || CAST(cell_id AS VARCHAR) AS cell, cell_id / 4.0::DOUBLE AS ux, CAST(cell_id % 10 AS DOUBLE) AS uy, CAST(cluster AS VARCHAR) AS cluster, total FROM cells LEFT JOIN t USING (cell_id)"),
    "xenium_folder": (xenium_folder, f"WITH {CELLS}, t AS (SELECT l_suppkey AS cell_id, count(*) AS n, sum(l_quantity) AS x_sum FROM lineitem GROUP BY 1) SELECT 'AA-' || CAST(cell_id AS VARCHAR) AS cell, round(cell_id / 8.0::DOUBLE / 0.2125, 4) + 0.0 AS x, round(cell_id * 2 / 0.2125::DOUBLE, 4) + 0.0 AS y, 5.0::DOUBLE AS transcripts, cell_id / 4.0::DOUBLE AS ux, CAST(cluster AS VARCHAR) AS cluster, n, x_sum FROM cells LEFT JOIN t USING (cell_id) WHERE cell_id % 9 > 0"),
    "transcript_sample": (transcript_sample, "WITH e AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS i, count(*) OVER () AS n FROM events), w AS (SELECT DISTINCT CASE WHEN n <= 500 THEN i ELSE k * n // 500 END AS i FROM e, (SELECT unnest(range(0, 500)) AS k)) SELECT count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM e SEMI JOIN w USING (i)"),
    "visium_bins": (visium_bins, f"WITH {CELLS} SELECT 'AA-' || CAST(cell_id AS VARCHAR) AS cell, CAST(cell_id + 1 AS DOUBLE) AS x, CAST(cell_id * 3 AS DOUBLE) AS y FROM cells WHERE cluster % 2 = 1"),
    "visium_cells": (visium_cells, f"WITH {CELLS} SELECT CAST(cell_id AS VARCHAR) AS cell, CAST((4 * cell_id + 8) AS DOUBLE) / 4 AS x, CAST((8 * cell_id + 3) AS DOUBLE) / 4 AS y, CAST(4 AS INTEGER) AS n_vertices FROM cells"),
    "merfish_folder": (merfish_folder, f"WITH {CELLS}, f AS (SELECT l_suppkey AS cell_id, l_returnflag, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2), t AS (SELECT cell_id, sum(v) AS total, count(*) AS n FROM f WHERE v > 0 GROUP BY 1) SELECT CAST(cell_id AS VARCHAR) AS cell, cell_id / 2.0::DOUBLE AS x, CAST(cluster AS DOUBLE) AS y, CASE WHEN cell_id % 2 = 0 THEN label END AS label, cell_id * 1.5::DOUBLE AS volume, total, n FROM cells LEFT JOIN t USING (cell_id)"),
    "cosmx_matrix": (cosmx_matrix, "SELECT CAST(l_suppkey % 5 AS VARCHAR) || '_' || CAST(l_suppkey AS VARCHAR) AS cell, l_returnflag AS feature, sum(l_quantity) AS value FROM lineitem WHERE l_returnflag IN ('A', 'N') GROUP BY l_suppkey, l_returnflag HAVING sum(l_quantity) >= 1"),
    "integrated_samples": (integrated_samples, f"WITH {CELLS} SELECT CASE WHEN cell_id % 2 = 0 THEN 'a' ELSE 'b' END AS sample, cluster, count(*) AS n FROM cells GROUP BY 1, 2"),
    "layouts": (layouts, "SELECT file, layout, (SELECT count(*) FROM supplier) AS n_rows FROM (VALUES ('cells.csv', 'xenium'), ('tissue_positions.csv', 'visium_hd'), ('a_exprMat_file.csv', 'cosmx'), ('cell_by_gene.csv', 'merfish'), ('matrix.mtx', 'mtx'), ('x.h5', 'h5'), ('fragments.tsv', 'fragments'), ('notes.txt', NULL)) AS v(file, layout)"),
    "genome_names": (genome_names, f"SELECT p_partkey, {_GENOMES} AS genome FROM part"),
    "fragment_file": (fragment_file, f"WITH {FRAG} SELECT CAST(barcode AS VARCHAR) AS barcode, count(*) AS n, CAST(sum(CASE WHEN s % 3 = 0 THEN 1 ELSE 2 END) AS BIGINT) AS counted, min(s) AS first FROM frag WHERE chrom = 'chr2' AND s % 11 <> 0 AND e >= 0 AND s <= 900000 GROUP BY 1"),
    "projection_file": (projection_file, f"WITH {CELLS} SELECT 'AA-' || CAST(cell_id AS VARCHAR) AS cell, cell_id / 4.0::DOUBLE AS x, CAST(cell_id % 10 AS DOUBLE) AS y FROM cells"),
    "quoted_csv": (quoted_csv, "SELECT p_partkey, CAST(length(p_name) + 6 AS INTEGER) AS size FROM part"),
    "affine_file": (affine_file, "SELECT vec_id AS id, round(2 * embedding[1]::DOUBLE + 0.5 * embedding[2]::DOUBLE + 10, 5) + 0.0 AS x, round(4 * embedding[2]::DOUBLE - 3, 5) + 0.0 AS y, true AS same FROM embeddings"),
    "saved_analysis": (saved_analysis, "SELECT 'cells' AS name, (SELECT count(*) FROM supplier) AS n, false AS written_again, CAST(2 AS BIGINT) AS k UNION ALL SELECT 'genes', (SELECT count(*) FROM part WHERE p_partkey % 2 = 0), true, 2"),
    "cached_rows": (cached_rows, f"WITH {CELLS} SELECT cluster, count(*) AS n, CAST(1 AS INTEGER) AS build FROM cells GROUP BY 1"),
    "annotation_file": (annotation_file, f"WITH {SCELLS} SELECT label, CAST(sample AS VARCHAR) AS sample, count(*) AS n FROM cells GROUP BY 1, 2"),
    "stream_counts": (stream_counts, "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS hour, event_type AS key, count(*) AS n FROM events GROUP BY 1, 2"),
}
