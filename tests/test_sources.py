import gzip
import json

import pytest
from pyspark.sql import functions as F

from lociframe import commands
from lociframe.sources import folders, readers, results
from lociframe.streaming import coverage, progress


def put(folder, name, text):
    (folder / name).write_bytes(gzip.compress(text.encode()) if name.endswith(".gz") else text.encode())
    return str(folder / name)


def test_matrix_folder(spark, tmp_path, rows):
    put(tmp_path, "matrix.mtx.gz", "%%MatrixMarket\n% note\n3 2 3\n1 1 2\r\n3 2 1.5\n2 1 7\n")
    put(tmp_path, "features.tsv.gz", "E1\tG1\tGene Expression\nE2\tG2\tGene Expression\n")
    put(tmp_path, "barcodes.tsv", "AA\nCC\n")
    counts, features, barcodes = readers.tenx_folder(spark, str(tmp_path))
    assert rows(counts) == [(0, 0, 2.0), (1, 0, 7.0), (2, 1, 1.5)]
    assert rows(features) == [("E1", "G1"), ("E2", "G2")] and barcodes.count() == 2
    assert readers.detect_layout(spark, str(tmp_path)) == "mtx"


def test_entry_that_looks_like_the_size_line(spark, tmp_path, rows):
    path = put(tmp_path, "m.mtx", "%\n2 2 2\n2 2 2\n1 1 1\n")
    assert rows(readers.matrix_market(spark, path)) == [(0, 0, 1.0), (1, 1, 2.0)]


def test_spatial_files(spark, tmp_path, rows):
    cells = put(tmp_path, "cells.csv", 'cell_id,x_centroid,y_centroid,transcript_counts,cell_area\n"a",2.125,4.25,10,3\nb,,1,1,1\n')
    assert rows(readers.xenium_cells(spark, cells)) == [("a", 10.0, 20.0, 10.0, 3.0, None)]
    shape = json.dumps({"features": [{"geometry": {"type": "Polygon", "coordinates": [[[0, 0], [2, 0], [2, 2], [0, 0]]]}, "properties": {"cell_id": "7"}}, {"geometry": {"type": "Point", "coordinates": []}, "properties": {}}]})
    found = readers.cell_polygons(spark, put(tmp_path, "s.geojson", shape)).first()
    assert (found.cell, found.x, found.y) == ("7", 1.0, 0.5)
    wide = put(tmp_path, "x_exprMat_file.csv", "fov,cell_ID,GeneA,NegPrb1\n1,2,3,4\n1,3,0,1\n")
    assert rows(readers.cosmx_matrix(spark, wide)) == [("1_2", "GeneA", 3.0)]
    projection = put(tmp_path, "p.csv", "Barcode,UMAP-1,UMAP-2\na,1,2\n")
    assert rows(readers.projection(spark, projection)) == [("a", 1.0, 2.0)]


def test_fragments_and_bed(spark, tmp_path, rows):
    path = put(tmp_path, "f.tsv.gz", "# head\nchr1\t1\t5\tAA\t2\nchr1\t3\t9\tCC\n")
    assert rows(readers.fragments(spark, path)) == [("chr1", 1, 5, "AA", 2), ("chr1", 3, 9, "CC", 1)]
    assert rows(readers.bed(spark, put(tmp_path, "p.bed", "chr1\t1\t5\nbad\n"))) == [("chr1", 1, 5)]
    assert readers.genome(spark, put(tmp_path, "summary.csv", "Genome,GRCh38\n")) == "hg38"


def test_save_load(spark, tmp_path, rows):
    path, table = f"file://{tmp_path}/saved", spark.range(5)
    assert results.save(spark, path, {"a": table}, {"k": 1}) == ["a"]
    assert results.save(spark, path, {"a": table.repartition(3)}, {"k": 2}) == []
    tables, settings = results.load(spark, path)
    assert rows(tables["a"]) == rows(table) and settings == {"k": 2}
    assert results.load(spark, f"file://{tmp_path}/none") is None


def test_saved_nulls_count(spark, tmp_path, rows):
    """Tables that differ in where their nulls are, or in the names of their columns, are written anew."""
    path, shape = f"file://{tmp_path}/n", "a int, b int, c array<int>"
    made = [[(1, None, [1, None])], [(None, 1, [1, None])], [(None, 1, [None, 1])], [(None, 1, None)]]
    for table in made:
        assert results.save(spark, path, {"t": spark.createDataFrame(table, shape)}) == ["t"]
        assert rows(results.load(spark, path)[0]["t"]) == table
        assert results.save(spark, path, {"t": spark.createDataFrame(table, shape)}) == []
    assert results.save(spark, path, {"t": spark.createDataFrame(made[-1], shape).withColumnRenamed("a", "z")}) == ["t"]


def test_matrix_round_trip(spark, tmp_path, rows):
    counts = spark.createDataFrame([(0, 0, 2.0), (4, 2, 1.0)], "feature_id long, cell_id long, value double")
    results.write_matrix_market(counts, 5, 3, f"file://{tmp_path}/m")
    assert rows(readers.matrix_market(spark, f"file://{tmp_path}/m")) == rows(counts)


def test_large_matrix_in_parts(spark, tmp_path, rows):
    n = 120_000
    counts = spark.range(n).select((F.col("id") % 700).alias("feature_id"), (F.col("id") * 7 % 300_000).alias("cell_id"), (F.col("id") % 9 + 1).cast("double").alias("value")).repartition(7)
    counts = counts.unionByName(spark.createDataFrame([(999, 299_999, float(n + 1))], counts.schema))  # looks like the size line
    path = f"file://{tmp_path}/m"
    results.write_matrix_market(counts, 1000, 300_000, path)
    assert readers.matrix_market_shape(spark, path) == (1000, 300_000, n + 1)
    found = readers.matrix_market(spark, path)
    assert found.count() == n + 1 and found.exceptAll(counts).isEmpty()


def test_genome_on_a_later_line(spark, tmp_path):
    assert readers.genome(spark, put(tmp_path, "summary.csv", "Sample,Genome\na,GRCh38\n")) == "hg38"


def test_folders(spark, tmp_path):
    for sub in ("outs/binned_outputs/square_016um/spatial", "outs/binned_outputs/square_008um/spatial"):
        (tmp_path / sub).mkdir(parents=True)
        put(tmp_path / sub, "tissue_positions.csv", f"barcode,in_tissue,pxl_row_in_fullres,pxl_col_in_fullres\n{sub.split('_')[-1][:3]},1,2,3\nz,0,1,1\n")
    assert [tuple(r) for r in folders.visium_hd(spark, str(tmp_path)).cells.collect()] == [("008", 3.0, 2.0)]
    with pytest.raises(FileNotFoundError):
        folders.xenium(spark, str(tmp_path))
    one = folders.Layout("xenium")
    with pytest.raises(ValueError, match="1 samples"):
        folders.integrated({"a": one})
    with pytest.raises(ValueError, match="one kind"):
        folders.integrated({"a": one, "b": folders.Layout("atac")})


@pytest.fixture
def data(spark):
    counts = spark.createDataFrame([(f, c, float((f * 7 + c * 3) % 5)) for f in range(6) for c in range(12) if (f * 7 + c * 3) % 5], "feature_id long, cell_id long, value double")
    cells = spark.range(12).select(F.col("id").alias("cell_id"), (F.col("id") % 3).cast("int").alias("cluster"), F.concat(F.lit("L"), (F.col("id") % 3).cast("string")).alias("label"), (F.col("id") % 2).cast("int").alias("sample"))
    features = spark.range(6).select(F.col("id").alias("feature_id"), F.concat(F.lit("Gene"), F.col("id").cast("string")).alias("name"))
    emb = spark.createDataFrame([(i, [float(i % 3), float(i % 3 == 1), i / 50]) for i in range(12)], "cell_id long, vec array<double>")
    return commands.Dataset(counts, cells, features, emb)


def test_commands(data):
    run = commands.run
    assert run(data, "plot_gene_expression", gene="gene3").count() == 12
    assert run(data, "plot_gene_violin", gene="GENE3").count() == 3
    assert set(run(data, "find_markers", cluster=0).columns) >= {"p_val", "pct1", "p_val_adj"}
    assert run(data, "cluster_info", cluster=0).first().n_cells == 4
    assert run(data, "list_dataset_items", kind="genes", offset=2, limit=3).count() == 3
    assert run(data, "highlight_cluster", cluster="l1").where("highlighted").count() == 4
    assert run(data, "rename_cluster", old="L1", new="L0").select("cluster").distinct().count() == 2
    assert run(commands.update(data, n_neighbors=3), "cluster_and_visualize").count() == 12
    assert run(data, "show_parameters", step="qc").count() == 3
    with pytest.raises(ValueError, match="needs gene"):
        run(data, "plot_gene_expression")
    with pytest.raises(KeyError):
        run(data, "make_coffee")


def test_stream_equals_batch(spark, tmp_path, rows):
    events = spark.createDataFrame([(i, f"2024-01-01 0{i % 5}:00:00", i % 3, "click") for i in range(30)], "event_id long, t string, user_id long, event_type string").select("event_id", F.col("t").cast("timestamp").alias("ts"), "user_id", "event_type")
    folder = f"file://{tmp_path}/events"
    events.write.parquet(folder)
    stream = coverage.windowed_counts(coverage.stream_table(spark, folder, events.schema))
    query = stream.writeStream.format("memory").queryName("live").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert progress.progress(spark, query).agg({"rows": "sum"}).first()[0] == 30
    assert rows(spark.table("live")) == rows(coverage.windowed_counts(events))
