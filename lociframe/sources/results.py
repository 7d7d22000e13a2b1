"""Writers: saved analyses, matrix files, annotation exports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import SIZE_COMMENT

VERSION = 1


def _nested(df: DataFrame, name: str) -> bool:
    """Whether nulls may hide inside a column's values."""
    return df.schema[name].dataType.typeName() in ("array", "map", "struct")


def content_hash(df: DataFrame) -> str:
    """A hash of the rows, the names and types of their columns, that does not depend on the order of either. Spark's hashes pass
    over nulls, so which columns are null is hashed too."""
    cols = sorted(df.columns)
    shape = F.lit(str([(c, df.schema[c].dataType.simpleString()) for c in cols]))
    values = [shape, F.array(*[F.col(c).isNull() for c in cols]), *[F.to_json(F.struct(c)) if _nested(df, c) else F.col(c) for c in cols]]
    found = df.select(F.xxhash64(*values).alias("a"), F.xxhash64(F.lit(1), *values).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("a").cast("decimal(38,0)")).alias("a"), F.sum(F.col("b").cast("decimal(38,0)")).alias("b")).first()
    return f"{found.n}-{found.a}-{found.b}"


def _manifest_rows(spark: SparkSession, path: str) -> dict:
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return {}
    return json.loads("".join(r.value for r in spark.read.text(f"{path}/manifest").collect()))


def save(spark: SparkSession, path: str, tables: dict[str, DataFrame], settings: dict | None = None) -> list[str]:
    """Write an analysis' tables as Parquet with a JSON manifest; tables whose content is unchanged are left. Returns those written."""
    before = _manifest_rows(spark, path).get("tables", {})
    hashes = {name: content_hash(df) for name, df in tables.items()}
    written = [name for name in tables if before.get(name) != hashes[name]]
    for name in written:
        tables[name].write.mode("overwrite").parquet(f"{path}/{name}")
    manifest = json.dumps({"version": VERSION, "tables": {**before, **hashes}, "settings": settings or {}})
    spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return written


def load(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict] | None:
    """The saved tables and settings, or None where there is no analysis of this version."""
    manifest = _manifest_rows(spark, path)
    if manifest.get("version") != VERSION:
        return None
    return {name: spark.read.parquet(f"{path}/{name}") for name in manifest["tables"]}, manifest["settings"]


def write_matrix_market(counts: DataFrame, n_features: int, n_cells: int, path: str) -> None:
    """A folder of gzipped parts; entries number from 1. As no part is the first, a comment repeats the size line."""
    size = f"{n_features} {n_cells} {counts.count()}"
    head = counts.sparkSession.createDataFrame([(f"%%MatrixMarket matrix coordinate real general\n{SIZE_COMMENT}{size}\n{size}",)], "line string")
    value = F.regexp_replace(F.col("value").cast("string"), r"\.0$", "")
    rows = counts.select(F.concat_ws(" ", (F.col("feature_id") + 1).cast("string"), (F.col("cell_id") + 1).cast("string"), value).alias("line"))
    head.coalesce(1).unionByName(rows).write.option("compression", "gzip").text(path)


def write_names(names: DataFrame, path: str) -> None:
    names.select(F.concat_ws("\t", "id", "name", F.lit("Gene Expression"))).write.option("compression", "gzip").text(path)


def export_annotations(cells: DataFrame, path: str) -> None:
    cells.write.option("header", True).csv(path)


def cached(spark: SparkSession, source: str, path: str, build) -> DataFrame:
    """build()'s rows, kept as Parquet at path while the source's size and time stay the same."""
    place = spark._jvm.org.apache.hadoop.fs.Path(source)
    status = place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place)
    key = f"{status.getLen()}-{status.getModificationTime()}"
    if _manifest_rows(spark, path).get("settings", {}).get("key") == key:
        return spark.read.parquet(f"{path}/rows")
    save(spark, path, {"rows": build()}, {"key": key})
    return spark.read.parquet(f"{path}/rows")
