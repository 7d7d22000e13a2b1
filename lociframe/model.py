"""The data model: long count tables, dimensions, embeddings, fragments and points, and their bindings to the
star-schema tables that serve as test inputs.

counts(feature_id, cell_id, value): an absent row is 0, so every statistic over cells divides by the number
of rows of the cell dimension, never by count(value).
"""

from __future__ import annotations

import math
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: By application: its folder for stored tables, in local mode without spark.checkpoint.dir.
_LOCAL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(x: Column, digits: int = 6) -> Column:
    """round() without negative zeros, for results that are compared across engines."""
    return F.round(x, digits) + F.lit(0.0)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir, deleted when the driver's JVM ends.

    Where that is unset, a temporary folder serves a driver that runs its tasks itself; on a cluster it is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or _LOCAL.get(spark.sparkContext.applicationId)
    if not where:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = _LOCAL[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="lociframe-")
    path = f"{where}/{name}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def materialized(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again, to cut the lineage of iterations.

    What was shuffled for it is deleted as soon as it is written: Spark otherwise keeps that until the driver collects its garbage."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def ranged(rows: DataFrame, *keys: str) -> DataFrame:
    """rows, stored, dealt out by ranges of keys, with __part, the number of the range: what a window over all rows would
    need one task for takes a window within each range and one over a row for each range."""
    return materialized(rows.repartitionByRange(*keys).withColumn("__part", F.spark_partition_id()), "ranged")


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by suppliers, valued by the quantity sold."""
    items = table(spark, sf_dir, "lineitem")
    return items.groupBy(F.col("l_partkey").alias("feature_id"), F.col("l_suppkey").alias("cell_id")).agg(F.sum("l_quantity").alias("value"))


def sparse_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by customers, through orders."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    joined = items.join(orders, items.l_orderkey == orders.o_orderkey)
    return joined.groupBy(F.col("l_partkey").alias("feature_id"), F.col("o_custkey").alias("cell_id")).agg(F.sum("l_quantity").alias("value"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell_id, cluster, label, sample of every supplier."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    found = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return found.select(F.col("s_suppkey").alias("cell_id"), F.col("s_nationkey").alias("cluster"), F.col("n_name").alias("label"), F.col("n_regionkey").alias("sample"))


def sparse_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell_id, cluster, label, sample of every customer."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    found = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return found.select(F.col("c_custkey").alias("cell_id"), F.col("c_nationkey").alias("cluster"), F.col("n_name").alias("label"), F.col("n_regionkey").alias("sample"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("feature_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("collection"))


def embedding(spark: SparkSession, sf_dir: str, first: int = 1, size: int | None = None) -> DataFrame:
    """cell_id, vec (double array, or a slice of it from the 1-based place first), cluster."""
    vec = F.col("embedding").cast("array<double>")
    vec = vec if size is None else F.slice(vec, first, size)
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("cell_id"), vec.alias("vec"), F.col("label").alias("cluster"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding").cast("array<double>")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), e[0].alias("x"), e[1].alias("y"), F.col("label").alias("cluster"))


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chrom, start, end, barcode, count from events: second 0 is 2024-01-01."""
    start = F.unix_timestamp(F.col("ts").cast("timestamp")) - 1704067200
    rows = table(spark, sf_dir, "events").select(F.concat(F.lit("chr"), (F.col("user_id") % 5).cast("string")).alias("chrom"), start.alias("start"), F.col("user_id").alias("barcode"))
    return rows.select("chrom", "start", (F.col("start") + 200).alias("end"), "barcode", F.lit(1).cast("long").alias("count"))


def fragment_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("barcode")).distinct().withColumn("cluster", (F.col("barcode") % 7).cast("int"))


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """peak_id, chr, start, end from orders: days since 1992-01-01 in hundreds."""
    start = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("long") * 100
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("peak_id"), F.concat(F.lit("chr"), (F.col("o_custkey") % 22 + 1).cast("string")).alias("chr"), start.alias("start"))
    return rows.withColumn("end", F.col("start") + F.col("peak_id") % 300)


def tss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gene, chr, tss of every part."""
    rows = table(spark, sf_dir, "part")
    return rows.select(F.col("p_partkey").alias("gene"), F.concat(F.lit("chr"), (F.col("p_size") % 22 + 1).cast("string")).alias("chr"), (F.col("p_partkey") * 37 % 240000).alias("tss"))


def blocks_of(n: int, size: int) -> int:
    return max(1, math.ceil(n / size))
