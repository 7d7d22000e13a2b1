import math

import pytest
from pyspark.sql import functions as F

from lociframe.operators import matrix, summaries

C = "feature_id long, cell_id long, value double"


@pytest.fixture
def counts(spark):
    return spark.createDataFrame([(0, 0, 2.0), (1, 0, 2.0), (1, 1, 3.0), (2, 2, 5.0)], C)


@pytest.fixture
def features(spark):
    return spark.range(3).withColumnRenamed("id", "feature_id")


@pytest.fixture
def cells(spark):
    return spark.range(3).withColumnRenamed("id", "cell_id")


def test_sums(counts, cells, features, rows):
    assert rows(matrix.axis_sums(counts, "cell_id", cells)) == [(0, 4.0, 2), (1, 3.0, 1), (2, 5.0, 1)]
    assert rows(matrix.axis_sums(counts, "feature_id", features)) == [(0, 2.0, 1), (1, 5.0, 2), (2, 5.0, 1)]


def test_dimension_fills_zeros(spark, counts, rows):
    more = spark.range(4).withColumnRenamed("id", "cell_id")
    assert (3, 0.0, 0) in rows(matrix.axis_sums(counts, "cell_id", more))


def test_tfidf(counts):
    get = lambda m: {(r.feature_id, r.cell_id): r.value for r in matrix.tfidf(counts, 3, m).collect()}
    assert get(4) == {(0, 0): 1.5, (1, 0): 0.6, (1, 1): 0.6, (2, 2): 0.6}
    assert get(1)[0, 0] == pytest.approx(math.log(7501))
    assert get(2)[1, 1] == pytest.approx(math.log(1 + 3 / 5))
    assert get(3)[1, 1] == pytest.approx(math.log(10001) * math.log(1.6))


def test_scaling_a_cell_leaves_normalised_values(counts, rows):
    scaled = counts.withColumn("value", F.when(F.col("cell_id") == 0, F.col("value") * 8).otherwise(F.col("value")))
    assert rows(matrix.log_normalize(counts)) == rows(matrix.log_normalize(scaled))
    value = {(r.feature_id, r.cell_id): r.value for r in matrix.log_normalize(counts).collect()}
    assert value[1, 1] == pytest.approx(math.log(10001))


def test_top_features(counts, features, rows):
    assert [r[0] for r in rows(matrix.top_features(counts, features, 0.4))] == [1, 2]


def test_dispersion(counts):
    found = {r.feature_id: r for r in matrix.dispersion(counts, 3).collect()}[1]
    assert (found.mean, found.variance, found.dispersion) == pytest.approx((5 / 3, 14 / 9, 14 / 15))


def test_memory_cap():
    assert matrix.memory_capped_top(2000, 10) == 2000
    assert matrix.memory_capped_top(2000, 600_000_000) == 1000
    assert matrix.memory_capped_top(60, 10**12) == 50


def test_subset_and_concat(spark, counts, rows):
    order = spark.createDataFrame([(2, 0), (1, 1)], "id long, new_id long")
    assert rows(matrix.subset(counts, "feature_id", order)) == [(0, 2, 5.0), (1, 0, 2.0), (1, 1, 3.0)]
    assert (2, 5, 5.0) in rows(matrix.concat_cells([(counts, 3), (counts, 3)]))


def test_wide_to_long(spark, rows):
    wide = spark.createDataFrame([(1, 2, 0, 9)], "cell int, a int, b int, NegPrb1 int")
    assert rows(matrix.wide_to_long(wide, "cell")) == [(1, "a", 2.0)]


def test_remap_drops_unmapped(spark, counts, rows):
    mapping = spark.createDataFrame([(0, 9), (1, 9), (2, None)], "feature_id long, new_id long")
    assert rows(matrix.remap(counts, mapping)) == [(9, 0, 4.0), (9, 1, 3.0)]


def test_dot_plot(spark, rows):
    counts = spark.createDataFrame([(0, 2, 2.0), (0, 3, 4.0)], C)
    cells = spark.createDataFrame([(i, "a") for i in range(4)], "cell_id long, cluster string")
    assert rows(summaries.dot_plot(counts, cells, "cluster")) == [("a", 0, 4, 0.5, 3.0)]
    parts = spark.createDataFrame([("a", 0, 4, 0.5, 3.0), ("a", 0, 6, 1.0, 1.0)], "g string, feature_id int, n_cells int, pct double, avg double")
    assert rows(summaries.dot_plot_merge(parts, "g")) == [("a", 0, 10, 0.8, 1.5)]


def test_violin_leaves_out_what_is_not_finite(spark, rows):
    values = spark.createDataFrame([("a", float(i)) for i in range(1, 6)] + [("a", float("nan")), ("a", None), ("a", float("inf"))], "g string, v double")
    assert rows(summaries.violin(values, "g", "v")) == [("a", 5, 1.0, 5.0, 3.0, 2.0, 3.0, 4.0)]


def test_density_integrates_to_one(spark):
    values = spark.createDataFrame([("a", i / 10) for i in range(1000)], "g string, v double")
    found = summaries.density(values, "g", "v").orderBy("step").collect()
    step = found[1].x - found[0].x
    assert sum(r.density for r in found) * step == pytest.approx(1, abs=0.05)


def test_permuting_rows_changes_nothing(counts, features, rows):
    assert rows(matrix.top_features(counts.orderBy(F.rand(1)), features, 0.1)) == rows(matrix.top_features(counts, features, 0.1))


def test_empty_counts(spark, cells, features, rows):
    none = spark.createDataFrame([], C)
    assert rows(matrix.tfidf(none, 3)) == []
    assert rows(matrix.axis_sums(none, "cell_id", cells)) == [(0, 0.0, 0), (1, 0.0, 0), (2, 0.0, 0)]


def test_stored_tables_leave_no_shuffle(spark):
    from lociframe import model

    held = lambda: spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()
    before, was = held(), spark.conf.get(model.SHUFFLE_CLEANUP, None)
    stored = model.materialized(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "grouped")
    assert held() <= before and spark.conf.get(model.SHUFFLE_CLEANUP, None) == was
    assert sorted(stored.collect()) == [(k, 143 if k < 6 else 142) for k in range(7)]
