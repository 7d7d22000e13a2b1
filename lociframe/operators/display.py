"""What results look like when they are shown: ranges, guards, orders, completion, pages and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ends of an empty range are this far apart.
LEAST_SPAN = 1e-6


def display_range(values: DataFrame, col: str, low: float | None = None, high: float | None = None, whole: DataFrame | None = None) -> DataFrame:
    """One row, low and high: the ends that are given, else those of the whole data's values, else those of the values shown."""
    ends = lambda rows: rows.agg(F.min(col).alias("low"), F.max(col).alias("high"))
    out = ends(values)
    if whole is not None:  # one row each
        out = out.join(F.broadcast(ends(whole).select(F.col("low").alias("l"), F.col("high").alias("h"))), F.lit(True)).select(F.coalesce("l", "low").alias("low"), F.coalesce("h", "high").alias("high"))
    out = out.select(F.coalesce(F.lit(low).cast("double"), "low").alias("low"), F.coalesce(F.lit(high).cast("double"), "high").alias("high"))
    return out.withColumn("high", F.when(F.col("low") == F.col("high"), F.col("low") + LEAST_SPAN).otherwise(F.col("high")))


def violin_guards(values: DataFrame, group: str, col: str, least: float = 0.2) -> DataFrame:
    """group, n, nonzero (fraction), drawn (enough of it), width (max(.4, sqrt(n / the largest n)))."""
    rows = values.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(col) != 0).cast("double")).alias("nonzero"))
    most = F.max("n").over(Window.partitionBy())  # over a row for each group
    return rows.select(group, "n", "nonzero", (F.col("nonzero") >= least).alias("drawn"), F.greatest(F.lit(0.4), F.sqrt(F.col("n") / most)).alias("width"))


def complete_coverage(signal: DataFrame, groups: DataFrame, samples: DataFrame, n_bins: int) -> DataFrame:
    """sample, cluster, bin, value, n_cells of every sample and cluster: signal(sample, cluster, bin, value) filled up with
    zeros, and groups(sample, cluster, n_cells) with none where a sample lacks the cluster.

    The grid is samples by clusters by bins: dimensions of the picture, not of the data."""
    pairs = samples.select("sample").distinct().join(F.broadcast(groups.select("cluster").distinct()), F.lit(True))
    grid = pairs.join(groups, ["sample", "cluster"], "left").withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_bins - 1).cast("long"))))
    rows = grid.join(signal, ["sample", "cluster", "bin"], "left")
    return rows.select("sample", "cluster", "bin", F.coalesce("value", F.lit(0.0)).alias("value"), F.coalesce("n_cells", F.lit(0).cast("long")).alias("n_cells"))


def link_order(links: DataFrame, how: str = "score") -> DataFrame:
    """links with place from 1: by score, largest |score| first; for display, smallest p first; for drawing, smallest |score|
    first. Ties by gene and peak."""
    key = {"score": F.desc(F.abs("score")), "display": F.asc("pvalue"), "draw": F.asc(F.abs("score"))}[how]
    return links.withColumn("place", F.row_number().over(Window.orderBy(key, "gene", "peak_id")))  # a region's links


def cluster_order(cluster: Column) -> Column:
    """A key that sorts numbers as numbers, before names, which sort as text."""
    number = cluster.try_cast("double")
    return F.struct(number.isNull().alias("named"), number.alias("number"), cluster.alias("text"))


def track_order(signal: DataFrame, groups: DataFrame, how: str = "id", most: int | None = None) -> DataFrame:
    """cluster, place of the tracks to show: by id, by total signal, or by cells; the largest first, ties by id; most of them."""
    rows = groups.join(signal.groupBy("cluster").agg(F.sum("value").alias("total")), "cluster", "left")
    first = {"id": [], "signal": [F.desc(F.coalesce("total", F.lit(0.0)))], "cells": [F.desc("n_cells")]}[how]
    ordered = rows.select("cluster", F.row_number().over(Window.orderBy(*first, cluster_order(F.col("cluster").cast("string")))).alias("place"))  # a row for each cluster
    return ordered if most is None else ordered.where(F.col("place") <= most)


def top_motifs(motifs: DataFrame, most: int = 25) -> DataFrame:
    """motifs(motif, fold, score) of the largest score, or fold where a motif has none."""
    return motifs.orderBy(F.desc(F.coalesce("score", "fold")), "motif").limit(most)


def interaction_head(interactions: DataFrame, rows: int = 20, routes: int = 12) -> tuple[DataFrame, DataFrame]:
    """The strongest rows, and the strongest routes between groups (source, target, strength)."""
    head = interactions.orderBy(F.desc("probability"), "source", "target", "pair").limit(rows)
    lines = interactions.groupBy("source", "target").agg(F.sum("probability").alias("strength"))
    return head, lines.orderBy(F.desc(F.round("strength", 9)), "source", "target").limit(routes)


def draw_order(values: DataFrame, col: str, id_col: str) -> DataFrame:
    """Rows with the largest value last, so it is drawn over the others."""
    return values.orderBy(F.asc_nulls_first(col), id_col)


def page(items: DataFrame, order: str, offset: int, limit: int, most: int = 100) -> DataFrame:
    """One row: items (their order column's values), total, has_more and next_offset (null on the last page)."""
    size = max(0, min(limit, most))
    shown = items.select(F.col(order).alias("item")).orderBy("item").offset(offset).limit(size)
    rows = shown.agg(F.sort_array(F.collect_list("item")).alias("items"))  # most of them at most
    total = items.agg(F.count(F.lit(1)).alias("total"))
    out = rows.join(F.broadcast(total), F.lit(True)).withColumn("has_more", F.col("total") > offset + size)
    return out.withColumn("next_offset", F.when(F.col("has_more"), F.lit(offset + size)).cast("long"))


def relabel_by_first(labels: DataFrame, id_col: str = "cell_id", label: str = "cluster") -> DataFrame:
    """labels with new_label from 0 in the order in which labels first appear by id."""
    first = labels.groupBy(label).agg(F.min(id_col).alias("__first"))
    numbers = first.select(label, (F.row_number().over(Window.orderBy("__first")) - 1).alias("new_label"))  # a row for each label
    return labels.join(numbers, label).select(*labels.columns, "new_label")


def running_weights(weights: DataFrame, id_col: str, col: str) -> DataFrame:
    """weights with running, their sum up to each row in the order by id; ranges hand their sums to the ones after them."""
    from ..model import ranged

    rows = ranged(weights, id_col)
    parts = rows.groupBy("__part").agg(F.sum(col).alias("__sum"))
    before = parts.select("__part", F.coalesce(F.sum("__sum").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("__before"))
    own = F.sum(col).over(Window.partitionBy("__part").orderBy(id_col))
    return rows.join(F.broadcast(before), "__part").withColumn("running", own + F.col("__before")).drop("__part", "__before")


def common_features(left: DataFrame, right: DataFrame) -> DataFrame:
    """key, left_id, right_id of names that two lists (feature_id, name) share without regard to case; of a list's names that
    then coincide the one of the largest id counts."""
    side = lambda rows, name: rows.groupBy(F.lower("name").alias("key")).agg(F.max("feature_id").alias(name))
    return side(left, "left_id").join(side(right, "right_id"), "key")


def aligned_cells(first: DataFrame, second: DataFrame) -> DataFrame:
    """barcode, first_id, second_id: the same cell in the views of two modalities, each (cell_id, barcode); cells that one
    view lacks are left out."""
    return first.select("barcode", F.col("cell_id").alias("first_id")).join(second.select("barcode", F.col("cell_id").alias("second_id")), "barcode")
