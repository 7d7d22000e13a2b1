"""Summaries by cluster: QC, dot plots, violins, composition, listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def qc_metrics(counts: DataFrame, cells: DataFrame, is_mito: Column) -> DataFrame:
    """n_features, total and mito_pct of every cell; zeros for cells without entries."""
    sums = counts.groupBy("cell_id").agg(F.count_if(F.col("value") > 0).alias("n_features"), F.sum("value").alias("total"), F.sum(F.when(is_mito, F.col("value")).otherwise(0.0)).alias("mito"))
    pct = F.coalesce(100 * F.try_divide(F.col("mito"), F.col("total")), F.lit(0.0))
    return cells.select("cell_id").join(sums, "cell_id", "left").select("cell_id", F.coalesce("n_features", F.lit(0)).cast("long").alias("n_features"), F.coalesce("total", F.lit(0.0)).alias("total"), pct.alias("mito_pct"))


def qc_filter(metrics: DataFrame, min_features: int, min_total: float, max_mito_pct: float) -> DataFrame:
    return metrics.where((F.col("n_features") >= min_features) & (F.col("total") >= min_total) & (F.col("mito_pct") <= max_mito_pct))


def histogram(values: DataFrame, col: str, bins: int = 30, clip: float = 0.95) -> DataFrame:
    """bin (from 0), n: equal bins from 0 to the value at place floor(clip * n) of the sorted values, which clips.

    Values are counted before they are ranked, so the window sees distinct values only."""
    by_value = values.groupBy(F.col(col).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    up = Window.orderBy("v")
    ranked = by_value.withColumns({"upto": F.sum("n").over(up), "all": F.sum("n").over(Window.partitionBy())})
    top = ranked.where(F.col("upto") > F.floor(F.col("all") * clip)).agg(F.min("v").alias("top"))
    step = by_value.join(F.broadcast(top), F.lit(True)).withColumn("w", F.col("top") / bins)
    bin_ = F.least(F.floor(F.coalesce(F.try_divide(F.least("v", "top"), F.col("w")), F.lit(0.0))), F.lit(bins - 1)).cast("int")
    return step.groupBy(bin_.alias("bin")).agg(F.sum("n").alias("n"))


def dot_plot(counts: DataFrame, cells: DataFrame, group: str) -> DataFrame:
    """group, feature_id, n_cells, pct (share of cells expressing) and avg (mean over expressing cells)."""
    sizes = cells.groupBy(group).agg(F.count(F.lit(1)).alias("n_cells"))
    sums = counts.where(F.col("value") > 0).join(cells.select("cell_id", group), "cell_id").groupBy(group, "feature_id").agg(F.count(F.lit(1)).alias("n_expr"), F.sum("value").alias("s"))
    return sums.join(sizes, group).select(group, "feature_id", "n_cells", (F.col("n_expr") / F.col("n_cells")).alias("pct"), (F.col("s") / F.col("n_expr")).alias("avg"))


def dot_plot_merge(stats: DataFrame, group: str, whole_cells: bool = False) -> DataFrame:
    """Dot plots of parts merged by group: averages weigh by expressing cells (whole numbers of them if whole_cells)."""
    detected = F.col("pct") * F.col("n_cells")
    detected = F.floor(detected + 0.5).cast("double") if whole_cells else detected
    sums = stats.groupBy(group, "feature_id").agg(F.sum("n_cells").alias("n_cells"), F.sum(detected).alias("d"), F.sum(detected * F.col("avg")).alias("w"))
    return sums.select(group, "feature_id", "n_cells", F.coalesce(F.try_divide(F.col("d"), F.col("n_cells")), F.lit(0.0)).alias("pct"), F.coalesce(F.try_divide(F.col("w"), F.col("d")), F.lit(0.0)).alias("avg"))


def dot_plot_scaled(stats: DataFrame, clamp: float = 4.0) -> DataFrame:
    """avg as a z-score across a feature's groups (divisor n - 1; no spread counts as 1), clamped."""
    own = Window.partitionBy("feature_id")
    sd = F.stddev_samp("avg").over(own)
    z = (F.col("avg") - F.avg("avg").over(own)) / F.when(sd.isNull() | (sd < 1e-12), F.lit(1.0)).otherwise(sd)
    return stats.withColumn("scaled", F.greatest(F.lit(-clamp), F.least(F.lit(clamp), z)))


def _counted(values: DataFrame, group: str, col: str) -> DataFrame:
    """group, v, t (rows of that value), last (rows up to it) and n (all): a window sees distinct values, not rows."""
    tied = values.groupBy(group, F.col(col).alias("v")).agg(F.count(F.lit(1)).alias("t"))
    own = Window.partitionBy(group)
    return tied.withColumns({"last": F.sum("t").over(own.orderBy("v")), "n": F.sum("t").over(own)})


def _at(place: Column) -> Column:
    """The value at a place from 0 of the sorted rows, as an aggregate over _counted rows."""
    return F.max(F.when((place < F.col("last")) & (place >= F.col("last") - F.col("t")), F.col("v")))


def violin(values: DataFrame, group: str, col: str) -> DataFrame:
    """n, min, max, mean and linearly interpolated quartiles by group, of finite values."""
    sound = values.where(F.col(col).isNotNull() & ~F.isnan(col) & (F.abs(col) != F.lit(float("inf"))))
    spots = {f"{name}{side}": _at(f((F.col("n") - 1) * q)) for name, q in (("a", 0.25), ("b", 0.5), ("c", 0.75)) for side, f in (("0", F.floor), ("1", F.ceil))}
    found = _counted(sound, group, col).groupBy(group).agg(
        F.max("n").alias("n"), F.min("v").alias("min"), F.max("v").alias("max"), (F.sum(F.col("v") * F.col("t")) / F.max("n")).alias("mean"), *[x.alias(k) for k, x in spots.items()]
    )
    between = lambda name, q: F.col(f"{name}0") + (F.col(f"{name}1") - F.col(f"{name}0")) * ((F.col("n") - 1) * q - F.floor((F.col("n") - 1) * q))
    return found.select(group, "n", "min", "max", "mean", between("a", 0.25).alias("q1"), between("b", 0.5).alias("median"), between("c", 0.75).alias("q3"))


def violin_ranked(values: DataFrame, group: str, col: str) -> DataFrame:
    """Quartiles as the sorted values at places floor(n q); the median averages the two middle values."""
    n = F.col("n")
    rows = _counted(values.where(F.col(col).isNotNull()), group, col)
    return rows.groupBy(group).agg(F.max("n").alias("n"), _at(F.floor(n * 0.25)).alias("q1"), ((_at(F.floor((n - 1) / 2)) + _at(F.floor(n / 2))) / 2).alias("median"), _at(F.floor(n * 0.75)).alias("q3"))


def density(values: DataFrame, group: str, col: str, steps: int = 30, least_width: float = 0.1) -> DataFrame:
    """Epanechnikov density of each group on steps + 1 places of its range; the width is the range over steps.

    Each value only meets the grid places within its reach, so rows grow with the values, not with the grid."""
    stats = values.groupBy(group).agg(F.min(col).alias("lo"), F.max(col).alias("hi"), F.count(F.lit(1)).alias("n"))
    stats = stats.withColumn("bw", F.greatest((F.col("hi") - F.col("lo")) / steps, F.lit(least_width))).withColumn("dx", (F.col("hi") - F.col("lo")) / steps)
    grid = stats.select(group, "lo", "dx", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("step"))
    v = values.select(group, F.col(col).alias("v")).join(stats, group)
    first, last = F.ceil((F.col("v") - F.col("bw") - F.col("lo")) / F.col("dx")), F.floor((F.col("v") + F.col("bw") - F.col("lo")) / F.col("dx"))
    near = F.when(F.col("dx") > 0, F.sequence(F.greatest(first - 1, F.lit(0)).cast("int"), F.least(last + 1, F.lit(steps)).cast("int"))).otherwise(F.sequence(F.lit(0), F.lit(steps)))
    u = (F.col("lo") + F.col("step") * F.col("dx") - F.col("v")) / F.col("bw")
    kernel = v.select(group, "v", "lo", "dx", "bw", "n", F.explode(near).alias("step")).where(F.abs(u) <= 1).groupBy(group, "step").agg(F.sum(0.75 * (1 - u * u) / (F.col("n") * F.col("bw"))).alias("density"))
    return grid.join(kernel, [group, "step"], "left").select(group, "step", (F.col("lo") + F.col("step") * F.col("dx")).alias("x"), F.coalesce("density", F.lit(0.0)).alias("density"))


def composition(cells: DataFrame, outer: str, inner: str) -> DataFrame:
    """n and fraction of each inner group within its outer group."""
    n = cells.groupBy(outer, inner).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("fraction", F.col("n") / F.sum("n").over(Window.partitionBy(outer)))


def cluster_info(cells: DataFrame, group: str = "cluster") -> DataFrame:
    n = cells.groupBy(group).agg(F.count(F.lit(1)).alias("n_cells"))
    return n.withColumn("total_cells", F.sum("n_cells").over(Window.partitionBy())).withColumn("fraction", F.col("n_cells") / F.col("total_cells"))


def merge_clusters(cells: DataFrame, renames: dict[str, str], label: str = "label") -> DataFrame:
    """Labels renamed; clusters whose labels then coincide become the one of smallest id."""
    expr = F.col(label)
    for old, new in renames.items():
        expr = F.when(F.col(label) == old, F.lit(new)).otherwise(expr)
    named = cells.withColumn(label, expr)
    return named.withColumn("cluster", F.min("cluster").over(Window.partitionBy(label)))


def annotate(cells: DataFrame, labels: DataFrame) -> DataFrame:
    """cells with their cluster's label of labels(cluster, name), else their own label, else the cluster id."""
    return cells.join(labels, "cluster", "left").withColumn("annotation", F.coalesce("name", "label", F.col("cluster").cast("string"))).drop("name")


def page(items: DataFrame, order: str, offset: int, limit: int, most: int = 100) -> DataFrame:
    return items.orderBy(order).offset(offset).limit(min(limit, most))


def volcano(markers: DataFrame, n: int = 10) -> DataFrame:
    """The n highest and n lowest by avg_logFC, with y = -log10 of the p value (0 for p <= 0, floor 1e-320)."""
    y = F.when(F.col("p_val") <= 0, F.lit(0.0)).otherwise(-F.log10(F.greatest("p_val", F.lit(1e-320))))
    rows = markers.withColumn("y", y)
    high = rows.orderBy(F.desc("avg_logFC"), "feature_id").limit(n).withColumn("side", F.lit("up"))
    low = rows.orderBy("avg_logFC", "feature_id").limit(n).withColumn("side", F.lit("down"))
    return high.unionByName(low)


def strength_matrix(interactions: DataFrame) -> DataFrame:
    """Summed probability by source and target, with the sources' and targets' totals over in and out."""
    pairs = interactions.groupBy("source", "target").agg(F.sum("probability").alias("strength"))
    ends = pairs.select(F.explode(F.array("source", "target")).alias("node"), "strength").groupBy("node").agg(F.sum("strength").alias("total"))
    out = pairs.join(ends.select(F.col("node").alias("source"), F.col("total").alias("source_total")), "source")
    return out.join(ends.select(F.col("node").alias("target"), F.col("total").alias("target_total")), "target").select("source", "target", "strength", "source_total", "target_total")
