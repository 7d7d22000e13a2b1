"""Count-matrix operators on counts(feature_id, cell_id, value): sums, filters, feature selection, normalisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def axis_sums(counts: DataFrame, axis: str, dimension: DataFrame | None = None) -> DataFrame:
    """Total and stored entries by cell_id or feature_id; ids of the dimension without entries get zeros."""
    sums = counts.groupBy(axis).agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("nnz"))
    if dimension is None:
        return sums
    full = dimension.select(axis).join(sums, axis, "left")
    return full.select(axis, F.coalesce("total", F.lit(0.0)).alias("total"), F.coalesce("nnz", F.lit(0)).cast("long").alias("nnz"))


def filter_axis_min_entries(counts: DataFrame, axis: str, least: int) -> DataFrame:
    """Ids of the axis with at least so many stored entries (explicit zeros count)."""
    return counts.groupBy(axis).agg(F.count(F.lit(1)).alias("nnz")).where(F.col("nnz") >= least)


def top_features(counts: DataFrame, features: DataFrame, cutoff: float) -> DataFrame:
    """Features whose share of row sums at most their own exceeds the cutoff: feature_id, total, percentile.

    The ranking runs over distinct totals, each with its number of features, not over the features."""
    sums = axis_sums(counts, "feature_id", features)
    totals = sums.groupBy("total").agg(F.count(F.lit(1)).alias("n"))
    every = Window.orderBy("total")
    whole = Window.partitionBy()
    ranked = totals.select("total", (F.sum("n").over(every) / F.sum("n").over(whole)).alias("percentile"))
    return sums.join(ranked, "total").where(F.col("percentile") > cutoff).select("feature_id", "total", "percentile")


def tfidf(counts: DataFrame, n_cells: int, method: int = 1, scale: float = 1e4) -> DataFrame:
    """Term frequency by cell times inverse frequency by feature, in four variants; value is replaced.

    With v the count, c its cell's and r its feature's total and N the number of cells:
    1 ln(1 + v/c * N/r * scale); 2 v/c * ln(1 + N/r); 3 ln(1 + v/c * scale) * ln(1 + N/r); 4 N/r. Zero totals give 0."""
    by_cell = counts.groupBy("cell_id").agg(F.sum("value").alias("c"))
    by_feature = counts.groupBy("feature_id").agg(F.sum("value").alias("r"))
    rows = counts.join(by_cell, "cell_id").join(by_feature, "feature_id")
    tf, idf = F.col("value") / F.col("c"), F.lit(float(n_cells)) / F.col("r")
    made = {1: F.ln(1 + tf * idf * scale), 2: tf * F.ln(1 + idf), 3: F.ln(1 + tf * scale) * F.ln(1 + idf), 4: idf}[method]
    return rows.select("feature_id", "cell_id", F.when((F.col("c") == 0) | (F.col("r") == 0), F.lit(0.0)).otherwise(F.nanvl(made, F.lit(0.0))).alias("value"))


def log_normalize(counts: DataFrame, scale: float = 1e4) -> DataFrame:
    """ln(1 + value * scale / cell total); 0 where the total is 0."""
    by_cell = counts.groupBy("cell_id").agg(F.sum("value").alias("c"))
    value = F.when(F.col("c") == 0, F.lit(0.0)).otherwise(F.ln(1 + F.col("value") * scale / F.col("c")))
    return counts.join(by_cell, "cell_id").select("feature_id", "cell_id", value.alias("value"))


def dispersion(counts: DataFrame, n_cells: int) -> DataFrame:
    """feature_id, mean, variance (population, zeros included) and dispersion of every feature with entries."""
    sums = counts.groupBy("feature_id").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss"))
    mean = F.col("s") / n_cells
    rows = sums.select("feature_id", mean.alias("mean"), (F.col("ss") / n_cells - mean * mean).alias("variance"))
    return rows.withColumn("dispersion", F.when(F.col("mean") > 1e-12, F.col("variance") / F.col("mean")).otherwise(F.col("variance")))


def highly_variable(counts: DataFrame, n_cells: int, n_top: int, digits: int = 9) -> DataFrame:
    """The n_top features of largest dispersion (compared at so many digits), ties to the smaller id."""
    return dispersion(counts, n_cells).orderBy(F.desc(F.round("dispersion", digits)), "feature_id").limit(n_top)


def memory_capped_top(n_top: int, nnz: int, most: int = 300_000_000, least: int = 50) -> int:
    """How many variable features to keep when their entries would exceed most."""
    return n_top if nnz <= most else max(least, n_top * most // nnz)


def feature_vector(counts: DataFrame, cells: DataFrame, feature_id: int) -> DataFrame:
    """One feature over all cells, zeros filled in."""
    own = counts.where(F.col("feature_id") == feature_id).select("cell_id", "value")
    return cells.select("cell_id").join(own, "cell_id", "left").select("cell_id", F.coalesce("value", F.lit(0.0)).alias("value"))


def subset(counts: DataFrame, axis: str, order: DataFrame) -> DataFrame:
    """The entries whose id is in order(id, new_id), re-numbered as given."""
    kept = counts.join(order, counts[axis] == order["id"])
    other = "cell_id" if axis == "feature_id" else "feature_id"
    return kept.select(F.col("new_id").alias(axis), other, "value")


def concat_cells(parts: list[tuple]) -> DataFrame:
    """Matrices of the same features side by side: (counts, number of cells) of each; cells are offset in turn.

    Parts that say their number of features, (counts, number of cells, number of features), must agree in it."""
    if len({p[2] for p in parts if len(p) > 2}) > 1:
        raise ValueError("matrices of different features can't be set side by side")
    out, offset = None, 0
    for counts, n_cells, *_ in parts:
        moved = counts.select("feature_id", (F.col("cell_id") + offset).alias("cell_id"), "value")
        out = moved if out is None else out.unionByName(moved)
        offset += n_cells
    return out


def wide_to_long(wide: DataFrame, id_col: str, prefixes_dropped: tuple[str, ...] = ("NegPrb",)) -> DataFrame:
    """A column for each feature to (id, feature, value) rows of positive values; control features are dropped."""
    names = [c for c in wide.columns if c != id_col and not c.startswith(prefixes_dropped)]
    cast = wide.select(id_col, *[F.col(c).cast("double").alias(c) for c in names])
    return cast.unpivot([id_col], names, "feature", "value").where(F.col("value") > 0)


def remap(counts: DataFrame, mapping: DataFrame) -> DataFrame:
    """Values summed by the new feature of mapping(feature_id, new_id); unmapped features go."""
    joined = counts.join(mapping.where("new_id is not null"), "feature_id")
    return joined.groupBy(F.col("new_id").alias("feature_id"), "cell_id").agg(F.sum("value").alias("value"))


def times_dense(counts: DataFrame, dense: DataFrame, axis: str, on: str) -> DataFrame:
    """The product with a dense matrix dense(on, k, weight): (axis, k, value)."""
    joined = counts.join(dense, on)
    return joined.groupBy(axis, "k").agg(F.sum(F.col("value") * F.col("weight")).alias("value"))


def streaming_pipeline(counts: DataFrame, n_top: int = 2000, min_features: int = 200, scale: float = 1e4) -> DataFrame:
    """Cells of enough features, the most variable features of their raw counts, then their log-normalised values."""
    kept = filter_axis_min_entries(counts, "cell_id", min_features).select("cell_id")
    rows = counts.join(kept, "cell_id", "left_semi")
    top = highly_variable(rows, kept.count(), n_top).select("feature_id")
    return log_normalize(rows, scale).join(top, "feature_id", "left_semi")
