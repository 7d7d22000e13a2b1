"""Spatial operators: tile pyramids, viewports, polygons, affine maps."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Affine = tuple[float, float, float, float, float, float]


def extent(points: DataFrame) -> DataFrame:
    return points.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))


def tiles(points: DataFrame, bounds: tuple[float, float, float, float], levels: int = 8) -> DataFrame:
    """level, tx, ty of every point for levels 0 to levels, 2^level tiles a side; outside points go to the border tiles."""
    x0, x1, y0, y1 = bounds
    n = F.pow(F.lit(2.0), F.col("level"))
    place = lambda v, lo, hi: F.greatest(F.lit(0), F.least(F.floor((v - lo) / max(hi - lo, 1e-300) * n), n - 1)).cast("int")
    rows = points.select("*", F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level"))
    return rows.withColumns({"tx": place(F.col("x"), x0, x1), "ty": place(F.col("y"), y0, y1)})


def pyramid(points: DataFrame, bounds: tuple[float, float, float, float], levels: int = 8) -> DataFrame:
    """level, tx, ty, n and centroid of every tile."""
    return tiles(points, bounds, levels).groupBy("level", "tx", "ty").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("cx"), F.avg("y").alias("cy"))


def tile_sample(points: DataFrame, bounds: tuple[float, float, float, float], levels: int = 8, base: int = 4, growth: float = 1.5, cap: int = 64, seed: int = 1) -> DataFrame:
    """level, tx, ty, id: up to min(round(base growth^level), cap) points of each tile, by a hash of id and seed."""
    most = F.least(F.round(base * F.pow(F.lit(growth), F.col("level"))), F.lit(float(cap)))
    rank = F.row_number().over(Window.partitionBy("level", "tx", "ty").orderBy(F.xxhash64("id", F.lit(seed)), "id"))
    return tiles(points, bounds, levels).withColumn("k", rank).where((F.col("k") <= cap) & (F.col("k") <= most)).select("level", "tx", "ty", "id")


def viewport_level(pyramid_rows: DataFrame, bounds: tuple[float, float, float, float], view: tuple[float, float, float, float], most: int, per_tile: int = 32) -> DataFrame:
    """One row, level and n: the deepest level whose sampled points in tiles that meet the view are at most so many, else the shallowest."""
    x0, x1, y0, y1 = bounds
    vx0, vx1, vy0, vy1 = view
    side = F.pow(F.lit(2.0), F.col("level"))
    left, low = x0 + F.col("tx") * ((x1 - x0) / side), y0 + F.col("ty") * ((y1 - y0) / side)
    meets = (left <= vx1) & (left + (x1 - x0) / side >= vx0) & (low <= vy1) & (low + (y1 - y0) / side >= vy0)
    by_level = pyramid_rows.where(meets).groupBy("level").agg(F.sum(F.least("n", F.lit(per_tile))).alias("n"))
    fits = F.max(F.when(F.col("n") <= most, F.col("level")))
    chosen = by_level.agg(F.coalesce(fits, F.min("level")).alias("level"))
    return by_level.join(F.broadcast(chosen), "level")


def grid_density(points: DataFrame, cell: float, weight: Column) -> DataFrame:
    """gx, gy, weight: summed weights on a grid."""
    return points.groupBy(F.floor(F.col("x") / cell).alias("gx"), F.floor(F.col("y") / cell).alias("gy")).agg(F.sum(weight).alias("weight"))


def in_polygon(x: Column, y: Column, corners: list[tuple[float, float]]) -> Column:
    """Even-odd ray casting, after a check of the bounding box; a flat edge's height counts as 1e-12."""
    xs, ys = [c[0] for c in corners], [c[1] for c in corners]
    inside = F.lit(False)
    for (xi, yi), (xj, yj) in zip(corners, [corners[-1], *corners[:-1]], strict=True):
        rise = yj - yi if yj != yi else 1e-12
        crosses = ((F.lit(yi) > y) != (F.lit(yj) > y)) & (x < (xj - xi) * (y - yi) / rise + xi)
        inside = inside != crosses
    return x.between(min(xs), max(xs)) & y.between(min(ys), max(ys)) & inside


def transform(x: Column, y: Column, m: Affine) -> tuple[Column, Column]:
    """The images of x and y under the affine map of rows (a, b, c), (d, e, f)."""
    a, b, c, d, e, f = m
    return a * x + b * y + c, d * x + e * y + f


def inverse(m: Affine) -> Affine:
    a, b, c, d, e, f = m
    det = a * e - b * d
    if abs(det) < 1e-12:
        raise ValueError("the affine map has no inverse")
    return e / det, -b / det, (b * f - c * e) / det, -d / det, a / det, (c * d - a * f) / det


def read_affine(text: str) -> Affine:
    """Three lines of three numbers, parted by commas or white space."""
    rows = [[float(x) for x in line.replace(",", " ").split()] for line in text.splitlines() if line.strip()]
    if len(rows) != 3 or any(len(r) != 3 for r in rows):
        raise ValueError("an affine map has three lines of three numbers")
    return (*rows[0], *rows[1])


def orientation(points: DataFrame, size: tuple[float, float], candidates: dict[str, Affine], slack: float = 0.25) -> DataFrame:
    """name, score of each candidate map, the best first in rank: the share of points that fall into the image, widened by slack."""
    w, h = size
    scores = []
    for k, (name, m) in enumerate(candidates.items()):
        x, y = transform(F.col("x"), F.col("y"), m)
        hit = x.between(-slack * w, (1 + slack) * w) & y.between(-slack * h, (1 + slack) * h)
        scores.append(F.struct(F.lit(name).alias("name"), F.lit(k).alias("place"), F.avg(hit.cast("double")).alias("score")))
    rows = points.agg(F.array(*scores).alias("s")).select(F.explode("s").alias("s")).select("s.*")
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "place"))).drop("place")


def image_tiles(spark, width: int, height: int, tile: int = 512, m: Affine = (1, 0, 0, 0, 1, 0)) -> DataFrame:
    """col, row and the transformed bounds of every tile of an image."""
    grid = spark.range(-(-width // tile)).select(F.col("id").alias("col")).join(F.broadcast(spark.range(-(-height // tile)).select(F.col("id").alias("row"))), F.lit(True))
    x0, y0 = F.col("col") * tile, F.col("row") * tile
    x1, y1 = F.least(x0 + tile, F.lit(width)), F.least(y0 + tile, F.lit(height))
    corners = [transform(x, y, m) for x in (x0, x1) for y in (y0, y1)]
    return grid.select("col", "row", F.least(*[c[0] for c in corners]).alias("x0"), F.greatest(*[c[0] for c in corners]).alias("x1"), F.least(*[c[1] for c in corners]).alias("y0"), F.greatest(*[c[1] for c in corners]).alias("y1"))


def spatial_knn(points: DataFrame, k: int, cell: float) -> DataFrame:
    """src, rank, dst, dist (squared): the exact k nearest of points(cell_id, x, y), self left out.

    Points of one place count once, with the k + 1 smallest of their ids. Grids have sides of cell times powers of two; each place
    begins at the finest one whose cell around it holds k / 2 places, so it meets about as many others however dense they lie. It
    meets those of the 3 x 3 cells around it; where its k-th distance reaches beyond these, it goes on to the next coarser grid."""
    from ..model import materialized

    points = points.select("cell_id", "x", "y").where("x is not null and y is not null")
    wide, high, total = points.agg(F.max("x") - F.min("x"), F.max("y") - F.min("y"), F.count(F.lit(1))).first()
    top = float(cell)
    while top < max(wide or 0, high or 0):
        top *= 2
    nth = F.row_number().over(Window.partitionBy("x", "y").orderBy("cell_id"))
    places = points.withColumn("nth", nth).where(F.col("nth") <= k + 1).groupBy("x", "y").agg(F.sort_array(F.collect_list("cell_id")).alias("ids"))
    places = materialized(places.select(F.col("ids")[0].alias("at"), "x", "y", "ids"), "places")
    side = F.lit(top) / F.pow(F.lit(2.0), F.col("level"))
    grid = {"gx": F.floor(F.col("x") / side), "gy": F.floor(F.col("y") / side)}
    first = max(0, math.ceil(math.log(max(total, 1) / 4096, 4)))  # about 4096 points a cell, were they spread evenly
    levels = places.select("at", "x", "y", F.explode(F.sequence(F.lit(first), F.lit(first + 20))).alias("level")).withColumns(grid)
    full = levels.groupBy("level", "gx", "gy").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max(1, k // 2)).drop("n")
    finest = levels.where(F.col("level") > first).join(full, ["level", "gx", "gy"]).groupBy("at").agg(F.max("level").alias("level"))
    open_ = places.select("at", "x", "y").join(finest, "at", "left").withColumn("level", F.coalesce("level", F.lit(first)))
    around = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    done = None
    while True:
        open_ = materialized(open_, "open")
        used = sorted(r.level for r in open_.select("level").distinct().collect())
        if not used and done is not None:
            break
        base = places.select("x", "y", "ids", F.explode(F.array(*[F.lit(v) for v in used] or [F.lit(0)])).alias("level")).withColumns(grid)
        base = base.select("level", "gx", "gy", F.col("x").alias("bx"), F.col("y").alias("by"), "ids")
        q = open_.withColumns(grid).withColumn("dx", F.explode(around)).withColumn("dy", F.explode(around))
        q = q.select("at", "x", "y", "level", (F.col("gx") + F.col("dx")).alias("gx"), (F.col("gy") + F.col("dy")).alias("gy"))
        dist = (F.col("x") - F.col("bx")) * (F.col("x") - F.col("bx")) + (F.col("y") - F.col("by")) * (F.col("y") - F.col("by"))
        near = q.join(base, ["level", "gx", "gy"]).select("at", "level", dist.alias("dist"), F.explode("ids").alias("dst"))
        nth = F.row_number().over(Window.partitionBy("at").orderBy("dist", "dst"))
        near = near.withColumn("nth", nth).where(F.col("nth") <= k + 1)
        found = near.groupBy("at", "level").agg(F.sort_array(F.collect_list(F.struct("dist", "dst"))).alias("near"))
        found = materialized(found, "spatial-knn")
        enough = (F.size("near") >= min(k + 1, total)) & (F.element_at("near", -1)["dist"] <= F.pow(side * (1 - 1e-9), F.lit(2.0)))
        settled = found.where(enough | (F.col("level") == 0)).select("at", "near")
        done = settled if done is None else done.unionByName(settled)
        open_ = open_.join(settled.select("at"), "at", "left_anti").withColumn("level", F.col("level") - 1)
    named = points.join(places.select("at", "x", "y"), ["x", "y"]).select(F.col("cell_id").alias("src"), "at").join(done, "at")
    others = F.slice(F.filter("near", lambda n: n.dst != F.col("src")), 1, k)
    rows = named.select("src", F.posexplode(others).alias("rank", "n"))
    return rows.select("src", (F.col("rank") + 1).alias("rank"), "n.dst", "n.dist")
