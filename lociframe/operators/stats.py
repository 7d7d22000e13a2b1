"""Tests and scores: rank-sum markers, multiple testing, cell-type scores, interactions, enrichment, themes."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.genomic import normal_tail
from ..model import materialized, ranged

PSEUDO = 1e-9
#: Rows of a test table that one task ranks.
ONE_WINDOW = 1_000_000


def benjamini_hochberg(tests: DataFrame, p: str, partition: list[str] | None = None, order: tuple[str, ...] = ()) -> DataFrame:
    """tests with p_val_adj: min(1, running minimum of p m / rank from the largest p), within the partition.

    Without a partition, up to ONE_WINDOW stored tests are one window; more are ranked in ranges of p: each range learns how many
    tests the ranges below it hold and the least p m / rank of those above. Both give the same."""
    tests = tests if partition else materialized(tests, "tests")
    if partition or tests.count() <= ONE_WINDOW:
        own = Window.partitionBy(*(partition or []))
        ranked = tests.withColumns({"__rank": F.row_number().over(own.orderBy(p, *order)), "__m": F.count(F.lit(1)).over(own)})
        ranked = ranked.withColumn("__q", F.col(p) * F.col("__m") / F.col("__rank"))
        rest = own.orderBy(F.desc("__rank")).rowsBetween(Window.unboundedPreceding, 0)  # a frame that ends with its row sums up once
        return ranked.withColumn("p_val_adj", F.least(F.lit(1.0), F.min("__q").over(rest))).drop("__rank", "__m", "__q")
    rows = ranged(tests, p, *order)
    parts = Window.orderBy("__part")  # over a row for each range
    sizes = rows.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    sizes = sizes.select("__part", (F.sum("__n").over(parts) - F.col("__n")).alias("__below"), F.sum("__n").over(Window.partitionBy()).alias("__m"))
    up = Window.partitionBy("__part").orderBy(p, *order)
    ranked = rows.join(F.broadcast(sizes), "__part").withColumn("__up", F.row_number().over(up))
    ranked = ranked.withColumn("__q", F.col(p) * F.col("__m") / (F.col("__up") + F.col("__below")))
    above = ranked.groupBy("__part").agg(F.min("__q").alias("__least"))
    above = above.select("__part", F.min("__least").over(Window.orderBy(F.desc("__part")).rowsBetween(Window.unboundedPreceding, -1)).alias("__above"))
    rest = F.min("__q").over(Window.partitionBy("__part").orderBy(F.desc("__up")).rowsBetween(Window.unboundedPreceding, 0))
    return ranked.join(F.broadcast(above), "__part").withColumn("p_val_adj", F.least(F.lit(1.0), rest, F.col("__above"))).drop("__part", "__below", "__m", "__q", "__above", "__up")


def markers(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """feature_id, p_val, avg_logFC, pct1, pct2, p_val_adj: rank-sum test of the cells of groups(cell_id, one) with one true
    against the others, zeros included.

    Zeros aren't made into rows: positive values rank above all z zeros, whose average rank is (z + 1) / 2. Values are first
    counted by feature and value, so ties are one row and a task holds a feature's distinct values only."""
    sizes = groups.agg(F.count_if(F.col("one")).alias("n1"), F.count_if(~F.col("one")).alias("n2")).first()
    return _rank_sum(counts.where(F.col("value") > 0).join(groups, "cell_id"), sizes["n1"], sizes["n2"])


def _rank_sum(rows: DataFrame, n1: int, n2: int, by: tuple[str, ...] = ()) -> DataFrame:
    n = n1 + n2
    one = F.when(F.col("one"), F.lit(1)).otherwise(0)
    tied = rows.groupBy(*by, "feature_id", "value").agg(F.count(F.lit(1)).alias("t"), F.sum(one).alias("t1"))
    own = Window.partitionBy(*by, "feature_id")
    below = F.coalesce(F.sum("t").over(own.orderBy("value").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    zeros = F.lit(n) - F.sum("t").over(own)
    tied = tied.withColumns({"rank": zeros + below + (F.col("t") + 1) / 2, "z": zeros})
    cube = lambda x: x * x * x - x
    sums = tied.groupBy(*by, "feature_id").agg(
        F.max("z").cast("double").alias("z"), F.sum("t1").cast("double").alias("p1"), F.sum(F.col("t") - F.col("t1")).cast("double").alias("p2"),
        F.sum(F.col("t1") * F.col("rank")).alias("r"), F.sum(cube(F.col("t").cast("double"))).alias("ties"),
        F.sum(F.col("t1") * F.col("value")).alias("s1"), F.sum((F.col("t") - F.col("t1")) * F.col("value")).alias("s2"),
    )
    r1 = F.col("r") + (n1 - F.col("p1")) * (F.col("z") + 1) / 2
    u = r1 - n1 * (n1 + 1) / 2
    variance = n1 * n2 / 12 * ((n + 1) - (F.col("ties") + cube(F.col("z"))) / (n * (n - 1.0)))
    sums = sums.withColumns({"u": u - n1 * n2 / 2, "variance": variance})  # columns of their own: the tail names z often
    sums = sums.withColumn("zed", F.when(F.col("variance") > 1e-12, F.col("u") / F.sqrt(F.greatest("variance", F.lit(1e-300)))).otherwise(0.0))
    p = F.when(F.col("variance") > 1e-12, F.least(F.lit(1.0), 2 * normal_tail(F.col("zed")))).otherwise(1.0)
    fold = F.ln((F.col("s1") / n1 + PSEUDO) / (F.col("s2") / n2 + PSEUDO))
    return benjamini_hochberg(sums.select(*by, "feature_id", p.alias("p_val"), fold.alias("avg_logFC"), (F.col("p1") / n1).alias("pct1"), (F.col("p2") / n2).alias("pct2")), "p_val", list(by), ("feature_id",))


def expressed_filter(rows: DataFrame, least: float = 0.2) -> DataFrame:
    return rows.where((F.coalesce("pct1", F.lit(0.0)) > least) | (F.coalesce("pct2", F.lit(0.0)) > least))


def cell_type_search(dots: DataFrame, panel: DataFrame, strong: float = 0.5, expressed: float = 0.1) -> DataFrame:
    """cluster, score, n_expressed, n_strong, strongest_pct of a marker panel(feature_id) over a dot plot's rows.

    score: mean over markers of the average expression's z-score across clusters times the share of cells expressing."""
    own = Window.partitionBy("feature_id")
    sd = F.stddev_samp("avg").over(own)
    rows = dots.join(panel, "feature_id", "left_semi").withColumn("z", F.when(sd.isNull() | (sd < 1e-12), F.lit(0.0)).otherwise((F.col("avg") - F.avg("avg").over(own)) / sd))
    return rows.groupBy("cluster").agg(F.avg(F.col("z") * F.col("pct")).alias("score"), F.count_if(F.col("pct") >= expressed).alias("n_expressed"), F.count_if(F.col("pct") >= strong).alias("n_strong"), F.max("pct").alias("strongest_pct"))


def jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def fold_enrichment(query_hits: Column, n_query: Column, pool_hits: Column, n_pool: Column) -> Column:
    return F.try_divide(F.try_divide(query_hits, n_query), F.try_divide(pool_hits, n_pool))


def hypergeometric_tail(overlap: Column, set_size: Column, drawn: Column, universe: Column) -> Column:
    """P(X >= overlap) for drawn of universe with set_size marked."""
    @F.pandas_udf("double")
    def tail(k: pd.Series, m: pd.Series, n: pd.Series, u: pd.Series) -> pd.Series:
        choose = lambda a, b: math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)
        def one(k, m, n, u):  # noqa: E306
            terms = [choose(m, i) + choose(u - m, n - i) - choose(u, n) for i in range(int(k), int(min(m, n)) + 1) if n - i <= u - m]
            return min(1.0, math.fsum(map(math.exp, terms)))
        return pd.Series([one(*x) for x in zip(k, m, n, u, strict=True)])

    return tail(overlap.cast("double"), set_size.cast("double"), drawn.cast("double"), universe.cast("double"))


def enrichment(chosen: DataFrame, sets: DataFrame, universe: int) -> DataFrame:
    """term, overlap, set_size, p_val, p_val_adj of sets(term, gene) for chosen(gene)."""
    n = chosen.count()
    hits = sets.join(chosen.withColumn("hit", F.lit(1)), "gene", "left").groupBy("term").agg(F.count("hit").alias("overlap"), F.count(F.lit(1)).alias("set_size"))
    rows = hits.withColumn("p_val", hypergeometric_tail(F.col("overlap"), F.col("set_size"), F.lit(n), F.lit(universe)))
    return benjamini_hochberg(rows, "p_val", order=("term",))


def motif_enrichment(motifs: DataFrame, peaks: DataFrame, background: DataFrame) -> DataFrame:
    """motif, query_hits, background_hits, fold, p_val, p_val_adj of motifs(motif, peak_id): how much oftener peaks hold a motif
    than the background does, and the chance of as many hits in as many peaks of the background."""
    rows = motifs.select("motif", "peak_id").distinct()
    hits = lambda chosen, name: rows.join(chosen.select("peak_id").distinct(), "peak_id", "left_semi").groupBy("motif").agg(F.count(F.lit(1)).alias(name))
    n_query, n_background = peaks.select("peak_id").distinct().count(), background.select("peak_id").distinct().count()
    both = hits(background, "background_hits").join(hits(peaks, "query_hits"), "motif", "left").withColumn("query_hits", F.coalesce("query_hits", F.lit(0).cast("long")))
    fold = fold_enrichment(F.col("query_hits"), F.lit(float(n_query)), F.col("background_hits"), F.lit(float(n_background)))
    scored = both.withColumn("fold", F.coalesce(fold, F.lit(0.0))).withColumn("p_val", hypergeometric_tail(F.col("query_hits"), F.col("background_hits"), F.lit(n_query), F.lit(n_background)))
    return benjamini_hochberg(scored, "p_val", order=("motif",)).select("motif", "query_hits", "background_hits", "fold", "p_val", "p_val_adj")


def pathway_themes(terms: DataFrame, keep: int = 80, themes: int = 8, related: int = 5) -> DataFrame:
    """theme, lead, related of the best terms(term, tokens, genes, p_val, p_val_adj, overlap).

    Kept: adjusted p up to .25 or p up to .01, keep of them at most. A term joins the first theme whose lead shares .45 of the
    genes, or .55 of the tokens and .25 of the genes. The greedy pass runs over at most keep rows."""
    best = terms.where("p_val_adj <= 0.25 or p_val <= 0.01").orderBy("p_val_adj", "p_val", F.desc("overlap"), "term").limit(keep)

    def near(a: set, b: set) -> float:
        return len(a & b) / len(a | b) if a and b else 0.0

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[dict, list[str]]] = []
        for row in pdf.sort_values(["p_val_adj", "p_val", "overlap", "term"], ascending=[True, True, False, True]).to_dict("records"):
            genes, tokens = set(row["genes"]), set(row["tokens"])
            for lead, others in found:
                g = near(genes, lead["genes"])
                if g >= 0.45 or near(tokens, lead["tokens"]) >= 0.55 and g >= 0.25:
                    if len(others) < related:
                        others.append(row["term"])
                    break
            else:
                if len(found) == themes:
                    break
                found.append((row | {"genes": genes, "tokens": tokens}, []))
        return pd.DataFrame([(k + 1, lead["term"], others) for k, (lead, others) in enumerate(found)], columns=["theme", "lead", "related"])

    return best.groupBy(F.lit(1).alias("all")).applyInPandas(run, "theme int, lead string, related array<string>")


def _places(rows: DataFrame, *keys: str) -> DataFrame:
    """rows with place, their place from 1 among the rows of one b in the order of keys, which must tell rows apart."""
    return running_places(rows.withColumn("__one", F.lit(1)), "__one", *keys).drop("__one")


def running_places(rows: DataFrame, weight: str, *keys: str) -> DataFrame:
    """rows with place: the sum of weight over the rows of the same b up to each, in the order of keys, by ranges."""
    parts = ranged(rows, "b", *keys)
    sums = parts.groupBy("b", "__part").agg(F.sum(weight).alias("__sum"))
    before = sums.select("b", "__part", (F.sum("__sum").over(Window.partitionBy("b").orderBy("__part")) - F.col("__sum")).alias("__before"))
    own = F.sum(weight).over(Window.partitionBy("b", "__part").orderBy(*keys))
    return parts.join(F.broadcast(before), ["b", "__part"]).withColumn("place", own + F.col("__before")).drop("__part", "__before")  # a row for each range


def interactions(expression: DataFrame, groups: DataFrame, pairs: DataFrame, nboot: int = 20, half: float = 0.5) -> DataFrame:
    """source, target, pair, probability, p_value, ligand_pct, receptor_pct between groups(cell_id, grp).

    probability = L R / (half + L R) of the groups' mean expressions. Labels are permuted nboot times: each permutation orders
    the cells by a hash of cell and number and deals the labels anew in that order."""
    n = groups.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
    kept = groups.join(n, "grp", "left_semi")
    order = _places(kept.withColumn("b", F.lit(0)), "cell_id").drop("b")
    boots = order.select("cell_id", F.explode(F.sequence(F.lit(1), F.lit(nboot))).alias("b")).withColumn("h", F.xxhash64("cell_id", "b"))
    shuffled = _places(boots, "h", "cell_id")
    dealt = shuffled.join(order.select("place", "grp"), "place").select("cell_id", "b", "grp").unionByName(kept.select("cell_id", F.lit(0).alias("b"), "grp"))
    genes = pairs.select(F.explode(F.array("ligand", "receptor")).alias("feature_id")).distinct()
    own = expression.join(genes, "feature_id", "left_semi")
    means = own.join(dealt, "cell_id").groupBy("b", "grp", "feature_id").agg(F.sum("value").alias("s"), F.count_if(F.col("value") > 0).alias("k"))
    means = means.join(n, "grp").select("b", "grp", "feature_id", (F.col("s") / F.col("n")).alias("mean"), (F.col("k") / F.col("n")).alias("pct"))
    left = means.select("b", F.col("grp").alias("source"), F.col("feature_id").alias("ligand"), F.col("mean").alias("l"), F.col("pct").alias("ligand_pct"))
    right = means.select("b", F.col("grp").alias("target"), F.col("feature_id").alias("receptor"), F.col("mean").alias("r"), F.col("pct").alias("receptor_pct"))
    rows = pairs.join(left, "ligand").join(right, ["b", "receptor"])
    rows = rows.withColumn("probability", F.col("l") * F.col("r") / (half + F.col("l") * F.col("r")))
    seen = rows.where("b = 0").select("source", "target", "pair", "probability", "ligand_pct", "receptor_pct")
    null = rows.where("b > 0").select("source", "target", "pair", F.col("probability").alias("p0"))
    beaten = seen.join(null, ["source", "target", "pair"], "left").groupBy("source", "target", "pair").agg(F.count_if(F.col("p0") >= F.col("probability")).alias("over"))
    return seen.join(beaten, ["source", "target", "pair"]).withColumn("p_value", (1 + F.col("over")) / (1 + nboot)).drop("over")


