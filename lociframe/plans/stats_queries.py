"""Queries on tests, scores and the text command surface, and their SQL."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import model as m
from ..functions import text as tx
from ..functions.genomic import normal_tail_sql
from ..model import rounded
from ..operators import algebra, matrix, neighbors, requests, stats, summaries
from .matrix_queries import _DOTS, CELLS, LOGN, SC, SCELLS, C


def _markers(spark, sf, one):
    groups = m.sparse_cells(spark, sf).select("cell_id", one.alias("one"))
    found = stats.markers(m.sparse_counts(spark, sf), groups)
    return found.select("feature_id", rounded(F.col("p_val"), 5).alias("p_val"), rounded(F.col("avg_logFC"), 5).alias("avg_logFC"), rounded(F.col("pct1")).alias("pct1"), rounded(F.col("pct2")).alias("pct2"), rounded(F.col("p_val_adj"), 5).alias("p_val_adj"))


def wilcoxon_markers(spark, sf):
    return _markers(spark, sf, F.col("cluster") == 3)


def roi_markers(spark, sf):
    return _markers(spark, sf, F.col("cluster").isin(1, 2, 5, 8))


def deg_between_samples(spark, sf):
    cells = m.sparse_cells(spark, sf).where(F.col("sample").isin(0, 1))
    rows = stats.markers(m.sparse_counts(spark, sf), cells.select("cell_id", (F.col("sample") == 0).alias("one")))
    return stats.expressed_filter(rows, 0.03).select("feature_id", rounded(F.col("p_val"), 5).alias("p_val"), rounded(F.col("pct1")).alias("pct1"), rounded(F.col("pct2")).alias("pct2"))


def volcano_top(spark, sf):
    rows = _markers(spark, sf, F.col("cluster") == 3)
    return summaries.volcano(rows).select("feature_id", "side", "avg_logFC", rounded(F.col("y"), 3).alias("y"))


def bh_adjust(spark, sf):
    tests = m.table(spark, sf, "part").select("p_partkey", "p_brand", (((F.col("p_partkey") * 7919) % 1000 + 1) / 1001.0).alias("p"))
    return stats.benjamini_hochberg(tests, "p", ["p_brand"], ("p_partkey",)).select("p_brand", "p_partkey", rounded(F.col("p_val_adj")).alias("p_val_adj"))


def cell_type_search(spark, sf):
    dots = summaries.dot_plot(m.counts(spark, sf), m.cells(spark, sf), "cluster")
    panel = m.features(spark, sf).where("collection = 'Brand#7'").select("feature_id")
    found = stats.cell_type_search(dots, panel)
    return found.select("cluster", rounded(F.col("score"), 5).alias("score"), "n_expressed", "n_strong", rounded(F.col("strongest_pct")).alias("strongest_pct"))


def _interactions(spark, sf):
    o = m.table(spark, sf, "orders").join(m.sparse_cells(spark, sf), F.col("o_custkey") == F.col("cell_id"))
    return o.select(F.concat(F.lit("c"), F.col("sample").cast("string")).alias("source"), F.concat(F.lit("c"), (F.col("cluster") % 4).cast("string")).alias("target"), (F.col("o_orderkey") % 8 / 8.0).alias("probability"))


def strength_matrix(spark, sf):
    return summaries.strength_matrix(_interactions(spark, sf))


def _sets(spark, sf):
    part = m.table(spark, sf, "part")
    return part.select(F.col("p_brand").alias("term"), F.col("p_size").alias("gene")).distinct()


def jaccard_terms(spark, sf):
    sets = _sets(spark, sf).groupBy("term").agg(F.collect_set("gene").alias("genes"))
    other = sets.select(F.col("term").alias("term2"), F.col("genes").alias("genes2"))
    pairs = sets.join(F.broadcast(other), F.col("term") < F.col("term2"))  # a few dozen terms
    return pairs.select("term", "term2", rounded(stats.jaccard(F.col("genes"), F.col("genes2"))).alias("jaccard"))


def term_tokens(spark, sf):
    name = F.concat(F.lit("GO_"), F.regexp_replace(F.upper("p_name"), " ", "_"), F.lit("_pathway of the "), F.lower("p_type"))
    return m.table(spark, sf, "part").select("p_partkey", F.array_join(tx.term_tokens(name), " ").alias("tokens"))


def motif_fold(spark, sf):
    part = m.table(spark, sf, "part").withColumn("query", F.col("p_size") <= 15)
    rows = part.groupBy("p_type").agg(F.count_if("query").alias("q"), F.count(F.lit(1)).alias("b"))
    total = part.agg(F.count_if("query").alias("nq"), F.count(F.lit(1)).alias("nb"))
    fold = stats.fold_enrichment(F.col("q"), F.col("nq"), F.col("b"), F.col("nb"))
    return rows.join(F.broadcast(total), F.lit(True)).select("p_type", "q", "b", rounded(F.coalesce(fold, F.lit(0.0))).alias("fold"))


def _terms(spark, sf):
    """Overlapping bands of part sizes as terms, and the parts of small size as the chosen ones."""
    part = m.table(spark, sf, "part")
    chosen = part.where("p_size <= 20").select(F.col("p_partkey").alias("gene"))
    bands = F.sequence(F.greatest(F.lit(0), F.ceil((F.col("p_size") - 6) / 3)), F.floor(F.col("p_size") / 3))
    sets = part.select(F.explode(bands).alias("band"), F.col("p_partkey").alias("gene")).select(F.concat(F.lit("GO_SIZE_BAND_"), F.col("band").cast("string")).alias("term"), "gene")
    return stats.enrichment(chosen, sets, part.count()), sets


def set_enrichment(spark, sf):
    found = _terms(spark, sf)[0]
    return found.select("term", "overlap", "set_size", rounded(F.col("p_val"), 5).alias("p_val"), rounded(F.col("p_val_adj"), 5).alias("p_val_adj"))


def pathway_themes(spark, sf):
    rows, sets = _terms(spark, sf)
    genes = sets.groupBy("term").agg(F.collect_set("gene").alias("genes"))
    return stats.pathway_themes(rows.join(genes, "term").withColumn("tokens", tx.term_tokens(F.col("term"))))


def ligand_receptor_perm(spark, sf):
    top = matrix.axis_sums(m.counts(spark, sf), "feature_id").orderBy(F.desc("total"), "feature_id").limit(12).select("feature_id").withColumn("k", F.row_number().over(Window.orderBy("feature_id")))
    pairs = top.where("k % 2 = 1").select((F.col("k") + 1).alias("next"), F.col("feature_id").alias("ligand")).join(top.select(F.col("k").alias("next"), F.col("feature_id").alias("receptor")), "next")
    pairs = pairs.select(F.concat_ws("_", "ligand", "receptor").alias("pair"), "ligand", "receptor")
    groups = m.cells(spark, sf).select("cell_id", F.col("sample").alias("grp"))
    return stats.interactions(matrix.log_normalize(m.counts(spark, sf)), groups, pairs)


def ligand_receptor_observed(spark, sf):
    """What ligand_receptor_perm observes, without its permutations' p."""
    rows = ligand_receptor_perm(spark, sf)
    return rows.select("source", "target", "pair", rounded(F.col("probability")).alias("probability"), rounded(F.col("ligand_pct")).alias("ligand_pct"), rounded(F.col("receptor_pct")).alias("receptor_pct"))


# ---- texts -------------------------------------------------------------------------------------------------

#: Command texts by the row's number; {n} is a number of the row.
SAMPLES = (
    "Show gene expression of Nphs2!", "what is  cluster {n}?", "rename cluster {n} to Tubule cells", "go to the spatial view", "hello there", "min genes {n}, max mito 12",
    "use {n} highly variable genes", "set min_dist to 0.4", "difference between s{n} and s7?", "change pca settings", "thanks a lot", "the second one", "plot umap; then find markers of {n}",
)


def _commands(spark, sf):
    rows = m.table(spark, sf, "customer").select("c_custkey")
    n = (F.col("c_custkey") % 40 + 1).cast("string")
    pick = F.element_at(F.array(*[F.lit(s) for s in SAMPLES]), (F.col("c_custkey") % len(SAMPLES) + 1).cast("int"))
    return rows.select("c_custkey", F.replace(pick, F.lit("{n}"), n).alias("text"))


_CMD = "cmd AS (SELECT c_custkey, replace(CASE CAST(c_custkey % {k} AS INTEGER) {whens} END, '{{n}}', CAST(c_custkey % 40 + 1 AS VARCHAR)) AS text FROM customer)".format(k=len(SAMPLES), whens=" ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(SAMPLES)))


def input_type(spark, sf):
    return _commands(spark, sf).select("c_custkey", tx.input_type(F.col("text")).alias("kind"), tx.non_command(F.col("text")).alias("reason"))


def turn_types(spark, sf):
    rows = m.table(spark, sf, "conversations")
    return rows.groupBy("role", tx.input_type(F.col("text")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def param_extract(spark, sf):
    t = F.col("text")
    rows = _commands(spark, sf).select("c_custkey", tx.rename(t).alias("r"), tx.cell_filter(t).alias("f"), tx.hvg_count(t).alias("hvg"), tx.min_dist(t).alias("min_dist"), tx.parameter_group(t).alias("step"), tx.sample_pair(t).alias("p"), tx.choice(t, 3).alias("choice"))
    return rows.select("c_custkey", F.col("r.old").alias("old_name"), F.col("r.new").alias("new_name"), F.col("f.min_features").alias("min_features"), F.col("f.max_mito_pct").alias("max_mito"), "hvg", "min_dist", "step", F.col("p.a").alias("sample_a"), F.col("p.b").alias("sample_b"), "choice")


def chained_commands(spark, sf):
    return _commands(spark, sf).select("c_custkey", F.posexplode(requests.commands(F.col("text"))).alias("place", "command"))


def fuzzy_names(spark, sf):
    names = m.table(spark, sf, "part").select("p_partkey", F.split("p_name", " ")[0].alias("a"), F.split("p_name", " ")[1].alias("b"))
    return names.select("p_partkey", tx.edit_distance(F.col("a"), F.col("b")).alias("edits"), tx.fuzzy_match(F.col("a"), F.concat(F.col("a"), F.lit("s"))).alias("near"))


def first_json(spark, sf):
    rows = m.table(spark, sf, "events").select("event_id", F.concat(F.lit("said: "), "props", F.lit(" and more }")).alias("text"))
    return rows.select("event_id", tx.first_json(F.col("text")).alias("json")).select("event_id", "json", F.get_json_object("json", "$.k").try_cast("int").alias("k"))


def salvaged_items(spark, sf):
    """The whole items of lists that break off in their last one."""
    broken = F.concat(F.lit('said [{"a": "}{"}, '), "props", F.lit(', {"k": 4, "b'))
    found = tx.complete_objects(broken)
    return m.table(spark, sf, "events").select("event_id", F.size(found).alias("n"), found[0].alias("first"), found[1].alias("second"))


def salvaged_nested(spark, sf):
    """The whole items, nested ones too, of lists that break off in their last one; broken ones in between are left out."""
    broken = F.concat(F.lit('said } [{"a": {"b": ['), "props", F.lit(', "}{\\"{"], "c": {}}}, {"bad": {,}}, '), "props", F.lit(', {"k": {"z": 1}, "b'))
    found = tx.whole_items(F.substring(broken, 8, 1 << 20))
    return m.table(spark, sf, "events").select("event_id", F.size(found).alias("n"), found[0].alias("first"), found[1].alias("second"))


def intent_linear(spark, sf):
    """A linear scorer learnt from labelled vectors: one row on how it does on them."""
    rows = m.embedding(spark, sf)
    made = m.materialized(rows.select(F.concat("vec", F.array(F.col("cluster").cast("double"))).alias("vec")), "labelled")
    w, b = algebra.fit_softmax(made, int(rows.agg(F.max("cluster")).first()[0]) + 1)
    scored = algebra.softmax_scores(rows.select(F.col("cell_id").alias("id"), "vec"), w, b).join(rows.select(F.col("cell_id").alias("id"), "cluster"), "id")
    largest = rows.groupBy("cluster").count().agg(F.max("count")).first()[0]
    return scored.agg(F.count(F.lit(1)).alias("n"), (F.count_if(F.col("best") == F.col("cluster")) > largest).alias("beats_largest"), F.every(F.col("confidence").between(0.0, 1.0)).alias("shares"))


def _scored(spark, sf):
    """Nearest-example scores: the largest cosine of a vector with an intent's examples (the first five of each label)."""
    emb = m.embedding(spark, sf)
    examples = emb.withColumn("k", F.row_number().over(Window.partitionBy("cluster").orderBy("cell_id"))).where("k <= 5")
    near = neighbors.knn(emb, examples, examples.count())
    own = examples.select(F.col("cell_id").alias("dst"), F.col("cluster").alias("intent"))
    return near.join(F.broadcast(own), "dst").groupBy("src", "intent").agg((1 - F.min("dist")).alias("score"))


def intent_cosine(spark, sf):
    return _scored(spark, sf).withColumn("score", rounded(F.col("score")))


def intent_softmax(spark, sf):
    own = Window.partitionBy("src")
    rows = _scored(spark, sf).withColumn("e", F.exp(5 * F.col("score") - F.max(5 * F.col("score")).over(own)))
    return rows.select("src", "intent", rounded(F.col("e") / F.sum("e").over(own)).alias("p"))


def ambiguity_flag(spark, sf):
    order = Window.partitionBy("src").orderBy(F.desc(F.round("score", 9)), "intent")
    ranked = _scored(spark, sf).select("src", "intent", "score", F.lead("score").over(order).alias("second"), F.row_number().over(order).alias("k")).where("k = 1")
    unclear = tx.ambiguous(F.col("score"), F.col("second"))
    confidence = F.when(unclear, F.least("score", F.lit(0.45))).otherwise(F.col("score"))
    return ranked.select("src", "intent", unclear.alias("unclear"), rounded(tx.gate(confidence, F.col("src") % 2 == 0)).alias("confidence"))


def _rank_sql(where: str, one: str) -> str:
    return f"""WITH {SC}, {SCELLS}, g AS (SELECT cell_id, {one} AS one FROM cells WHERE {where}),
    sz AS (SELECT CAST(count(CASE WHEN one THEN 1 END) AS DOUBLE) AS n1, CAST(count(CASE WHEN NOT one THEN 1 END) AS DOUBLE) AS n2 FROM g),
    x AS (SELECT feature_id, value, one FROM counts JOIN g USING (cell_id) WHERE value > 0),
    rk AS (SELECT *, (sz.n1 + sz.n2) - count(*) OVER (PARTITION BY feature_id) AS z, rank() OVER (PARTITION BY feature_id ORDER BY value) AS r0, count(*) OVER (PARTITION BY feature_id, value) AS t FROM x, sz),
    s AS (SELECT feature_id, max(n1) AS n1, max(n2) AS n2, max(z) AS z, CAST(count(CASE WHEN one THEN 1 END) AS DOUBLE) AS p1, CAST(count(CASE WHEN NOT one THEN 1 END) AS DOUBLE) AS p2,
        sum(CASE WHEN one THEN z + r0 + (t - 1) / 2.0 ELSE 0.0 END) AS r, sum(CAST(t AS DOUBLE) * t - 1) AS ties, sum(CASE WHEN one THEN value ELSE 0.0 END) AS s1, sum(CASE WHEN one THEN 0.0 ELSE value END) AS s2 FROM rk GROUP BY 1),
    u AS (SELECT *, r + (n1 - p1) * (z + 1) / 2 - n1 * (n1 + 1) / 2 - n1 * n2 / 2 AS u, n1 * n2 / 12 * ((n1 + n2 + 1) - (ties + z * z * z - z) / ((n1 + n2) * (n1 + n2 - 1.0))) AS v FROM s),
    w AS (SELECT *, CASE WHEN v > 1e-12 THEN u / sqrt(v) ELSE 0.0 END AS zed FROM u),
    p AS (SELECT feature_id, CASE WHEN v > 1e-12 THEN least(1.0, 2 * {normal_tail_sql('zed')}) ELSE 1.0 END AS p_val, ln((s1 / n1 + 1e-9) / (s2 / n2 + 1e-9)) AS fc, p1 / n1 AS pct1, p2 / n2 AS pct2 FROM w),
    q AS (SELECT *, p_val * count(*) OVER () / row_number() OVER (ORDER BY p_val, feature_id) AS q, row_number() OVER (ORDER BY p_val, feature_id) AS k FROM p),
    mk AS (SELECT feature_id, round(p_val, 5) + 0.0 AS p_val, round(fc, 5) + 0.0 AS "avg_logFC", round(pct1, 6) + 0.0 AS pct1, round(pct2, 6) + 0.0 AS pct2, pct1 AS x1, pct2 AS x2, round(least(1.0, min(q) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 5) + 0.0 AS p_val_adj FROM q)"""


_MK = 'SELECT feature_id, p_val, "avg_logFC", pct1, pct2, p_val_adj FROM mk'
_INTENT = """e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings), ex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY id) AS k FROM e) WHERE k <= 5),
    sc AS (SELECT a.id AS src, b.label AS intent, max(round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 12)) AS score FROM e a, ex b GROUP BY 1, 2)"""
_CLEAN = "lower(regexp_replace(regexp_replace(trim(text), '[\\s.,!?;:]+$', ''), '\\s+', ' ', 'g'))"


def _kind_sql() -> str:
    """The patterns of input_type for an engine without look-ahead: what must not follow is matched and excluded."""
    cases = []
    for kind, _, patterns in tx.INPUT_KINDS:
        tests = []
        for p in patterns:
            bare, ahead = re.sub(r"\(\?!.*?\)", "", p), re.search(r"\(\?!(.*?)\)", p)
            tests.append(f"regexp_matches(lower(trim(text)), '{bare}')" + (f" AND NOT regexp_matches(lower(trim(text)), '{bare}{ahead[1]}')" if ahead else ""))
        cases.append(f"WHEN {' OR '.join(tests)} THEN '{kind}'")
    return f"CASE {' '.join(cases)} ELSE 'unknown' END"


_KIND = _kind_sql()

QUERIES = {
    "wilcoxon_markers": (wilcoxon_markers, _rank_sql("true", "cluster = 3") + " " + _MK),
    "roi_markers": (roi_markers, _rank_sql("true", "cluster IN (1, 2, 5, 8)") + " " + _MK),
    "deg_between_samples": (deg_between_samples, _rank_sql("sample IN (0, 1)", "sample = 0") + " SELECT feature_id, p_val, pct1, pct2 FROM mk WHERE x1 > 0.03 OR x2 > 0.03"),
    "volcano_top": (volcano_top, _rank_sql("true", "cluster = 3") + " , y AS (SELECT feature_id, \"avg_logFC\", round(CASE WHEN p_val <= 0 THEN 0.0 ELSE -log10(greatest(p_val, 1e-320)) END, 3) + 0.0 AS y FROM mk) SELECT * FROM (SELECT feature_id, 'up' AS side, \"avg_logFC\", y FROM y ORDER BY \"avg_logFC\" DESC, feature_id LIMIT 10) UNION ALL SELECT * FROM (SELECT feature_id, 'down' AS side, \"avg_logFC\", y FROM y ORDER BY \"avg_logFC\", feature_id LIMIT 10)"),
    "bh_adjust": (bh_adjust, "WITH t AS (SELECT p_brand, p_partkey, ((p_partkey * 7919) % 1000 + 1) / 1001.0::DOUBLE AS p FROM part), q AS (SELECT *, p * count(*) OVER (PARTITION BY p_brand) / row_number() OVER (PARTITION BY p_brand ORDER BY p, p_partkey) AS q, row_number() OVER (PARTITION BY p_brand ORDER BY p, p_partkey) AS k FROM t) SELECT p_brand, p_partkey, round(least(1.0, min(q) OVER (PARTITION BY p_brand ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) + 0.0 AS p_val_adj FROM q"),
    "cell_type_search": (cell_type_search, f"WITH {C}, {CELLS}, {_DOTS}, d AS (SELECT dots.* FROM dots JOIN part ON p_partkey = feature_id WHERE p_brand = 'Brand#7'), z AS (SELECT *, avg(avg) OVER (PARTITION BY feature_id) AS mu, stddev_samp(avg) OVER (PARTITION BY feature_id) AS sd FROM d) SELECT cluster, round(avg(CASE WHEN sd IS NULL OR sd < 1e-12 THEN 0.0 ELSE (avg - mu) / sd END * pct), 5) + 0.0 AS score, count(CASE WHEN pct >= 0.1 THEN 1 END) AS n_expressed, count(CASE WHEN pct >= 0.5 THEN 1 END) AS n_strong, round(max(pct), 6) + 0.0 AS strongest_pct FROM z GROUP BY 1"),
    "strength_matrix": (strength_matrix, f"WITH {SCELLS}, i AS (SELECT 'c' || CAST(sample AS VARCHAR) AS source, 'c' || CAST(cluster % 4 AS VARCHAR) AS target, (o_orderkey % 8) / 8.0::DOUBLE AS probability FROM orders JOIN cells ON cell_id = o_custkey), p AS (SELECT source, target, sum(probability) AS strength FROM i GROUP BY 1, 2), e AS (SELECT node, sum(strength) AS total FROM (SELECT source AS node, strength FROM p UNION ALL SELECT target, strength FROM p) GROUP BY 1) SELECT source, target, strength, a.total AS source_total, b.total AS target_total FROM p JOIN e a ON a.node = source JOIN e b ON b.node = target"),
    "jaccard_terms": (jaccard_terms, "WITH s AS (SELECT DISTINCT p_brand AS term, p_size AS gene FROM part), n AS (SELECT term, count(*) AS n FROM s GROUP BY 1), i AS (SELECT a.term AS term, b.term AS term2, count(*) AS k FROM s a JOIN s b ON a.gene = b.gene AND a.term < b.term GROUP BY 1, 2) SELECT a.term AS term, b.term AS term2, round(coalesce(k, 0) / CAST(a.n + b.n - coalesce(k, 0) AS DOUBLE), 6) + 0.0 AS jaccard FROM n a JOIN n b ON a.term < b.term LEFT JOIN i ON i.term = a.term AND i.term2 = b.term"),
    "term_tokens": (term_tokens, "WITH w AS (SELECT p_partkey, i, words[i] AS w FROM (SELECT p_partkey, words, unnest(range(1, len(words) + 1)) AS i FROM (SELECT p_partkey, string_split(lower(p_name || ' pathway of the ' || p_type), ' ') AS words FROM part))), k AS (SELECT p_partkey, w, min(i) AS i FROM w WHERE length(w) > 2 AND w NOT IN ('and', 'the', 'for', 'from', 'with', 'pathway', 'process', 'regulation') GROUP BY 1, 2) SELECT p_partkey, string_agg(w, ' ' ORDER BY i) AS tokens FROM k GROUP BY 1"),
    "motif_fold": (motif_fold, "WITH t AS (SELECT CAST(count(CASE WHEN p_size <= 15 THEN 1 END) AS DOUBLE) AS nq, CAST(count(*) AS DOUBLE) AS nb FROM part), r AS (SELECT p_type, count(CASE WHEN p_size <= 15 THEN 1 END) AS q, count(*) AS b FROM part GROUP BY 1) SELECT p_type, q, b, round((q / nq) / (b / nb), 6) + 0.0 AS fold FROM r, t"),
    "set_enrichment": (set_enrichment, """WITH s AS (SELECT 'GO_SIZE_BAND_' || CAST(b AS VARCHAR) AS term, p_partkey AS gene, p_size FROM part, (SELECT unnest(range(0, 40)) AS b) WHERE b <= floor(p_size / 3.0) AND b >= ceil((p_size - 6) / 3.0)),
        n AS (SELECT CAST(count(*) AS DOUBLE) AS u, CAST(count(CASE WHEN p_size <= 20 THEN 1 END) AS DOUBLE) AS d FROM part), h AS (SELECT term, count(CASE WHEN p_size <= 20 THEN 1 END) AS overlap, count(*) AS set_size FROM s GROUP BY 1),
        t AS (SELECT term, overlap, set_size, u, d, CAST(unnest(range(overlap, CAST(least(set_size, d) AS BIGINT) + 1)) AS DOUBLE) AS i FROM h, n),
        p AS (SELECT term, any_value(overlap) AS overlap, any_value(set_size) AS set_size, least(1.0, sum(exp(lgamma(set_size + 1.0) - lgamma(i + 1) - lgamma(set_size - i + 1) + lgamma(u - set_size + 1) - lgamma(d - i + 1) - lgamma(u - set_size - d + i + 1) - lgamma(u + 1) + lgamma(d + 1) + lgamma(u - d + 1)))) AS p FROM t WHERE d - i <= u - set_size GROUP BY term),
        q AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p, term) AS q, row_number() OVER (ORDER BY p, term) AS k FROM p)
        SELECT term, overlap, set_size, round(p, 5) + 0.0 AS p_val, round(least(1.0, min(q) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 5) + 0.0 AS p_val_adj FROM q"""),
    "ligand_receptor_observed": (ligand_receptor_observed, f"""WITH {C}, {CELLS}, {LOGN}, tp AS (SELECT feature_id, row_number() OVER (ORDER BY feature_id) AS k FROM (SELECT feature_id FROM counts GROUP BY 1 ORDER BY sum(value) DESC, feature_id LIMIT 12)),
        pr AS (SELECT CAST(a.feature_id AS VARCHAR) || '_' || CAST(b.feature_id AS VARCHAR) AS pair, a.feature_id AS ligand, b.feature_id AS receptor FROM tp a JOIN tp b ON b.k = a.k + 1 WHERE a.k % 2 = 1),
        sz AS (SELECT sample AS grp, count(*) AS n FROM cells GROUP BY 1 HAVING count(*) >= 3), mn AS (SELECT sample AS grp, feature_id, sum(value) / max(n) AS mean, count(CASE WHEN value > 0 THEN 1 END) / CAST(max(n) AS DOUBLE) AS pct FROM ln_ JOIN cells USING (cell_id) JOIN sz ON sz.grp = sample GROUP BY 1, 2)
        SELECT l.grp AS source, r.grp AS target, pair, round(l.mean * r.mean / (0.5 + l.mean * r.mean), 6) + 0.0 AS probability, round(l.pct, 6) + 0.0 AS ligand_pct, round(r.pct, 6) + 0.0 AS receptor_pct FROM pr JOIN mn l ON l.feature_id = ligand JOIN mn r ON r.feature_id = receptor"""),
    "pathway_themes": (pathway_themes, None),
    "ligand_receptor_perm": (ligand_receptor_perm, None),
    "input_type": (input_type, f"WITH {_CMD} SELECT c_custkey, {_KIND} AS kind, CASE WHEN regexp_matches({_CLEAN}, '^(hello|thanks)\\b') THEN 'small talk' END AS reason FROM cmd"),
    "turn_types": (turn_types, f"SELECT role, {_KIND} AS kind, count(*) AS n FROM conversations GROUP BY 1, 2"),
    "param_extract": (param_extract, f"WITH {_CMD}, k AS (SELECT c_custkey, CAST(c_custkey % {len(SAMPLES)} AS INTEGER) AS k, CAST(c_custkey % 40 + 1 AS VARCHAR) AS n FROM cmd) SELECT c_custkey, CASE WHEN k = 2 THEN n END AS old_name, CASE WHEN k = 2 THEN 'Tubule cells' END AS new_name, CASE WHEN k = 5 THEN CAST(n AS DOUBLE) END AS min_features, CASE WHEN k = 5 THEN 12.0::DOUBLE END AS max_mito, CASE WHEN k = 6 THEN CAST(n AS INTEGER) END AS hvg, CASE WHEN k = 7 THEN 0.4::DOUBLE END AS min_dist, CASE WHEN k = 9 THEN 'pca' WHEN k IN (7, 12) THEN 'umap' WHEN k IN (1, 2) THEN 'clustering' WHEN k = 5 THEN 'cellFiltering' WHEN k = 6 THEN 'featureSelection' END AS step, CASE WHEN k = 8 THEN 's' || n END AS sample_a, CASE WHEN k = 8 THEN 's7' END AS sample_b, CASE WHEN k = 11 THEN 1 WHEN k IN (1, 2, 5, 6, 12) AND CAST(n AS INTEGER) <= 3 THEN CAST(n AS INTEGER) - 1 END AS choice FROM k"),
    "chained_commands": (chained_commands, f"WITH {_CMD}, p AS (SELECT c_custkey, regexp_replace(text, ', then | then |; then ', '\x01', 'g') AS t FROM cmd), q AS (SELECT c_custkey, string_split(replace(t, '; then ', '\x01'), '\x01') AS a FROM p) SELECT c_custkey, CAST(i - 1 AS INTEGER) AS place, rtrim(a[i], ';') AS command FROM (SELECT c_custkey, a, unnest(range(1, len(a) + 1)) AS i FROM q)"),
    "fuzzy_names": (fuzzy_names, "WITH n AS (SELECT p_partkey, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part) SELECT p_partkey, CAST(damerau_levenshtein(a, b) AS INTEGER) AS edits, length(a) + 1 >= 4 AS near FROM n"),
    "first_json": (first_json, "SELECT event_id, props AS json, CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER) AS k FROM events"),
    "salvaged_items": (salvaged_items, """SELECT event_id, CAST(2 AS INTEGER) AS n, '{"a": "}{"}' AS first, props AS second FROM events"""),
    "salvaged_nested": (salvaged_nested, r"""SELECT event_id, CAST(2 AS INTEGER) AS n, '{"a": {"b": [' || props || ', "}{\"{"], "c": {}}}' AS first, props AS second FROM events"""),
    "intent_linear": (intent_linear, "SELECT count(*) AS n, true AS beats_largest, true AS shares FROM embeddings"),
    "intent_cosine": (intent_cosine, f"WITH {_INTENT} SELECT src, intent, round(score, 6) + 0.0 AS score FROM sc"),
    "intent_softmax": (intent_softmax, f"WITH {_INTENT}, x AS (SELECT src, intent, exp(5 * score - max(5 * score) OVER (PARTITION BY src)) AS x FROM sc) SELECT src, intent, round(x / sum(x) OVER (PARTITION BY src), 6) + 0.0 AS p FROM x"),
    "ambiguity_flag": (ambiguity_flag, f"WITH {_INTENT}, r AS (SELECT *, lead(score) OVER (PARTITION BY src ORDER BY round(score, 9) DESC, intent) AS second, row_number() OVER (PARTITION BY src ORDER BY round(score, 9) DESC, intent) AS k FROM sc), c AS (SELECT src, intent, score < 0.6 AND score - coalesce(second, 0.0) < 0.15 AS unclear, score FROM r WHERE k = 1), d AS (SELECT src, intent, unclear, CASE WHEN unclear THEN least(score, 0.45) ELSE score END AS confidence FROM c) SELECT src, intent, unclear, round(CASE WHEN src % 2 = 0 THEN greatest(confidence, 0.75) ELSE least(confidence, 0.3) END, 6) + 0.0 AS confidence FROM d"),
}
