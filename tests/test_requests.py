"""Requests in plain text: what is found by joins, chains of commands, the gate, parameters."""

import pytest
from pyspark.sql import functions as F

from lociframe.functions import places
from lociframe.functions import text as tx
from lociframe.operators import requests as rq


def test_places(spark):
    texts = ["", "ab é ab", "aab" * 700, "no", "𝒳ab𝒳ab"]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select("t", places.placed(F.col("t"), "ab").alias("p")).collect()
    import re

    for r in found:
        assert [(p.m, p.start) for p in r.p] == [(x[0], x.start()) for x in re.finditer("ab", r.t)]


def test_entities(spark):
    said = ["plot nphs2 and WT1 in podocyte", "is podocyte near Tubule, tubule and TUBULE?", "show genes max, max", "PLOT MAX NOW PLEASE", "plot MAX", "gene a of chr1:100-200", "violin podocin", None, "podocin podocin", "x 7 it 3.5 PDF gene pdf"]
    genes = spark.createDataFrame([(g,) for g in ("Nphs2", "NPHS2b", "WT1", "MAX", "A", "X", "7", "It", "pdf", "podocin", "")], "name string")
    labels = spark.createDataFrame([("Podocyte", 3), ("tubule", 5), ("Tubule", 1), ("Podocin", 9), (None, 4)], "label string, cluster int")
    found = {r.id: r for r in rq.entities(spark.createDataFrame(list(enumerate(said)), "id long, text string"), genes, labels).collect()}
    told = {i: ([(g.symbol, g.start) for g in r.genes], [(c.text, list(c.ids), c.start) for c in r.clusters], r.masked) for i, r in found.items()}
    assert told[0] == ([("Nphs2", 5), ("WT1", 15)], [("podocyte", [3], 22)], "plot gene in cluster")
    assert told[1] == ([], [("podocyte", [3], 3), ("Tubule", [1, 5], 17), ("tubule", [1, 5], 25), ("TUBULE", [1, 5], 36)], "is cluster near cluster?")
    assert told[2][0] == [("MAX", 11)] and told[3][0] == [] and told[4][0] == [("MAX", 5)]
    assert told[5] == ([("A", 5), ("chr1:100-200", 10)], [], "gene of gene")
    assert told[6] == ([("podocin", 7)], [], "violin gene") and told[7] == ([], [], "") and told[8] == ([], [("podocin", [9], 0), ("podocin", [9], 8)], "cluster")
    assert told[9][0] == [("pdf", 20)]
    guessed = rq.entities(spark.createDataFrame([(1, "plot abc12 and max")], "id long, text string")).first()
    assert [(g.text, g.guessed) for g in guessed.genes] == [("abc12", True)] and guessed.clusters == []


def test_what_stands_before_a_name_is_looked_at_only_where_it_decides(spark):
    texts = ["é" * 50 + " gene max", "gene" + " " * 39 + "max", "gene" + " " * 34 + "max", "show podocin", "show" + " " * 45 + "podocin"]
    genes = spark.createDataFrame([("MAX",), ("podocin",)], "name string")
    labels = spark.createDataFrame([("Podocin", 9)], "label string, cluster int")
    found = rq.entities(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), genes, labels)
    told = {r.id: ([g.symbol for g in r.genes], [c.text for c in r.clusters]) for r in found.collect()}
    assert told == {0: (["MAX"], []), 1: ([], []), 2: (["MAX"], []), 3: (["podocin"], []), 4: ([], ["podocin"])}
    assert "before" not in found._jdf.queryExecution().optimizedPlan().toString()  # no such text for each token


def test_running_sums(spark):
    sums = [[], [5], [3, -1, 2], list(range(70)), [1] * 5000]
    found = spark.createDataFrame([(x,) for x in sums], "x array<bigint>").select("x", places.running(F.col("x")).alias("s")).collect()
    import itertools

    assert all(r.s == list(itertools.accumulate(r.x)) for r in found)


def test_the_gate_tidies_a_text_once(spark):
    gated = spark.createDataFrame([("what is",)], "t string").select(tx.non_command(F.col("t")).alias("why"))
    assert gated._jdf.queryExecution().optimizedPlan().toString().count("lower(") <= 1 and gated.first().why == "question"


def test_spelling(spark):
    said = ["Shwo the clsuter  5,", "rename clutser 3 to Clsuter plott", "rename cluster 3 to Clsuter plott", "vln plots of Gene", "how now market lsit of gnees!", "make it brigth x1y plott2", "", None, "Parametres", "dim plot featureplot"]
    found = {r.id: r.text for r in rq.corrected(spark.createDataFrame(list(enumerate(said)), "id long, text string")).collect()}
    assert [found[i] for i in range(10)] == ["Show the cluster 5", "rename cluster 3 to Cluster plot", "rename cluster 3 to Clsuter plott", "violin plot of Gene", "how now market list of genes", "marker it brigth x1y plott2", "", "", "Parameters", "umap plot feature plot"]


@pytest.mark.parametrize("said, want", [
    ("rename cluster 1, 2 and 3 to Tubule cells", ["rename cluster 1 to Tubule cells", "rename cluster 2 to Tubule cells", "rename cluster 3 to Tubule cells"]),
    ("rename cluster 1 to A, then cluster 2 to B, then plot umap", ["rename cluster 1 to A", "rename cluster 2 to B", "plot umap"]),
    ("rename cluster 1 to A and cluster 2 to B and cluster 3 to C", ["rename cluster 1 to A", "rename cluster 2 to B", "rename cluster 3 to C"]),
    ("can you plot NPHS2 and WT1", ["can you plot NPHS2 and WT1"]),
    ("dotplot for a1 and b1 then plot umap", ["dotplot for a1 and b1 then plot umap"]),
    ("plot umap then x", ["plot umap then x"]),
    ("find markers of 1, then show qc plots", ["find markers of 1", "show qc plots"]),
    ("rerun steps with 20 pcs and plot umap", ["rerun steps with 20 pcs", "plot umap"]),
    ("", [""]),
    ("can you rename cluster 1 to Then then cluster 2 to then too", ["can you rename cluster 1 to Then", "rename cluster 2 to then too"]),
    ("rename cluster 1, cluster 2 and cluster 9 to then and then run umap", ["rename cluster 1 to then", "rename cluster 2 to then", "rename cluster 9 to then", "run umap"]),
])
def test_commands(spark, said, want):
    assert spark.createDataFrame([(said,)], "t string").select(rq.commands(F.col("t"))).first()[0] == want


def test_gate(spark):
    said = {
        "": "empty", "hello there": "small talk", "run rna velocity": "unsupported:estimate RNA velocity", "what is the role of nphs2": "gene knowledge", "why is that so": "question",
        "how do i plot": "how-to question", "what is in cluster 3": None, "tell me a joke": "general chat", "plot umap": None, "how many cells are there?": "question", "how many cells in cluster 2": None,
        "which settings are being used": None, "is nphs2 expressed": None, "is nphs2 nice": "question", "hi, please plot umap": None,
    }
    rows = spark.createDataFrame([(t,) for t in said], "t string").select("t", tx.non_command(F.col("t")).alias("why"), tx.on_topic(F.col("t")).alias("on")).collect()
    assert {r.t: r.why for r in rows} == said
    assert {r.t for r in rows if not r.on} == {"", "hello there", "why is that so", "tell me a joke"}


def test_parameters(spark):
    t = F.col("t")
    rows = {r.t: r for r in spark.createDataFrame([(x,) for x in (
        "Rename cluster 3 to “Tubule cells”.", "rename Old to New", "rename cluster 1 to a and cluster 2 to b", "update region x's name as the Cortex", "use 2000 variable genes", "500 genes and 5% mito", "hvgs: like 1500",
        "min dist .25", "compare a with b in cluster 4", "between the liver and kidney for cluster 2", "call cluster 4 it", "1000 umis, mt 1000",
    )], "t string").select("t", tx.rename(t, F.array(F.lit("old"))).alias("r"), tx.cell_filter(t).alias("f"), tx.hvg_count(t).alias("h"), tx.min_dist(t).alias("d"), tx.sample_pair(t).alias("p"), tx.sample_pair(t, ("Kidney", "liver")).alias("k")).collect()}
    assert tuple(rows["Rename cluster 3 to “Tubule cells”."].r) == ("cluster", "3", "Tubule cells") and tuple(rows["rename Old to New"].r) == ("cluster", "Old", "New")
    assert rows["rename cluster 1 to a and cluster 2 to b"].r is None and rows["call cluster 4 it"].r is None and tuple(rows["update region x's name as the Cortex"].r) == ("region", "x's", "Cortex")
    assert rows["use 2000 variable genes"].h == 2000 and rows["use 2000 variable genes"].f.min_features is None and rows["hvgs: like 1500"].h == 1500 and rows["min dist .25"].d == 0.25
    assert tuple(rows["500 genes and 5% mito"].f) == (500.0, None, 5.0) and tuple(rows["1000 umis, mt 1000"].f)[1] is None
    assert tuple(rows["compare a with b in cluster 4"].p) == ("a", "b") and tuple(rows["between the liver and kidney for cluster 2"].p) == ("liver", "kidney") and tuple(rows["between the liver and kidney for cluster 2"].k) == ("liver", "Kidney")


def test_whole_items(spark):
    said = {
        '[{"a": 1}, {"b": {"c": [{}]}}, {"d": ': ['{"a": 1}', '{"b": {"c": [{}]}}'], "none": [], '{"x": "}{"} {"y": "\\"}"}': ['{"x": "}{"}', '{"y": "\\"}"}'],
        '{"bad": ,} {"ok": 2}': ['{"ok": 2}'], '{"open': [], "": [], '} {"a": 1} {"b": 2}': ['{"b": 2}'],
    }
    rows = spark.createDataFrame([(t,) for t in said], "t string").select("t", tx.whole_items(F.col("t")).alias("w")).collect()

    def brute(text):
        import json

        items, depth, start, inside, skip = [], 0, -1, False, False
        for i, c in enumerate(text):
            if skip:
                skip = False
            elif c == "\\":
                skip = True
            elif c == '"':
                inside = not inside
            elif not inside and c == "{":
                start = i if depth == 0 else start
                depth += 1
            elif not inside and c == "}":
                depth -= 1
                if depth == 0 and start >= 0:
                    try:
                        json.loads(text[start : i + 1])
                        items.append(text[start : i + 1])
                    except ValueError:
                        pass
                    start = -1
        return items

    assert {r.t: r.w for r in rows} == {t: brute(t) for t in said}
    assert brute('[{"a": 1}, {"b": {"c": [{}]}}, {"d": ') == said['[{"a": 1}, {"b": {"c": [{}]}}, {"d": ']


def test_linear_scorer(spark):
    import numpy as np

    from lociframe.operators import algebra

    rng = np.random.default_rng(2)
    centres = rng.normal(size=(4, 6)) * 2
    rows = [(i, [float(a) for a in centres[i % 4] + rng.normal(size=6) * 0.5], i % 4) for i in range(200)]
    w, b = algebra.fit_softmax(spark.createDataFrame([([*v, float(k)],) for _, v, k in rows], "vec array<double>"), 4)
    found = {r.id: r for r in algebra.softmax_scores(spark.createDataFrame([r[:2] for r in rows], "id long, vec array<double>"), w, b).collect()}
    assert sum(found[i].best == k for i, _, k in rows) >= 196 and all(0.25 <= r.confidence <= 1 for r in found.values())
