import random

from pyspark.sql import functions as F

import corpus_pipeline
from lociframe.llm.shared import stored


def test_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_classifier", "language_id", "line_dedup", "near_duplicates", "packing"]


def test_stages_on_odd_rows(spark, tmp_path):
    rnd = random.Random(3)
    good = lambda: "\n".join(" ".join(rnd.choice(["river", "stone", "walks", "under", "light.", "over"]) for _ in range(12)) for _ in range(5))
    texts = [good() for _ in range(80)]
    rows = [(i, t, "en", "s", len(t), "x") for i, t in enumerate(texts)]
    rows += [(100 + i, "BUY!! $$$ | NOW!! " * 20, "en", "s", 1, "x") for i in range(40)]
    rows += [(200, texts[3], "en", "s", 1, "x"), (201, texts[4].replace("river", "lake", 1), None, None, None, None), (202, None, None, None, None, None), (203, "", "en", "s", 0, "x"), (None, texts[5], "en", "s", 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, __score string")
    docs = docs.withColumns({c: F.lit(7) for c in ("n_lines", "n_removed_lines", "__lang_pred", "__text", "__letters", "__id", "__gone", "__lines", "id", "sid")})
    labels = spark.createDataFrame([(r[0], int(r[0] < 100)) for r in rows if r[0] is not None and r[0] < 140], "doc_id long, quality int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    left = []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stored(stage(spark, docs, str(tmp_path)), name)
        left.append(docs.count())
        if name != "packing":
            assert docs.columns == before.columns
            ids = {r.doc_id for r in docs.select("doc_id").collect()}
            assert set(range(80)) - ids == set(), name
            assert docs.where("n_lines != 7 or n_removed_lines != 7 or __gone != 7 or sid != 7").isEmpty()
        if name == "quality_classifier":
            assert not ids & set(range(100, 140))
        if name == "language_id":
            assert not ids & {202, 203}
        if name == "line_dedup":
            assert 200 not in ids
        if name == "near_duplicates":
            assert not ids & {200}
    assert docs.agg({"length": "sum"}).first()[0] > 1000


def test_empty_documents(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
