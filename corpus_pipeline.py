"""The corpus pipeline: five stages from documents to packed training sequences.

Every stage takes (spark, docs, sf_dir), works on all rows of docs, and returns a DataFrame that is written
as Parquet and read again as the next stage's docs. Null texts count as empty; very long texts are judged
whole; of rows that repeat an id with the same text, and of near copies, one stays from the fourth stage on (an id
with unlike texts names several documents); rows with null ids pass the first four stages; extra columns, whatever their names, pass through all but the last.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.llm import jaccard_join, language_id, line_dedup, packing, quality_classifier
from lociframe.llm.shared import fresh, stored

#: The least quality score of documents that stay.
MIN_QUALITY = 0.3
#: Documents stay whose language is told with this score at least, in so many bits a byte at most.
MIN_LANGUAGE_SCORE = 0.3
MAX_BITS = 7.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores at MIN_QUALITY or more."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality_classifier.fit(docs, labels.where(quality_classifier.remainder("doc_id", 5) != 0))
    (score,) = fresh(docs.columns, "__score")
    scored = quality_classifier.score(docs, model, carry=tuple(docs.columns), out=score)
    return scored.where(F.col(score) >= MIN_QUALITY).select(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the identifier knows; those without a letter or in none of them go."""
    model = language_id.fit(docs.where(F.coalesce(quality_classifier.remainder("doc_id", 4) != 2, F.lit(True))))
    front = "__"
    while any(c.lower().startswith(front) for c in docs.columns):
        front += "_"
    told = language_id.identify(docs, model, carry=tuple(docs.columns), prefix=front)
    known = (F.col(front + "lang_pred") != language_id.UNKNOWN) & (F.col(front + "score") >= MIN_LANGUAGE_SCORE) & (F.col(front + "bits_per_byte") <= MAX_BITS)
    return (told.where(known) if model is not None else told).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that repeat a passage of three; documents of which nothing is left go."""
    names = docs.columns
    own = [c for c in names if c.lower() in ("n_lines", "n_removed_lines")]  # the operator's counts go by these names
    apart = dict(zip(own, fresh(names, *[c + "_" for c in own]), strict=True))
    done = line_dedup.dedup_lines(docs.withColumnsRenamed(apart)).where((F.col("n_removed_lines") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col("n_removed_lines") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return done.select(*[F.col(apart.get(c, c)).alias(c) for c in names])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near duplicates."""
    return jaccard_join.one_of_each(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document in a sequence."""
    return packing.with_crc32(packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality), ("language_id", language), ("line_dedup", lines), ("near_duplicates", near_duplicates), ("packing", pack),
]

#: Tokenising, scoring and packing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
