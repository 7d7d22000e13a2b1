"""The text operators' queries: whole tables, production parameters; and SQL for those it can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, conversation_repair, disclosure, jaccard_join, language_id, line_dedup, oracles, packing, pieces, quality_classifier, quality_rules, tokens, vector_codes, warc
from .shared import shared_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed_lines, kept_md5 (of the text that is left) of every document."""
    done = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_removed_lines", F.md5("text").alias("kept_md5"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.apply_policy(quality_rules.ledger(_table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similarity_components(_table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = tokens.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return tokens.length_histogram(counted)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.with_crc32(packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    files = warc.archives(pages, "page_id", "url", "html")
    records = warc.with_revisits(warc.convert(files), warc.convert(files, payloads=False))
    path = shared_path(spark, "warc")
    largest = pages.agg(F.max(F.octet_length("html"))).first()[0] or 0
    warc.write_warc(records, path, largest)
    read = warc.referred(warc.read_warc(spark, path).drop("payload"))
    return read.select(F.col("key").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = quality_classifier.remainder("doc_id", 4) == 2
    model = language_id.fit(docs.where(~held_out))
    return language_id.identify(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = quality_classifier.remainder("doc_id", 5) == 0
    model = quality_classifier.fit(docs, _table(spark, sf_dir, "labels").where(~held_out))
    scored = quality_classifier.score(docs, model)
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(_table(spark, sf_dir, "embeddings"))
    digest = F.lit(None if books is None else books.digest()).cast("string")
    found = vector_codes.with_label_errors(coded)
    return found.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", digest.alias("codebooks_sha256"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    repaired = conversation_repair.repair(conversation_repair.damaged(_table(spark, sf_dir, "conversations")))
    digest = F.sha2(conversation_repair.repaired_text(F.col("turns")), 256)
    return repaired.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", digest.alias("repaired_sha256"))


def op13_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = disclosure.find(_table(spark, sf_dir, "documents"))
    counts = [disclosure.number_of(k).alias(f"n_{k}") for k in disclosure.KINDS]
    removed = F.size(F.filter("terms", lambda s: s.removed)).cast("long").alias("n_removed")
    return found.select("doc_id", *counts, F.sha2(disclosure.named(F.col("base")), 256).alias("base_sha256"), disclosure.named(disclosure.all_spans()).alias("spans"), F.size("terms").cast("long").alias("n_terms"), removed)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_line_dedup, op2_quality_rules, op3_jaccard_join, op4_token_counts, op5_packing, op6_warc, op7_language_id, op8_ann, op9_piece_codec, op10_quality_classifier, op11_vector_codes, op12_conversation_repair, op13_disclosure)}


_SPACE = r"[\x20\x09-\x0D]"

ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": rf"""
        WITH lines AS (
            SELECT doc_id, i - 1 AS i, arr[i] AS line, regexp_replace(arr[i], '^{_SPACE}+|{_SPACE}+$', '', 'g') AS t
            FROM (SELECT doc_id, string_split(text, chr(10)) AS arr, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL)
        ), w AS (
            SELECT doc_id, i, t, lead(t, 1) OVER p AS t2, lead(t, 2) OVER p AS t3, lead(i, 1) OVER p AS i2, lead(i, 2) OVER p AS i3
            FROM lines WHERE t <> '' WINDOW p AS (PARTITION BY doc_id ORDER BY i)
        ), later AS (
            SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY t, t2, t3 ORDER BY doc_id, i) AS k FROM w WHERE t3 IS NOT NULL) WHERE k > 1
        ), gone AS (
            SELECT doc_id, i FROM later UNION SELECT doc_id, i2 FROM later UNION SELECT doc_id, i3 FROM later
        ), kept AS (
            SELECT l.doc_id, count(*) AS n_lines, count(g.i) AS n_removed_lines, md5(coalesce(string_agg(CASE WHEN g.i IS NULL THEN l.line END, chr(10) ORDER BY l.i), '')) AS kept_md5
            FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY l.doc_id
        )
        SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed_lines, 0) AS BIGINT) AS n_removed_lines, kept_md5
        FROM documents d LEFT JOIN kept USING (doc_id)
    """,
    "op2_quality_rules": r"""
        WITH words AS (
            SELECT doc_id, i, arr[i] AS w FROM (
                SELECT doc_id, arr, unnest(range(1, len(arr) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS arr FROM documents))
        ), counts AS (
            SELECT doc_id, count(*) AS n_words, sum(length(w)) AS word_chars, sum(length(regexp_replace(w, '[^#*$%&|<>]', '', 'g'))) AS n_symbols,
                sum(length(regexp_replace(w, '[^|]', '', 'g'))) AS n_bars, sum(length(regexp_replace(w, '[^!]', '', 'g'))) AS n_shouts, count(DISTINCT w) AS n_distinct
            FROM words GROUP BY doc_id
        ), lines AS (
            SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL
        ), dup AS (
            SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
        ), win AS (
            SELECT doc_id, i, w, lead(w,1) OVER p AS w1, lead(w,2) OVER p AS w2, lead(w,3) OVER p AS w3, lead(w,4) OVER p AS w4, lead(w,5) OVER p AS w5, lead(w,6) OVER p AS w6, lead(w,7) OVER p AS w7
            FROM words WINDOW p AS (PARTITION BY doc_id ORDER BY i)
        ), twice AS (
            SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w, w1, w2, w3, w4, w5, w6, w7) AS n FROM win WHERE w7 IS NOT NULL) WHERE n > 1
        ), covered AS (
            SELECT doc_id, sum(least(8, coalesce(following - i, 8))) AS n_repeat_words FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS following FROM twice) GROUP BY doc_id
        ), m AS (
            SELECT d.doc_id, coalesce(n_words, 0) AS n, coalesce(word_chars, 0) AS chars, coalesce(n_symbols, 0) AS symbols, coalesce(n_bars, 0) AS bars, coalesce(n_shouts, 0) AS shouts,
                coalesce(n_distinct, 0) AS n_distinct, coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS dups, coalesce(n_repeat_words, 0) AS repeats
            FROM documents d LEFT JOIN counts USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN covered USING (doc_id)
        ), b AS (
            SELECT *, CAST((CASE WHEN n < 20 THEN 1 ELSE 0 END) + (CASE WHEN 100 * repeats > 30 * n THEN 2 ELSE 0 END) + (CASE WHEN n > 100000 THEN 4 ELSE 0 END)
                + (CASE WHEN chars < 2 * n THEN 8 ELSE 0 END) + (CASE WHEN chars > 18 * n THEN 16 ELSE 0 END) + (CASE WHEN 10 * symbols > n THEN 32 ELSE 0 END)
                + (CASE WHEN 10 * dups > 5 * n_lines THEN 64 ELSE 0 END) + (CASE WHEN 10 * bars > n THEN 128 ELSE 0 END) + (CASE WHEN 10 * shouts > n THEN 256 ELSE 0 END)
                + (CASE WHEN n >= 50 AND 100 * n_distinct < 8 * n THEN 512 ELSE 0 END) AS BIGINT) AS fail_bits FROM m
        )
        SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(chars AS BIGINT) AS word_chars, CAST(symbols AS BIGINT) AS n_symbols, CAST(dups AS BIGINT) AS n_dup_lines,
            CAST(repeats AS BIGINT) AS n_repeat_words, n < 20 OR 100 * repeats > 30 * n AS base_failed, (fail_bits & 635) = 0 AS kept, fail_bits FROM b
    """,
}


def oracle_sql() -> dict[str, str]:
    return ORACLE_SQL | {"op11_vector_codes": oracles.vector_codes_sql(), "op12_conversation_repair": oracles.conversation_repair_sql(), "op13_disclosure": oracles.disclosure_sql()}
