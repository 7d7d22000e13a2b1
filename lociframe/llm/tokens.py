"""Encoders of public vocabularies, and the exact length histogram.

The paths of vocabulary files are parameters. Encoders are kept by each Python worker.

token_lengths: null texts have no tokens (length 0), like empty ones. Repeated rows count as often as
they occur, very long texts at full length, ties in length in one row; extra columns are not read; an empty table gives an empty histogram.
"""

from __future__ import annotations

import itertools
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD_BLOCK, fresh, lower_ascii, short_batches, text_blocks, word_spans
from .word_cache import WordTable, span_strings

#: Classes of bytes by which such a vocabulary's pre-tokeniser parts a word: letters, digits, marks (no apostrophe, which
#: may begin a contraction); 0: any other, next to which words stay whole.
_CLASS = np.zeros(256, np.uint8)
_CLASS[97:123], _CLASS[48:58] = 1, 2
_CLASS[[c for c in range(33, 127) if not chr(c).isalnum() and c != 39]] = 3
#: First byte of the capital sigma, whose small form depends on what follows.
_SIGMA = 0xCE


def parted(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words parted where letters, digits and marks meet, and around every digit."""
    kind = _CLASS[data]
    left, right = kind[:-1], kind[1:]
    cut = np.zeros(len(data) + 1, bool)
    cut[1:-1] = (left > 0) & (right > 0) & ((left != right) | (left == 2))
    for word in np.unique(np.searchsorted(begins, np.flatnonzero(data == _SIGMA), "right") - 1):
        cut[begins[word] + 1 : ends[word]] = False
    inside = np.flatnonzero(cut)
    if not len(inside) or not len(begins):
        return begins, ends, rows
    of = np.searchsorted(begins, inside, "right") - 1
    keep = (of >= 0) & (inside > begins[of]) & (inside < ends[of])
    inside, of = inside[keep], of[keep]
    return np.sort(np.concatenate((begins, inside))), np.sort(np.concatenate((ends, inside))), np.sort(np.concatenate((rows, rows[of])))


@lru_cache(maxsize=2)
def lower_word_encoder(path: str) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]:
    """Ids by the tokenizers library of a vocabulary that lower-cases and drops white space: a function of
    an array of texts that returns all ids and where each text's ids begin (and the last end).

    White space ends a word for its pre-tokeniser and its normaliser works on one word at a time, so a
    text's ids are those of its words; each distinct word is encoded once. Texts that may hold one of the
    vocabulary's special tokens are encoded whole."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)

    def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [x.ids for x in tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(lengths.sum())), lengths

    table = WordTable(encode)

    def run(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        all_ids, all_sizes = [], []
        for low, high, data, offsets in text_blocks(texts, WORD_BLOCK):
            data = lower_ascii(data)
            begins, ends, rows = word_spans(data, offsets)
            begins, ends, rows = parted(data, begins, ends, rows)
            ids, lengths = table.look_up(span_strings(data, begins, ends))
            sizes = np.bincount(rows, lengths, minlength=high - low).astype(np.int64)
            if (special := pc.match_substring(texts.slice(low, high - low), "<|")).true_count:
                parts = np.split(ids, np.cumsum(sizes)[:-1])
                for k in np.flatnonzero(pc.fill_null(special, False)):
                    parts[k] = np.array(tokenizer.encode(texts[low + k].as_py(), add_special_tokens=False).ids, np.uint32)
                ids, sizes = np.concatenate(parts), np.array([len(x) for x in parts], np.int64)
            all_ids.append(ids)
            all_sizes.append(sizes)
        if not all_ids:
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        return np.concatenate(all_ids), np.concatenate(([0], np.cumsum(np.concatenate(all_sizes))))

    return run


@lru_cache(maxsize=2)
def rank_encoder(path: str, pattern: str):
    """A tiktoken encoding of a vocabulary file of ranks."""
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, path: str, pattern: str, text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """The columns to carry and n_tokens of every row; a column to carry of that name gives way."""
    short_batches(docs.sparkSession)
    carry = tuple(c for c in carry if c.lower() != "n_tokens")
    (text,) = fresh(list(carry), "__text")
    step = docs.select(*carry, F.col(text_col).cast("string").alias(text))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = rank_encoder(path, pattern)
        for batch in it:
            n = np.fromiter((len(encoder.encode_ordinary(t or "")) for t in batch.column(text).to_pylist()), np.int64, len(batch))
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in carry} | {"n_tokens": n})

    return step.mapInArrow(run, docs.select(*carry).schema.add("n_tokens", "long"))


def length_histogram(counted: DataFrame) -> DataFrame:
    """A row for each length that occurs: n_tokens, n_docs, and over the documents at least as long docs_at_least
    and tokens_at_least; docs_up_to; truncated_total, the tokens left when all documents are cut to n_tokens."""
    table = counted.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))
    # the histogram has one row a length, however many documents there are
    down = Window.orderBy(F.desc("n_tokens"))
    table = table.withColumns({"docs_at_least": F.sum("n_docs").over(down), "tokens_at_least": F.sum(F.col("n_docs") * F.col("n_tokens")).over(down)})
    whole = Window.orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum(F.col("n_docs") * F.col("n_tokens")).over(whole), F.lit(0))
    up = F.sum("n_docs").over(Window.orderBy("n_tokens"))
    return table.withColumns({"docs_up_to": up, "truncated_total": below + F.col("docs_at_least") * F.col("n_tokens")})


def limit_report(histogram: DataFrame, limits: DataFrame, limit_col: str = "context_limit") -> DataFrame:
    """For each context limit: documents longer, tokens in all, tokens left after cutting. From the histogram alone."""
    rows = histogram.select("n_tokens", "n_docs")
    cut = F.least("n_tokens", F.col(limit_col))
    # limits is a short list the caller gives; each meets the histogram, not the documents
    return limits.select(limit_col).distinct().join(F.broadcast(rows), F.lit(True), "left").groupBy(limit_col).agg(
        F.coalesce(F.sum(F.when(F.col("n_tokens") > F.col(limit_col), F.col("n_docs")).otherwise(0)), F.lit(0)).alias("docs_over"),
        F.coalesce(F.sum(F.col("n_docs") * F.col("n_tokens")), F.lit(0)).alias("total_tokens"),
        F.coalesce(F.sum(F.col("n_docs") * cut), F.lit(0)).alias("truncated_tokens"),
    )


def length_quantile(histogram: DataFrame, q: float) -> DataFrame:
    """One row, n_tokens: the smallest length that at least the share q of the documents does not exceed."""
    total = histogram.agg(F.sum("n_docs").alias("total"))
    return histogram.join(F.broadcast(total), F.col("docs_up_to") >= F.col("total") * q).agg(F.min("n_tokens").alias("n_tokens"))
