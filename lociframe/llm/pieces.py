"""Subword encoding and decoding by vectorised merge rounds.

The vocabulary is a byte-fallback BPE model file of the sentencepiece library with an identity
normaliser and a dummy prefix. No piece holds the space mark after another character, and characters
that are in no longer piece never merge, so a text splits into words that are encoded once each. In a
round every unfinished word finds its best-ranked adjacent pair and merges the leftmost of the
non-overlapping pairs with that rank at once; where the merged piece could at once take part in a pair
of better rank, only the leftmost pair merges. Rounds go on until no word has a pair.

Null texts are empty: begin and end ids only. Very long texts are encoded whole. Repeated rows give equal results; null ids and extra columns
pass through; an empty table gives an empty result.
"""

from __future__ import annotations

import codecs
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .shared import WORD_BLOCK, fresh, short_batches, spread, text_blocks, together
from .word_cache import WordTable, span_strings

MARK = "▁"
NONE = np.int64(1) << 40

codecs.register_error("lociframe_each_byte", lambda e: ("�" * (e.end - e.start), e.end))


class PieceModel:
    """The tables of a vocabulary, and encode and decode on flat arrays."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        probe = f" a  b{MARK} "
        if sp.decode(sp.encode(probe)) != probe.replace(MARK, " "):
            raise ValueError("only models with an identity normaliser, a dummy prefix and byte fallback are supported")
        pieces = [sp.id_to_piece(i).replace(MARK, " ") for i in range(n)]
        self.begin, self.end = sp.bos_id(), sp.eos_id()
        special = [sp.is_control(i) or sp.is_unknown(i) for i in range(n)]
        is_byte = [sp.is_byte(i) for i in range(n)]
        normal = {p: i for i, p in enumerate(pieces) if not (special[i] or is_byte[i] or sp.is_unused(i))}
        self.byte_ids = np.zeros(256, np.int64)
        for i in np.flatnonzero(is_byte):
            self.byte_ids[int(pieces[i][3:5], 16)] = i
        # symbols: pieces by their id, then characters that are in pieces but are none themselves
        symbols = dict(normal)
        for c in sorted({c for p in normal for c in p} - set(normal)):
            symbols[c] = n + len(symbols) - len(normal)
        self.n_ids = n
        self.width = n + len(symbols) - len(normal) + 1
        self.char_symbols = np.full(0x110000, -1, np.int32)
        for c in symbols:
            if len(c) == 1:
                self.char_symbols[ord(c)] = symbols[c]
        _, rank = np.unique([-sp.get_score(i) for i in range(n)], return_inverse=True)
        pairs = sorted((symbols[p[:k]] * self.width + symbols[p[k:]], i) for p, i in normal.items() for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols)
        self.pair_keys, self.pair_ids = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        self.likely = np.zeros(1 << 22, bool)
        self.likely[self.slot(self.pair_keys)] = True
        self.rank = rank.astype(np.int64)
        self.alone = np.zeros(self.width, bool)  # pieces that may pair at once with a better rank
        for side in (self.pair_keys // self.width, self.pair_keys % self.width):
            inside = side < n
            worse = inside & (rank[self.pair_ids] <= rank[np.minimum(side, n - 1)])
            self.alone[side[worse]] = True
        self.split_lines = not any("\n" in p for p in normal)
        if any(" " in p.lstrip(" ") for p in normal):
            raise ValueError("pieces across words aren't supported")
        texts = [b"" if special[i] else bytes([int(pieces[i][3:5], 16)]) if is_byte[i] else pieces[i].encode() for i in range(n)]
        texts[sp.unk_id()] = " ⁇ ".encode()
        self.text_bytes = np.frombuffer(b"".join(texts), np.uint8)
        self.text_sizes = np.array([len(t) for t in texts], np.int64)
        self.text_starts = np.concatenate(([0], np.cumsum(self.text_sizes)[:-1]))
        self.starts_word = np.array([p.startswith(" ") for p in pieces])
        self.table = WordTable(self.encode_words)

    @staticmethod
    def slot(key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The piece of each pair of symbols and its rank, NONE without one."""
        key = left * self.width + right
        some = np.flatnonzero(self.likely[self.slot(key)] & (left >= 0) & (right >= 0))
        at = np.minimum(np.searchsorted(self.pair_keys, key[some]), len(self.pair_keys) - 1)
        real = self.pair_keys[at] == key[some]
        merged, rank = np.zeros(len(key), np.int64), np.full(len(key), NONE)
        merged[some[real]] = self.pair_ids[at[real]]
        rank[some[real]] = self.rank[merged[some[real]]]
        return merged, rank

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after another and the number of ids of each."""
        chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        symbol = self.char_symbols[chars].astype(np.int64)
        word, place = np.repeat(np.arange(len(words)), sizes), np.arange(len(chars))
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(symbol):
            inner = word[:-1] == word[1:]
            merged, rank = self.pair(symbol[:-1], symbol[1:])
            rank = np.append(np.where(inner, rank, NONE), NONE)
            first = np.flatnonzero(np.concatenate(([True], ~inner)))
            best = np.minimum.reduceat(rank, first)
            sizes = np.diff(np.append(first, len(symbol)))
            going = np.repeat(best < NONE, sizes)
            if not going.all():
                stop = ~going
                done.append((word[stop], place[stop], symbol[stop]))
                best, sizes = best[best < NONE], sizes[best < NONE]
                symbol, word, place, rank, merged = symbol[going], word[going], place[going], rank[going], np.append(merged, 0)[going]
                if not len(symbol):
                    break
                first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            else:
                merged = np.append(merged, 0)
            hit = rank == np.repeat(best, sizes)
            index = np.arange(len(hit))
            run = np.maximum.accumulate(np.where(hit & ~np.concatenate(([False], hit[:-1])), index, 0))
            take = hit & ((index - run) % 2 == 0)
            single = take & self.alone[merged]
            if single.any():
                seen = np.cumsum(take)
                nth = seen - np.repeat(seen[first] - take[first], sizes)
                lone = np.zeros(len(first), bool)
                lone[np.repeat(np.arange(len(first)), sizes)[single]] = True
                take &= ~np.repeat(lone, sizes) | (nth == 1)
            symbol = np.where(take, merged, symbol)
            keep = ~np.concatenate(([False], take[:-1]))
            symbol, word, place = symbol[keep], word[keep], place[keep]
        if not done:
            return np.zeros(0, np.uint32), np.zeros(len(words), np.int64)
        word, place, symbol = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(place, kind="stable")
        word, place, symbol = word[order], place[order], symbol[order]
        # characters that are no piece become the ids of their UTF-8 bytes
        lost = (symbol < 0) | (symbol >= self.n_ids)
        count = np.ones(len(symbol), np.int64)
        raw = [chr(c).encode() for c in chars[place[lost]]]
        count[lost] = [len(x) for x in raw]
        ids = np.repeat(symbol, count)
        ids[np.repeat(lost, count)] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        return ids.astype(np.uint32), np.bincount(word, count, minlength=len(words)).astype(np.int64)

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """The words of texts, spaces before the word they belong to and one more in front of a text; the row of each."""
        sizes = np.diff(offsets)
        rows = np.repeat(np.arange(len(sizes)), sizes)
        front = np.cumsum(sizes > 0)  # one space for each text that isn't empty
        padded = np.full(len(data) + (front[-1] if len(front) else 0), 32, np.uint8)
        padded[np.arange(len(data)) + front[rows]] = data
        starts = offsets[:-1] + np.concatenate(([0], front[:-1]))
        new = np.zeros(len(padded) + 1, bool)
        space, line = padded == 32, padded == 10
        new[1:-1] = space[1:] & ~space[:-1]
        if self.split_lines:
            new[:-1] |= line
            new[1:] |= line
        new[starts] = True
        begins = np.flatnonzero(new[:-1])
        filled = np.flatnonzero(sizes > 0)
        return span_strings(padded, begins, np.append(begins[1:], len(padded))[: len(begins)]), filled[np.searchsorted(starts[filled], begins, "right") - 1]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, with begin and end ids, and where each text's ids begin (and the last end)."""
        texts = pc.replace_substring(pc.fill_null(texts, ""), MARK, " ")
        all_ids, all_sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for low, high, data, offsets in text_blocks(texts, WORD_BLOCK):
            words, rows = self.words(data, offsets)
            ids, lengths = self.table.look_up(words)
            all_ids.append(ids)
            all_sizes.append(np.bincount(rows, lengths, minlength=high - low).astype(np.int64))
        ids, ends = np.concatenate(all_ids), np.concatenate(([0], np.cumsum(np.concatenate(all_sizes))))
        k = np.arange(len(texts) + 1)
        out = np.full(len(ids) + 2 * len(texts), self.begin, np.uint32)
        out[np.arange(len(ids)) + 2 * np.repeat(k[:-1], np.diff(ends)) + 1] = ids
        out[ends[1:] + 2 * k[1:] - 1] = self.end
        return out, ends + 2 * k

    def decode(self, ids: np.ndarray, starts: np.ndarray) -> Iterator[str]:
        """The text of each run of ids; the space that the dummy prefix made is left out."""
        sizes = self.text_sizes[ids]
        data = self.text_bytes[spread(self.text_starts[ids], sizes)]
        ends = np.concatenate(([0], np.cumsum(sizes)))[starts]
        for k in range(len(starts) - 1):
            own = ids[starts[k] : starts[k + 1]]
            shown = np.flatnonzero(self.text_sizes[own[:8]])
            cut = bool(len(shown)) and self.starts_word[own[shown[0]]]
            yield data[ends[k] + cut : ends[k + 1]].tobytes().decode(errors="lociframe_each_byte")


@lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


def encode(docs: DataFrame, path: str, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns to carry and ids, an array of the text's ids with begin and end; a column to carry of that name gives way."""
    carry = tuple(c for c in carry if c.lower() != "ids")
    (text,) = fresh(list(carry), "__text")
    short_batches(docs.sparkSession)
    step = docs.select(*carry, F.col(text_col).cast("string").alias(text))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        for batch in together(it):
            ids, starts = model.encode(batch.column(text).combine_chunks())
            lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids.astype(np.int32)))
            yield from pa.table({c: batch.column(c) for c in carry} | {"ids": lists}).combine_chunks().to_batches()

    return step.mapInArrow(run, docs.select(*carry).schema.add("ids", ArrayType(IntegerType())))


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns to carry and text, decoded from the array of ids (null ids: null); a column to carry of that name gives way."""
    carry = tuple(c for c in carry if c.lower() != "text")
    (ids_name,) = fresh(list(carry), "__ids")
    short_batches(encoded.sparkSession)
    step = encoded.select(*carry, F.col(ids_col).alias(ids_name))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        for batch in together(it):
            ids = batch.column(ids_name).combine_chunks()
            sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
            texts = model.decode(ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate(([0], np.cumsum(sizes))))
            texts = [None if gone else t for t, gone in zip(texts, ids.is_null().to_pylist(), strict=True)]
            yield from pa.table({c: batch.column(c) for c in carry} | {"text": pa.array(texts, pa.string())}).combine_chunks().to_batches()

    return step.mapInArrow(run, encoded.select(*carry).schema.add("text", "string"))


def round_trip_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit integers) and decoded_sha256 of every
    row, encoding and decoding in one pass so that ids never leave the task."""
    short_batches(docs.sparkSession)
    step = docs.select(id_col, F.col(text_col).cast("string").alias("__text"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        for batch in together(it):
            ids, starts = model.encode(batch.column("__text").combine_chunks())
            raw = ids.astype("<u4")
            yield from pa.table({
                id_col: batch.column(id_col),
                "n_tokens": np.diff(starts).astype(np.int64),
                "ids_sha256": [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(starts[:-1], starts[1:], strict=True)],
                "decoded_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in model.decode(ids, starts)],
            }).combine_chunks().to_batches()

    return step.mapInArrow(run, docs.select(id_col).schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string"))
