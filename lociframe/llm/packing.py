"""Sum-of-squares online packing of token sequences.

Each task packs the documents of its partition as they come. Full windows are cut off a document first;
the rest goes to the fill level h, or into a new window (h = 0), for which the sum of the squared counts
of partially filled windows grows least, that is where N(h + s) - N(h) is smallest (ties to the fullest
window). A level array counts and holds the open windows. At the end of a partition the gaps of the fuller
open windows are filled with the contents of the emptiest ones, cut where a gap ends, so only as many tokens
move as the gaps hold; the one window left over is cut at powers of two, which need no padding.

A null text is an empty document of the end id alone. A very long text fills windows of its own but for its
rest. Repeated rows are packed as often as they occur; null ids and extra columns pass through; an empty
table gives no piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .shared import short_batches, together
from .tokens import lower_word_encoder

CAPACITY = 2048
END_ID = 1


class Levels:
    """The open windows of one partition by fill level."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, np.int64)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def place(self, size: int) -> int:
        """The level, 0 for a new window, to put size tokens at."""
        at, after = self.count[: self.capacity - size + 1], self.count[size:]
        grow = np.where(at > 0, 2 * (after - at) + 2, np.iinfo(np.int64).max)
        grow[-1] -= (at[-1] > 0) * 1  # a full window leaves the count
        grow[0] = 2 * after[0] + 1
        return int(len(grow) - 1 - grow[::-1].argmin())

    def take(self, level: int) -> int:
        self.count[level] -= 1
        return self.open[level].pop()

    def put(self, window: int, level: int) -> None:
        self.count[level] += 1
        self.open[level].append(window)


def powers_of_two(n: int) -> list[int]:
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


def pack_partition(sizes: Iterator[int], capacity: int = CAPACITY) -> Iterator[tuple[int, int, int, int, int]]:
    """(document number, start, length, window, offset) of each piece; windows number from 0.

    Pieces of full windows come as soon as these are full; memory holds the open windows only."""
    levels, held, windows = Levels(capacity), {}, 0
    for doc, n in enumerate(sizes):
        start = 0
        while n - start >= capacity:
            yield doc, start, capacity, windows, 0
            windows, start = windows + 1, start + capacity
        size = n - start
        if not size:
            continue
        level = levels.place(size)
        if level:
            window = levels.take(level)
        else:
            window, windows = windows, windows + 1
            held[window] = []
        held[window].append((doc, start, size))
        if level + size == capacity:
            yield from _closed(held.pop(window), window)
        else:
            levels.put(window, level + size)
    yield from _level_out([(w, held[w]) for level in range(capacity, 0, -1) for w in levels.open[level]], windows, capacity)


def _level_out(rest: list[tuple[int, list]], windows: int, capacity: int) -> Iterator[tuple[int, int, int, int, int]]:
    """The open windows, fullest first: gaps filled from the emptiest, the last one cut at powers of two into new windows."""
    i, j = 0, len(rest) - 1
    while i < j:
        window, pieces = rest[i]
        room = capacity - sum(p[2] for p in pieces)
        while room and i < j:
            doc, start, size = rest[j][1].pop()
            n = min(size, room)
            if n < size:
                rest[j][1].append((doc, start, size - n))
            pieces.append((doc, start + size - n, n))
            room -= n
            j -= not rest[j][1]
        if not room:
            yield from _closed(pieces, window)
            i += 1
    if i == j:
        pieces = rest[i][1]
        targets = powers_of_two(sum(p[2] for p in pieces))
        fill, room = [], targets.pop(0)
        for doc, start, size in pieces:
            while size:
                n = min(size, room)
                fill.append((doc, start, n))
                start, size, room = start + n, size - n, room - n
                if not room:
                    yield from _closed(fill, windows)
                    fill, windows, room = [], windows + 1, targets.pop(0) if targets else 0


def _closed(pieces: list[tuple[int, int, int]], window: int) -> Iterator[tuple[int, int, int, int, int]]:
    offset = 0
    for doc, start, n in pieces:
        yield doc, start, n, window, offset
        offset += n


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """A row for each piece: id, start, length, ids (its tokens), doc_tokens, sequence_id, offset.

    sequence_id holds the partition's number in its high bits, so tasks need not agree on a counter."""
    short_batches(docs.sparkSession)
    step = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"), F.spark_partition_id().alias("__part"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = lower_word_encoder(tokenizer)
        part, live, counts = 0, {}, {}

        def sizes() -> Iterator[int]:
            nonlocal part
            number = 0
            for held in together(it):
                part, texts, names = held.column("__part")[0].as_py(), held.column("__text").combine_chunks(), held.column(id_col)
                found, starts = encode(texts)
                for k, name in enumerate(names.to_pylist()):
                    ids = np.append(found[starts[k] : starts[k + 1]], np.uint32(end_id)).astype("<u4")
                    live[number], counts[number] = (name, ids), len(ids)
                    yield len(ids)
                    number += 1

        out: list[tuple] = []
        for doc, start, n, window, offset in pack_partition(sizes(), capacity):
            name, ids = live[doc]
            out.append((name, start, n, ids[start : start + n].tobytes(), len(ids), part << 33 | window, offset))
            counts[doc] -= n
            if not counts[doc]:
                del live[doc], counts[doc]
            if len(out) >= 2000:
                yield _batch(out, schema)
                out = []
        if out:
            yield _batch(out, schema)

    fields = step.select(id_col).schema.add("start", "long").add("length", "long").add("ids", "binary").add("doc_tokens", "long").add("sequence_id", "long").add("offset", "long")
    schema = to_arrow_schema(fields)
    return step.mapInArrow(run, fields)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def with_crc32(pieces: DataFrame) -> DataFrame:
    """ids_crc32 in place of the ids."""
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")

