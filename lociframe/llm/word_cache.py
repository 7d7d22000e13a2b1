"""Encoding by distinct word: a bounded table of the words seen by a Python worker and their ids."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

from .shared import spread

#: Words that a table holds before it shrinks: some 50 MB in each Python worker.
MAX_WORDS = 250_000


def span_strings(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The strings of data between begins and ends, which must be in order and hold whole characters."""
    lengths = ends - begins
    if len(begins) and (begins[0] != 0 or ends[-1] != len(data) or (begins[1:] != ends[:-1]).any()):
        data = data[spread(begins, lengths)]
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))


class WordTable:
    """Ids of words, encoded once each. encode takes a list of new words and returns (ids, lengths)."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], max_words: int = MAX_WORDS):
        self.encode, self.max_words = encode, max_words
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}  # in the order of the numbers
        self.hits = np.zeros(1 << 14, np.int64)
        self.ids = np.zeros(1 << 16, np.uint32)
        self.starts, self.lengths = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.used = 0

    def shrink(self) -> None:
        """Keep the quarter of the words that was met most often, and count afresh."""
        kept = np.sort(np.argpartition(-self.hits[: len(self.place)], self.max_words // 4)[: self.max_words // 4])
        words, lengths = list(self.place), self.lengths[kept]
        ids = self.ids[spread(self.starts[kept], lengths)]
        self.clear()
        self.store([words[k] for k in kept], ids, lengths)

    def store(self, words: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        n, more = len(self.place), len(words)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n + more > len(self.starts):
            self.starts, self.lengths, self.hits = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths, self.hits))
        self.ids[self.used : self.used + len(ids)] = ids
        self.starts[n : n + more] = self.used + np.concatenate(([0], np.cumsum(lengths)[:-1]))
        self.lengths[n : n + more] = lengths
        self.used += len(ids)
        self.place.update(zip(words, range(n, n + more), strict=True))

    def look_up(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after another, and the number of ids of each word."""
        if not len(words):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if len(self.place) > self.max_words:
            self.shrink()
        coded = words.dictionary_encode()
        known = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = [w for w in known if w not in self.place]
        if new:
            self.store(new, *self.encode(new))
        number = np.fromiter(map(self.place.__getitem__, known), np.int64, len(known))
        self.hits[number] += 1
        at = number[coded.indices.to_numpy()]
        lengths = self.lengths[at]
        return self.ids[spread(self.starts[at], lengths)], lengths
