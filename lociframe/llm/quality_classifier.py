"""Quality classifier: random Fourier features over document statistics, ridge regression by
partition-summed normal equations, isotonic calibration.

fit() learns from at most MAX_TRAIN labelled rows (a documented bound); statistics and scores cover the
whole text of every document. Null and empty texts have zero statistics and get the score of those.
Very long texts are measured whole. Repeated rows get equal scores; null ids, ties and extra columns pass through; an empty table gives an
empty result; without labels every score is 0.5.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh, lower_ascii, short_batches, text_blocks, word_hashes, word_spans

MAX_TRAIN = 20_000
N_FEATURES = 256
WIDTH = 3.0
RIDGE = 1e-2
BINS = 400
#: Tasks among which the labelled rows are dealt, whatever the session's number of shuffle partitions.
FIT_TASKS = 8
#: Byte classes of the statistics: upper, lower, digit, white space, bar, shout, symbol, other ASCII, lead byte, continuation.
_CLASS = np.full(256, 7, np.uint8)
for _k, _chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " \t\n\v\f\r", "|", "!", "#*$%&<>@^~_=+\\/{}[]")):
    _CLASS[[ord(c) for c in _chars]] = _k
_CLASS[0x80:0xC0], _CLASS[0xC0:] = 9, 8
N_STATISTICS = 17


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of N_STATISTICS numbers for each text."""
    n = len(offsets) - 1
    rows = np.repeat(np.arange(n), np.diff(offsets))
    counts = np.bincount(rows * 10 + _CLASS[data], minlength=10 * n).reshape(n, 10).astype(float)
    chars = np.maximum(counts[:, :9].sum(1), 1)
    begins, ends, words_of = word_spans(data, offsets)
    n_words = np.bincount(words_of, minlength=n).astype(float)
    per_word = np.maximum(n_words, 1)
    low = lower_ascii(data)
    h = word_hashes(low, begins, ends)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (words_of[1:] == words_of[:-1])
    order = np.lexsort((h, words_of))
    first = np.ones(len(h), bool)
    first[1:] = (h[order][1:] != h[order][:-1]) | (words_of[order][1:] != words_of[order][:-1])
    distinct = np.bincount(words_of[order][first], minlength=n)
    long_word = np.bincount(words_of, ends - begins > 14, minlength=n)
    loud = np.bincount(words_of, _CLASS[data[np.minimum(ends - 1, len(data) - 1)]] == 6, minlength=n) if len(h) else np.zeros(n)
    # lines: hashed whole, blank ones included
    cut = data == 10
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    line_begin = np.flatnonzero((np.concatenate(([True], cut[:-1])) | edge[:-1]) if len(data) else np.zeros(0, bool))
    line_end = np.append(line_begin[1:], len(data))[: len(line_begin)]
    lines_of = np.searchsorted(offsets, line_begin, "right") - 1
    lh = word_hashes(data, line_begin, line_end)
    order = np.lexsort((lh, lines_of))
    first = np.ones(len(lh), bool)
    first[1:] = (lh[order][1:] != lh[order][:-1]) | (lines_of[order][1:] != lines_of[order][:-1])
    n_lines = np.bincount(lines_of, minlength=n).astype(float)
    distinct_lines = np.bincount(lines_of[order][first], minlength=n)
    letters = np.maximum(counts[:, 0] + counts[:, 1], 1)
    share = lambda x: np.sqrt(x)  # noqa: E731  small shares matter
    return np.column_stack([
        np.log1p(n_words), np.log1p(n_lines), counts[:, 0] / letters, share(counts[:, 2] / chars), counts[:, 3] / chars,
        share(counts[:, 4] / per_word), share(counts[:, 5] / per_word), share(counts[:, 6] / per_word), share(counts[:, 7] / chars),
        counts[:, 8] / chars, (chars - counts[:, 3]) / per_word, share(np.bincount(words_of, same, minlength=n) / per_word),
        distinct / per_word, share(long_word / per_word), share(loud / per_word), distinct_lines / np.maximum(n_lines, 1), n_words / np.maximum(n_lines, 1) / 50,
    ])


@dataclasses.dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    shift: np.ndarray
    ridge: np.ndarray
    cuts: np.ndarray
    levels: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights + self.shift
        return np.column_stack([np.cos(z) * np.sqrt(2 / N_FEATURES), np.ones(len(x))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.ridge

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.cuts, self.levels)


def isotonic(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence closest to value in weighted squares (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for v, w in zip(value, weight, strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks[-1]
            blocks[-1] = [(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2]
    return np.concatenate([np.full(int(n), v) for v, _, n in blocks]) if blocks else np.zeros(0)


def remainder(id_col: str, k: int) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % k


def _rows(it: Iterator[pa.RecordBatch], text: str = "__text") -> Iterator[tuple[pa.RecordBatch, int, int, np.ndarray]]:
    for batch in it:
        for low, high, data, offsets in text_blocks(batch.column(text)):
            yield batch, low, high, statistics(data, offsets)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train: int = MAX_TRAIN) -> Model | None:
    """A model of the given labels (rows of null label or id are left out; a document's conflicting labels vote).

    labels must hold the rows to learn from only. A hash of the id keeps about max_train of them."""
    short_batches(docs.sparkSession)
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y")).where("id is not null and y is not null")
    n = marks.count()
    share = min(1.0, max_train / max(n, 1))
    marks = marks.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000)).groupBy("id").agg((F.avg("y") >= 0.5).cast("double").alias("y"))
    # at most about max_train rows of two numbers each: small enough for every executor
    train = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("__text")).join(F.broadcast(marks), "id")

    def measure(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, low, high, x in _rows(it):
            cols = {"id": batch.column("id").slice(low, high - low).cast(pa.string()), "y": batch.column("y").slice(low, high - low), "x": pa.array(list(x), pa.list_(pa.float64()))}
            yield pa.RecordBatch.from_pydict(cols)

    measured = train.mapInArrow(measure, "id string, y double, x array<double>").repartition(FIT_TASKS, "id").coalesce(FIT_TASKS).persist()
    try:
        means = [f(F.col("x")[k]).alias(f"{f.__name__}{k}") for f in (F.avg, F.stddev_pop) for k in range(N_STATISTICS)]
        first = measured.agg(F.count(F.lit(1)).alias("n"), F.min("y").alias("low"), F.max("y").alias("high"), *means).first()
        if not first["n"] or first["low"] == first["high"]:
            return None
        mean, scale = np.array(first[3:], float).reshape(2, -1)
        rng = np.random.default_rng(20_240_607)
        model = Model(mean, np.maximum(scale, 1e-6), rng.normal(0, 1 / WIDTH, (N_STATISTICS, N_FEATURES)), rng.uniform(0, 2 * np.pi, N_FEATURES), np.zeros(N_FEATURES + 1), np.array([0.0]), np.array([0.0]))
        held = F.crc32("id") % 7 == 3

        def equations(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            a = np.zeros((N_FEATURES + 1, N_FEATURES + 2))
            for batch in it:
                z = model.features(np.stack(batch.column("x").to_numpy(zero_copy_only=False))) if len(batch) else np.zeros((0, N_FEATURES + 1))
                a += z.T @ np.column_stack([z, batch.column("y").to_numpy()])
            yield pa.RecordBatch.from_pydict({"a": [a.tobytes()]})

        fitted = measured.where(~held) if first["n"] >= 50 else measured
        sums = fitted.select("x", "y").mapInArrow(equations, "a binary").collect()  # one sum of half a MB from each of FIT_TASKS tasks
        a = sum(np.frombuffer(r.a).reshape(N_FEATURES + 1, N_FEATURES + 2) for r in sums)
        size = max(first["n"], 1)
        model.ridge = np.linalg.solve(a[:, :-1] + RIDGE * size / 100 * np.diag(np.append(np.ones(N_FEATURES), 1e-6)), a[:, -1])

        def binned(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in it:
                if len(batch):
                    raw = model.raw(np.stack(batch.column("x").to_numpy(zero_copy_only=False)))
                    yield pa.RecordBatch.from_pydict({"bin": np.clip(np.floor(raw * BINS / 2 + BINS / 4), 0, BINS).astype(np.int64), "y": batch.column("y")})

        calibration = measured.where(held) if first["n"] >= 50 else measured
        table = calibration.select("x", "y").mapInArrow(binned, "bin bigint, y double").groupBy("bin").agg(F.avg("y").alias("y"), F.count(F.lit(1)).alias("n")).orderBy("bin").collect()  # at most BINS + 1 rows
        if not table:
            return None
        model.cuts = np.array([(r.bin - BINS / 4 + 0.5) * 2 / BINS for r in table])
        model.levels = np.clip(isotonic(np.array([r.y for r in table]), np.array([r.n for r in table], float)), 0, 1)
        return model
    finally:
        measured.unpersist()


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), out: str = "score") -> DataFrame:
    """id, the columns to carry, and the score (0 to 1) of every row, in the column out, which no carried column may be."""
    short_batches(docs.sparkSession)
    kept = list(dict.fromkeys([id_col, *carry]))
    (text,) = fresh([*kept, out], "__text")
    step = docs.select(*kept, F.col(text_col).cast("string").alias(text))
    if model is None:
        return step.select(*kept, F.lit(0.5).alias(out))
    cast = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: N_FEATURES by N_STATISTICS numbers

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, low, high, x in _rows(it, text):
            cols = {c: batch.column(c).slice(low, high - low) for c in kept}
            yield pa.RecordBatch.from_pydict(cols | {out: np.clip(cast.value.score(x), 0, 1)})

    schema = step.select(*kept).schema.add(out, "double")
    return step.mapInArrow(run, schema)
