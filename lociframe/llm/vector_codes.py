"""Compression of vectors to four-byte product codes, with codebooks of a bounded Lloyd iteration.

A vector's components become integers floor(1024 * x) and are cut into PARTS consecutive parts. Every part has a codebook
of ENTRIES at most, begun from the rows of the smallest ids and refined in ROUNDS rounds of assignment (squared Euclidean
distance, ties to the lower index) and integer means (floor(sum / count); unused entries stay).

Assignment keeps Hamerly's bounds: each part of a row carries an upper bound of the distance to its entry and a lower bound of
that to every other entry. Entries move between rounds, which loosens the bounds; while the upper one stays strictly below the
lower one (or below half the way to the entry's nearest neighbour) the entry can't have changed, ties included. Only parts
whose bounds fail, also after the upper one is made exact, are compared with all entries. Bounds are rounded outwards.

Rows whose vector is null or holds a null or non-finite component are dropped, as are those of another length than the first
row's (by id, nulls last, then by vector). A length that four doesn't divide gives the first parts one component more. Rows that
repeat an id stay rows of their own. Components beyond the limit that keeps sums of squares in 64 bits (2 ** 27 for parts of 16)
count as that limit; label_error stops at the greatest long. Extra columns pass by; an empty table gives an empty result.
The driver holds codebooks only: PARTS * ENTRIES parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import few_rows, forget, shared_path, short_batches

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Relative room by which bounds are rounded outwards, far above a double's error.
SLACK = 1e-9
_STATE = "vec_id long, label string, q binary, code binary, upper binary, lower binary, n_scanned int"


@dataclass(frozen=True)
class Codebooks:
    """entries[p] holds the integer entries of part p; cuts are the places where a vector is cut."""

    cuts: tuple[int, ...]
    entries: tuple[np.ndarray, ...]

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(x) for e in self.entries for x in e.ravel().tolist()).encode()).hexdigest()


def _limit(size: int) -> int:
    """The largest component for which the four parts' squared distances add up within 63 bits."""
    return 1 << ((58 - (max(1, size) - 1).bit_length()) // 2)


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, label and v (doubles) of the rows that take part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("v").isNotNull() & (F.size("v") > 0) & finite)


def _whole(v: np.ndarray, limit: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(np.floor(v * SCALE), -limit, limit).astype(np.int64)


def first_codebooks(rows: DataFrame) -> Codebooks | None:
    """The parts of the first ENTRIES rows by id; None where there are no rows."""
    order = (F.col("vec_id").asc_nulls_last(), F.col("v").asc())
    head = rows.orderBy(*order).limit(1).select(F.size("v").alias("d")).first()
    if head is None:
        return None
    d = head.d
    cuts = tuple(np.concatenate([[0], np.cumsum([len(x) for x in np.array_split(np.arange(d), PARTS)])]).tolist())
    first = rows.where(F.size("v") == d).orderBy(*order).limit(ENTRIES).select("v").collect()
    q = _whole(np.array([r.v for r in first], float).reshape(len(first), d), _limit(int(max(np.diff(cuts)))))
    return Codebooks(cuts, tuple(q[:, a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)))


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows of x to rows of c, exact: in doubles where all terms stay below 2 ** 53."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if 4 * top * top * max(1, x.shape[1]) < 1 << 53:
        xf, cf = x.astype(float), c.astype(float)
        return ((xf * xf).sum(1)[:, None] - 2 * (xf @ cf.T) + (cf * cf).sum(1)).astype(np.int64)
    return np.stack([((x - e) ** 2).sum(1) for e in c], 1)


def _assign(q: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray, c: np.ndarray, half: np.ndarray) -> np.ndarray:
    """Bring one part's code and bounds up to date in place; the rows that were compared with all entries."""
    open_ = np.flatnonzero(~(upper < np.maximum(lower, half[code])))
    if len(open_):  # the exact distance to the entry may do
        upper[open_] = np.sqrt(((q[open_] - c[code[open_]]) ** 2).sum(1)) * (1 + SLACK)
        open_ = open_[~(upper[open_] < np.maximum(lower[open_], half[code[open_]]))]
    for at in range(0, len(open_), 4096):
        rows = open_[at : at + 4096]
        far = _distances(q[rows], c)
        code[rows] = far.argmin(1)
        near = np.partition(far, 1, axis=1)[:, :2] if len(c) > 1 else np.stack([far[:, 0], np.full(len(rows), np.iinfo(np.int64).max)], 1)
        upper[rows], lower[rows] = np.sqrt(near[:, 0]) * (1 + SLACK), np.sqrt(near[:, 1]) * (1 - SLACK)
    return open_


def _column(batch: pa.RecordBatch, name: str, kind: str, width: int) -> np.ndarray:
    flat = batch[name]
    ends = np.frombuffer(flat.buffers()[1], np.int32)[flat.offset : flat.offset + len(flat) + 1]
    return np.frombuffer(flat.buffers()[2] or b"", kind, int(ends[-1] - ends[0]) // np.dtype(kind).itemsize, int(ends[0])).reshape(len(flat), width).copy()


def _cells(x: np.ndarray) -> pa.Array:
    data = np.ascontiguousarray(x)
    width = data.strides[0]
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(np.arange(len(data) + 1, dtype=np.int32) * width), pa.py_buffer(data.tobytes())])


def _state(head: pa.RecordBatch, q: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray, scanned: np.ndarray) -> pa.RecordBatch:
    columns = [head["vec_id"], head["label"], _cells(q.astype(np.int32)), _cells(code.astype(np.uint8)), _cells(upper), _cells(lower), pa.array(scanned, pa.int32())]
    return pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in _STATE.split(", ")])


def _half_ways(c: np.ndarray) -> np.ndarray:
    """Half the distance of each entry to its nearest other, rounded down."""
    if len(c) < 2:
        return np.full(len(c), np.inf)
    far = _distances(c, c)
    np.fill_diagonal(far, np.iinfo(np.int64).max)
    return np.sqrt(far.min(1)) * (0.5 - SLACK)


def begin(rows: DataFrame, books: Codebooks) -> DataFrame:
    """The state before the first round: integer vectors and bounds that say nothing."""
    cuts = books.cuts

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit = _limit(int(max(np.diff(cuts))))
        for batch in it:
            if len(batch):
                v = batch["v"].flatten().to_numpy(zero_copy_only=False).reshape(len(batch), cuts[-1])
                n = len(batch)
                yield _state(batch, _whole(v, limit), np.zeros((n, PARTS)), np.full((n, PARTS), np.inf), np.zeros((n, PARTS)), np.zeros(n))

    return rows.where(F.size("v") == cuts[-1]).mapInArrow(run, _STATE)


def assigned(state: DataFrame, books: Codebooks, moved: list[np.ndarray]) -> DataFrame:
    """The state after an assignment, given how far each part's entries have moved since the last."""
    cuts, entries = books.cuts, books.entries

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        halves = [_half_ways(c) for c in entries]
        others = []  # the farthest that another entry has moved
        for m in moved:
            top = np.argsort(m)[::-1][:2]
            o = np.full(len(m), m[top[0]])
            o[top[0]] = m[top[1]] if len(top) > 1 else 0.0
            others.append(o)
        for batch in it:
            if not len(batch):
                continue
            q, code = _column(batch, "q", "<i4", cuts[-1]).astype(np.int64), _column(batch, "code", "u1", PARTS).astype(np.int64)
            upper, lower = _column(batch, "upper", "<f8", PARTS), _column(batch, "lower", "<f8", PARTS)
            scanned = np.zeros(len(batch), np.int64)
            for p, c in enumerate(entries):
                at, up, low = code[:, p].copy(), upper[:, p].copy(), lower[:, p].copy()
                up = (up + moved[p][at]) * (1 + SLACK)
                low = np.maximum(0.0, (low - others[p][at]) * (1 - SLACK) - SLACK)
                scanned[_assign(q[:, cuts[p] : cuts[p + 1]], at, up, low, c, halves[p])] += 1
                code[:, p], upper[:, p], lower[:, p] = at, up, low
            yield _state(batch, q, code, upper, lower, scanned)

    return state.mapInArrow(run, _STATE)


def summed(state: DataFrame, books: Codebooks) -> DataFrame:
    """part, entry, n and s0, s1, ..: the number and componentwise sums of the parts that each entry has. A task gives one
    row for each of its entries, so the shuffle doesn't grow with the rows."""
    cuts, sizes = books.cuts, [len(e) for e in books.entries]
    width = int(max(np.diff(cuts)))
    names = ["part", "entry", "n", *[f"s{i}" for i in range(width)]]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = [np.zeros(k, np.int64) for k in sizes], [np.zeros((k, width), np.int64) for k in sizes]
        for batch in it:
            if not len(batch):
                continue
            q, code = _column(batch, "q", "<i4", cuts[-1]).astype(np.int64), _column(batch, "code", "u1", PARTS)
            for p in range(PARTS):
                order = np.argsort(code[:, p], kind="stable")
                at, first = np.unique(code[order, p], return_index=True)
                n[p][at] += np.diff([*first, len(order)])
                sums[p][at, : cuts[p + 1] - cuts[p]] += np.add.reduceat(q[order, cuts[p] : cuts[p + 1]], first, axis=0)
        for p in range(PARTS):
            at = np.flatnonzero(n[p])
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), p)), pa.array(at), pa.array(n[p][at]), *[pa.array(x) for x in sums[p][at].T]], names=names)

    parts = state.select("q", "code").mapInArrow(run, ", ".join(f"{c} long" for c in names))
    return parts.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in names[3:]])


def means(state: DataFrame, books: Codebooks) -> tuple[Codebooks, list[np.ndarray]]:
    """The codebooks of the assigned parts' means, and how far each entry moved, rounded up."""
    entries = [e.copy() for e in books.entries]
    for r in summed(state, books).collect():  # PARTS * ENTRIES rows at most
        c = entries[r.part]
        c[r.entry] = [r[3 + i] // r.n for i in range(c.shape[1])]
    moved = [np.sqrt(((a - b) ** 2).sum(1)) * (1 + SLACK) for a, b in zip(entries, books.entries, strict=True)]
    return Codebooks(books.cuts, tuple(entries)), moved


def compress(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks | None]:
    """vec_id, label, code (PARTS bytes), error (squared distances summed over the parts) and n_scanned of every row that takes
    part; and the codebooks."""
    spark = vectors.sparkSession
    short_batches(spark)
    rows = usable(vectors, id_col, vec_col, label_col)
    books = first_codebooks(rows)
    if books is None:
        return rows.select("vec_id", "label", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error")), None
    state, moved, path = begin(rows, books), [np.zeros(len(e)) for e in books.entries], None
    for k in range(rounds + 1):
        before, path = path, shared_path(spark, f"codes-{k}")
        assigned(state, books, moved).write.parquet(path)
        state = spark.read.schema(_STATE).parquet(path)
        if before is not None:
            forget(spark, before)
        if k < rounds:
            books, moved = means(state, books)
    return with_errors(state, books), books


def with_errors(state: DataFrame, books: Codebooks) -> DataFrame:
    cuts, entries = books.cuts, books.entries

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if len(batch):
                q, code = _column(batch, "q", "<i4", cuts[-1]).astype(np.int64), _column(batch, "code", "u1", PARTS)
                error = sum(((q[:, cuts[p] : cuts[p + 1]] - entries[p][code[:, p]]) ** 2).sum(1) for p in range(PARTS))
                yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["label"], batch["code"], pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    return state.select("vec_id", "label", "q", "code").mapInArrow(run, "vec_id long, label string, code binary, error long")


def with_label_errors(coded: DataFrame) -> DataFrame:
    """coded with label_error: the error summed over the rows of the same label, null labels together."""
    most = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), most).cast("long").alias("label_error"))
    return coded.join(few_rows(sums, sums.count()), F.col("label").eqNullSafe(F.col("of"))).drop("of")
