"""Language identification by prediction by partial matching.

A variable-order byte context tree for each language (contexts of 0 to 3 bytes, escape method C, frozen
after training) gives the exact code length of a text; the language of the shortest code wins, ties to
the smaller language name. Texts are lower-cased and all ASCII characters but letters count as one
separator. fit() learns from about MAX_DOCS whole documents a language (a documented bound on labelled
rows), from at least one of each, and from every language there is; every context of those documents is kept.

Null texts and texts without a letter are 'und' with score 0. Repeated rows get equal results; null ids,
very long texts (read a block at a time) and extra columns pass through; an empty table gives an empty
result; with no labelled document everything is 'und'.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import few_rows, fresh, short_batches, spread, stored, text_blocks

MAX_DOCS = 600
ORDER = 3
UNKNOWN = "und"
#: Bytes over which the margin between two languages is averaged at least, for the score.
MARGIN_BYTES = 24
#: Numbers that one step of scoring holds: places of a text times languages.
STEP = 4_000_000
_MAP = np.full(256, 32, np.uint8)
_MAP[97:123] = np.arange(97, 123)
_MAP[128:] = np.arange(128, 256)


def padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The mapped bytes with ORDER separators before and one after each text; first place of each text."""
    sizes = np.diff(offsets) + ORDER + 1
    starts = np.concatenate(([0], np.cumsum(sizes)))
    out = np.full(starts[-1], 32, np.uint8)
    rows = np.repeat(np.arange(len(sizes)), np.diff(offsets))
    out[np.arange(len(data)) + rows * (ORDER + 1) + ORDER] = _MAP[data]
    return out, starts


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each byte of the padded texts that is coded, with the ORDER bytes before it, as one number; and where each
    text's begin (and the last end)."""
    found, starts = padded(data, offsets)
    g = found.astype(np.int64)
    g = g[:-3] << 24 | g[1:-2] << 16 | g[2:-1] << 8 | g[3:]
    coded = np.ones(len(found), bool)
    coded[(starts[:-1, None] + np.arange(ORDER)).ravel()] = False
    return g[coded[ORDER:]] if len(g) else g, starts - ORDER * np.arange(len(starts))


@dataclasses.dataclass
class Model:
    """Bits for what the trees have seen: keys are context << 8 | byte, sorted, for each order; the rows of cost of one
    key follow one another by language (cells: where each key's begin). A byte that a language hasn't seen in a
    context costs the escape and then what it costs a byte earlier."""

    languages: list[str]
    keys: list[np.ndarray]  # of orders 0 to ORDER
    cells: list[np.ndarray]
    cell_language: list[np.ndarray]
    cell_bits: list[np.ndarray]
    contexts: list[np.ndarray]
    escape_cells: list[np.ndarray]
    escape_language: list[np.ndarray]
    escape_bits: list[np.ndarray]
    fresh: float

    def bits(self, gram: np.ndarray) -> np.ndarray:
        """Bits of each gram's last byte after the ORDER before it, a column for each language."""
        total = np.zeros((len(gram), len(self.languages)))
        going = np.ones(total.shape, bool)
        for k in range(ORDER, -1, -1):
            for keys, cells, language, bits, ends, part in (
                (self.keys[k], self.cells[k], self.cell_language[k], self.cell_bits[k], True, gram & ((1 << (8 * (k + 1))) - 1)),
                (self.contexts[k], self.escape_cells[k], self.escape_language[k], self.escape_bits[k], False, gram >> 8 & ((1 << (8 * k)) - 1)),
            ):
                if not len(keys):
                    continue
                at = np.minimum(np.searchsorted(keys, part), len(keys) - 1)
                row = np.flatnonzero(keys[at] == part)
                sizes = cells[at[row] + 1] - cells[at[row]]
                cell, place = spread(cells[at[row]], sizes), np.repeat(row, sizes)
                open_ = going[place, language[cell]]
                cell, place = cell[open_], place[open_]
                total[place, language[cell]] += bits[cell]
                if ends:
                    going[place, language[cell]] = False
        return total + going * self.fresh

    def lengths(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bits of each text in each language, and its bytes with the separator after it."""
        gram, starts = grams(data, offsets)
        out = np.zeros((len(starts) - 1, len(self.languages)))
        of = np.repeat(np.arange(len(out)), np.diff(starts))
        known, at = np.unique(gram, return_inverse=True)  # most grams of a block repeat
        step = max(1, STEP // len(self.languages))
        for low in range(0, len(known), step):
            cost = self.bits(known[low : low + step])
            own = np.flatnonzero((at >= low) & (at < low + step))
            for part in range(0, len(own), step):
                some = own[part : part + step]
                rows, first = np.unique(of[some], return_index=True)
                out[rows] += np.add.reduceat(cost[at[some] - low], first, axis=0)
        return out, np.diff(offsets) + 1


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_docs: int = MAX_DOCS) -> Model | None:
    """Learn from docs' texts and non-null languages. Of each language about max_docs different texts are kept,
    those of the smallest hashes, and the one of the smallest hash in any case."""
    short_batches(docs.sparkSession)
    rows = docs.select(F.lower(F.col(text_col).cast("string")).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    rows = rows.withColumn("h", F.xxhash64(F.lit(7), "text").bitwiseAND(F.lit((1 << 31) - 1)))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("least")).withColumn("most", F.greatest("least", F.ceil(F.lit((1 << 31) * max_docs) / F.col("n"))))
    counts = stored(counts.select("lang", "most"), "languages")
    sample = rows.join(few_rows(counts, counts.count()), "lang").where("h <= most").select("lang", "text").distinct()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for lang in set(batch.column("lang").to_pylist()):
                own = pa.compute.filter(batch.column("text"), pa.compute.equal(batch.column("lang"), lang))
                for _, _, data, offsets in text_blocks(own):
                    gram, n = np.unique(grams(data, offsets)[0], return_counts=True)
                    yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(gram), pa.string()), "gram": gram, "n": n.astype(np.int64)})

    # counts of a bounded sample: the grams of about max_docs documents a language
    table = sample.mapInArrow(run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    return build(table.lang.to_numpy(str), table.gram.to_numpy(np.int64), table.n.to_numpy(np.int64)) if len(table) else None


def build(lang: np.ndarray, gram: np.ndarray, n: np.ndarray) -> Model:
    """The frozen trees of the counted grams. In a context that came c times with d different bytes, a byte that came
    f times costs log2((c + d) / f) bits and an escape log2((c + d) / d); bytes that a language hasn't seen at
    all cost 8 bits after all escapes."""
    languages = sorted(set(lang.tolist()))
    of = np.searchsorted(np.array(languages), lang).astype(np.int64)
    many = len(languages)

    def table(key: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (key, language), as key * many + language, and the sum of their weights."""
        cell, at = np.unique(key * many + of_cell, return_inverse=True)
        return cell, np.bincount(at, weight, minlength=len(cell))

    columns: list[list[np.ndarray]] = [[] for _ in range(8)]
    for k in range(ORDER + 1):
        of_cell = of
        cell, count = table(gram & ((1 << (8 * (k + 1))) - 1), n.astype(float))
        of_cell = cell % many
        place, total = table(cell // many >> 8, count)
        _, distinct = table(cell // many >> 8, np.ones(len(cell)))
        own = np.searchsorted(place, (cell // many >> 8) * many + of_cell)
        bits = np.log2((total + distinct)[own] / count)
        for out, (c, b) in zip((columns[:4], columns[4:]), ((cell, bits), (place, np.log2((total + distinct) / distinct))), strict=True):
            keys, first = np.unique(c // many, return_index=True)
            for column, values in zip(out, (keys, np.append(first, len(c)), (c % many).astype(np.int32), b.astype(np.float32)), strict=True):
                column.append(values)
    return Model(languages, *columns, 8.0)


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), prefix: str = "") -> DataFrame:
    """id, the columns to carry, lang_pred, score and bits_per_byte of every row; the last three names get the
    prefix, which keeps them apart from carried columns."""
    short_batches(docs.sparkSession)
    kept = list(dict.fromkeys([id_col, *carry]))
    text = F.col(text_col).cast("string")
    text_name, letters_name = fresh(kept, "__text", "__letters")
    step = docs.select(*kept, F.lower(text).alias(text_name), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias(letters_name))
    if model is None:
        return step.select(*kept, F.lit(UNKNOWN).alias(prefix + "lang_pred"), F.lit(0.0).alias(prefix + "score"), F.lit(None).cast("double").alias(prefix + "bits_per_byte"))
    cast = docs.sparkSession.sparkContext.broadcast(model)  # what about MAX_DOCS documents a language hold

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = cast.value
        names = np.array(m.languages, object)
        for batch in it:
            for low, high, data, offsets in text_blocks(batch.column(text_name)):
                bits, size = m.lengths(data, offsets)
                best = bits.argmin(1)
                margin = (bits - bits[np.arange(len(bits)), best, None]) * np.minimum(1, MARGIN_BYTES / size)[:, None]
                letters = batch.column(letters_name).slice(low, high - low).to_numpy(zero_copy_only=False)
                cols = {c: batch.column(c).slice(low, high - low) for c in kept}
                yield pa.RecordBatch.from_pydict(cols | {
                    prefix + "lang_pred": pa.array(np.where(letters, names[best], UNKNOWN), pa.string()),
                    prefix + "score": np.where(letters, 1 / np.exp2(-margin).sum(1), 0.0),
                    prefix + "bits_per_byte": bits[np.arange(len(bits)), best] / size,
                })

    schema = step.select(*kept).schema.add(prefix + "lang_pred", "string").add(prefix + "score", "double").add(prefix + "bits_per_byte", "double")
    return step.mapInArrow(run, schema)
