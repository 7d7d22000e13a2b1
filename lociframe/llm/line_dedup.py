"""Line dedup over overlapping three-line windows.

A line is a piece of the text between line feeds, compared without white space at its ends; lines
without other characters form no window and are never removed. Every run of three lines that follow
one another is hashed to 128 bits; of equal windows in the whole table the one with the smallest (id,
place) stays, and every line that another occurrence covers goes.

Null texts and texts of fewer than three lines have no window and stay as they are. Very long texts are
one row like any other. Rows that repeat an id with the same text are one occurrence; those that repeat it with
another text are documents of their own, in the order of a hash of their texts. Windows of rows with a null id count
for nothing and stay. Extra columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fresh

WINDOW = 3
_ENDS = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"


def windows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """h1, h2 (the hash of a window), id, of (a hash of the text: both name the document), place and places (numbers of
    its first line, and of all three)."""
    far = 1 << 30  # start + far must not overflow an int
    trimmed = F.transform(F.split(F.col(text_col), "\n", -1), lambda x, i: F.struct(F.regexp_replace(x, _ENDS, "").alias("s"), i.alias("i")))
    lines = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("of"), F.filter(trimmed, lambda x: x.s != "").alias("t"))
    rows = lines.select("id", "of", F.explode(F.arrays_zip(F.col("t").alias("a"), F.slice("t", 2, far).alias("b"), F.slice("t", 3, far).alias("c"))).alias("w")).where("w.c is not null")
    return rows.select(F.xxhash64("w.a.s", "w.b.s", "w.c.s").alias("h1"), F.xxhash64(F.lit(7), "w.a.s", "w.b.s", "w.c.s").alias("h2"), "id", "of", F.col("w.a.i").alias("place"), F.array("w.a.i", "w.b.i", "w.c.i").alias("places"))


def removed_places(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, of and gone: the numbers of its lines that a later occurrence of a window covers."""
    found = windows(docs, id_col, text_col)
    # combined before the shuffle, so a window that fills the table is one row from each task
    at = F.struct("id", "place", "of")
    first = found.groupBy("h1", "h2").agg(F.min(at).alias("first"), F.max(at).alias("last")).where("first != last")
    first = first.select("h1", "h2", F.col("first.id").alias("id0"), F.col("first.place").alias("place0"), F.col("first.of").alias("of0"))
    later = found.join(first, ["h1", "h2"]).where("id != id0 or place != place0 or of != of0")
    return later.groupBy("id", "of").agg(F.array_distinct(F.flatten(F.collect_set("places"))).alias("gone"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' columns with the repeated lines cut from the text, then n_lines and n_removed_lines (0 for a
    null text). A column of docs with one of these two names is replaced."""
    id_, of_, gone_, lines_ = fresh(docs.columns, "__id", "__of", "__gone", "__lines")
    gone = removed_places(docs, id_col, text_col).select(F.col("id").alias(id_), F.col("of").alias(of_), F.col("gone").alias(gone_))
    step = docs.join(gone, (F.col(id_col) == F.col(id_)) & (F.xxhash64(text_col) == F.col(of_)), "left").withColumn(lines_, F.split(F.col(text_col), "\n", -1))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines_) - 1), F.col(gone_))
    left = F.array_join(F.transform(kept, lambda i: F.get(lines_, i)), "\n")
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed_lines")]
    out = [F.when(F.col(gone_).isNull(), F.col(c)).otherwise(left).alias(c) if c == text_col else F.col(c) for c in names]
    return step.select(*out, F.greatest(F.size(lines_), F.lit(0)).cast("long").alias("n_lines"), F.greatest(F.size(gone_), F.lit(0)).cast("long").alias("n_removed_lines"))
