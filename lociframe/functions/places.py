"""Where the matches of a pattern stand in a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(x: Column, f) -> Column:
    """f(x), with x evaluated once."""
    return F.transform(F.array(x), f)[0]


def all_matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))


def running(x: Column) -> Column:
    """Running sums of an array of longs, in about as many blocks as each holds: arrays grow by copying, so one fold would take the square of
    its length."""
    none, zero = F.array().cast("array<bigint>"), F.lit(0).cast("long")

    def grown(values: Column, first: Column) -> Column:
        return F.aggregate(values, F.concat(none, F.array(first)), lambda a, v: F.concat(a, F.array(F.element_at(a, -1) + v)))

    def summed(z: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(z.x) - 1) / z.most).cast("int"))), lambda b: F.slice(z.x, b * z.most + 1, z.most))

        def joined(b: Column) -> Column:
            sums = F.transform(b, lambda v: F.aggregate(v, zero, lambda s, y: s + y))
            return let(grown(sums, zero), lambda at: F.flatten(F.transform(b, lambda v, i: F.slice(grown(v, F.get(at, i)), F.lit(2), F.greatest(F.size(v), F.lit(1))))))

        return let(blocks, joined)

    return let(x, lambda v: let(F.struct(v.alias("x"), F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(v))).cast("int")).alias("most")), summed))


def placed(text: Column, pattern: str) -> Column:
    """The matches of pattern as an array of (m, start), start in code points from 0."""

    def places(z: Column) -> Column:
        gaps = F.transform(z.found, lambda m, i: (F.length(F.get(z.pieces, i)) + F.when(i > 0, F.length(F.get(z.found, i - 1))).otherwise(0)).cast("long"))
        return F.arrays_zip(z.found.alias("m"), running(gaps).alias("start"))

    return let(F.struct(all_matches(text, pattern).alias("found"), F.split(text, pattern, -1).alias("pieces")), places)
