"""Nearest neighbours by multiprobe p-stable hashing, with exact distances.

Distinct vectors are scaled to length 1, so cosine order is Euclidean order. Each of the tables hashes a
vector by floor((a x + b) / w) for Gaussian a. A query visits its own bucket and the perturbed buckets of
every table in the order of their estimated chance of success (the squared distance to the cell borders
crossed); in a bucket, queries meet its vectors in blocks, and only the nearest few of each leave it.
The few of all tables are merged and reranked by one double precision cosine a pair, which doesn't hang on
the block that a pair met in.

Copies of a vector are hashed once: a class of equal vectors keeps its smallest ids, as many as can be
answers. Buckets over MAX_BUCKET vectors are dealt out in blocks, so none is cut. Null and zero vectors and
such with null or non-finite components take no part; vectors of any finite size are scaled by a power of
two, which is exact, before they are multiplied; ties go to the smaller id; rows that repeat an id
with another vector are vectors of their own; extra columns are not read; an empty table gives no row.
A query with fewer answers than asked is searched among all vectors; vectors of another length are another
space, so it may then still have fewer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

TABLES = 5
HASHES = 4
WIDTH = 1.2
PROBES = 60
MAX_BUCKET = 8192
SEED = 11
#: Classes that leave a bucket beside those asked for, as block products round otherwise than the final score.
SPARE = 3


def usable(vector: Column) -> Column:
    """True for vectors that take part."""
    v = vector.cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(sound & F.exists(v, lambda x: x != 0), F.lit(False))


def classes(vectors: DataFrame, id_col: str, vec_col: str, k: int) -> tuple[DataFrame, DataFrame]:
    """(class, ids, vec) of the distinct vectors, and (class, id) of all rows that take part.

    A class is named by its smallest id and lists its k + 1 smallest ids: with equal scores no other can be
    an answer. The window's group limit drops the others before the shuffle."""
    rows = vectors.where(usable(F.col(vec_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.transform(F.col(vec_col).cast("array<double>"), lambda x: x + F.lit(0.0)).alias("vec"))
    rows = rows.withColumns({"k1": F.xxhash64("vec"), "k2": F.xxhash64(F.lit(5), "vec")})
    few = rows.withColumn("nth", F.row_number().over(Window.partitionBy("k1", "k2").orderBy("id"))).where(F.col("nth") <= k + 1)
    distinct = few.groupBy("k1", "k2").agg(F.min("id").alias("class"), F.sort_array(F.collect_list("id")).alias("ids"), F.min_by("vec", "nth").alias("vec"))
    return distinct, rows.select("k1", "k2", "id")


def hash_cells(x: np.ndarray, table: int, hashes: int = HASHES, width: float = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Cell numbers of unit vectors in a table, and where in its cell each lies (0 to 1)."""
    rng = np.random.default_rng((SEED, table))
    at = (x @ rng.normal(size=(x.shape[1], hashes)) + rng.uniform(0, width, hashes)) / width
    cell = np.floor(at)
    return cell.astype(np.int64), at - cell


def bucket(cells: np.ndarray) -> np.ndarray:
    """One long for a row of cell numbers, each of which fits 16 bits."""
    return ((cells + (1 << 15)) << (16 * np.arange(cells.shape[-1]))).sum(-1)


def probes(cells: np.ndarray, inside: np.ndarray, n: int) -> np.ndarray:
    """The n buckets most likely to hold near vectors, likeliest first; perturbations of -1, 0 and 1 in each hash."""
    moves = np.stack(np.meshgrid(*[[0, -1, 1]] * cells.shape[1], indexing="ij"), -1).reshape(-1, cells.shape[1])
    cost = (np.where(moves == -1, inside[:, None], np.where(moves == 1, 1 - inside[:, None], 0)) ** 2).sum(-1)
    order = np.argsort(cost, axis=1, kind="stable")[:, : min(n, len(moves))]
    return bucket(cells[:, None] + moves[order])


def _stack(column: pa.Array) -> np.ndarray:
    return np.stack([np.frombuffer(x, np.float64) for x in column.to_numpy(zero_copy_only=False)]) if len(column) else np.zeros((0, 1))


def scaled(v: np.ndarray) -> np.ndarray:
    """v times the power of two that brings its largest component to between 0.5 and 1, so that squares stay finite."""
    return np.ldexp(v, -np.frexp(np.abs(v).max())[1])


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The cosine of each row of x with that of y, whatever other rows there are."""
    dot = lambda a, b: np.einsum("ij,ij->i", a, b)
    return dot(x, y) / (np.sqrt(dot(x, x)) * np.sqrt(dot(y, y)))


def _packed(distinct: DataFrame) -> DataFrame:
    """class, ids and vec: the scaled components as bytes."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            vec = [scaled(np.asarray(v, np.float64)).tobytes() for v in batch.column("vec").to_numpy(zero_copy_only=False)]
            yield pa.RecordBatch.from_pydict({"class": batch.column("class"), "ids": batch.column("ids"), "vec": pa.array(vec, pa.binary())})

    return distinct.select("class", "ids", "vec").mapInArrow(run, "class long, ids array<long>, vec binary")


def _placed(packed: DataFrame, n_probes: int) -> DataFrame:
    """part (table), bucket, class and vec: a row for each table, or for each probe of each table."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for low in range(0, len(batch), 512):
                own = batch.slice(low, 512)
                sizes = [len(v) for v in own.column("vec").to_pylist()]
                for size in set(sizes):  # vectors of another length are another space
                    pick = np.flatnonzero(np.array(sizes) == size)
                    some = own.take(pa.array(pick))
                    x = _stack(some.column("vec"))
                    x = x / np.linalg.norm(x, axis=1, keepdims=True)
                    for t in range(TABLES):
                        found = probes(*hash_cells(x, t), n_probes)
                        row = np.repeat(np.arange(len(x)), found.shape[1])
                        wide = some.take(pa.array(row))
                        part = np.full(len(row), t + TABLES * size, np.int64)
                        yield pa.RecordBatch.from_pydict({"part": part, "bucket": found.ravel(), "class": wide.column("class"), "vec": wide.column("vec")})

    return packed.select("class", "vec").mapInArrow(run, "part long, bucket long, class long, vec binary")


def _nearest(keep: int):
    """For one bucket or block: the keep nearest of its vectors to each query that visits it."""

    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(rows):
            return pd.DataFrame({"query": [], "class": [], "score": []})
        x = np.stack([np.frombuffer(v) for v in rows["vec"]])
        names, size = rows["class"].to_numpy(np.int64), np.linalg.norm(x, axis=1)
        out = []
        for low in range(0, len(queries), 1024):
            q = np.stack([np.frombuffer(v) for v in queries["vec"].iloc[low : low + 1024]])
            score = (q @ x.T) / (np.linalg.norm(q, axis=1)[:, None] * size)
            k = min(keep, len(names))
            top = np.argpartition(-score, k - 1, axis=1)[:, :k] if k < len(names) else np.broadcast_to(np.arange(len(names)), score.shape)
            out.append(pd.DataFrame({"query": np.repeat(queries["class"].to_numpy(np.int64)[low : low + 1024], k), "class": names[top].ravel(), "score": np.take_along_axis(score, top, 1).ravel()}))
        return pd.concat(out)

    return run


def _joined(queries: DataFrame, rows: DataFrame, keys: list[str], keep: int) -> DataFrame:
    queries = queries.select(*[F.col(c).alias(c) for c in queries.columns])  # both may come from one frame; names of its own keep them apart
    found = queries.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInPandas(_nearest(keep), "query long, class long, score double")
    return found.groupBy("query", "class").agg(F.max("score").alias("score"))


def _dealt(blocks: Column) -> Column:
    return F.pmod(F.xxhash64("class"), blocks)


def exhaustive(queries: DataFrame, packed: DataFrame, keep: int) -> DataFrame:
    """query, class, score: the nearest classes among all, by blocks of vectors that every query block meets."""
    blocks, turns = (max(1, -(-df.count() // MAX_BUCKET)) for df in (packed, queries))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    rows = packed.withColumns({"block": _dealt(F.lit(blocks)), "turn": every(turns), "size": F.length("vec")})
    asked = queries.withColumns({"block": every(blocks), "turn": _dealt(F.lit(turns)), "size": F.length("vec")})
    return _joined(asked, rows, ["block", "turn", "size"], keep)


def _answers(hits: DataFrame, asked: DataFrame, packed: DataFrame, keep: int, k: int) -> DataFrame:
    """The k nearest rows of each asked row, of hits (query, class, score), of which the keep best a query are reranked."""

    def rerank(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if len(batch):
                x, y = ([np.frombuffer(v) for v in batch.column(c).to_pylist()] for c in ("qvec", "vec"))
                score = np.empty(len(batch))
                for size in {len(v) for v in x}:
                    of = [i for i, v in enumerate(x) if len(v) == size]
                    score[of] = cosines(np.stack([x[i] for i in of]), np.stack([y[i] for i in of]))
                yield pa.RecordBatch.from_pydict({"query": batch.column("query"), "ids": batch.column("ids"), "score": score})

    top = hits.withColumn("nth", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "class"))).where(F.col("nth") <= keep)
    of = packed.select(F.col("class").alias("query"), F.col("vec").alias("qvec"))
    met = top.select("query", "class").join(packed, "class").join(of, "query").select("query", "qvec", "vec", "ids")
    pairs = met.mapInArrow(rerank, "query long, ids array<long>, score double").select("query", "score", F.explode("ids").alias("vec_id"))
    pairs = asked.select(F.col("class").alias("query"), F.col("id").alias("query_id")).join(pairs, "query").where("query_id != vec_id")
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", n_probes: int = PROBES, exact: bool = False) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (cosine): for each row of is_query, its k nearest found among the other rows."""
    keep = k + 1 + SPARE  # the query's own class may be one
    distinct, rows = classes(vectors, id_col, vec_col, k)
    distinct = stored(distinct, "ann-classes")
    packed = stored(_packed(distinct), "ann-vectors")
    queries = vectors.where(is_query).select(F.col(id_col).cast("long").alias("id")).distinct()
    asked = stored(rows.join(queries, "id").join(distinct.select("k1", "k2", "class"), ["k1", "k2"]).select("id", "class").distinct(), "ann-queries")
    probing = packed.join(asked.select("class").distinct(), "class", "left_semi")
    if exact:
        return _answers(exhaustive(probing, packed, keep), asked, packed, keep, k)
    index, wanted = _placed(packed, 1), _placed(probing, n_probes)
    # buckets of many vectors or many visits are dealt out: blocks of vectors by blocks (turns) of the queries that visit them
    many = lambda c: F.ceil(F.coalesce(c, F.lit(0)) / MAX_BUCKET).cast("long")
    sizes = index.groupBy("part", "bucket").agg(F.count(F.lit(1)).alias("n")).join(wanted.groupBy("part", "bucket").agg(F.count(F.lit(1)).alias("m")), ["part", "bucket"])
    blocks = stored(sizes.where((F.col("n") > MAX_BUCKET) | (F.col("m") > MAX_BUCKET)).select("part", "bucket", many(F.col("n")).alias("blocks"), many(F.col("m")).alias("turns")), "ann-blocks")  # a row for each large bucket
    one = F.lit(1).cast("long")
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(c, one) - 1))
    index = index.join(blocks, ["part", "bucket"], "left").withColumns({"block": _dealt(F.coalesce("blocks", one)), "turn": every(F.col("turns"))})
    blocks = blocks.select(*[F.col(c).alias(c) for c in blocks.columns])  # names of its own
    wanted = wanted.join(blocks, ["part", "bucket"], "left").withColumns({"turn": _dealt(F.coalesce("turns", one)), "block": every(F.col("blocks"))})
    hits = stored(_joined(wanted, index, ["part", "bucket", "block", "turn"], keep), "ann-hits")
    answers = _answers(hits, asked, packed, keep, k)
    # queries with fewer answers than asked: all vectors (the most that any can have is one less than there are)
    least = F.lit(min(k, rows.limit(k + 1).count() - 1))
    short = asked.join(answers.groupBy(F.col("query_id").alias("id")).count(), "id", "left").where(F.coalesce("count", F.lit(0)) < least).select("id", "class")
    if short.isEmpty():
        return answers
    short = stored(short, "ann-short")
    rest = _answers(exhaustive(packed.join(short.select("class").distinct(), "class", "left_semi"), packed, keep), short, packed, keep, k)
    return answers.join(short, F.col("query_id") == F.col("id"), "left_anti").unionByName(rest)
