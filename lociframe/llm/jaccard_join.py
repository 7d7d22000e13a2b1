"""Exact n-gram Jaccard join with a count-vector R-tree.

A document's set is its distinct runs of five words (A-Z lower-cased), or its whole word sequence if
shorter. Texts with equal sets form a class, known by a 64-bit hash of the set. Two sets link when
100 * intersection >= 80 * union, that is 9 * intersection >= 4 * (size + size).

Tokens are hashed into groups, twice. Coarsely, the counts of a set's tokens in GROUPS groups are its point,
and the intersection of two sets is at most the sum of the smaller counts; a packed R-tree of points leaves
out boxes that can't reach what a link asks for, and surviving pairs are verified on the texts' full sets.
Finely, groups deal the points out: two sets that link differ in at most (size + size) / 9 tokens, so among
more groups than that one holds the same tokens in both, and a set goes to the buckets named by the contents
of its first size / 4 + 1 groups that hold any. The number of groups is the power of two that suits
size + size, so a set has buckets at one or two levels. Tokens of many documents (a common passage, say) are
left out of the contents; what a sample tells of them decides how much work there is, never the result.
Sets with too few groups left also go to the buckets of their prefix: in any global order, two sets that
link share one of the first n - ceil(0.8 n) + 1 tokens of each, and rare tokens come first.

What is connected needs no further comparison. First each class meets the pivots of two of its buckets, which
settles large groups of copies at one pair a class; then buckets that still hold several components are
searched, large ones in blocks, by the trees of their points.

Null texts and texts without words have size 0 and link with nothing. Rows with a null id take no part
and get a null component. Repeated rows are copies of one another; ties can't arise, as all links count.
Very long texts are read a block at a time and have no other treatment. Extra columns are not read; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import few_rows, free_shuffles, fresh, lower_ascii, mix, shingle_hashes, short_batches, stored, text_blocks, word_hashes, word_spans

GROUPS = 256
CEILING = 255
#: Token frequencies are read off about so many documents; tokens in fewer of them than FREQUENT count as rare.
SAMPLE_DOCS = 20_000
FREQUENT = 8
MAX_FREQUENT = 200_000
#: Tokens in one of so many sampled documents name no bucket.
OFTEN_ONE_IN = 200
BLOCK = 4096
LEAF = 16
RUN_ROWS = 1_000_000
#: Open rows up to which all open buckets are searched at once.
SEARCH_AT_ONCE = 2_000_000


def token_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct token hashes of each text, sorted, one text after another; where each text's begin."""
    data = lower_ascii(data)
    begins, ends, rows = word_spans(data, offsets)
    n = len(offsets) - 1
    of, tokens = shingle_hashes(word_hashes(data, begins, ends), rows, n)
    starts = np.searchsorted(of, np.arange(n + 1))
    parts = [np.unique(tokens[a:b]) for a, b in zip(starts[:-1], starts[1:], strict=True)]
    return np.concatenate([np.zeros(0, np.uint64), *parts]), np.concatenate(([0], np.cumsum([len(p) for p in parts], dtype=np.int64)))


def set_hashes(tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One signed 64-bit number for each set of tokens."""
    sums = np.zeros(len(tokens) + 1, np.uint64)
    np.cumsum(mix(tokens ^ np.uint64(0xA5A5A5A5A5A5A5A5)), out=sums[1:])
    return mix(sums[starts[1:]] - sums[starts[:-1]] + np.diff(starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def group_counts(tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The point of each set; counts stop at CEILING."""
    n = len(starts) - 1
    at = np.repeat(np.arange(n), np.diff(starts)) * GROUPS + (tokens & np.uint64(GROUPS - 1)).astype(np.int64)
    return np.minimum(np.bincount(at, minlength=n * GROUPS), CEILING).astype(np.uint8).reshape(n, GROUPS)


def overlap_bound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The largest intersection of sets with points up to a and b: summed coordinate minima (a count at its ceiling bounds nothing)."""
    least = np.minimum(a, b)
    total = least.sum(-1, dtype=np.int64)
    return np.where((least == CEILING).any(-1), np.iinfo(np.int64).max // 16, total) if len(total) and least.max() == CEILING else total


def may_link(a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether sets of points up to a and b and of that total size can link."""
    return 9 * overlap_bound(a, b) >= 4 * sizes


def _level(total: np.ndarray) -> np.ndarray:
    """The level of two sets of that total size: 2 ** level groups, a third more than tokens in which they may differ."""
    return np.maximum(1, np.ceil(np.log2(np.maximum(total, 1) * 0.15))).astype(np.int64)


def group_keys(tokens: np.ndarray, starts: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set, key) of the buckets named by groups' contents, and which sets have too few groups for that to suffice.

    Sets of fewer than four tokens link with no other set and have none."""
    n = np.diff(starts)
    of = np.repeat(np.arange(len(n)), n)
    use = n[of] >= 4
    if len(often):
        use &= often[np.minimum(np.searchsorted(often, tokens), len(often) - 1)] != tokens
    tokens, of = tokens[use], of[use]
    differ, low, high = n // 4, _level(n + -(-4 * n // 5)), _level(n + 5 * n // 4)
    sets, keys, poor = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], np.zeros(len(n), bool)
    for level, on in ((low, n >= 4), (high, (n >= 4) & (high > low))):
        own, owner = tokens[on[of]], of[on[of]]
        group = own >> (64 - level[owner]).astype(np.uint64)
        first = np.ones(len(own), bool)
        first[1:] = (group[1:] != group[:-1]) | (owner[1:] != owner[:-1])
        at = np.flatnonzero(first)
        contents = np.add.reduceat(mix(own ^ np.uint64(0x6A09E667F3BCC909)), at) if len(at) else own
        owner = owner[at]
        begins = np.searchsorted(owner, np.arange(len(n) + 1))
        poor |= on & (np.diff(begins) <= differ)
        taken = np.arange(len(at)) - begins[owner] <= differ[owner]
        sets.append(owner[taken])
        keys.append(mix(contents[taken] + level[owner[taken]].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    return np.concatenate(sets), np.concatenate(keys), poor


def frequent_tokens(texts: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens in FREQUENT or more of about SAMPLE_DOCS documents, sorted, and their counts; MAX_FREQUENT at most."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for _, _, data, offsets in text_blocks(batch.column("text")):
                token, count = np.unique(token_sets(data, offsets)[0], return_counts=True)
                yield pa.RecordBatch.from_pydict({"token": token.view(np.int64), "n": count})

    sample = texts.sample(fraction=min(1.0, SAMPLE_DOCS / max(n, 1)), seed=3).select("text")
    counted = sample.mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
    found = counted.orderBy(F.desc("n"), "token").limit(MAX_FREQUENT).toPandas()
    token = found["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(token)
    return token[order], found["n"].to_numpy(np.int64)[order]


def _lists(of: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    """A list of values for each of n rows."""
    order = np.argsort(of, kind="stable")
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(of[order], np.arange(n + 1)), pa.int32()), pa.array(values[order].view(np.int64)))


def signatures(texts: DataFrame, frequent: tuple[np.ndarray, np.ndarray], n_docs: int) -> DataFrame:
    """id, h (a hash of the text), n (set size), sid (the class; null for empty sets), point, keys and hot (buckets, and those of tokens in
    many documents); the last three once a class and task, on a row with an id, as rows without one are left
    out later."""
    least = max(FREQUENT, min(n_docs, SAMPLE_DOCS) // OFTEN_ONE_IN)
    cast = texts.sparkSession.sparkContext.broadcast((*frequent, frequent[0][frequent[1] >= least]))  # MAX_FREQUENT numbers at most

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts, often = cast.value
        seen: set[int] = set()

        def prefix(own: np.ndarray) -> np.ndarray:
            at = np.minimum(np.searchsorted(known, own), max(len(known) - 1, 0))
            rank = np.where(known[at] == own, counts[at], 0) if len(known) else np.zeros(len(own), np.int64)
            return own[np.argsort(rank, kind="stable")[: len(own) - -(-4 * len(own) // 5) + 1]]

        for batch in it:
            for low, high, data, offsets in text_blocks(batch.column("text")):
                tokens, starts = token_sets(data, offsets)
                n, sid, ids = np.diff(starts), set_hashes(tokens, starts), batch.column("id").slice(low, high - low)
                new = np.zeros(high - low, bool)
                for k in np.flatnonzero((n > 0) & ids.is_valid().to_numpy(zero_copy_only=False)):
                    if (s := int(sid[k])) not in seen:
                        seen.add(s)
                        new[k] = True
                rows = np.flatnonzero(new)
                own = tokens[np.repeat(new, n)]
                begins = np.concatenate(([0], np.cumsum(n[rows])))
                of, keys, poor = group_keys(own, begins, often)
                rest = [(k, prefix(own[begins[k] : begins[k + 1]])) for k in np.flatnonzero(poor)]
                po = np.repeat(np.array([k for k, _ in rest], np.int64), [len(p) for _, p in rest])
                pk = np.concatenate([np.zeros(0, np.uint64), *[p for _, p in rest]])
                hot = np.isin(pk, often)
                pk = mix(pk ^ np.uint64(0xBB67AE8584CAA73B))
                points = np.full(high - low, None, object)
                points[rows] = [p.tobytes() for p in group_counts(own, begins)]
                yield pa.RecordBatch.from_pydict({
                    "id": ids, "h": batch.column("h").slice(low, high - low), "n": n, "sid": pa.array(sid, mask=n == 0), "point": pa.array(points, pa.binary()),
                    "keys": _lists(rows[np.concatenate((of, po[~hot]))], np.concatenate((keys, pk[~hot])), high - low),
                    "hot": _lists(rows[po[hot]], pk[hot], high - low),
                })

    return texts.mapInArrow(run, "id long, h long, n long, sid long, point binary, keys array<long>, hot array<long>")


def _runs(it: Iterator[pa.RecordBatch], keys: list[str], most: int = 1 << 62) -> Iterator[tuple[pa.Table, np.ndarray, bool]]:
    """Tables of whole runs of equal keys from sorted rows, where each run begins, and whether it is a part of
    a run only: a run of over most rows comes in parts."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def cut(table: pa.Table) -> np.ndarray:
        new = np.zeros(len(table), bool)
        new[:1] = True
        for k in keys:
            v = table.column(k).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(new)

    cutting = False
    for batch in it:
        held.append(batch)
        rows += len(batch)
        if rows < 50_000:
            continue
        table = pa.Table.from_batches(held)
        begins = cut(table)
        last = int(begins[-1])
        if cutting and len(begins) > 1:  # the rest of a run that came in parts
            yield table.slice(0, int(begins[1])), np.zeros(1, np.int64), True
            table, begins, last, cutting = table.slice(int(begins[1])), begins[1:] - begins[1], last - int(begins[1]), False
        if last:
            yield table.slice(0, last), begins[:-1], False
        table, rows = table.slice(last), len(table) - last
        if rows > most:
            yield table, np.zeros(1, np.int64), True
            table, rows, cutting = table.slice(rows), 0, True
        held = table.combine_chunks().to_batches()
    if rows:
        table = pa.Table.from_batches(held)
        begins = cut(table)
        if cutting:
            end = int(begins[1]) if len(begins) > 1 else len(table)
            yield table.slice(0, end), np.zeros(1, np.int64), True
            table, begins = table.slice(end), begins[1:] - end
        if len(table):
            yield table, begins, False


def buckets(signed: DataFrame) -> DataFrame:
    """(bucket, sid, m): the classes of every key that two or more share, m of them about; once for each distinct
    list of classes, but for keys in many documents."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for table, begins, part in _runs(it, ["key"], RUN_ROWS):
            key, sid = (table.column(c).to_numpy() for c in ("key", "sid"))
            if part:
                yield pa.RecordBatch.from_pydict({"bucket": key, "sid": sid, "m": np.full(len(key), RUN_ROWS)})
                continue
            run_of = np.zeros(len(key), np.int64)
            run_of[begins[1:]] = 1
            run_of = np.cumsum(run_of)
            first = np.ones(len(key), bool)
            first[1:] = (sid[1:] != sid[:-1]) | (run_of[1:] != run_of[:-1])
            sid, run_of = sid[first], run_of[first]
            sizes = np.bincount(run_of)
            name = mix(np.add.reduceat(mix(sid.view(np.uint64)), np.concatenate(([0], np.cumsum(sizes)[:-1]))) + sizes.astype(np.uint64)).view(np.int64)
            use = sizes > 1
            for k in np.flatnonzero(use):
                if (x := int(name[k])) in seen:
                    use[k] = False
                else:
                    seen.add(x)
            if len(seen) > 1_000_000:
                seen.clear()
            pick = use[run_of]
            if pick.any():
                yield pa.RecordBatch.from_pydict({"bucket": name[run_of[pick]], "sid": sid[pick], "m": sizes[run_of[pick]]})

    posted = signed.select(F.explode("keys").alias("key"), "sid")
    found = posted.repartition("key").sortWithinPartitions("key", "sid").mapInArrow(run, "bucket long, sid long, m long")
    # keys known to be in many documents need no meeting in one task to find that out
    hot = signed.select(F.explode("hot").alias("bucket"), "sid").distinct()
    sizes = hot.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1")  # MAX_FREQUENT rows at most
    return found.unionByName(hot.join(F.broadcast(sizes), "bucket").select("bucket", "sid", "m")).distinct()


def tree_pairs(points: np.ndarray, sizes: np.ndarray, comp: np.ndarray, side: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of different comp (and of different side, if sides are given) whose bound allows a link, by
    joining a packed R-tree with itself; some at a time."""
    order = np.lexsort((points[:, 2], points[:, 1], points[:, 0], sizes))
    p, n, c = points[order], sizes[order], comp[order]
    levels = [(p, n, c, c)]
    while len(levels[-1][1]) > LEAF:
        hi, lo, c0, c1 = levels[-1]
        at = np.arange(0, len(lo), LEAF)
        levels.append((np.maximum.reduceat(hi, at), np.minimum.reduceat(lo, at), np.minimum.reduceat(c0, at), np.maximum.reduceat(c1, at)))
    a, b = np.triu_indices(len(levels[-1][1]))
    stack = [(len(levels) - 1, a, b)]
    while stack:
        level, a, b = stack.pop()
        if len(a) > 65_536:  # a piece at a time keeps memory small
            half = len(a) // 2
            stack += [(level, a[half:], b[half:]), (level, a[:half], b[:half])]
            continue
        hi, lo, c0, c1 = levels[level]
        apart = (c0[a] != c1[b]) | (c1[a] != c0[b])
        a, b = a[apart], b[apart]
        near = may_link(hi[a], hi[b], lo[a] + lo[b])
        a, b = a[near], b[near]
        if not len(a):
            continue
        if level == 0:
            keep = a < b
            if side is not None:
                keep &= side[order[a]] != side[order[b]]
            yield order[a[keep]], order[b[keep]]
            continue
        below = len(levels[level - 1][1])
        for part in range(0, len(a), 256):
            x, y = a[part : part + 256], b[part : part + 256]
            i = (x[:, None, None] * LEAF + np.arange(LEAF)[None, :, None]) + np.zeros((1, 1, LEAF), np.int64)
            j = (y[:, None, None] * LEAF + np.arange(LEAF)[None, None, :]) + np.zeros((1, LEAF, 1), np.int64)
            i, j = i.ravel(), j.ravel()
            real = (i < below) & (j < below) & (i <= j)
            stack.append((level - 1, i[real], j[real]))


def likeliest_pairs(points: np.ndarray, sizes: np.ndarray, comp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each member with the one of another comp whose bound exceeds what a link asks for by most, if any does."""
    most, with_ = np.full(len(sizes), -1.0), np.full(len(sizes), -1)
    for a, b in tree_pairs(points, sizes, comp):
        over = overlap_bound(points[a], points[b]) / (sizes[a] + sizes[b])
        for x, y in ((a, b), (b, a)):
            order = np.lexsort((over, x))
            last = order[np.append(x[order][1:] != x[order][:-1], True)] if len(x) else order
            last = last[over[last] > most[x[last]]]
            most[x[last]], with_[x[last]] = over[last], y[last]
    found = np.flatnonzero(with_ >= 0)
    yield found, with_[found]


def star_pairs(members: DataFrame, points: DataFrame) -> DataFrame:
    """(a, b) with a < b: each class with the pivots of two of its buckets, if their points allow a link. The two
    are those of the smallest hashes, so like classes choose alike; a pivot is the member of the smallest hash."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            p, q = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, GROUPS) for c in ("point", "q"))
            n, a, b = batch.column("n").to_numpy() + batch.column("o").to_numpy(), batch.column("sid").to_numpy(), batch.column("t").to_numpy()
            keep = may_link(p, q, n)
            yield _pair_batch([(a[keep], b[keep])])

    least = [F.min(F.struct(F.xxhash64(F.lit(k), "bucket").alias("h"), "bucket")).alias(f"b{k}") for k in (0, 1)]
    chosen = members.groupBy("sid").agg(*least).join(points, "sid")
    chosen = chosen.select(F.explode(F.array_distinct(F.array("b0.bucket", "b1.bucket"))).alias("bucket"), "sid", "n", "point")
    pivots = chosen.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("sid").alias("h"), "sid", "n", "point")).alias("v"))
    met = chosen.join(pivots.select("bucket", F.col("v.sid").alias("t"), F.col("v.n").alias("o"), F.col("v.point").alias("q")), "bucket").where("sid != t")
    return met.select("sid", "n", "point", "t", "o", "q").mapInArrow(run, "a long, b long").distinct()


def candidates(rows: DataFrame, points: DataFrame, likeliest: bool) -> DataFrame:
    """(a, b) with a < b: the pairs of open buckets, rows (bucket, sid, m, comp), that the trees let through, of
    different comp; or each class's likeliest partner of them. Buckets over BLOCK members come in blocks; every
    two blocks meet once, or each stays by itself for the likeliest partners."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, begins, _ in _runs(it, ["bucket", "i", "j"]):
            sid, comp, n, side, i, j = (table.column(c).to_numpy() for c in ("sid", "comp", "n", "side", "i", "j"))
            point = np.frombuffer(b"".join(table.column("point").to_pylist()), np.uint8).reshape(-1, GROUPS)
            ends = np.append(begins[1:], len(sid))
            two = begins[ends - begins == 2]
            ok = may_link(point[two], point[two + 1], n[two] + n[two + 1]) & (comp[two] != comp[two + 1]) & ((i[two] == j[two]) | (side[two] != side[two + 1]))
            found, held = [(sid[two[ok]], sid[two[ok] + 1])], 0
            for low, high in zip(begins, ends, strict=True):
                if high - low > 2:
                    own = slice(int(low), int(high))
                    if likeliest:
                        pairs = likeliest_pairs(point[own], n[own], comp[own])
                    else:
                        pairs = tree_pairs(point[own], n[own], comp[own], side[own] if i[low] != j[low] else None)
                    for x, y in pairs:
                        found.append((sid[own][x], sid[own][y]))
                        held += len(x)
                        if held > 200_000:
                            yield _pair_batch(found)
                            found, held = [], 0
            yield _pair_batch(found)

    rows = rows.withColumn("parts", F.ceil(F.col("m") / BLOCK).cast("long")).withColumn("side", F.pmod(F.xxhash64("sid"), F.col("parts")))
    if likeliest:
        rows = rows.withColumns({"i": F.col("side"), "j": F.col("side")})
    else:
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        rows = rows.withColumns({"i": F.least("side", "other"), "j": F.greatest("side", "other")})
    rows = rows.join(points, "sid").select("bucket", "i", "j", "side", "sid", "comp", "n", "point")
    return rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(run, "a long, b long").distinct()


def _pair_batch(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    x, y = (np.concatenate(z) for z in zip(*found, strict=True))
    pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0) if len(x) else np.zeros((0, 2), np.int64)
    return pa.RecordBatch.from_pydict({"a": pairs[:, 0], "b": pairs[:, 1]})


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a stored table) whose texts' sets link; texts has (sid, text)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for low, high, data, offsets in text_blocks(batch.column("ta")):
                own = batch.slice(low, high - low)
                left, ls = token_sets(data, offsets)
                keep = set_hashes(left, ls) == own.column("a").to_numpy()
                for low2, high2, data2, offsets2 in text_blocks(own.column("tb")):
                    right, rs = token_sets(data2, offsets2)
                    keep[low2:high2] &= set_hashes(right, rs) == own.column("b").to_numpy()[low2:high2]
                    for k in range(low2, high2):
                        x, y = left[ls[k] : ls[k + 1]], right[rs[k - low2] : rs[k - low2 + 1]]
                        keep[k] &= 9 * len(np.intersect1d(x, y, assume_unique=True)) >= 4 * (len(x) + len(y))
                yield own.select(["a", "b"]).filter(pa.array(keep))

    asked = few_rows(pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct(), 2 * pairs.count())
    texts = texts.join(asked, "sid", "left_semi")
    left = texts.select(F.col("sid").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("sid").alias("b"), F.col("text").alias("tb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long").distinct()


def _placed(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """rows (.., sid) with the component that sid is known to be in, itself at least."""
    return rows.join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("comp", F.coalesce("root", "sid")).drop("root")


def _classed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, h (a hash of the text), n and, where the set isn't empty and the id isn't null, component: the smallest (id, h) reachable."""
    short_batches(docs.sparkSession)
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    n_docs = docs.count()
    signed = stored(signatures(texts, frequent_tokens(texts, n_docs), n_docs), "signatures")
    named = signed.where("id is not null and sid is not null")
    classes = stored(named.groupBy("sid").agg(F.min(F.struct("id", "h")).alias("rep"), F.max("n").alias("n"), F.max("point").alias("point")), "classes")
    members = stored(buckets(named), "buckets")
    free_shuffles(spark)
    shared = stored(members.select("sid").distinct().join(classes, "sid"), "shared")
    points = shared.select("sid", "n", "point")
    reps = few_rows(shared.select("rep.id", "rep.h", "sid"), shared.count())
    needed = stored(texts.join(reps, ["id", "h"]).select("sid", "text"), "texts")
    pairs = stored(star_pairs(members, points), "pairs")
    links = stored(verified(pairs, needed), "links")
    free_shuffles(spark)
    roots = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    open_ = members
    for likeliest in (True, False):
        placed = _placed(open_, roots)
        several = placed.groupBy("bucket").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 != c1").select("bucket")
        open_ = stored(placed.join(several, "bucket", "left_semi"), "open")
        work = open_.agg(F.sum("m")).first()[0]  # pairs at most, twice
        if work is None:
            break
        if likeliest and work <= SEARCH_AT_ONCE:
            open_ = open_.drop("comp")
            continue
        more = stored(candidates(open_, points, likeliest).join(pairs, ["a", "b"], "left_anti"), "pairs")
        found = stored(verified(more, needed), "links")
        free_shuffles(spark)
        pairs, links, open_ = pairs.unionByName(more), links.unionByName(found), open_.drop("comp")
        if found.count():
            roots = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    least = _placed(classes.select("sid", "rep"), roots)
    least = least.join(least.groupBy("comp").agg(F.min("rep").alias("component")), "comp").select("sid", "component")
    out = signed.select("id", "h", "n", "sid").join(least, "sid", "left")
    return out.select("id", "h", "n", F.when(F.col("id").isNotNull(), F.col("component")).alias("component"))


def similarity_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: id, n_shingles, component_id (the smallest id reachable by links, itself included)."""
    found = _classed(docs, id_col, text_col)
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component.id", "id").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: that of the smallest id and, where an id has several texts, of the smallest hash of its
    text. Rows that repeat an id with an unlike text are documents of their own; of equal (id, text) one row stays, and of texts
    without words, or rows with a null id, all do."""
    found = stored(_classed(docs, id_col, text_col), "classed")
    gone = stored(found.where("id != component.id or h != component.h").select("id", "h").distinct(), "gone")
    gone = few_rows(gone, gone.count())
    id_, of_ = F.col(id_col).cast("long"), F.xxhash64(F.col(text_col).cast("string"))
    kept = docs.join(gone, (id_ == gone["id"]) & (of_ == gone["h"]), "left_anti")
    twice = found.where("component is not null").groupBy("id", "h").count().where("count > 1").limit(1)
    if twice.isEmpty():
        return kept
    own_id, own_of = fresh(docs.columns, "__id", "__of")
    kept = kept.withColumns({own_id: id_, own_of: of_})
    once = stored(found.where("component is not null").select(F.col("id").alias(own_id), F.col("h").alias(own_of)).distinct(), "once")
    single = kept.join(once, [own_id, own_of], "left_semi").dropDuplicates([own_id, own_of])
    return single.unionByName(kept.join(once, [own_id, own_of], "left_anti")).select(*docs.columns)
