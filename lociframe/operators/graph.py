"""Graph operators on edges(src, dst, weight): connected parts and modularity clustering."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import materialized

#: Links and entries of walks up to which the rounds of a clustering run in one task: as jobs they would cost more than their work.
SMALL = 1 << 22


def _in_one_task(rows: DataFrame, find: Callable[[dict[str, np.ndarray]], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """node, c: what find gives for all rows, by column; a table whose size is bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            t = pa.Table.from_batches(held)
            found = find({c: t[c].to_numpy() for c in t.column_names})
            yield from pa.table({"node": found[0].astype(np.int64), "c": found[1].astype(np.int64)}).to_batches(65_536)

    return materialized(rows.repartition(1).mapInArrow(run, "node long, c long"), "clusters")


def _half(nodes: np.ndarray, *more: int) -> np.ndarray:
    """pmod(xxhash64(node, *more), 2)."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turned = lambda x, r: (x << np.uint64(r)) | (x >> np.uint64(64 - r))

    def mixed(h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        return h ^ (h >> np.uint64(32))

    h = (np.full(len(nodes), 42, np.uint64) + p5 + np.uint64(8)) ^ (turned(nodes.astype(np.int64).view(np.uint64) * p2, 31) * p1)
    h = mixed(turned(h, 27) * p1 + p4)
    for x in more:
        h = h + p5 + np.uint64(4)
        h = mixed(turned(h ^ (np.full(len(nodes), x, np.uint64) * p1), 23) * p2 + p3)
    return (h & np.uint64(1)).astype(np.int64)


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    start = np.flatnonzero(np.diff(keys[order], prepend=-1) != 0)
    return keys[order[start]], np.add.reduceat(values[order], start) if len(start) else np.zeros(0)


def _swept(src: np.ndarray, dst: np.ndarray, weight: np.ndarray, names: np.ndarray, m2: float, resolution: float, level: int, sweeps: int) -> np.ndarray:
    """_moved() in one task: the place of each node's cluster; src and dst are places in names, which ascend."""
    n = len(names)
    k = np.bincount(src, weight, n)
    own, other = np.arange(n), src != dst
    src, dst, weight, moving = src[other], dst[other], weight[other], True
    for turn in range(2 * sweeps):
        total = np.bincount(own, k, n)
        pair, w = _summed(np.r_[src * n + own[dst], np.arange(n) * n + own], np.r_[weight, np.zeros(n)])
        node, to = pair // n, pair % n
        now = to == own[node]
        gain = w - resolution * k[node] * (total[to] - np.where(now, k[node], 0.0)) / m2
        start = np.searchsorted(node, np.arange(n))
        close = np.round(gain, 9)
        best = np.flatnonzero(close == np.maximum.reduceat(close, start)[node])
        best = to[best[np.searchsorted(node[best], np.arange(n))]]  # of equal ones the smallest
        moves = (_half(names, level, turn // 2) == turn % 2) & (np.maximum.reduceat(gain, start) > gain[now] + 1e-9)
        own = np.where(moves, best, own)
        moved = bool(moves.any())
        if turn % 2 and not (moved or moving):
            break
        moving = moved
    return own


def _louvain_of(graph: dict[str, np.ndarray], resolution: float, sweeps: int) -> tuple[np.ndarray, np.ndarray]:
    """louvain() of graph (src, dst, weight) in one task: its nodes and their clusters' names."""
    names, ends = np.unique(np.r_[graph["src"], graph["dst"]], return_inverse=True)
    src, dst, weight = ends[: len(graph["src"])], ends[len(graph["src"]) :], graph["weight"].astype(float)
    label, level, nodes = np.arange(len(names)), 0, names
    while (m2 := weight.sum()) > 0:
        own = _swept(src, dst, weight, names, m2, resolution, level, sweeps)
        left, place = np.unique(own, return_inverse=True)
        label = place[label]
        pair, weight = _summed(place[src] * len(left) + place[dst], weight)
        src, dst, before = pair // len(left), pair % len(left), len(names)
        names, level = names[left], level + 1
        if len(left) >= before:
            break
    return nodes, names[label]


def symmetric(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of each node's connected part; edges(src, dst).

    Each round takes the least root among the neighbours and then that root's root, so long paths halve."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    roots = materialized(nodes.select("node", F.col("node").alias("root")), "roots")
    while True:
        near = both.join(roots.select(F.col("node").alias("dst"), "root"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("root").alias("near"))
        step = roots.join(near, "node", "left").select("node", "root", F.least("root", F.coalesce("near", "root")).alias("up"))
        jump = step.select(F.col("node").alias("up"), F.col("up").alias("far"))
        moved = materialized(step.join(jump, "up").select("node", F.least("up", "far").alias("root"), (F.col("root") != F.least("up", "far")).alias("moved")), "roots")
        roots = moved.select("node", "root")
        if moved.where("moved").isEmpty():
            return roots


def split_disconnected(clusters: DataFrame, edges: DataFrame) -> DataFrame:
    """node, cluster: each cluster's connected parts numbered densely by (cluster, smallest node)."""
    a = clusters.select(F.col("node").alias("src"), F.col("cluster").alias("cs"))
    b = clusters.select(F.col("node").alias("dst"), F.col("cluster").alias("cd"))
    inside = edges.join(a, "src").join(b, "dst").where("cs = cd").select("src", "dst")
    rooted = connected(clusters.select("node"), inside).join(clusters, "node")
    parts = rooted.select("cluster", "root").distinct().withColumn("part", F.dense_rank().over(Window.orderBy("cluster", "root")) - 1)
    return rooted.join(parts, ["cluster", "root"]).select("node", F.col("part").alias("cluster"))


def modularity(clusters: DataFrame, edges: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row: sum of inner weight share less resolution times squared degree share, over clusters."""
    both = symmetric(edges)
    a = both.join(clusters.select(F.col("node").alias("src"), F.col("cluster").alias("cs")), "src").join(clusters.select(F.col("node").alias("dst"), F.col("cluster").alias("cd")), "dst")
    sums = a.groupBy(F.col("cs").alias("cluster")).agg(F.sum(F.when(F.col("cs") == F.col("cd"), F.col("weight")).otherwise(0.0)).alias("inner"), F.sum("weight").alias("degree"))
    total = sums.agg(F.sum("degree").alias("m2"))
    share = F.col("inner") / F.col("m2") - resolution * F.pow(F.col("degree") / F.col("m2"), 2)
    return sums.join(F.broadcast(total), F.lit(True)).agg(F.sum(share).alias("modularity"))


def _moved(graph: DataFrame, own: DataFrame, m2: float, resolution: float, level: int, sweeps: int) -> DataFrame:
    """own (node, c, k) once no node gains modularity by moving to a neighbour's cluster.

    Moves are made for all nodes of a round at once. A sweep is two rounds: a hash of node and sweep names the half that may
    move in the first, the others may in the second, which stops pairs of nodes from swapping for ever. Sweeps go on until
    one moves nothing (100 at most, as in the reference)."""
    moving = True
    for turn in range(2 * sweeps):
        totals = own.groupBy("c").agg(F.sum("k").alias("tot"))
        links = graph.where("src != dst").join(own.select(F.col("node").alias("dst"), "c"), "dst").groupBy(F.col("src").alias("node"), "c").agg(F.sum("weight").alias("w"))
        stay = own.select("node", "c").withColumn("w", F.lit(0.0))
        choice = links.unionByName(stay).groupBy("node", "c").agg(F.sum("w").alias("w")).join(totals, "c").join(own.select("node", F.col("c").alias("now"), "k"), "node")
        rest = F.col("tot") - F.when(F.col("c") == F.col("now"), F.col("k")).otherwise(0.0)
        gain = F.col("w") - resolution * F.col("k") * rest / m2
        best = choice.withColumn("gain", gain).groupBy("node").agg(F.max_by("c", F.struct(F.round("gain", 9), -F.col("c"))).alias("to"), F.max("now").alias("now"), F.max("k").alias("k"), F.max("gain").alias("g"), F.max(F.when(F.col("c") == F.col("now"), F.col("gain"))).alias("g0"))
        free = F.pmod(F.xxhash64("node", F.lit(level), F.lit(turn // 2)), F.lit(2)) == turn % 2
        moves = free & (F.col("g") > F.col("g0") + 1e-9)
        step = materialized(best.select("node", F.when(moves, F.col("to")).otherwise(F.col("now")).alias("c"), "k", moves.alias("moved")), "louvain-step")
        own = step.select("node", "c", "k")
        moved = not step.where("moved").isEmpty()
        if turn % 2 and not (moved or moving):
            break
        moving = moved
    return own


def _merged(graph: DataFrame, parts: DataFrame) -> DataFrame:
    """The graph of parts (node, c); edges within a part become a self loop."""
    a, b = parts.select(F.col("node").alias("src"), F.col("c").alias("cs")), parts.select(F.col("node").alias("dst"), F.col("c").alias("cd"))
    return materialized(graph.join(a, "src").join(b, "dst").groupBy(F.col("cs").alias("src"), F.col("cd").alias("dst")).agg(F.sum("weight").alias("weight")), "louvain-graph")


def _dense(label: DataFrame) -> DataFrame:
    names = label.select("cluster").distinct().withColumn("dense", F.dense_rank().over(Window.orderBy("cluster")) - 1)
    return label.join(names, "cluster").select("node", F.col("dense").alias("cluster"))


def _begun(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    label = materialized(nodes.select("node", F.col("node").alias("cluster")), "louvain")
    return label, materialized(symmetric(edges).groupBy("src", "dst").agg(F.sum("weight").alias("weight")), "louvain-graph")


def louvain(nodes: DataFrame, edges: DataFrame, resolution: float = 1.0, sweeps: int = 100) -> DataFrame:
    """node, cluster (dense from 0): local moving by modularity gain, then the same on the graph of clusters, until no clusters merge.
    Up to SMALL links that is one task, more go by jobs for each round; either gives the same."""
    label, graph = _begun(nodes, edges)
    if graph.schema["src"].dataType.simpleString() == "bigint" and graph.count() <= SMALL:
        found = _in_one_task(graph, lambda g: _louvain_of(g, resolution, sweeps))
        return _dense(label.join(found, "node", "left").select("node", F.coalesce("c", "cluster").alias("cluster")))
    level = 0
    while True:
        degree = materialized(graph.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("k")), "louvain-degree")
        m2 = degree.agg(F.sum("k")).first()[0]
        if not m2:
            break
        nodes_before = degree.count()
        own = _moved(graph, degree.select("node", F.col("node").alias("c"), "k"), m2, resolution, level, sweeps)
        label = materialized(label.join(own.select(F.col("node").alias("cluster"), "c"), "cluster", "left").select("node", F.coalesce("c", "cluster").alias("cluster")), "louvain")
        graph = _merged(graph, own)
        level += 1
        if own.select("c").distinct().count() >= nodes_before:
            break
    return _dense(label)


def _refined(graph: DataFrame, own: DataFrame, m2: float, resolution: float, level: int, rounds: int = 8) -> DataFrame:
    """node, c: the parts of each cluster of own (node, c, k) that hang well together.

    Every node begins as a part of its own. In a round the nodes of one half (by hash) that still are alone, and that are well
    connected to the rest of their cluster, join the part of the other half with the largest gain, if it is positive and that part is
    well connected too. What joins is linked to what it joins and what is joined doesn't move, so parts are connected."""
    within = graph.where("src != dst").join(own.select(F.col("node").alias("src"), "c"), "src").join(own.select(F.col("node").alias("dst"), F.col("c").alias("cd")), "dst").where("c = cd").select("src", "dst", "weight")
    within = materialized(within, "leiden-within")
    totals = own.groupBy("c").agg(F.sum("k").alias("tot"))
    linked = within.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("w"))
    held = own.join(totals, "c").join(linked, "node", "left")
    well = F.coalesce("w", F.lit(0.0)) >= resolution * F.col("k") * (F.col("tot") - F.col("k")) / m2
    parts = materialized(held.select("node", "c", "k", "tot", well.alias("well"), F.col("node").alias("part")), "leiden-parts")
    for turn in range(rounds):
        sizes = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("kp"), F.max("tot").alias("tot"))
        a = parts.select(F.col("node").alias("src"), F.col("part").alias("ps"))
        b = parts.select(F.col("node").alias("dst"), F.col("part").alias("pd"))
        cut = within.join(a, "src").join(b, "dst").where("ps != pd")
        outer = cut.groupBy(F.col("ps").alias("part")).agg(F.sum("weight").alias("out"))
        sizes = sizes.join(outer, "part", "left").withColumn("firm", F.coalesce("out", F.lit(0.0)) >= resolution * F.col("kp") * (F.col("tot") - F.col("kp")) / m2)
        mover = F.pmod(F.xxhash64("node", F.lit(level), F.lit(turn)), F.lit(2)) == 0
        alone = parts.join(sizes.select("part", "n"), "part").where((F.col("n") == 1) & F.col("well") & mover).select(F.col("node").alias("src"), F.col("k").alias("ks"))
        still = sizes.where("firm").join(alone.select(F.col("src").alias("part")), "part", "left_anti").select(F.col("part").alias("pd"), "kp")
        offers = cut.join(alone, "src").groupBy("src", "ks", "pd").agg(F.sum("weight").alias("w")).join(still, "pd")
        offers = offers.withColumn("gain", F.col("w") - resolution * F.col("ks") * F.col("kp") / m2).where("gain > 1e-9")
        best = offers.groupBy(F.col("src").alias("node")).agg(F.max_by("pd", F.struct(F.round("gain", 9), -F.col("pd"))).alias("to"))
        step = materialized(parts.join(best, "node", "left").select("node", "c", "k", "tot", "well", F.coalesce("to", "part").alias("part"), F.col("to").isNotNull().alias("moved")), "leiden-parts")
        parts = step.drop("moved")
        if turn % 2 and step.where("moved").isEmpty():
            break
    return parts.select("node", F.col("part").alias("c"))


def leiden(nodes: DataFrame, edges: DataFrame, resolution: float = 1.0, sweeps: int = 100) -> DataFrame:
    """node, cluster (dense from 0): as louvain(), but the next level's nodes are the well-connected parts of the clusters, which begin there
    in their cluster. So parts may leave it again. Every cluster is connected."""
    label, graph = _begun(nodes, edges)  # label: the part that each node is in
    own, level = None, 0
    while True:
        degree = materialized(graph.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("k")), "louvain-degree")
        m2 = degree.agg(F.sum("k")).first()[0]
        if not m2:
            break
        begun = degree.select("node", F.col("node").alias("c"), "k") if own is None else degree.join(own, "node").select("node", "c", "k")
        moved = _moved(graph, begun, m2, resolution, level, sweeps)
        parts = _refined(graph, moved, m2, resolution, level)
        n, n_parts = degree.count(), parts.select("c").distinct().count()
        if n_parts == n:  # nothing merges: the clusters are final
            label = label.join(moved.select(F.col("node").alias("cluster"), "c"), "cluster", "left").select("node", F.coalesce("c", "cluster").alias("cluster"))
            break
        label = materialized(label.join(parts.select(F.col("node").alias("cluster"), F.col("c").alias("part")), "cluster", "left").select("node", F.coalesce("part", "cluster").alias("cluster")), "louvain")
        own = materialized(parts.select("node", F.col("c").alias("part")).join(moved.select("node", "c"), "node").groupBy(F.col("part").alias("node")).agg(F.max("c").alias("c")), "leiden-own")
        graph = _merged(graph, parts)
        level += 1
    return split_disconnected(_dense(materialized(label, "louvain")), edges)


def _walks_merged(rows: dict[str, np.ndarray], rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """The rounds of walktrap() in one task: nodes and clusters of rows (kind, a, b, v), the walks' places (0), edges (1) and nodes (2)."""
    walk, edge, node = (rows["kind"] == k for k in range(3))
    names, at = np.unique(np.r_[rows["a"], rows["b"]], return_inverse=True)
    n, size = len(names), len(rows["a"])
    a, b = at[:size], at[size:]
    src, dst, weight = a[edge], b[edge], rows["v"][edge].astype(float)
    key, v = _summed(a[walk] * n + b[walk], rows["v"][walk].astype(float))
    here = np.unique(a[node])
    label = np.arange(n)
    count = np.bincount(here, minlength=n).astype(float)
    links = np.unique(np.minimum(src, dst)[src != dst] * n + np.maximum(src, dst)[src != dst])
    known, dots, changed = np.zeros(0, np.int64), np.zeros(0), np.zeros(n, bool)
    best, best_label = -1.0, label
    for _ in range(rounds):
        if not len(links):
            break
        begin = np.searchsorted(key, np.arange(n + 1) * n)
        norm = np.bincount(key // n, v * v, n)
        x, y = links // n, links % n
        dot = np.zeros(len(links))
        if len(known):
            place = np.minimum(np.searchsorted(known, links), len(known) - 1)
            old = (known[place] == links) & ~changed[x] & ~changed[y]
            dot[old] = dots[place[old]]
        else:
            old = np.zeros(len(links), bool)
        todo = np.flatnonzero(~old)
        swap = begin[x + 1] - begin[x] > begin[y + 1] - begin[y]
        short, long = np.where(swap, y, x), np.where(swap, x, y)
        many = begin[short + 1] - begin[short]
        low, ends = 0, np.cumsum(many[todo])
        while low < len(todo):  # the shorter row's places are looked up in the other
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + (1 << 20), "right")))
            some = todo[low:high]
            from_ = np.repeat(begin[short[some]] - np.cumsum(many[some]) + many[some], many[some]) + np.arange(many[some].sum())
            of = np.repeat(np.arange(len(some)), many[some])
            want = long[some][of] * n + key[from_] % n
            place = np.minimum(np.searchsorted(key, want), len(key) - 1)
            dot[some] = np.bincount(of, np.where(key[place] == want, v[from_] * v[place], 0.0), len(some))
            low = high
        known, dots = links, dot
        cost = np.round(count[x] * count[y] / (count[x] + count[y]) * (norm[x] + norm[y] - 2 * dot), 12)
        rank = np.empty(len(links), np.int64)
        rank[np.lexsort((links, cost))] = np.arange(len(links))
        nearest = np.full(n, len(links))
        np.minimum.at(nearest, x, rank)
        np.minimum.at(nearest, y, rank)
        ranked = np.sort(cost)
        most = np.median(ranked[nearest[nearest < len(links)]])
        chosen = (nearest[x] == rank) & (nearest[y] == rank) & (cost <= most)
        if not chosen.any():
            break
        into = np.arange(n)
        into[y[chosen]] = x[chosen]
        changed = np.zeros(n, bool)
        changed[x[chosen]] = changed[y[chosen]] = True
        grown = np.bincount(into, count, n)
        moved = changed[key // n]
        new, sums = _summed(into[key[moved] // n] * n + key[moved] % n, v[moved] * count[key[moved] // n])
        key, v = np.r_[key[~moved], new], np.r_[v[~moved], sums / grown[new // n]]
        order = np.argsort(key, kind="stable")
        key, v, count = key[order], v[order], grown
        p, q = into[x], into[y]
        links = np.unique(np.minimum(p, q)[p != q] * n + np.maximum(p, q)[p != q])
        label = into[label]
        inner, degree = 2 * weight[label[src] == label[dst]].sum(), np.bincount(label[src], weight, n) + np.bincount(label[dst], weight, n)
        share = inner / degree.sum() - ((degree / degree.sum()) ** 2).sum() if degree.sum() else 0.0
        if share > best:
            best, best_label = share, label
    return names[here], names[best_label[here]]


def walktrap(nodes: DataFrame, edges: DataFrame, steps: int = 4, least: float = 0.0, rounds: int = 200) -> DataFrame:
    """node, cluster (dense from 0): clusters merge by how alike short random walks from them are (Ward's distance of where they are after
    so many steps, places weighted by their degree); of all stages of merging the one of largest modularity is given.

    In a round pairs merge that are each other's nearest among linked clusters and no farther apart than half of the clusters are from
    their nearest; the nearest pair of all is one of them, so every round merges. Walks are sparse rows; shares of at most least are left out, for graphs where walks get everywhere. A node's own loop
    weighs as much as its edges do on average. Up to SMALL entries of walks merge in one task, more by jobs; either gives the same."""
    both = symmetric(edges)
    loops = both.groupBy("src").agg(F.avg("weight").alias("weight"))
    looped = nodes.select(F.col("node").alias("src")).join(loops, "src", "left").select("src", F.col("src").alias("dst"), F.coalesce("weight", F.lit(1.0)).alias("weight"))
    graph = both.unionByName(looped).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    degree = materialized(graph.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("k")), "walk-degree")
    step = materialized(graph.join(degree, F.col("src") == F.col("node")).select(F.col("src").alias("at"), F.col("dst").alias("to"), (F.col("weight") / F.col("k")).alias("p")), "walk-step")
    walk = step.select(F.col("at").alias("c"), "to", "p")
    for _ in range(steps - 1):
        far = walk.withColumnRenamed("to", "at").withColumnRenamed("p", "so_far").join(step, "at")
        walk = materialized(far.groupBy("c", "to").agg(F.sum(F.col("so_far") * F.col("p")).alias("p")).where(F.col("p") > least), "walks")
    own = degree.select(F.col("node").alias("to"), F.sqrt("k").alias("root"))
    profile = materialized(walk.join(own, "to").select("c", "to", (F.col("p") / F.col("root")).alias("v")), "profiles")
    plain = edges.schema["src"].dataType.simpleString() == "bigint" and profile.schema["v"].dataType.simpleString() == "double"
    if plain and profile.count() <= SMALL and edges.count() <= SMALL:
        shape = lambda df, kind, a, b, v: df.select(F.lit(kind).alias("kind"), F.col(a).alias("a"), F.col(b).alias("b"), F.col(v).cast("double").alias("v"))
        rows = shape(profile, 0, "c", "to", "v").unionByName(shape(edges, 1, "src", "dst", "weight")).unionByName(nodes.select(F.lit(2).alias("kind"), F.col("node").alias("a"), F.col("node").alias("b"), F.lit(0.0).alias("v")))
        return _dense(_in_one_task(rows, lambda x: _walks_merged(x, rounds)).withColumnRenamed("c", "cluster"))
    links = materialized(edges.where("src != dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct(), "walk-links")
    label = materialized(nodes.select("node", F.col("node").alias("cluster")), "walk-label")
    best, best_label = -1.0, label
    for _ in range(rounds):
        sizes = label.groupBy(F.col("cluster").alias("c")).agg(F.count(F.lit(1)).cast("double").alias("n"))
        x = profile.select(F.col("c").alias("a"), "to", F.col("v").alias("va"))
        y = profile.select(F.col("c").alias("b"), "to", F.col("v").alias("vb"))
        norm = profile.groupBy("c").agg(F.sum(F.col("v") * F.col("v")).alias("norm")).join(sizes, "c")
        dots = links.join(x, "a").join(y, ["b", "to"]).groupBy("a", "b").agg(F.sum(F.col("va") * F.col("vb")).alias("dot"))
        pairs = links.join(dots, ["a", "b"], "left").join(norm.select(F.col("c").alias("a"), F.col("norm").alias("na"), F.col("n").alias("sa")), "a").join(norm.select(F.col("c").alias("b"), F.col("norm").alias("nb"), F.col("n").alias("sb")), "b")
        cost = F.round(F.col("sa") * F.col("sb") / (F.col("sa") + F.col("sb")) * (F.col("na") + F.col("nb") - 2 * F.coalesce("dot", F.lit(0.0))), 12)
        pairs = materialized(pairs.select("a", "b", cost.alias("cost")), "walk-pairs")
        ends = pairs.select(F.col("a").alias("c"), F.struct("cost", "a", "b").alias("way")).unionByName(pairs.select(F.col("b").alias("c"), F.struct("cost", "a", "b").alias("way")))
        nearest = materialized(ends.groupBy("c").agg(F.min("way").alias("way")), "walk-nearest")
        most = nearest.agg(F.median("way.cost")).first()[0]  # null once no clusters are linked
        chosen = nearest.where(F.col("way.cost") <= F.lit(most)).groupBy("way.a", "way.b").agg(F.count(F.lit(1)).alias("votes")).where("votes = 2")
        into = materialized(chosen.select(F.col("b").alias("c"), F.col("a").alias("to_c")), "walk-into")
        if into.isEmpty():
            break
        new = F.coalesce("to_c", "c")
        grown = sizes.join(into, "c", "left").select("c", "n", new.alias("new"))
        profile = materialized(profile.join(grown, "c").groupBy(F.col("new").alias("c"), "to").agg((F.sum(F.col("v") * F.col("n"))).alias("v")).join(grown.groupBy(F.col("new").alias("c")).agg(F.sum("n").alias("n")), "c").select("c", "to", (F.col("v") / F.col("n")).alias("v")), "profiles")
        names_a, names_b = into.select(F.col("c").alias("a"), F.col("to_c").alias("ta")), into.select(F.col("c").alias("b"), F.col("to_c").alias("tb"))
        moved = links.join(names_a, "a", "left").join(names_b, "b", "left").select(F.coalesce("ta", "a").alias("x"), F.coalesce("tb", "b").alias("y")).where("x != y")
        links = materialized(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "walk-links")
        label = materialized(label.join(into.withColumnRenamed("c", "cluster"), "cluster", "left").select("node", F.coalesce("to_c", "cluster").alias("cluster")), "walk-label")
        share = modularity(label, edges).first()[0] or 0.0
        if share > best:
            best, best_label = share, label
    return _dense(best_label)
