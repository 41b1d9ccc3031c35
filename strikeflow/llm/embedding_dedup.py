"""Near-duplicate embeddings by NN-descent.

Every vector keeps a list of neighbours. In each round a sample of the lists, new entries first, is
joined with its reverse: all vectors that meet at a common neighbour - neighbours of
neighbours - are compared there, and what is closer enters the lists. A list holds its K best entries and, when
these are all above the threshold, grows to hold every one above it, up to DENSE.

Lists start from neighbours in orders of random rotations (the nearest signed axis of each of LEVELS rotations is
the sort key). As a pair that lies alone is out of reach of neighbours of neighbours, there are so many
orders that pairs at the threshold meet in one of them with a chance of MET: more for more vectors.

A vector with DENSE links or more is compared with all such vectors of its cluster, block by
block: the blocks give counts of links and a tree of each component, so that the links of a cluster are never listed.

An audit decides when to stop. It demands a recall of RECALL by brute force, for a sample of all vectors and of those with close
neighbours, and that orders of fresh rotations bring no more than 1 - RECALL of links that were not known: a sample of
vectors tells nothing where links are rare, fresh orders do. While it fails the rounds go on with these orders taken in.

Equal vectors are one node. Nothing is grouped without bound: the start uses range-sorted rows,
and the vectors meeting at one neighbour are split into blocks of BLOCK.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strikeflow.llm.graph import components
from strikeflow.llm.textcore import release, stored

K = 10
SAMPLE_NEW, SAMPLE_OLD = 8, 8
BLOCK = 256
#: Rotations of a sort key, their axes, and rows to either side that a row is compared with.
LEVELS, AXES, REACH = 5, 64, 8
#: Orders of which all comparisons enter the lists; further ones give close pairs only.
FULL_ORDERS, FULL_REACH = 4, 4
#: The share of pairs with a cosine of 0.9 that one order brings together among 20,000 vectors (measured; 16 to 128 dimensions
#: differ little) and the power of their number by which it falls.
MEETS, FALLS, MET = 0.2, 0.2, 0.98
#: Vectors with so many links are compared with all of their cluster in blocks of DENSE_BLOCK; the links that join a cluster, of each of them.
DENSE, JOINED, DENSE_BLOCK = 256, 32, 1024
#: Vectors in a partition of an order, at least.
START_ROWS = 4096
ROUNDS_MIN = 2
#: Rounds after which a search whose audit still fails is an error rather than a result.
ROUNDS_MAX = 60
CHANGES = 0.02
AUDIT = 256
RECALL = 0.97
#: Similarities of the search are of half-precision vectors; closer to the threshold than this they are taken again in double precision.
SLACK = 0.005
#: So far below the threshold a vector's best neighbour is close, for the audit.
CLOSE = 0.1


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes: doubles for exact work, unit half-precision ones for the search."""
    for b in batches:
        rows = [(None if v is None else np.array([np.nan if x is None else x for x in v], np.float64)) for v in b.column("embedding").to_pylist()]
        good = [v is not None and len(v) > 0 and bool(np.isfinite(v).all()) and bool(v.any()) for v in rows]
        scaled = [v / np.abs(v).max() if g else None for v, g in zip(rows, good, strict=True)]
        exact = [(v / np.sqrt((v * v).sum())) if g else None for v, g in zip(scaled, good, strict=True)]
        yield pa.record_batch(
            [b.column("vec_id"), pa.array([v.tobytes() if g else None for v, g in zip(exact, good, strict=True)], pa.binary()), pa.array([len(v) if g else 0 for v, g in zip(rows, good, strict=True)], pa.int32())],
            names=["vec_id", "exact", "dim"],
        )


def orders_for(total: int) -> int:
    """Orders after which a pair at the threshold has met with a chance of MET."""
    meets = MEETS * min(1.0, (total / 20_000) ** -FALLS)
    return math.ceil(math.log(1 - MET) / math.log(1 - meets))


@functools.cache
def _turns(dim: int, seed: int, count: int) -> list[list[np.ndarray]]:
    """LEVELS random rotations for each of `count` orders, as far as AXES axes go."""
    rng = np.random.default_rng(seed)
    return [[np.linalg.qr(rng.standard_normal((dim, min(dim, AXES))))[0].astype(np.float32) for _ in range(LEVELS)] for _ in range(count)]


def _orders(seed: int, count: int):
    """Each vector with the sort keys of `count` orders: the nearest signed axes of LEVELS rotations."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = np.frombuffer(b"".join(b.column("exact").to_pylist()), np.float64).reshape(b.num_rows, -1).astype(np.float32)
            half = pa.array([v.tobytes() for v in x.astype(np.float16)], pa.binary())
            for k, turns in enumerate(_turns(x.shape[1], seed, count)):
                key = np.zeros(len(x), np.int64)
                for turn in turns:
                    y = x @ turn
                    at = np.abs(y).argmax(1)
                    key = key * (2 * AXES) + 2 * at + (y[np.arange(len(x)), at] > 0)
                yield pa.record_batch([pa.array(np.full(len(x), k, np.int32)), pa.array(key), b.column("node"), half], names=["order", "sign", "node", "vec"])

    return run


def _near_rows(threshold: float, full: int):
    """Neighbours in sorted rows of an order. Of the first `full` orders all that are FULL_REACH apart, of all orders close ones up to REACH apart."""

    def run(batches):
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            x = np.frombuffer(b"".join(b.column("vec").to_pylist()), np.float16).reshape(b.num_rows, -1).astype(np.float32)
            part = [b.column("node").to_numpy(zero_copy_only=False), b.column("order").to_numpy(zero_copy_only=False), x]
            if held is not None:
                part = [np.concatenate([h, p]) for h, p in zip(held, part, strict=True)]
            n, order, x = part
            a, c, s = [], [], []
            for d in range(1, min(REACH, len(n) - 1) + 1):
                sim = (x[:-d] * x[d:]).sum(1)
                use = np.flatnonzero((order[:-d] == order[d:]) & ((sim >= threshold - CLOSE) | ((order[d:] < full) & (d <= FULL_REACH))))
                a += [n[use], n[use + d]]
                c += [n[use + d], n[use]]
                s += [sim[use], sim[use]]
            held = [p[-REACH:] for p in part]
            if a:
                yield pa.record_batch([pa.array(np.concatenate(a)), pa.array(np.concatenate(c)), pa.array(np.concatenate(s).astype(np.float32))], names=["a", "b", "sim"])

    return run


def _meet(threshold: float):
    """Vectors that meet at a neighbour, sorted by it and by block: pairs with a new entry that improve a list."""

    def solve(nodes, x, new, kth):
        sim = x @ x.T
        # A list that holds all it can has a `kth` that nothing exceeds.
        good = (new[:, None] | new[None, :]) & ((sim > kth[:, None]) | ((sim >= threshold - SLACK) & (kth < 2)[:, None])) & (nodes[:, None] != nodes[None, :])
        i, j = np.nonzero(good)
        return nodes[i], nodes[j], sim[i, j]

    def run(batches):
        held = None
        cols = ("at", "block", "node", "new", "kth")
        for b in batches:
            if not b.num_rows:
                continue
            x = np.frombuffer(b"".join(b.column("vec").to_pylist()), np.float16).reshape(b.num_rows, -1)
            part = [*(b.column(c).to_numpy(zero_copy_only=False) for c in cols), x]
            if held is not None:
                part = [np.concatenate([h, p]) for h, p in zip(held, part, strict=True)]
            edge = np.flatnonzero((part[0][1:] != part[0][:-1]) | (part[1][1:] != part[1][:-1])) + 1
            cut = edge[-1] if len(edge) else 0
            held = [p[cut:] for p in part]
            if cut:
                yield answer(part, np.concatenate([[0], edge]))
        if held is not None and len(held[0]):
            yield answer(held, np.array([0, len(held[0])]))

    def answer(part, edges):
        x = part[5].astype(np.float32)
        out = [solve(part[2][i:j], x[i:j], part[3][i:j], part[4][i:j]) for i, j in zip(edges[:-1], edges[1:], strict=True)]
        a, b, s = (np.concatenate(v) for v in zip(*out, strict=True))
        # The same pair often meets at several neighbours of this task.
        order = np.lexsort((b, a))
        a, b, s = a[order], b[order], s[order]
        keep = np.ones(len(a), bool)
        keep[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        return pa.record_batch([pa.array(a[keep]), pa.array(b[keep]), pa.array(s[keep].astype(np.float32))], names=["a", "b", "sim"])

    return run


def _lists(entries: DataFrame, threshold: float) -> DataFrame:
    """(a, kth, list<b, sim, new>) from entries (a, b, sim, old, new): the K best, and all above the threshold up to DENSE."""
    best = entries.repartition("a").groupBy("a", "b").agg(F.max("sim").alias("sim"), F.max("old").alias("old"), F.max("new").alias("new"))
    item = F.struct((-F.col("sim")).alias("away"), "b", "sim", (F.when(F.col("old"), F.col("new")).otherwise(True)).alias("new"))
    # A hub has as many entries as vectors that met it: all but the first DENSE go before any are gathered.
    nth = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "b"))
    best = best.withColumn("nth", nth).where(F.col("nth") <= DENSE)
    made = best.groupBy("a").agg(F.array_sort(F.collect_list(item)).alias("list"))
    kept = F.filter("list", lambda x, i: (i < K) | ((x["sim"] >= threshold - SLACK) & (i < DENSE)))
    full = (F.size("list") >= DENSE) & (F.try_element_at("list", F.lit(DENSE))["sim"] >= threshold - SLACK)
    kth = F.when(full, F.lit(2.0)).when(F.size("list") >= K, F.element_at("list", K)["sim"]).otherwise(F.lit(-2.0)).cast("float")
    return made.select("a", kth.alias("kth"), F.transform(kept, lambda x: F.struct(x["b"].alias("b"), x["sim"].alias("sim"), x["new"].alias("new"))).alias("list"))


def _round(lists: DataFrame, nodes: DataFrame, threshold: float, k: int) -> DataFrame:
    def pick(new: bool, n: int):
        some = F.filter("list", lambda x: x["new"] == F.lit(new))
        return F.slice(F.array_sort(F.transform(some, lambda x: F.struct(F.xxhash64(x["b"], F.col("a"), F.lit(k)).alias("h"), x["b"].alias("b"), x["new"].alias("new")))), 1, n)

    sampled = lists.withColumn("some", F.concat(pick(True, SAMPLE_NEW), pick(False, SAMPLE_OLD)))
    sampled = sampled.withColumn("done", F.transform(F.filter("some", lambda x: x["new"]), lambda x: x["b"]))
    edges = sampled.select("a", F.explode("some").alias("e")).select("a", F.col("e.b").alias("b"), F.col("e.new").alias("new"))
    both = edges.select(F.col("a").alias("at"), F.col("b").alias("node"), "new").unionAll(edges.select(F.col("b").alias("at"), F.col("a").alias("node"), "new"))
    both = both.repartition("at").groupBy("at", "node").agg(F.max("new").alias("new"))
    blocks = F.ceil(F.count("*").over(Window.partitionBy("at")) / BLOCK)
    both = both.withColumn("block", F.pmod(F.xxhash64("node", F.lit(k)), blocks).cast("int"))
    met = both.join(nodes.select("node", "vec").join(lists.select(F.col("a").alias("node"), "kth"), "node"), "node").repartition("at", "block").sortWithinPartitions("at", "block")
    pairs = met.select("at", "block", "node", "new", "kth", "vec").mapInArrow(_meet(threshold), "a long, b long, sim float")
    old = sampled.select("a", F.explode("list").alias("e"), "done").select("a", F.col("e.b").alias("b"), F.col("e.sim").alias("sim"), F.lit(True).alias("old"), (F.col("e.new") & ~F.array_contains("done", F.col("e.b"))).alias("new"))
    return _lists(old.unionAll(pairs.select("a", "b", "sim", F.lit(False).alias("old"), F.lit(True).alias("new"))), threshold)


def _trees(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix of links the least row that it is connected with."""
    root = np.arange(len(linked))
    while True:
        low = np.where(linked, root[None, :], len(linked)).min(1, initial=len(linked))
        new = np.minimum(root, low)
        new = np.minimum(new, new[new])
        if (new == root).all():
            return root
        root = new


def _crossed(threshold: float):
    """Of the rows of each (cluster, lo, hi), sorted by it: how many rows of the block, or of the other one, each is linked with,
    the copies that these stand for, and a row that it is connected with."""

    def answer(part):
        lo, hi, side, nodes, copies, x = part[1][0], part[2][0], *part[3:]
        linked = (x @ x.T >= threshold) & ~np.eye(len(x), dtype=bool)
        if lo != hi:
            linked &= side[:, None] != side[None, :]
        return pa.record_batch([pa.array(nodes), pa.array(linked.sum(1).astype(np.int64)), pa.array(linked @ copies), pa.array(nodes[_trees(linked)])], names=["node", "n", "links", "root"])

    def run(batches):
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            x = np.frombuffer(b"".join(b.column("exact").to_pylist()), np.float64).reshape(b.num_rows, -1)
            part = [*(b.column(c).to_numpy(zero_copy_only=False) for c in ("cluster", "lo", "hi", "side", "node", "copies")), x]
            if held is not None:
                part = [np.concatenate([h, p]) for h, p in zip(held, part, strict=True)]
            edge = np.flatnonzero((part[0][1:] != part[0][:-1]) | (part[1][1:] != part[1][:-1]) | (part[2][1:] != part[2][:-1])) + 1
            for i, j in zip(np.concatenate([[0], edge])[:-1], edge, strict=True):
                yield answer([p[i:j] for p in part])
            held = [p[edge[-1] if len(edge) else 0 :] for p in part]
        if held is not None:
            yield answer(held)

    return run


def _dense_clusters(lists: DataFrame, threshold: float, joins: DataFrame | None = None) -> DataFrame | None:
    """(node, cluster) of the vectors with DENSE links or more; None if there are none. `joins` are links between clusters that
    no list holds (see _joins())."""
    near = F.filter("list", lambda x: x["sim"] >= threshold - SLACK)
    dense = lists.where(F.size(near) >= DENSE)
    if dense.isEmpty():
        return None
    # The least by one hash: vectors of a cluster name mostly the same ones.
    joined = F.slice(F.array_sort(F.transform(near, lambda x: F.struct(F.xxhash64(x["b"]).alias("h"), x["b"].alias("b")))), 1, JOINED)
    links = dense.select("a", F.explode(joined).alias("e")).select("a", F.col("e.b").alias("b"))
    roots = components(links if joins is None else links.unionAll(joins))
    return stored(roots.join(dense.select(F.col("a").alias("node")), "node", "left_semi").withColumnRenamed("root", "cluster"), "dense")


def _joins(other: DataFrame, clusters: DataFrame, threshold: float) -> DataFrame:
    """(a, b): of fresh close pairs (a, b, sim) one for each two clusters that they join. Lists that are full of their own cluster would
    let go of such pairs; with them the clusters are one from the next time on, and all of their vectors are compared."""
    of = lambda c: clusters.select(F.col("node").alias(c), F.col("cluster").alias(f"{c}_cluster"))
    near = other.where(F.col("sim") >= threshold - SLACK).join(of("a"), "a").join(of("b"), "b").where("a_cluster <> b_cluster")
    ends = (F.least("a_cluster", "b_cluster").alias("one"), F.greatest("a_cluster", "b_cluster").alias("two"))
    return stored(near.groupBy(*ends).agg(F.min(F.struct("a", "b")).alias("e")).select("e.a", "e.b"), "joins")


def _dense_links(clusters: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """(node, n, links, root) of all vectors of each cluster, one row for each two blocks that a vector is compared in."""
    sizes = clusters.groupBy("cluster").agg(F.ceil(F.count("*") / DENSE_BLOCK).cast("int").alias("blocks"))
    placed = clusters.join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int")).join(nodes.select("node", "copies", "exact"), "node")
    other = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    other = other.select("cluster", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), (F.col("block") > F.col("other")).cast("int").alias("side"), "node", "copies", "exact")
    return other.repartition("cluster", "lo", "hi").sortWithinPartitions("cluster", "lo", "hi").mapInArrow(_crossed(threshold), "node long, n long, links long, root long")


def _brute(queries: np.ndarray, ids: np.ndarray, threshold: float):
    """How many links the given unit vectors have among those of a task, in double precision."""

    def run(batches):
        total = np.zeros(len(ids), np.int64)
        for b in batches:
            if b.num_rows:
                x = np.frombuffer(b"".join(b.column("exact").to_pylist()), np.float64).reshape(b.num_rows, -1)
                n = b.column("node").to_numpy(zero_copy_only=False)
                total += ((queries @ x.T >= threshold) & (ids[:, None] != n[None, :])).sum(1)
        yield pa.record_batch([pa.array(ids), pa.array(total)], names=["node", "true"])

    return run


def audit_recall(nodes: DataFrame, counts: DataFrame, queries: DataFrame, threshold: float) -> float:
    """Share of the links of `queries` (node, exact; a bounded set), by brute force against all nodes, that are in `counts` (node, n). As
    all counted links are exact, numbers of links tell what is missing."""
    rows = queries.collect()
    if not rows:
        return 1.0
    q, ids = np.stack([np.frombuffer(r["exact"], np.float64) for r in rows]), np.array([r["node"] for r in rows])
    true = nodes.select("node", "exact").mapInArrow(_brute(q, ids, threshold), "node long, true long").groupBy("node").agg(F.sum("true").alias("true"))
    r = true.join(counts.select("node", "n"), "node", "left").agg(F.sum("true").alias("true"), F.sum("n").alias("n")).first()
    return (r["n"] or 0) / r["true"] if r["true"] else 1.0


def _exact(threshold: float):
    def run(batches):
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.float64).reshape(b.num_rows, -1) for c in ("x", "y"))
                yield pa.record_batch([b.column("a"), b.column("b"), pa.array((x * y).sum(1) >= threshold)], names=["a", "b", "linked"])

    return run


def _linked(close: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b, sim) that are links, near the threshold by the double-precision cosine."""
    sure = close.where(F.col("sim") >= threshold + SLACK).select("a", "b")
    near = close.where(F.col("sim") < threshold + SLACK)
    vec = nodes.select("node", "exact")
    near = near.join(vec.select(F.col("node").alias("a"), F.col("exact").alias("x")), "a").join(vec.select(F.col("node").alias("b"), F.col("exact").alias("y")), "b")
    return sure.unionAll(near.select("a", "b", "x", "y").mapInArrow(_exact(threshold), "a long, b long, linked boolean").where("linked").select("a", "b"))


def _found(lists: DataFrame, nodes: DataFrame, threshold: float, joins: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(a, b): links that join the components; (node, n, links): how many nodes each is linked with, and the copies these stand for;
    (node, cluster): the dense clusters, if any."""
    e = lists.select("a", F.explode("list").alias("e")).where(F.col("e.sim") >= threshold - SLACK)
    close = e.select(F.least("a", "e.b").alias("a"), F.greatest("a", "e.b").alias("b"), "e.sim").groupBy("a", "b").agg(F.max("sim").alias("sim"))
    clusters = _dense_clusters(lists, threshold, joins)
    if clusters is not None:
        # What the blocks of a cluster count is not counted here.
        of = lambda c: clusters.select(F.col("node").alias(c), F.col("cluster").alias(f"{c}_cluster"))
        close = close.join(of("a"), "a", "left").join(of("b"), "b", "left").where("a_cluster is null or b_cluster is null or a_cluster <> b_cluster").select("a", "b", "sim")
    edges = stored(_linked(close, nodes, threshold), "links")
    copies = nodes.select(F.col("node").alias("b"), "copies")
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counts = both.join(copies, "b").select(F.col("a").alias("node"), F.lit(1).cast("long").alias("n"), F.col("copies").alias("links"))
    if clusters is not None:
        dense = stored(_dense_links(clusters, nodes, threshold), "blocks")
        edges = edges.unionAll(dense.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
        counts = counts.unionAll(dense.select("node", "n", "links"))
    return edges, stored(counts.groupBy("node").agg(F.sum("n").alias("n"), F.sum("links").alias("links")), "counts"), clusters


def neighbour_links(nodes: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """See _found(). `nodes` (node, exact, copies) are different unit vectors of one dimension."""
    spark = nodes.sparkSession
    total = nodes.count()
    orders = orders_for(total)
    # In parts of a few vectors an order would have no neighbours.
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(1, total * orders // START_ROWS))

    def entries(seed: int, count: int, full: int) -> tuple[DataFrame, DataFrame]:
        start = nodes.select("node", "exact").mapInArrow(_orders(seed, count), "order int, sign long, node long, vec binary")
        ranged = start.repartitionByRange(parts, "order", "sign", F.xxhash64("node")).sortWithinPartitions("order", "sign", F.xxhash64("node"))
        return start, ranged.select("order", "node", "vec").mapInArrow(_near_rows(threshold, full), "a long, b long, sim float")

    first = entries(5, orders, FULL_ORDERS)[1]
    half = stored(entries(5, 1, 0)[0].select("node", "vec"), "vectors")
    lists = stored(_lists(first.select("a", "b", "sim", F.lit(True).alias("old"), F.lit(True).alias("new")), threshold), "lists")
    some = nodes.select("node", "exact").orderBy(F.xxhash64("node")).limit(AUDIT // 2)
    k, joins = 0, None
    while k < ROUNDS_MAX:
        made = stored(_round(lists, half, threshold, k), "lists")
        release(spark, lists)
        lists = made
        k += 1
        fresh = lists.select(F.sum(F.size(F.filter("list", lambda x: x["new"]))).alias("n")).first()["n"] or 0
        if k < ROUNDS_MIN or fresh > CHANGES * total * K and k % 3:
            continue
        edges, counts, clusters = _found(lists, nodes, threshold, joins)
        near = lists.where(F.exists("list", lambda x: x["sim"] >= threshold - CLOSE)).select(F.col("a").alias("node"))
        close = nodes.select("node", "exact").join(near, "node", "left_semi").orderBy(F.xxhash64("node", F.lit(1))).limit(AUDIT // 2)
        # Half as many orders as at the start still bring most pairs together.
        other = stored(entries(5 + k, -(-orders // 2), 0)[1].where(F.col("a") < F.col("b")), "fresh")
        if _fresh_share(other, lists, nodes, threshold) <= 1 - RECALL and audit_recall(nodes, counts, some.unionAll(close).distinct(), threshold) >= RECALL:
            release(spark, lists, half, other)
            return edges, counts
        if clusters is not None:
            new = _joins(other, clusters, threshold)
            joins = new if joins is None else joins.unionAll(new)
        back = other.unionAll(other.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim"))
        held = lists.select("a", F.explode("list").alias("e")).select("a", F.col("e.b").alias("b"), F.col("e.sim").alias("sim"), F.lit(True).alias("old"), F.col("e.new").alias("new"))
        made = stored(_lists(held.unionAll(back.select("a", "b", "sim", F.lit(False).alias("old"), F.lit(True).alias("new"))), threshold), "lists")
        release(spark, lists, other)
        lists = made
    raise RuntimeError(f"the audit's recall is below {RECALL} after {ROUNDS_MAX} rounds")


def _fresh_share(other: DataFrame, lists: DataFrame, nodes: DataFrame, threshold: float) -> float:
    """The share of the links in `other` (a, b, sim) that neither end has in its list; ends whose lists are full are left to the blocks."""
    links = _linked(other.where(F.col("sim") >= threshold - SLACK).groupBy("a", "b").agg(F.max("sim").alias("sim")), nodes, threshold)
    held = lists.select("a", F.explode("list").alias("e"), (F.col("kth") >= 2).alias("full")).where(F.col("e.sim") >= threshold - SLACK)
    held = held.select(F.least("a", "e.b").alias("a"), F.greatest("a", "e.b").alias("b")).distinct().withColumn("hit", F.lit(1))
    full = lists.where("kth >= 2").select("a")
    open_ = links.join(full, "a", "left_anti").join(full.select(F.col("a").alias("b")), "b", "left_anti")
    r = open_.join(held, ["a", "b"], "left").agg(F.count("*").alias("n"), F.count("hit").alias("k")).first()
    return (r["n"] - r["k"]) / r["n"] if r["n"] else 0.0


def embedding_near_dedup(vectors: DataFrame, threshold: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of `vectors` (vec_id long, embedding array).

    Links are pairs of rows with a cosine of `threshold` or more in double precision, as far as
    NN-descent finds them (the rounds go on until the audit has a recall of RECALL; pairs within
    clusters of vectors with DENSE links are all compared). A cosine of just `threshold` links. n_links counts other rows linked directly, equal vectors included; component_id is the smallest vec_id reachable;
    kept marks vec_id = component_id. Vectors that are null, empty, zero, or hold null or non-finite components
    link with nothing, and neither do vectors of different length. Rows with the same vec_id
    are rows of their own; a null vec_id takes part but names no component (kept is then
    false). Other columns are ignored; an empty table gives no rows.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(_unit, "vec_id long, exact binary, dim int")
    classes = rows.where("exact is not null").groupBy("exact", "dim").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    found = None
    # One search for each length of vectors: usually one.
    for r in classes.groupBy("dim").count().where("count > 1").collect():
        e = neighbour_links(classes.where(F.col("dim") == r["dim"]), threshold)
        found = e if found is None else tuple(x.unionAll(y) for x, y in zip(found, e, strict=True))
    none = classes.limit(0)
    edges, counts = found or (none.select(F.col("node").alias("a"), F.col("node").alias("b")), none.select("node", F.lit(0).alias("n"), F.lit(0).alias("links")))
    roots = components(edges)
    of = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = of.groupBy("root").agg(F.min("least").alias("component"))
    full = of.join(names, "root").join(counts.select("node", "links"), "node", "left").select("exact", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), "component")
    out = rows.join(full, "exact", "left")
    component = F.when(F.col("links").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
