"""Connected components of an edge table, by joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strikeflow.llm.textcore import release, stored

ROUNDS = 60
#: Edges that a task contracts at once.
LOCAL = 1 << 21


def contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the given edges, each with the smallest node of its component."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    root, (x, y) = np.arange(len(nodes)), ends.reshape(2, -1)
    while len(apart := np.flatnonzero(root[x] != root[y])):
        x, y = x[apart], y[apart]
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
    return nodes, nodes[root]


def _contracted(size: int):
    """Edges of a task -> one edge from each of its nodes to the smallest node that these edges link it with, itself included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, held = [], [], 0
        for batch in batches:
            a.append(batch.column("a").to_numpy(zero_copy_only=False))
            b.append(batch.column("b").to_numpy(zero_copy_only=False))
            held += batch.num_rows
            if held >= size:
                x, y = contract(np.concatenate(a), np.concatenate(b))
                a, b, held = [x], [y], 0
        if a:
            x, y = contract(np.concatenate(a), np.concatenate(b))
            for k in range(0, len(x), 1 << 17):
                yield pa.record_batch([pa.array(x[k : k + (1 << 17)]), pa.array(y[k : k + (1 << 17)])], names=["a", "b"])

    return run


def components(edges: DataFrame, a: str = "a", b: str = "b", local: int | None = None) -> DataFrame:
    """(node, root): the smallest node of each component of the undirected edges (long ids).

    Every task first contracts its own edges, as many as `local` at once; edges that fit in one task are then done. Between
    tasks, in alternating steps, every node's larger neighbours, then its smaller ones, are linked to
    the smallest node it sees. Edges only ever shrink towards stars, each step is a
    group-wise minimum (with map-side partial aggregation) and one join, so no component is
    gathered in a task. Edges with a null end are ignored; an empty table gives no rows.
    """
    local = local or LOCAL
    e = stored(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b"), "cc")
    spark = e.sparkSession
    parts = -(-e.count() // local)
    for _ in range(ROUNDS):
        made = stored(e.coalesce(max(parts, 1)).mapInArrow(_contracted(local), "a long, b long"), "cc")
        release(spark, e)
        if parts <= 1:
            return made.select(F.col("a").alias("node"), F.col("b").alias("root"))
        e = made.where("a <> b")
        if _stars(e):
            break
        both = e.select("a", "b").unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("s")).select("s.a", F.col("s.m").alias("b")).where("a <> b").distinct()
        e = stored(small, "cc")
        release(spark, made)
    else:
        raise RuntimeError("components did not converge")
    nodes = e.select("a", "b").unionAll(e.select(F.col("b").alias("a"), "b").distinct())
    return nodes.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _stars(e: DataFrame) -> bool:
    """Whether every node is either a root or a leaf of one root."""
    ends = e.distinct().select(F.explode(F.array(F.struct(F.col("a").alias("n"), F.lit(1).alias("leaf"), F.lit(0).alias("root")), F.struct(F.col("b").alias("n"), F.lit(0).alias("leaf"), F.lit(1).alias("root")))).alias("s"))
    return not ends.groupBy("s.n").agg(F.sum("s.leaf").alias("leaf"), F.max("s.root").alias("root")).where("leaf > 1 or leaf = 1 and root = 1").limit(1).count()
