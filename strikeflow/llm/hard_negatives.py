"""Hard negatives by blocks in the order of a Hilbert curve.

Vectors are put in the order of a Hilbert curve through their leading directions and written as Parquet, a row for each
block, with the least and greatest value of every dimension: its zone map. An anchor's inner product with any vector of a block lies between
two sums over these intervals. The bounds choose the blocks that can hold one of the anchor's first positives, or
a score within one of its windows of negatives; only these are compared with it, exactly.

Blocks lie together in units. Anchors go to the units that they need and stream past their blocks, so that a task holds a
unit, never all anchors; what each unit gives is at most a few rows for an anchor, of which the first are taken.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strikeflow.llm.textcore import release, stored

#: Rows of a block and of a unit.
BLOCK, UNIT = 2048, 16384
#: Units times dimensions, at most: bounds the zone maps that are broadcast (32 MB); beyond it units hold more rows.
CELLS = 1 << 21
#: Directions of the curve, bits of each (together under 63), and dimensions that the directions are taken from.
DIRECTIONS, BITS, SKETCH = 8, 7, 64
#: Anchors compared at a time.
BATCH = 256
EXACT = float(1 << 53)


def hilbert(at: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of points with whole coordinates below 2^bits, one row each."""
    x = at.astype(np.int64).T.copy()
    dims = len(x)
    # Undo the rotations of the sub-cubes from the top bit down, then Gray decode.
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for d in range(dims):
            flip = (x[d] & q) > 0
            swap = np.where(flip, 0, (x[0] ^ x[d]) & p)
            x[0] ^= np.where(flip, p, swap)
            x[d] ^= swap
        q >>= 1
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[-1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= turn
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for d in range(dims):
            out = out << 1 | (x[d] >> b & 1)
    return out


def _matrix(batch: pa.RecordBatch, d: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that take part, their vectors in whole 256ths), shorter ones filled up with zeros."""
    column = batch.column("embedding")
    flat = column.flatten().cast(pa.float64())
    offs = np.asarray(column.offsets, np.int64)
    offs = offs - offs[0]
    size = np.diff(offs)
    x = flat.to_numpy(zero_copy_only=False)  # null as nan
    bad = np.zeros(len(x) + 1, np.int64)
    np.cumsum(~np.isfinite(x), out=bad[1:])
    ok = np.asarray(column.is_valid()) & (bad[offs[1:]] == bad[offs[:-1]])
    for name in ("vec_id", "label"):
        ok &= np.asarray(batch.column(name).is_valid())
    rows = np.flatnonzero(ok)
    out = np.zeros((len(rows), d))
    n = size[rows]
    r = np.repeat(np.arange(len(rows)), n)
    c = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    out[r, c] = np.clip(np.floor(256.0 * x[np.repeat(offs[rows], n) + c]), -1e300, 1e300)
    return rows, out


@functools.cache
def _sketch(d: int) -> np.ndarray:
    """A fixed projection to at most SKETCH dimensions."""
    if d <= SKETCH:
        return np.eye(d)
    return np.linalg.qr(np.random.default_rng(5).standard_normal((d, SKETCH)))[0]


def _moments(d: int):
    """Of a task: count, greatest size, sum and products of the sketched vectors, as numbered rows of numbers."""

    def run(batches):
        m = min(d, SKETCH)
        total, most = np.zeros((m + 1, m + 1)), 0.0
        for b in batches:
            _, x = _matrix(b, d)
            if len(x):
                most = max(most, float(np.abs(x).max()))
                y = np.hstack([np.ones((len(x), 1)), x @ _sketch(d)])
                total += y.T @ y
        yield pa.record_batch([pa.array(range(m + 2), pa.int32()), pa.array([*(r.tobytes() for r in total), np.array([most]).tobytes()], pa.binary())], names=["slice", "numbers"])

    return run


def _merged(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the slices, greatest of the last."""
    total = None
    for b in batches:
        for x in b.column("numbers").to_pylist():
            x = np.frombuffer(x)
            total = x if total is None else np.maximum(total, x) if len(x) == 1 else total + x
    yield pa.record_batch([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["slice", "numbers"])


def _keyed(d: int, mean: np.ndarray, directions: np.ndarray, scale: np.ndarray):
    """Rows that take part, with their place on the curve: 2^BITS cells of each direction within three deviations."""

    def run(batches):
        for b in batches:
            rows, x = _matrix(b, d)
            if not len(rows):
                continue
            y = (x @ _sketch(d) - mean) @ directions / scale
            cell = np.clip((y / 3 + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
            kept = b.take(pa.array(rows))
            yield pa.record_batch([pa.array(hilbert(cell)), kept.column("vec_id"), kept.column("label"), pa.array([v.tobytes() for v in x], pa.binary())], names=["key", "vec_id", "label", "vector"])

    return run


def _small(x: np.ndarray) -> np.ndarray:
    """The numbers in as few bytes as hold them all."""
    most = np.abs(x).max(initial=0)
    return x.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.float64)


def _blocks(d: int):
    """Sorted rows as blocks: their numbers, and zone maps of the dimensions and of labels."""

    def run(batches):
        from pyspark import TaskContext

        unit, nth = TaskContext.get().partitionId(), 0
        ids, labels, vectors = [], [], []

        def packed() -> pa.RecordBatch:
            x = np.frombuffer(b"".join(vectors)).reshape(len(ids), d)
            small = _small(x)
            lo, hi = x.min(axis=0, initial=np.inf), x.max(axis=0, initial=-np.inf)
            return pa.record_batch(
                [pa.array([unit], pa.int32()), pa.array([nth], pa.int32()), pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([np.array(labels, np.int64).tobytes()], pa.binary()), pa.array([small.dtype.str]), pa.array([small.tobytes()], pa.binary()), pa.array([lo.tobytes()], pa.binary()), pa.array([hi.tobytes()], pa.binary()), pa.array([min(labels)], pa.int64()), pa.array([max(labels)], pa.int64())],
                names=["unit", "block", "ids", "labels", "kind", "vectors", "lo", "hi", "label_lo", "label_hi"],
            )

        for b in batches:
            for i, l, v in zip(*(b.column(c).to_pylist() for c in ("vec_id", "label", "vector")), strict=True):
                ids.append(i)
                labels.append(l)
                vectors.append(v)
                if len(ids) == BLOCK:
                    yield packed()
                    nth += 1
                    ids, labels, vectors = [], [], []
        if ids:
            yield packed()

    return run


_BLOCK = "unit int, block int, ids binary, labels binary, kind string, vectors binary, lo binary, hi binary, label_lo long, label_hi long"


def _zone(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The zone map of a unit from those of its blocks."""
    lo = hi = None
    labels: list[int] = []
    for b in batches:
        for x, y in zip(b.column("lo").to_pylist(), b.column("hi").to_pylist(), strict=True):
            x, y = np.frombuffer(x), np.frombuffer(y)
            lo, hi = (x, y) if lo is None else (np.minimum(lo, x), np.maximum(hi, y))
        labels += b.column("label_lo").to_pylist() + b.column("label_hi").to_pylist()
        labels = [min(labels), max(labels)]
    yield pa.record_batch([pa.array([key[0].as_py()], pa.int32()), pa.array([lo.tobytes()], pa.binary()), pa.array([hi.tobytes()], pa.binary()), pa.array([labels[0]], pa.int64()), pa.array([labels[1]], pa.int64())], names=["unit", "lo", "hi", "label_lo", "label_hi"])


class Zones:
    """Zone maps of units or blocks."""

    def __init__(self, lo: list[bytes], hi: list[bytes], label_lo: list[int], label_hi: list[int], d: int):
        self.lo, self.hi = (np.frombuffer(b"".join(x)).reshape(len(x), d) for x in (lo, hi))
        self.label_lo, self.label_hi = np.array(label_lo, np.int64), np.array(label_hi, np.int64)

    def bounds(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest inner product of each row of `a` with a vector of each zone."""
        plus, minus = np.maximum(a, 0), np.minimum(a, 0)
        return plus @ self.lo.T + minus @ self.hi.T, plus @ self.hi.T + minus @ self.lo.T

    def may_hold(self, labels: np.ndarray, same: bool) -> np.ndarray:
        """Whether a zone can hold a row of the same label, or of another."""
        l = labels[:, None]  # noqa: E741
        return (self.label_lo <= l) & (l <= self.label_hi) if same else (self.label_lo != l) | (l != self.label_hi)


class Space:
    """What tasks need to know of the table; whether float64 holds every inner product exactly."""

    def __init__(self, d: int, most: float, every: int, positives: int, negatives: int):
        self.d, self.every, self.positives, self.negatives = d, every, positives, negatives
        self.exact = d * most * most < EXACT

    def numbers(self, kind: str, data: bytes) -> np.ndarray:
        x = np.frombuffer(data, kind).reshape(-1, self.d)
        return x.astype(np.float64) if self.exact else np.vectorize(int, otypes=[object])(x)

    def scores(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a @ b.T if self.exact else a.dot(b.T)


def _first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest scores, ties by smaller id."""
    if len(scores) > 4 * k and scores.dtype != object:
        bar = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= bar)
    else:
        some = np.arange(len(scores))
    return np.array(sorted(some.tolist(), key=lambda i: (-scores[i], ids[i]))[:k], np.int64)


_ANCHOR = "unit int, anchor long, vec_id long, label long, kind string, vector binary, least double"


def _anchors(space: Space, zones):
    """Anchors of the blocks with the units that can hold one of their first positives: those whose upper bound reaches the
    last of the first positives that the anchor's own block has. Unit -1 has each anchor once."""

    def run(batches):
        z: Zones = zones.value
        for b in batches:
            for unit, block, ids, labels, kind, vectors in zip(*(b.column(c).to_pylist() for c in ("unit", "block", "ids", "labels", "kind", "vectors")), strict=True):
                ids, labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
                at = np.flatnonzero(ids % space.every == 0)
                if not len(at):
                    continue
                x, raw = space.numbers(kind, vectors), np.frombuffer(vectors, kind).reshape(len(ids), -1)
                least = np.full(len(at), -np.inf)
                for k, i in enumerate(at.tolist()):
                    here = np.flatnonzero((labels == labels[i]) & (ids != ids[i]))
                    if space.exact and len(here) >= space.positives:
                        s = space.scores(x[i : i + 1], x[here])[0]
                        least[k] = np.partition(s, len(s) - space.positives)[len(s) - space.positives]
                need = z.may_hold(labels[at], True)
                if space.exact:
                    need &= z.bounds(x[at])[1] >= least[:, None]
                who, where = np.nonzero(np.hstack([np.ones((len(at), 1), bool), need]))
                anchor = (unit << 44) + (block << 20) + at
                yield pa.record_batch(
                    [pa.array(where - 1, pa.int32()), pa.array(anchor[who], pa.int64()), pa.array(ids[at][who]), pa.array(labels[at][who]), pa.array([kind] * len(who)), pa.array([raw[i].tobytes() for i in at[who].tolist()], pa.binary()), pa.array(least[who])],
                    names=["unit", "anchor", "vec_id", "label", "kind", "vector", "least"],
                )

    return run


def _unit_task(space: Space, compare, names: list[str]):
    """Streams the rows of units, blocks first: holds a unit's blocks and hands batches of its anchors to `compare`."""

    def run(batches):
        now, blocks = None, []
        for b in batches:
            units, kinds = (np.asarray(b.column(c)) for c in ("unit", "what"))
            cuts = [0, *(np.flatnonzero((np.diff(units) != 0) | (np.diff(kinds) != 0)) + 1).tolist(), len(units)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if i == j:
                    continue
                if units[i] != now:
                    now, blocks = units[i], []
                if kinds[i] == 0:
                    rows = b.slice(i, j - i).to_pylist()
                    blocks += [(np.frombuffer(r["ids"], np.int64), np.frombuffer(r["labels"], np.int64), space.numbers(r["kind"], r["vector"]), Zones([r["lo"]], [r["hi"]], [r["label_lo"]], [r["label_hi"]], space.d)) for r in rows]
                    continue
                for k in range(i, j, BATCH):
                    rows = b.slice(k, min(BATCH, j - k)).to_pylist()
                    vectors = np.concatenate([space.numbers(r["kind"], r["vector"]) for r in rows])
                    out = compare(rows, vectors, blocks)
                    yield pa.record_batch([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * len(names))], names=names)

    return run


def _positives(space: Space):
    """The first rows of the anchors' labels in a unit."""

    def compare(rows, a, blocks):
        best: list[list[tuple]] = [[] for _ in rows]  # (-score, id)
        labels = np.array([r["label"] for r in rows], np.int64)
        least = np.array([r["least"] for r in rows])
        for ids, own, x, zone in blocks:
            need = zone.may_hold(labels, True)[:, 0]
            if space.exact:
                need &= zone.bounds(a)[1][:, 0] >= least
            who = np.flatnonzero(need)
            if not len(who):
                continue
            s = space.scores(a[who], x)
            for k, i in enumerate(who.tolist()):
                here = (own == labels[i]) & (ids != rows[i]["vec_id"])
                if space.exact:
                    here &= s[k] >= least[i]
                here = np.flatnonzero(here)
                top = here[_first(s[k][here], ids[here], space.positives)]
                best[i] = sorted(best[i] + [(-int(s[k][j]), int(ids[j])) for j in top.tolist()])[: space.positives]
                if space.exact and len(best[i]) == space.positives:
                    least[i] = max(least[i], -best[i][-1][0])
        return [(r["anchor"], i, _long(-s)) for r, b in zip(rows, best, strict=True) for s, i in b]

    return compare


def _long(x: int) -> int:
    return max(-(1 << 63), min((1 << 63) - 1, int(x)))


def _window(score: int) -> tuple[int, int]:
    """Scores s with 50 * score <= 100 * s <= 95 * score; none if the score is below 0."""
    return -(-50 * score // 100), 95 * score // 100


def _negatives(space: Space):
    """The first rows of other labels in a unit, in the window of each of the anchors' positives."""

    def compare(rows, a, blocks):
        labels = np.array([r["label"] for r in rows], np.int64)
        windows = [[_window(p["score"]) for p in r["positives"]] for r in rows]
        best: list[list[list[tuple]]] = [[[] for _ in w] for w in windows]
        for ids, own, x, zone in blocks:
            need = zone.may_hold(labels, False)[:, 0]
            if space.exact:
                low, high = (v[:, 0] for v in zone.bounds(a))
                # A window that is full is only improved from its last score on.
                open_ = lambda w, b: max(w[0], -b[-1][0]) if len(b) == space.negatives else w[0]
                need &= np.array([any(h <= w[1] and g >= open_(w, b) for w, b in zip(ws, bs, strict=True)) for ws, bs, h, g in zip(windows, best, low.tolist(), high.tolist(), strict=True)], bool)
            who = np.flatnonzero(need)
            if not len(who):
                continue
            s = space.scores(a[who], x)
            for k, i in enumerate(who.tolist()):
                if not windows[i]:
                    continue
                row = s[k]
                some = np.flatnonzero((own != labels[i]) & (row >= min(w[0] for w in windows[i])) & (row <= max(w[1] for w in windows[i])))
                row, names = row[some], ids[some]
                for j, (lo, hi) in enumerate(windows[i]):
                    here = np.flatnonzero((row >= lo) & (row <= hi))
                    if len(here):
                        top = here[_first(row[here], names[here], space.negatives)]
                        best[i][j] = sorted(best[i][j] + [(-int(row[t]), int(names[t])) for t in top.tolist()])[: space.negatives]
        return [(r["anchor"], r["vec_id"], p["nth"], p["id"], _long(p["score"]), i, _long(-s)) for r, bs in zip(rows, best, strict=True) for p, b in zip(r["positives"], bs, strict=True) for s, i in b]

    return compare


def _routed(space: Space, zones):
    """Anchors with their positives, once for each unit that can hold a score within one of their windows."""

    def run(batches):
        z: Zones = zones.value
        for b in batches:
            for k in range(0, b.num_rows, BATCH):
                part = b.slice(k, BATCH)
                rows = part.to_pylist()
                a = np.concatenate([space.numbers(r["kind"], r["vector"]) for r in rows])
                need = z.may_hold(np.array([r["label"] for r in rows], np.int64), False)
                if space.exact:
                    low, high = z.bounds(a)
                    inside = np.zeros(need.shape, bool)
                    for i, r in enumerate(rows):
                        for p in r["positives"]:
                            lo, hi = _window(p["score"])
                            inside[i] |= (low[i] <= hi) & (high[i] >= lo)
                    need &= inside
                who, where = np.nonzero(need)
                if len(who):
                    yield pa.record_batch([pa.array(where, pa.int32()), *part.take(pa.array(who)).columns], names=["unit", *part.schema.names])

    return run


def _met(blocks: DataFrame, anchors: DataFrame, units: int) -> DataFrame:
    """Blocks and the anchors that need their units, in streams that have the blocks first."""
    both = blocks.withColumnRenamed("vectors", "vector").withColumn("what", F.lit(0)).unionByName(anchors.withColumn("what", F.lit(1)), allowMissingColumns=True)
    return both.repartition(max(1, units), "unit").sortWithinPartitions("unit", "what", "block", "anchor")


def hard_negatives(vectors: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3) -> DataFrame:
    """(anchor_id, positive_id, rank int, negative_id, positive_score, negative_score) from (vec_id, label, embedding).

    A component x counts as floor(256 * x); scores are inner products of these; higher scores come first, ties by smaller
    vec_id. Anchors are the rows whose vec_id is divisible by `every`; an anchor's positives are its first `positives` rows of
    the same label and another vec_id, and for each of them come the first `negatives` rows of other labels
    with 50 * positive_score <= 100 * negative_score <= 95 * positive_score, ranked from 1.

    Rows with a null vec_id, label or vector, or with a null or non-finite component, take no part. Shorter vectors are filled up with
    zeros. Repeated rows count each, as anchors, positives and negatives. Other columns are ignored; an empty table, anchors
    without positives and windows without rows give no rows. Scores that float64 does not hold exactly are computed in
    whole numbers of any size, without bounds; a score beyond a long counts as the nearest long.
    """
    spark = vectors.sparkSession
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    d = rows.agg(F.max(F.size("embedding"))).first()[0]
    made = {r["slice"]: np.frombuffer(r["numbers"]) for r in rows.mapInArrow(_moments(d), "slice int, numbers binary").groupBy("slice").applyInArrow(_merged, "slice int, numbers binary").toLocalIterator()} if d and d > 0 else {}
    if not made or made[0][0] == 0:
        return spark.createDataFrame([], out)
    m = min(d, SKETCH)
    moments, most, n = np.stack([made[k] for k in range(m + 1)]), float(made[m + 1][0]), int(made[0][0])
    mean = moments[0, 1:] / n
    spread, axes = np.linalg.eigh(np.nan_to_num(moments[1:, 1:] / n - np.outer(mean, mean), posinf=1e300, neginf=-1e300))
    axes = axes[:, ::-1][:, :DIRECTIONS]
    scale = np.sqrt(np.maximum(spread[::-1][:DIRECTIONS], 1e-9))
    space = Space(d, most, every, positives, negatives)
    units = max(1, min(-(-n // UNIT), CELLS // d))
    keyed = rows.mapInArrow(_keyed(d, mean, axes, scale), "key long, vec_id long, label long, vector binary")
    ordered = keyed.repartitionByRange(units, "key", "vec_id", F.xxhash64("vector")).sortWithinPartitions("key", "vec_id")
    blocks = stored(ordered.mapInArrow(_blocks(d), _BLOCK), "hilbert-blocks")
    found = {r["unit"]: r for r in blocks.select("unit", "lo", "hi", "label_lo", "label_hi").groupBy("unit").applyInArrow(_zone, "unit int, lo binary, hi binary, label_lo long, label_hi long").toLocalIterator()}
    # Units are numbered anew, as a task of the range may be empty.
    names = sorted(found)
    zones = spark.sparkContext.broadcast(Zones(*([bytes(found[u][c]) for u in names] for c in ("lo", "hi")), *([found[u][c] for u in names] for c in ("label_lo", "label_hi")), d))
    place = F.array(*map(F.lit, names)) if names != list(range(len(names))) else None
    named = blocks if place is None else blocks.withColumn("unit", (F.array_position(place, F.col("unit")) - 1).cast("int"))
    anchors = stored(named.mapInArrow(_anchors(space, zones), _ANCHOR), "anchors")
    task = _unit_task(space, _positives(space), ["anchor", "id", "score"])
    some = _met(named, anchors.where("unit >= 0"), len(names)).mapInArrow(task, "anchor long, id long, score long")
    nth = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("score"), "id"))
    first = some.withColumn("nth", nth).where(F.col("nth") <= positives).groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct(F.col("nth").cast("long").alias("nth"), "id", "score"))).alias("positives"))
    asked = anchors.where("unit = -1").drop("unit", "least").join(first, "anchor")
    kinds = "unit int, " + ", ".join(f"{c} {t}" for c, t in asked.dtypes)
    windows = stored(asked.mapInArrow(_routed(space, zones), kinds), "windows")
    task = _unit_task(space, _negatives(space), ["anchor", "anchor_id", "nth", "positive_id", "positive_score", "negative_id", "negative_score"])
    near = _met(named, windows, len(names)).mapInArrow(task, "anchor long, anchor_id long, nth long, positive_id long, positive_score long, negative_id long, negative_score long")
    rank = F.row_number().over(Window.partitionBy("anchor", "nth").orderBy(F.desc("negative_score"), "negative_id"))
    made = stored(near.withColumn("rank", rank).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "hard-negatives")
    release(spark, blocks, anchors, windows, zones)
    return made
