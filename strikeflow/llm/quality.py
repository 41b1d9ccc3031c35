"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded by its bytes and words, a hidden
layer embeds it, gated attention weighs the passages of a document, and a
logistic layer scores the weighted sum. Only document labels are needed; the attention
learns which passages matter. The net is trained on a bounded sample of labelled
documents and then scores every whole document in parallel.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strikeflow.llm.textcore import LOWER, SPACED, U64, buffers, give_back, mix, pieces, run_hashes, spans

PASSAGE_WORDS = 64
#: Labelled documents that the net is fitted on, fewer if these have more passages in all than that: bounds what the driver holds.
#: A document counts with all of its passages.
SAMPLE_DOCS, SAMPLE_PASSAGES = 4000, 100_000
BIGRAMS = 192
HIDDEN, GATE = 32, 16

#: Byte classes: control, blank, digit, upper, lower, non-ASCII, and the ASCII signs in five kinds.
CLASS = np.zeros(256, np.int64)
CLASS[[9, 10, 13]] = 1
CLASS[32] = 2
CLASS[48:58], CLASS[65:91], CLASS[97:123], CLASS[128:] = 3, 4, 5, 6
for k, signs in enumerate((b".,;:", b"!?", b"'\"()-", b"#$%&*+=@^~", b"/<>[]\\_`{|}")):
    CLASS[list(signs)] = 7 + k
CLASSES = 12
WIDTH = CLASSES + BIGRAMS + 7


def passages(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of the passages of all texts, and the row bounds. A text without words has
    one passage without any feature."""
    data, offs = buffers(texts)
    starts, ends, bounds = spans(data, offs, SPACED)
    words = np.diff(bounds)
    count = np.maximum(1, -(-words // PASSAGE_WORDS))
    at = np.concatenate([[0], np.cumsum(count)])
    n = int(at[-1])
    out = np.zeros((n, WIDTH), np.float32)
    if not len(starts):
        return out, at
    row = np.repeat(np.arange(len(words)), words)
    place = np.arange(len(starts)) - bounds[:-1][row]
    of = at[:-1][row] + place // PASSAGE_WORDS
    size = np.bincount(of, minlength=n).astype(np.float32)
    some = np.maximum(size, 1)
    # Bytes belong to the passage of the last word that began at or before them.
    begin = np.zeros(len(data), bool)
    begin[starts] = True
    nth = np.cumsum(begin) - 1
    own = np.where(nth >= 0, of[np.maximum(nth, 0)], 0)
    kind = np.bincount(own * CLASSES + CLASS[data], minlength=n * CLASSES).reshape(n, CLASSES)
    total = np.maximum(kind.sum(1), 1)
    out[:, :CLASSES] = kind / total[:, None]
    low = LOWER[data].astype(np.int64)
    pair = (low[:-1] * 31 + low[1:] * 17) % BIGRAMS
    bigram = np.bincount(own[:-1] * BIGRAMS + pair, minlength=n * BIGRAMS).reshape(n, BIGRAMS)
    out[:, CLASSES : CLASSES + BIGRAMS] = np.sqrt(bigram / total[:, None])
    length = ends - starts
    mark = run_hashes(LOWER[data], starts, ends)
    mean = lambda x: np.bincount(of, x, minlength=n) / some
    first, last = CLASS[data[starts]], CLASS[data[ends - 1]]
    same = np.zeros(len(mark), bool)
    same[1:] = (mark[1:] == mark[:-1]) & (row[1:] == row[:-1])
    # Words whose pair with the next word stands elsewhere in the document, too.
    two = mix(mark[:-1] + mark[1:] * U64(3) + mix(row[:-1].astype(U64)))
    _, back, seen = np.unique(two, return_inverse=True, return_counts=True)
    again = np.append(seen[back] > 1, False)
    distinct = np.unique(of.astype(np.uint64) * U64(1 << 40) + (mark >> U64(24)))
    inside = np.bincount((distinct >> U64(40)).astype(np.int64), minlength=n)
    extra = (mean(length) / 12, mean(first == 4), mean((last >= 9) & (last < 12)), mean(last == 8), mean(same), mean(again), inside / some)
    out[:, CLASSES + BIGRAMS :] = np.stack(extra, 1)
    return out, at


class Net:
    """Gated attention over passages, with its gradients."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        make = lambda a, b: (rng.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
        self.mean, self.scale = np.zeros(WIDTH, np.float32), np.ones(WIDTH, np.float32)
        self.p = {"w": make(WIDTH, HIDDEN), "b": np.zeros(HIDDEN, np.float32), "v": make(HIDDEN, GATE), "u": make(HIDDEN, GATE), "a": make(GATE, 1), "c": make(HIDDEN, 1), "d": np.zeros(1, np.float32)}

    def forward(self, x: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        x = np.clip((x - self.mean) * self.scale, -8, 8)
        h = np.tanh(x @ p["w"] + p["b"])
        t, s = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        e = ((t * s) @ p["a"])[:, 0]
        n = np.diff(at)
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, at[:-1]), n))
        alpha = e / np.repeat(np.add.reduceat(e, at[:-1]), n)
        z = np.add.reduceat(alpha[:, None] * h, at[:-1], axis=0)
        return {"x": x, "h": h, "t": t, "s": s, "alpha": alpha, "z": z, "logit": (z @ p["c"])[:, 0] + p["d"][0]}

    def score(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.forward(x, at)["logit"].astype(np.float64), -30, 30)))

    def gradients(self, x: np.ndarray, at: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, f, n = self.p, self.forward(x, at), np.diff(at)
        g = ((1 / (1 + np.exp(-f["logit"]))) - y).astype(np.float32) / len(y)
        dz = np.repeat(g, n)[:, None] * p["c"][:, 0]
        dh = f["alpha"][:, None] * dz
        da = (dz * f["h"]).sum(1)
        da = f["alpha"] * (da - np.repeat(np.add.reduceat(f["alpha"] * da, at[:-1]), n))
        gate = da[:, None] * p["a"][:, 0]
        dt, ds = gate * f["s"] * (1 - f["t"] ** 2), gate * f["t"] * f["s"] * (1 - f["s"])
        dh += dt @ p["v"].T + ds @ p["u"].T
        dx = dh * (1 - f["h"] ** 2)
        return {"w": f["x"].T @ dx, "b": dx.sum(0), "v": f["h"].T @ dt, "u": f["h"].T @ ds, "a": (f["t"] * f["s"]).T @ da[:, None], "c": f["z"].T @ g[:, None], "d": g.sum(keepdims=True)}

    def fit(self, every: np.ndarray, bounds: np.ndarray, y: np.ndarray, epochs: int = 40, batch: int = 128, rate: float = 3e-3, decay: float = 1e-4) -> Net:
        """Bags are the rows of `every` between bounds. Nothing of its size is made beside it."""
        bags = [every[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        std = np.concatenate([every[:, k : k + 16].std(0) for k in range(0, WIDTH, 16)])
        self.mean, self.scale = every.mean(0), 1 / (std + 1e-2)
        rng = np.random.default_rng(1)
        m, v, step = {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0
        for _ in range(epochs):
            for some in np.array_split(rng.permutation(len(bags)), max(1, len(bags) // batch)):
                step += 1
                at = np.concatenate([[0], np.cumsum([len(bags[i]) for i in some])])
                for k, g in self.gradients(np.concatenate([bags[i] for i in some]), at, y[some]).items():
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8) + decay * self.p[k])).astype(np.float32)
        return self


def _encoded(batches):
    for piece in pieces(batches):
        x, at = passages(piece.column("text"))
        rows = [x[a:b].astype(np.float16).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
        yield pa.record_batch([piece.column("doc_id"), piece.column("quality"), pa.array(rows, pa.binary())], names=["doc_id", "quality", "x"])


def _scored(net: Net | None, column: str):
    def run(batches):
        for piece in pieces(batches):
            x, at = passages(piece.column("text"))
            score = net.score(x, at) if net else np.full(piece.num_rows, 0.5)
            yield pa.record_batch([*piece.columns, pa.array(score)], names=[*piece.schema.names, column])

    return run


def fit_quality(docs: DataFrame, labels: DataFrame, usable, sample: int = SAMPLE_DOCS, passages_bound: int = SAMPLE_PASSAGES) -> Net | None:
    """The net, fitted on at most `sample` documents whose labels satisfy the column `usable`
    (they are picked by a hash of doc_id, as many as have `passages_bound` passages; a document is used whole); None if there are none of both kinds. Rows with null doc_id or quality are not used;
    of repeated labels the least counts."""
    labels = labels.where(usable & F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    picked = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # At most `sample` rows of 12 bytes: safe to broadcast at any input size.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id").select("doc_id", "text", "quality")
    coded = rows.mapInArrow(_encoded, "doc_id long, quality int, x binary").select("*", F.xxhash64("doc_id").alias("h"))
    seen, held, total = {}, [], 0
    for r in coded.toLocalIterator():
        if r["doc_id"] in seen:
            continue
        seen[r["doc_id"]] = (r["quality"], np.frombuffer(r["x"], np.float16).reshape(-1, WIDTH))
        heapq.heappush(held, (-r["h"], r["doc_id"]))
        total += len(seen[r["doc_id"]][1])
        # Of too many passages those of the documents go that were picked last.
        while total > passages_bound and len(held) > 2:
            total -= len(seen.pop(heapq.heappop(held)[1])[1])
    if len({q for q, _ in seen.values()}) < 2:
        return None
    order = sorted(seen)
    y = np.array([seen[k][0] for k in order], np.float32)
    bounds = np.concatenate([[0], np.cumsum([len(seen[k][1]) for k in order])])
    every = np.empty((bounds[-1], WIDTH), np.float32)
    for k, a, b in zip(order, bounds[:-1], bounds[1:], strict=True):
        every[a:b] = seen.pop(k)[1]
    net = Net().fit(every, bounds, y)
    del every
    give_back()
    return net


def quality_scores(docs: DataFrame, net: Net | None, column: str = "score") -> DataFrame:
    """`docs` with a column of this name, the probability of good quality, in place of any of that name.

    Null and empty texts are scored as one passage without features; without a net
    every score is 0.5. Whole texts are read; other columns are kept as they are.
    """
    from pyspark.sql.types import DoubleType, StructType

    docs = docs.drop(column)
    return docs.mapInArrow(_scored(net, column), StructType([*docs.schema.fields]).add(column, DoubleType()))
