"""Periodic runs of words: stretches that repeat themselves at least three times.

Squares (a stretch and the same stretch again) are caught as an online algorithm does: a catcher stands on each
completed block of 2^k words and watches for distances q in [2^k, 2^(k+1)) whether the words that are appended end in the
block again. A catch is a suffix that repeats at distance q; comparing on from it, either way, gives the stretch in which words q apart are
the same, and with it the run that the square belongs to. A run of period q and three periods holds such a block whole, so every one is caught.
Appended words are taken a block's worth at a time, so that a level's catchers advance together as one array.

Catches inside a run that is known are multiples of its period and are not compared again: texts that repeat one word
from end to end cost no more than others. A catch is found by sums of the words' 64-bit hashes; every run is settled by comparing these one by one.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strikeflow.llm.textcore import BASE, SPACED, U64, buffers, mix, pieces, powers, run_hashes, spans

#: A run is as long as this many words, and as many periods.
LEAST_WORDS, POWER = 24, 3
#: Blocks of fewer words are compared at each distance.
HASHED = 8


@functools.cache
def _inverse() -> np.uint64:
    return U64(pow(int(BASE), -1, 1 << 64))


@functools.cache
def _divisors(q: int) -> tuple[int, ...]:
    """q divided by each of its primes: if q is no smallest period of a long run, one of these is a period."""
    primes, rest, p = [], q, 2
    while p * p <= rest:
        if rest % p == 0:
            primes.append(p)
            while rest % p == 0:
                rest //= p
        p += 1
    return tuple(q // p for p in [*primes, *([rest] if rest > 1 else [])])


def _stretch(x: np.ndarray, i: int, q: int, low: int, high: int) -> tuple[int, int]:
    """The stretch around place i, between low and high, in which x[j] == x[j + q]; empty if i is not in one."""
    b, step = i, 32
    while b < high - q:
        n = min(step, high - q - b)
        other = np.flatnonzero(x[b : b + n] != x[b + q : b + q + n])
        if len(other):
            b += int(other[0])
            break
        b, step = b + n, step * 2
    a, step = i, 32
    while a > low:
        n = min(step, a - low)
        other = np.flatnonzero(x[a - n : a] != x[a - n + q : a + q])
        if len(other):
            a += int(other[-1]) + 1 - n
            break
        a, step = a - n, step * 2
    return a, b


def _is_smallest(x: np.ndarray, s: int, q: int) -> bool:
    """Whether a run from s with period q, at least three periods long, has no smaller one."""
    return not any(np.array_equal(x[s : s + q], x[s + d : s + d + q]) for d in _divisors(q))


def _short(x: np.ndarray, q: int) -> Iterator[tuple[int, int]]:
    """Stretches of x[j] == x[j + q] of POWER - 1 periods and more."""
    if len(x) < POWER * q:
        return
    same = np.zeros(len(x) - q + 2, np.int8)
    same[1:-1] = x[q:] == x[:-q]
    turn = np.diff(same)
    a, b = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    long = b - a >= (POWER - 1) * q
    yield from zip(a[long].tolist(), b[long].tolist(), strict=True)


def _caught(x: np.ndarray, c: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of the block, distance) of what the catchers on blocks of c words catch, if half of the words that a run still lacks
    follow or precede alike."""
    n = len(x)
    sums = np.zeros(n + 1, U64)
    np.cumsum(x * powers(n), out=sums[1:])
    back = powers(n + 1, _inverse())
    ends = (sums[c:] - sums[:-c]) * back[: n - c + 1]
    blocks = -(-len(ends) // c)
    padded = np.zeros((blocks + 1) * c, U64)
    padded[: len(ends)] = ends
    m, r = np.nonzero(padded[c:].reshape(blocks, c) == padded[: blocks * c : c, None])
    i, q = m * c, c + r
    inside = i + q + c <= n
    i, q = i[inside], q[inside]
    half = ((POWER - 1) * q - c + 1) // 2

    def alike(at: np.ndarray) -> np.ndarray:
        ok = (at >= 0) & (at + q + half <= n)
        a = np.where(ok, at, 0)
        h = np.where(ok, half, 0)
        one, two = (sums[a + h] - sums[a]) * back[a], (sums[np.where(ok, a + q + h, 0)] - sums[np.where(ok, a + q, 0)]) * back[np.where(ok, a + q, 0)]
        return ok & (one == two)

    good = alike(i + c) | alike(i - half)
    return i[good], q[good]


def find_runs(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, smallest period) of the maximal runs of POWER periods and more in rows of word hashes that stand end to end; no
    run leaves its row. By start, then period."""
    n = np.diff(bounds)
    row = np.repeat(np.arange(len(n)), n)
    with np.errstate(over="ignore"):
        x = mix(words + mix(row.astype(U64) + U64(1)))
        found: list[tuple[int, int, int]] = []
        for q in range(1, HASHED):
            found += [(a, b + q, q) for a, b in _short(x, q) if _is_smallest(x, a, q)]
        c = HASHED
        while (n >= POWER * c).any():
            at = np.flatnonzero((n >= POWER * c)[row])
            i, q = _caught(x[at], c)
            i = at[i]
            # What lies within a run of a smaller period is a repetition of that.
            reach = np.zeros(len(x) + 1, np.int64)
            if found:
                s, e, _ = np.array(found).T
                np.maximum.at(reach, s, e)
            reach = np.maximum.accumulate(reach)
            new = reach[i] < i + c + q
            i, q = i[new], q[new]
            order = np.lexsort((i, q))
            over = (0, 0)  # distance and end of the last stretch
            for i_, q_ in zip(i[order].tolist(), q[order].tolist(), strict=True):
                if over[0] == q_ and i_ < over[1]:
                    continue
                r = row[i_]
                a, b = _stretch(x, i_, q_, int(bounds[r]), int(bounds[r + 1]))
                over = (q_, b)
                if b - a >= (POWER - 1) * q_ and _is_smallest(x, a, q_):
                    found.append((a, b + q_, q_))
            c *= 2
    found.sort(key=lambda f: (f[0], f[2]))
    s, e, q = np.array(found, np.int64).reshape(-1, 3).T
    return s, e, q


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, kept: np.ndarray) -> pa.Array:
    """The kept words of each row, with one blank between two."""
    before = np.concatenate([[0], np.cumsum(kept)])
    size = (ends - starts + 1)[kept]
    rows = before[bounds]
    last = rows[1:][np.diff(rows) > 0] - 1
    size[last] -= 1
    first = np.cumsum(size) - size
    where = np.arange(int(size.sum())) + np.repeat(starts[kept] - first, size)
    out = np.append(data, np.uint8(32))[where] if len(where) else np.zeros(0, np.uint8)
    blank = np.ones(len(size), bool)
    blank[last] = False
    out[(first + size - 1)[blank]] = 32
    offs = np.concatenate([[0], np.cumsum(size)])[rows]
    return pa.Array.from_buffers(pa.large_string(), len(rows) - 1, [None, pa.py_buffer(offs.astype(np.int64).tobytes()), pa.py_buffer(out.tobytes())])


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _scan(least: int):
    def run(batches):
        for piece in pieces(batches):
            data, offs = buffers(piece.column("text"))
            starts, ends, bounds = spans(data, offs, SPACED)
            s, e, q = find_runs(run_hashes(data, starts, ends), bounds)
            long = e - s >= least
            s, e, q = s[long], e[long], q[long]
            turn = np.zeros(len(starts) + 1, np.int64)
            np.add.at(turn, s + q, 1)
            np.add.at(turn, e, -1)
            kept = np.cumsum(turn[:-1]) == 0
            row = np.searchsorted(bounds, s, side="right") - 1
            runs = pa.StructArray.from_arrays([pa.array(s - bounds[row]), pa.array(e - s), pa.array(q)], fields=list(_RUN))
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(piece.num_rows + 1)).astype(np.int32)), runs)
            text = _joined(data, starts, ends, bounds, kept).cast(pa.string())
            yield pa.record_batch([piece.column("doc_id"), pa.array(np.diff(bounds)), lists, text], names=["doc_id", "n_words", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, n_words, runs array<struct<start, length, period>>, collapsed): the maximal periodic stretches of words of every
    text, by start, then period, and the text without what repeats.

    Words are `[^\\x20\\x09-\\x0D]+`, numbered from 0. A run is a stretch of `least` words and three periods or more, of
    smallest period q, that no neighbouring word extends. A word goes from `collapsed` if a run holds it after that
    run's first q words; the others are joined by one blank. Whole texts are read; runs may overlap. Null, empty and
    blank texts have no words, no runs and an empty text; repeated rows give a row each; null doc_ids stay null; other columns are ignored;
    an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_scan(least), "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def run_digests(found: DataFrame) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of what periodic_runs() gives: the run of
    the greatest exact length / period (ties: smallest start, then period; nulls without runs), and digests of all runs and of the text."""
    # Of two runs the later one only if it is greater: they come by start and period.
    best = F.reduce("runs", F.try_element_at("runs", F.lit(1)), lambda top, r: F.when(r["length"] * top["period"] > top["length"] * r["period"], r).otherwise(top))
    line = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))))
    rows = found.withColumn("best", best)
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(line, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def _tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in pieces(batches):
        texts = piece.column("text").to_pylist()
        for k, doc_id in enumerate(piece.column("doc_id").to_pylist()):
            h = zlib.crc32(str(doc_id).encode())
            if doc_id is None or texts[k] is None or h % 10:
                continue
            words = re.findall(r"[^\x20\x09-\x0D]+", texts[k])
            if n := len(words):
                g = h // 10
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                texts[k] = " ".join(words[:a] + (words[a : a + p] * -(-(n - a) // p))[: n - a])
        yield pa.record_batch([piece.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text): a tenth of the documents, by h = crc32 of the decimal doc_id, end in repetitions of their own words. With g = h // 10 and n words
    every word i >= a becomes the word a + (i - a) % p, where a = g % n and p = 1 + (n - a) // (3 + g % 8). Texts without words
    and rows with a null doc_id stay as they are."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_tails, "doc_id long, text string")
