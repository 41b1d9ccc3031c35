import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from strikeflow.llm import periodic as R


def plain(words, least=24):
    """Every maximal stretch for every period, smallest periods by trying each smaller one."""
    n, out = len(words), []
    for q in range(1, n // 3 + 1):
        a = 0
        while a < n - q:
            b = a
            while b < n - q and words[b] == words[b + q]:
                b += 1
            if b - a >= 2 * q:
                w = words[a : b + q]
                if not any(all(w[j] == w[j + d] for j in range(len(w) - d)) for d in range(1, q)):
                    out.append((a, b + q - a, q))
            a = b + 1
    return sorted((r for r in out if r[1] >= least), key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def contract(doc_id, text, least=24):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain(words, least)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join("%d,%d,%d\n" % r for r in runs)), sha(collapsed(words, runs)))


def texts(rng):
    """Powers, powers within powers, runs that overlap, near misses, and two-letter noise."""
    word = lambda k: [rng.choice("abcdefgh"[: max(1, k)]) for _ in range(rng.randint(1, 9))]
    for _ in range(250):
        w = []
        for _ in range(rng.randint(1, 5)):
            u = word(rng.randint(1, 8))
            for _ in range(rng.randint(0, 2)):
                u = u * rng.randint(1, 5) + word(rng.randint(1, 3))
            w += (u * rng.randint(1, 7))[: rng.randint(1, 400)]
        if w and rng.random() < 0.3:
            w[rng.randrange(len(w))] = "z"
        yield w
    a, b = ["a"], ["a", "b"]
    for _ in range(12):  # Fibonacci words, full of runs of two and a half periods, and their cubes
        a, b = b, b + a
    yield b
    yield (b[:34] * 7)[: 34 * 7 - 3]
    t = ["a"]
    for _ in range(11):  # Thue-Morse words, which sums of powers of one base do not tell apart
        t = t + ["b" if x == "a" else "a" for x in t]
    yield t
    yield t[:500] * 3 + t[:7]
    yield ["x"] * 1500
    yield (["x"] * 30 + ["y"]) * 20
    yield []


def test_runs_as_the_plain_search_finds_them():
    rng = random.Random(11)
    rows = list(texts(rng))
    code: dict[str, int] = {}
    flat = np.array([code.setdefault(w, len(code) * 7919 + 13) for r in rows for w in r], np.uint64)
    bounds = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    s, e, q = R.find_runs(flat, bounds)
    got = [[] for _ in rows]
    for k, a, b, p in zip((np.searchsorted(bounds, s, side="right") - 1).tolist(), s.tolist(), e.tolist(), q.tolist(), strict=True):
        got[k].append((a - int(bounds[k]), b - a, p))
    assert got == [plain(r, 0) for r in rows]
    assert sum(map(len, got)) > 500


def test_contract(spark):
    rng = random.Random(12)
    rows = [(k, (" " * rng.randint(0, 2)) + rng.choice([" ", "\t", " \n"]).join(w)) for k, w in enumerate(texts(rng))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = R.run_digests(R.periodic_runs(R.with_periodic_tails(df))).collect()
    want = sorted(contract(*r) for r in rows)
    assert sorted(tuple(r) for r in got) == want
    assert sum(w[1] > 0 for w in want) > 50


def test_odd_rows(spark, odd_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    got = R.run_digests(R.periodic_runs(R.with_periodic_tails(odd_docs)))
    short = [(d, t if t is None or len(t) < 5000 else None) for d, t in rows]
    want = {str(contract(*r)) for r in short if r[0] not in (7, 8)}
    have = [tuple(r) for r in got.collect()]
    assert len(have) == len(rows) and {str(h) for h in have if h[0] not in (7, 8)} == want
    assert got.dtypes == [*((c, "bigint") for c in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli")), ("runs_sha256", "string"), ("collapsed_sha256", "string")]


def test_no_rows(no_docs):
    assert R.periodic_runs(no_docs).count() == 0


@pytest.mark.parametrize("period", [1, 7, 8, 9, 1000, 33333])
def test_long_texts(period):
    """A text of one run from end to end, and one whose run is a third of it."""
    rng = np.random.default_rng(period)
    unit = rng.integers(1, 1 << 62, period).astype(np.uint64)
    x = np.tile(unit, -(-100_000 // period))[:100_000]
    s, e, q = R.find_runs(x, np.array([0, len(x)]))
    assert list(zip(s, e, q, strict=True)) == [(0, 100_000, period)]
    noise = rng.integers(1, 1 << 62, 200_000).astype(np.uint64)
    s, e, q = R.find_runs(np.concatenate([noise, x]), np.array([0, 300_000]))
    assert list(zip(s, e, q, strict=True)) == [(200_000, 300_000, period)]
