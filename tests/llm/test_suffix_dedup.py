import collections
import hashlib
import random

import pytest

from strikeflow.llm import suffix_dedup as S


def brute(rows, size, keep_first):
    """Rows in order of doc_id, nulls first."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    raw = [(t or "").encode() for _, t in rows]
    count, first = collections.Counter(), {}
    for k, t in enumerate(raw):
        for i in range(len(t) - size + 1):
            count[t[i : i + size]] += 1
            first.setdefault(t[i : i + size], (k, i))
    out = []
    for k, t in enumerate(raw):
        hit = bytearray(len(t))
        for i in range(len(t) - size + 1):
            w = t[i : i + size]
            if (first[w] != (k, i)) if keep_first else count[w] > 1:
                hit[i : i + size] = b"\1" * size
        kept = bytes(b for b, h in zip(t, hit, strict=True) if not h)
        spans = sum(1 for i in range(len(hit)) if hit[i] and not (i and hit[i - 1]))
        out.append((rows[k][0], len(t), sum(hit), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(df, size, keep_first):
    got = S.suffix_dedup(df, size, keep_first).collect()
    assert all(r["n_repeated"] == r["n_removed"] for r in got)
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got), key=str)


@pytest.mark.parametrize("bucket", [2000, 2])
@pytest.mark.parametrize("keep_first", [False, True])
def test_against_all_windows(spark, make_prose, monkeypatch, bucket, keep_first):
    monkeypatch.setattr(S, "BUCKET_MAX", bucket)
    monkeypatch.setattr(S, "BLOCK", 3000)
    rng = random.Random(8)
    shared = [make_prose(rng, 60) for _ in range(3)]
    rows = []
    for i in range(30):
        parts = [make_prose(rng, rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            a = rng.randint(0, 40)
            parts += [s[a : a + rng.randint(100, 400)], make_prose(rng, rng.randint(0, 20))]
        rows.append((i, " ".join(parts)))
    rows += [(50, "ab" * 900), (51, "é" * 300), (52, make_prose(rng, 2000)), (53, None), (54, "")]
    rows.append((55, rows[-3][1][2000:9000]))
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert run(df, 150, keep_first) == brute(rows, 150, keep_first)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert run(odd_docs, 200, False) == brute(rows, 200, False)
    assert run(no_docs, 200, False) == []


@pytest.mark.parametrize("keep_first", [False, True])
def test_shorter_repeats_are_counted(spark, make_prose, keep_first):
    rng = random.Random(9)
    shared = make_prose(rng, 90)
    rows = []
    for i in range(20):
        a, n = rng.randint(0, 200), rng.randint(60, 260)
        rows.append((i, " ".join([make_prose(rng, rng.randint(0, 40)), shared[a : a + n], make_prose(rng, 9), shared[5 : 5 + n // 2]])))
    rows.append((30, None))
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = S.suffix_dedup(df, 150, keep_first, least=80).collect()
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got), key=str) == brute(rows, 150, keep_first)
    assert sorted(((r["doc_id"], r["n_repeated"]) for r in got), key=str) == [(r[0], r[2]) for r in brute(rows, 80, False)]
    assert any(r["n_repeated"] > r["n_removed"] > 0 for r in got)


@pytest.mark.parametrize("keep_first", [False, True])
def test_a_line_that_fills_texts(spark, make_prose, monkeypatch, keep_first):
    """All places of a repeated line in a text are one row of the join with the kinds that occur again, and all of them are cut."""
    rng = random.Random(10)
    line = make_prose(rng, 60)[:300] + "."
    rows = [(i, " ".join([line] * 20 + [make_prose(rng, 30)])) for i in range(12)] + [(20, make_prose(rng, 80)), (21, line), (22, None)]
    stored, made = S.stored, {}

    def counted(df, name):
        out = stored(df, name)
        made[name] = made.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(S, "stored", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert run(df, 200, keep_first) == brute(rows, 200, keep_first)
    # A row for each kind of segment and text, not for each of 20 places.
    assert made["repeats"] < 13 * 20


def test_suffix_order():
    import numpy as np

    text = b"abracadabra" * 5
    windows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(text, np.uint8), 20)
    bucket = np.arange(len(windows)) % 2
    order, shared = S.suffix_order(windows, bucket)
    keyed = [(int(bucket[i]), bytes(windows[i])) for i in order]
    assert keyed == sorted(keyed)
    for k in range(1, len(order)):
        (p, x), (q, y) = keyed[k - 1 : k + 1]
        assert shared[k] == (next((i for i in range(20) if x[i] != y[i]), 20) if p == q else 0)


def test_previous_factors_against_all_pairs():
    import numpy as np

    rng = random.Random(2)
    text = bytes(rng.choice(b"ab") for _ in range(150))
    windows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(text, np.uint8), 12)
    order, shared = S.suffix_order(windows, np.zeros(len(windows), int))
    got = np.zeros(len(order), int)
    got[order] = S.previous_factors(order, shared)
    common = lambda x, y: next((i for i in range(12) if x[i] != y[i]), 12)
    assert got.tolist() == [max((common(windows[i], windows[j]) for j in range(i)), default=0) for i in range(len(windows))]
