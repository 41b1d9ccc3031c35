import random
import re

import numpy as np
import pytest

from strikeflow.llm import ngram_join as J
from strikeflow.llm.graph import components

FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows):
    """doc_id of each row's component, by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(((doc, len(s), least.get(find(i)) if s else doc) for i, ((doc, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def edited(rng, text, n):
    w = text.split(" ")
    for _ in range(n):
        w[rng.randrange(len(w))] = "".join(rng.choice("xyz") for _ in range(9))
    return " ".join(w)


@pytest.mark.parametrize(("salted", "small"), [(J.SALTED, J.SMALL_BUCKET), (2, 2)])
def test_against_all_pairs(spark, make_prose, salted, small, monkeypatch):
    monkeypatch.setattr(J, "SALTED", salted)
    monkeypatch.setattr(J, "SMALL_BUCKET", small)
    rng = random.Random(5)
    bases = [make_prose(rng, rng.randint(30, 150)) for _ in range(6)]
    rows = [(i, edited(rng, b, rng.randint(0, 9))) for i, b in enumerate(b for b in bases for _ in range(12))]
    rows += [(1000 + i, t) for i, t in enumerate(["", None, "one", "One", "one two three four", "ONE two\tthree\nfour", "one two three four five"])]
    rng.shuffle(rows)
    got = J.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    got = J.ngram_jaccard_join(odd_docs).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)
    assert J.ngram_jaccard_join(no_docs).count() == 0


def test_threshold_is_exact(spark):
    # 7 and 8 shingles, 6 shared: 6 of 9 is below, 6 of 8 is not
    w = [f"w{i}" for i in range(20)]
    a, b, c = " ".join(w[:11]), " ".join(w[1:12]), " ".join(w[:12])
    rows = [(1, a), (2, b), (3, c)]
    got = J.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_partners_against_all_pairs():
    rng = np.random.default_rng(4)
    bucket = np.sort(rng.integers(0, 30, 300))
    size = rng.integers(1, 40, 300)
    order = np.lexsort((size, bucket))
    size = size[order]
    pos = (rng.random(300) * (size - -(-75 * size // 100) + 1)).astype(int)
    most = J._most(size, pos, 75, 100)
    want = []
    for i in range(300):
        # At least 3/7 of both sizes in common, of what is left from the shared shingle on
        want.append(any(i != j and bucket[i] == bucket[j] and 175 * min(size[i] - pos[i], size[j] - pos[j]) >= 75 * (size[i] + size[j]) for j in range(300)))
    assert J._has_partner(bucket, size, most).tolist() == want
    assert any(want) and not all(want)


def test_suffix_filter_is_a_bound():
    rng = np.random.default_rng(6)
    draw = lambda n: np.sort(rng.integers(0, 2**64, n, dtype=np.uint64))
    import pyarrow as pa

    for n in (20, 300, 5000):
        both, mine, yours = draw(n), draw(n // 7), draw(n // 9)
        x, y = np.sort(np.concatenate([both, mine])), np.sort(np.concatenate([both, yours]))
        far = draw(n)
        rows = [(1, 2, J._ranges(x), J._ranges(y), len(x), len(y)), (1, 3, J._ranges(x), J._ranges(far), len(x), len(far)), (1, 4, b"", J._ranges(far), len(x), len(far))]
        batch = pa.RecordBatch.from_pydict(dict(zip(("x", "y", "x_ranges", "y_ranges", "x_size", "y_size"), map(list, zip(*rows, strict=True)), strict=True)))
        kept = {y for b in J._may_link(75, 100)([batch]) for y in b.column("y").to_pylist()}
        assert {2, 4} <= kept and (n < 100 or 3 not in kept)


@pytest.mark.parametrize("local", [None, 7])
def test_components(spark, local):
    rng = np.random.default_rng(1)
    chain = [(i, i + 1) for i in range(40)]
    edges = chain + [(int(a), int(b)) for a, b in rng.integers(100, 160, (40, 2))]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame([*edges, (7, 7), (None, 3)], "a long, b long"), local=local).collect()}
    root = {}
    for a, b in edges:
        x, y = a, b
        while root.get(x, x) != x:
            x = root[x]
        while root.get(y, y) != y:
            y = root[y]
        root[max(x, y)] = min(x, y)

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    assert got == {n: find(n) for e in edges if e[0] != e[1] for n in e}


def test_more_parts_for_more_shingles(spark, make_prose, monkeypatch):
    """Parts by volume give the same links."""
    import random

    from strikeflow.llm import ngram_join as J

    rng = random.Random(9)
    texts = [make_prose(rng, 50) for _ in range(40)]
    texts += [t + " " + make_prose(rng, 3) for t in texts[::2]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted(map(tuple, J.ngram_jaccard_join(df).collect()))
    monkeypatch.setattr(J, "PART_SHINGLES", 20)
    assert sorted(map(tuple, J.ngram_jaccard_join(df).collect())) == want
    assert len({r[2] for r in want}) == 40
