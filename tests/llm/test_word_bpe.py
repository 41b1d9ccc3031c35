import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from strikeflow.llm import word_bpe as B

PATH = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def words():
    return B.tokenizer(PATH)


def expected(library, rows):
    sha = lambda b: hashlib.sha256(b).hexdigest()
    out = []
    for doc, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        out.append((doc, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids, skip_special_tokens=False).encode())))
    return sorted(out, key=str)


PARTS = ["'s", "'t", "'re", "'VE", "'ll", "'d", "'m", "'", "''", " ", "  ", "\n", "\t", "a", "B", "12", "É", "é", "世", "!", "?", "　", " ", "\u0085", "​", "re", "l", "🙂", "ΣΑΣ", "İ", "S", "\r\n", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endof", "ꟓ", "가", "̈́", "½", "中文", "the", "of"]


def lexicon_of(words, entries):
    merged = [words.merge(w) for w in entries]
    return B.transducer(entries) | {"classes": words.classes(), "offsets": np.concatenate([[0], np.cumsum([len(m) for m in merged])]).astype(np.int32), "ids": np.array([i for m in merged for i in m], np.int32)}


def test_texts_as_the_library_encodes_them(library, words):
    rng = random.Random(1)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    import pyarrow as pa

    for entries in ([], sorted({b"the", b"of", b"a", b"'s", "世".encode(), b"ll", b"theof"})):
        lexicon = lexicon_of(words, entries)
        got = [[] for _ in texts]
        for row, ids in B._ids_of(words, lexicon, pa.array(texts)):
            got[row] += ids.tolist()
        assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_every_character(library, words):
    """Classes and normal forms of all code points, each beside a letter and a number."""
    every = [chr(c) for c in [*range(0xD800), *range(0xE000, 0x110000)]]
    texts = ["".join(f"{c}{c}a1 " for c in every[k : k + 4096]) for k in range(0, len(every), 4096)]
    import pyarrow as pa

    lexicon = lexicon_of(words, [])
    got = [[] for _ in texts]
    for row, ids in B._ids_of(words, lexicon, pa.array(texts)):
        got[row] += ids.tolist()
    for e, t, g in zip(library.encode_batch(texts, add_special_tokens=False), texts, got, strict=True):
        assert e.ids == g, hex(ord(t[0]))


def test_transducer_is_minimal_and_numbers_words():
    rng = random.Random(2)
    entries = sorted({bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 7))) for _ in range(400)} | {b"station", b"nation", b"\xff\xfe"})
    t = B.transducer(entries)
    others = sorted({bytes(rng.choice(b"abcd") for _ in range(rng.randint(1, 8))) for _ in range(400)} - set(entries))
    data = np.frombuffer(b"".join(entries + others), np.uint8)
    size = np.array([len(w) for w in entries + others])
    ends = np.cumsum(size)
    assert B.look_up(t, data, ends - size, ends).tolist() == [*range(len(entries)), *[-1] * len(others)]
    # No two states have the same words after them.
    after = {}
    n = len(t["final"])
    edges = {}
    for k, target in zip(t["keys"].tolist(), t["targets"].tolist(), strict=True):
        edges.setdefault(k >> 8, []).append((k & 255, target))

    def right(s):
        if s not in after:
            after[s] = frozenset(([b""] if t["final"][s] else []) + [bytes([b]) + w for b, x in edges.get(s, []) for w in right(x)])
        return after[s]

    assert len({right(s) for s in range(n)}) == n
    assert B.look_up(B.transducer([]), data, ends - size, ends).tolist() == [-1] * len(size)


@pytest.mark.parametrize("most", [0, 20, 1 << 16])
def test_round_trip_of_odd_rows(spark, odd_docs, library, most, monkeypatch):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    got = B.word_bpe_round_trip(odd_docs, PATH, most).collect()
    assert sorted((tuple(r) for r in got), key=str) == expected(library, rows)


def test_no_rows(no_docs):
    assert B.word_bpe_round_trip(no_docs, PATH).count() == 0


def test_frequent_words_are_all_counted(spark, make_prose):
    texts = [make_prose(random.Random(k), 400) for k in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    from collections import Counter

    count = Counter(w.encode() for t in texts for w in t.split())
    name = B._shipped(spark, B.pack({"classes": B.tokenizer(PATH).classes()}))
    got = B.frequent_words(df.select("doc_id", "text"), PATH, name, 100)
    assert got == sorted(got) and 15 <= len(got) <= 100
    assert min(count[w] for w in got) > max(n for w, n in count.items() if w not in set(got))


def test_encode_and_decode(spark, library):
    rows = [(1, "The cat's Hat <|endoftext|> é"), (2, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    coded = B.encode(df, PATH)
    want = {d: library.encode(t or "", add_special_tokens=False).ids for d, t in rows}
    assert {r["doc_id"]: list(r["ids"]) for r in coded.collect()} == want
    assert {r["doc_id"]: r["text"] for r in B.decode(coded, PATH).collect()} == {d: library.decode(i, skip_special_tokens=False) for d, i in want.items()}


def test_slices_of_a_long_text(library, words, monkeypatch):
    monkeypatch.setattr(B, "SLICE", 50)
    rng = random.Random(5)
    text = "".join(rng.choice(PARTS) for _ in range(2000)) + "x" * 300
    import pyarrow as pa

    lexicon = lexicon_of(words, [b"a", b"the"])
    got = [i for _, ids in B._ids_of(words, lexicon, pa.array([text])) for i in ids.tolist()]
    assert got == library.encode(text, add_special_tokens=False).ids
