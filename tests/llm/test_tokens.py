import base64
import hashlib
import random

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest

from strikeflow.llm import token_output as T
from strikeflow.llm.bpe import OVERLAP_CHARS, bpe_round_trip, encode, ranks

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    import tiktoken

    with open(PATH, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=table, special_tokens={})


def expected(library, rows):
    sha = lambda b: hashlib.sha256(b).hexdigest()
    out = []
    for doc, text in rows:
        ids = library.encode_ordinary(text or "")
        out.append((doc, len(ids), sha(np.array(ids, "<u4").tobytes()), sha((text or "").encode())))
    return sorted(out, key=str)


PARTS = ["'s", "'t", "'re", "'ve", "'ll", "'d", "'m", "'", " ", "  ", "\n", "\t", "a", "b", "1", "é", "世", "!", "?", "　", "re", "l", "🙂", "'l", "S", "\r\n", "<|endoftext|>"]


def test_pre_tokens(library):
    rng = random.Random(1)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(5000)]
    ids, at = ranks(PATH, P.PATTERN).encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [library.encode_ordinary(t) for t in texts]


@pytest.mark.parametrize("chunk", [700, 1 << 15])
def test_chunks(spark, library, make_prose, chunk):
    rng = random.Random(2)
    rows = [(i, make_prose(rng, rng.randint(0, 700))) for i in range(20)]
    rows += [(30, " " * 3000), (31, "x" * (3 * OVERLAP_CHARS + 900)), (32, "".join(rng.choice(PARTS) for _ in range(4000))), (33, "a b" * 900 + "y" * 2000 + " c d" * 300), (34, None), (35, ""), (35, "")]
    got = bpe_round_trip(spark.createDataFrame(rows, "doc_id long, text string"), PATH, P.PATTERN, chunk).collect()
    assert sorted((tuple(r) for r in got), key=str) == expected(library, rows)


def test_odd_rows(spark, library, odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert sorted((tuple(r) for r in bpe_round_trip(odd_docs, PATH, P.PATTERN, 500).collect()), key=str) == expected(library, rows)
    assert bpe_round_trip(no_docs, PATH, P.PATTERN).count() == 0
    parts = encode(odd_docs, PATH, P.PATTERN, 500).orderBy("row", "segment").collect()
    assert b"".join(r["decoded"] for r in parts if r["doc_id"] == 7).decode() == next(t for d, t in rows if d == 7)


@pytest.mark.parametrize("n", [1, 2, 3, 1000, 4097])
def test_permutation(n):
    p = T.permute(np.arange(n), n, 11)
    assert sorted(p) == list(range(n))
    assert (T.permute(p, n, 11, inverse=True) == np.arange(n)).all()
    if n > 100:
        assert (p != np.arange(n)).mean() > 0.9 and (p != T.permute(np.arange(n), n, 12)).any()


def test_shards(spark, library, odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    shards = T.token_shards(odd_docs, PATH, P.PATTERN, key=5, length=64, shard=16)
    got = shards.orderBy("shard").collect()
    want = []
    for doc, text in rows:
        ids = [*library.encode_ordinary(text or ""), 50256]
        want += [(doc, k // 64, ids[k : k + 64]) for k in range(0, len(ids), 64)]
    assert [r["first_slot"] for r in got] == [16 * k for k in range(len(got))]
    assert all(r["n_sequences"] == 16 for r in got[:-1]) and sum(r["n_sequences"] for r in got) == len(want)
    held = []
    for r in got:
        assert len(r["payload"]) == r["stride"] * r["n_sequences"] and hashlib.sha256(r["payload"]).hexdigest() == r["sha256"]
        all_ = np.frombuffer(r["payload"], "<u2").reshape(-1, 64)
        held += [(d, p, x[:n].tolist()) for d, p, n, x in zip(r["doc_ids"], r["parts"], r["n_tokens"], all_, strict=True)]
    assert sorted(held, key=str) == sorted(want, key=str)
    assert held != sorted(held, key=str)
    some = T.read_slots(shards, 10, 20, 16).orderBy("slot").collect()
    assert [(r["doc_id"], r["part"], np.frombuffer(r["tokens"], "<u2").tolist()) for r in some] == held[10:30]
    assert T.token_shards(no_docs, PATH, P.PATTERN).count() == 0


def test_slots_follow_the_permutation_however_rows_are_split(spark, library, odd_docs):
    rows = [(r["doc_id"], r["text"] or "") for r in odd_docs.collect()]
    a, b = (
        {(r["first_slot"] + k): (d, p, n) for r in T.token_shards(df, PATH, P.PATTERN, key=9, length=64, shard=16).collect() for k, (d, p, n) in enumerate(zip(r["doc_ids"], r["parts"], r["n_tokens"], strict=True))}
        for df in (odd_docs.coalesce(1), odd_docs.repartition(7))
    )
    assert a == b
    # Sequences in the order of ids, nulls first; texts of one id go by hash, and here these are alike or have one sequence.
    count = [(d, -(-(len(library.encode_ordinary(t)) + 1) // 64)) for d, t in rows]
    back = T.permute(np.arange(len(a)), len(a), 9)
    ordered = [a[int(s)][0] for s in back]
    assert ordered == sorted(ordered, key=lambda d: (d is not None, d or 0))
    assert len(ordered) == sum(n for _, n in count)
    for doc in {d for d, _ in rows}:
        parts = [a[int(s)][1] for s in back if a[int(s)][0] == doc]
        assert sorted(parts) == sorted(p for d, n in count if d == doc for p in range(n))


def test_shard_files(spark, odd_docs, tmp_path):
    shards = T.token_shards(odd_docs, PATH, P.PATTERN, key=5, length=64, shard=16)
    folder = f"file://{tmp_path}/shards"
    index = T.write_shards(shards, folder)
    want = b"".join(r["payload"] for r in shards.orderBy("shard").collect())
    files = sorted((tmp_path / "shards").glob("shard-*.bin"))
    assert b"".join(f.read_bytes() for f in files) == want and len(files) == index.count() > 2
    got = T.read_files(index, folder, 10, 20).orderBy("slot").collect()
    assert [r["slot"] for r in got] == list(range(10, 30)) and b"".join(r["tokens"] for r in got) == want[10 * 128 : 30 * 128]
    # A job that is run again keeps whole files and makes the others anew.
    files[0].write_bytes(b"cut")
    kept = files[1].stat().st_mtime_ns
    T.write_shards(shards, folder)
    assert b"".join(f.read_bytes() for f in files) == want and files[1].stat().st_mtime_ns == kept


def test_files_of_other_bytes_are_written_again(spark, odd_docs, no_docs, tmp_path):
    import pathlib

    shards = T.token_shards(odd_docs, PATH, P.PATTERN, length=16, shard=64)
    folder = f"file://{tmp_path}/s"
    index = T.write_shards(shards, folder)
    file = pathlib.Path(tmp_path, "s", index.first()["file"])
    whole = file.read_bytes()
    file.write_bytes(bytes(len(whole)))
    T.write_shards(shards, folder)
    assert file.read_bytes() == whole
    assert T.write_shards(T.token_shards(no_docs, PATH, P.PATTERN), f"file://{tmp_path}/n").count() == 0


def test_a_long_turn_takes_little_memory():
    """20 million characters, of controls and others, read back within 1 GB."""
    import subprocess
    import sys

    code = """
import resource, sys
sys.path.insert(0, sys.argv[1])
from strikeflow.llm.chat_format import parse, render
for text in ("ab <#" * 4_000_000, "### Assistant: </turn> " + chr(92) * 100_000 + "x" * 20_000_000, "<#" * 3_000_000):
    assert parse(render("user", text) + render("a:b", "")) == [("user", text), ("a:b", "")]
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    import pathlib

    root = str(pathlib.Path(__file__).parents[2])
    out = subprocess.run([sys.executable, "-c", code, root], capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr[-500:]
    assert int(out.stdout.split()[-1]) < 1000
