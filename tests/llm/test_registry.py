"""The registered queries over a small table, against plain versions of their contracts."""

import hashlib
import re
import zlib
from collections import Counter

import pytest

from strikeflow.llm import registry as R

SF = "/root/testdata/sf0.001"
FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def run(spark, name):
    return [r.asDict() for r in R.QUERIES[name](spark, SF).collect()]


def crc(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def test_op1(spark, documents):
    got = run(spark, "op1_token_output")
    assert {d for r in got for d in r["doc_ids"]} == set(documents)
    assert all(len(r["payload"]) == r["n_sequences"] * r["stride"] and hashlib.sha256(r["payload"]).hexdigest() == r["sha256"] for r in got)


def test_op2(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    trap = "\\### Assistant: </turn> ok"
    talks = {-7: [("user", trap), ("assistant", trap)]}
    for r in sorted(rows, key=lambda r: (r["conv_id"], r["turn"])):
        talks.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = {}
    for k, turns in talks.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        want[k] = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss))
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in run(spark, "op2_chat_format")}
    assert got == want


def test_op3(spark, documents):
    sets = {}
    for k, r in documents.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (r["text"] or "").translate(FOLD))
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {k: k for k in sets}
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in run(spark, "op3_ngram_jaccard_join")}
    assert got == {k: (len(s), root[k]) for k, s in sets.items()}


def test_op4(spark, documents):
    got = {r["doc_id"]: r for r in run(spark, "op4_quality_classifier")}
    assert set(got) == set(documents)
    for k, r in got.items():
        assert r["held_out"] == (crc(k, 5) == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r["doc_id"] in got}
    held = [(got[k]["predicted"], q) for k, q in labels.items() if got[k]["held_out"]]
    assert held and sum(p == q for p, q in held) >= 0.85 * len(held)


def test_op5(spark):
    import numpy as np

    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    x = np.array([r["embedding"] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = ((x @ x.T >= 0.9) & ~np.eye(len(x), dtype=bool)).sum(1)
    got = {r["vec_id"]: r["n_links"] for r in run(spark, "op5_embedding_dedup")}
    assert set(got) == {r["vec_id"] for r in rows}
    assert sum(got.values()) >= 0.97 * links.sum() and all(got[r["vec_id"]] <= n for r, n in zip(rows, links, strict=True))


def test_op6(spark, documents):
    import public_tokenizers as P
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_tiktoken_bpe(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    for r in run(spark, "op6_byte_bpe"):
        text = documents[r["doc_id"]]["text"] or ""
        ids = own.encode_ordinary(text)
        assert r["n_tokens"] == len(ids) and r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert r["ids_sha256"] == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()


def test_op7(spark, documents):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(FOLD))
    items = {r["item_id"]: " " + " ".join(words(r["text"])) + " " for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    copies = {(k, i) for k, r in documents.items() for i, t in items.items() if t.strip() and t in " " + " ".join(words(r["text"])) + " "}
    got = {(r["doc_id"], r["item_id"]) for r in run(spark, "op7_decontamination")}
    assert copies and copies <= got


def test_op8(spark, documents):
    raw = {k: (r["text"] or "").encode() for k, r in documents.items()}
    count = {size: Counter(t[i : i + size] for t in raw.values() for i in range(len(t) - size + 1)) for size in (200, 400)}
    got = {r["doc_id"]: r for r in run(spark, "op8_suffix_dedup")}
    assert set(got) == set(raw)
    for k, t in raw.items():
        hit = {}
        for size in (200, 400):
            hit[size] = bytearray(len(t))
            for i in range(len(t) - size + 1):
                if count[size][t[i : i + size]] > 1:
                    hit[size][i : i + size] = b"\1" * size
        kept = bytes(b for b, h in zip(t, hit[400], strict=True) if not h)
        spans = sum(1 for i in range(len(t)) if hit[400][i] and not (i and hit[400][i - 1]))
        r = got[k]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], r["n_repeated"]) == (len(t), sum(hit[400]), spans, hashlib.sha256(kept).hexdigest(), sum(hit[200]))


def test_op9(spark, documents):
    phrases = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}
    for r in run(spark, "op9_license_scan"):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (documents[r["doc_id"]]["text"] or "").translate(FOLD))
        at = [(i, label) for p, label in phrases.items() for i in range(len(w)) if tuple(w[i : i + len(p)]) == p]
        places = [i for i, _ in at]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(at), min(places, default=None), max(places, default=None))
        base = sorted({label for _, label in at})
        assert r["base_labels"] == ",".join(base) and set(base) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1


def test_op10(spark, documents):
    got = run(spark, "op10_language_id")
    assert {r["doc_id"] for r in got} == set(documents)
    held = 0
    for r in got:
        d = documents[r["doc_id"]]
        assert r["held_out"] == (crc(r["doc_id"], 4) == 2)
        letters = any(c.isalpha() for c in d["text"] or "")
        assert letters or r["lang_pred"] == "und"
        held += r["held_out"] and letters and r["lang_pred"] != d["lang"]
    assert held <= 0.05 * sum(r["held_out"] for r in got)


def test_op11(spark, documents):
    from test_periodic import contract

    got = {r["doc_id"]: tuple(r.values()) for r in run(spark, "op11_periodic_runs")}
    assert set(got) == set(documents)
    # The plain search takes the square of a text's words.
    short = [k for k, r in documents.items() if len((r["text"] or "").split()) <= 1500]
    assert len(short) > 150 and all(got[k] == contract(k, documents[k]["text"]) for k in short)


def test_op12(spark, documents):
    import public_tokenizers
    from test_word_bpe import expected
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = sorted((tuple(r.values()) for r in run(spark, "op12_word_bpe")), key=str)
    assert got == expected(library, [(k, r["text"]) for k, r in documents.items()])


def test_op13(spark):
    """The rows that the SQL gives, and those of the plain version."""
    import duckdb
    from test_hard_negatives import plain

    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = duck.execute(R.ORACLES["op13_hard_negatives"])
    names = [c[0] for c in want.description]
    want = sorted(want.fetchall())
    got = R.QUERIES["op13_hard_negatives"](spark, SF)
    assert [t for _, t in got.select(names).dtypes] == ["bigint", "bigint", "int", "bigint", "bigint", "bigint"]
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    changed = [(r["vec_id"], r["embedding"], r["label"] if r["vec_id"] % 7 else (r["label"] + 1) % 10) for r in rows]
    assert sorted(tuple(r[c] for c in names) for r in got.collect()) == want == plain(changed)
