"""BPE with word ends: encoding by a lexicon of frequent words, and decoding.

All words of the corpus are counted; the frequent ones are compiled into a minimal acyclic
transducer: an automaton over bytes whose common suffixes are shared and whose edges carry
numbers that add up to a word's place in a table of ids. It is written as one file, which
Spark ships to the executors, where every worker maps the same pages. Words that it lacks are merged exactly,
so the lexicon's size changes the speed and never the ids.

Inside a task pre-tokenising and the walk through the transducer are vectorised over the
distinct words of many texts.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strikeflow.llm.textcore import buffers, pieces, run_hashes, shared_dir, stored

#: Most words of a lexicon, and their longest length in bytes.
LEXICON, LONGEST = 1 << 16, 48
#: Classes of counts, for a threshold that keeps at most LEXICON words: so many to a doubling.
CLASSES = 8
#: Characters of a slice of a text; the distinct words that a task counts, or the merges that it keeps, before it lets them go.
SLICE, KNOWN_MAX = 1 << 20, 100_000
PIECE = 4 << 20
OTHER, LETTER, NUMBER, SPACE = range(4)

#: Where Python's own tables give what the tokenizer's normaliser gives; other texts go through that.
_OWN = re.compile("[^\u0000-\u1c7f\u2000-\u206f\u20a0-\u20bf\u3000-\u30ff\u4e00-\u9fff]")
_BLANK = re.compile("[ \t\r\n]")


# The transducer


def transducer(words: list[bytes]) -> dict[str, np.ndarray]:
    """The minimal acyclic automaton of sorted, distinct words: `keys` (state * 256 + byte, ascending), `targets` and `outputs` of its
    edges, and `final` of its states; 0 is the start. The outputs along a word's path add up to its place in `words`."""
    edges: list[dict[int, int]] = [{}]
    final = [False]
    register: dict[tuple, int] = {}
    path = [0]  # states along the last word
    last = b""

    def settle(depth: int) -> None:
        """Replaces the states of the last word below `depth` by equal ones that are there."""
        for k in range(len(last), depth, -1):
            state = path.pop()
            same = register.setdefault((final[state], *edges[state].items()), state)
            edges[path[-1]][last[k - 1]] = same

    for word in words:
        common = next((i for i, (a, b) in enumerate(zip(last, word, strict=False)) if a != b), min(len(last), len(word)))
        settle(common)
        for b in word[common:]:
            edges.append({})
            final.append(False)
            edges[path[-1]][b] = len(edges) - 1
            path.append(len(edges) - 1)
        final[path[-1]] = True
        last = word
    settle(0)
    # Only states that can still be reached, numbered anew, and the words below each
    place, order, below = {0: 0}, [0], {}
    for s in order:
        for t in edges[s].values():
            if t not in place:
                place[t] = len(order)
                order.append(t)
    stack = [(0, False)]
    while stack:
        s, seen = stack.pop()
        if seen:
            below[s] = final[s] + sum(below[t] for t in edges[s].values())
        elif s not in below:
            stack.append((s, True))
            stack += [(t, False) for t in edges[s].values() if t not in below]
    keys, targets, outputs = [], [], []
    for s in order:
        before = int(final[s])
        for b, t in sorted(edges[s].items()):
            keys.append(place[s] << 8 | b)
            targets.append(place[t])
            outputs.append(before)
            before += below[t]
    return {"keys": np.array(keys, np.int64), "targets": np.array(targets, np.int32), "outputs": np.array(outputs, np.int32), "final": np.array([final[s] for s in order], bool)}


def look_up(lexicon: dict[str, np.ndarray], data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The place of each word of `data` in the lexicon, or -1."""
    state, out = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    keys = lexicon["keys"]
    live = np.flatnonzero(ends - starts <= LONGEST) if len(keys) else np.zeros(0, np.int64)
    done = np.zeros(len(starts), bool)
    k = 0
    while len(live):
        over = starts[live] + k == ends[live]
        done[live[over]] = True
        live = live[~over]
        key = state[live] << 8 | data[starts[live] + k]
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        here = keys[at] == key
        live, at = live[here], at[here]
        out[live] += lexicon["outputs"][at]
        state[live] = lexicon["targets"][at]
        k += 1
    done &= lexicon["final"][state]
    return np.where(done, out, -1)


def pack(arrays: dict[str, np.ndarray]) -> bytes:
    """Arrays as the bytes of one file: a line that says where they are, then the arrays, aligned."""
    head, body = {}, b""
    for name, a in arrays.items():
        body += bytes(-len(body) % 64)
        head[name] = (str(a.dtype), len(a), len(body))
        body += a.tobytes()
    line = json.dumps(head).encode()
    return line + bytes(b" ") * (-(len(line) + 1) % 64) + b"\n" + body


@functools.cache
def mapped(name: str) -> dict[str, np.ndarray]:
    """The arrays of a packed file that Spark shipped, as views of its pages."""
    path = SparkFiles.get(name)
    with open(path, "rb") as f:
        line = f.readline()
    if not len(line):
        raise ValueError(f"{name} is empty")
    whole = np.memmap(path, np.uint8, "r")
    out = {}
    for key, (kind, n, at) in json.loads(line).items():
        kind = np.dtype(kind)
        out[key] = whole[len(line) + at : len(line) + at + n * kind.itemsize].view(kind)
    return out


def _shipped(spark: SparkSession, blob: bytes) -> str:
    """Writes the file in the shared folder and has Spark bring it to every executor, those that come later included; its name there."""
    path = shared_dir(spark, "lexicon")
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at)
    for k in range(0, len(blob), 1 << 20):
        out.write(bytearray(blob[k : k + (1 << 20)]))
    out.close()
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[1]


# The tokenizer


class Words:
    """A tokenizer file of word-end BPE: its pre-tokens, merges and tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.find_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        vocab = self.tokenizer.get_vocab(True)
        parts = [b" "] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            parts[i] = b" " + token.encode()
        #: Every token with the blank before it
        self.size = np.array([len(p) for p in parts])
        self.first = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(parts), np.uint8)
        self.known: dict[bytes, list[int]] = {}

    @functools.cached_property
    def alphabet(self) -> dict[int, str]:
        """The characters that stand for bytes: printable ones for themselves, the others from 256 on in order."""
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in printable]
        return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(rest)}

    def classes(self) -> np.ndarray:
        """Letter, number, white space or other, for each code point, as the tokenizer's own expressions have it."""
        from tokenizers import Regex, pre_tokenizers

        out = np.zeros(0x110000, np.uint8)
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
            for _, (start, end) in pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(every):
                a, b = (x + 0x800 * (x >= 0xD800) for x in (start, end - 1))
                out[a : b + 1] = kind
        out[0xD800:0xE000] = OTHER
        return out

    def normal(self, text: str) -> str:
        """Composed and in lower case; white space is left, as it only parts words."""
        if text.isascii():
            return text.lower()
        if _OWN.search(text) is None:
            # Python alone looks at a sigma's neighbours
            return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return self.tokenizer.normalizer.normalize_str(text)

    def segments(self, text: str) -> Iterator[str | int]:
        """A text's stretches between special tokens, and these as ids; long stretches are cut at blanks, where nothing merges."""
        at = 0
        for m in [*self.find_special.finditer(text), None]:
            end = m.start() if m else len(text)
            while end - at > SLICE and (cut := _BLANK.search(text, at + SLICE, end)):
                yield self.normal(text[at : cut.start()])
                at = cut.start()
            yield self.normal(text[at:end])
            if m:
                yield self.special[m[0]]
                at = m.end()

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word by the merges themselves."""
        out = self.known.get(word)
        if out is None:
            if len(self.known) >= KNOWN_MAX:
                self.known.clear()
            out = self.known[word] = [t.id for t in self.tokenizer.model.tokenize("".join(map(self.alphabet.__getitem__, word)))]
        return out

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the tokens, each with a blank before it."""
        size = self.size[ids]
        return self.bytes[np.arange(size.sum()) + np.repeat(self.first[ids] - (np.cumsum(size) - size), size)]


@functools.cache
def tokenizer(path: str) -> Words:
    return Words(path)


def pretokens(codes: np.ndarray, rows: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in an array of code points: letters, single numbers, or other characters together, and an
    apostrophe that begins one of the seven endings with it. `rows` are the starts of the texts and the end of the last."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = classes[codes]
    cut = np.zeros(n + 3, bool)
    cut[rows] = True
    start = cut[:n] | (kind == NUMBER)
    start[1:] |= kind[1:] != kind[:-1]
    tick = np.flatnonzero(start[: n - 1] & (codes[: n - 1] == 39))
    tick = tick[~cut[tick + 1]]
    one = codes[tick + 1]
    two = np.where(cut[tick + 2], 0, codes[np.minimum(tick + 2, n - 1)])
    # The endings 's 't 're 've 'm 'll 'd
    size = np.where(np.isin(one, [ord(c) for c in "stmd"]), 2, 0)
    for a, b in ("re", "ve", "ll"):
        size = np.where((one == ord(a)) & (two == ord(b)), 3, size)
    tick, size = tick[size > 0], size[size > 0]
    start[tick + 1] = False
    start[(tick + size)[tick + size < n]] = True
    starts = np.flatnonzero(start)
    ends = np.append(starts[1:], n)
    word = kind[starts] != SPACE
    return starts[word], ends[word]


def distinct_words(texts: list[str], classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts and ends of the distinct words, which of them each word is, bounds of the texts in words)."""
    data, offs = buffers(pa.array(texts, pa.large_string()))
    codes = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    lead = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    rows = np.searchsorted(lead, offs)
    a, b = pretokens(codes, rows, classes)
    bounds = np.searchsorted(a, rows)
    starts, ends = lead[a], lead[b]
    h = run_hashes(data, starts, ends)
    # Long words stand for themselves
    long = np.flatnonzero(ends - starts > 256)
    h[long] = np.arange(len(long), dtype=np.uint64)
    _, first, back = np.unique(h, return_index=True, return_inverse=True)
    return data, starts[first], ends[first], back, bounds


def encode_texts(words: Words, lexicon: dict[str, np.ndarray], texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all normal texts end to end, and the bounds of the texts."""
    data, starts, ends, back, bounds = distinct_words(texts, lexicon["classes"])
    place = look_up(lexicon, data, starts, ends)
    raw = data.tobytes()
    rest = np.flatnonzero(place < 0)
    merged = [words.merge(raw[i:j]) for i, j in zip(starts[rest].tolist(), ends[rest].tolist(), strict=True)]
    at, pool = lexicon["offsets"].astype(np.int64), lexicon["ids"]
    size, base = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    seen = place[place >= 0]
    size[place >= 0], base[place >= 0] = at[seen + 1] - at[seen], at[seen]
    size[rest] = [len(m) for m in merged]
    base[rest] = len(pool) + np.cumsum(size[rest]) - size[rest]
    pool = np.concatenate([pool, np.array([i for m in merged for i in m], np.int32)])
    counts = size[back]
    total = np.concatenate([[0], np.cumsum(counts)])
    return pool[np.arange(total[-1]) + np.repeat(base[back] - total[:-1], counts)], total[bounds]


# The jobs


def _counted(path: str, name: str):
    """Words of a task's texts with their counts; a word may come more than once."""

    def run(batches):
        words, classes, seen = tokenizer(path), mapped(name)["classes"], Counter()

        def given() -> pa.RecordBatch:
            out = pa.record_batch([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
            seen.clear()
            return out

        for piece in pieces(batches, limit=PIECE):
            for chunk in _chunks(words, piece.column("text")):
                data, starts, ends, back, _ = distinct_words([s for _, s in chunk if isinstance(s, str)], classes)
                n, raw = np.bincount(back, minlength=len(starts)), data.tobytes()
                some = ends - starts <= LONGEST
                for i, j, k in zip(starts[some].tolist(), ends[some].tolist(), n[some].tolist(), strict=True):
                    seen[raw[i:j]] += k
                if len(seen) >= KNOWN_MAX:
                    yield given()
        yield given()

    return run


def frequent_words(docs: DataFrame, path: str, name: str, most: int) -> list[bytes]:
    """The words of all texts that are counted most, sorted: the classes of counts from the top whose words are at most `most`
    together. What comes to the driver is bounded by `most` and LONGEST."""
    counts = stored(docs.mapInArrow(_counted(path, name), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    kind = F.floor(F.log2("n") * CLASSES).cast("int")
    rows = sorted((r["kind"], r["count"]) for r in counts.groupBy(kind.alias("kind")).count().toLocalIterator())
    least, total = None, 0
    for k, n in reversed(rows):
        total += n
        if total > most:
            break
        least = k
    if least is None:
        return []
    return sorted(bytes(r["word"]) for r in counts.where(kind >= least).select("word").toLocalIterator())


def build_lexicon(docs: DataFrame, path: str, most: int = LEXICON) -> str:
    """Counts the words of `docs` and ships the transducer of the frequent ones; the name of its file (see mapped())."""
    spark, words = docs.sparkSession, tokenizer(path)
    classes = {"classes": words.classes()}
    found = frequent_words(docs, path, _shipped(spark, pack(classes)), most)
    merged = [words.merge(w) for w in found]
    ids = {"offsets": np.concatenate([[0], np.cumsum([len(m) for m in merged])]).astype(np.int32), "ids": np.array([i for m in merged for i in m], np.int32)}
    return _shipped(spark, pack(classes | transducer(found) | ids))


def _chunks(words: Words, texts: pa.Array) -> Iterator[list[tuple[int, str | int]]]:
    """The segments of the texts with their rows, in lists of some SLICE characters."""
    chunk, size = [], 0
    for row, text in enumerate(texts):
        for s in words.segments(text.as_py() or ""):
            chunk.append((row, s))
            size += len(s) if isinstance(s, str) else 1
            if size >= SLICE:
                yield chunk
                chunk, size = [], 0
    if chunk:
        yield chunk


def _ids_of(words: Words, lexicon: dict[str, np.ndarray], texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, ids) of the segments of the texts, in order."""
    for chunk in _chunks(words, texts):
        ids, bounds = encode_texts(words, lexicon, [s if isinstance(s, str) else "" for _, s in chunk])
        for (row, s), a, b in zip(chunk, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            yield row, ids[a:b] if isinstance(s, str) else np.array([s], np.int32)


def _coded(path: str, name: str):
    def run(batches):
        words, lexicon = tokenizer(path), mapped(name)
        for piece in pieces(batches, limit=PIECE):
            parts: list[list[np.ndarray]] = [[] for _ in range(piece.num_rows)]
            for row, ids in _ids_of(words, lexicon, piece.column("text")):
                parts[row].append(ids)
            size = [sum(map(len, p)) for p in parts]
            flat = np.concatenate([np.zeros(0, np.int32), *(x for p in parts for x in p)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(flat))
            yield pa.record_batch([piece.column("doc_id"), lists], names=["doc_id", "ids"])

    return run


def _decoded(path: str):
    def run(batches):
        words = tokenizer(path)
        for b in batches:
            texts = [words.decode(np.array(ids.as_py() or [], np.int64)).tobytes()[1:].decode() for ids in b.column("ids")]
            yield pa.record_batch([b.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def _digests(path: str, name: str):
    """Encodes and decodes; digests grow by segments, so that ids of a long text are never all there."""

    def run(batches):
        words, lexicon = tokenizer(path), mapped(name)
        for piece in pieces(batches, limit=PIECE):
            rows = piece.num_rows
            n, coded, text = [0] * rows, [hashlib.sha256() for _ in range(rows)], [hashlib.sha256() for _ in range(rows)]
            for row, ids in _ids_of(words, lexicon, piece.column("text")):
                if len(ids):
                    coded[row].update(ids.astype("<u4").tobytes())
                    text[row].update(words.decode(ids)[0 if n[row] else 1 :].tobytes())
                    n[row] += len(ids)
            yield pa.record_batch([piece.column("doc_id"), pa.array(n, pa.int64()), pa.array([x.hexdigest() for x in coded]), pa.array([x.hexdigest() for x in text])], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def encode(docs: DataFrame, path: str, lexicon: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>): the ids of every text, as the tokenizers library gives them without special tokens of its
    own; those that a text spells out are one id each. `lexicon` is what build_lexicon() gave, else one is built of these texts."""
    docs = _texts(docs)
    return docs.mapInArrow(_coded(path, lexicon or build_lexicon(docs, path)), "doc_id long, ids array<int>")


def decode(coded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text): the tokens of `ids` with a blank between two, as the library decodes without a decoder of the file's own."""
    return coded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(_decoded(path), "doc_id long, text string")


def word_bpe_round_trip(docs: DataFrame, path: str, most: int = LEXICON) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for each row of `docs`.

    ids_sha256 is the lowercase hex digest of the ids as little-endian unsigned 32-bit integers, decoded_sha256 that of
    the decoded text. A null text is read as empty: no tokens, digests of nothing. Repeated rows give a row each, null
    doc_ids stay null, other columns are ignored, an empty table gives no rows. Words that are counted alike are in the lexicon together or
    not at all, which no result shows. A long text is taken in slices, cut at blanks. `path` is a tokenizer file,
    readable on the executors.
    """
    docs = _texts(docs)
    return docs.mapInArrow(_digests(path, build_lexicon(docs, path, most)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
