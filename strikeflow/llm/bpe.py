"""Byte-level BPE encoding and decoding.

Texts longer than `chunk_chars` are cut into overlapping chunks that are pre-tokenised in
parallel. Matching goes left to right and never looks back, so from any position where
two neighbouring chunks both have a pre-token boundary they agree for good: there the
chunks are stitched, and the stitched segments are encoded. Decoding joins the raw bytes
of the ids.

Inside a task pre-tokenising is vectorised over many texts, and each distinct pre-token of
a piece of the batch is merged once.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strikeflow.llm.textcore import buffers, pieces, run_hashes

CHUNK_CHARS = 1 << 15
OVERLAP_CHARS = 512
KNOWN_MAX = 100_000
PIECE = 4 << 20
OTHER, LETTER, NUMBER, SPACE = range(4)


@functools.cache
def _classes() -> np.ndarray:
    """Letter, number, white space or other, for each code point."""
    import regex

    out = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            a, b = (x + 0x800 * (x >= 0xD800) for x in (m.start(), m.end() - 1))
            out[a : b + 1] = kind
    out[0xD800:0xE000] = OTHER
    return out


def boundaries(codes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens in an array of code points, as public_tokenizers.PATTERN
    matches them; `rows` are the starts of the texts and the end of the last."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    kind = _classes()[codes]
    cut = np.zeros(n + 1, bool)
    cut[rows] = True
    run = cut[:n].copy()
    run[1:] |= kind[1:] != kind[:-1]
    start = run.copy()
    # The last of the white space before a word: a blank goes with the word, any other stands alone.
    word = np.flatnonzero(run & (kind != SPACE) & ~cut[:n])
    word = word[kind[word - 1] == SPACE]
    start[word - 1] = True
    start[word[codes[word - 1] == 32]] = False
    # 's 't 're 've 'm 'll 'd, where an apostrophe alone starts a match
    tick = np.flatnonzero(start[: n - 1] & (codes[: n - 1] == 39))
    tick = tick[~cut[tick + 1]]
    one = codes[tick + 1]
    two = np.where((tick + 2 < n) & ~cut[np.minimum(tick + 2, n)], codes[np.minimum(tick + 2, n - 1)], 0)
    size = np.where(np.isin(one, [ord(c) for c in "stmd"]), 2, 0)
    size = np.where(((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")), 3, size)
    tick, size = tick[size > 0], size[size > 0]
    start[tick + 1] = False
    start[(tick + size)[tick + size < n]] = True
    return np.flatnonzero(start)


class Ranks:
    """The vocabulary of a rank file."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            self.ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.merge = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=self.ids, special_tokens={}).encode_ordinary
        size = max(self.ids.values()) + 1
        parts = [b""] * size
        for token, i in self.ids.items():
            parts[i] = token
        self.size = np.array([len(p) for p in parts])
        self.first = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(parts), np.uint8)
        self.known: dict[bytes, bytes] = {}

    def of(self, piece: bytes) -> bytes:
        """Ids of one pre-token, little-endian unsigned 32-bit."""
        out = self.known.get(piece)
        if out is None:
            if len(self.known) >= KNOWN_MAX:
                self.known.clear()
            i = self.ids.get(piece)
            out = self.known[piece] = array("I", self.merge(piece.decode()) if i is None else [i]).tobytes()
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the row bounds."""
        data, offs = buffers(texts)
        raw = data.tobytes()
        codes = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        at = boundaries(codes, np.searchsorted(lead, offs))
        starts = lead[at]
        ends = np.append(starts[1:], len(data))
        _, first, back = np.unique(run_hashes(data, starts, ends), return_index=True, return_inverse=True)
        # Distinct pre-tokens of a blank and letters, end to end, still split in the same places: one call merges all.
        nth = at[first]
        words = (codes[nth] == 32) & (_classes()[codes[np.minimum(nth + 1, len(codes) - 1)]] == LETTER) if len(at) else np.zeros(0, bool)
        size = np.zeros(len(first), np.int64)
        a, n = starts[first[words]], (ends - starts)[first[words]]
        joined = data[np.arange(n.sum()) + np.repeat(a - (np.cumsum(n) - n), n)].tobytes().decode()
        merged = np.array(self.merge(joined), "<u4")
        size[words] = np.diff(np.searchsorted(np.cumsum(self.size[merged]), np.cumsum(n)) + 1, prepend=0)
        rest = [self.of(raw[i:j]) for i, j in zip(starts[first[~words]].tolist(), ends[first[~words]].tolist(), strict=True)]
        size[~words] = [len(c) // 4 for c in rest]
        pool = np.concatenate([merged, np.frombuffer(b"".join(rest), "<u4")])
        base = np.zeros(len(first), np.int64)
        base[words] = np.cumsum(size[words]) - size[words]
        base[~words] = len(merged) + np.cumsum(size[~words]) - size[~words]
        counts = size[back]
        total = np.concatenate([[0], np.cumsum(counts)])
        ids = pool[np.arange(total[-1]) + np.repeat(base[back] - total[:-1], counts)]
        return ids, total[np.searchsorted(starts, offs)]

    def decode(self, ids: np.ndarray) -> bytes:
        size = self.size[ids]
        where = np.arange(size.sum()) + np.repeat(self.first[ids] - (np.cumsum(size) - size), size)
        return self.bytes[where].tobytes()


@functools.cache
def ranks(path: str, pattern: str) -> Ranks:
    return Ranks(path, pattern)


def _whole(path: str, pattern: str):
    """Texts of one chunk: encode, decode, digest."""

    def run(batches):
        r = ranks(path, pattern)
        for piece in pieces(batches, limit=PIECE):
            ids, at = r.encode(piece.column("text"))
            made = r.decode(ids)
            ends = np.concatenate([[0], np.cumsum(r.size[ids])])[at]
            coded = ids.astype("<u4").tobytes()
            digest = lambda x, a: [hashlib.sha256(x[i:j]).hexdigest() for i, j in zip(a[:-1].tolist(), a[1:].tolist(), strict=True)]
            yield pa.record_batch([piece.column("doc_id"), pa.array(np.diff(at)), pa.array(digest(memoryview(coded), at * 4)), pa.array(digest(memoryview(made), ends))], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _chunks(chunk: int, overlap: int):
    """Long texts as overlapping chunks."""

    def run(batches):
        for batch in batches:
            for doc_id, row, text in zip(batch.column("doc_id").to_pylist(), batch.column("row").to_pylist(), batch.column("text"), strict=True):
                text = text.as_py()
                for k in range(0, len(text), chunk):
                    yield pa.record_batch([pa.array([row], pa.int64()), pa.array([doc_id], pa.int64()), pa.array([k // chunk], pa.int64()), pa.array([text[k : k + chunk + overlap]], pa.string())], names=["row", "doc_id", "chunk", "text"])

    return run


def _marks(chunk: int):
    """Pre-tokenises chunks; of the boundaries only those in the overlaps are needed: `head` with
    the previous chunk, `tail` with the next one. A boundary at the very end of a chunk may
    be an effect of the cut and is left out."""

    def run(batches):
        for batch in batches:
            heads, tails = [], []
            for text, k in zip(batch.column("text").to_pylist(), batch.column("chunk").to_pylist(), strict=True):
                codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
                at = boundaries(codes, np.array([0, len(codes)]))
                at = at[at < len(codes) - 1]
                base = k * chunk
                heads.append((base + at[(at > 0) & (at < OVERLAP_CHARS)]).tolist() if k else [])
                tails.append((base + at[at >= chunk]).tolist())
            kind = pa.list_(pa.int64())
            yield pa.record_batch([*(batch.column(c) for c in ("row", "doc_id", "chunk", "text")), pa.array(heads, kind), pa.array(tails, kind)], names=["row", "doc_id", "chunk", "text", "head", "tail"])

    return run


def segments(chunks: DataFrame, chunk: int = CHUNK_CHARS) -> DataFrame:
    """(row, doc_id, segment, text): chunks with `head` and `tail` boundaries, stitched where
    both of two neighbours have a boundary. Neighbours without a common one (a
    pre-token longer than the overlap) stay together in one segment."""
    order = Window.partitionBy("row").orderBy("chunk")
    c = chunks.withColumn("stop", F.array_min(F.array_intersect("tail", F.lead("head").over(order))))
    c = c.withColumn("go", F.lag("stop").over(order)).withColumn("last", F.lead("chunk").over(order).isNull())
    c = c.withColumn("segment", F.sum(F.when(F.col("go").isNotNull(), 1).otherwise(0)).over(order))
    own = F.struct("chunk", F.when(F.col("last") | F.col("stop").isNotNull(), F.col("text")).otherwise(F.substring("text", 1, chunk)).alias("text"))
    g = c.groupBy("row", "segment").agg(F.min("doc_id").alias("doc_id"), F.min("chunk").alias("chunk"), F.min("go").alias("go"), F.max("stop").alias("stop"), F.array_sort(F.collect_list(own)).alias("own"))
    text = F.concat_ws("", F.col("own.text"))
    begin = F.coalesce(F.col("go") - F.col("chunk") * chunk, F.lit(0))
    size = F.when(F.col("stop").isNotNull(), F.col("stop") - F.col("chunk") * chunk - begin).otherwise(F.length(text))
    return g.select("row", "doc_id", "segment", F.substring(text, begin.cast("int") + 1, size.cast("int")).alias("text"))


def _coded(path: str, pattern: str):
    def run(batches):
        r = ranks(path, pattern)
        for piece in pieces(batches, limit=PIECE):
            ids, at = r.encode(piece.column("text"))
            rows = [ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.record_batch([piece.column("row"), piece.column("doc_id"), piece.column("segment"), pa.array([x.astype("<u4").tobytes() for x in rows], pa.binary()), pa.array([r.decode(x) for x in rows], pa.binary())], names=["row", "doc_id", "segment", "ids", "decoded"])

    return run


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of sorted segments, as they stream by."""
    now = None
    done = lambda x: pa.record_batch([pa.array([x[1]], pa.int64()), pa.array([x[2]], pa.int64()), pa.array([x[3].hexdigest()]), pa.array([x[4].hexdigest()])], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    for b in batches:
        for row, doc_id, ids, decoded in zip(*(b.column(c) for c in ("row", "doc_id", "ids", "decoded")), strict=True):
            row, ids = row.as_py(), ids.as_py()
            if now is None or now[0] != row:
                if now:
                    yield done(now)
                now = [row, doc_id.as_py(), 0, hashlib.sha256(), hashlib.sha256()]
            now[2] += len(ids) // 4
            now[3].update(ids)
            now[4].update(decoded.as_py())
    if now:
        yield done(now)


def bpe_round_trip(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK_CHARS) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for each row of `docs`.

    ids_sha256 is the lowercase hex digest of the ids as little-endian unsigned 32-bit
    integers, decoded_sha256 that of the decoded bytes. A null text is read as empty: no
    tokens, digests of nothing. Repeated rows give a row each, null doc_ids stay null, other
    columns are ignored, an empty table gives no rows. `path` is a rank file, readable on
    the executors.
    """
    out = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    short = docs.where(F.length("text") <= chunk).mapInArrow(_whole(path, pattern), out)
    return short.unionAll(_long_coded(docs, path, pattern, chunk).repartition("row").sortWithinPartitions("row", "segment").mapInArrow(_digests, out))


def _long_coded(docs: DataFrame, path: str, pattern: str, chunk: int) -> DataFrame:
    """(row, doc_id, segment, ids, decoded) of the texts of more than one chunk."""
    rows = docs.withColumn("row", F.monotonically_increasing_id()).where(F.length("text") > chunk)
    parts = rows.mapInArrow(_chunks(chunk, OVERLAP_CHARS), "row long, doc_id long, chunk long, text string").repartition("row", "chunk")
    marked = parts.mapInArrow(_marks(chunk), "row long, doc_id long, chunk long, text string, head array<long>, tail array<long>")
    return segments(marked, chunk).mapInArrow(_coded(path, pattern), "row long, doc_id long, segment long, ids binary, decoded binary")


def encode(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK_CHARS) -> DataFrame:
    """(row, doc_id, segment, ids binary, decoded binary): the ids themselves. Texts of one
    chunk are segment 0; longer ones have their segments in order. Nulls are empty texts."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    short = docs.withColumn("row", F.monotonically_increasing_id()).where(F.length("text") <= chunk).select("row", "doc_id", F.lit(0).cast("long").alias("segment"), "text")
    return short.mapInArrow(_coded(path, pattern), "row long, doc_id long, segment long, ids binary, decoded binary").unionAll(_long_coded(docs, path, pattern, chunk))
