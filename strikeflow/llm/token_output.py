"""Training-order materialisation of token ids.

Every document is tokenised and cut into sequences; a keyed Feistel permutation gives each
of the N sequences a slot in 0..N-1 (values outside are walked on along their cycle), so that the order is random, needs no global
shuffle file and can be computed for any sequence or inverted for any slot. Range partitions
of the slots are packed into shards of fixed stride: sequence s of a shard starts at byte
s * stride, so that a reader finds any slot by arithmetic and resumes anywhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from strikeflow.llm.bpe import PIECE, ranks
from strikeflow.llm.textcore import U64, mix, pieces, release, stored

SEQUENCE = 512
SHARD = 1024
ROUNDS = 6


def _network(x: np.ndarray, key: int, half: int, inverse: bool) -> np.ndarray:
    mask = (U64(1) << U64(half)) - U64(1)
    left, right = x >> U64(half), x & mask
    for r in reversed(range(ROUNDS)) if inverse else range(ROUNDS):
        salt = mix(np.array([key % (1 << 64) + r * 0x9E3779B97F4A7C15 & (1 << 64) - 1], U64))[0]
        if inverse:
            left, right = right ^ (mix(left ^ salt) & mask), left
        else:
            left, right = right, left ^ (mix(right ^ salt) & mask)
    return left << U64(half) | right


def permute(index: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """A keyed permutation of 0..n-1, applied to the given numbers."""
    half = max(1, (int(n - 1).bit_length() + 1) // 2)
    x = _network(np.asarray(index).astype(U64), key, half, inverse)
    while (far := x >= U64(n)).any():
        x[far] = _network(x[far], key, half, inverse)
    return x.astype(np.int64)


def _sequences(path: str, pattern: str, length: int, end: int):
    """Sequences of each text, numbered within the task."""

    def run(batches):
        task, at_row = TaskContext.get().partitionId(), 0
        r = ranks(path, pattern)
        if max(len(r.size) - 1, end) > 0xFFFF:
            raise ValueError("ids of this rank file do not fit in 16 bits")
        for piece in pieces(batches, limit=PIECE):
            ids, at = r.encode(piece.column("text"))
            # One end token after each text
            ids = np.insert(ids, at[1:], end).astype("<u2")
            at = at + np.arange(len(at))
            count = -(-np.diff(at) // length)
            row = np.repeat(np.arange(len(count)), count)
            part = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            a = at[:-1][row] + part * length
            b = np.minimum(a + length, at[1:][row])
            raw = ids.tobytes()
            n = len(row)
            yield pa.record_batch(
                [pa.array(np.full(n, task, np.int32)), pa.array(np.arange(at_row, at_row + n)), piece.column("doc_id").take(pa.array(row)), pa.array(part.astype(np.int32)), pa.array((b - a).astype(np.int32)), pa.array([raw[2 * x : 2 * y] for x, y in zip(a.tolist(), b.tolist(), strict=True)], pa.binary())],
                names=["task", "nth", "doc_id", "part", "n_tokens", "tokens"],
            )
            at_row += n

    return run


_SHARDS = "shard long, first_slot long, n_sequences int, stride int, doc_ids array<long>, parts array<int>, n_tokens array<int>, payload binary, sha256 string"


def _pack(length: int, end: int):
    pad = np.full(length, end, "<u2").tobytes()

    def done(shard, rows):
        payload = b"".join(t + pad[len(t) :] for _, _, _, _, t in rows)
        cols = ([shard], [rows[0][0]], [len(rows)], [2 * length], [[r[1] for r in rows]], [[r[2] for r in rows]], [[r[3] for r in rows]], [payload], [hashlib.sha256(payload).hexdigest()])
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.string())
        names = ("shard", "first_slot", "n_sequences", "stride", "doc_ids", "parts", "n_tokens", "payload", "sha256")
        return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=list(names))

    def run(batches: Iterator[pa.RecordBatch]):
        now, held = None, []
        for b in batches:
            for shard, *r in zip(*(b.column(c).to_pylist() for c in ("shard", "slot", "doc_id", "part", "n_tokens", "tokens")), strict=True):
                if shard != now and held:
                    yield done(now, held)
                    held = []
                now = shard
                held.append(r)
        if held:
            yield done(now, held)

    return run


def tokenised(docs: DataFrame, path: str, pattern: str, length: int = SEQUENCE, end: int = 50256) -> DataFrame:
    """The sequences of all documents, written once: (task, nth) numbers them without gaps in a task, and tasks in the order of
    doc_id (null first), then of the text's hash. So the numbers in a row do not hang on how the input is split."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # The last key only spreads rows that are alike.
    order = ("doc_id", F.xxhash64("text"), F.monotonically_increasing_id())
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.repartitionByRange(parts, *order).sortWithinPartitions("doc_id", F.xxhash64("text")).select("doc_id", "text")
    out = stored(docs.mapInArrow(_sequences(path, pattern, length, end), "task int, nth long, doc_id long, part int, n_tokens int, tokens binary"), "sequences")
    release(docs.sparkSession)
    return out


def slotted(sequences: DataFrame, key: int) -> DataFrame:
    """`sequences` with its `slot`, a permutation of 0..N-1."""
    # One row for each task that wrote sequences.
    sizes = {r["task"]: r["n"] for r in sequences.groupBy("task").agg(F.count("*").alias("n")).toLocalIterator()}
    tasks = sorted(sizes)
    first = np.concatenate([[0], np.cumsum([sizes[t] for t in tasks])]).astype(np.int64)
    total = int(first[-1])

    @F.pandas_udf("long")
    def slot(task: pd.Series, nth: pd.Series) -> pd.Series:
        return pd.Series(permute(first[np.searchsorted(tasks, task.to_numpy())] + nth.to_numpy(), total, key))

    return sequences.withColumn("slot", slot("task", "nth"))


def token_shards(docs: DataFrame, path: str, pattern: str, key: int = 1, length: int = SEQUENCE, shard: int = SHARD, end: int = 50256) -> DataFrame:
    """(shard, first_slot, n_sequences, stride, doc_ids, parts, n_tokens, payload, sha256).

    Texts are encoded by the rank file and closed by the id `end`; sequence p of a document holds its
    tokens from p * length on. The payload holds the sequences of `shard` consecutive slots as
    little-endian unsigned 16-bit ids, each padded to `length` with `end`; doc_ids, parts and n_tokens
    tell for each slot what it holds. Null and empty texts are one sequence of
    the end token; null doc_ids stay null, repeated rows are sequences of their own, other columns
    are ignored, an empty table gives no shards. The order depends on the key, the ids and the texts alone, so that a job that
    is run again on another cluster resumes the same one. See write_shards() for files.
    """
    spark = docs.sparkSession
    s = slotted(tokenised(docs, path, pattern, length, end), key).withColumn("shard", F.floor(F.col("slot") / shard).cast("long"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = s.select("shard", "slot", "doc_id", "part", "n_tokens", "tokens").repartitionByRange(parts, "shard").sortWithinPartitions("shard", "slot")
    return ordered.mapInArrow(_pack(length, end), _SHARDS)


def _digest(store, path: str) -> str | None:
    """Of a file's bytes, if it is there."""
    from pyarrow import fs

    if store.get_file_info(path).type != fs.FileType.File:
        return None
    out = hashlib.sha256()
    with store.open_input_stream(path) as f:
        while chunk := f.read(1 << 20):
            out.update(chunk)
    return out.hexdigest()


def _written(folder: str):
    from pyarrow import fs

    def run(batches):
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for b in batches:
            names = []
            for shard, payload, digest in zip(b.column("shard").to_pylist(), b.column("payload"), b.column("sha256").to_pylist(), strict=True):
                name = f"shard-{shard:010d}.bin"
                if _digest(store, f"{root}/{name}") != digest:
                    # Under its own name only when it is whole; an attempt that is run again writes the same bytes.
                    part = f"{root}/_{name}-{TaskContext.get().taskAttemptId()}"
                    with store.open_output_stream(part) as out:
                        out.write(payload.as_buffer())
                    store.move(part, f"{root}/{name}")
                names.append(name)
            yield pa.record_batch([*(b.column(c) for c in b.schema.names if c != "payload"), pa.array(names)], names=[*(c for c in b.schema.names if c != "payload"), "file"])

    return run


def write_shards(shards: DataFrame, folder: str) -> DataFrame:
    """Writes each shard of token_shards() as a file of n_sequences * stride bytes in `folder` - a URI that driver and
    executors share - and returns the index: the shards without payloads, with the name of their `file`. Files that
    are there with the same bytes are kept, so that a job that stopped goes on where it was; any others of these names are replaced. An empty table
    writes an empty index and no files."""
    schema = StructType([*(f for f in shards.schema.fields if f.name != "payload")]).add("file", StringType())
    index = shards.mapInArrow(_written(folder), schema)
    at = f"{folder.rstrip('/')}/_index"
    index.write.mode("overwrite").parquet(at)
    return shards.sparkSession.read.schema(schema).parquet(at)


def _read_ranges(folder: str, first: int, count: int):
    from pyarrow import fs

    def run(batches):
        store, root = fs.FileSystem.from_uri(folder)
        for b in batches:
            for name, at, n, stride in zip(*(b.column(c).to_pylist() for c in ("file", "first_slot", "n_sequences", "stride")), strict=True):
                a, z = max(first, at), min(first + count, at + n)
                with store.open_input_file(f"{root}/{name}") as f:
                    f.seek((a - at) * stride)
                    raw = f.read((z - a) * stride)
                yield pa.record_batch([pa.array(range(a, z), pa.int64()), pa.array([raw[k * stride : (k + 1) * stride] for k in range(z - a)], pa.binary())], names=["slot", "tokens"])

    return run


def read_files(index: DataFrame, folder: str, first: int, count: int) -> DataFrame:
    """(slot, tokens): `count` slots from `first` on, padded as stored. Of each file that has some only
    one range of bytes is read."""
    inside = index.where((F.col("first_slot") < first + count) & (F.col("first_slot") + F.col("n_sequences") > first))
    return inside.select("file", "first_slot", "n_sequences", "stride").mapInArrow(_read_ranges(folder, first, count), "slot long, tokens binary")


def read_slots(shards: DataFrame, first: int, count: int, shard: int = SHARD) -> DataFrame:
    """(slot, doc_id, part, tokens): `count` slots from `first` on, from the rows of token_shards(); payloads of shards that hold
    none of them are not read. See read_files() for files."""
    inside = shards.where(F.col("shard").between(first // shard, (first + count - 1) // shard))
    each = inside.select("first_slot", "stride", "payload", F.posexplode(F.arrays_zip("doc_ids", "parts", "n_tokens")).alias("k", "what"))
    slot = F.col("first_slot") + F.col("k")
    return each.where((slot >= first) & (slot < first + count)).select(slot.alias("slot"), F.col("what.doc_ids").alias("doc_id"), F.col("what.parts").alias("part"), F.substring("payload", F.col("k") * F.col("stride") + 1, F.col("what.n_tokens") * 2).alias("tokens"))
