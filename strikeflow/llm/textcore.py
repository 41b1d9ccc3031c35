"""Vectorised primitives on Arrow string columns, used inside mapInArrow tasks.

Batches are cut into pieces of bounded bytes, so that the working arrays stay
small whatever the batch size is; one text is never cut here.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark import Broadcast
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

#: Bits of the filters of ids (8 MB), whatever the number of ids.
FILTER_BITS = 1 << 26
PIECE_BYTES = 1 << 20
PIECE_ROWS = 4096
U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15 | 1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words for [^\x20\x09-\x0D]+
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False

#: Bytes of words for [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ on lower-cased text
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def buffers(array: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; null reads as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = pc.fill_null(array, "")
    if len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type) else np.int32
    _, offs, data = array.buffers()
    offs = np.frombuffer(offs, kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = PIECE_BYTES, rows: int = PIECE_ROWS) -> Iterator[pa.RecordBatch]:
    """Slices of the batches of at most `rows` texts that hold up to `limit` bytes, or of one longer text."""
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < n:
            base = size[at - 1] if at else 0
            end = min(max(at + 1, int(np.searchsorted(size, base + limit, side="right"))), at + rows)
            yield batch.slice(at, end - at)
            at = end
        del batch, size
    give_back()


@functools.cache
def _trim():
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Returns memory that a task has freed to the system: workers serve many tasks of many steps, and else hold the most that any of them took."""
    pa.default_memory_pool().release_unused()
    if _trim():
        _trim()(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(n: int, base: np.uint64 = BASE) -> np.ndarray:
    out = np.full(max(n, 1), base, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


def spans(data: np.ndarray, offs: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes marked by `inside` (a table of 256), never
    across rows, and for each row boundary the number of runs before it."""
    n = len(data)
    is_in = np.zeros(n + 2, bool)
    np.take(inside, data, out=is_in[1:-1])
    edges = np.flatnonzero(is_in[1:] != is_in[:-1])
    starts, ends = edges[::2], edges[1::2]
    # Runs that go on across a row's end are cut there.
    cut = np.unique(offs[is_in[offs] & is_in[offs + 1]])
    if len(cut):
        starts, ends = np.insert(starts, np.searchsorted(starts, cut), cut), np.insert(ends, np.searchsorted(ends, cut), cut)
    return starts, ends, np.searchsorted(starts, offs)


def _inverse(x: int) -> np.uint64:
    """The inverse of an odd number modulo 2^64."""
    return U64(pow(x, -1, 1 << 64))


#: Powers of BASE and of its inverse, for texts of up to a piece's bytes.
_POWERS: dict[str, np.ndarray] = {}


def _both_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS:
        _POWERS["up"], _POWERS["down"] = powers(PIECE_BYTES), powers(PIECE_BYTES, _inverse(int(BASE)))
    if n <= PIECE_BYTES:
        return _POWERS["up"][:n], _POWERS["down"][:n]
    return powers(n), powers(n, _inverse(int(BASE)))


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes: the sum of its bytes plus one, by powers of BASE from its start on. That is the difference of
    two sums from the start of the data, by the inverse power of the run's place."""
    if not len(starts):
        return np.zeros(0, U64)
    out = np.empty(len(starts), U64)
    at = 0
    while at < len(starts):
        # By parts of a piece's bytes, or one longer run.
        first = int(starts[at])
        end = max(at + 1, int(np.searchsorted(ends, first + PIECE_BYTES, side="right")))
        a, b = starts[at:end] - first, ends[at:end] - first
        up, down = _both_powers(int(b[-1]))
        total = np.empty(int(b[-1]) + 1, U64)
        total[0], sums = 0, total[1:]
        np.add(data[first : first + int(b[-1])], U64(1), out=sums)
        np.multiply(sums, up, out=sums)
        np.cumsum(sums, out=sums)
        out[at:end] = (total[b] - total[a]) * down[a]
        at = end
    return mix(out + (ends - starts).astype(U64))


def shingles(words: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word windows of each row, and the row of each. A row with fewer
    words gives its whole sequence as one; a row without words gives none."""
    count = np.diff(bounds)
    base = powers(n, U64(0xD6E8FEB86659FD93))
    total = len(words)
    if total >= n:
        rolled = np.zeros(total - n + 1, U64)
        for j in range(n):
            rolled += words[j : total - n + 1 + j] * base[j]
        rolled = mix(rolled)
    else:
        rolled = np.zeros(0, U64)
    full = np.maximum(count - n + 1, 0)
    rows = np.repeat(np.arange(len(count)), full)
    first = np.cumsum(full) - full
    out = rolled[np.arange(int(full.sum())) - np.repeat(first - bounds[:-1], full)] if full.sum() else np.zeros(0, U64)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        extra = np.array([mix(np.array([(words[bounds[r] : bounds[r + 1]] * base[: count[r]]).sum(dtype=U64) + U64(count[r])], U64))[0] for r in short], U64)
        out, rows = np.concatenate([out, extra]), np.concatenate([rows, short])
        order = np.argsort(rows, kind="stable")
        out, rows = out[order], rows[order]
    return out, rows


def shared_dir(spark, name: str) -> str:
    """A new folder below the one that driver and executors share, from the cluster's setting. Only a local run
    that has none gets a temporary folder: elsewhere executors would write to their own disks."""
    import tempfile
    import uuid

    root = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", "")
    if not root:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="strikeflow-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Lists that note the folders that stored() makes while they are here, see folders_made().
_noting: list[list[str]] = []


@contextlib.contextmanager
def folders_made() -> Iterator[list[str]]:
    """The folders that stored() makes within."""
    made: list[str] = []
    _noting.append(made)
    try:
        yield made
    finally:
        _noting.remove(made)


def stored(df, name: str):
    """The frame written once as Parquet in the shared folder and read back: cuts lineage,
    survives lost executors and is shared by the steps that follow."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    for made in _noting:
        made.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bits of a row's number for its file and for its place there.
FILE_BITS, PLACE_BITS = 34, 29


def _is_scan(df) -> bool:
    """Whether each row of the frame is a row of one file."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias") and plan.children().size() == 1:
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation"


def numbered(df, row: str, name: str):
    """The frame with a number for each row in a column `row`, which is the same whenever it is read and however scans are split.

    Rows of a Parquet table have that of their file and their place in it, and nothing is stored; files are told apart by hashes of their
    paths, which are checked to differ. Other frames are stored with numbers in them."""
    if _is_scan(df):
        with contextlib.suppress(AnalysisException):
            path = F.col("_metadata.file_path")
            placed = df.select(path.alias("p"), "_metadata.row_index")
            for seed in range(8):
                kind = lambda c: F.pmod(F.xxhash64(c, F.lit(seed)), F.lit(1 << FILE_BITS))  # noqa: B023, E731
                r = placed.select("p").distinct().agg(F.count("*"), F.count_distinct(kind(F.col("p")))).first()
                if r[0] == r[1]:
                    place = F.col("_metadata.row_index")
                    place = F.when(place < 1 << PLACE_BITS, place).otherwise(F.raise_error(F.lit("a file of too many rows")).cast("long"))
                    return df.select("*", F.shiftleft(kind(path), PLACE_BITS).bitwiseOR(place).alias(row))
    return stored(df.withColumn(row, F.monotonically_increasing_id()), name)


def id_bits(ids, hashed) -> np.ndarray:
    """A filter of FILTER_BITS bits that is set at the given column of hashes, modulo its size."""
    at = F.pmod(hashed, F.lit(FILTER_BITS)) + 1
    made = ids.groupBy(F.bitmap_bucket_number(at).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in made.toLocalIterator():
        bits = np.frombuffer(r["bits"], np.uint8)
        first = (r["k"] - 1) * len(bits)
        out[first : first + len(bits)] |= bits[: len(out) - first]
    return out


def id_filter(ids, column: str):
    """A function of a column that is true for all the given ids and false for most others, to spare rows an
    exchange before they are joined with the ids, and the broadcast that it reads. When the filter fills, it lets more rows pass."""
    shared = ids.sparkSession.sparkContext.broadcast(id_bits(ids, F.xxhash64(column)))

    @F.pandas_udf("boolean")
    def passes(at: pd.Series) -> pd.Series:
        at = at.to_numpy()
        return pd.Series((shared.value[at >> 3] >> (at & 7) & 1) > 0)

    return lambda c: passes(F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))), shared


def drop_folders(spark, paths) -> None:
    jvm = spark.sparkContext._jvm
    for folder in paths:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def trim_jvm(spark) -> None:
    """Returns memory that the driver's JVM has freed outside of its heap to the system, where the JVM has the command for it (as `jcmd
    System.trim_native_heap`). Compiling the plans of many steps, on many threads, else leaves some 50 to 100 MB with each run of the pipeline, whatever the input."""
    gateway = spark.sparkContext._gateway
    jvm = gateway.jvm
    with contextlib.suppress(Py4JError):
        # The server's own class is not open to calls, its interface is.
        kinds, args = gateway.new_array(jvm.java.lang.Class, 4), gateway.new_array(jvm.java.lang.Object, 4)
        for k, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[k] = jvm.java.lang.Class.forName(kind)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)


def release(spark, *done) -> None:
    """Removes the files of frames made by stored(), and broadcasts, that nothing reads any more, and lets Spark drop the shuffle
    files of finished steps: these go when the driver's JVM collects its garbage, which a mostly idle
    driver may not do before executors' disks fill. What the driver's processes have freed goes back to the system."""
    frames = [x for x in done if not isinstance(x, Broadcast)]
    for x in done:
        if isinstance(x, Broadcast):
            x.destroy()
    drop_folders(spark, {f.rsplit("/", 1)[0] for df in frames for f in df.inputFiles()})
    gc.collect()
    give_back()
    spark.sparkContext._jvm.System.gc()
    trim_jvm(spark)
