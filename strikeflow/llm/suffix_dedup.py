"""Removal of long repeated strings by longest-previous-factor arrays.

The longest previous factor of a position is the longest string there that also starts at an
earlier position; in suffix order it is shared with the previous or the next smaller position.
A position whose factor has `size` bytes or more starts a repeat; the same towards later positions
gives the copies that come after. The suffix order is only built where repeats can be:

1. Every window of `size` bytes is filed under its anchor, the window's least k-gram; equal
   windows have equal anchors at the same offset. Neighbouring windows of one anchor are a
   segment. Equal segments are counted with map-side combination, and one of each kind stands for all:
   a kind that occurs twice is repeated throughout, an anchor that occurs once has no repeats.
2. The different kinds around one anchor are put in suffix order, bucket by bucket; the order's common
   prefixes and its previous and next smaller positions give the factors.
3. Buckets with more than BUCKET_MAX kinds are split further: by the bytes around the anchor, of classes of WIDTH windows, and
   what is then still different into one bucket for each different window. All
   suffixes of such a bucket share `size` bytes, so that the factor is full for all but the
   first; no bucket is gathered, only counted.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strikeflow.llm.textcore import BASE, U64, buffers, id_filter, mix, numbered, pieces, powers, release, stored

GRAM = 32
BLOCK = 1 << 19
BUCKET_MAX = 512
#: Offsets of the anchor that a class of windows of a hot bucket spans.
WIDTH = 16
#: Suffixes that are sorted together.
BATCH_STARTS = 1 << 15


@functools.cache
def _tables(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random values of the bytes, powers of the base and of its inverse modulo 2**64."""
    values = mix(np.arange(1, 257, dtype=U64) * BASE)
    return values, powers(n), powers(n, U64(pow(int(BASE), -1, 1 << 64)))


def _prefix(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values, power, inverse = _tables(1 << max(16, int(len(data)).bit_length()))
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(values[data] * power[: len(data)], out=out[1:])
    return out, inverse


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minima of all windows of w values."""
    n = len(x) - w + 1
    pad = -len(x) % w
    y = np.concatenate([x, np.full(pad, np.iinfo(U64).max, U64)]).reshape(-1, w)
    ahead = np.minimum.accumulate(y, axis=1).ravel()
    back = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def anchored(data: np.ndarray, offs: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Segments of texts that lie end to end: text, first and last window start (from the start of the
    data), anchor hash, and a fingerprint of the segment's bytes and the anchor's place in them."""
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, U64, U64))
    if len(data) < size:
        return none
    total, inverse = _prefix(data)
    n = len(data) - GRAM + 1
    gram = mix((total[GRAM:] - total[:-GRAM]) * inverse[:n])
    # The place in the low bits: of equal grams in a window the first counts.
    bits = U64(max(1, int(n).bit_length()))
    least = _sliding_min(((gram >> bits) << bits) | np.arange(n, dtype=U64), size - GRAM + 1)
    place = (least & ((U64(1) << bits) - U64(1))).astype(np.int64)
    row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[: len(place)]
    good = np.arange(len(place)) + size <= offs[1:][row]
    edge = np.ones(len(place), bool)
    edge[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1]) | ~good[:-1]
    first = np.flatnonzero(edge & good)
    if not len(first):
        return none
    ends = np.flatnonzero(good & np.append(edge[1:] | ~good[1:], True))
    p = place[first]
    whole = mix((total[ends + size] - total[first]) * inverse[first])
    return row[first], first, ends, gram[p], mix(whole + mix((p - first).astype(U64)) + (ends - first).astype(U64) * BASE)


def _alike(row: np.ndarray, anchor: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of segments in the order of their places: the first of each kind in each text, the others by the first of their kind, and where among these those of each first one begin."""
    order = np.argsort(mix(mark + mix(anchor + row.astype(U64) * BASE)), kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = np.any([x[order[1:]] != x[order[:-1]] for x in (row, anchor, mark)], axis=0)
    lead = np.empty(len(order), np.int64)
    lead[order] = order[new][np.cumsum(new) - 1]
    own = lead == np.arange(len(lead))
    first, more = np.flatnonzero(own), np.flatnonzero(~own)
    more = more[np.argsort(lead[more], kind="stable")]
    return first, more, np.searchsorted(lead[more], np.append(first, len(lead)))


def _segments(size: int):
    """(row, doc_id, s0, s1, anchor, print, more) of all segments, block by block in long texts. Places count from `base` on. Of segments of
    one kind in a block of a text the first is a row, in which `more` has the places of the others."""

    def run(batches):
        for piece in pieces(batches, limit=BLOCK):
            data, offs = buffers(piece.column("text"))
            for at in range(0, max(1, len(data)), BLOCK):  # more than one only for one long text
                cut = data[at : at + BLOCK + size - 1] if piece.num_rows == 1 else data
                o = offs if piece.num_rows > 1 else np.array([0, len(cut)])
                row, s0, s1, anchor, mark = anchored(cut, o, size)
                base = at - o[row] + piece.column("base").to_numpy(zero_copy_only=False)[row]
                s0, s1 = s0 + base, s1 + base
                first, more, cuts = _alike(row, anchor, mark)
                more = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(s0[more]))
                row, s0, s1, anchor, mark = (x[first] for x in (row, s0, s1, anchor, mark))
                yield pa.record_batch(
                    [piece.column("row").take(pa.array(row)), piece.column("doc_id").take(pa.array(row)), pa.array(s0), pa.array(s1), pa.array(anchor.view(np.int64)), pa.array(mark.view(np.int64)), more],
                    names=["row", "doc_id", "s0", "s1", "anchor", "print", "more"],
                )
                if piece.num_rows > 1:
                    break

    return run


def suffix_order(windows: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of suffixes, given by their first bytes (a row each), within their buckets, and how many
    bytes each shares with the one before it."""
    key = np.concatenate([bucket.astype(">u4").view(np.uint8).reshape(-1, 4), windows], axis=1)
    order = np.argsort(np.ascontiguousarray(key).view(f"V{key.shape[1]}").ravel(), kind="stable")
    key = key[order]
    other = key[1:] != key[:-1]
    shared = np.where(other.any(1), other.argmax(1), key.shape[1]) - 4
    return order, np.append(0, np.maximum(shared, 0))[: len(order)]


def previous_factors(place: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """For suffixes in suffix order, with their places and the bytes that each shares with the one before:
    the longest prefix that each shares with a suffix at a smaller place."""

    def nearest(place, shared):
        # `at` runs back to the nearest smaller place over what is known to be larger, `low` is the least common prefix on the way.
        at, low = np.arange(-1, len(place) - 1), shared.copy()
        while len(far := np.flatnonzero((at >= 0) & (place[at] > place))):
            low[far] = np.minimum(low[far], low[at[far]])
            at[far] = at[at[far]]
        return np.where(at >= 0, low, 0)

    after = nearest(place[::-1], np.append(0, shared[:0:-1])[: len(place)])[::-1]
    return np.maximum(nearest(place, shared), after)


def _runs(flag: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of set flags within a group."""
    edge = np.ones(len(flag), bool)
    edge[1:] = group[1:] != group[:-1]
    first = np.flatnonzero(flag & (edge | ~np.append(False, flag[:-1])))
    last = np.flatnonzero(flag & np.append(edge[1:] | ~flag[1:], True))
    return first, last


def _windows(t: pa.Table, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All windows of the segments of a table: the bytes of the segments end to end, where in them each window starts, its segment and its place in the text."""
    text, ends = buffers(t["bytes"])
    s0, s1 = (t[c].to_numpy() for c in ("s0", "s1"))
    count = s1 - s0 + 1
    seg = np.repeat(np.arange(len(count)), count)
    inner = np.arange(len(seg)) - np.repeat(np.cumsum(count) - count, count)
    return text, ends[:-1][seg] + inner, seg, s0[seg] + inner


def _sorted_buckets(size: int, keep_first: bool):
    """Segments sorted by bucket -> repeated window starts (row, first, last). Whole buckets are
    sorted together, up to BATCH_STARTS windows; buckets do not influence each other, as equal
    windows have equal anchors."""

    def solve(t):
        ids = t["doc_id"]
        order = np.lexsort((t["s0"].to_numpy(), t["row"].to_numpy(), ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy()))
        t = t.take(pa.array(order))
        text, starts, seg, place = _windows(t, size)
        bucket = np.unique(t["anchor"].to_numpy(), return_inverse=True)[1]
        # A window whose fingerprint stands once in its bucket has no factor of `size` bytes: only the others are sorted.
        total, inverse = _prefix(text)
        mark = mix((total[starts + size] - total[starts]) * inverse[starts]) + bucket[seg].astype(U64) * BASE
        _, back, seen = np.unique(mark, return_inverse=True, return_counts=True)
        some = np.flatnonzero(seen[back] > 1)
        order, shared = suffix_order(np.lib.stride_tricks.sliding_window_view(text, size)[starts[some]], bucket[seg[some]])
        order = some[order]
        factor = np.zeros(len(seg), np.int64)
        # The table is in the order of places.
        factor[order] = previous_factors(order, shared)
        if not keep_first:
            later = np.zeros(len(seg), np.int64)
            later[order] = previous_factors(-order, shared)
            factor = np.maximum(factor, later)
        first, last = _runs(factor >= size, seg)
        return pa.record_batch([pa.array(t["row"].to_numpy()[seg[first]]), pa.array(place[first]), pa.array(place[last])], names=["row", "first", "last"])

    def run(batches):
        held = None
        for b in batches:
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])]).combine_chunks()
            anchor = t["anchor"].to_numpy()
            cuts = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
            total = np.cumsum(t["s1"].to_numpy() - t["s0"].to_numpy() + 1)
            at = 0
            for cut in cuts.tolist():
                if total[cut - 1] - (total[at - 1] if at else 0) >= BATCH_STARTS:
                    yield solve(t.slice(at, cut - at))
                    at = cut
            held = t.slice(at)
        if held is not None and held.num_rows:
            yield solve(held)

    return run


def _classes(size: int):
    """Segments cut where the anchor's offset in the window passes a multiple of WIDTH. All windows of such a class hold the same bytes
    around the anchor, all but WIDTH - 1 of a window's: their hash is the new anchor, which equal windows share."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 512):
                t = pa.Table.from_batches([b.slice(at, 512)]).combine_chunks()
                text, starts, seg, place = _windows(t, size)
                _, ends = buffers(t["bytes"])
                total, inverse = _prefix(text)
                n = len(text) - GRAM + 1
                own = np.repeat(np.arange(t.num_rows), np.diff(ends))[:n]
                anchor = t["anchor"].to_numpy().view(U64)
                hit = np.flatnonzero(mix((total[GRAM:] - total[:-GRAM]) * inverse[:n]) == anchor[own])
                # Of equal grams the first is the anchor.
                p = hit[np.unique(own[hit], return_index=True)[1]][seg]
                c = (p - starts) // WIDTH
                first = np.flatnonzero(np.append(True, (seg[1:] != seg[:-1]) | (c[1:] != c[:-1])))
                last = np.append(first[1:], len(seg)) - 1
                a, z, core = starts[first], starts[last] + size, p[first] - c[first] * WIDTH
                key = mix(mix((total[core + size - WIDTH + 1] - total[core]) * inverse[core]) + mix(anchor[seg[first]] + c[first].astype(U64)))
                mark = mix(mix((total[z] - total[a]) * inverse[a]) + mix((p[first] - a).astype(U64)) + (last - first).astype(U64) * BASE)
                raw = text.tobytes()
                for k in range(0, len(first), 4096):
                    w, s = slice(k, k + 4096), seg[first[k : k + 4096]]
                    cols = [t["doc_id"].combine_chunks().take(pa.array(s)), pa.array(t["row"].to_numpy()[s]), pa.array(place[first[w]]), pa.array(place[last[w]]), pa.array(key[w].view(np.int64)), pa.array(mark[w].view(np.int64)), pa.array([raw[x:y] for x, y in zip(a[w].tolist(), z[w].tolist(), strict=True)], pa.binary())]
                    yield pa.record_batch(cols, names=["doc_id", "row", "s0", "s1", "anchor", "print", "bytes"])

    return run


def _window_prints(size: int):
    """Each window start of a segment with a fingerprint of its bytes."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 512):
                t = pa.Table.from_batches([b.slice(at, 512)]).combine_chunks()
                text, starts, seg, place = _windows(t, size)
                total, inverse = _prefix(text)
                mark = mix(mix((total[starts + size] - total[starts]) * inverse[starts]) + t["anchor"].to_numpy().view(U64)[seg])
                for k in range(0, len(seg), 1 << 16):
                    w = seg[k : k + (1 << 16)]
                    yield pa.record_batch([t["doc_id"].combine_chunks().take(pa.array(w)), pa.array(t["row"].to_numpy()[w]), pa.array(place[k : k + len(w)]), pa.array(mark[k : k + len(w)].view(np.int64))], names=["doc_id", "row", "first", "print"])

    return run


def _cut_out(size: int):
    """Texts with the segments wanted of them -> the segments' bytes."""

    def run(batches):
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
        for piece in pieces(batches):
            out = []
            for doc_id, row, base, text, wanted in zip(*(piece.column(c) for c in ("doc_id", "row", "base", "text", "wanted")), strict=True):
                raw, base = text.as_py(), base.as_py()
                # A row may come in several parts.
                out += [(doc_id.as_py(), row.as_py(), w["s0"], w["s1"], w["anchor"], w["hot"], raw[w["s0"] - base : w["s1"] - base + size]) for w in wanted.as_py() if base <= w["s0"] and w["s1"] + size <= base + len(raw)]
            if out:
                yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "row", "s0", "s1", "anchor", "hot", "bytes"])

    return run


def repeated_windows(docs: DataFrame, size: int, keep_first: bool) -> DataFrame:
    """(row, found): the runs of window starts that are to be removed, as an array of (first, last), stored. `docs` has row, doc_id, base
    and text (binary), a stored table; a row's text starts at byte `base`, and a row may come in parts that are apart."""
    spark = docs.sparkSession
    if not keep_first:  # then the order of documents does not matter
        docs = docs.withColumn("doc_id", F.lit(None).cast("long"))
    segments = stored(docs.mapInArrow(_segments(size), "row long, doc_id long, s0 long, s1 long, anchor long, print long, more array<long>"), "segments")
    # The first copy only matters where it stays; otherwise any stands for its kind, which needs no sorting. A segment is shorter than `size`.
    span = F.col("s0") * size + F.col("s1") - F.col("s0")
    one = [F.min(F.struct("doc_id", "row", "s0", "s1")).alias("one")] if keep_first else [F.first("row").alias("row"), F.first(span).alias("span")]
    kinds = segments.groupBy("anchor", "print").agg(F.sum(F.size("more") + 1).alias("n"), *one)
    if not keep_first:
        s0 = F.expr(f"span div {size}")
        kinds = kinds.select("anchor", "print", "n", F.struct("row", s0.alias("s0"), (s0 + F.col("span") % size).alias("s1")).alias("one"))
    anchors = kinds.groupBy("anchor").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"), F.min("n").alias("least"))
    kinds = stored(kinds.join(anchors.where("total > 1"), "anchor"), "kinds")
    release(spark)

    # A segment that occurs again is repeated as a whole. A text has one row for all places of a kind.
    again = segments.join(kinds.where("n > 1").select("anchor", "print", "one"), ["anchor", "print"])
    places = F.concat(F.array("s0"), "more")
    if keep_first:
        other = (F.col("row") != F.col("one.row")) | (F.col("s0") != F.col("one.s0"))
        again, places = again.where(other | (F.size("more") > 0)), F.when(other, places).otherwise(F.col("more"))
    span = F.col("s1") - F.col("s0")
    whole = stored(again.select("row", F.transform(places, lambda at: F.struct(at.alias("first"), (at + span).alias("last"))).alias("found")), "repeats")
    release(spark, segments)

    # One of each kind where an anchor has several.
    open_ = kinds.where("kinds > 1" if keep_first else "kinds > 1 and least = 1")
    wanted = open_.select("one.row", F.struct("one.s0", "one.s1", "anchor", (F.col("kinds") > BUCKET_MAX).alias("hot")).alias("w")).groupBy("row").agg(F.collect_list("w").alias("wanted"))
    wanted = stored(wanted, "wanted")
    asked, bits = id_filter(wanted.select("row"), "row")
    parts = docs.where(asked("row")).join(wanted, "row").select("doc_id", "row", "base", "text", "wanted")
    parts = stored(parts.mapInArrow(_cut_out(size), "doc_id long, row long, s0 long, s1 long, anchor long, hot boolean, bytes binary"), "suffixes")
    release(spark, kinds, wanted, bits)
    found = "row long, first long, last long"
    cool = parts.where("not hot").select("doc_id", "row", "s0", "s1", "anchor", "bytes").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_sorted_buckets(size, keep_first), found)

    # Hot buckets by class: again equal ones count as one, and only different ones around the same bytes are taken window by window.
    hot = parts.where("hot").select("doc_id", "row", "s0", "s1", "anchor", "bytes")
    classes = stored(hot.mapInArrow(_classes(size), "doc_id long, row long, s0 long, s1 long, anchor long, print long, bytes binary"), "classes")
    alike = classes.groupBy("anchor", "print").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "row", "s0")).alias("one"))
    alike = stored(alike.join(alike.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("n").alias("least")), "anchor"), "alike")
    again = classes.join(alike.where("n > 1").select("anchor", "print", "one"), ["anchor", "print"])
    if keep_first:
        again = again.where((F.col("row") != F.col("one.row")) | (F.col("s0") != F.col("one.s0")))
    equal = again.select("row", F.col("s0").alias("first"), F.col("s1").alias("last"))
    single = alike.where("kinds > 1" if keep_first else "kinds > 1 and least = 1").select("anchor", "print", "one.row", "one.s0")
    single = classes.join(single, ["anchor", "print", "row", "s0"], "left_semi").select("doc_id", "row", "s0", "s1", "anchor", "bytes")
    marks = stored(single.mapInArrow(_window_prints(size), "doc_id long, row long, first long, print long"), "windows")
    seen = marks.groupBy("print").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "row", "first")).alias("one")).where("n > 1")
    hot = marks.join(seen, "print")
    if keep_first:
        hot = hot.where((F.col("row") != F.col("one.row")) | (F.col("first") != F.col("one.first")))
    runs = cool.unionAll(equal).unionAll(hot.select("row", "first", F.col("first").alias("last"))).select("row", F.array(F.struct("first", "last")).alias("found"))
    out = stored(whole.unionAll(runs).groupBy("row").agg(F.flatten(F.collect_list("found")).alias("found")), "found")
    release(spark, whole, parts, classes, alike, marks)
    return out


def _runs_of(column: pa.Array):
    """A function of a row and a length that gives which bytes are reached from the window starts of the row's runs."""
    first, last = (column.values.field(c).to_numpy(zero_copy_only=False) for c in ("first", "last"))
    at = column.offsets.to_numpy()

    def covered(k: int, n: int, reach: int) -> np.ndarray:
        a, b = at[k], at[k + 1]
        hit = np.bincount(first[a:b], minlength=n + 1) - np.bincount(last[a:b] + reach, minlength=n + 1)
        return np.cumsum(hit[:n]) > 0

    return covered


def _fragments(size: int, least: int):
    """Of each text the parts that may hold a repeat of `size` bytes: all its windows of `least` bytes are repeated."""

    def run(batches):
        for piece in pieces(batches):
            out = []
            covered = _runs_of(piece.column("found"))
            for k, (row, doc_id, text) in enumerate(zip(*(piece.column(c) for c in ("row", "doc_id", "text")), strict=True)):
                raw, row, doc_id = text.as_py(), row.as_py(), doc_id.as_py()
                starts = covered(k, len(raw), 1)
                for a, b in zip(*(x.tolist() for x in _runs(starts, np.zeros(len(raw), np.int8))), strict=True):
                    if b + least - a >= size:
                        out.append((row, doc_id, a, raw[a : b + least]))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["row", "doc_id", "base", "text"])

    return run


_OUT = "row long, doc_id long, n_bytes long, n_removed long, n_spans long, n_repeated long, kept_sha256 string, kept_text string"


def _removed(size: int, least: int):
    def run(batches):
        for piece in pieces(batches):
            rows = []
            by_size, by_least = _runs_of(piece.column("found")), _runs_of(piece.column("shorter"))
            for k, (text, found, shorter) in enumerate(zip(*(piece.column(c) for c in ("text", "found", "shorter")), strict=True)):
                raw = text.as_py() or b""
                if not found.is_valid and not shorter.is_valid:
                    rows.append((len(raw), 0, 0, 0, hashlib.sha256(raw).hexdigest(), raw.decode()))
                    continue
                out = by_size(k, len(raw), size)
                again = by_least(k, len(raw), least) if shorter.is_valid else out
                data = np.frombuffer(raw, np.uint8)[~out].tobytes() if found.is_valid else raw
                spans = int((out[1:] & ~out[:-1]).sum() + (len(out) > 0 and out[0]))
                rows.append((len(raw), int(out.sum()), spans, int(again.sum()), hashlib.sha256(data).hexdigest(), data.decode("utf-8", "ignore")))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.record_batch([piece.column("row"), piece.column("doc_id"), *(pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=["row", "doc_id", "n_bytes", "n_removed", "n_spans", "n_repeated", "kept_sha256", "kept_text"])

    return run


def suffix_dedup(docs: DataFrame, size: int = 400, keep_first: bool = True, least: int | None = None, row: str | None = None) -> DataFrame:
    """(row, doc_id, n_bytes, n_removed, n_spans, n_repeated, kept_sha256, kept_text), one for each row of `docs`.

    Bytes of the UTF-8 text that a repeated string of `size` bytes covers are removed; matches
    never cross documents and strings are judged on the input. With `keep_first`
    a string's first copy stays (by doc_id, then row, then place); without it all copies go.
    n_spans counts maximal removed runs. n_repeated counts the bytes that a string of `least` bytes (below `size`)
    covers which also starts anywhere else, first copies included; without `least` it is n_removed. kept_sha256 is over the remaining bytes;
    kept_text drops bytes of a character that was cut through. Null texts read as empty;
    texts shorter than `size` stay; repeated rows are copies of each other; null doc_ids
    come first. An empty table gives no rows. Other columns are ignored. `row` names a column that numbers the
    rows of `docs`, a stored table; without it the rows are numbered and stored here.
    """
    least = min(size, least or size)
    if row is None:
        docs, row = numbered(docs.select("doc_id", "text"), "row", "numbered"), "row"
    docs = docs.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).cast("long").alias("base"), F.col("text").cast("string").cast("binary").alias("text"))
    short = repeated_windows(docs.where("text is not null"), least, keep_first and least == size)
    found, shorter = short, short.select("row", F.col("found").alias("shorter"))
    if least < size:
        # A repeat of `size` bytes lies within what repeats of `least` bytes cover.
        asked, bits = id_filter(short.select("row"), "row")
        parts = docs.where(asked("row")).join(short, "row").select("row", "doc_id", "text", "found")
        parts = stored(parts.mapInArrow(_fragments(size, least), "row long, doc_id long, base long, text binary"), "fragments")
        release(docs.sparkSession, bits)
        found = repeated_windows(parts, size, keep_first)
        release(docs.sparkSession, parts)
    spans = found.join(shorter, "row", "full") if least < size else found.withColumn("shorter", F.lit(None).cast(found.schema["found"].dataType))
    # Rows without repeats are not exchanged.
    asked, _ = id_filter(short.select("row"), "row")
    docs = docs.withColumn("asked", asked("row"))
    kind = short.schema["found"].dataType
    whole = docs.where("not asked").select("row", "doc_id", "text", F.lit(None).cast(kind).alias("found"), F.lit(None).cast(kind).alias("shorter"))
    cut = docs.where("asked").join(spans, "row", "left").select("row", "doc_id", "text", "found", "shorter")
    return whole.unionAll(cut).mapInArrow(_removed(size, least), _OUT)
