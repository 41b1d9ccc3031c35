"""N-gram Jaccard self join of documents.

Rare-first prefix filtering: the shingles of a set are put in one global order, rare
before frequent, and two sets of similarity t share a shingle among the first
|x| - ceil(t|x|) + 1 of each. Only those prefix shingles are exchanged. A length and a
positional filter drop rows of a bucket that can link with no other row of it; a suffix filter -
counts of the shingles by ranges of the hash order - drops pairs before texts are exchanged;
what is left is tested exactly, each pair once.

Group sizes are never bounded: a bucket of g documents is not expanded into its g*g pairs.
Buckets first link their members to a pivot; when that has joined all members,
nothing is left to test. What stays apart is then compared in full, only across
components, so that every link between different texts counts for the components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strikeflow.llm.graph import components
from strikeflow.llm.textcore import FILTER_BITS, LOWER, SPACED, U64, buffers, id_bits, mix, pieces, release, run_hashes, shingles, spans, stored

#: Cells of the table of hashed shingle frequencies (a byte each): its size never grows.
CELLS = 1 << 23
SLICES = 1024
#: Rows of one shingle that go to one task; frequent shingles are salted.
SALTED = 1 << 14
#: Shingles of a part of the buckets, of which about a quarter are in prefixes: some 100 MB of arrays.
PART_SHINGLES = 1 << 24
#: Open buckets of up to so many rows are compared in full, larger ones only after a second pivot.
SMALL_BUCKET = 16
#: Ratio of neighbouring size classes in which rows of a bucket meet.
CLASS = 1.05


def _sets(piece: pa.RecordBatch, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each row, sorted, end to end, and their row bounds."""
    data, offs = buffers(piece.column("text"))
    data = LOWER[data]
    starts, ends, bounds = spans(data, offs, SPACED)
    grams, rows = shingles(run_hashes(data, starts, ends), bounds, n)
    if not len(grams):
        return grams, np.zeros(piece.num_rows + 1, np.int64)
    at = np.searchsorted(rows, np.arange(piece.num_rows + 1))
    parts = [np.unique(grams[at[r] : at[r + 1]]) for r in range(piece.num_rows)]
    size = np.array([len(p) for p in parts])
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(size)])


def _nodes(grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One id for each set: equal sets have equal ids. 0 is the empty set."""
    out = np.zeros(len(bounds) - 1, U64)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        first = bounds[:-1][full]
        a = np.add.reduceat(mix(grams), first)
        b = np.bitwise_xor.reduceat(mix(grams + U64(0x632BE59BD9B4E019)), first)
        out[full] = mix(a ^ mix(b + np.diff(bounds)[full].astype(U64))) | U64(1)
    return out.view(np.int64)


def _cell(grams: np.ndarray) -> np.ndarray:
    return (grams & U64(CELLS - 1)).astype(np.int32)


def _signatures(n: int):
    """Per row: id, set size and set id; and per task the frequencies of hashed shingles."""

    def run(batches):
        cells = np.zeros(CELLS, np.int32)
        held, got = [], 0
        for piece in pieces(batches):
            grams, bounds = _sets(piece, n)
            held.append(_cell(grams))
            got += len(grams)
            if got > 1 << 22:
                np.add.at(cells, np.concatenate(held), 1)
                held, got = [], 0
            k = piece.num_rows
            yield pa.record_batch([piece.column("doc_id"), pa.array(np.diff(bounds), pa.int64()), pa.array(_nodes(grams, bounds)), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names=["doc_id", "n_shingles", "node", "slice", "cells"])
        if held:
            np.add.at(cells, np.concatenate(held), 1)
        used = [(i, np.minimum(c, 65535).astype(np.uint16)) for i, c in enumerate(np.split(cells, SLICES)) if c.any()]
        if used:
            k = len(used)
            yield pa.record_batch([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.array([i for i, _ in used], pa.int32()), pa.array([c.tobytes() for _, c in used], pa.binary())], names=["doc_id", "n_shingles", "node", "slice", "cells"])

    return run


def _sum_cells(keys: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for b in batches:
        for c in b.column("cells").to_pylist():
            c = np.frombuffer(c, np.uint16).astype(np.int64)
            total = c if total is None else total + c
    total = np.minimum(total, 2**31 - 1).astype(np.int32)
    yield pa.record_batch([pa.array([keys[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["slice", "cells"])


def _prefix_size(size: np.ndarray, num: int, den: int) -> np.ndarray:
    return size - (num * size + den - 1) // den + 1


def _most(size: np.ndarray, pos: np.ndarray, num: int, den: int) -> np.ndarray:
    """The largest set with which a set can link if the shingle at `pos` is their first common one: they share
    at most this one and the shorter rest, and overlap >= num (x + y) / (num + den). Two rows of a bucket
    pass the length and the positional filter exactly if the size of each is at most this of the other."""
    return (size - pos) * (num + den) // num - size


def _prefixes(n: int, num: int, den: int, parts: int, salted: int, shared):
    """The rare-first prefixes, packed by the part of the hash range that they belong to:
    one row for each task and part, columns as arrays. Equal sets of a task go once. Salts are 0 but for frequent shingles."""

    def run(batches):
        freq, mean = shared.value
        held: list[list[np.ndarray]] = []
        done: set[int] = set()

        def flush():
            g, salt, node, size, pos = (np.concatenate(x) for x in zip(*held, strict=True))
            part = ((mix(g + salt) >> U64(32)) * U64(parts) >> U64(32)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            at = np.searchsorted(part[order], np.arange(parts + 1))
            rows = [p for p in range(parts) if at[p] < at[p + 1]]
            cut = lambda x: pa.array([x[at[p] : at[p + 1]].tobytes() for p in rows], pa.binary())
            held.clear()
            return pa.record_batch([pa.array(rows, pa.int32()), *(cut(x[order]) for x in (g, salt.astype(np.uint16), node, size, pos))], names=["part", "grams", "salts", "nodes", "sizes", "positions"])

        got = 0
        for piece in pieces(batches):
            grams, bounds = _sets(piece, n)
            if not len(grams):
                continue
            size = np.diff(bounds)
            nodes = _nodes(grams, bounds)
            fresh = np.zeros(len(nodes), bool)
            fresh[np.unique(nodes, return_index=True)[1]] = True
            fresh &= np.array([x not in done for x in nodes.tolist()])
            done.update(nodes[fresh].tolist())
            rows = np.repeat(np.arange(len(size)), size)
            grams, rows = grams[fresh[rows]], rows[fresh[rows]]
            often = freq[_cell(grams)]
            order = np.lexsort((grams, often, rows))
            rank = np.arange(len(grams)) - np.searchsorted(rows, np.arange(len(size)))[rows]
            take = rank < _prefix_size(size, num, den)[rows]
            rows, rank, order = rows[take], rank[take], order[take]
            # Beyond the load that any cell has, a cell's count is that of a frequent shingle.
            split = np.clip((np.exp2(often[order] / 8) - 2 * mean) // salted, 0, 60000).astype(U64)
            salt = np.where(split > 0, mix(nodes[rows].view(U64)) % (split + U64(1)) + U64(1), U64(0))
            held.append([grams[order], salt, nodes[rows], size[rows].astype(np.uint32), rank.astype(np.uint32)])
            got += len(rows)
            if got > 1_500_000:
                yield flush()
                got = 0
        if held:
            yield flush()

    return run


def _has_partner(bucket: np.ndarray, size: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Whether another row of the bucket passes both filters with each row. Rows are sorted by bucket and size."""
    n = len(size)
    if not n:
        return np.zeros(0, bool)
    key = bucket.astype(np.int64) << 32
    # Largest `most` of 2**k rows from each row on
    table = [most]
    while (1 << len(table)) <= int(np.bincount(bucket).max()):
        last, step = table[-1], 1 << (len(table) - 1)
        table.append(np.maximum(last, np.append(last[step:], np.zeros(step, last.dtype))[:n]))
    table = np.stack(table)
    # Smaller sets than num / den of a row's size have no `most` that reaches it.
    a, b, i = np.searchsorted(key + size, key), np.searchsorted(key + size, key + np.maximum(most, 0), "right"), np.arange(n)

    def reaches(lo, hi):
        out = np.zeros(n, bool)
        some = np.flatnonzero(hi > lo)
        k = np.floor(np.log2(hi[some] - lo[some])).astype(int)
        out[some] = np.maximum(table[k, lo[some]], table[k, hi[some] - (1 << k)]) >= size[some]
        return out

    return reaches(a, np.minimum(b, i)) | reaches(np.maximum(a, i + 1), b)


def _shared(num: int, den: int):
    """Of one part: the prefix shingles that two sets or more hold, as buckets of the rows that can link with another one. A row has its
    bucket's pivot, unless the length or the positional filter rules a link with it out. A frequent shingle's rows of one
    salt have a pivot of their own, and all are kept: their partners may have another salt.

    The pivot is the set in which the shingle comes first for its size: of edited copies that is the one with the fewest
    shingles of its own, the one nearest to their origin."""

    def run(keys: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols = [[], [], [], [], []]
        for b in batches:
            for x, name, kind in zip(cols, ("grams", "salts", "nodes", "sizes", "positions"), (U64, np.uint16, np.int64, np.uint32, np.uint32), strict=True):
                x += [np.frombuffer(v, kind) for v in b.column(name).to_pylist()]
        g, salt, node, size, pos = (np.concatenate(x) for x in cols)
        cols.clear()
        order = np.lexsort((node, salt, g))
        g, salt, node, size, pos = g[order], salt[order], node[order], size[order].astype(np.int64), pos[order].astype(np.int64)
        keep = np.ones(len(g), bool)
        keep[1:] = (g[1:] != g[:-1]) | (salt[1:] != salt[:-1]) | (node[1:] != node[:-1])
        g, salt, node, size, pos = g[keep], salt[keep], node[keep], size[keep], pos[keep]
        edge = lambda: np.append(True, (g[1:] != g[:-1]) | (salt[1:] != salt[:-1]))[: len(g)]
        many = salt > 0
        bucket = np.cumsum(edge()) - 1
        order = np.lexsort((size, bucket))
        g, salt, node, size, pos, many, bucket = (x[order] for x in (g, salt, node, size, pos, many, bucket))
        keep = _has_partner(bucket, size, _most(size, pos, num, den)) | many
        g, salt, node, size, pos, many = (x[keep] for x in (g, salt, node, size, pos, many))
        order = np.lexsort((mix(node.view(U64)), pos / np.maximum(size, 1), salt, g))
        g, salt, node, size, pos, many = (x[order] for x in (g, salt, node, size, pos, many))
        first = edge()
        bucket = np.cumsum(first) - 1
        at = np.flatnonzero(first)[bucket]
        most = _most(size, pos, num, den)
        near = (node != node[at]) & (size <= most[at]) & (size[at] <= most)
        members = np.maximum(np.bincount(bucket)[bucket] if len(g) else bucket, 3 * many)
        use = np.flatnonzero(near | (members > 2))
        for k in range(0, len(use), 1 << 17):
            w = use[k : k + (1 << 17)]
            yield pa.record_batch(
                [pa.array(g[w].view(np.int64)), pa.array(node[w]), pa.array(size[w].astype(np.int32)), pa.array(pos[w].astype(np.int32)), pa.array(members[w].astype(np.int32)), pa.array(node[at[w]], mask=~near[w])],
                names=["gram", "node", "size", "pos", "members", "pivot"],
            )

    return run


def _ranges(grams: np.ndarray) -> bytes:
    """How many shingles of a set lie in each range of the hash order, about two in one; empty if a count needs more than a byte."""
    bits = min(max(len(grams).bit_length() - 1, 4), 14)
    count = np.bincount((grams >> U64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return count.astype(np.uint8).tobytes() if count.max() < 256 else b""


def _may_link(num: int, den: int):
    """The suffix filter: overlap is at most the sum over the ranges of the smaller count."""

    def run(batches):
        for b in batches:
            ok = np.ones(b.num_rows, bool)
            for i, (p, q, x, y) in enumerate(zip(*(b.column(c).to_pylist() for c in ("x_ranges", "y_ranges", "x_size", "y_size")), strict=True)):
                if p and q:
                    p, q = np.frombuffer(p, np.uint8).astype(np.int64), np.frombuffer(q, np.uint8).astype(np.int64)
                    m = min(len(p), len(q))
                    ok[i] = (num + den) * int(np.minimum(p.reshape(m, -1).sum(1), q.reshape(m, -1).sum(1)).sum()) >= num * (x + y)
            yield pa.record_batch([b.column("x").filter(pa.array(ok)), b.column("y").filter(pa.array(ok))], names=["x", "y"])

    return run


def _verify(n: int, num: int, den: int):
    """Exact test of the pairs, each once."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                ok = np.zeros(part.num_rows, bool)
                sides = []
                for side in ("x_text", "y_text"):
                    texts = part.column(side).dictionary_encode()
                    sides.append((*_sets(pa.record_batch([texts.dictionary], names=["text"]), n), texts.indices.to_numpy(zero_copy_only=False)))
                for i in range(part.num_rows):
                    x, y = (grams[bounds[index[i]] : bounds[index[i] + 1]] for grams, bounds, index in sides)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    ok[i] = den * both >= num * (len(x) + len(y) - both)
                yield pa.record_batch([part.column("x"), part.column("y"), pa.array(ok)], names=["x", "y", "linked"])

    return run


def _frequencies(seen: DataFrame) -> tuple[np.ndarray, int]:
    """Of the hashed shingles: 8 log2(1 + count) for each cell, and the sum of all counts."""
    freq, total = np.zeros(CELLS, np.uint8), 0
    for r in seen.where("slice is not null").select("slice", "cells").groupBy("slice").applyInArrow(_sum_cells, "slice int, cells binary").toLocalIterator():
        counts = np.frombuffer(r["cells"], np.int32)
        total += int(counts.sum(dtype=np.int64))
        freq[r["slice"] * (CELLS // SLICES) : (r["slice"] + 1) * (CELLS // SLICES)] = np.floor(8 * np.log2(1.0 + counts))
    return freq, total


def _texts_of(n: int, asked):
    """(node, size, ranges, text) of the sets that pass the filter, once for each task; a set's texts give the same shingles."""

    def run(batches):
        done: set[int] = set()
        for piece in pieces(batches):
            grams, bounds = _sets(piece, n)
            nodes = _nodes(grams, bounds)
            at = nodes & (FILTER_BITS - 1)
            use = []
            for i in np.flatnonzero((np.diff(bounds) > 0) & (asked.value[at >> 3] >> (at & 7) & 1 > 0)).tolist():
                if nodes[i] not in done:
                    done.add(int(nodes[i]))
                    use.append(i)
            if use:
                size = np.diff(bounds)[use].astype(np.int32)
                yield pa.record_batch([pa.array(nodes[use]), pa.array(size), pa.array([_ranges(grams[bounds[i] : bounds[i + 1]]) for i in use], pa.binary()), piece.column("text").take(pa.array(use))], names=["node", "size", "ranges", "text"])

    return run


def ngram_jaccard_join(docs: DataFrame, n: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of `docs` (doc_id long, text string).

    Words are `[^\\x20\\x09-\\x0D]+` of the text with A-Z lower-cased; a set holds the
    distinct n-word shingles; with fewer words the whole sequence is the one shingle.
    Sets link when den * intersection >= num * union; component_id is the smallest doc_id
    reachable by links, itself included. Null and empty texts, or texts without
    words, have n_shingles 0 and link with nothing. Equal sets are one node and link whatever their
    number; rows with the same doc_id give one row each; a null doc_id takes part in
    links, but names no component (component_id is null where only such rows are linked).
    An empty table gives no rows; other columns are ignored. Texts are read whole and
    shingles compared as 64-bit hashes.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows, roots = ngram_components(docs, n, num, den, SALTED)
    classes = rows.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("least"))
    of = classes.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    names = of.join(of.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("node", "component_id")
    return rows.join(names, "node", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def ngram_components(docs: DataFrame, n: int = 5, num: int = 75, den: int = 100, salted: int = SALTED) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, node) of each row, equal sets having one node, and (node, root) of the linked nodes."""
    spark = docs.sparkSession
    seen = stored(docs.mapInArrow(_signatures(n), "doc_id long, n_shingles long, node long, slice int, cells binary"), "ngram-sets")
    freq, total = _frequencies(seen)
    # A part of the buckets is one task's arrays: as many parts as keep it small, whatever the corpus.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1, int(-(-total // PART_SHINGLES)))
    cells = spark.sparkContext.broadcast((freq, total / CELLS))
    packed = docs.select("text").mapInArrow(_prefixes(n, num, den, parts, salted, cells), "part int, grams binary, salts binary, nodes binary, sizes binary, positions binary")
    buckets = stored(packed.groupBy("part").applyInArrow(_shared(num, den), "gram long, node long, size int, pos int, members int, pivot long"), "ngram-buckets")
    release(spark, cells)
    del freq

    members = buckets.select("node").unionAll(buckets.select("pivot").where("pivot is not null"))
    asked = spark.sparkContext.broadcast(id_bits(members, F.col("node")))
    named = docs.where("text is not null").select("text").mapInArrow(_texts_of(n, asked), "node long, size int, ranges binary, text string")
    # The filter may let others pass.
    texts = stored(named.join(members.distinct().hint("merge"), "node", "left_semi").dropDuplicates(["node"]), "ngram-texts")
    release(spark, asked)

    # First every row against its bucket's pivot: that settles nearly all.
    first = buckets.where("pivot is not null")
    checked = _checked(_ordered(first.select(F.col("node").alias("x"), F.col("pivot").alias("y"))), texts, n, num, den)
    roots = stored(components(checked.where("linked"), "x", "y"), "ngram-roots")
    left = stored(_open(buckets.where("members > 2").select("gram", "node", "size", "pos"), roots), "ngram-open")
    release(spark, buckets)
    for last in (False, True):
        sized = left.join(left.groupBy("gram").agg(F.count("*").alias("n")), "gram")
        # Small buckets are compared in full; large ones with another pivot, and in full if that does not end.
        few, many = sized.where(F.col("n") <= SMALL_BUCKET), sized.where(F.col("n") > SMALL_BUCKET)
        pairs = _cross_pairs(sized, num, den) if last else _cross_pairs(few, num, den).unionAll(_pivot_pairs(many, num, den)).distinct()
        pairs = stored(pairs.join(checked.select("x", "y"), ["x", "y"], "left_anti"), "ngram-cross")
        if not pairs.isEmpty():
            new = _checked(pairs, texts, n, num, den, few=True)
            checked = checked.unionAll(new)
            links = roots.select(F.col("node").alias("x"), F.col("root").alias("y")).unionAll(new.where("linked").select("x", "y"))
            roots = stored(components(links, "x", "y"), "ngram-roots")
        release(spark, pairs)
        if last or many.isEmpty():
            break
        still = stored(_open(many.drop("root", "n"), roots), "ngram-open")
        release(spark, left)
        left = still
    release(spark, left, texts, checked)
    return seen.where("slice is null").select("doc_id", "n_shingles", "node"), roots


def _checked(pairs: DataFrame, texts: DataFrame, n: int, num: int, den: int, few: bool = False) -> DataFrame:
    """(x, y, linked) of the pairs that pass the suffix filter; texts travel for these alone. `few`: pairs of which Spark may
    broadcast as many as its own bound allows; otherwise merge joins at every size."""

    def side(s: str, *columns: str) -> DataFrame:
        df = texts.select(F.col("node").alias(s), *(F.col(c).alias(f"{s}_{c}") for c in columns))
        return df if few else df.hint("merge")

    near = pairs.join(side("x", "size", "ranges"), "x").join(side("y", "size", "ranges"), "y")
    near = stored(near.select("x", "y", "x_size", "y_size", "x_ranges", "y_ranges").mapInArrow(_may_link(num, den), "x long, y long"), "ngram-near")
    both = near.join(side("x", "text"), "x").join(side("y", "text"), "y")
    out = stored(both.select("x", "y", "x_text", "y_text").mapInArrow(_verify(n, num, den), "x long, y long, linked boolean"), "ngram-pairs")
    release(pairs.sparkSession, near)
    return out


def _open(buckets: DataFrame, roots: DataFrame) -> DataFrame:
    """Buckets that hold sets of two components or more, with the component of each row."""
    b = buckets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    two = b.groupBy("gram").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("gram")
    return b.join(two, "gram", "left_semi")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def _side(df: DataFrame, s: str, num: int, den: int) -> DataFrame:
    """Rows of buckets with the largest size that each can link with, see _most()."""
    most = F.expr(f"(cast(size - pos as bigint) * {num + den}) div {num} - size")
    return df.select("gram", F.col("node").alias(s), F.col("size").alias(f"{s}_size"), most.alias(f"{s}_most"), F.col("root").alias(f"{s}_root"))


_NEAR = "x_size <= y_most and y_size <= x_most and x_root <> y_root"


def _pivot_pairs(b: DataFrame, num: int, den: int) -> DataFrame:
    """Each row of open buckets with another pivot: the set that comes first in a shuffled order, so
    that similar buckets have the same one."""
    pivot = b.groupBy("gram").agg(F.min_by(F.struct("node", "size", "pos", "root"), F.struct(F.xxhash64("node"), "node")).alias("p")).select("gram", "p.*")
    return _ordered(_side(b, "x", num, den).join(_side(pivot, "y", num, den), "gram").where(_NEAR))


def _cross_pairs(b: DataFrame, num: int, den: int) -> DataFrame:
    """All pairs of an open bucket's rows that are still in different components and pass the filters.
    The larger set has a size from the smaller one's to the largest that it can link with: rows meet by size class."""
    size_class = lambda c: F.floor(F.log(F.col(c).cast("double")) / float(np.log(CLASS)))
    small = _side(b, "x", num, den).where("x_most >= x_size").withColumn("class", F.explode(F.sequence(size_class("x_size"), size_class("x_most"))))
    large = _side(b, "y", num, den).withColumn("class", size_class("y_size"))
    return _ordered(small.join(large, ["gram", "class"]).where("x_size < y_size or x_size = y_size and x < y").where(_NEAR))
