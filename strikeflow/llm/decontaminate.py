"""Benchmark decontamination by latent semantic retrieval.

Documents and benchmark items are compared as passages of words. TF-IDF weights come from all
passages of the corpus, copies of a text counted once; a randomised SVD of the same passages, computed as sums over their
partitions, gives the latent space. Both tell words by cells of a table of hashes: words of one cell count as one, which can add candidates and lose none. Every window of every document is then held against the
vectors of every benchmark passage of its length class: a bound on the cosine first, then the cosine. Candidates are
settled by their longest common subsequence with the passage and, for paraphrases, by
whether the passage's answer (its last words) is there as well.

A passage of ordinary words can weigh so little that even a full copy among rare words has a low
cosine. Such passages are searched by count instead: every window that holds LIKELY of their words,
in any order, goes to the common subsequence.

A passage is looked for by two vectors: its own TF-IDF vector, which finds copies, and its latent one, which the SVD makes of it: what the
passage has, through the leading directions of the corpus and their strengths, on other words that go with its own. A window in which
words are exchanged for such companions has a small plain cosine, and a latent cosine that makes it a candidate.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strikeflow.llm.textcore import ALNUM, LOWER, U64, buffers, numbered, pieces, release, run_hashes, spans, stored

#: Cells of the table of hashed passage frequencies (8 MB).
CELLS = 1 << 20
PASSAGE = 64
#: A word in more than this share of the passages has no weight in the latent space.
COMMON = 0.05
#: Lengths of windows; a benchmark passage goes with the first that is at least 1.2 times its length.
WINDOWS = (8, 12, 18, 27, 40, 60, 80)
PART_WORDS = 64
#: Leading directions of the corpus, cells of its most widespread words that they are over beside the benchmark's, and companions that a passage gets.
LATENT, LATENT_WORDS, COMPANIONS = 64, 8192, 32
#: A companion goes with the passage's words at least by this share of what the one of these that goes best with the others has.
LEAST_WEIGHT = 0.25
#: Weight of a companion that goes with the passage as well as its own words do, by the greatest of these: companions are fewer than words exchanged.
COMPANION_WEIGHT = 1.3
#: Passages that are looked for together, in one table of words.
SHARED = 256
#: Benchmark passages handled in one pass over the corpus: bounds what is broadcast.
BLOCK = 1024
#: Bytes of texts that are cut into words together: arrays of a value for each byte then stay in the processor's cache.
WORDS_BYTES = 1 << 18
#: Passages that are multiplied with a basis together, and rows that are gathered for that at a time.
PRODUCT, GATHERED = 4096, 2048
#: Rows of a matrix that is summed over tasks go to so many groups.
SLICES = 64
COSINE = 0.5
SURE, LIKELY, ANSWER_WORDS = 0.8, 0.6, 5


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of lower-cased texts, and row bounds."""
    data, offs = buffers(texts)
    hashes, bounds, row = [np.zeros(0, U64)], [np.zeros(1, np.int64)], 0
    while row < len(offs) - 1:
        end = max(row + 1, int(np.searchsorted(offs, offs[row] + WORDS_BYTES, side="right")) - 1)
        some = np.take(LOWER, data[offs[row] : offs[end]])
        starts, ends, before = spans(some, offs[row : end + 1] - offs[row], ALNUM)
        hashes.append(run_hashes(some, starts, ends))
        bounds.append(bounds[-1][-1] + before[1:])
        row = end
    return np.concatenate(hashes), np.concatenate(bounds)


def _cells(h: np.ndarray) -> np.ndarray:
    return (h & U64(CELLS - 1)).astype(np.int32)


def _by_passage(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The values of words as a sorted row of PASSAGE for each passage; passages are short of words by the -1 that come first."""
    count = -(-np.diff(bounds) // PASSAGE)
    place = np.arange(len(values)) + np.repeat((np.cumsum(count) - count) * PASSAGE - bounds[:-1], np.diff(bounds))
    out = np.full(int(count.sum()) * PASSAGE, -1, values.dtype)
    out[place] = values
    out = out.reshape(-1, PASSAGE)
    out.sort(axis=1)
    return out


def _firsts(rows: np.ndarray) -> np.ndarray:
    """Where in sorted rows a value other than -1 stands first."""
    out = rows >= 0
    out[:, 1:] &= rows[:, 1:] != rows[:, :-1]
    return out


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task: in how many passages the words of each cell stand; slice -1 counts passages."""
    seen, total = np.zeros(CELLS, np.int64), 0
    for piece in pieces(batches):
        h, bounds = words_of(piece.column("text"))
        rows = _by_passage(_cells(h), bounds)
        np.add.at(seen, rows[_firsts(rows)], 1)
        total += len(rows)
    parts = [(i, p) for i, p in enumerate(np.split(seen, 64)) if p.any()] + [(-1, np.array([total]))]
    yield pa.record_batch([pa.array([i for i, _ in parts], pa.int32()), pa.array([p.astype("<i8").tobytes() for _, p in parts], pa.binary())], names=["slice", "counts"])


def _summed(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = 0
    for b in batches:
        for c in b.column("counts").to_pylist():
            total = total + np.frombuffer(c, "<i8")
    yield pa.record_batch([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["slice", "counts"])


def frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many passages of the given texts the words of each cell stand, and the number of passages."""
    seen, total = np.zeros(CELLS), 0
    for r in texts.mapInArrow(_frequencies, "slice int, counts binary").groupBy("slice").applyInArrow(_summed, "slice int, counts binary").toLocalIterator():
        counts = np.frombuffer(r["counts"], "<i8")
        if r["slice"] < 0:
            total = int(counts[0])
        else:
            seen[r["slice"] * (CELLS // 64) : (r["slice"] + 1) * (CELLS // 64)] = counts
    return seen, total


def _weights(seen: np.ndarray, total: int) -> tuple[np.ndarray, float]:
    idf = np.log((total + 1) / (seen + 1)).astype(np.float32)
    # Of a few passages a word may be in all and still tell them apart.
    idf[seen > max(COMMON * total, 16)] = 0
    return idf, float(np.log(total + 1))


def inverse_frequencies(docs: DataFrame) -> tuple[np.ndarray, float]:
    """log((N + 1) / (n + 1)) for each cell of hashed words, from all N passages of different texts, 0 for common
    words; and the weight log(N + 1) that no word exceeds."""
    return _weights(*frequencies(docs.distinct()))


def benchmark_passages(items: list[tuple[int, str | None]]) -> list[tuple[int, np.ndarray]]:
    """(item, word hashes): items of more than PART_WORDS words are cut evenly; items without words have none."""
    out = []
    for i, text in items:
        h, _ = words_of(pa.array([text], pa.string()))
        if len(h):
            out += [(i, p) for p in np.array_split(h, -(-len(h) // PART_WORDS))]
    return out


def _rows(passages: list[np.ndarray], vocabulary: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF rows over the vocabulary's cells, of unit length."""
    x = np.zeros((len(passages), len(vocabulary)), np.float32)
    for r, p in zip(x, map(_cells, passages), strict=True):
        at = np.minimum(np.searchsorted(vocabulary, p), len(vocabulary) - 1)
        here = vocabulary[at] == p
        np.add.at(r, at[here], idf[p[here]])
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _places(vocabulary: np.ndarray) -> np.ndarray:
    """Of each cell its place in the vocabulary, or -1."""
    out = np.full(CELLS, -1, np.int16 if len(vocabulary) < 1 << 15 else np.int32)
    out[vocabulary] = np.arange(len(vocabulary))
    return out


def _sums(matrix: np.ndarray, index: np.ndarray, values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Of each segment of the entries (index, value), given by its start, the sum of value * matrix[index]: the product of a sparse matrix with a
    dense one. Segments of the same length are multiplied together."""
    count = np.diff(starts, append=len(index))
    out = np.empty((len(count), matrix.shape[1]), np.float32)
    order = np.argsort(count, kind="stable")
    cuts = [*np.flatnonzero(np.diff(count[order], prepend=-1)).tolist(), len(order)]
    for first, end in zip(cuts[:-1], cuts[1:], strict=True):
        n = int(count[order[first]])
        for k in range(first, end, max(1, GATHERED // n)):
            some = order[k : min(end, k + max(1, GATHERED // n))]
            at = starts[some][:, None] + np.arange(n)
            out[some] = np.matmul(values[at][:, None, :], matrix[index[at]])[:, 0]
    return out


def _add_product(rows: np.ndarray, weights: np.ndarray, basis: np.ndarray, total: np.ndarray) -> None:
    """Adds the product of the covariance of passages, sorted rows of places of words, with the basis."""
    at = np.flatnonzero(rows.ravel() >= 0)
    first = np.flatnonzero(_firsts(rows).ravel()[at])
    if not len(first):
        return
    word, of = rows.ravel()[at[first]], at[first] // PASSAGE
    values = weights[word] * np.diff(first, append=len(at)).astype(np.float32)
    starts = np.flatnonzero(np.diff(of, prepend=-1))
    nth = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(of)))
    values /= np.maximum(np.sqrt(np.add.reduceat(values * values, starts)), 1e-9)[nth]
    made = _sums(basis, word, values, starts)
    order = np.argsort(word, kind="stable")
    word = word[order]
    starts = np.flatnonzero(np.diff(word, prepend=-1))
    total[word[starts]] += _sums(made, nth[order], values[order], starts)


def _moments(shared):
    """Of a task's passages: the sum of a (a . basis), their part of the product of the covariance with the basis, in slices of rows."""

    def run(batches):
        vocabulary, weights, basis = shared.value
        place = _places(vocabulary)
        total, held, n = np.zeros(basis.shape, np.float64), [], 0
        for piece in pieces(batches):
            h, bounds = words_of(piece.column("text"))
            held.append(_by_passage(place[_cells(h)], bounds))
            n += len(held[-1])
            if n >= PRODUCT:
                _add_product(np.concatenate(held), weights, basis, total)
                held, n = [], 0
        if held:
            _add_product(np.concatenate(held), weights, basis, total)
        if total.any():
            parts = np.array_split(total.astype("<f4"), SLICES)
            yield pa.record_batch([pa.array(range(SLICES), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["slice", "counts"])

    return run


def _added(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = 0
    for b in batches:
        for c in b.column("counts").to_pylist():
            total = total + np.frombuffer(c, "<f4").astype(np.float64)
    yield pa.record_batch([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["slice", "counts"])


def latent_space(texts: DataFrame, vocabulary: np.ndarray, idf: np.ndarray, rank: int = LATENT) -> tuple[np.ndarray, np.ndarray]:
    """Randomised SVD: the leading right singular vectors (vocabulary x rank) of the weighted matrix of all passages of the given texts, and the squares of their singular values.
    Each of two products with the covariance is a scan of the texts, a sum over their partitions."""
    spark = texts.sparkSession
    size = min(rank + 16, len(vocabulary))
    basis = np.random.default_rng(7).standard_normal((len(vocabulary), size))
    for _ in range(2):
        basis = np.linalg.qr(basis)[0].astype(np.float32)
        shared = spark.sparkContext.broadcast((vocabulary, idf[vocabulary], basis))
        made = texts.mapInArrow(_moments(shared), "slice int, counts binary").groupBy("slice").applyInArrow(_added, "slice int, counts binary")
        product = np.zeros(basis.shape)
        rows = np.array_split(product, SLICES)
        for r in made.toLocalIterator():
            rows[r["slice"]][:] = np.frombuffer(r["counts"], np.float64).reshape(rows[r["slice"]].shape)
        shared.destroy()
        last, basis = basis, product
    strength, turn = np.linalg.eigh((last.T @ product + product.T @ last) / 2)
    # Directions that the corpus does not have would be arbitrary.
    lead = [k for k in range(size - 1, -1, -1) if strength[k] > 1e-6 * max(strength[-1], 1e-30)][:rank]
    return (last @ turn[:, lead]).astype(np.float32), strength[lead].astype(np.float32)


def _latent_cells(seen: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The cells with weight of most passages of the corpus, LATENT_WORDS at most, of two passages at least."""
    some = np.flatnonzero((seen > 1) & (idf > 0))
    return some[np.argsort(-seen[some], kind="stable")[:LATENT_WORDS]]


def with_companions(passages: list[np.ndarray], vocabulary: np.ndarray, idf: np.ndarray, space: np.ndarray, strength: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(cells, weights) that each passage's latent vector has beside its own words: those that go with these in the corpus, as its leading
    directions have it. A weight is the passage's greatest, in proportion to how well the companion goes with it."""
    out = []
    for k in range(0, len(passages), 256):
        rows = _rows(passages[k : k + 256], vocabulary, idf)
        for own, made in zip(rows, rows @ space * strength @ space.T, strict=True):
            best = made[own > 0].max(initial=0)
            made = np.where(own > 0, 0, np.minimum(made, best))
            top = np.argsort(-made, kind="stable")[:COMPANIONS]
            top = top[made[top] >= LEAST_WEIGHT * best] if best > 1e-6 else top[:0]
            out.append((vocabulary[top], COMPANION_WEIGHT * made[top] / max(best, 1e-30) * own.max(initial=0)))
    return out


def lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel in the length of a."""
    at: dict[int, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        u = v & at.get(x, 0)
        if u:
            v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def is_leak(words: list[int], window: list[int]) -> tuple[float, bool, bool]:
    """(share of the passage's words in the common subsequence, answer found, verdict)."""
    # It has at most as many words as the window has words of the passage, which most candidates tell apart already.
    most = sum(map(set(words).__contains__, window)) / len(words)
    if most < LIKELY:
        return most, False, False
    # Nor has it a word more often than the passage.
    left, most = Counter(words), 0
    for x in window:
        n = left.get(x, 0)
        if n:
            left[x] = n - 1
            most += 1
    if most < LIKELY * len(words):
        return most / len(words), False, False
    share = lcs(words, window) / len(words)
    if share < LIKELY:
        return share, False, False
    answer = words[-ANSWER_WORDS:]
    found = lcs(answer, window) >= 0.8 * len(answer)
    return share, found, share >= SURE or found


def _fits(n: int) -> int:
    """The length of the windows that a passage of n words is searched in."""
    return next((w for w in WINDOWS if w >= 1.2 * n), WINDOWS[-1])


def _is_light(passage: np.ndarray, idf: np.ndarray, most: float) -> bool:
    """Whether a window with a full copy, its other words as heavy as words get, can have a cosine below COSINE."""
    own = float((idf[_cells(passage)].astype(np.float64) ** 2).sum())
    return own <= 0 or own < COSINE * COSINE * (own + (_fits(len(passage)) - len(passage)) * most * most)


def _windows(bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, end and row of the windows of `size` words of every row; a shorter row is one window."""
    n = np.diff(bounds)
    step = max(1, size // 6)
    count = np.where(n > 0, np.maximum(0, -(-(n - size) // step)) + 1, 0)
    row = np.repeat(np.arange(len(n)), count)
    a = bounds[:-1][row] + (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * step
    return a, np.minimum(a + size, bounds[1:][row]), row


def _held(at: np.ndarray, owned: np.ndarray, of: np.ndarray) -> np.ndarray:
    """How many of the places in each row of `at` are within the number of times that its row `of` of `owned` has that place."""
    at = np.sort(at, axis=1)
    nth = np.arange(at.shape[1])
    new = np.ones(at.shape, bool)
    new[:, 1:] = at[:, 1:] != at[:, :-1]
    nth = nth - np.maximum.accumulate(np.where(new, nth, 0), axis=1)
    return (nth < owned[of[:, None], at]).sum(axis=1)


def _by_count(h: np.ndarray, cells: np.ndarray, bounds: np.ndarray, some: np.ndarray, light: list[tuple[int, np.ndarray]]) -> Iterator[tuple[int, int, int, int, None, float, bool]]:
    """(row, item, first word, end, no cosine, share, answer) of the leaks of the passages of `light`, whatever their words weigh; `some` marks
    the cells of these words."""
    vocabulary = np.unique(np.concatenate([p for _, p in light]))
    known = np.flatnonzero(some[cells])
    place = np.minimum(np.searchsorted(vocabulary, h[known]), len(vocabulary) - 1)
    here = vocabulary[place] == h[known]
    known, place = known[here], place[here]
    every = np.full(len(h), len(vocabulary), np.int32)
    every[known] = place
    nth = np.zeros(len(h) + 1, np.int64)
    nth[known + 1] = 1
    nth = np.cumsum(nth)
    for size in sorted({_fits(len(p)) for _, p in light}):
        a, b, row = _windows(bounds, size)
        low, high = nth[a], nth[b]
        for item, p in light:
            if _fits(len(p)) != size:
                continue
            owned = np.bincount(np.searchsorted(vocabulary, p), minlength=len(vocabulary) + 1)
            # A common subsequence has at most as many words as the window has words of the passage.
            held = np.zeros(len(place) + 1, np.int32)
            np.cumsum((owned > 0)[place], out=held[1:])
            words, least = p.tolist(), LIKELY * len(p)
            near = np.flatnonzero(held[high] - held[low] >= least)
            for k in range(0, len(near), 4096):
                w = near[k : k + 4096]
                at = a[w, None] + np.arange(size)
                at = np.where(at < b[w, None], every[np.minimum(at, len(every) - 1)], len(vocabulary))
                # Nor has it a word more often than the passage.
                for w in w[_held(at, owned[None], np.zeros(len(w), np.int64)) >= least].tolist():
                    share, answer, leak = is_leak(words, h[a[w] : b[w]].tolist())
                    if leak:
                        yield int(row[w]), item, int(a[w]), int(b[w]), None, share, answer


def _times(words: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """How often each word stands within `size` places of each of its own places, either way, itself included."""
    order = np.argsort(words, kind="stable")
    key = words[order].astype(np.int64) * (1 << 40) + at[order]
    out = np.empty(len(at), np.int64)
    out[order] = np.searchsorted(key, key + size - 1, "right") - np.searchsorted(key, key - size + 1)
    return out


def _by_cosine(h: np.ndarray, cells: np.ndarray, bounds: np.ndarray, weight: np.ndarray, group: tuple) -> Iterator[tuple[int, int, int, int, float, float, bool]]:
    """(row, item, first word, end, cosine, share, answer) of the leaks of the passages of a latent space. `weight`: squared weights of the words."""
    places, classes, every, owned = group
    place = places[cells]
    known = np.flatnonzero(place >= 0)
    place = place[known]
    bound = weight[known] * _times(place, known, max(c[0] for c in classes))
    less = weight * np.float64(-COSINE * COSINE)
    for size, table, owners, hashes, own, whose, least in classes:
        a, b, row = _windows(bounds, size)
        # The cosine is at most the share of the window's weight on words of the class's passages. A word that
        # stands in it c times adds c * c times its weight, and for each place _times() is at least c.
        nth = own[place]
        mine = np.flatnonzero(nth >= 0)
        at, nth = known[mine], nth[mine]
        more = less.copy()
        more[at] += bound[mine]
        sums = np.zeros(len(h) + 1)
        np.cumsum(more, out=sums[1:])
        near = np.flatnonzero(sums[b] - sums[a] >= -1e-6)
        # Only words in such windows, of the class's passages, are projected.
        low, high = np.searchsorted(at, a[near]), np.searchsorted(at, b[near])
        some = high > low
        near, low, high = near[some], low[some], high[some]
        inside = np.zeros(len(at) + 1, np.int32)
        np.add.at(inside, low, 1)
        np.add.at(inside, high, -1)
        used = np.flatnonzero(np.cumsum(inside) > 0)
        low, high = np.searchsorted(used, low), np.searchsorted(used, high)
        latent = np.zeros((len(used) + 1, table.shape[1]), np.float32)
        np.cumsum(table[nth[used]], axis=0, out=latent[1:])
        for k in range(0, len(near), 4096):
            w = near[k : k + 4096]
            inner = np.arange(size)
            word = a[w, None] + inner
            within = word < b[w, None]
            word = np.minimum(word, len(h) - 1)
            whole = np.maximum(np.where(within, weight[word], 0).sum(axis=1), 1e-9)
            cos = (latent[high[k : k + 4096]] - latent[low[k : k + 4096]]) / np.sqrt(whole)[:, None]
            found, of = np.nonzero(cos >= COSINE)
            for j in range(0, len(found), 4096):
                i, q = found[j : j + 4096], of[j : j + 4096]
                # A common subsequence has at most as many words as the window has words, or others of their cells, of the passage, and none more often than the passage.
                places_ = np.where(within[i], every[cells[word[i]]], -1) % owned.shape[1]
                likely = _held(places_, owned, whose[q]) >= least[q]
                for i, q in zip(i[likely].tolist(), q[likely].tolist(), strict=True):
                    x, y = int(a[w[i]]), int(b[w[i]])
                    share, answer, leak = is_leak(hashes[q], h[x:y].tolist())
                    if leak:
                        yield int(row[w[i]]), owners[q], x, y, min(1.0, float(cos[i, q])), share, answer


def _search(shared):
    def run(batches):
        idf, groups, light = shared.value
        groups = [(_places(vocabulary), classes, _places(every), owned) for vocabulary, classes, every, owned in groups]
        some = np.zeros(CELLS, bool)
        for _, p in light:
            some[_cells(p)] = True
        names = ["row", "doc_id", "item_id", "first_word", "n_words", "cosine", "lcs_share", "answer"]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_())
        for piece in pieces(batches):
            h, bounds = words_of(piece.column("text"))
            if not len(h):
                continue
            best: dict[tuple[int, int], tuple] = {}
            ids, rows = piece.column("doc_id").to_pylist(), piece.column("row").to_pylist()
            cells = _cells(h)
            weight = idf[cells] ** 2
            leaks = [_by_cosine(h, cells, bounds, weight, g) for g in groups]
            if light:
                leaks.append(_by_count(h, cells, bounds, some, light))
            for r, item, x, y, cosine, share, answer in (leak for some in leaks for leak in some):
                key = (r, item)
                if key not in best or best[key][6] < share:
                    best[key] = (rows[r], ids[r], item, x - int(bounds[r]), y - x, cosine, share, answer)
            if best:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*(best[k] for k in sorted(best)), strict=True), kinds, strict=True)], names=names)

    return run


_FOUND = "row long, doc_id long, item_id long, first_word long, n_words long, cosine double, lcs_share double, answer boolean"


def find_leaks(docs: DataFrame, benchmark: DataFrame, row: str | None = None) -> DataFrame:
    """(row, doc_id, item_id, first_word, n_words, cosine, lcs_share, answer): benchmark items found in documents,
    one row for each document and item, with the best matching window.

    Whole texts are searched, in words of letters and digits with A-Z lower-cased. An item is found if a window
    has a latent cosine of COSINE or more with one of its passages and holds at least
    SURE of its words in order, or LIKELY of them and its answer; passages whose words weigh too little for the
    cosine are found without it (cosine is then null). Null or empty texts and items find nothing; repeated rows are found
    each; null ids stay null; other columns are ignored; empty tables give no rows. `row` names a column that numbers the rows of `docs`, a stored
    table; without it the rows are numbered and stored here.
    The benchmark is taken to the driver in blocks of BLOCK passages; documents are not.
    """
    spark = docs.sparkSession
    if row is None:
        docs, row = numbered(docs.select("doc_id", "text"), "row", "numbered"), "row"
    docs = docs.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = seen = None
    out = None
    block: list[tuple[int, np.ndarray]] = []
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").toLocalIterator()

    def search() -> None:
        nonlocal out, texts, seen
        if texts is None:
            # Read three times: for frequencies and both products of the SVD.
            texts = stored(docs.select("text").distinct(), "texts")
            seen = frequencies(texts)
        found = _block(docs, texts, block, *seen)
        out = found if out is None else out.unionAll(found)
        block.clear()

    for r in items:
        block += benchmark_passages([(r["item_id"], r["text"])])
        if len(block) >= BLOCK:
            search()
    if block:
        search()
    if out is None:
        return spark.createDataFrame([], _FOUND)
    release(spark, texts)
    return out


def _block(docs: DataFrame, texts: DataFrame, block: list[tuple[int, np.ndarray]], seen: np.ndarray, total: int) -> DataFrame:
    idf, most = _weights(seen, total)
    light = [(i, p) for i, p in block if _is_light(p, idf, most)]
    block = [(i, p) for i, p in block if not _is_light(p, idf, most)]
    groups = []
    if block:
        own = np.unique(_cells(np.concatenate([p for _, p in block])))
        vocabulary = np.union1d(own[idf[own] > 0], _latent_cells(seen, idf))
        companions = with_companions([p for _, p in block], vocabulary, idf, *latent_space(texts, vocabulary, idf))
        groups = [_group(block[k : k + SHARED], companions[k : k + SHARED], idf) for k in range(0, len(block), SHARED)]
    return docs.mapInArrow(_search(docs.sparkSession.sparkContext.broadcast((idf, groups, light))), _FOUND)


def _group(block: list[tuple[int, np.ndarray]], companions: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray) -> tuple:
    """(vocabulary, classes of windows, all cells, how often each passage has which) of at most SHARED passages; each has its own vector and, if it has companions, its latent one.
    A class has the weighted vectors over the words that any of them has."""
    vocabulary = np.unique(np.concatenate([_cells(p) for _, p in block] + [w for w, _ in companions]))
    vocabulary = vocabulary[idf[vocabulary] > 0]
    plain = _rows([p for _, p in block], vocabulary, idf)
    of = [i for i, (w, _) in enumerate(companions) if len(w)]
    latent = plain[of]
    for row, i in zip(latent, of, strict=True):
        words, weights = companions[i]
        row[np.searchsorted(vocabulary, words)] += weights
    vectors = np.concatenate([plain, latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)])
    whose = np.array([*range(len(block)), *of], np.int64)
    # Words without weight count in common subsequences; the last column is that of other words.
    every = np.unique(np.concatenate([_cells(p) for _, p in block]))
    owned = np.zeros((len(block), len(every) + 1), np.int16)
    for r, (_, p) in zip(owned, block, strict=True):
        np.add.at(r, np.searchsorted(every, _cells(p)), 1)
    classes = []
    fits = np.array([_fits(len(block[i][1])) for i in whose])
    for w in WINDOWS:
        here = np.flatnonzero(fits == w)
        if len(here):
            some = np.flatnonzero((vectors[here] != 0).any(axis=0))
            own = np.full(len(vocabulary), -1, np.int32)
            own[some] = np.arange(len(some))
            table = np.ascontiguousarray((vectors[np.ix_(here, some)] * idf[vocabulary[some]]).T)
            classes.append((w, table, [block[i][0] for i in whose[here]], [block[i][1].tolist() for i in whose[here]], own, whose[here], LIKELY * np.array([len(block[i][1]) for i in whose[here]])))
    return vocabulary, classes, every, owned
