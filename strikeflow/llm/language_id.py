"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1; the vector of an n-gram binds (multiplies)
its letters' vectors, each permuted by its place; a text bundles (adds) the vectors
of its n-grams, and a language those of its texts. A text gets the language whose
profile has the largest cosine with it. All sums are of whole numbers, so a profile is the same
however the work is split.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strikeflow.llm.bpe import LETTER, _classes
from strikeflow.llm.textcore import U64, buffers, mix, pieces

DIM = 1024
GRAM = 3
SEED = 20
#: Texts handled at once: bounds the table of their n-gram counts.
PIECE_TEXTS = 512


@functools.cache
def _lower() -> np.ndarray:
    """Lower case of each code point where that is one letter; 0 for all that is no letter."""
    code = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x10000):
        if not 0xD800 <= c < 0xE000:
            low = chr(c).lower()
            if len(low) == 1:
                code[c] = ord(low)
    code[_classes() != LETTER] = 0
    return code


def letter_vectors(letters: np.ndarray, dim: int) -> np.ndarray:
    """Random vectors of +1 and -1, fixed by the code point."""
    words = mix(mix(letters.astype(U64) + U64(SEED))[:, None] + np.arange(dim // 64, dtype=U64)[None, :] * U64(0x9E3779B97F4A7C15))
    bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8).reshape(len(letters), -1), axis=1)
    return bits.astype(np.int8) * 2 - 1


def bundles(texts: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The vector of each text, and its number of letters. Runs of anything but letters read
    as one blank, which also stands before and after each text."""
    data, offs = buffers(texts)
    code = _lower()[np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)]
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    at = np.searchsorted(lead, offs)
    rows = len(texts)
    row = np.repeat(np.arange(rows), np.diff(at))
    letters = np.bincount(row[code > 0], minlength=rows)
    # A blank at both ends of each row, then only the first of several blanks.
    # Ends go in first, so that a row's end comes before the next row's start.
    row = np.insert(row, np.concatenate([at[1:], at[:-1]]), np.concatenate([np.arange(rows)] * 2))
    code = np.insert(code, np.concatenate([at[1:], at[:-1]]), 0)
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] > 0) | (code[:-1] > 0) | (row[1:] != row[:-1])
    code, row = code[keep], row[keep]
    seen = np.flatnonzero(np.bincount(code)) if len(code) < 1 << 16 else np.unique(code)
    sign = np.searchsorted(seen, code)
    n = len(code) - GRAM + 1
    if n < 1 or not letters.any():
        return np.zeros((rows, dim), np.float32), letters
    k = len(seen)
    if k**GRAM > 1 << 24:  # many scripts at once: sort instead of a table of all n-grams
        gram = (sign[:n].astype(np.int64) * k + sign[1 : n + 1]) * k + sign[2:]
        good = row[:n] == row[2:]
        used, index = np.unique(gram[good], return_inverse=True)
    else:
        gram = (sign[:n] * k + sign[1 : n + 1]) * k + sign[2:]
        good = row[:n] == row[2:]
        table = np.bincount(gram[good], minlength=k**GRAM) > 0
        used = np.flatnonzero(table)
        index = (np.cumsum(table) - 1)[gram[good]]
    base = letter_vectors(seen, dim)
    bound = np.roll(base, 2, 1)[used // (k * k)] * np.roll(base, 1, 1)[used // k % k] * base[used % k]
    counts = np.bincount(row[:n][good] * len(used) + index, minlength=rows * len(used)).reshape(rows, len(used))
    return counts.astype(np.float32) @ bound.astype(np.float32), letters


def _profiles(dim: int):
    """Sums of the texts' vectors by language, one row for each task, language and dimension."""

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for piece in pieces(batches, limit=1 << 19, rows=PIECE_TEXTS):
            made, _ = bundles(piece.column("text"), dim)
            langs = np.array(piece.column("lang").to_pylist(), object)
            for lang in set(langs):
                total[lang] = total.get(lang, 0) + np.rint(made[langs == lang]).astype(np.int64).sum(0)
        for lang, v in total.items():
            yield pa.record_batch([pa.array([lang] * dim), pa.array(np.arange(dim, dtype=np.int32)), pa.array(v)], names=["lang", "dim", "value"])

    return run


def language_profiles(docs: DataFrame, dim: int = DIM) -> DataFrame:
    """(lang, dim, value) learned from the rows of `docs` with text and lang."""
    rows = docs.where("text is not null and lang is not null").select("text", "lang")
    return rows.mapInArrow(_profiles(dim), "lang string, dim int, value long").groupBy("lang", "dim").agg(F.sum("value").alias("value"))


def _predict(names: list[str], profiles: np.ndarray, dim: int):
    def run(batches):
        for piece in pieces(batches, limit=1 << 19, rows=PIECE_TEXTS):
            made, letters = bundles(piece.column("text"), dim)
            size = np.linalg.norm(made.astype(np.float64), axis=1)
            cos = made.astype(np.float64) @ profiles.T / np.maximum(size, 1e-30)[:, None] if names else np.zeros((len(made), 1))
            best = cos.argmax(1)
            known = (letters > 0) & (size > 0) & bool(names)
            lang = np.where(known, np.array([*names, "und"], object)[best if names else np.zeros(len(made), int)], "und")
            score = np.where(known, np.clip(cos.max(1), 0, 1), 0.0)
            yield pa.record_batch([piece.column("doc_id"), piece.column("held_out"), pa.array(lang.tolist(), pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify_language(docs: DataFrame, held_out, dim: int = DIM) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of `docs`.

    Profiles are learned from all rows with text and lang where the column `held_out` is not
    true; they are one vector for each language, whatever the input's size. The score is the cosine with the best profile
    (0 if negative). Null texts and texts without letters are `und` with score 0, and so
    is every text when there is nothing to learn from. Null lang or doc_id: the row is not
    learned from or is predicted like any other. Ties go to the first language by name. Repeated rows give a row each;
    other columns are ignored; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    learned: dict[str, np.ndarray] = {}
    for r in language_profiles(docs.where("not held_out"), dim).toLocalIterator():
        learned.setdefault(r["lang"], np.zeros(dim))[r["dim"]] = r["value"]
    names = sorted(k for k, v in learned.items() if v.any())
    profiles = np.array([learned[k] / np.linalg.norm(learned[k]) for k in names]).reshape(len(names), dim)
    return docs.select("doc_id", "text", "held_out").mapInArrow(_predict(names, profiles, dim), "doc_id long, held_out boolean, lang_pred string, score double")
