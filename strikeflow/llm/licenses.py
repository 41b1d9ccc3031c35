"""License scan by ordered signature rules.

A text is reduced to its words; hundreds of regexes look for license names, notices and
tags in the words: names with their versions follow from a list of licenses (_rules), sentences of notices are written out (NOTICES). Most texts are settled by the keyword prefilter: a rule
is tried only where all its keywords stand in the text, be it inside longer words. Every match
of a rule holds all its keywords, so that the prefilter drops none. Overlapping detections are
resolved by priority and interval containment: a detection that lies within a kept one of
the same or higher priority is dropped.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strikeflow.llm.license_notices import NOTICES
from strikeflow.llm.textcore import ALNUM, LOWER, buffers, pieces, spans

#: The three phrases that are always counted.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

NAMED = 30
NOTICE = 20
HINT = 10


def _rules() -> list[tuple[str, str, tuple[str, ...], int]]:
    """(label, regex over words joined by single blanks, keywords, priority)."""
    out: list[tuple[str, str, tuple[str, ...], int]] = []

    def rule(label: str, pattern: str, keywords: str, priority: int = NAMED) -> None:
        out.append((label, pattern, tuple(keywords.split()), priority))

    def tag(label: str, words: str) -> None:
        rule(label, rf"spdx license identifier {words}", "spdx identifier", NAMED + 10)

    digits = lambda v: v.replace(".", " ")
    for name, full, versions in (
        ("gpl", "gnu general public", ("1", "2", "3")),
        ("lgpl", "gnu (?:lesser|library) general public", ("2", "2.1", "3")),
        ("agpl", "gnu affero general public", ("1", "3")),
    ):
        for v in versions:
            w = digits(v)
            rule(f"{name}-{v}-or-later", rf"{full} licen[cs]e (?:as published by the free software foundation )?(?:either )?version {w}(?: 0)? (?:of the licen[cs]e )?or (?:at your option )?any later version", "general public later")
            rule(f"{name}-{v}-only", rf"{full} licen[cs]e (?:as published by the free software foundation )?version {w}(?: 0)? only", "general public only")
            rule(f"{name}-{v}", rf"{full} licen[cs]e (?:\w+ ){{0,6}}?v(?:ersion )?{w}\b", "general public")
            rule(f"{name}-{v}", rf"\b{name} ?v?{w}\b", name, NOTICE)
            tag(f"{name}-{v}-or-later", rf"{name} {w}(?: 0)? or later")
            tag(f"{name}-{v}-only", rf"{name} {w}(?: 0)? only")
            tag(f"{name}-{v}", rf"{name} {w}(?: 0)?\b")
        rule(name, rf"\b{full} licen[cs]e\b", "general public", NOTICE)
    for name, full, versions in (
        ("apache", "apache(?: software)? licen[cs]e", ("1.0", "1.1", "2.0")),
        ("mpl", "mozilla public licen[cs]e", ("1.0", "1.1", "2.0")),
        ("epl", "eclipse public licen[cs]e", ("1.0", "2.0")),
        ("cddl", "common development and distribution licen[cs]e", ("1.0", "1.1")),
        ("eupl", "european union public licen[cs]e", ("1.0", "1.1", "1.2")),
        ("artistic", "artistic licen[cs]e", ("1.0", "2.0")),
        ("osl", "open software licen[cs]e", ("1.0", "2.0", "2.1", "3.0")),
        ("afl", "academic free licen[cs]e", ("1.1", "1.2", "2.0", "2.1", "3.0")),
        ("cpl", "common public licen[cs]e", ("1.0",)),
        ("cecill", "cecill(?: free software)? licen[cs]e", ("1.0", "2.0", "2.1")),
        ("lppl", "latex project public licen[cs]e", ("1.0", "1.1", "1.2", "1.3")),
        ("ofl", "sil open font licen[cs]e", ("1.0", "1.1")),
        ("zpl", "zope public licen[cs]e", ("1.1", "2.0", "2.1")),
        ("php", "php licen[cs]e", ("3.0", "3.01")),
        ("psf", "python software foundation licen[cs]e", ("2.0",)),
        ("ms-pl", "microsoft public licen[cs]e", ("1.0",)),
        ("ms-rl", "microsoft reciprocal licen[cs]e", ("1.0",)),
        ("bsl", "boost software licen[cs]e", ("1.0",)),
        ("busl", "business source licen[cs]e", ("1.0", "1.1")),
        ("sspl", "server side public licen[cs]e", ("1.0",)),
        ("odbl", "open data(?:base| commons open database) licen[cs]e", ("1.0",)),
        ("odc-by", "open data commons attribution licen[cs]e", ("1.0",)),
    ):
        key = re.match(r"[a-z]+", full)[0]
        for v in versions:
            w = digits(v)
            rule(f"{name}-{v}", rf"\b{full} (?:the )?v(?:ersion )?{w}\b", f"{key} licen")
            rule(f"{name}-{v}", rf"\b{full} {w}\b", f"{key} licen")
            rule(f"{name}-{v}", rf"\blicensed under (?:the )?{name.replace('-', ' ')} (?:v(?:ersion )?)?{w}\b", "licensed under", NOTICE)
            tag(f"{name}-{v}", rf"{name.replace('-', ' ')} {w}\b")
        rule(name, rf"\b{full}\b", f"{key} licen", NOTICE)
    for kind, words in (("by", "attribution"), ("by-sa", "attribution share ?alike"), ("by-nc", "attribution non ?commercial"), ("by-nd", "attribution no ?deriv(?:ative)?s?"), ("by-nc-sa", "attribution non ?commercial share ?alike"), ("by-nc-nd", "attribution non ?commercial no ?deriv(?:ative)?s?")):
        short = kind.replace("-", " ")
        for v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            w = digits(v)
            rule(f"cc-{kind}-{v}", rf"\bcc {short} {w}\b", "cc by")
            rule(f"cc-{kind}-{v}", rf"\bcreative commons {words} {w}\b", "creative commons")
            rule(f"cc-{kind}-{v}", rf"\bcreativecommons org licenses {short} {w}\b", "creativecommons")
        rule(f"cc-{kind}", rf"\bcreative commons {words}\b", "creative commons", NOTICE)
        rule(f"cc-{kind}", rf"\bcc {short}\b", "cc by", NOTICE)
    rule("cc0", r"\bcc0(?: 1 0)?(?: universal)?\b", "cc0")
    rule("cc0", r"\bcreativecommons org publicdomain zero\b", "creativecommons publicdomain")
    for n, words in (("0", "zero"), ("1", "one"), ("2", "two"), ("3", "three"), ("4", "four")):
        rule(f"bsd-{n}-clause", rf"\b(?:bsd {n} clause|{n} clause bsd|{words} clause bsd|bsd {words} clause)\b", "clause bsd")
        tag(f"bsd-{n}-clause", rf"bsd {n} clause")
    rule("bsd-3-clause", r"\bneither the name of (?:\w+ ){1,12}?nor the names of its contributors\b", "neither contributors")
    rule("bsd", r"\bredistribution and use in source and binary forms with or without modification are permitted\b", "redistribution binary")
    rule("bsd", r"\bbsd(?: style)? licen[cs]e\b", "bsd", NOTICE)
    rule("mit", r"\bpermission is hereby granted free of charge to any person obtaining a copy\b", "hereby granted")
    rule("mit", r"\b(?:under the )?mit licen[cs]e\b", "mit licen")
    rule("mit", r"\blicensed under (?:the )?mit\b", "licensed mit", NOTICE)
    rule("isc", r"\bpermission to use copy modify and or distribute this software for any purpose\b", "permission distribute")
    rule("isc", r"\bisc licen[cs]e\b", "isc licen")
    rule("zlib", r"\bzlib(?: libpng)? licen[cs]e\b", "zlib")
    rule("zlib", r"\bprovided as is without any express or implied warranty in no event will the authors\b", "provided warranty")
    rule("unlicense", r"\bthis is free and unencumbered software released into the public domain\b", "unencumbered domain")
    rule("unlicense", r"\bthe unlicense\b", "unlicense")
    rule("wtfpl", r"\bdo what the fuck you want to public licen[cs]e\b", "want public")
    rule("wtfpl", r"\bwtfpl\b", "wtfpl")
    rule("vim", r"\bvim licen[cs]e\b", "vim licen")
    rule("ruby", r"\bruby licen[cs]e\b", "ruby licen")
    rule("beerware", r"\bbeer ?ware licen[cs]e\b", "beer licen")
    rule("public-domain", r"\b(?:released|placed|dedicated) (?:in|into|to) the public domain\b", "public domain")
    rule("public-domain", r"\bpublic domain\b", "public domain", HINT)
    rule("proprietary", r"\bproprietary and confidential\b", "proprietary confidential")
    rule("proprietary", r"\bunauthorized (?:copying|reproduction|use|distribution)\b", "unauthorized", NOTICE)
    rule("proprietary", r"\bmay not be (?:reproduced|copied|redistributed)\b", "may not", NOTICE)
    rule("copyright", r"\bcopyright (?:c )?(?:19|20)\d\d\b(?: (?:19|20)?\d\d\b)?", "copyright", NOTICE)
    rule("copyright", r"\bcopyright\b", "copyright", HINT)
    rule("licensed", r"\blicensed under the\b", "licensed under", HINT)
    rule("licensed", r"\bsee (?:the )?licen[cs]e (?:file )?for details\b", "details", HINT)
    rule("licensed", r"\bterms and conditions of the licen[cs]e\b", "terms conditions", HINT)
    for label, pattern, keywords in NOTICES:
        rule(label, pattern, keywords)
    for phrase, label in BASE.items():
        rule(label, rf"\b{phrase}\b", phrase, NAMED + 20)
    for label in ("mit", "isc", "zlib", "unlicense", "wtfpl", "vim", "ruby", "cc0 1 0", "bsl 1 0", "ncsa", "postgresql", "openssl", "curl", "x11", "ftl", "ijg", "libpng", "tcl", "w3c", "xnet", "zlib acknowledgement", "json", "icu", "hpnd", "intel", "naist 2003", "upl 1 0", "blueoak 1 0 0", "0bsd"):
        tag(label.replace(" ", "-"), label)
    return out


RULES = _rules()


@functools.cache
def _compiled():
    """An automaton of all keywords with their numbers, and for each that gates rules - the rarest-looking one of a rule - these rules."""
    import ahocorasick

    words = sorted({k for _, _, keywords, _ in RULES for k in keywords})
    number = {k: i for i, k in enumerate(words)}
    machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for k, i in number.items():
        machine.add_word(k, i)
    machine.make_automaton()
    by_gate: dict[int, list] = {}
    for label, pattern, keywords, priority in RULES:
        by_gate.setdefault(number[max(keywords, key=len)], []).append((label, re.compile(pattern), frozenset(number[k] for k in keywords), priority))
    return machine, by_gate


def keywords_in(text: str) -> set[int]:
    """Numbers of all keywords that stand in the text, be it inside longer words, found in one pass."""
    return {i for _, i in _compiled()[0].iter(text)}


def detect(words: list[str], have: set[int] | None = None) -> list[tuple[int, int, str, int]]:
    """Kept detections (first word, end, label, priority) in a list of words; `have`: the keywords that are there, if known."""
    text = " ".join(words)
    have, by_gate = keywords_in(text) if have is None else have, _compiled()[1]
    found = []
    for gate in have & by_gate.keys():
        for label, pattern, keywords, priority in by_gate[gate]:
            if keywords <= have:
                found += [(m.start(), m.end(), label, priority) for m in pattern.finditer(text)]
    if not found:
        return []
    at = np.cumsum([0, *(len(w) + 1 for w in words)])
    found = {(int(np.searchsorted(at, a, "right")) - 1, int(np.searchsorted(at, b, "left")), label, p) for a, b, label, p in found}
    kept, furthest = [], {}  # furthest: the last end so far, by priority
    for a, b, label, p in sorted(found, key=lambda x: (x[0], -x[1], -x[3], x[2])):
        if all(end < b for level, end in furthest.items() if level >= p):
            kept.append((a, b, label, p))
        furthest[p] = max(b, furthest.get(p, 0))
    return kept


def base_places(words: list[str]) -> list[tuple[int, str]]:
    """Every place where the words of a base phrase stand consecutively."""
    out = []
    for phrase, label in BASE.items():
        p = phrase.split(" ")
        at = -1
        try:
            while True:
                at = words.index(p[0], at + 1)
                if words[at : at + len(p)] == p:
                    out.append((at, label))
        except ValueError:
            pass
    return out


def covered(kept: list[tuple[int, int, str, int]]) -> int:
    """How many words lie within a detection."""
    total, last = 0, 0
    for a, b, *_ in sorted(kept):
        total += max(0, b - max(a, last))
        last = max(last, b)
    return total


def _scan(batches):
    gates = _compiled()[1].keys()
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    for piece in pieces(batches):
        data, offs = buffers(piece.column("text"))
        data = LOWER[data]
        starts, ends, bounds = spans(data, offs, ALNUM)
        rows = []
        raw = data.tobytes()
        for i in range(piece.num_rows):
            places, kept = [], []
            a, b = bounds[i], bounds[i + 1]
            # Keywords are single words: what stands in the text stands in its words.
            have = keywords_in(raw[offs[i] : offs[i + 1]].decode("utf-8", "replace"))
            if not gates.isdisjoint(have):
                words = [raw[x:y].decode("utf-8", "replace") for x, y in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True)]
                places, kept = base_places(words), detect(words, have)
            at = [x for x, _ in places]
            base = {x for _, x in places}
            rows.append((len(places), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | {x[2] for x in kept})), covered(kept) / max(1, int(b - a))))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
        cols = list(zip(*rows, strict=True))
        yield pa.record_batch([piece.column("doc_id"), pa.array(np.diff(bounds)), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=names)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for each row.

    Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the whole text with A-Z lower-cased. n_base counts all
    places of the base phrases, whatever else is found there; first_word and last_word are
    the least and largest start (null without any). labels adds what the rules detect.
    score is the share of the text's words that lie within detections: 1 for a license's own text, little for a mention in a long text. Null and
    empty texts have no words and no labels (empty strings). Repeated rows give a row each; null doc_ids stay;
    other columns are ignored; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_scan, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
