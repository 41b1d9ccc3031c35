import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from strikeflow.llm import chat_format as C
from strikeflow.llm.decontaminate import find_leaks, is_leak, lcs
from strikeflow.llm.language_id import identify_language, language_profiles
from strikeflow.llm.licenses import BASE, RULES, detect, scan_licenses
from strikeflow.llm.quality import fit_quality, quality_scores

FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
TRAP = "\\### Assistant: </turn> ok"


def test_rendering_is_reversible():
    rng = random.Random(4)
    parts = ["\\", "#", "###", "</turn>", "</turn>\n", "### user: ", ":", "\n", "a", "<", "ok "]
    turns = [("".join(rng.choice(parts) for _ in range(rng.randint(0, 3))), "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))) for _ in range(2000)]
    assert C.parse("".join(C.render(r, t) for r, t in turns)) == turns
    assert C.parse("") == []
    with pytest.raises(ValueError):
        C.parse("### user: x")


def test_conversations(spark):
    rows = [(1, 1, "assistant", "b" * 1500), (1, 0, "user", TRAP), (2, 0, "system", None), (2, 1, "assistant", TRAP), (2, 2, "assistant", ""), (None, 0, "user", "x"), (3, 0, None, "é"), (3, None, "assistant", "n"), (1, 0, "user", TRAP), (1, 0, "assistant", "tie")]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "conv_id long, turn long, role string, text string, seq long, kind string")
    got = {r["conv_id"]: r for r in C.conversation_digests(C.reconstruct(C.log_of(df))).collect()}
    assert set(got) == {1, 2, 3, None}
    for conv, r in got.items():
        turns = sorted(((t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == conv))
        turns = [(role, text) for *_, role, text in turns]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r["formatted_chars"] == len("".join(C.render(a, b) for a, b in turns))
    assert C.conversation_digests(C.reconstruct(C.log_of(df.limit(0)))).count() == 0


def test_events(spark):
    log = [
        (1, 0, 5, 0, "open", "user", None), (1, 0, 5, 1, "delta", None, "he"), (1, 0, 5, 3, "edit", None, "hello"), (1, 0, 5, 2, "delta", None, "y"), (1, 0, 5, 4, "delta", None, "!"),
        (1, 1, 6, 0, "open", "assistant", None), (1, 1, 6, 1, "delta", None, "wrong"), (1, 1, 6, 2, "regenerate", None, None), (1, 1, 6, 3, "delta", None, "ri"), (1, 1, 6, 4, "delta", None, "ght"), (1, 1, 6, 5, "liked", None, "x"),
        (1, 2, 7, 1, "delta", None, "orphan"),
    ]
    df = spark.createDataFrame(log, "conv_id long, turn long, message long, seq long, kind string, role string, text string")
    got = C.reconstruct(df).orderBy("turn").collect()
    assert [(r["role"], r["text"]) for r in got] == [("user", "hello!"), ("assistant", "right"), ("", "orphan")]


def brute_licenses(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))
    places = [(i, label) for phrase, label in BASE.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in places]
    base = sorted({label for _, label in places})
    labels = sorted(set(base) | {label for *_, label, _ in detect(w)})
    return (len(w), len(places), min(at, default=None), max(at, default=None), ",".join(base), ",".join(labels))


def test_licenses(spark, odd_docs, no_docs):
    assert len(RULES) > 200
    rng = random.Random(6)
    parts = ["CC-BY-SA 4.0", "cc by", "GNU General Public License version 3 or any later version", "All rights reserved.", "all rights", "general public", "license", "Apache License, Version 2.0", "MIT License", "copyright (c) 2020", "x", "é", "SPDX-License-Identifier: MIT", "cc cc by by"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(300)] + [None, "", "cc by " * 5000]
    rows = list(enumerate(texts)) + [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    got = scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    strip = sorted(((r["doc_id"], *tuple(r)[1:7]) for r in got), key=str)
    assert strip == sorted(((d, *brute_licenses(t)) for d, t in rows), key=str)
    assert all(0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"]) for r in got)
    assert scan_licenses(no_docs).count() == 0 and scan_licenses(odd_docs).count() == odd_docs.count()
    kept = {label for *_, label, _ in detect("gnu general public license version 2 or any later version".split())}
    assert "gpl-2-or-later" in kept and "gpl-2" not in kept


def test_language(spark, odd_docs, no_docs):
    rng = random.Random(7)
    letters = {"aa": "abcde ", "bb": "defgh ", "cc": "éèçàù "}
    rows = [(i, "".join(rng.choice(letters[lang]) for _ in range(rng.randint(40, 400))), lang) for i, lang in enumerate(list(letters) * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in identify_language(df, F.col("doc_id") % 4 == 2).collect()}
    held = [(got[i]["lang_pred"], lang) for i, _, lang in rows if got[i]["held_out"]]
    assert len(held) == 45 and all(a == b for a, b in held)
    one, two = (sorted(map(tuple, language_profiles(x).collect())) for x in (df.coalesce(1), df.repartition(7)))
    assert one == two
    odd = identify_language(odd_docs, F.col("doc_id") == 9).collect()
    assert len(odd) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in odd)
    assert {r["lang_pred"] for r in odd if r["doc_id"] in (3, 4, 5)} == {"und"}
    assert identify_language(no_docs, F.lit(False)).count() == 0
    assert {r["lang_pred"] for r in identify_language(df.withColumn("lang", F.lit(None).cast("string")), F.lit(False)).collect()} == {"und"}


def test_net_holds_its_passages_once(spark):
    import tracemalloc

    from strikeflow.llm.quality import PASSAGE_WORDS, WIDTH

    docs = spark.range(1600).select(F.col("id").alias("doc_id"), F.expr(f"array_join(transform(sequence(1, {10 * PASSAGE_WORDS}), i -> concat('w', (i * 7 + id) % 90)), ' ')").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    tracemalloc.start()
    try:
        assert fit_quality(docs, labels, F.lit(True)) is not None
        # Half of it as it came, and once as it is trained on.
        assert tracemalloc.get_traced_memory()[1] < 2.2 * (4 * WIDTH * 16000)
    finally:
        tracemalloc.stop()


def test_quality(spark, make_prose, odd_docs, no_docs):
    rng = random.Random(9)
    bad = lambda: " ".join(f"{w.upper()}!!" for w in make_prose(rng, rng.randint(30, 300)).split())
    rows = [(i, bad() if i % 4 == 0 else make_prose(rng, rng.randint(30, 300)), 0 if i % 4 == 0 else 1) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    labels = df.select("doc_id", "quality")
    net = fit_quality(df, labels.unionAll(spark.createDataFrame([(None, 1), (5, None)], labels.schema)), F.col("doc_id") % 5 != 0)
    got = quality_scores(df.select("doc_id", "text", "quality"), net).where("doc_id % 5 = 0").collect()
    assert sum((r["score"] >= 0.3) == bool(r["quality"]) for r in got) >= 0.95 * len(got)
    odd = quality_scores(odd_docs, net).collect()
    assert len(odd) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in odd) and odd[0]["x"] == "n"
    assert quality_scores(no_docs, net).count() == 0
    assert fit_quality(no_docs, labels, F.lit(True)) is None
    assert quality_scores(odd_docs, None).where("score <> 0.5").count() == 0


def test_gradients():
    import numpy as np

    from strikeflow.llm.quality import WIDTH, Net

    rng = np.random.default_rng(0)
    net, x, at, y = Net(3), rng.standard_normal((9, WIDTH)), np.array([0, 2, 5, 9]), np.array([1, 0, 1])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}

    def loss():
        z = net.forward(x, at)["logit"]
        return float(np.mean(np.log1p(np.exp(z)) - y * z))

    for k, g in net.gradients(x, at, y).items():
        i = tuple(rng.integers(0, n) for n in net.p[k].shape)
        old = net.p[k][i]
        net.p[k][i] = old + 1e-5
        up = loss()
        net.p[k][i] = old - 1e-5
        down = loss()
        net.p[k][i] = old
        assert abs((up - down) / 2e-5 - g[i]) < 1e-5


def test_lcs():
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
            row = new
        return row[-1]

    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.randrange(6) for _ in range(rng.randint(1, 40))] for _ in range(2))
        assert lcs(a, b) == plain(a, b)
    words = list(range(20))
    assert is_leak(words, words)[2] and not is_leak(words, words[:10])[2]
    assert is_leak(words, [0, 1, 2, 3, 99, 5, 98, 97, 8, 96, 10, 95, 12, 94, 14, 15, 16, 17, 18, 19])[2]


def test_leaks(spark, make_prose, odd_docs, no_docs):
    rng = random.Random(12)
    items = [(i, make_prose(rng, rng.randint(12, 70))) for i in range(30)] + [(40, None), (41, ""), (42, make_prose(rng, 150))]
    docs, want = [], set()
    for i in range(300):
        w = make_prose(rng, rng.randint(20, 500)).split(" ")
        if i % 3 == 0:
            item, text = rng.choice(items[:30] + items[-1:])
            p = text.split(" ")
            if i % 2:  # a paraphrase: a sixth of the words changed
                for k in rng.sample(range(len(p)), len(p) // 6):
                    p[k] = "other"
            at = rng.randint(0, len(w))
            w[at:at] = [x.upper() + "," for x in p]
            want.add((i, item))
        docs.append((i, " ".join(w)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert len(want - got) <= 0.05 * len(want) and not {d for d, _ in got} - {d for d, _ in want}
    assert find_leaks(odd_docs, bench).count() == 0 and find_leaks(no_docs, bench).count() == 0
    assert find_leaks(odd_docs, bench.limit(0)).count() == 0
    own = spark.createDataFrame([(1, odd_docs.where("doc_id = 1").first()["text"], "x")], "item_id long, text string, doc_id string")
    assert sorted((r["doc_id"] for r in find_leaks(odd_docs, own).collect()), key=str) == sorted([1, 2, 2, None], key=str)


def test_widespread_leaks(spark, make_prose):
    rng = random.Random(31)
    item, plain = make_prose(rng, 30), "it is for the with that on be by this in of"
    hot = " ".join([make_prose(rng, 60), item, make_prose(rng, 30)])
    docs = [(i, make_prose(rng, 300)) for i in range(300)] + [(1000 + i, hot) for i in range(150)]
    # The copies differ, so that no count over different texts tells them from others.
    docs += [(2000 + i, f"v{i} {hot} w{i}") for i in range(150)]
    rare = lambda: " ".join("".join(rng.choice("jkqvwxyz") for _ in range(9)) for _ in range(40))
    docs += [(3000, f"{rare()} {item} {rare()}"), (3001, f"{rare()} {plain} {rare()}")]
    bench = spark.createDataFrame([(1, item), (2, plain)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert got >= {(i, 1) for i, _ in docs if 1000 <= i <= 3000} and (3001, 2) in got
    assert not [i for i, item in got if item == 1 and i < 1000]


def test_leaks_of_many_items(spark, make_prose):
    rng = random.Random(33)
    lexicon = [make_prose(rng, 1) for _ in range(20000)]
    prose = lambda n: " ".join(rng.choice(lexicon) for _ in range(n))
    items = [(i, prose(40)) for i in range(1100)]
    docs = [(i, " ".join([prose(30), text, prose(30)])) for i, text in items]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert got == {(i, i) for i, _ in items}


def test_licenses_without_gates(spark, monkeypatch):
    from strikeflow.llm import licenses

    texts = ["Released under GPLv2", "LGPLv3 applies", "AGPLv3", "GPL2 or GPLv3", "the Beerware License", "beer-ware licence", "\u201cGPL v2\u201d", "\u00a9copyright\u20142020", "onlygnu General Public License version 2 onlyx", "xspdx-license-identifier: mitx", "\u201cmit license\u201d", "permit", "plain"]
    rng = random.Random(16)
    parts = sorted({w for _, pattern, keywords, _ in RULES for w in (*re.findall("[a-z0-9]+", pattern), *keywords)})
    texts += [" ".join(rng.choice(parts) for _ in range(60)) for _ in range(50)]
    # A match of each rule, as far as one is easily made.
    for _, pattern, *_ in RULES:
        plain = re.sub(r"\\b|\(\?:[^()]*\)\?|\?", "", pattern).replace("licen[cs]e", "license")
        plain = re.sub(r"\(\?:|\)|:", "", re.sub(r"\|[^()|]*", "", plain)).replace("\\d", "1")
        texts += [plain, f"\u201c{plain}\u201d"]
    words = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(FOLD)) for t in texts]
    got = [detect(w) for w in words]
    rows = scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    every = set(range(len({k for r in licenses.RULES for k in r[2]})))
    monkeypatch.setattr(licenses, "keywords_in", lambda text: every)
    want = [detect(w) for w in words]
    assert got == want and all(want[:11])
    base = [{label for phrase, label in BASE.items() if f" {phrase} " in f" {' '.join(w)} "} for w in words]
    assert {r["doc_id"]: r["labels"] for r in rows} == {i: ",".join(sorted(b | {label for *_, label, _ in w})) for i, (b, w) in enumerate(zip(base, want, strict=True))}


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", {"apache-2.0"}),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", {"mit"}),
        ("This is free and unencumbered software released into the public domain.", {"unlicense"}),
        ("Redistribution and use in source and binary forms, with or without modification, are permitted", {"bsd"}),
        ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", {"bsd-3-clause"}),
        ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", {"mpl-2.0"}),
        ("redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.", {"gpl-3-or-later", "gpl"}),
        ("You should have received a copy of the GNU Affero General Public License along with this program.", {"agpl", "gpl"}),
        ("SPDX-License-Identifier: BSD-3-Clause", {"bsd-3-clause"}),
        ("This work is licensed under CC BY-SA 4.0", {"cc-by", "cc-by-sa-4.0"}),
        ("This Font Software is licensed under the SIL Open Font License, Version 1.1.", {"ofl-1.1"}),
        ("released under the Beerware License", {"beerware"}),
        ("a story about people, apache country and public places", set()),
        ("permission to enter the general area", set()),
    ],
)
def test_labels_of_known_notices(text, labels):
    got = {label for *_, label, _ in detect(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(FOLD)))}
    # Base labels stay beside wider ones.
    assert got == labels


def test_language_against_plain_sums(spark, make_prose):
    """Profiles and scores by loops over letters and n-grams."""
    import numpy as np

    from strikeflow.llm import language_id as L

    rng = random.Random(12)
    rows = [(i, make_prose(rng, rng.randint(3, 30)) + rng.choice(["", " Ünïcode É", " 12, x"]), rng.choice(["en", "fr"])) for i in range(24)] + [(90, "", "en"), (91, "5 6", "fr"), (92, None, "en")]
    dim = 128

    def vector(text):
        letters = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else " " for c in text or "")
        s = " " + " ".join(letters.split()) + " " if letters.strip() else ""
        out = np.zeros(dim)
        code = lambda c: L.letter_vectors(np.array([0 if c == " " else ord(c)]), dim)[0].astype(int)
        for a, b, c in zip(s, s[1:], s[2:], strict=False):
            out += np.roll(code(a), 2) * np.roll(code(b), 1) * code(c)
        return out

    made = {i: vector(t) for i, t, _ in rows}
    learn = {k: sum(made[i] for i, t, lang in rows if lang == k and i % 4 and t is not None) for k in ("en", "fr")}
    cos = lambda x, y: x @ y / (np.linalg.norm(x) * np.linalg.norm(y))
    got = {r["doc_id"]: r for r in identify_language(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.col("doc_id") % 4 == 0, dim).collect()}
    for i, x in made.items():
        if not x.any():
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        score = {k: cos(x, y) for k, y in learn.items()}
        best = max(score, key=score.get)
        assert got[i]["lang_pred"] == best and abs(got[i]["score"] - max(0, score[best])) < 1e-6


def test_attention_against_plain_loops():
    """The net's score by loops over passages and units."""
    import math

    import numpy as np

    from strikeflow.llm.quality import WIDTH, Net

    rng = np.random.default_rng(4)
    net, at = Net(3), np.array([0, 1, 4, 9])
    x = rng.standard_normal((9, WIDTH)).astype(np.float32)
    p = {k: v.astype(float) for k, v in net.p.items()}
    for k, got in enumerate(net.score(x, at)):
        hidden, weight = [], []
        for row in x[at[k] : at[k + 1]]:
            h = [math.tanh(sum(float(v) * p["w"][i][j] for i, v in enumerate(row)) + p["b"][j]) for j in range(len(p["b"]))]
            gate = 0.0
            for g in range(p["v"].shape[1]):
                t = math.tanh(sum(h[j] * p["v"][j][g] for j in range(len(h))))
                s = 1 / (1 + math.exp(-sum(h[j] * p["u"][j][g] for j in range(len(h)))))
                gate += t * s * p["a"][g][0]
            hidden.append(h)
            weight.append(math.exp(gate))
        z = [sum(w * h[j] for w, h in zip(weight, hidden, strict=True)) / sum(weight) for j in range(len(p["b"]))]
        logit = sum(a * b for a, b in zip(z, p["c"][:, 0], strict=True)) + p["d"][0]
        assert abs(got - 1 / (1 + math.exp(-logit))) < 1e-5


def test_leaks_against_all_windows(spark, make_prose):
    """By the exact TF-IDF cosine of every window; common words, repeated words and paraphrases included."""
    import numpy as np

    from strikeflow.llm import decontaminate as D

    rng = random.Random(31)
    bases = [make_prose(rng, rng.randint(8, 40)) for _ in range(12)] + ["the of and to in is that for it as", "again again again again word word word again again word"]
    docs = []
    for i in range(60):
        parts = [make_prose(rng, rng.randint(0, 80))]
        if i % 2:
            w = rng.choice(bases).split()
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = "changed"
            parts += [" ".join(w), make_prose(rng, rng.randint(0, 20))]
        docs.append((i, " ".join(parts)))
    df, items = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), spark.createDataFrame(list(enumerate(bases)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in D.find_leaks(df, items).collect()}
    idf, most = D.inverse_frequencies(df.select("text"))
    import pyarrow as pa

    want, sure = set(), set()
    for i, text in docs:
        h, bounds = D.words_of(pa.array([text]))
        for k, base in enumerate(bases):
            p, _ = D.words_of(pa.array([base]))
            light = D._is_light(p, idf, most)
            a, b, _ = D._windows(bounds, D._fits(len(p)))
            for x, y in zip(a, b, strict=True):
                window = h[x:y]
                if not D.is_leak(p.tolist(), window.tolist())[2]:
                    continue
                want.add((i, k))
                both = np.unique(np.concatenate([p, window]))
                u, v = (np.array([(q == w).sum() * idf[D._cells(np.array([w]))][0] for w in both], float) for q in (p, window))
                if light or u @ v >= (D.COSINE + 1e-3) * np.linalg.norm(u) * np.linalg.norm(v):
                    sure.add((i, k))
    assert len(sure) > 20 and sure <= got <= want


def _topics(rng, make_prose, n=6):
    """Texts of a few subjects, in each of which words and their synonyms stand side by side; and of each subject (words, synonyms)."""
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8))
    topics = [([word() for _ in range(13)], [word() for _ in range(13)]) for _ in range(n)]
    texts = []
    for i in range(5 * n):
        own, other = topics[i % n]
        texts.append(" ".join(rng.sample(own + other, 18) + make_prose(rng, 30).split()))
    return topics, texts


def test_the_latent_cosine_finds_what_the_plain_one_misses(spark, make_prose):
    """Paraphrases: the weighty words of an item are exchanged for words that go with them in the corpus, its ordinary ones stay in order."""
    import numpy as np
    import pyarrow as pa

    from strikeflow.llm import decontaminate as D

    rng = random.Random(41)
    topics, texts = _topics(rng, make_prose)
    light = "the of and to in is that for it as was on with be by at this from are or an".split()
    items, docs = [], list(enumerate(texts))
    for k, (own, other) in enumerate(topics):
        small = rng.sample(light, 20)
        order = rng.sample(range(27), 13)
        item, copy, a, b = [], [], iter(zip(own, other, strict=True)), iter(small)
        for i in range(33):
            mine, its = next(a) if i in order else (None, None)
            one = next(b) if mine is None else None
            item.append(one or mine)
            copy.append(one or its)
        items.append((k, " ".join(item)))
        for j in range(5):
            docs.append((1000 + 10 * k + j, " ".join([*rng.choices(light, k=20), *copy, *rng.choices(light, k=10)])))
    docs += [(5000 + i, make_prose(rng, 40)) for i in range(200)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), spark.createDataFrame(items, "item_id long, text string")
    idf, most = D.inverse_frequencies(df.select("text"))
    heavy = [not D._is_light(D.words_of(pa.array([t]))[0], idf, most) for _, t in items]
    assert all(heavy)
    want, plain = set(), set()
    for d, text in docs:
        h, bounds = D.words_of(pa.array([text]))
        for k, t in items:
            p = D.words_of(pa.array([t]))[0]
            a, b, _ = D._windows(bounds, D._fits(len(p)))
            for x, y in zip(a, b, strict=True):
                if D.is_leak(p.tolist(), h[x:y].tolist())[2]:
                    want.add((d, k))
                    words = np.unique(np.concatenate([p, h[x:y]]))
                    u, v = (np.array([(q == w).sum() * idf[D._cells(np.array([w]))][0] for w in words], float) for q in (p, h[x:y]))
                    if u @ v >= D.COSINE * np.linalg.norm(u) * np.linalg.norm(v):
                        plain.add((d, k))
    got = {(r["doc_id"], r["item_id"]) for r in D.find_leaks(df, bench).collect()}
    print(len(want), len(plain & want), len(got & want))
    assert plain <= got <= want and len(want) >= 25
    assert len(plain) < 0.5 * len(want) and len(got) >= 0.9 * len(want)


def test_the_latent_space_is_that_of_all_passages(spark, make_prose, monkeypatch):
    """Every different text is in the SVD, once, and its products are those of the dense matrix of all passages."""
    import numpy as np
    import pyarrow as pa

    from strikeflow.llm import decontaminate as D

    rng = random.Random(43)
    texts = [make_prose(rng, rng.randint(0, 150)) for _ in range(1300)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts[:200])] + [(9999, None)], "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(1, make_prose(rng, 40))], "item_id long, text string")
    seen = []
    plain = D.latent_space

    def latent_space(given, vocabulary, idf):
        space, strength = plain(given, vocabulary, idf)
        seen.append((sorted(r["text"] or "" for r in given.collect()), vocabulary, idf, space, strength))
        return space, strength

    monkeypatch.setattr(D, "latent_space", latent_space)
    D.find_leaks(docs, bench).collect()
    used, vocabulary, idf, space, strength = seen[0]
    assert sorted(filter(None, used)) == sorted(set(filter(None, texts)))
    h = [D.words_of(pa.array([t]))[0] for t in set(texts)]
    x = D._rows([w[i : i + D.PASSAGE] for w in h for i in range(0, len(w), D.PASSAGE)], vocabulary, idf).astype(float)
    assert np.allclose(space.T @ space, np.eye(space.shape[1]), atol=1e-4)
    assert np.allclose(space.T @ (x.T @ (x @ space)), np.diag(strength), atol=1e-3 * strength[0])


def test_a_word_that_fills_a_window_is_no_candidate(monkeypatch):
    """Windows that hold one word of a passage many times are told apart by counts, none is compared; the passage itself is found."""
    import numpy as np
    import pyarrow as pa

    from strikeflow.llm import decontaminate as D

    passage = "a b c d e f g h i j"
    h, bounds = D.words_of(pa.array(["a " * 3000 + passage + " b" * 3000]))
    p = D.words_of(pa.array([passage]))[0]
    some = np.zeros(D.CELLS, bool)
    some[D._cells(p)] = True
    compared = []
    plain = D.is_leak
    monkeypatch.setattr(D, "is_leak", lambda words, window: compared.append(window) or plain(words, window))
    got = list(D._by_count(h, D._cells(h), bounds, some, [(7, p)]))
    assert {g[1] for g in got} == {7} and max(g[5] for g in got) == 1.0
    assert len(compared) < 20


def test_words_are_those_of_each_text(make_prose, monkeypatch):
    """However many bytes are cut into words together; texts that end and begin with a letter are not joined."""
    import numpy as np
    import pyarrow as pa

    from strikeflow.llm import decontaminate as D

    rng = random.Random(8)
    texts = ["", None, "a", "B", "é", " c ", None, "x" * 700] + [make_prose(rng, rng.randint(0, 90)).upper() for _ in range(60)] + ["a", ""]
    want = [D.words_of(pa.array([t], pa.string()))[0] for t in texts]
    for size in (1, 500, 1 << 20):
        monkeypatch.setattr(D, "WORDS_BYTES", size)
        h, bounds = D.words_of(pa.array(texts))
        assert np.array_equal(h, np.concatenate(want)) and np.diff(bounds).tolist() == list(map(len, want))


def test_sums_of_segments_against_dense_products():
    import numpy as np

    from strikeflow.llm import decontaminate as D

    rng = np.random.default_rng(4)
    matrix = rng.standard_normal((50, 7)).astype(np.float32)
    count = np.concatenate([rng.integers(1, 9, 40), [1, 3 * D.GATHERED]])
    starts = np.cumsum(count) - count
    index, values = rng.integers(0, 50, count.sum()), rng.random(count.sum()).astype(np.float32)
    dense = np.zeros((len(count), 50))
    np.add.at(dense, (np.repeat(np.arange(len(count)), count), index), values)
    assert np.allclose(D._sums(matrix, index, values, starts), dense @ matrix, atol=1e-2, rtol=1e-3)
    empty = np.zeros(0, np.float64)
    D._add_product(np.full((3, D.PASSAGE), -1), empty, matrix, empty)


def test_run_hashes_against_plain_sums():
    import numpy as np

    from strikeflow.llm import textcore as T

    rng = random.Random(3)
    data = np.array(rng.choices(range(256), k=3000), np.uint8)
    data = np.concatenate([data, np.full(T.PIECE_BYTES + 5, 97, np.uint8), data])
    starts, ends, _ = T.spans(data, np.array([0, len(data)]), T.SPACED)
    got = T.run_hashes(data, starts, ends)
    for a, b, h in zip(starts.tolist(), ends.tolist(), got.tolist(), strict=True):
        if b - a < 2000:
            want = sum((int(x) + 1) * pow(int(T.BASE), k, 1 << 64) for k, x in enumerate(data[a:b])) + b - a
            assert h == int(T.mix(np.array([want % (1 << 64)], np.uint64))[0])
