import re

import corpus_pipeline as P
from strikeflow.llm.ngram_join import ngram_jaccard_join

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, counts = docs.columns, [docs.count()]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == names, name
        docs = spark.createDataFrame(out.collect(), out.schema).coalesce(1)
        counts.append(docs.count())
    assert sorted(counts, reverse=True) == counts and counts[-1] < counts[0]
    left = docs.collect()
    assert {r["doc_id"] for r in left} <= set(texts)
    # No near duplicates, no long string twice, no benchmark item.
    assert ngram_jaccard_join(docs).where("doc_id <> component_id").count() == 0
    seen = set()
    for r in sorted(left, key=lambda r: r["doc_id"]):
        raw = r["text"].encode()
        assert r["n_chars"] == len(r["text"])
        own = {raw[i : i + 400] for i in range(len(raw) - 399)}
        assert not own & seen
        seen |= own
    words = lambda t: " ".join(re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.lower()))
    items = [words(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not [r["doc_id"] for r in left if any(i in words(r["text"]) for i in items)]
    tokens = P.STAGES[-1][1](spark, docs, SF).collect()
    assert len(tokens) == len(left)


def test_odd_rows(spark, odd_docs, no_docs):
    for df in (odd_docs.withColumn("n_chars", odd_docs["doc_id"]), no_docs.withColumn("n_chars", no_docs["doc_id"])):
        for name, stage in P.STAGES:
            docs = spark.createDataFrame(df.collect(), df.schema).coalesce(1)
            out = stage(spark, docs, SF)
            assert out.count() <= df.count(), name
            if name != P.STAGES[-1][0]:
                assert out.columns == df.columns, name


def test_near_duplicates_keep_one_row_of_each_group(spark, make_prose):
    import random

    rng = random.Random(2)
    w = make_prose(rng, 120).split()
    near = lambda: " ".join([*w[:-1], make_prose(rng, 1)])
    other = make_prose(rng, 80)
    rows = [(None, near()), (None, near()), (5, near()), (7, near()), (7, other), (9, other), (None, "x y z a b c d"), (None, "x y z a b c d"), (3, None), (4, ""), (4, "")]
    df = spark.createDataFrame([(*r, i, i * 2, "v") for i, r in enumerate(rows)], "doc_id long, text string, row long, row_ long, kept_text string").coalesce(1)
    got = P.near_duplicates(spark, df, SF).collect()
    assert sorted(r["row"] for r in got) == [2, 4, 6, 8, 9, 10]
    assert all(r["row_"] == 2 * r["row"] and r["kept_text"] == "v" and r["text"] == rows[r["row"]][1] for r in got)


def test_values_of_clashing_columns_survive(spark, make_prose):
    import random

    rng = random.Random(4)
    shared = make_prose(rng, 70)
    texts = [f"{make_prose(rng, 20)} {shared} {make_prose(rng, 20)}" for _ in range(3)] + [None]
    df = spark.createDataFrame([(i, t, len(t or ""), i + 50, f"k{i}", 0.5) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long, row long, kept_text string, score double").coalesce(1)
    for stage in (P.repeated_passages, P.decontaminated, P.quality):
        out = stage(spark, df, SF)
        assert out.columns == df.columns
        assert {(r["doc_id"], r["row"], r["kept_text"], r["score"]) for r in out.collect()} <= {(i, i + 50, f"k{i}", 0.5) for i in range(4)}
    cut = {r["doc_id"]: r["text"] for r in P.repeated_passages(spark, df, SF).collect()}
    assert cut[0] == texts[0] and shared not in cut[1] and shared not in cut[2] and cut[3] is None


def test_nothing_but_the_result_is_left(spark, tmp_path, make_prose):
    """Of a whole run only the last table stays in the shared folder."""
    import pathlib
    import random

    rng = random.Random(5)
    texts = [make_prose(rng, 60) for _ in range(40)]
    texts += [t + " " + make_prose(rng, 2) for t in texts[:8]]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    from strikeflow.llm.textcore import shared_dir

    root = pathlib.Path(shared_dir(spark, "x").removeprefix("file:")).parent
    before = {p.name for p in root.iterdir()}
    out = P.run(spark, str(tmp_path))
    assert {p.name.rsplit("-", 1)[0] for p in root.iterdir() if p.name not in before} == {"pipeline-token_ids"}
    assert 30 <= out.count() <= 48


def test_rows_of_files_have_lasting_numbers(spark, tmp_path):
    from pyspark.sql import functions as F

    from strikeflow.llm.textcore import folders_made, numbered

    spark.range(1000).repartition(7).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    with folders_made() as made:
        one = numbered(df.where("id % 3 = 0"), "row", "n")
        assert not made
        numbered(df.select(F.explode(F.array("id", "id")).alias("id")), "row", "n")
        assert len(made) == 1
    small = spark.conf.get("spark.sql.files.maxPartitionBytes")
    rows = {r["id"]: r["row"] for r in one.collect()}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        assert rows == {r["id"]: r["row"] for r in numbered(df, "row", "n").where("id % 3 = 0").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", small)
    assert len(set(rows.values())) == len(rows) == 334


def test_freed_memory_of_the_driver_goes_back(spark):
    import re
    from pathlib import Path

    from strikeflow.llm.textcore import release

    jvm = spark.sparkContext._jvm
    status = Path(f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/smaps_rollup")
    held = lambda: int(re.search(r"\nAnonymous:\s+(\d+)", status.read_text())[1]) >> 10
    data = bytes(range(256)) * 4
    release(spark)
    release(spark)
    before = held()
    # Memory outside of the heap; what is freed below the last piece stays with the process.
    made = []
    for _ in range(2000):
        made.append(jvm.java.util.zip.Deflater())
        made[-1].setInput(data)
        made[-1].deflate(bytearray(16))
    grown = held() - before
    for x in made[:-1]:
        x.end()
    freed = held() - before
    release(spark)
    assert grown > 100 and freed > grown // 2 and held() - before < grown // 2, (grown, freed, held() - before)
