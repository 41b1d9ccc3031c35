"""From raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet
in the shared folder and reads back for the next one. All but the last keep the columns of
documents. Rows with null texts are kept as texts without words; an empty table stays empty.

What a stage stores on the way is removed when the next one begins, by which time its result is to be
written; folders that the next one's documents are read from stay.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strikeflow.llm.bpe import bpe_round_trip
from strikeflow.llm.decontaminate import find_leaks
from strikeflow.llm.ngram_join import ngram_jaccard_join
from strikeflow.llm.quality import fit_quality, quality_scores
from strikeflow.llm.suffix_dedup import suffix_dedup
from strikeflow.llm.textcore import drop_folders, folders_made, numbered, release, shared_dir

#: Documents with a lower score go.
QUALITY = 0.3
#: Repeated strings of this many bytes are cut but for their first copy; passages of 50 words are longer.
REPEAT_BYTES = 200

#: Not expressible in SQL: trained scores, suffix order and BPE merges.
ORACLE_SQL = None


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Folders that the last stage left.
_left: list[str] = []


def _clear(spark: SparkSession, docs: DataFrame | None = None) -> None:
    read = {f.rsplit("/", 1)[0] for f in docs.inputFiles()} if _left and docs is not None else set()
    name = lambda path: path.rsplit("/", 1)[-1]
    done = [p for p in _left if name(p) not in set(map(name, read))]
    drop_folders(spark, done)
    _left[:] = [p for p in _left if p not in done]


def _stage(f: Stage) -> Stage:
    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _clear(spark, docs)
        release(spark)
        with folders_made() as made:
            out = f(spark, docs, sf_dir)
        _left.extend(made)
        return out

    return run_stage


def _free(docs: DataFrame, name: str) -> str:
    """A column name that the documents do not have."""
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    return name


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the quality classifier, trained on the labels of four fifths of them, accepts.

    Null and empty texts are scored like any other; whole texts are read, however long. Equal texts have equal scores, so repeated
    rows stay or go together; a score of exactly QUALITY stays. Where no labels fit, all stay. A column
    named like the score is left as it is.
    """
    net = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    score = _free(docs, "score")
    return quality_scores(docs, net, score).where(F.col(score) >= QUALITY).select(docs.columns)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates: that of the smallest doc_id, then the first row; null doc_ids come last.

    Rows without words are linked with nothing and stay. Repeated rows are one group, and so are different texts under one doc_id only if they are linked. Other columns
    stay as they are, whatever their names.
    """
    row = _free(docs, "row")
    docs = numbered(docs, row, "near-duplicates")
    groups = ngram_jaccard_join(docs.select(F.col(row).alias("doc_id"), "text")).where("n_shingles > 0")
    place = F.struct(F.col("id").isNull().alias("last"), "id", "at")
    named = groups.select(F.col("doc_id").alias("at"), "component_id").join(docs.select(F.col(row).alias("at"), F.col("doc_id").alias("id")), "at")
    firsts = named.groupBy("component_id").agg(F.min(place).alias("first")).select(F.col("first.at").alias("at"))
    others = named.select("at").join(firsts, "at", "left_anti").withColumnRenamed("at", row)
    return docs.join(others, row, "left_anti").drop(row)


@_stage
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out passages of REPEAT_BYTES bytes and more that stand in an earlier document or further up; every row stays, if with less text.

    Earlier is by doc_id (null first), then row: of repeated rows the first keeps its text. Null and short texts stay as they are;
    n_chars is counted anew where a text is cut. Other columns stay as they are, whatever their names.
    """
    row, kept = _free(docs, "row"), _free(docs, "kept_text")
    docs = numbered(docs, row, "repeated-passages")
    cut = suffix_dedup(docs.select(row, "doc_id", "text"), REPEAT_BYTES, keep_first=True, row=row).where("n_removed > 0").select(F.col("row").alias(row), F.col("kept_text").alias(kept))
    rows = docs.join(cut, row, "left")
    same = F.col(kept).isNull()
    text = F.when(same, F.col("text")).otherwise(F.col(kept))
    n_chars = F.when(same, F.col("n_chars")).otherwise(F.length(kept).cast("long"))
    return rows.withColumns({"text": text, "n_chars": n_chars}).drop(row, kept)


@_stage
def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows in which a benchmark item is found, as find_leaks() has it.

    Null and empty texts stay; whole texts are searched; of repeated rows all go. An item that just reaches a bound
    is found. Other columns stay as they are, whatever their names.
    """
    row = _free(docs, "row")
    docs = numbered(docs, row, "decontaminated")
    leaks = find_leaks(docs.select(row, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), row=row)
    return docs.join(leaks.select(F.col("row").alias(row)).distinct(), row, "left_anti").drop(row)


@_stage
def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded bytes, one row for each row; null texts count as empty, other columns are left out."""
    import public_tokenizers

    return bpe_round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontaminated", decontaminated),
    ("token_ids", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. A stage's table goes when the next one is written, with all that was stored for it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        path = shared_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        _clear(spark)
        release(spark, *([before] if before is not None else []))
        before = docs = spark.read.parquet(path)
    return docs
