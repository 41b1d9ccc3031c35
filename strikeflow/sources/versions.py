"""Partitioned tables that change in whole steps.

A change writes the partitions that it touches into a folder of its own, and then a small log of them, which one rename makes visible.
Readers see all of a change or nothing; a job that dies leaves a folder that no log names, and can be run again. The log tells the batch
that made a change, so that a batch that comes twice counts once, the input files that are in it, and the times that each partition
holds, so that questions about the table's extent are answered without reading it. One job writes a table at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType, TimestampNTZType, TimestampType

BATCH, PARTITION, FILE = "batch", "partition", "file"

#: What a log says beside the partition columns, by kind of row.
LOG = StructType(
    [
        StructField("version", IntegerType()),
        StructField("kind", StringType()),
        StructField("batch", StringType()),
        StructField("path", StringType()),  # of a partition below data, or of an input file
        StructField("rows", LongType()),
        StructField("files", LongType()),
        StructField("bytes", LongType()),
        StructField("first", TimestampNTZType()),
        StructField("last", TimestampNTZType()),
        StructField("modified", TimestampType()),
    ]
)


def path_exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _rename(spark: SparkSession, source: str, target: str) -> None:
    jvm = spark.sparkContext._jvm
    a, b = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    files = a.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(b.getParent())
    if files.exists(b) or not files.rename(a, b):
        raise RuntimeError(f"{target} is there: another job has written this table")


@dataclass(frozen=True)
class Versions:
    """The table below `root`, partitioned by `by`, whose columns hold no nulls."""

    spark: SparkSession
    root: str
    by: StructType
    time: str = "timestamp"

    @property
    def keys(self) -> list[str]:
        return self.by.fieldNames()

    def log(self) -> DataFrame:
        schema = StructType([*LOG.fields, *self.by.fields])
        if not path_exists(self.spark, f"{self.root}/log"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{self.root}/log")

    def has(self, batch: str) -> bool:
        return bool(self.log().where((F.col("kind") == BATCH) & (F.col("batch") == batch)).take(1))

    def partitions(self) -> DataFrame:
        """The catalogue: each partition as it is now, with its version, path, rows, files, bytes, first and last time."""
        now = F.max_by(F.struct("version", "path", "rows", "files", "bytes", "first", "last"), "version")
        return self.log().where(F.col("kind") == PARTITION).groupBy(*self.keys).agg(now.alias("now")).select(*self.keys, "now.*")

    def files(self) -> DataFrame:
        """(path, bytes, modified) of the input files that are in the table."""
        return self.log().where(F.col("kind") == FILE).select("path", "bytes", "modified").distinct()

    def read(self, schema: StructType, chosen: DataFrame | None = None) -> DataFrame:
        """The table as it is now, or some of partitions(): no folder of another partition or version is listed or scanned.
        The paths go through the driver, as Spark's own list of a table's files does."""
        paths = [r["path"] for r in (self.partitions() if chosen is None else chosen).select("path").where("path is not null").collect()]
        if not paths:
            return self.spark.createDataFrame([], schema)
        base = f"{self.root}/data"
        return self.spark.read.schema(schema).option("basePath", base).parquet(*(f"{base}/{p}" for p in paths)).select(*schema.fieldNames())

    def write(self, rows: DataFrame, batch: str, files: DataFrame | None = None, salt: Column | None = None, helpers: tuple[str, ...] = (), file_rows: int = 0) -> bool:
        """Replaces the partitions that `rows` has rows of, as `batch`; False, and nothing done, if that batch is in the table.
        `files` (path, bytes, modified) are the input files that the rows come from. A partition is written by a task for each value of
        `salt`, which may use columns of `rows` that are `helpers` and not written; a file gets up to `file_rows` rows (0: any number)."""
        if self.has(batch):
            return False
        version = (self.log().agg(F.max("version")).first()[0] or 0) + 1
        at = f"{self.root}/data/version={version}"
        dealt = rows.repartition(*self.keys, *([] if salt is None else [salt])).drop(*helpers)
        dealt.write.partitionBy(*self.keys).option("maxRecordsPerFile", file_rows).mode("overwrite").parquet(at)
        self._publish(version, batch, self._described(dealt, at), files)
        return True

    def _described(self, rows: DataFrame, at: str) -> DataFrame:
        """A row for each partition that was written."""
        schema = StructType([*(f for f in rows.schema.fields if f.name not in self.keys), *self.by.fields])
        # Paths come as addresses, in which a plus stands for itself.
        place = F.url_decode(F.replace(F.regexp_extract("_metadata.file_path", r"/data/(version=.*)/[^/]*$", 1), F.lit("+"), F.lit("%2B")))
        made = self.spark.read.schema(schema).parquet(at).withColumns({"path": place, "file": F.col("_metadata.file_path"), "size": F.col("_metadata.file_size")})
        each = made.groupBy(*self.keys, "path", "file").agg(F.count("*").alias("n"), F.max("size").alias("size"), F.min(self.time).alias("a"), F.max(self.time).alias("b"))
        return each.groupBy(*self.keys, "path").agg(F.sum("n").alias("rows"), F.count("*").alias("files"), F.sum("size").alias("bytes"), F.min("a").alias("first"), F.max("b").alias("last"))

    def _publish(self, version: int, batch: str, parts: DataFrame, files: DataFrame | None) -> None:
        one = self.spark.createDataFrame([(BATCH,)], "kind string")
        log = one.unionByName(parts.withColumn("kind", F.lit(PARTITION)), allowMissingColumns=True)
        if files is not None:
            log = log.unionByName(files.withColumn("kind", F.lit(FILE)), allowMissingColumns=True)
        log = log.withColumns({"version": F.lit(version), "batch": F.lit(batch)})
        for f in [*LOG.fields, *self.by.fields]:
            if f.name not in log.columns:
                log = log.withColumn(f.name, F.lit(None).cast(f.dataType))
        written = f"{self.root}/_writing/{version}"
        log.select(*LOG.fieldNames(), *self.keys).coalesce(1).write.mode("overwrite").parquet(written)
        _rename(self.spark, written, f"{self.root}/log/{version:012d}")

    def compact(self, schema: StructType, most: int, target: int, batch: str) -> bool:
        """Rewrites the partitions of more than `most` files into files of some `target` bytes, as one more change; readers and
        streams that are under way keep the files that they have begun. False if no partition has so many."""
        small = self.partitions().where(F.col("files") > most)
        if not small.take(1):
            return False
        # A partition goes to as many tasks as it will have files.
        parts = small.select(*self.keys, F.greatest(F.lit(1), F.ceil(F.col("bytes") / target)).cast("int").alias("_parts"))
        rows = self.read(schema, small).join(parts, self.keys)
        return self.write(rows, batch, salt=F.pmod(F.xxhash64(self.time), F.col("_parts")), helpers=("_parts",))
