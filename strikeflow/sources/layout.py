"""Tables laid out in buckets by moment, so that joins, chains and desks find their rows together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strikeflow.schema import MOMENT


def write_by_moment(table: DataFrame, name: str, path: str, buckets: int) -> None:
    """The table in `buckets` buckets of an asset's moments, sorted by them, one file each. Options and futures that are joined have the
    same number. A moment is some thousand rows at most, so buckets are even however much an asset has."""
    table.repartition(buckets, *MOMENT).write.bucketBy(buckets, *MOMENT).sortBy(*MOMENT).mode("overwrite").option("path", path).saveAsTable(name)


def read_by_moment(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)
