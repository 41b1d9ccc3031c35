"""Reading and writing histories and updates.

Layout of histories: exchange / asset / kind / timeframe / year as partition columns, so that a
read prunes to what it needs. Updates are many small files whose names carry their time. The history that the nightly job
keeps has the same partitions in versions (see versions.py), with a catalogue of them.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from strikeflow.operators.resample import bins, model_of, resample, seed_ohlc, sums_of
from strikeflow.schema import COLUMNS, FUTURE, FUTURE_DEFAULT, MEAN, OPTION, OPTION_DEFAULT, TEXT, TIMEFRAMES, struct
from strikeflow.sources.versions import Versions

PARTITIONS = ("exchange_code", "base_asset_code", "asset_type", "timeframe", "year")

#: Sums and counts that bars keep beside their means.
MEAN_PARTS = [StructField(n, t) for c, (_, rule) in COLUMNS.items() if rule == MEAN for n, t in zip(sums_of(c), (DoubleType(), LongType()), strict=True)]

#: Every column a history file may have; absent ones read as null, and a scan takes only what is asked.
HISTORY = StructType([*struct(*(c for c in COLUMNS if c not in PARTITIONS)).fields, *MEAN_PARTS, *(StructField(c, TEXT) for c in PARTITIONS[:-1]), StructField("year", IntegerType())])

#: Fixed value: names of update files.
FILE_NAME = r"(\d{4}|\d{2})-(\d{2})-(\d{2})(?:T(\d{2})(?:-(\d{2}))?)?\.parquet"


def write_history(table: DataFrame, path: str, files_per_partition: int = 1) -> None:
    """Replaces the partitions that the table has rows of, and leaves the others. Rows are dealt by partition and a
    salt, so that a large asset is written by several tasks."""
    df = table.withColumn("year", F.year("timestamp"))
    salt = F.pmod(F.xxhash64("timestamp"), F.lit(files_per_partition))
    df.repartition(*PARTITIONS, salt).write.partitionBy(*PARTITIONS).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def _period(df: DataFrame, year: int | None, on: date | None, start: datetime | None, end: datetime | None) -> DataFrame:
    t = F.col("timestamp")
    if year is not None:
        df = df.where(F.col("year") == year)
    if on is not None:
        df = df.where((F.col("year") == on.year) & (t >= F.lit(datetime(on.year, on.month, on.day))) & (t < F.date_add(F.lit(on), 1).cast("timestamp_ntz")))
    if start is not None:
        df = df.where((F.col("year") >= start.year) & (t >= F.lit(start)))
    if end is not None:
        df = df.where((F.col("year") <= end.year) & (t <= F.lit(end)))
    return df


def load_history(spark: SparkSession, path: str, kind: str, asset: str | None = None, timeframe: str | None = None, columns: Sequence[str] = (), year: int | None = None, on: date | None = None, start: datetime | None = None, end: datetime | None = None, schema: StructType = HISTORY) -> DataFrame:
    """Rows of one kind of a period: a year, a date, or an inclusive range; filters on partition columns prune files."""
    df = spark.read.schema(schema).parquet(path).where(F.col("asset_type") == kind)
    if asset is not None:
        df = df.where(F.col("base_asset_code") == asset)
    if timeframe is not None:
        df = df.where(F.col("timeframe") == timeframe)
    df = _period(df, year, on, start, end)
    return df.select(*columns) if columns else df


def load_options(spark: SparkSession, path: str, columns: Sequence[str] = OPTION_DEFAULT, **what) -> DataFrame:
    """Option history without rows that have no price."""
    return load_history(spark, path, OPTION, columns=columns, **what).dropna(subset=["price"])


def load_futures(spark: SparkSession, path: str, columns: Sequence[str] = FUTURE_DEFAULT, **what) -> DataFrame:
    return load_history(spark, path, FUTURE, columns=columns, **what)


def load_range(table: DataFrame, asset: str, start: datetime, end: datetime, by: str = "asset_code") -> DataFrame:
    """Rows of one asset in an inclusive range."""
    return table.where((F.col(by) == asset) & F.col("timestamp").between(F.lit(start), F.lit(end)))


def load_chain(table: DataFrame, underlying: str, expiration: datetime) -> DataFrame:
    """A stored chain of one expiry; empty if there is none."""
    return table.where((F.col("base_asset_code") == underlying) & (F.col("expiration_date") == F.lit(expiration)))


def list_assets(table: DataFrame, kind: str | None = None) -> DataFrame:
    df = table if kind is None else table.where(F.col("asset_type") == kind)
    return df.select("base_asset_code").distinct()


def list_years(table: DataFrame) -> DataFrame:
    """Years that a table has; from its `year` column where it has one: given a catalogue (see nightly()), nothing of the history is read."""
    year = F.col("year") if "year" in table.columns else F.year("timestamp")
    return table.select("base_asset_code", "asset_type", "timeframe", year.alias("year")).distinct()


def assets_with_options(assets: DataFrame, options: DataFrame) -> DataFrame:
    return assets.join(options.select("base_asset_code").distinct(), "base_asset_code", "left_semi")


def update_bucket(time: Column, timeframe: str) -> Column:
    """Folder and name of an update: by year for days, by month for an hour or more, else by day; the finer, the longer the name."""
    minutes = TIMEFRAMES[timeframe]
    if timeframe == "EOD":
        return F.date_format(time, "yyyy/yy-MM-dd")
    if minutes <= 30:
        return F.concat(F.year(time).cast("string"), F.lit("/"), F.month(time).cast("string"), F.lit("/"), F.dayofmonth(time).cast("string"), F.lit("/"), F.date_format(time, "yy-MM-dd'T'HH-mm"))
    name = "yy-MM-dd'T'HH-mm" if minutes <= 120 else "yy-MM-dd'T'HH"
    return F.concat(F.year(time).cast("string"), F.lit("/"), F.month(time).cast("string"), F.lit("/"), F.date_format(time, name))


def write_updates(table: DataFrame, path: str, timeframe: str, digits: int = 2) -> None:
    """Rows as update files below `path`, each named by the time of its rows, with the year in two or four digits."""
    name = F.element_at(F.split(update_bucket(F.col("timestamp"), timeframe), "/"), -1)
    century = F.substring(F.year("timestamp").cast("string"), 1, digits - 2)
    table.withColumn("file", F.concat(century, name, F.lit(".parquet"))).repartition("file").write.partitionBy("file").mode("append").parquet(path)


def update_time(path: Column) -> Column:
    """Time in an update file's name; null if it is no update file."""
    # What Spark writes under such a name is a folder of parts.
    part = lambda k: F.regexp_extract(path, r"(?:^|/|/file=)" + FILE_NAME + r"(?:/part-[^/]*)?$", k)
    year = F.when(F.length(part(1)) == 2, F.concat(F.lit("20"), part(1))).otherwise(part(1))
    or_zero = lambda k: F.when(part(k) == "", "00").otherwise(part(k))
    text = F.concat(year, F.lit("-"), part(2), F.lit("-"), part(3), F.lit(" "), or_zero(4), F.lit(":"), or_zero(5), F.lit(":00"))
    return F.when(part(1) != "", text.try_cast("timestamp_ntz"))


def updates_since(files: DataFrame, start: datetime, timeframe: str, path: str = "path", frame: str = "timeframe") -> DataFrame:
    """Update files (path, timeframe) from `start` on that are no coarser than `timeframe`."""
    minutes = F.create_map(*(F.lit(x) for pair in TIMEFRAMES.items() for x in pair))[F.col(frame)]
    return files.withColumn("file_time", update_time(F.col(path))).where((F.col("file_time") >= F.lit(start)) & (minutes <= TIMEFRAMES[timeframe]))


def nightly(spark: SparkSession, path: str) -> Versions:
    """The history that merge_updates() keeps below `path`."""
    return Versions(spark, path, StructType([f for f in HISTORY.fields if f.name in PARTITIONS]))


def _of_timeframe(catalogue: DataFrame, kind: str | None = None, timeframe: str | None = None) -> DataFrame:
    df = catalogue if kind is None else catalogue.where(F.col("asset_type") == kind)
    return df if timeframe is None else df.where(F.col("timeframe") == timeframe)


def last_update_of(catalogue: DataFrame, timeframe: str | None = None) -> datetime | None:
    """The earliest, over kinds, of the newest time, from a catalogue: no time of the history is read."""
    newest = _of_timeframe(catalogue, None, timeframe).groupBy("asset_type").agg(F.max("last").alias("newest"))
    return newest.agg(F.min("newest")).first()[0]


def newest_partitions(catalogue: DataFrame, kind: str | None = None, timeframe: str | None = None) -> DataFrame:
    """The partitions of a catalogue that hold an asset's newest time, for each exchange, asset, kind and timeframe: where
    newest chains and books are, and all that a read for them has to list."""
    by = [c for c in PARTITIONS if c != "year"]
    newest = F.max("last").over(Window.partitionBy(*by))
    return _of_timeframe(catalogue, kind, timeframe).withColumn("_newest", newest).where("last = _newest").drop("_newest")


def update_files(spark: SparkSession, path: str, timeframe: str) -> DataFrame:
    """(path, bytes, modified, file_time) of the update files below `path` that are no coarser than `timeframe`; their timeframe is a
    folder on the way to them (`.../1m/...` or `timeframe=1m`), files without one are of `timeframe`. No file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    frames = F.filter(F.regexp_extract_all("path", F.lit(r"/(?:timeframe=)?([^/]+)(?=/)"), 1), lambda part: part.isin(*TIMEFRAMES))
    frame = F.coalesce(F.try_element_at(frames, F.lit(-1)), F.lit(timeframe))
    minutes = F.create_map(*(F.lit(x) for pair in TIMEFRAMES.items() for x in pair))[frame]
    named = files.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), update_time(F.col("path")).alias("file_time"))
    return named.withColumn("_ok", minutes <= TIMEFRAMES[timeframe]).where("_ok and file_time is not null").drop("_ok")


def _read_files(spark: SparkSession, files: DataFrame, schema: StructType, timeframe: str) -> DataFrame:
    """Rows of the listed files. A night's paths go through the driver, as the list of any table's files does."""
    paths = [r["path"] for r in files.select("path").collect()]
    df = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*paths) if paths else spark.createDataFrame([], schema)
    return df.withColumns({"timeframe": F.lit(timeframe), "year": F.year("timestamp"), "bin": bins(timeframe)})


def merge_updates(spark: SparkSession, updates: str, history: str, timeframe: str, start: datetime | None = None, model: dict[str, str] | None = None, tie: Sequence[str] = (), ohlc: bool = False, slack: timedelta = timedelta(minutes=5)) -> bool:
    """The nightly job: update files become bars of their exchange, asset, kind, timeframe and year. False if there was nothing to do.

    Files are found by their names, from `start` on; without one, from the earliest, over kinds, of the newest bar of the history
    (all, if it has none), which its catalogue tells. Files that are in the history already are left out: the log of
    the history has them, so that any number of nights may list the same folder. Bins that new files have rows of are built again from all of
    their files, old and new, so first, last and mean are those of all rows however late some came; bins are only
    complete if the files that are in them are still there, else the job is refused. A file's rows lie within `slack` of
    its name's time. With `ohlc` open, high, low and close come from the price where they are not given.

    Only partitions that are touched are read and replaced, in one step together with the list of new files: a job that dies, wherever it does,
    leaves the history as it was, and can be run again.
    """
    table = nightly(spark, history)
    start = start or last_update_of(table.partitions(), timeframe)
    # Listed once, so that what arrives meanwhile is for the next night.
    files, known = update_files(spark, updates, timeframe).persist(), table.files()
    fresh = (files if start is None else files.where(F.col("file_time") >= F.lit(start))).join(known.select("path"), "path", "left_anti")
    changed = files.join(known.select("path", F.col("bytes").alias("_bytes"), F.col("modified").alias("_modified")), "path").where("bytes <> _bytes or modified <> _modified")
    fresh = fresh.persist()
    try:
        if changed.take(1):
            raise ValueError("update files have changed since they were merged; write what is new into new files")
        if not fresh.take(1):
            return False
        schema = StructType([f for f in HISTORY.fields if f.name != "year"])
        touched = _read_files(spark, fresh, schema, timeframe).select("bin").distinct().persist()
        # All files that can have rows of these bins
        width = F.expr(f"INTERVAL '{TIMEFRAMES[timeframe]}' MINUTE")
        near = touched.select((F.col("bin") - F.lit(slack)).alias("_from"), (F.col("bin") + width + F.lit(slack)).alias("_to"))
        days = near.select("_from", "_to", F.explode(F.sequence(F.to_date("_from"), F.to_date("_to"))).alias("_day"))
        whose = lambda df: df.withColumn("_day", F.to_date("file_time")).join(days, "_day").where("file_time >= _from and file_time < _to").select("path").distinct()
        if whose(known.withColumn("file_time", update_time(F.col("path")))).join(files, "path", "left_anti").take(1):
            raise ValueError("files of bins that have new rows are gone; such bins can't be built again")
        merged = fresh.select("path").union(known.select("path"))
        rows = _read_files(spark, whose(files).join(merged, "path", "left_semi"), schema, timeframe).join(touched, "bin", "left_semi")
        keys = [c for c in PARTITIONS if c != "year"] + ["asset_code"]
        rows = rows.drop("bin")
        rules = model or model_of(rows)
        made = resample(seed_ohlc(rows, rules) if ohlc else rows, timeframe, keys, rules, tie, keep_sums=True).withColumn("year", F.year("timestamp")).persist()
        # Partitions that get bars, and what else they have
        ours = made.select(*PARTITIONS).distinct()
        kept = table.read(HISTORY, table.partitions().join(ours, list(PARTITIONS), "left_semi"))
        kept = kept.join(touched.withColumnRenamed("bin", "timestamp"), "timestamp", "left_anti")
        table.write(made.unionByName(kept.select(*made.columns)), f"files-{_digest(fresh)}", fresh.select("path", "bytes", "modified"))
        made.unpersist()
        touched.unpersist()
        return True
    finally:
        fresh.unpersist()
        files.unpersist()


def _digest(files: DataFrame) -> str:
    """A name for a set of files."""
    r = files.agg(F.count("*"), F.expr("bit_xor(xxhash64(path))")).first()
    return f"{r[0]}-{r[1] & (1 << 64) - 1:016x}"
