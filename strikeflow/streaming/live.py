"""Continuous ingestion of snapshots: bars, repeated instruments, late data, gaps."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from datetime import timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, StructField, StructType

from strikeflow.operators.blocks import WEEK, in_blocks
from strikeflow.operators.resample import aggregates, merge_history, ordering, resample
from strikeflow.schema import GAP_SECONDS, TIMEFRAMES
from strikeflow.sources.versions import Versions


#: Tasks that write one year.
YEAR_FILES = 16


def snapshots(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    """Arriving snapshot files as a stream; `event_time` is the timestamp in the type that watermarks need."""
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return df.withColumn("event_time", F.col("timestamp").cast("timestamp"))


def bars(stream: DataFrame, timeframe: str, keys: Sequence[str], model: dict[str, str], late: str = "1 hour", tie: Sequence[str] = ()) -> DataFrame:
    """Tumbling bars as in resample(); a bar comes out when the watermark has passed its end."""
    window = F.window("event_time", f"{TIMEFRAMES[timeframe]} minutes")
    made = stream.withWatermark("event_time", late).groupBy(*keys, window.alias("w")).agg(*aggregates(stream, model, ordering(stream, tie)))
    return made.select(*keys, F.col("w.start").cast("timestamp_ntz").alias("timestamp"), *model)


def without_repeats(stream: DataFrame, keys: Sequence[str], late: str = "1 hour") -> DataFrame:
    """Each instrument once per time, as far as the watermark remembers."""
    return stream.withWatermark("event_time", late).dropDuplicatesWithinWatermark([*keys, "timestamp"])


def run_available(stream: DataFrame, checkpoint: str, path: str | None = None, batch: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Takes in all that is there and stops; state and progress are in the checkpoint, so that a rerun goes on where it ended."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query = writer.foreachBatch(batch).start() if batch else writer.outputMode("append").format("parquet").start(path)
    query.awaitTermination()
    return query


def ingest(stream: DataFrame, checkpoint: str, path: str, by: Sequence[str] = ("asset_type", "base_asset_code")) -> StreamingQuery:
    """Every arriving row of a normalised book appended to the folder of its kind and asset; progress is in the checkpoint."""
    query = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).partitionBy(*by).outputMode("append").format("parquet").start(path)
    query.awaitTermination()
    return query


def late_history(spark: SparkSession, path: str) -> Versions:
    """The yearly history that merge_late() keeps below `path`."""
    return Versions(spark, path, StructType([StructField("year", IntegerType())]))


def merge_late(history_path: str, timeframe: str, keys: Sequence[str], model: dict[str, str], tie: Sequence[str] = (), name: str = "late") -> Callable[[DataFrame, int], None]:
    """A batch function that merges rows of any date into a yearly history (see late_history()): only the touched years are read and
    replaced, in one step. The history knows its batches by `name` and number, so a batch that comes again, in full or after a job that died, counts once;
    bars keep sums and counts of means."""

    def merge(batch: DataFrame, number: int) -> None:
        table = late_history(batch.sparkSession, history_path)
        if table.has(f"{name}-{number}"):
            return
        rows = batch.drop("event_time").withColumn("year", F.year("timestamp")).persist()
        years = table.partitions().join(rows.select("year").distinct(), "year", "left_semi")
        bare = resample(rows.limit(0), timeframe, keys, model, tie, keep_sums=True)
        schema = StructType([*bare.schema.fields, StructField("year", IntegerType())])
        old = table.read(schema, years).drop("year")
        made = merge_history(old, rows.drop("year"), timeframe, keys, model, tie).withColumn("year", F.year("timestamp"))
        table.write(made, f"{name}-{number}", salt=F.pmod(F.xxhash64(*keys), F.lit(YEAR_FILES)))
        rows.unpersist()

    return merge


def allowed_gap(timeframe: str) -> float:
    """Seconds between snapshots that are still in order."""
    return GAP_SECONDS.get(timeframe, TIMEFRAMES[timeframe] * 75)


def gaps(table: DataFrame, timeframe: str, by: str = "asset_code", width: timedelta = WEEK) -> DataFrame:
    """Snapshots that came too long after the one before; a long series is many tasks (see in_blocks())."""
    rows = in_blocks(table.select(by, "timestamp").distinct(), by, 1, width)
    before = F.lag("timestamp").over(Window.partitionBy(by, "_block").orderBy("timestamp"))
    seconds = (F.unix_micros(F.col("timestamp").cast("timestamp")) - F.unix_micros(before.cast("timestamp"))) / 1_000_000
    return rows.withColumn("seconds", seconds).where((F.col("seconds") > allowed_gap(timeframe)) & F.col("_own")).select(by, "timestamp", "seconds")


class _Feed(StatefulProcessor):
    """Of each feed the time of its last snapshot, and a timer at which the next one is due."""

    def __init__(self, by: str, limit: float):
        self.by, self.limit = by, int(limit * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "micros long")

    def _rows(self, key: tuple, lasts: list[int]) -> pd.DataFrame:
        times = pd.to_datetime(pd.Series(lasts, dtype="int64"), unit="us")
        return pd.DataFrame({self.by: pd.Series([key[0]] * len(lasts), dtype=object), "last": times, "due": times + pd.Timedelta(milliseconds=self.limit)})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        seen = sorted({int(t.value // 1000) for p in rows for t in p["timestamp"]})
        last = self.last.get()[0] if self.last.exists() else None
        fallen = []
        for t in seen:
            if last is not None and t - last > self.limit * 1000:
                fallen.append(last)
            last = t if last is None else max(last, t)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        due = -(-last // 1000) + self.limit
        if due <= timerValues.getCurrentWatermarkInMs():
            fallen.append(last)
            self.last.clear()
        else:
            self.last.update((last,))
            self.handle.registerTimer(due)
        if fallen:
            yield self._rows(key, fallen)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0]
        self.last.clear()
        yield self._rows(key, [last])

    def close(self) -> None:
        pass


def silent_feeds(stream: DataFrame, timeframe: str, by: str = "asset_code", late: str = "1 hour") -> DataFrame:
    """(by, last, due): feeds that fell silent, with their last snapshot and when the next one was due; told by a timer as soon as the
    watermark of all feeds has passed that time, or by the next snapshot if that comes first.

    State is one time and one timer for each feed that is alive, and goes with the feed: needs the RocksDB state store (see
    use_rocksdb()). `stream` has `event_time`; snapshots of a feed that come in other than their order within one batch are put
    in order, older ones than the last batch's change nothing.
    """
    schema = f"{by} string, last timestamp_ntz, due timestamp_ntz"
    rows = stream.withWatermark("event_time", late).select(by, "timestamp", "event_time")
    return rows.groupBy(by).transformWithStateInPandas(_Feed(by, allowed_gap(timeframe)), schema, "append", "eventTime")


def use_rocksdb(spark: SparkSession) -> None:
    """Streams that are started from now on keep their state in RocksDB, outside the heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def stream_gaps(stream: DataFrame, timeframe: str, by: str = "asset_code") -> DataFrame:
    """The same on a stream, with the last time of each asset as state."""
    limit = allowed_gap(timeframe)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = pd.Timestamp(state.get[0]) if state.exists else None
        times = sorted({t for p in parts for t in p["timestamp"]})
        out = []
        for t in times:
            if last is not None and t > last and (t - last).total_seconds() > limit:
                out.append((key[0], t, (t - last).total_seconds()))
            last = t if last is None else max(last, t)
        if last is not None:
            state.update((last.to_pydatetime(),))
        yield pd.DataFrame(out, columns=[by, "timestamp", "seconds"])

    schema = f"{by} string, timestamp timestamp_ntz, seconds double"
    return stream.select(by, "timestamp").groupBy(by).applyInPandasWithState(step, schema, "last timestamp_ntz", "append", GroupStateTimeout.NoTimeout)


def expected_grid(first: Column, last: Column, timeframe: str) -> Column:
    """The snapshot times between two times."""
    return F.sequence(first, last, F.expr(f"INTERVAL '{TIMEFRAMES[timeframe]}' MINUTE"))


def missing_snapshots(table: DataFrame, timeframe: str, by: Sequence[str] = ("asset_code",)) -> DataFrame:
    """Expected snapshots, between an asset's first and last one, that are not there; `timestamp` holds starts of bins."""
    ends = table.groupBy(*by).agg(F.min("timestamp").alias("a"), F.max("timestamp").alias("b"))
    grid = ends.select(*by, F.explode(expected_grid(F.col("a"), F.col("b"), timeframe)).alias("timestamp"))
    return grid.join(table.select(*by, "timestamp").distinct(), [*by, "timestamp"], "left_anti")
