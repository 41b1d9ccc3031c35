"""Registered queries that write tables or run streams; the SQL gives the batch result."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strikeflow.jobs import views as V
from strikeflow.functions import normalize as N
from strikeflow.jobs.catalog import BOOK, BOOK_SQL, KEYS, NEWEST, OHLC, PARSED, SPLIT, _bars_sql, _raw_book, query
from strikeflow.operators import chain as C
from strikeflow.operators import resample as R
from strikeflow.operators.enrich import add_intrinsic_value, add_time_value, join_by_moment
from strikeflow.operators.guards import refuse, watched
from strikeflow.schema import CHAIN
from strikeflow.sources import history as H
from strikeflow.sources.layout import read_by_moment, write_by_moment
from strikeflow.sources.shared import shared_dir
from strikeflow.streaming import live as L

YEAR = 1996


@query(f"WITH {V.OPTIONS} SELECT base_asset_code, timestamp, expiration_date, option_type, strike, price FROM options WHERE base_asset_code = 'Brand#11' AND timestamp BETWEEN TIMESTAMP '1995-06-01' AND TIMESTAMP '1996-06-01'")
def history_round_trip(spark, d):
    """Options and futures written to the partitioned layout and read back for one asset and an inclusive range."""
    tags = {"exchange_code": F.lit("x"), "timeframe": F.lit("EOD")}
    path = shared_dir(spark, "history")
    H.write_history(V.options(spark, d).withColumns({**tags, "asset_type": F.lit("o")}), path)
    H.write_history(V.futures(spark, d).withColumns({**tags, "asset_type": F.lit("f")}), path)
    return H.load_options(spark, path, (*CHAIN, "option_type", "strike", "price"), asset="Brand#11", timeframe="EOD", start=datetime(1995, 6, 1), end=datetime(1996, 6, 1))


@query(f"WITH {V.QUOTES}, {V.FUTURES} SELECT base_asset_code, timestamp, expiration_date, price FROM futures WHERE year(timestamp) = {YEAR}")
def futures_year(spark, d):
    """One year of all futures, from the partitioned layout."""
    path = shared_dir(spark, "history")
    H.write_history(V.futures(spark, d).withColumns({"exchange_code": F.lit("x"), "timeframe": F.lit("EOD"), "asset_type": F.lit("f")}), path)
    return H.load_futures(spark, path, (*CHAIN, "price"), year=YEAR)


@query(f"WITH {V.OPTIONS} SELECT base_asset_code, timestamp, expiration_date, option_type, strike, price FROM options WHERE volume >= 10 AND year(timestamp) = {YEAR}")
def priced_options_year(spark, d):
    """A year of options from the partitioned layout; rows stored without a price are left out."""
    path = shared_dir(spark, "history")
    o = V.options(spark, d).withColumn("price", F.when(F.col("volume") >= 10, F.col("price")))
    H.write_history(o.withColumns({"exchange_code": F.lit("x"), "timeframe": F.lit("EOD"), "asset_type": F.lit("o")}), path)
    return H.load_options(spark, path, (*CHAIN, "option_type", "strike", "price"), year=YEAR)


#: Update rows: quotes at the first three days of a quarter, at midnight and noon. A quarter of those of the last day before a night come a night late; others,
#: of days that are long over, come in the last night and are not taken, as they lie before its start.
NIGHTS = (datetime(1997, 1, 1), datetime(1998, 1, 1))
LATE = "l_suppkey % 4 = 0 AND timestamp >= TIMESTAMP '{0}-10-03' AND timestamp < TIMESTAMP '{1}-01-01'"
TOO_LATE = "l_suppkey % 4 = 1 AND timestamp < TIMESTAMP '1995-01-01'"
UPDATES = f"""{V.QUOTES}, updates AS (SELECT substring(base_asset_code, 1, 7) AS base_asset_code, base_asset_code || '-' || option_type AS asset_code, CAST(date_trunc('quarter', original_timestamp) + to_days(CAST(l_linenumber % 3 AS INTEGER)) + to_hours(CAST(12 * (l_orderkey % 2) AS INTEGER)) AS TIMESTAMP) AS timestamp,
  original_timestamp, premium AS price, volume, CASE WHEN bid IS NOT NULL THEN volume END AS iv, l_suppkey FROM quotes)"""
ORDER = "(timestamp, original_timestamp, price, volume)"


@query(
    f"""WITH {UPDATES} SELECT base_asset_code, asset_code, CAST(date_trunc('day', timestamp) AS TIMESTAMP) AS timestamp, CAST(year(timestamp) AS INTEGER) AS year, arg_min(price, {ORDER}) AS open, max(price) AS high, min(price) AS low, arg_max(price, {ORDER}) AS close,
      arg_max(price, {ORDER}) AS price, arg_max(volume, {ORDER}) AS volume, avg(iv) AS iv, count(iv) AS iv_count FROM updates WHERE NOT ({TOO_LATE}) GROUP BY 1, 2, 3, 4"""
)
def nightly_merge(spark, d):
    """Three nights over one growing folder of update files: each finds its start in the history and takes files that are new from there on.
    Bars, first and last prices and means are those of all rows that were taken, each once, though bins are touched twice."""
    q = V.quotes(spark, d)
    time = F.expr("cast(cast(date_trunc('quarter', original_timestamp) as timestamp_ntz) + make_dt_interval(l_linenumber % 3, 12 * (l_orderkey % 2)) as timestamp_ntz)")
    rows = q.select(
        F.lit("x").alias("exchange_code"), F.substring("base_asset_code", 1, 7).alias("base_asset_code"), F.lit("o").alias("asset_type"), F.concat_ws("-", "base_asset_code", "option_type").alias("asset_code"), time.alias("timestamp"), "original_timestamp",
        F.col("premium").alias("price"), "volume", F.when(F.col("bid").isNotNull(), F.col("volume")).alias("iv"), "l_suppkey",
    )
    after = sum((F.when(F.col("timestamp") >= F.lit(n), 1).otherwise(0) for n in NIGHTS), F.lit(0))
    late = F.expr(LATE.format(1996, 1997)) | F.expr(LATE.format(1997, 1998))
    night = F.when(F.expr(TOO_LATE), 2).otherwise(after + F.when(late, 1).otherwise(0))
    # Quotes are made once, a folder for each night.
    nights = shared_dir(spark, "nights")
    rows = rows.withColumn("night", night).drop("l_suppkey")
    rows.write.partitionBy("night").parquet(nights)
    rows = spark.read.schema(rows.schema).parquet(nights)
    model = {"original_timestamp": "last", "open": "first", "high": "max", "low": "min", "close": "last", "price": "last", "volume": "last", "iv": "mean"}
    history, updates = shared_dir(spark, "history"), shared_dir(spark, "updates")
    for k in range(3):
        H.write_updates(rows.where(F.col("night") == k).drop("night"), f"{updates}/1h", "1h", digits=4)
        H.merge_updates(spark, updates, history, "EOD", model=model, tie=("price", "volume"), ohlc=True)
    made = H.nightly(spark, history).read(H.HISTORY)
    return made.select("base_asset_code", "asset_code", "timestamp", "year", "open", "high", "low", "close", "price", "volume", "iv", "iv_count")


def _kept_history(spark, d, file_rows: int = 0):
    """Options in a history with a catalogue, written in two changes, in files of up to so many rows."""
    table = H.nightly(spark, shared_dir(spark, "history"))
    o = V.enriched(spark, d).withColumns({"exchange_code": F.lit("x"), "timeframe": F.lit("EOD"), "asset_type": F.lit("o"), "year": F.year("timestamp")})
    for k, part in enumerate((o.where(F.col("year") < YEAR), o.where(F.col("year") >= YEAR))):
        table.write(part, f"part-{k}", file_rows=file_rows)
    return table


@query(f"WITH {V.OPTIONS} SELECT base_asset_code, 'o' AS asset_type, 'EOD' AS timeframe, CAST(year(timestamp) AS INTEGER) AS year, count(*) AS rows, CAST(min(timestamp) AS TIMESTAMP) AS first, CAST(max(timestamp) AS TIMESTAMP) AS last, max(max(timestamp)) OVER () AS last_update FROM options GROUP BY 1, 4")
def history_catalogue(spark, d):
    """Assets, years and extents of a written history, and the time from which updates are to be merged: from its catalogue, no file of the history is opened."""
    table = _kept_history(spark, d)
    catalogue = table.partitions()
    return catalogue.select("base_asset_code", "asset_type", "timeframe", "year", "rows", "first", "last", F.lit(H.last_update_of(catalogue, "EOD")).cast("timestamp_ntz").alias("last_update"))


@query(f"WITH {V.ENRICHED}, {NEWEST} SELECT {KEYS}, option_type, strike, price, underlying_price, price_status FROM chains")
def newest_chain_of_history(spark, d):
    """The newest chain of each asset from a written history: only the partitions with an asset's newest time are listed and read."""
    table = _kept_history(spark, d)
    schema = StructType([*(f for f in H.HISTORY.fields if f.name in (*CHAIN, "option_type", "strike", "price", "underlying_price", "price_status")), *(f for f in H.HISTORY.fields if f.name in ("year",))])
    rows = table.read(schema, H.newest_partitions(table.partitions(), "o", "EOD"))
    return C.select_chain(rows).select(*CHAIN, "option_type", "strike", "price", "underlying_price", "price_status")


@query(f"WITH {V.OPTIONS} SELECT base_asset_code, CAST(year(timestamp) AS INTEGER) AS year, count(*) AS rows, sum(volume) AS volume, 1::BIGINT AS files FROM options GROUP BY 1, 2")
def compacted_history(spark, d):
    """A history of many small files, packed into one file for each partition; rows are the same."""
    table = _kept_history(spark, d, 50)
    table.compact(H.HISTORY, 1, 1 << 27, "compaction")
    files = table.partitions().select("base_asset_code", "year", "files")
    return table.read(H.HISTORY).groupBy("base_asset_code", "year").agg(F.count("*").alias("rows"), F.sum("volume").alias("volume")).join(files, ["base_asset_code", "year"])


@query(
    f"""WITH {V.ENRICHED} SELECT {KEYS}, strike, max(price) FILTER (option_type = 'c') AS price_call, max(price) FILTER (option_type = 'p') AS price_put, max(price_status) FILTER (option_type = 'c') AS price_status_call,
      max(price_status) FILTER (option_type = 'p') AS price_status_put, max(timed_value) FILTER (option_type = 'c') AS timed_value_call, max(timed_value) FILTER (option_type = 'p') AS timed_value_put FROM enriched GROUP BY 1, 2, 3, 4"""
)
def desk_by_moment(spark, d):
    """Join with futures, time value, moneyness and desk over tables laid out by moment: nothing is exchanged between them."""
    names = {k: f"{k}_{shared_dir(spark, 'x').rsplit('-', 1)[1]}" for k in ("options", "futures")}
    for k, table in (("options", V.options(spark, d)), ("futures", V.futures(spark, d))):
        write_by_moment(table, names[k], shared_dir(spark, k), 8)
    o, f = (read_by_moment(spark, names[k]) for k in ("options", "futures"))
    rows = C.add_moneyness(add_time_value(add_intrinsic_value(join_by_moment(o, f))))
    return C.desk(rows, ("price", "price_status", "timed_value"))


@query(f"WITH {PARSED} SELECT count(*) AS rows, count(CASE WHEN parse_error THEN 1 END) AS parse_error, count(CASE WHEN last IS NULL AND bid IS NULL AND ask IS NULL THEN 1 END) AS no_price FROM p")
def watched_book(spark, d):
    """Faults of a normalised book, counted while it is written."""
    book = N.normalize_book(_raw_book(spark, d), F.current_timestamp())
    df, seen = watched(book.select(*BOOK, "parse_error"), parse_error=F.col("parse_error"), no_price=F.col("price").isNull())
    df.write.parquet(shared_dir(spark, "book"))
    counts = refuse(seen, parse_error=0.5, no_price=0.5)
    return spark.createDataFrame([(counts["rows"], counts["parse_error"], counts["no_price"])], "rows long, parse_error long, no_price long")


@query(BOOK_SQL)
def stream_normalized(spark, d):
    """Arriving snapshots normalised and appended to the folder of their kind and asset."""
    schema = spark.read.parquet(f"{d}/lineitem.parquet").schema
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", 100).parquet(f"{d}/lineitem.parquet*")
    path = shared_dir(spark, "sink")
    s = N.normalize_book(_raw_book(spark, d, raw), F.current_timestamp()).select(*BOOK)
    L.ingest(s, shared_dir(spark, "progress"), path)
    return spark.read.schema(s.schema).parquet(path).select(*BOOK)


def _stream(spark, d):
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", 100).parquet(f"{d}/events.parquet*")
    t = raw.select(F.concat(F.lit("A"), F.col("user_id").cast("string")).alias("asset_code"), F.col("ts").alias("timestamp"), F.col("value").alias("price"), "event_id", "event_type")
    return t.withColumn("event_time", F.col("timestamp").cast("timestamp"))


@query(f"WITH {V.TICKS} SELECT event_type, asset_code, event_id, timestamp, price FROM ticks")
def stream_ingest(spark, d):
    """Every arriving row appended by kind."""
    path = shared_dir(spark, "sink")
    s = _stream(spark, d).drop("event_time")
    L.run_available(s, shared_dir(spark, "progress"), path)
    return spark.read.schema(s.schema).parquet(path).select("event_type", "asset_code", "event_id", "timestamp", "price")


@query(f"WITH {V.TICKS}, b AS ({_bars_sql(1440)}) SELECT * FROM b WHERE timestamp + INTERVAL 1 DAY <= (SELECT max(timestamp) - INTERVAL 1 HOUR FROM ticks)")
def stream_bars(spark, d):
    """Daily bars of the stream: those that the watermark has closed."""
    s = R.seed_ohlc(_stream(spark, d))
    made = L.bars(s, "EOD", ["asset_code"], OHLC, "1 hour", ("event_id",))
    path = shared_dir(spark, "sink")
    L.run_available(made, shared_dir(spark, "progress"), path)
    return spark.read.schema(made.schema).parquet(path)


@query(f"WITH {V.TICKS} SELECT asset_code, timestamp, min(price) AS price FROM ticks GROUP BY 1, 2")
def stream_without_repeats(spark, d):
    s = _stream(spark, d)
    twice = s.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    made = L.without_repeats(twice, ["asset_code"]).select("asset_code", "timestamp", "price")
    path = shared_dir(spark, "sink")
    L.run_available(made, shared_dir(spark, "progress"), path)
    return spark.read.schema(made.schema).parquet(path)


LATE_BARS = "asset_code string, timestamp timestamp_ntz, open double, high double, low double, close double, price double, iv double, iv_sum double, iv_count long, year int"


@query(f"WITH {V.TICKS}, b AS ({_bars_sql(1440)}), m AS (SELECT asset_code, time_bucket(INTERVAL '1440 minutes', timestamp, TIMESTAMP '2000-01-01') AS timestamp, round(avg(price), 6) AS mean FROM ticks GROUP BY 1, 2) SELECT * FROM b JOIN m USING (asset_code, timestamp)")
def late_merge(spark, d):
    """Late rows merged into the yearly history of bars: first the one half of the events, then the other as a stream; batches that come again count once, means included."""
    path = shared_dir(spark, "history")
    merge = L.merge_late(path, "EOD", ["asset_code"], OHLC | {"iv": "mean"}, ("event_id",))
    seeded = lambda df: R.seed_ohlc(df).withColumn("iv", F.col("price"))
    first = seeded(V.ticks(spark, d)).where(F.col("timestamp") < F.lit(SPLIT))
    merge(first, -1)
    merge(first, -1)

    def twice(batch, number):
        merge(batch, number)
        merge(batch, number)

    L.run_available(seeded(_stream(spark, d)).where(F.col("timestamp") >= F.lit(SPLIT)), shared_dir(spark, "progress"), batch=twice)
    made = L.late_history(spark, path).read(spark.createDataFrame([], LATE_BARS).schema)
    return made.withColumn("mean", F.round("iv", 6)).select("asset_code", "timestamp", "open", "high", "low", "close", "price", "mean")


GAPS = f"{V.TICKS}, s AS (SELECT DISTINCT asset_code, timestamp FROM ticks), g AS (SELECT asset_code, timestamp, (epoch_us(timestamp) - epoch_us(lag(timestamp) OVER (PARTITION BY asset_code ORDER BY timestamp))) / 1000000.0 AS seconds FROM s)"


@query(f"WITH {GAPS} SELECT asset_code, timestamp, CAST(seconds AS DOUBLE) AS seconds FROM g WHERE seconds > {25 * 3600}")
def snapshot_gaps(spark, d):
    return L.gaps(V.ticks(spark, d), "EOD")


@query(f"WITH {GAPS} SELECT asset_code, timestamp, CAST(seconds AS DOUBLE) AS seconds FROM g WHERE seconds > {75 * 60}")
def stream_snapshot_gaps(spark, d):
    path = shared_dir(spark, "sink")
    made = L.stream_gaps(_stream(spark, d), "1h")
    L.run_available(made, shared_dir(spark, "progress"), path)
    return spark.read.schema(made.schema).parquet(path)


@query(
    f"""WITH {V.TICKS}, s AS (SELECT DISTINCT asset_code, timestamp FROM ticks), g AS (SELECT *, lead(timestamp) OVER (PARTITION BY asset_code ORDER BY timestamp) AS next, max(timestamp) OVER () AS newest FROM s)
    SELECT asset_code, timestamp AS last, timestamp + INTERVAL 25 HOUR AS due FROM g WHERE epoch_us(next) - epoch_us(timestamp) > 25 * 3600000000 OR next IS NULL AND timestamp + INTERVAL 25 HOUR <= newest - INTERVAL 1 HOUR"""
)
def stream_silent_feeds(spark, d):
    """Feeds that fell silent for more than a day, those that never came back included: as told by timers on the stream."""
    L.use_rocksdb(spark)
    path = shared_dir(spark, "sink")
    made = L.silent_feeds(_stream(spark, d), "EOD")
    L.run_available(made, shared_dir(spark, "progress"), path)
    return spark.read.schema(made.schema).parquet(path)


@query(f"WITH {V.TICKS}, s AS (SELECT DISTINCT asset_code, time_bucket(INTERVAL '60 minutes', timestamp, TIMESTAMP '2000-01-01') AS timestamp FROM ticks), g AS (SELECT asset_code, unnest(generate_series(min(timestamp), max(timestamp), INTERVAL 1 HOUR)) AS timestamp FROM s GROUP BY 1) SELECT asset_code, timestamp FROM g ANTI JOIN s USING (asset_code, timestamp)")
def missing_snapshots(spark, d):
    t = V.ticks(spark, d).withColumn("timestamp", R.bins("1h"))
    return L.missing_snapshots(t, "1h")
