"""Market tables derived from order tables: each once for Spark and once as SQL.

Quotes come from line items and parts, ticks from events. Both sides use plain IEEE arithmetic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strikeflow.functions.normalize import filled_price
from strikeflow.operators.chain import add_moneyness
from strikeflow.operators.enrich import add_intrinsic_value, add_time_value, join_option_with_future

TIE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quotes(spark: SparkSession, sf_dir: str, lineitem: DataFrame | None = None) -> DataFrame:
    """Quotes of the line items, or of the given ones (a stream, say)."""
    rows = (table(spark, sf_dir, "lineitem") if lineitem is None else lineitem).join(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey"))
    month = "cast(date_trunc('month', l_shipdate) as timestamp_ntz)"
    quarter = "cast(date_trunc('quarter', l_shipdate) as timestamp_ntz)"
    premium = "l_extendedprice / 1000"
    return rows.selectExpr(
        f"{month} as timestamp",
        "l_shipdate as original_timestamp",
        "p_brand as base_asset_code",
        "cast(ceil(l_quantity / 5) * 200 as double) as strike",
        "case when l_linenumber % 2 = 0 then 'p' else 'c' end as option_type",
        f"cast({month} + make_ym_interval(0, cast(1 + l_suppkey % 3 as int)) as timestamp_ntz) as expiration_date",
        f"case when l_suppkey % 7 = 0 then null else cast({quarter} + make_ym_interval(0, 3) as timestamp_ntz) end as underlying_expiration_date",
        f"{premium} as premium",
        f"case when l_returnflag <> 'R' then {premium} end as last",
        f"case when l_linenumber % 3 <> 0 then {premium} * (1 - l_discount) end as bid",
        f"case when l_linenumber % 4 <> 0 then {premium} * (1 + l_tax) end as ask",
        "l_quantity as volume",
        "p_retailprice",
        *TIE,
    )


MONTH = "CAST(date_trunc('month', l_shipdate) AS TIMESTAMP)"
QUOTES = f"""quotes AS (
  SELECT {MONTH} AS timestamp, l_shipdate AS original_timestamp, p_brand AS base_asset_code,
    CAST(ceil(l_quantity / 5) * 200 AS DOUBLE) AS strike,
    CASE WHEN l_linenumber % 2 = 0 THEN 'p' ELSE 'c' END AS option_type,
    CAST({MONTH} + to_months(CAST(1 + l_suppkey % 3 AS INTEGER)) AS TIMESTAMP) AS expiration_date,
    CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE CAST(CAST(date_trunc('quarter', l_shipdate) AS TIMESTAMP) + to_months(3) AS TIMESTAMP) END AS underlying_expiration_date,
    l_extendedprice / 1000 AS premium,
    CASE WHEN l_returnflag <> 'R' THEN l_extendedprice / 1000 END AS last,
    CASE WHEN l_linenumber % 3 <> 0 THEN l_extendedprice / 1000 * (1 - l_discount) END AS bid,
    CASE WHEN l_linenumber % 4 <> 0 THEN l_extendedprice / 1000 * (1 + l_tax) END AS ask,
    l_quantity AS volume, p_retailprice, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

FILLED = "coalesce(last, (coalesce(ask, bid) + coalesce(bid, ask)) / 2)"


def options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last quote of each contract and time, with its filled price."""
    keys = ["base_asset_code", "timestamp", "expiration_date", "option_type", "strike"]
    order = F.struct("original_timestamp", *TIE)
    row = F.struct("underlying_expiration_date", "last", "bid", "ask", "volume")
    df = quotes(spark, sf_dir).groupBy(*keys).agg(F.max_by(row, order).alias("r")).select(*keys, "r.*")
    none = F.lit(None).cast("double")
    return df.withColumn("price", filled_price(none, F.col("last"), F.col("ask"), F.col("bid"), none, none)).dropna(subset=["price"])


OPTIONS = f"""{QUOTES}, options AS (
  SELECT base_asset_code, timestamp, expiration_date, option_type, strike, underlying_expiration_date, last, bid, ask, volume, {FILLED} AS price
  FROM (SELECT *, row_number() OVER (PARTITION BY base_asset_code, timestamp, expiration_date, option_type, strike
          ORDER BY original_timestamp DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS rn FROM quotes)
  WHERE rn = 1 AND {FILLED} IS NOT NULL)"""


def futures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes(spark, sf_dir).groupBy("base_asset_code", "timestamp", F.col("underlying_expiration_date").alias("expiration_date")).agg(F.max("p_retailprice").alias("price"))


FUTURES = """futures AS (
  SELECT base_asset_code, timestamp, underlying_expiration_date AS expiration_date, max(p_retailprice) AS price FROM quotes GROUP BY ALL)"""


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = join_option_with_future(options(spark, sf_dir), futures(spark, sf_dir))
    return add_moneyness(add_time_value(add_intrinsic_value(df)))


CHAIN = "base_asset_code, timestamp, expiration_date"
ENRICHED = f"""{OPTIONS}, {FUTURES}, joined AS (
  SELECT o.*, f.price AS underlying_price FROM options o LEFT JOIN futures f
    ON o.base_asset_code = f.base_asset_code AND o.timestamp = f.timestamp AND o.underlying_expiration_date IS NOT DISTINCT FROM f.expiration_date),
valued AS (
  SELECT *, CASE WHEN gain > 0 THEN gain WHEN gain <= 0 THEN 0.0 END AS intrinsic_value,
    price - CASE WHEN gain > 0 THEN gain WHEN gain <= 0 THEN 0.0 END AS timed_value
  FROM (SELECT *, CASE WHEN option_type = 'c' THEN underlying_price - strike ELSE strike - underlying_price END AS gain FROM joined)),
atms AS (
  SELECT {CHAIN}, strike AS atm FROM (
    SELECT *, row_number() OVER (PARTITION BY {CHAIN} ORDER BY abs(underlying_price - strike), strike) AS rn FROM valued WHERE underlying_price IS NOT NULL) WHERE rn = 1),
enriched AS (
  SELECT v.* EXCLUDE (gain), CASE WHEN atm IS NULL THEN NULL WHEN strike = atm THEN 'atm'
      WHEN (option_type = 'c' AND strike < atm) OR (option_type = 'p' AND strike > atm) THEN 'itm' ELSE 'otm' END AS price_status
  FROM valued v LEFT JOIN atms a ON v.base_asset_code = a.base_asset_code AND v.timestamp = a.timestamp AND v.expiration_date = a.expiration_date)"""


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.concat(F.lit("A"), F.col("user_id").cast("string")).alias("asset_code"), F.col("ts").alias("timestamp"), F.col("value").alias("price"), "event_id", "event_type")


TICKS = """ticks AS (SELECT 'A' || CAST(user_id AS VARCHAR) AS asset_code, ts AS timestamp, value AS price, event_id, event_type FROM events)"""


def names(spark: SparkSession, sf_dir: str, lineitem: DataFrame | None = None) -> DataFrame:
    """Quotes with an exchange's instrument name; the kind goes by l_linenumber."""
    q = quotes(spark, sf_dir, lineitem)
    day = F.upper(F.date_format("expiration_date", "dMMMyy"))
    base = F.col("base_asset_code")
    k = F.col("strike").cast("int").cast("string")
    n = F.col("l_linenumber")
    name = (
        F.when(n == 1, F.concat_ws("-", base, day, k, F.upper("option_type")))
        .when(n == 2, F.concat_ws("-", base, day))
        .when(n == 3, F.concat(base, F.lit("_USD")))
        .when(n == 4, F.concat_ws("-", base, F.lit("FS"), F.concat(day, F.lit("_PERP"))))
        .when(n == 5, F.concat_ws("-", base, F.lit("CS"), day, F.concat(k, F.lit("_"), k)))
        .when(n == 6, F.concat(base, F.lit("-PERPETUAL")))
        .otherwise(F.concat_ws("-", base, F.lit("bad"), F.lit("name")))
    )
    return q.withColumn("asset_code", name)


DAY = "upper(strftime(expiration_date, '%-d%b%y'))"
NAMES = f"""{QUOTES}, names AS (
  SELECT *, CASE l_linenumber
      WHEN 1 THEN base_asset_code || '-' || {DAY} || '-' || CAST(CAST(strike AS INTEGER) AS VARCHAR) || '-' || upper(option_type)
      WHEN 2 THEN base_asset_code || '-' || {DAY}
      WHEN 3 THEN base_asset_code || '_USD'
      WHEN 4 THEN base_asset_code || '-FS-' || {DAY} || '_PERP'
      WHEN 5 THEN base_asset_code || '-CS-' || {DAY} || '-' || CAST(CAST(strike AS INTEGER) AS VARCHAR) || '_' || CAST(CAST(strike AS INTEGER) AS VARCHAR)
      WHEN 6 THEN base_asset_code || '-PERPETUAL'
      ELSE base_asset_code || '-bad-name' END AS asset_code
  FROM quotes)"""
