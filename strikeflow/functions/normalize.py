"""Column expressions that turn raw exchange fields into the dictionary's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strikeflow.schema import AMERICAN, EUROPEAN, FUTURE, FUTURE_COMBO, OPTION, OPTION_COMBO, SPOT

def ntz(c: Column) -> Column:
    return c.cast("timestamp_ntz")


def expiration_date(code: Column) -> Column:
    """`3FEB25`, `28feb25` or `280225` as a date at midnight, anything else as null."""
    named = F.when(code.rlike(r"^\d{1,2}[A-Za-z]{3}\d{2}$"), F.try_to_timestamp(F.upper(code), F.lit("dMMMyy")))
    return ntz(F.when(code.rlike(r"^\d{6}$"), F.try_to_timestamp(code, F.lit("ddMMyy"))).otherwise(named))


def expiration_dates(*codes: Column) -> Column:
    """expiration_date() of several codes, as an array. The parsing is there once, in a lambda: spelled out for each code it
    makes a book's generated method so long that the JVM does not compile it, at several times the cost."""
    return F.transform(F.array(*codes), expiration_date)


def epoch_millis(c: Column) -> Column:
    return ntz(F.timestamp_millis(c))


def round_time(c: Column, seconds: int = 1) -> Column:
    """Rounds to whole units, half to even: 04:35:59.997 becomes 04:36:00."""
    return ntz(F.timestamp_seconds(F.bround(F.unix_micros(c.cast("timestamp")) / F.lit(seconds * 1_000_000).cast("double")) * seconds))


def filled_price(price: Column, last: Column, ask: Column, bid: Column, high: Column, low: Column) -> Column:
    """price, else last, else the middle of what is known of ask/high and bid/low."""
    upper = F.coalesce(ask, high)
    lower = F.coalesce(bid, low)
    return F.coalesce(price, last, (F.coalesce(upper, lower) + F.coalesce(lower, upper)) / 2)


NAMED = ("asset_type", "base_asset_code", "expiration_date", "strike", "option_type", "parse_error")


def with_instruments(df: DataFrame) -> DataFrame:
    """Adds what the names in asset_code say: NAMED. In steps, so that a part or a date that several columns
    need is taken from the name once; no row leaves its partition."""
    df = df.withColumn("_part", F.split(F.regexp_replace("asset_code", r"(\d)[dD](\d)", "$1.$2"), "-"))
    at = lambda k: F.try_element_at("_part", F.lit(k))
    df = df.withColumns({"_n": F.size("_part"), "_two": at(2), "_three": F.split(at(3), "_")[0], "_four": at(4)})
    df = df.withColumn("_dates", expiration_dates(F.col("_two"), F.col("_three")))
    df = df.withColumns({"_second": F.col("_dates")[0], "_third": F.col("_dates")[1]})
    n, second, third = F.col("_n"), F.col("_second"), F.col("_third")
    kind = (
        F.when(n == 1, SPOT)
        .when((n == 2) & ((F.upper("_two") == "PERPETUAL") | second.isNotNull()), FUTURE)
        .when((n == 3) & third.isNotNull(), FUTURE_COMBO)
        .when((n == 4) & second.isNotNull(), OPTION)
        .when((n == 4) & third.isNotNull(), OPTION_COMBO)
    )
    df = df.withColumn("asset_type", kind)
    kind = F.col("asset_type")
    new = {
        "base_asset_code": F.col("_part")[0],
        "expiration_date": F.when(kind.isin(FUTURE, OPTION), second).when(kind.isin(FUTURE_COMBO, OPTION_COMBO), third),
        "strike": F.when(kind == OPTION, at(3).try_cast("double")),
        "option_type": F.when(kind == OPTION, F.lower("_four")),
        "parse_error": kind.isNull() & F.col("asset_code").isNotNull(),
    }
    return df.withColumns(new).drop("_part", "_n", "_two", "_three", "_four", "_dates", "_second", "_third")


def underlying_expiration(index: Column) -> Column:
    """The expiry in an underlying's name; synthetic and index underlyings have none."""
    return F.when(index.startswith("SYN.") | (index == "index_price"), F.lit(None)).otherwise(expiration_dates(F.try_element_at(F.split(index, "-"), F.lit(2)))[0])


def codes(c: Column, table: dict[str, str]) -> Column:
    """Long names to codes; unknown ones are null."""
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[c]


def option_type_of(contract: Column) -> Column:
    """The first C or P of a contract's id from which on it still holds a digit, in lower case."""
    # Fixed value: the pattern, which looks ahead from the letter's own place.
    found = F.regexp_extract(contract, r"(?=\w+\d+\.?\d*)([CP])", 1)
    return F.when(found != "", F.lower(found))


def underlying_id(code: Column, kind: Column) -> Column:
    # Fixed value: the suffix of such ids.
    return F.concat(code, F.lit("."), F.upper(kind), F.lit("/MOEX"))


def series(df: DataFrame, code: str = "series_code") -> DataFrame:
    """Style, expiry and currency that a series code spells."""
    c = F.col(code)
    return df.withColumns(
        {
            "option_style": F.when(F.lower(c).endswith("a"), AMERICAN).otherwise(EUROPEAN),
            "expiration_date": expiration_date(F.expr(f"substring({code}, length({code}) - 7, 6)")),
            "currency": F.lit("rub"),
        }
    )


QUOTED = ("ask", "bid", "last", "high_24", "low_24", "mark_price")


def to_quote_currency(df: DataFrame) -> DataFrame:
    """Prices of options quoted in their base asset, in money: multiplied by the delivery price
    where it is known and not 0. source_<column> keeps what was."""
    on = (F.size(F.split("asset_code", "-")) == 4) & (F.col("base_currency") == F.col("quote_currency")) & F.col("estimated_delivery_price").isNotNull() & (F.col("estimated_delivery_price") != 0)
    # A column of its own, so that each of the prices does not look at the name again.
    df = df.withColumn("_on", F.coalesce(on, F.lit(False)))
    on = F.col("_on")
    new = {}
    for c in (c for c in (*QUOTED, "price") if c in df.columns):
        if c != "price":
            new[f"source_{c}"] = F.when(on, F.col(c))
        new[c] = F.when(on, F.col(c) * F.col("estimated_delivery_price")).otherwise(F.col(c))
    if {"volume_notional", "volume_usd"} <= set(df.columns):
        new["volume_notional"] = F.when(on, F.coalesce("volume_notional", "volume_usd")).otherwise(F.col("volume_notional"))
    return df.withColumns(new).drop("_on")


#: The vendor's names of columns.
VENDOR = {"instrument_name": "asset_code", "bid_price": "bid", "ask_price": "ask", "high": "high_24", "low": "low_24", "mark_iv": "exchange_mark_iv"}


def normalize_book(raw: DataFrame, request_time: Column) -> DataFrame:
    """A raw book with the dictionary's columns: names parsed, times rounded, prices filled and converted."""
    df = raw.withColumnsRenamed({k: v for k, v in VENDOR.items() if k in raw.columns})
    df = with_instruments(df)
    empty = F.lit(None).cast("double")
    get = lambda c: F.col(c) if c in df.columns else empty
    df = df.withColumns(
        {
            "original_timestamp": epoch_millis(F.col("creation_timestamp")),
            "request_timestamp": request_time,
            "timestamp": round_time(epoch_millis(F.col("creation_timestamp"))),
            "price": filled_price(get("price"), get("last"), get("ask"), get("bid"), get("high_24"), get("low_24")),
            "underlying_expiration_date": underlying_expiration(F.col("underlying_index")) if "underlying_index" in df.columns else F.lit(None).cast("timestamp_ntz"),
        }
    )
    return to_quote_currency(df)


def flatten_board(df: DataFrame, board: str) -> DataFrame:
    """struct<call: array<struct>, put: array<struct>> of the same fields to one row for each contract."""
    keep = [c for c in df.columns if c != board]
    tagged = lambda side: F.transform(F.coalesce(f"{board}.{side}", F.array()), lambda e: F.struct(F.lit(side[0]).alias("option_type"), e.alias("e")))
    return df.select(*keep, F.inline(F.concat(tagged("call"), tagged("put")))).select(*keep, "option_type", "e.*")


def flatten_series(df: DataFrame) -> DataFrame:
    """One row for each series and side, from columns call and put (structs of the same fields)."""
    keep = [c for c in df.columns if c not in ("call", "put")]
    both = F.array(F.struct(F.lit("c").alias("option_type"), F.col("call").alias("e")), F.struct(F.lit("p").alias("option_type"), F.col("put").alias("e")))
    return df.select(*keep, F.explode(both).alias("s")).select(*keep, "s.option_type", "s.e.*")


def wide_series(df: DataFrame) -> DataFrame:
    """Fields of both sides as columns call_* and put_*."""
    keep = [c for c in df.columns if c not in ("call", "put")]
    sides = [F.col(f"{side}.{f.name}").alias(f"{side}_{f.name}") for side in ("call", "put") for f in df.schema[side].dataType.fields]
    return df.select(*keep, *sides)


def flatten_ticker(df: DataFrame) -> DataFrame:
    """Structs `stats` and `greeks` as columns: stats_*, and the greeks by name."""
    keep = [c for c in df.columns if c not in ("stats", "greeks")]
    return df.select(*keep, *(F.col(f"stats.{f.name}").alias(f"stats_{f.name}") for f in df.schema["stats"].dataType.fields), "greeks.*")


def candles(df: DataFrame, arrays: tuple[str, ...]) -> DataFrame:
    """Parallel arrays to one row for each tick."""
    keep = [c for c in df.columns if c not in arrays]
    return df.select(*keep, F.explode(F.arrays_zip(*arrays)).alias("e")).select(*keep, "e.*")


def book_levels(df: DataFrame, bids: str = "bids", asks: str = "asks") -> DataFrame:
    """Arrays of [price, amount] to levels as deep as both sides go; a book without levels is one row of nulls."""
    keep = [c for c in df.columns if c not in (bids, asks)]
    depth = F.least(F.size(bids), F.size(asks))
    zipped = F.arrays_zip(F.slice(bids, F.lit(1), depth).alias("b"), F.slice(asks, F.lit(1), depth).alias("a"))
    rows = df.select(*keep, F.posexplode_outer(zipped).alias("level", "e"))
    return rows.select(*keep, "level", F.col("e.b")[0].alias("bid_price"), F.col("e.b")[1].alias("bid_amount"), F.col("e.a")[0].alias("ask_price"), F.col("e.a")[1].alias("ask_amount"))


def value_pairs(df: DataFrame, pairs: str, time: str = "timestamp", value: str = "value") -> DataFrame:
    """An array of [epoch ms, value] to rows."""
    keep = [c for c in df.columns if c != pairs]
    return df.select(*keep, F.explode(pairs).alias("e")).select(*keep, epoch_millis(F.col("e")[0].cast("long")).alias(time), F.col("e")[1].alias(value))


def drop_unused_sources(df: DataFrame) -> DataFrame:
    """Without the source_* columns that hold nothing; one aggregate finds them."""
    columns = [c for c in df.columns if c.startswith("source_")]
    if not columns:
        return df
    used = df.agg(*(F.count(c).alias(c) for c in columns)).first()
    return df.drop(*(c for c in columns if not used[c]))
