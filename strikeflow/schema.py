"""Columns, codes and rules of option, future and spot tables."""

from __future__ import annotations

from pyspark.sql import types as T

# Short codes that tables store.
CALL, PUT = "c", "p"
AT_THE_MONEY, IN_THE_MONEY, OUT_OF_THE_MONEY = "atm", "itm", "otm"
OPTION, FUTURE, SPOT, FUTURE_COMBO, OPTION_COMBO = "o", "f", "s", "fc", "oc"
AMERICAN, EUROPEAN = "a", "e"

#: Timeframe -> minutes. Every one divides a day, so bins are aligned to midnight UTC.
TIMEFRAMES = {"EOD": 1440, "1m": 1, "5m": 5, "15m": 15, "30m": 30, "1h": 60, "4h": 240}

#: Largest usual distance of two snapshots, in seconds; other timeframes: 1.25 times their length.
GAP_SECONDS = {"EOD": 25 * 3600, "1m": 90, "5m": 360, "1h": 75 * 60}

FIRST, LAST, MAX, MIN, MEAN = "first", "last", "max", "min", "mean"

TIME = T.TimestampNTZType()
NUMBER, TEXT = T.DoubleType(), T.StringType()

#: Column -> (type, rule of resampling; None: dropped by it)
COLUMNS: dict[str, tuple[T.DataType, str | None]] = {
    **dict.fromkeys(("timestamp", "expiration_date", "underlying_expiration_date", "request_timestamp", "original_timestamp"), (TIME, LAST)),
    **dict.fromkeys(("strike", "price", "ask", "bid", "open_interest", "volume", "volume_premium", "volume_notional"), (NUMBER, LAST)),
    **dict.fromkeys(("exchange_mark_price", "exchange_mark_iv", "last", "underlying_price", "intrinsic_value", "timed_value", "mark_price", "mark_iv"), (NUMBER, LAST)),
    "open": (NUMBER, FIRST),
    "close": (NUMBER, LAST),
    "high": (NUMBER, MAX),
    "low": (NUMBER, MIN),
    **dict.fromkeys(("low_24", "high_24"), (NUMBER, None)),
    **dict.fromkeys(("iv", "delta", "gamma", "vega", "theta", "rho"), (NUMBER, MEAN)),
    **dict.fromkeys(("option_type", "price_status", "series_code", "asset_code", "asset_type", "underlying_asset_code", "underlying_asset_type", "base_asset_code", "title", "option_style", "currency"), (TEXT, LAST)),
}

OPTION_ONLY = ("strike", "option_type", "option_style", "underlying_expiration_date", "underlying_price", "intrinsic_value", "timed_value", "price_status", "series_code", "mark_iv", "exchange_mark_iv", "iv", "delta", "gamma", "vega", "theta", "rho")
FUTURE_COLUMNS = [c for c in COLUMNS if c not in OPTION_ONLY]
SPOT_COLUMNS = [c for c in FUTURE_COLUMNS if c != "expiration_date"]

OPTION_DEFAULT = ("timestamp", "strike", "expiration_date", "option_type", "price", "underlying_expiration_date", "underlying_price")
FUTURE_DEFAULT = ("timestamp", "expiration_date", "price")

#: Enriched column -> the columns it is computed from, in order.
DEPENDS = {"underlying_price": (), "intrinsic_value": ("underlying_price",), "timed_value": ("intrinsic_value",), "price_status": ("underlying_price",)}

CHAIN = ("base_asset_code", "timestamp", "expiration_date")
#: What options and futures of one time have in common: every chain lies within one.
MOMENT = ("base_asset_code", "timestamp")
CONTRACT = ("base_asset_code", "expiration_date", "option_type", "strike")


def struct(*columns: str) -> T.StructType:
    """The schema of a table with these columns."""
    return T.StructType([T.StructField(c, COLUMNS[c][0]) for c in columns])
