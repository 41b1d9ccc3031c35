"""Black-Scholes prices and Greeks as column expressions.

The normal distribution function is the rational approximation published by Hart (1968) and
West (2005), exact to double precision, so that pricing stays in generated code.
"""

from __future__ import annotations

import math
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strikeflow.operators.blocks import WEEK, in_blocks

# Coefficients of the approximation, highest power first.
UPPER = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
LOWER = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
SWITCH = 7.07106781186547
ROOT_TWO_PI = 2.506628274631

DAYS = 365.0
TRADING_DAYS = 252.0


def _polynomial(z: Column, coefficients: tuple[float, ...]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * z + F.lit(c)
    return out


def normal_cdf(x: Column) -> Column:
    z = F.abs(x)
    e = F.exp(-z * z / 2)
    near = e * _polynomial(z, UPPER) / _polynomial(z, LOWER)
    far = e / ((z + 1 / (z + 2 / (z + 3 / (z + 4 / (z + 0.65))))) * ROOT_TWO_PI)
    tail = F.when(z > 37, 0.0).when(z < SWITCH, near).otherwise(far)
    return F.when(x > 0, 1 - tail).otherwise(tail)


def normal_density(x: Column) -> Column:
    return F.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def with_terms(df: DataFrame, as_of: datetime | Column | None = None) -> DataFrame:
    """Adds years, d1 and d2 to a table with underlying_price, strike, expiration_date, rate, dividend and sigma.
    `as_of` defaults to the row's timestamp; years are whole days over 365. d1 and d2 are null for expired or riskless rows."""
    now = F.col("timestamp") if as_of is None else as_of if isinstance(as_of, Column) else F.lit(as_of)
    days = F.floor((F.unix_micros(F.col("expiration_date").cast("timestamp")) - F.unix_micros(now.cast("timestamp"))) / F.lit(86_400_000_000))
    df = df.withColumn("years", days / F.lit(DAYS))
    live = (F.col("years") > 0) & (F.col("sigma") > 0) & (F.col("underlying_price") > 0) & (F.col("strike") > 0)
    d1 = (F.ln(F.col("underlying_price") / F.col("strike")) + (F.col("rate") - F.col("dividend") + F.col("sigma") * F.col("sigma") / 2) * F.col("years")) / (F.col("sigma") * F.sqrt("years"))
    df = df.withColumn("d1", F.when(live, d1))
    return df.withColumn("d2", F.col("d1") - F.col("sigma") * F.sqrt("years"))


def with_price(df: DataFrame, name: str = "theoretical_price") -> DataFrame:
    """Price of a table of with_terms(): the payoff if expired, never below 0."""
    s = F.col("underlying_price") * F.exp(-F.col("dividend") * F.col("years"))
    k = F.col("strike") * F.exp(-F.col("rate") * F.col("years"))
    call = F.col("option_type") == "c"
    df = df.withColumns({"n_d1": normal_cdf(F.when(call, F.col("d1")).otherwise(-F.col("d1"))), "n_d2": normal_cdf(F.when(call, F.col("d2")).otherwise(-F.col("d2")))})
    live = F.when(call, s * F.col("n_d1") - k * F.col("n_d2")).otherwise(k * F.col("n_d2") - s * F.col("n_d1"))
    gain = F.when(call, F.col("underlying_price") - F.col("strike")).otherwise(F.col("strike") - F.col("underlying_price"))
    value = F.when(F.col("years") <= 0, gain).otherwise(live)
    return df.withColumn(name, F.when(value > 0, value).when(value <= 0, 0.0)).drop("n_d1", "n_d2")


def with_greeks(df: DataFrame) -> DataFrame:
    """delta, gamma, theta (a day), vega (1 % of volatility) and rho (1 % of rate) of a table of with_terms(); 0 if expired."""
    call = F.col("option_type") == "c"
    sign = F.when(call, 1.0).otherwise(-1.0)
    spot, years, rate, dividend, sigma = (F.col(c) for c in ("underlying_price", "years", "rate", "dividend", "sigma"))
    df = df.withColumns({"g_n1": normal_cdf(sign * F.col("d1")), "g_n2": normal_cdf(sign * F.col("d2")), "g_pdf": normal_density(F.col("d1")), "g_q": F.exp(-dividend * years), "g_r": F.exp(-rate * years)})
    n1, n2, pdf, q, r = (F.col(c) for c in ("g_n1", "g_n2", "g_pdf", "g_q", "g_r"))
    live = {
        "delta": sign * q * n1,
        "gamma": q * pdf / (spot * sigma * F.sqrt(years)),
        "theta": (-spot * pdf * sigma * q / (2 * F.sqrt(years)) - sign * rate * F.col("strike") * r * n2 + sign * dividend * spot * q * n1) / DAYS,
        "vega": spot * q * pdf * F.sqrt(years) / 100,
        "rho": sign * F.col("strike") * years * r * n2 / 100,
    }
    return df.withColumns({k: F.when(years <= 0, 0.0).otherwise(v) for k, v in live.items()}).drop("g_n1", "g_n2", "g_pdf", "g_q", "g_r")


def realized_volatility(spot: DataFrame, lookback: int = 30, by: str = "asset_code") -> DataFrame:
    """Per asset the sample deviation of its last `lookback` log returns, of a year; null with fewer than `lookback` prices.
    Every task keeps its newest prices of an asset only, so that no history is exchanged."""
    newest = Window.partitionBy(by).orderBy(F.desc("timestamp"))
    last = spot.select(by, "timestamp", "price").withColumn("nth", F.row_number().over(newest)).where(F.col("nth") <= lookback + 1)
    before = F.lead("price").over(Window.partitionBy(by).orderBy("nth"))
    df = last.withColumn("ret", F.when((F.col("price") > 0) & (before > 0), F.ln(F.col("price") / before)))
    made = df.groupBy(by).agg(F.count("*").alias("prices"), F.stddev_samp(F.when(F.col("nth") <= lookback, F.col("ret"))).alias("dev"))
    return made.select(by, F.when(F.col("prices") >= lookback, F.col("dev") * math.sqrt(TRADING_DAYS)).alias("volatility"))


def rolling_volatility(spot: DataFrame, lookback: int = 30, by: str = "asset_code", width: timedelta = WEEK) -> DataFrame:
    """The same at every time of the series, in blocks of `width` (see in_blocks()): a long series is many tasks."""
    rows = in_blocks(spot.select(by, "timestamp", "price"), by, lookback, width)
    order = Window.partitionBy(by, "_block").orderBy("timestamp")
    before = F.lag("price").over(order)
    df = rows.withColumn("ret", F.when((F.col("price") > 0) & (before > 0), F.ln(F.col("price") / before)))
    last = order.rowsBetween(-(lookback - 1), 0)
    made = df.withColumn("volatility", F.when(F.count("*").over(last) >= lookback, F.stddev_samp("ret").over(last) * math.sqrt(TRADING_DAYS)))
    return made.where("_own").select(by, "timestamp", "price", "volatility")


def market_data(spot: DataFrame, lookback: int = 30, by: str = "asset_code", volatility: float | None = None, rate: float = 0.05, dividend: float = 0.0) -> DataFrame:
    """Newest known spot price, newest time, volatility (or the given one), rate and dividend of each asset."""
    known = F.when(F.col("price").isNotNull(), F.col("timestamp"))
    newest = spot.groupBy(by).agg(F.max_by("price", known).alias("underlying_price"), F.max("timestamp").alias("timestamp"))
    if volatility is None:
        newest = newest.join(realized_volatility(spot, lookback, by), by, "left").withColumnRenamed("volatility", "sigma")
    else:
        newest = newest.withColumn("sigma", F.lit(float(volatility)))
    return newest.withColumns({"rate": F.lit(float(rate)), "dividend": F.lit(float(dividend))})


def price_chain(market: DataFrame, strikes: list[float] | DataFrame, expiration: datetime, as_of: datetime | None = None, by: str = "asset_code") -> DataFrame:
    """Calls and puts of every strike (a list, or a table of (by, strike)), priced and with Greeks; symbol U_yyyymmdd_K_C|P."""
    if isinstance(strikes, DataFrame):
        grid = market.join(strikes, by)
    else:
        grid = market.withColumn("strike", F.explode(F.array(*(F.lit(float(k)) for k in strikes))))
    grid = grid.withColumns({"option_type": F.explode(F.array(F.lit("c"), F.lit("p"))), "expiration_date": F.lit(expiration).cast("timestamp_ntz")})
    symbol = F.concat_ws("_", F.col(by), F.date_format("expiration_date", "yyyyMMdd"), F.col("strike").cast("long").cast("string"), F.upper("option_type"))
    return with_greeks(with_price(with_terms(grid, as_of))).withColumn("symbol", symbol)
