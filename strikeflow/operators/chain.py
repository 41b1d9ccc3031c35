"""Chains: selection, at-the-money strikes, moneyness, desks.

A chain is a key (base asset, timestamp, expiration); every function works on all chains of a table at once.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strikeflow.schema import AT_THE_MONEY, CALL, CHAIN, IN_THE_MONEY, OUT_OF_THE_MONEY, PUT

ASSET = "base_asset_code"


def _first(rows: DataFrame, order: Column) -> DataFrame:
    """Per asset the rows that come first in the order, ties included. Tasks drop what is not first among
    their own rows before the exchange."""
    return rows.withColumn("_rank", F.rank().over(Window.partitionBy(ASSET).orderBy(order))).where("_rank = 1").drop("_rank")


def select_chain(options: DataFrame, settlement: datetime | None = None, expiration: datetime | None = None) -> DataFrame:
    """Per asset the rows of the settlement time (default: the newest) and the nearest expiration not before it (or a given one).

    The table is read once: the newest rows of each task and asset meet in one exchange, where the nearest expiry is picked, too."""
    now = book_at(options, settlement).where("expiration_date >= timestamp")
    if expiration is not None:
        return now.where(F.col("expiration_date") == F.lit(expiration))
    return _first(now, F.asc("expiration_date"))


def book_at(table: DataFrame, settlement: datetime | None = None) -> DataFrame:
    """Rows of one settlement time per asset (default: the newest)."""
    table = table.dropna(subset=[ASSET, "timestamp"])
    return _first(table, F.desc("timestamp")) if settlement is None else table.where(F.col("timestamp") == F.lit(settlement))


def chain_faults(candidates: DataFrame, by: Sequence[str] = (ASSET,)) -> DataFrame:
    """Candidates that are no chain: more than one timestamp or expiration."""
    return candidates.groupBy(*by).agg(F.count_distinct("timestamp").alias("timestamps"), F.count_distinct("expiration_date").alias("expirations")).where("timestamps <> 1 or expirations <> 1")


def nearest_expiration(options: DataFrame) -> DataFrame:
    """Per asset the newest time and its nearest expiration."""
    return select_chain(options).select(ASSET, "timestamp", "expiration_date").distinct()


def longest_expiration(options: DataFrame, settlement: datetime | None = None) -> DataFrame:
    """Per asset the expiration that has most distinct timestamps, the earliest of equals. With a
    settlement only what was recorded before it counts, and expirations from it on."""
    rows = options if settlement is None else options.where((F.col("timestamp") < F.lit(settlement)) & (F.col("expiration_date") >= F.lit(settlement)))
    counts = rows.select(ASSET, "expiration_date", "timestamp").distinct().groupBy(ASSET, "expiration_date").agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("m"), "expiration_date"))
    return counts.groupBy(ASSET).agg(best.alias("b")).select(ASSET, F.col("b.expiration_date").alias("expiration_date"), (-F.col("b.m")).alias("n"))


def most_recorded(options: DataFrame) -> DataFrame:
    """Per asset the strike with most rows, and for it the expiration with most rows; the lowest of equals."""
    counts = options.groupBy(ASSET, "strike", "expiration_date").agg(F.count("*").alias("n"))
    strikes = counts.groupBy(ASSET, "strike").agg(F.sum("n").alias("rows"), F.min(F.struct((-F.col("n")).alias("m"), "expiration_date")).alias("e"))
    top = strikes.groupBy(ASSET).agg(F.min(F.struct((-F.col("rows")).alias("m"), "strike", "e")).alias("s"))
    return top.select(ASSET, F.col("s.strike").alias("strike"), (-F.col("s.m")).alias("strike_rows"), F.col("s.e.expiration_date").alias("expiration_date"), (-F.col("s.e.m")).alias("rows"))


def distance() -> Column:
    return F.abs(F.col("underlying_price") - F.col("strike"))


def atm_order() -> Column:
    """Null where there is no underlying price, which min_by skips; the lower of two strikes at one distance comes first."""
    return F.when(distance().isNotNull(), F.struct(distance().alias("d"), "strike"))


def atm_strikes(options: DataFrame, by: Sequence[str] = CHAIN) -> DataFrame:
    """The strike nearest to the underlying, for each chain."""
    return options.groupBy(*by).agg(F.min_by("strike", atm_order()).alias("atm_strike"))


def nearest_strikes(options: DataFrame, k: int | None = None, by: Sequence[str] = CHAIN) -> DataFrame:
    """Distinct strikes of each chain ranked by their distance, the first k."""
    each = options.where(distance().isNotNull()).groupBy(*by, "strike").agg(F.min(distance()).alias("distance"))
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("distance", "strike")))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def add_moneyness(options: DataFrame, by: Sequence[str] = CHAIN) -> DataFrame:
    """price_status of every row by the chain's at-the-money strike: one shuffle on the chain, no
    group is handled in Python. Null where the chain has no underlying price or a key is null."""
    atm = F.min_by("strike", atm_order()).over(Window.partitionBy(*by))
    inside = ((F.col("option_type") == CALL) & (F.col("strike") < F.col("atm"))) | ((F.col("option_type") == PUT) & (F.col("strike") > F.col("atm")))
    known = F.col("atm").isNotNull()
    for c in by:
        known &= F.col(c).isNotNull()
    status = F.when(~known, F.lit(None)).when(F.col("strike") == F.col("atm"), AT_THE_MONEY).when(inside, IN_THE_MONEY).otherwise(OUT_OF_THE_MONEY)
    return options.withColumn("atm", atm).withColumn("price_status", status).drop("atm")


def add_moneyness_by_type(options: DataFrame) -> DataFrame:
    """As add_moneyness, with the at-the-money strike of each side of a chain."""
    return add_moneyness(options, (*CHAIN, "option_type"))


def step_moneyness(desk: DataFrame, by: Sequence[str] = CHAIN) -> DataFrame:
    """Moneyness of a desk by its strike step, the distance of the two middle strikes: ATM within a step
    of the price, else ITM or OTM by the intrinsic value; for the call and the put side."""
    order = Window.partitionBy(*by).orderBy("strike")
    n = F.count("*").over(Window.partitionBy(*by))
    ranked = desk.withColumn("nth", F.row_number().over(order)).withColumn("n", n)
    half = F.floor(F.col("n") / 2)
    every = Window.partitionBy(*by)
    pick = lambda k: F.max(F.when(F.col("nth") == k, F.col("strike"))).over(every)
    df = ranked.withColumn("step", pick(half + 1) - pick(half))
    near = F.abs(F.col("strike") - F.col("underlying_price")) < F.col("step")
    gain = F.col("underlying_price") - F.col("strike")
    side = lambda g: F.when(near, AT_THE_MONEY).when(g > 0, IN_THE_MONEY).otherwise(OUT_OF_THE_MONEY)
    return df.withColumns({"call_status": side(gain), "put_status": side(-gain)}).drop("nth", "n")


def desk(options: DataFrame, columns: Sequence[str] = ("price",), futures: DataFrame | None = None, future_columns: Sequence[str] = (), by: Sequence[str] = CHAIN) -> DataFrame:
    """Calls and puts side by side: one row for each strike of a chain, columns with _call and _put. Contracts
    are unique in a chain, so one conditional aggregate does it, without a self join. Absent
    columns are ignored. Futures' columns are joined by time and expiration, nulls to nulls."""
    columns = [c for c in columns if c in options.columns]
    sides = [F.max(F.when(F.col("option_type") == t, F.col(c))).alias(f"{c}_{name}") for c in columns for t, name in ((CALL, "call"), (PUT, "put"))]
    made = options.where(F.col("option_type").isin(CALL, PUT)).groupBy(*by, "strike").agg(*sides)
    if futures is None:
        return made
    extra = [c for c in future_columns if c in futures.columns]
    f = futures.select(*(F.col(k).alias(f"f_{k}") for k in by), *extra).distinct()
    on = F.lit(True)
    for k in by:
        on &= F.col(k).eqNullSafe(F.col(f"f_{k}"))
    return made.join(f, on, "left").drop(*(f"f_{k}" for k in by))


def strike_band(options: DataFrame, by: Sequence[str] = CHAIN) -> DataFrame:
    """Rows strictly inside a band around the money. k5 is the farthest strike strictly inside (atm, 1.05 atm);
    the band goes from the highest strike up to 90 % of the lesser of atm and k5 to the lowest from 110 % of the greater on."""
    chain = Window.partitionBy(*by)
    df = options.withColumn("atm", F.min_by("strike", atm_order()).over(chain))
    df = df.withColumn("k5", F.max(F.when((F.col("strike") > F.col("atm")) & (F.col("strike") < 1.05 * F.col("atm")), F.col("strike"))).over(chain))
    low, high = F.least("atm", "k5"), F.greatest("atm", "k5")
    df = df.withColumn("band_low", F.max(F.when(F.col("strike") <= 0.9 * low, F.col("strike"))).over(chain)).withColumn("band_high", F.min(F.when(F.col("strike") >= 1.1 * high, F.col("strike"))).over(chain))
    return df.where("strike > band_low and strike < band_high").drop("atm", "k5")
