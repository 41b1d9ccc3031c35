"""Time value over time, payoffs of strategies, profit scenarios."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strikeflow.operators.chain import ASSET, atm_order, select_chain
from strikeflow.schema import AT_THE_MONEY, CALL, CHAIN, FUTURE, PUT

SERIES = (ASSET, "expiration_date", "option_type")

SALTS = 64


def time_value_by_atm_distance(options: DataFrame, distance: float | str = 0.0, expiration: datetime | None = None, option_type: str | None = None) -> DataFrame:
    """Time value, at each time, of the strike nearest to at-the-money plus `distance` (a number or a column);
    strikes at the same distance all stay. Without an expiration or type: for every one."""
    df = options if expiration is None else options.where(F.col("expiration_date") == F.lit(expiration))
    df = df if option_type is None else df.where(F.col("option_type") == option_type)
    moment = Window.partitionBy(*SERIES, "timestamp")
    shift = F.col(distance) if isinstance(distance, str) else F.lit(float(distance))
    df = df.withColumn("atm", F.min_by("strike", atm_order()).over(moment))
    df = df.withColumn("away", F.abs(F.col("strike") - F.col("atm") - shift))
    return df.withColumn("least", F.min("away").over(moment)).where("away = least").select(*SERIES, "timestamp", "strike", "timed_value")


def time_value_by_strike_distance(options: DataFrame, strikes: DataFrame, option_type: str = CALL) -> DataFrame:
    """As above with the distance that a strike has from at-the-money in the asset's current chain.
    `strikes` has (base_asset_code, target); the series is that of the current chain's expiration."""
    now = select_chain(options)
    atm = now.groupBy(*CHAIN).agg(F.min_by("strike", atm_order()).alias("atm_now"))
    shift = atm.join(strikes, ASSET).select(ASSET, "expiration_date", (F.col("target") - F.col("atm_now")).alias("distance"))
    return time_value_by_atm_distance(options.where(F.col("option_type") == option_type).join(shift, [ASSET, "expiration_date"]), "distance")


def time_value_for_strike(options: DataFrame, strike: float) -> DataFrame:
    """Time value of one strike over time."""
    return options.where(F.col("strike") == strike).select(*SERIES, "timestamp", "strike", "timed_value")


def leg_id():
    """#index_type_strike_lots"""
    return F.concat(F.lit("#"), F.col("leg_idx").cast("string"), F.lit("_"), F.col("type"), F.lit("_"), F.col("leg_strike").cast("long").cast("string"), F.lit("_"), F.col("lots").cast("string"))


def _books(chains: DataFrame) -> DataFrame:
    """A row for each chain with its contracts: some hundreds, in one array. What follows needs no second look at the table."""
    contract = F.struct(F.col("option_type").alias("side"), "strike", "price", "underlying_price")
    known = chains if "underlying_price" in chains.columns else chains.withColumn("underlying_price", F.lit(None).cast("double"))
    return known.where(F.col("option_type").isin(CALL, PUT)).groupBy(*CHAIN).agg(F.collect_list(contract).alias("contracts"))


def _side() -> Column:
    return F.when(F.col("type") == "put", PUT).otherwise(CALL)


def leg_premiums(chains: DataFrame, legs: DataFrame) -> DataFrame:
    """Each option leg with its premium in every chain of `chains`; missing_leg where the chain has no such contract.

    Every chain meets every leg, as the result has a row for each; they meet by a salt, so that either side may be of any size."""
    legs = legs.where("type <> 'futures'").withColumnRenamed("strike", "leg_strike").withColumn("_side", _side())
    legs = legs.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = _books(chains).withColumn("_salt", F.pmod(F.xxhash64(*CHAIN), F.lit(SALTS)).cast("int")).join(legs, "_salt")
    own = F.filter("contracts", lambda c: (c["side"] == F.col("_side")) & (c["strike"] == F.col("leg_strike")))
    rows = rows.withColumn("price", F.array_max(F.transform(own, lambda c: c["price"]))).withColumn("missing_leg", F.col("price").isNull())
    return rows.drop("contracts", "_side", "_salt")


def chain_payoff_legs(chains: DataFrame, legs: DataFrame) -> DataFrame:
    """Profit of each leg at expiration, on the strike grid of its type (a future: that of the calls), for all
    strategies and chains at once. `legs`: strategy_id, leg_idx, strike, lots, type (call, put, futures).

    A leg first meets the contracts of its type and strike, and only chains that have its contract are laid out on the grid;
    futures meet every chain once. Legs whose contract a chain lacks give no rows there (see leg_premiums)."""
    option = F.col("type") != "futures"
    kind, strike = F.when(option, _side()).otherwise(FUTURE), F.when(option, F.col("strike")).otherwise(0.0)
    asked = legs.withColumns({"_kind": kind, "_strike": strike, "_side": _side()}).withColumnRenamed("strike", "leg_strike")
    place = F.transform("contracts", lambda c: F.struct(c["side"].alias("_kind"), c["strike"].alias("_strike"), c["price"].alias("premium")))
    future = F.array(F.struct(F.lit(FUTURE).alias("_kind"), F.lit(0.0).alias("_strike"), F.lit(None).cast("double").alias("premium")))
    met = _books(chains).select(*CHAIN, "contracts", F.inline(F.concat(place, future))).where("premium is not null or _kind = 'f'").join(asked, ["_kind", "_strike"])
    grid = F.filter("contracts", lambda c: c["side"] == F.col("_side"))
    rows = met.select(*CHAIN, "strategy_id", "leg_idx", "leg_strike", "lots", "type", "_side", "premium", F.inline(F.transform(grid, lambda c: F.struct(c["strike"].alias("strike"), c["underlying_price"].alias("underlying_price")))))
    move = F.when(F.col("_side") == CALL, F.col("strike") - F.col("leg_strike")).otherwise(F.col("leg_strike") - F.col("strike"))
    long_ = F.when(move > 0, move - F.col("premium")).otherwise(-F.col("premium"))
    gain = F.when(F.col("lots") > 0, long_).otherwise(-long_) * F.abs("lots")
    future = (F.col("strike") - F.col("underlying_price")) * F.col("lots")
    profit = F.when(F.col("type") == "futures", future).otherwise(gain)
    return rows.select("strategy_id", *CHAIN, "leg_idx", leg_id().alias("leg_id"), "strike", profit.alias("profit"))


def chain_payoff(chains: DataFrame, legs: DataFrame) -> DataFrame:
    """Profit of each strategy per strike; where a leg's grid lacks a strike the others are summed."""
    return chain_payoff_legs(chains, legs).groupBy("strategy_id", *CHAIN, "strike").agg(F.sum("profit").alias("profit"))


def profit_scenario(chains: DataFrame, target: str) -> DataFrame:
    """What three calls of each chain and the future gain if the underlying moves to `target` (a column
    constant in the chain): the one at the money, the last strike below 2 atm - target, and the first above (target + atm) / 2."""
    calls = chains.where(F.col("option_type") == CALL)
    chain = Window.partitionBy(*CHAIN)
    df = calls.withColumn("atm", F.min(F.when(F.col("price_status") == AT_THE_MONEY, F.col("strike"))).over(chain))
    inner, outer = F.col("strike") < 2 * F.col("atm") - F.col(target), F.col("strike") > (F.col(target) + F.col("atm")) / 2
    row = F.struct("strike", "price")
    picked = df.groupBy(*CHAIN).agg(
        F.first(target, ignorenulls=True).alias("target"),
        F.max("underlying_price").alias("underlying_price"),
        F.min(F.when(F.col("strike") == F.col("atm"), row)).alias("atm"),
        F.max(F.when(inner, row)).alias("itm"),
        F.min(F.when(outer, row)).alias("otm"),
    )
    kinds = [F.struct(F.lit(k).alias("leg"), F.col(f"{k}.strike").alias("strike"), F.col(f"{k}.price").alias("price"), (F.col("target") - F.col(f"{k}.strike")).alias("value")) for k in ("itm", "atm", "otm")]
    future = F.struct(F.lit("future").alias("leg"), F.lit(None).cast("double").alias("strike"), F.col("underlying_price").alias("price"), F.col("target").alias("value"))
    rows = picked.select(*CHAIN, F.explode(F.array(*kinds, future)).alias("s")).select(*CHAIN, "s.*").where("price is not null")
    return rows.withColumn("profit", F.col("value") - F.col("price")).withColumn("ratio", F.when(F.col("price") != 0, F.col("profit") / F.col("price")))


def stack_series(series: dict[str, DataFrame], columns: tuple[str, ...] = ("timestamp", "timed_value")) -> DataFrame:
    """Several series in one table, named by `series`."""
    out = None
    for name, df in series.items():
        missing = [c for c in columns if c not in df.columns]
        if missing:
            raise ValueError(f"{name} lacks {missing}")
        named = df.select(F.lit(name).alias("series"), *columns)
        out = named if out is None else out.unionByName(named)
    return out
