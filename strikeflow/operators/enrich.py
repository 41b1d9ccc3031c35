"""Enrichment of option history."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strikeflow.operators.chain import add_moneyness
from strikeflow.schema import CALL, DEPENDS, MOMENT, PUT

#: Rows of a futures table up to which it is broadcast in the join: 2 million rows of 24 bytes.
BROADCAST_ROWS = 2_000_000


def join_option_with_future(options: DataFrame, futures: DataFrame, keys: tuple[str, ...] = ("base_asset_code",), broadcast_rows: int | None = None) -> DataFrame:
    """Options with the price of their future as underlying_price. The expiry matches null to null, as perpetual
    futures have none. Futures are made unique first, so that options never multiply.

    The futures side is broadcast only if the caller states its size and that is within bounds; otherwise
    it is a sort-merge join on (keys, timestamp, expiry), which AQE may turn into a
    broadcast by the size it measures.
    """
    f = futures.groupBy(*keys, "timestamp", F.col("expiration_date").alias("f_expiration")).agg(F.max("price").alias("underlying_price"))
    f = f.select(*(F.col(k).alias(f"f_{k}") for k in keys), F.col("timestamp").alias("f_timestamp"), "f_expiration", "underlying_price")
    if broadcast_rows is not None and broadcast_rows <= BROADCAST_ROWS:
        f = F.broadcast(f)
    on = (F.col("timestamp") == F.col("f_timestamp")) & F.col("underlying_expiration_date").eqNullSafe(F.col("f_expiration"))
    for k in keys:
        on &= F.col(k) == F.col(f"f_{k}")
    return options.drop("underlying_price").join(f, on, "left").drop("f_timestamp", "f_expiration", *(f"f_{k}" for k in keys))


def join_by_moment(options: DataFrame, futures: DataFrame) -> DataFrame:
    """join_option_with_future() for tables that are laid out by MOMENT (see layout.py): an asset's futures of a moment, a few, become one row, the
    two meet on the moment alone, and the expiry is looked up there, null to null. Nothing is exchanged, and what follows by chain finds its rows together."""
    future = F.struct("expiration_date", "price")
    of = futures.groupBy(*MOMENT).agg(F.collect_list(future).alias("_futures"))
    rows = options.drop("underlying_price").join(of, list(MOMENT), "left")
    own = F.filter("_futures", lambda f: f["expiration_date"].eqNullSafe(F.col("underlying_expiration_date")))
    return rows.withColumn("underlying_price", F.array_max(F.transform(own, lambda f: f["price"]))).drop("_futures")


def add_intrinsic_value(df: DataFrame) -> DataFrame:
    gain = F.when(F.col("option_type") == CALL, F.col("underlying_price") - F.col("strike")).when(F.col("option_type") == PUT, F.col("strike") - F.col("underlying_price")).otherwise(0.0)
    return df.withColumn("intrinsic_value", F.when(gain > 0, gain).when(gain <= 0, 0.0))


def add_time_value(df: DataFrame) -> DataFrame:
    return df.withColumn("timed_value", F.col("price") - F.col("intrinsic_value"))


def resolve(columns: Iterable[str], present: Iterable[str] = (), force: bool = False) -> list[str]:
    """The columns to compute, in order, so that each comes after those it depends on."""
    present, order = set(present), []

    def visit(c: str) -> None:
        if c not in DEPENDS:
            raise ValueError(f"no enrichment gives {c}")
        if c in order or (c in present and not force):
            return
        for d in DEPENDS[c]:
            visit(d)
        order.append(c)

    for c in sorted(columns, key=list(DEPENDS).index) if set(columns) <= set(DEPENDS) else columns:
        visit(c)
    return order


def enrich_options(options: DataFrame, futures: DataFrame, columns: Iterable[str], force: bool = False) -> DataFrame:
    """Options with the asked columns and what these depend on; present ones are kept unless forced."""
    steps = {
        "underlying_price": lambda d: join_option_with_future(d, futures),
        "intrinsic_value": add_intrinsic_value,
        "timed_value": add_time_value,
        "price_status": add_moneyness,
    }
    for c in resolve(columns, options.columns, force):
        options = options.transform(steps[c])
    return options
