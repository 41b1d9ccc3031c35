"""Books: split by kind, derived futures and spot, contract metadata, top of book."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strikeflow.schema import COLUMNS, FUTURE, FUTURE_COLUMNS, OPTION, OPTION_ONLY, SPOT, SPOT_COLUMNS


def of_kind(book: DataFrame, kind: str) -> DataFrame:
    """Rows of one kind, with the columns that the dictionary has for it and those it does not know."""
    df = book.where(F.col("asset_type") == kind)
    if kind == OPTION:
        return df
    unused = set(OPTION_ONLY) if kind == FUTURE else set(COLUMNS) - set(SPOT_COLUMNS)
    return df.drop(*unused) if kind in (FUTURE, SPOT) else df


def stored_by_kind(book: DataFrame, path: str) -> DataFrame:
    """The book written once below `path`, a folder for each kind, and read back: of_kind() then reads its own folder. Without it each
    kind would parse every name again, and its filter, pushed below the parsing, once more for every part that it looks at."""
    book.write.partitionBy("asset_type").parquet(path)
    return book.sparkSession.read.schema(book.schema).parquet(path)


def project(df: DataFrame, columns: Iterable[str] = FUTURE_COLUMNS) -> DataFrame:
    """The listed columns, typed; absent ones are null."""
    return df.select(*((F.col(c) if c in df.columns else F.lit(None)).cast(COLUMNS[c][0]).alias(c) for c in columns))


def union_books(*books: DataFrame) -> DataFrame:
    """Books with different columns, one below the other."""
    out = books[0]
    for b in books[1:]:
        out = out.unionByName(b, allowMissingColumns=True)
    return out


def drop_repeated(book: DataFrame) -> DataFrame:
    """Instruments that were requested twice are one row."""
    return book.dropDuplicates(["asset_code", "timestamp", "request_timestamp"])


def derived_futures(options: DataFrame) -> DataFrame:
    """The futures that options stand on: one row for each time and underlying."""
    f = options.where(F.col("underlying_asset_type") == FUTURE)
    return f.groupBy("timestamp", F.col("underlying_asset_code").alias("asset_code")).agg(
        F.max("base_asset_code").alias("base_asset_code"), F.max("underlying_expiration_date").alias("expiration_date"), F.max("underlying_price").alias("price"), F.lit(FUTURE).alias("asset_type")
    )


def derived_spot(options: DataFrame) -> DataFrame:
    """The other underlyings: one row for each time, code and type."""
    s = options.where(F.col("underlying_asset_type") != FUTURE)
    return s.groupBy("timestamp", F.col("underlying_asset_code").alias("asset_code"), F.col("underlying_asset_type").alias("asset_type")).agg(F.max("underlying_price").alias("price"))


def with_default_underlying(df: DataFrame) -> DataFrame:
    return df.withColumn("underlying_asset_code", F.coalesce("underlying_asset_code", "base_asset_code"))


def board_underlying(board: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """The underlying price that a board implies: strike plus intrinsic value of its lowest call in the money."""
    price = F.min_by(F.col("strike") + F.col("intrinsic_value"), F.when((F.col("option_type") == "c") & (F.col("intrinsic_value") > 0), F.col("strike")))
    return board.join(board.groupBy(*by).agg(price.alias("underlying_price")), list(by), "left")


def series_with_futures(series: DataFrame, futures: DataFrame) -> DataFrame:
    """Series with the expiry of their underlying future."""
    f = futures.groupBy(F.col("asset_code").alias("underlying_asset_code"), F.col("asset_type").alias("underlying_asset_type")).agg(F.max("expiration_date").alias("underlying_expiration_date"))
    return series.join(f, ["underlying_asset_code", "underlying_asset_type"], "left")


def book_with_series(book: DataFrame, series: DataFrame) -> DataFrame:
    """Book rows with their series' columns; a series counts once, so that rows never multiply."""
    new = [c for c in series.columns if c not in book.columns or c == "series_code"]
    return book.join(series.select(*new).dropDuplicates(["series_code"]), "series_code", "left")


def keep_listed(df: DataFrame, listed: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose keys are listed."""
    return df.join(listed.select(*on).distinct(), on, "left_semi")


def quote_table(levels: DataFrame) -> DataFrame:
    """Calls and puts of the top of book side by side, in one aggregate with map-side combination; a contract is at most once at
    the top. `levels`: underlying_index, expiration_date, strike, option_type, level,
    bid_price, ask_price, underlying_price, settlement_price."""
    keys = ["underlying_index", "expiration_date", "strike"]
    sides = [F.max(F.when(F.col("option_type") == t, F.col(c))).alias(f"{c}_{n}") for t, n in (("c", "call"), ("p", "put")) for c in ("bid_price", "ask_price", "underlying_price", "settlement_price")]
    both = levels.where("level = 0 and option_type in ('c', 'p')").groupBy(*keys).agg(*sides)
    u = F.coalesce("underlying_price_call", "underlying_price_put")
    return both.select(*keys, "bid_price_call", "ask_price_call", "bid_price_put", "ask_price_put", u.alias("underlying_price"), (u * F.col("settlement_price_call")).alias("settlement_usd_call"), (u * F.col("settlement_price_put")).alias("settlement_usd_put"))


def quotes_with_contracts(quotes: DataFrame, contracts: DataFrame, bases: DataFrame) -> DataFrame:
    """Quotes with their contract's columns and one base record for each underlying."""
    one = bases.groupBy("underlying_id").agg(*(F.min(c).alias(c) for c in bases.columns if c != "underlying_id"))
    return quotes.join(contracts.dropDuplicates(["contract_id"]), "contract_id", "left").join(one, "underlying_id", "left")
