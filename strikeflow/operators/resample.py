"""Snapshots to timeframe bars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strikeflow.schema import COLUMNS, FIRST, LAST, MAX, MEAN, MIN, TIMEFRAMES

TIMES = ("timestamp", "original_timestamp", "request_timestamp")


def model_of(df: DataFrame, extra: dict[str, str] | None = None) -> dict[str, str]:
    """Column -> rule for the columns of a table; source_<column> goes by its base column."""
    rules = {}
    for c in df.columns:
        _, rule = COLUMNS.get(c.removeprefix("source_"), (None, None))
        if rule and c != "timestamp":
            rules[c] = rule
    return rules | (extra or {})


def ordering(df: DataFrame, tie: Sequence[str] = ()) -> Column:
    """The order of rows within a bin: the times, then what breaks ties."""
    return F.struct(*(c for c in (*TIMES, *tie) if c in df.columns))


def sums_of(column: str) -> tuple[str, str]:
    """Columns that a stored bar keeps beside a mean, so that later rows can be added to it."""
    return f"{column}_sum", f"{column}_count"


def aggregates(df: DataFrame, model: dict[str, str], order: Column, keep_sums: bool = False) -> list[Column]:
    """One aggregate for each column of the model, all in one pass. First and last skip nulls. Rows that are bars themselves
    count in a mean by their sum and count; `keep_sums` returns these, too."""

    def sums(c: str) -> tuple[Column, Column]:
        total, count = sums_of(c)
        known = {total, count} <= set(df.columns)
        one = F.when(F.col(c).isNotNull(), 1)
        return F.sum(F.coalesce(total, c) if known else c), F.coalesce(F.sum(F.coalesce(F.col(count), one) if known else one), F.lit(0)).cast("long")

    made = {
        FIRST: lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), order)),
        LAST: lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), order)),
        MAX: F.max,
        MIN: F.min,
        MEAN: lambda c: sums(c)[0] / sums(c)[1],
    }
    out = [made[rule](c).alias(c) for c, rule in model.items() if c in df.columns]
    if keep_sums:
        out += [x.alias(n) for c, rule in model.items() if rule == MEAN and c in df.columns for x, n in zip(sums(c), sums_of(c), strict=True)]
    return out


PRICES = ("open", "high", "low", "close")


def seed_ohlc(df: DataFrame, model: dict[str, str] | None = None) -> DataFrame:
    """open, high, low and close from the price, where they are absent; with a model, those that it has, and where they are null."""
    if model is None:
        return df.withColumns({c: F.col("price") for c in PRICES if c not in df.columns})
    return df.withColumns({c: F.coalesce(c, "price") if c in df.columns else F.col("price") for c in PRICES if c in model})


def infer_keys(df: DataFrame) -> list[str]:
    """Keys of a table without exchange symbols. Spot: none; futures: the expiry; options: expiry, type and
    strike; before them the base asset if there are several. Mixed tables are an error."""
    have = [c for c in ("expiration_date", "option_type", "strike") if c in df.columns]
    several = "base_asset_code" in df.columns
    asked = [F.count("*").alias("rows"), *(F.count(c).alias(c) for c in have)]
    if several:
        asked += [F.min("base_asset_code").alias("low"), F.max("base_asset_code").alias("high")]
    r = df.agg(*asked).first()
    keys = [c for c in have if r[c]]
    if "strike" in keys or "option_type" in keys:
        if keys != ["expiration_date", "option_type", "strike"] or any(r[c] < r["rows"] for c in keys):
            raise ValueError("an option table needs expiration_date, option_type and strike in every row")
    return (["base_asset_code"] if several and r["low"] != r["high"] else []) + keys


def bins(timeframe: str, time: str = "timestamp") -> Column:
    """Start of the bin: left-closed, aligned to midnight UTC."""
    width = TIMEFRAMES[timeframe] * 60_000_000
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    return F.timestamp_micros(micros - F.pmod(micros, F.lit(width))).cast("timestamp_ntz")


def resample(df: DataFrame, timeframe: str, keys: Sequence[str] = ("asset_code",), model: dict[str, str] | None = None, tie: Sequence[str] = (), emit_empty_bins: bool = False, keep_sums: bool = False) -> DataFrame:
    """Bars by key and bin; `timestamp` becomes the start of the bin.

    One hash aggregate with map-side combination and one shuffle on (keys, bin): no key is
    gathered, however many snapshots it has. Rows with a null key vanish. With
    `emit_empty_bins` bins without rows between a key's first and last one appear with nulls;
    with `keep_sums` means come with their sums and counts, as merge_history() needs them. Rows of more than one
    asset_code in a bar are an error, told by the same pass (see mixed_groups() for which they are).
    """
    keys = list(keys)
    model = {c: r for c, r in (model or model_of(df)).items() if c not in keys}
    rows = df.dropna(subset=keys) if keys else df
    made = aggregates(df, model, ordering(df, tie), keep_sums)
    guarded = "asset_code" in df.columns and "asset_code" not in keys
    if guarded:
        made.append((F.min("asset_code") < F.max("asset_code")).alias("_mixed"))
    bars = rows.groupBy(*keys, bins(timeframe).alias("bin")).agg(*made).withColumnRenamed("bin", "timestamp")
    if guarded:
        bars = bars.withColumn("timestamp", F.when(F.col("_mixed"), F.raise_error(F.lit("rows of more than one asset_code in a bar"))).otherwise(F.col("timestamp"))).drop("_mixed")
    if not emit_empty_bins:
        return bars
    ends = bars.groupBy(*keys).agg(F.min("timestamp").alias("a"), F.max("timestamp").alias("b"))
    grid = ends.select(*keys, F.explode(F.sequence("a", "b", F.expr(f"INTERVAL '{TIMEFRAMES[timeframe]}' MINUTE"))).alias("timestamp"))
    return grid.join(bars, [*keys, "timestamp"], "left")


def mixed_groups(df: DataFrame, keys: Sequence[str], timeframe: str) -> DataFrame:
    """Groups that hold more than one asset: a check of the data."""
    return df.groupBy(*keys, bins(timeframe).alias("timestamp")).agg(F.count_distinct("asset_code").alias("assets")).where("assets > 1")


def last_update(history: DataFrame, kind: str = "asset_type") -> DataFrame:
    """The earliest, over kinds, of the newest time: from there on updates are to be merged."""
    return history.groupBy(kind).agg(F.max("timestamp").alias("newest")).agg(F.min("newest").alias("last_update"))


def merge_history(history: DataFrame, updates: DataFrame, timeframe: str, keys: Sequence[str] = ("asset_code",), model: dict[str, str] | None = None, tie: Sequence[str] = ()) -> DataFrame:
    """History with updates merged in. Bins that updates touch are built again from the stored bar and the
    updates; the others pass through. Means are exact, as bars keep their sums and counts; a
    history that has means without them is refused."""
    rules = model or model_of(history)
    bare = [c for c, rule in rules.items() if rule == MEAN and c in history.columns and not set(sums_of(c)) <= set(history.columns)]
    if bare:
        raise ValueError(f"the history keeps no sums and counts of {bare}; see resample(keep_sums=True)")
    return resample(history.unionByName(updates, allowMissingColumns=True), timeframe, keys, rules, tie, keep_sums=True)
