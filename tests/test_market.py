"""Exact results on small hand-made tables."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from strikeflow.functions import normalize as N
from strikeflow.functions import pricing as P
from strikeflow.operators import analytics as A
from strikeflow.operators import chain as C
from strikeflow.operators import resample as R
from strikeflow.operators.enrich import add_intrinsic_value, add_time_value, join_option_with_future, resolve
from strikeflow.sources import history as H
from strikeflow.streaming import live as L

T0, EXPIRY = datetime(2025, 1, 1), datetime(2025, 3, 28)
CALLS = dict(zip(range(100, 800, 100), (303, 204, 105, 10, 6, 5, 4), strict=True))
PUTS = dict(zip(range(100, 800, 100), (7, 8, 9, 35, 119, 218, 317), strict=True))


@pytest.fixture
def chain(spark):
    rows = [("B", T0, EXPIRY, t, float(k), float(p), 385.0) for t, side in (("c", CALLS), ("p", PUTS)) for k, p in side.items()]
    return spark.createDataFrame(rows, "base_asset_code string, timestamp timestamp_ntz, expiration_date timestamp_ntz, option_type string, strike double, price double, underlying_price double")


def legs(spark, *rows):
    return spark.createDataFrame([("s", i, float(k), n, t) for i, (k, n, t) in enumerate(rows)], "strategy_id string, leg_idx int, strike double, lots int, type string")


def profits(spark, chain, *rows):
    return {r["strike"]: r["profit"] for r in A.chain_payoff(chain, legs(spark, *rows)).collect()}


@pytest.mark.parametrize("strike", [100, 300, 600])
@pytest.mark.parametrize("lots", [1, 3])
def test_payoff_of_single_legs(spark, chain, strike, lots):
    long_call = profits(spark, chain, (strike, lots, "call"))
    assert min(long_call.values()) == -CALLS[strike] * lots
    assert long_call[600] == max(-CALLS[strike], 600 - strike - CALLS[strike]) * lots
    short = profits(spark, chain, (strike, -lots, "call"))
    assert max(short.values()) == CALLS[strike] * lots
    put = profits(spark, chain, (strike, lots, "put"))
    assert min(put.values()) == -PUTS[strike] * lots
    assert put[strike] == -PUTS[strike] * lots


def test_payoff_of_strategies(spark, chain):
    assert profits(spark, chain, (0, 10, "futures"))[700] == (700 - 385) * 10
    both = profits(spark, chain, (300, 1, "call"), (300, 1, "put"))
    assert min(both, key=both.get) == 300
    ids = {r["leg_id"] for r in A.chain_payoff_legs(chain, legs(spark, (300, 1, "call"), (300, 1, "put"))).collect()}
    assert ids == {"#0_call_300_1", "#1_put_300_1"}
    missing = A.leg_premiums(chain, legs(spark, (350, 1, "call"))).collect()
    assert [r["missing_leg"] for r in missing] == [True]


def test_missing_prices(spark):
    rows = [(80.0, None, None, None, None), (None, 105.0, 95.0, None, None), (None, 105.0, None, None, None), (None, None, 95.0, None, None), (None, None, None, 110.0, 90.0), (None, None, None, 110.0, None), (None, None, None, None, 90.0), (0.0, 5.0, 5.0, None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, last double, ask double, bid double, high double, low double")
    got = df.orderBy("i").select(N.filled_price(F.lit(None).cast("double"), *(F.col(c) for c in ("last", "ask", "bid", "high", "low"))).alias("p")).collect()
    assert [r["p"] for r in got] == [80, 100, 105, 95, 100, 110, 90, 0]


def test_expiration_dates(spark):
    texts = ["3FEB25", "19SEP22", "28feb25", "280225", "25-01-01", "03/02/25", "21 of Feb 20204", "31FEB25", "", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(N.expiration_date(F.col("t"))).collect()]
    assert got[:4] == [datetime(2025, 2, 3), datetime(2022, 9, 19), datetime(2025, 2, 28), datetime(2025, 2, 28)]
    assert got[4:] == [None] * 6


def test_instruments(spark):
    names = {
        "ETH_BTC": ("s", None, None, None),
        "BTC-27JUN25": ("f", datetime(2025, 6, 27), None, None),
        "BTC-PERPETUAL": ("f", None, None, None),
        "BTC-FS-26SEP25_24JAN25": ("fc", datetime(2025, 9, 26), None, None),
        "BTC-7FEB25-106000-P": ("o", datetime(2025, 2, 7), 106000.0, "p"),
        "DOGE_USDC-7FEB25-0d4064-C": ("o", datetime(2025, 2, 7), 0.4064, "c"),
        "BTC-CSR13-17JAN25-50000_55000": ("oc", datetime(2025, 1, 17), None, None),
        "BTC-WHAT-IS": (None, None, None, None),
    }
    got = N.with_instruments(spark.createDataFrame([(n,) for n in names], "asset_code string")).collect()
    assert {r["asset_code"]: (r["asset_type"], r["expiration_date"], r["strike"], r["option_type"]) for r in got} == names
    assert [r["asset_code"] for r in got if r["parse_error"]] == ["BTC-WHAT-IS"]


def test_round_time(spark):
    times = [datetime(2025, 1, 1, 4, 35, 59, 997000), datetime(2025, 1, 1, 4, 36, 0, 2000), datetime(2025, 1, 1, 0, 0, 0, 500000), datetime(2025, 1, 1, 0, 0, 1, 500000)]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in times], "t timestamp_ntz").select(N.round_time(F.col("t"))).collect()]
    assert got == [datetime(2025, 1, 1, 4, 36), datetime(2025, 1, 1, 4, 36), datetime(2025, 1, 1), datetime(2025, 1, 1, 0, 0, 2)]


KEYS = "base_asset_code string, expiration_date timestamp_ntz, option_type string, strike double, price double"


@pytest.mark.parametrize(
    ("rows", "keys"),
    [
        ([("a", None, None, None, 1.0)], []),
        ([("a", None, None, None, 1.0), ("b", None, None, None, 1.0)], ["base_asset_code"]),
        ([("a", EXPIRY, None, None, 1.0)], ["expiration_date"]),
        ([("a", EXPIRY, None, None, 1.0), ("b", EXPIRY, None, None, 1.0)], ["base_asset_code", "expiration_date"]),
        ([("a", EXPIRY, "c", 1.0, 1.0)], ["expiration_date", "option_type", "strike"]),
        ([("a", EXPIRY, "c", 1.0, 1.0), ("b", EXPIRY, "c", 1.0, 1.0)], ["base_asset_code", "expiration_date", "option_type", "strike"]),
        ([("a", EXPIRY, "c", 1.0, 1.0), ("a", EXPIRY, None, 1.0, 1.0)], None),
        ([("a", EXPIRY, "c", 1.0, 1.0), ("a", EXPIRY, "c", None, 1.0)], None),
    ],
)
def test_keys(spark, rows, keys):
    df = spark.createDataFrame(rows, KEYS)
    if keys is None:
        with pytest.raises(ValueError):
            R.infer_keys(df)
    else:
        assert R.infer_keys(df) == keys


def test_resample_skips_nulls_and_keeps_order(spark):
    at = lambda h, m: datetime(2025, 1, 1, h, m)
    rows = [("a", at(0, 1), 1.0, 5.0), ("a", at(0, 30), None, 7.0), ("a", at(3, 0), 3.0, None), (None, at(0, 0), 9.0, 9.0)]
    df = R.seed_ohlc(spark.createDataFrame(rows, "asset_code string, timestamp timestamp_ntz, price double, iv double"))
    got = {r["timestamp"].hour: r for r in R.resample(df, "1h", emit_empty_bins=True).collect()}
    assert sorted(got) == [0, 1, 2, 3]
    assert (got[0]["open"], got[0]["close"], got[0]["price"], got[0]["iv"]) == (1.0, 1.0, 1.0, 6.0)
    assert got[1]["price"] is None and got[3]["close"] == 3.0
    assert {r["asset_code"] for r in got.values()} == {"a"}


def test_join_keeps_rows_and_matches_nulls(spark):
    o = spark.createDataFrame([("B", T0, None, "c", 90.0, 12.0), ("B", T0, EXPIRY, "p", 120.0, 12.0), ("B", T0, datetime(2026, 1, 1), "c", 1.0, 1.0)], "base_asset_code string, timestamp timestamp_ntz, underlying_expiration_date timestamp_ntz, option_type string, strike double, price double")
    f = spark.createDataFrame([("B", T0, None, 100.0), ("B", T0, EXPIRY, 110.0), ("B", T0, EXPIRY, 110.0)], "base_asset_code string, timestamp timestamp_ntz, expiration_date timestamp_ntz, price double")
    got = {r["strike"]: r for r in add_time_value(add_intrinsic_value(join_option_with_future(o, f))).collect()}
    assert len(got) == 3
    assert (got[90.0]["underlying_price"], got[90.0]["intrinsic_value"], got[90.0]["timed_value"]) == (100.0, 10.0, 2.0)
    assert (got[120.0]["underlying_price"], got[120.0]["intrinsic_value"]) == (110.0, 10.0)
    assert got[1.0]["underlying_price"] is None and got[1.0]["intrinsic_value"] is None


def test_enrichment_order():
    assert resolve(["timed_value", "intrinsic_value", "price_status"]) == ["underlying_price", "intrinsic_value", "timed_value", "price_status"]
    assert resolve(["timed_value"], ["underlying_price"]) == ["intrinsic_value", "timed_value"]
    with pytest.raises(ValueError):
        resolve(["nothing"])


def test_moneyness_and_desk(spark, chain):
    got = {(r["option_type"], r["strike"]): r["price_status"] for r in C.add_moneyness(chain).collect()}
    assert got["c", 400.0] == got["p", 400.0] == "atm"
    assert (got["c", 300.0], got["p", 300.0], got["c", 500.0], got["p", 500.0]) == ("itm", "otm", "otm", "itm")
    assert [r["strike"] for r in C.nearest_strikes(chain, 3).orderBy("rank").collect()] == [400.0, 300.0, 500.0]
    desk = {r["strike"]: (r["price_call"], r["price_put"]) for r in C.desk(chain).collect()}
    assert desk[300.0] == (105.0, 9.0) and len(desk) == 7
    assert not C.chain_faults(C.select_chain(chain)).count()
    none = C.add_moneyness(chain.withColumn("underlying_price", F.lit(None).cast("double")))
    assert none.where("price_status is not null").count() == 0


def test_normal_cdf(spark):
    import math

    xs = [x / 8 for x in range(-320, 321)]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", P.normal_cdf(F.col("x")).alias("y")).collect()
    assert max(abs(r["y"] - 0.5 * math.erfc(-r["x"] / math.sqrt(2))) for r in got) < 1e-14


def test_black_scholes(spark):
    df = spark.createDataFrame([("c", 100.0, 100.0), ("p", 100.0, 100.0)], "option_type string, underlying_price double, strike double").withColumns({"sigma": F.lit(0.2), "rate": F.lit(0.05), "dividend": F.lit(0.0), "expiration_date": F.lit(datetime(2026, 1, 1)).cast("timestamp_ntz")})
    got = {r["option_type"]: r for r in P.with_greeks(P.with_price(P.with_terms(df, T0))).collect()}
    assert abs(got["c"]["theoretical_price"] - 10.450583572185565) < 1e-9
    assert abs(got["c"]["theoretical_price"] - got["p"]["theoretical_price"] - 100 + 100 * 2.718281828459045**-0.05) < 1e-9
    assert abs(got["c"]["delta"] - 0.6368306511756191) < 1e-9 and abs(got["c"]["delta"] - got["p"]["delta"] - 1) < 1e-12
    late = P.with_greeks(P.with_price(P.with_terms(df, datetime(2026, 6, 1)))).where("option_type = 'c'").first()
    assert late["theoretical_price"] == 0.0 and late["delta"] == 0.0


def test_update_files(spark):
    names = ["a/25-01-22T00-06.parquet", "25-01-22T04.parquet", "25-01-22.parquet", "2025-01-22.parquet", "25-01-22.csv", "x25-01-22.parquet", "25-13-22.parquet"]
    got = {r["n"]: r["t"] for r in spark.createDataFrame([(n,) for n in names], "n string").select("n", H.update_time(F.col("n")).alias("t")).collect()}
    assert [got[n] for n in names] == [datetime(2025, 1, 22, 0, 6), datetime(2025, 1, 22, 4), datetime(2025, 1, 22), datetime(2025, 1, 22), None, None, None]
    files = spark.createDataFrame([("25-01-24.parquet", "1h"), ("25-01-25.parquet", "1h"), ("25-01-26.parquet", "1h"), ("25-01-26.parquet", "EOD")], "path string, timeframe string")
    assert H.updates_since(files, datetime(2025, 1, 25), "1h").count() == 2


@pytest.mark.parametrize(("timeframe", "minutes", "late"), [("1m", 1, False), ("1m", 2, True), ("1h", 60, False), ("1h", 120, True), ("EOD", 1440, False), ("EOD", 2880, True), ("30m", 37, False), ("30m", 38, True)])
def test_gaps(spark, timeframe, minutes, late):
    df = spark.createDataFrame([("a", datetime(2025, 1, 1)), ("a", datetime.fromtimestamp(datetime(2025, 1, 1).timestamp() + 60 * minutes))], "asset_code string, timestamp timestamp_ntz")
    assert bool(L.gaps(df, timeframe).count()) is late


def test_merge_twice_is_the_same(spark, tmp_path):
    rows = [("a", datetime(2024, 12, 31, 5), 1.0), ("a", datetime(2025, 1, 1, 5), 2.0), ("a", datetime(2025, 1, 1, 6), 5.0)]
    df = R.seed_ohlc(spark.createDataFrame(rows, "asset_code string, timestamp timestamp_ntz, price double"))
    merge = L.merge_late(str(tmp_path / "h"), "EOD", ["asset_code"], {"open": "first", "high": "max", "low": "min", "close": "last"})
    merge(df.where("price < 5"), 0)
    merge(df.where("price >= 5"), 1)
    merge(df.where("price >= 5"), 1)
    schema = spark.createDataFrame([], "timestamp timestamp_ntz, open double, high double, close double, year int").schema
    got = {r["timestamp"]: (r["open"], r["high"], r["close"]) for r in L.late_history(spark, str(tmp_path / "h")).read(schema).collect()}
    assert got == {datetime(2024, 12, 31): (1.0, 1.0, 1.0), datetime(2025, 1, 1): (2.0, 5.0, 5.0)}


def test_option_type_looks_ahead_from_its_letter(spark):
    ids = {"SI65000BC9": "c", "SI65000BP5": "p", "SI65000CM280225": "c", "SI65000B": None, "SIC": None, "CSI1P": "c", None: None}
    got = spark.createDataFrame([(k,) for k in ids], "id string").select("id", N.option_type_of(F.col("id")).alias("t")).collect()
    assert {r["id"]: r["t"] for r in got} == ids


def test_means_of_merged_bars_are_exact(spark):
    rows = [("a", datetime(2024, 1, 1, h), float(v)) for h, v in ((1, 1), (2, 2), (3, 9), (4, 4))] + [("a", datetime(2024, 1, 1, 5), None)]
    df = spark.createDataFrame(rows, "asset_code string, timestamp timestamp_ntz, iv double")
    model = {"iv": "mean"}
    old = R.resample(df.where(F.hour("timestamp") <= 3), "EOD", model=model, keep_sums=True)
    merged = R.merge_history(old, df.where(F.hour("timestamp") > 3), "EOD", model=model).collect()
    assert [(r["iv"], r["iv_sum"], r["iv_count"]) for r in merged] == [(4.0, 16.0, 4)]
    with pytest.raises(ValueError, match="sums"):
        R.merge_history(old.drop("iv_sum", "iv_count"), df, "EOD", model=model)


def test_book_without_levels_is_one_row_of_nulls(spark):
    df = spark.createDataFrame([(1, [[1.0, 2.0]], [[3.0, 4.0], [5.0, 6.0]]), (2, [], [[1.0, 1.0]])], "id int, bids array<array<double>>, asks array<array<double>>")
    got = {(r["id"], r["level"], r["bid_price"], r["ask_amount"]) for r in N.book_levels(df).collect()}
    assert got == {(1, 0, 1.0, 4.0), (2, None, None, None)}


def test_legs_meet_by_keys(spark):
    chain = [("A", datetime(2024, 1, 1), datetime(2024, 2, 1), float(k), t, 5.0 + k / 100, 250.0) for k in (100, 200, 300) for t in ("c", "p")]
    chains = spark.createDataFrame(chain, "base_asset_code string, timestamp timestamp_ntz, expiration_date timestamp_ntz, strike double, option_type string, price double, underlying_price double")
    legs = spark.createDataFrame([("s", 0, 200.0, 1, "call"), ("s", 1, 200.0, -1, "put"), ("f", 0, 0.0, 2, "futures"), ("n", 0, 250.0, 1, "call")], "strategy_id string, leg_idx int, strike double, lots int, type string")
    made = A.chain_payoff_legs(chains, legs)
    want = made.collect()
    assert len(want) == 9 and {(r["strategy_id"], r["strike"], r["profit"]) for r in want if r["leg_idx"] == 0} == {("s", 100.0, -7.0), ("s", 200.0, -7.0), ("s", 300.0, 93.0), ("f", 100.0, -300.0), ("f", 200.0, -100.0), ("f", 300.0, 100.0)}
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (made, A.leg_premiums(chains, legs))]
    assert not any(x in plan for plan in plans for x in ("NestedLoop", "Cartesian", "Window"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert sorted(A.chain_payoff_legs(chains, legs).collect()) == sorted(want)
        assert [(r["strategy_id"], r["leg_idx"], r["price"], r["missing_leg"]) for r in A.leg_premiums(chains, legs).orderBy("strategy_id", "leg_idx").collect()] == [("n", 0, None, True), ("s", 0, 7.0, False), ("s", 1, 7.0, False)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


@pytest.mark.parametrize("minutes", [1, 7, 60, 100_000])
def test_blocks_of_time_are_as_whole_series(spark, minutes):
    import random

    from pyspark.sql import Window

    rng = random.Random(minutes)
    start = datetime(2025, 1, 1)
    rows = [(a, start + timedelta(seconds=s), rng.uniform(1, 9) if rng.random() > 0.05 else -1.0) for a in "abc" for s in sorted(rng.sample(range(40_000), 120))]
    rows += [("d", start, 1.0), (None, start, 1.0)] + [("e", start + timedelta(seconds=k), 2.0 + k % 3) for k in range(50)]
    df = spark.createDataFrame(rows, "asset_code string, timestamp timestamp_ntz, price double")
    width = timedelta(minutes=minutes)
    order = Window.partitionBy("asset_code").orderBy("timestamp")
    before = F.lag("price").over(order)
    whole = df.where("asset_code is not null").withColumn("ret", F.when((F.col("price") > 0) & (before > 0), F.ln(F.col("price") / before)))
    last = order.rowsBetween(-9, 0)
    whole = whole.select("asset_code", "timestamp", F.when(F.count("*").over(last) >= 10, F.stddev_samp("ret").over(last) * 252**0.5).alias("v"))
    near = lambda rows: sorted((r[0], r[1], None if r[2] is None else round(r[2], 9)) for r in rows)
    got = P.rolling_volatility(df.where("asset_code is not null"), 10, width=width).select("asset_code", "timestamp", "volatility")
    assert near(got.collect()) == near(whole.collect())
    gaps = df.where("asset_code is not null").withColumn("b", F.lag("timestamp").over(order)).withColumn("s", F.unix_micros(F.col("timestamp").cast("timestamp")) - F.unix_micros(F.col("b").cast("timestamp"))).where("s > 90000000")
    assert sorted(map(tuple, L.gaps(df, "1m", width=width).select("asset_code", "timestamp").collect())) == sorted(map(tuple, gaps.select("asset_code", "timestamp").collect()))


def test_series_meet_by_blocks(spark):
    df = spark.createDataFrame([("a", datetime(2025, 1, 1), 1.0)], "asset_code string, timestamp timestamp_ntz, price double")
    exchanges = [line for line in P.rolling_volatility(df)._jdf.queryExecution().executedPlan().toString().split("\n") if "hashpartitioning(asset_code" in line]
    # Only counts of blocks meet on the series alone.
    assert sum("_block" not in line for line in exchanges) == 1


def test_feeds_that_fall_silent(spark, tmp_path):
    at = lambda d, h: datetime(2025, 1, d, h)
    schema = "asset_code string, timestamp timestamp_ntz"
    L.use_rocksdb(spark)

    def arrive(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = L.snapshots(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema, 1)
        L.run_available(L.silent_feeds(stream, "EOD"), f"{tmp_path}/progress", f"{tmp_path}/out")
        return sorted((r["asset_code"], r["last"].day, r["due"]) for r in spark.read.schema("asset_code string, last timestamp_ntz, due timestamp_ntz").parquet(f"{tmp_path}/out").collect())

    assert arrive(("a", at(1, 0)), ("b", at(1, 1)), ("c", at(1, 2))) == []
    # a falls silent: the watermark is just at the time that its next snapshot is due; b comes a moment before its timer goes
    assert arrive(("b", at(2, 2)), ("c", at(2, 2))) == [("a", 1, at(2, 1))]
    assert arrive(("b", at(3, 2)), ("c", at(3, 2))) == [("a", 1, at(2, 1))]
    # a returns, told once; b goes on, c not
    assert arrive(("a", at(3, 5)), ("b", at(4, 3)), ("b", at(5, 3))) == [("a", 1, at(2, 1)), ("a", 3, at(4, 6)), ("c", 3, at(4, 3))]


def test_nothing_is_exchanged_between_tables_laid_out_by_moment(spark):
    from strikeflow.jobs import live_queries as Q

    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = Q.desk_by_moment(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "Window" in plan and "SortMergeJoin" in plan and "Exchange" not in plan


def test_faults_are_told_by_the_pass_that_writes(spark, tmp_path):
    from strikeflow.operators.guards import refuse, watched

    df = spark.createDataFrame([(1, None), (2, 3.0), (3, 4.0)], "id int, price double")
    rows, seen = watched(df, no_price=F.col("price").isNull())
    rows.write.parquet(f"{tmp_path}/t")
    assert refuse(seen, no_price=0.5) == {"rows": 3, "no_price": 1}
    with pytest.raises(ValueError, match="no_price: 1 of 3"):
        refuse(seen)
