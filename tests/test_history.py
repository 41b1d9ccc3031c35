"""Histories that jobs keep: nights, late batches, catalogue, compaction, and jobs that die."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strikeflow.operators import resample as R
from strikeflow.sources import history as H
from strikeflow.sources.versions import Versions
from strikeflow.streaming import live as L

MODEL = {"original_timestamp": "last", "open": "first", "high": "max", "low": "min", "close": "last", "price": "last", "iv": "mean"}


def updates(spark, path, frame, *rows):
    """rows: (asset, time, price, iv)"""
    df = spark.createDataFrame([("x", a, k, f"{a}-1", t, float(p), float(v)) for a, k, t, p, v in rows], "exchange_code string, base_asset_code string, asset_type string, asset_code string, timestamp timestamp_ntz, price double, iv double")
    H.write_updates(df, f"{path}/{frame}", frame, digits=4)


def bars(spark, path):
    rows = H.nightly(spark, path).read(H.HISTORY).collect()
    assert len(rows) == len({(r["base_asset_code"], r["asset_type"], r["timestamp"]) for r in rows})
    return {(r["base_asset_code"], r["asset_type"], r["timestamp"]): (r["open"], r["high"], r["low"], r["close"], r["iv"], r["iv_count"]) for r in rows}


def at(day, hour=0, minute=0):
    return datetime(2025, 1, day, hour, minute)


def night(spark, path, **more):
    return H.merge_updates(spark, f"{path}/u", f"{path}/h", more.pop("timeframe", "EOD"), model=MODEL, ohlc=True, **more)


def test_three_nights(spark, tmp_path):
    u = f"{tmp_path}/u"
    updates(spark, u, "1h", ("a", "o", at(1, 5), 1, 10), ("a", "o", at(1, 9), 2, 20), ("b", "f", at(2, 1), 7, 1))
    assert night(spark, tmp_path)
    assert bars(spark, f"{tmp_path}/h")["a", "o", at(1)] == (1.0, 2.0, 1.0, 2.0, 15.0, 2)
    # Nothing is new
    assert not night(spark, tmp_path)
    # A row of the last day, earlier than those that are there, and a new day: the start is the older of the kinds' newest bars
    updates(spark, u, "1h", ("a", "o", at(1, 3), 3, 60), ("a", "o", at(2, 3), 4, 5))
    assert night(spark, tmp_path)
    got = bars(spark, f"{tmp_path}/h")
    assert got["a", "o", at(1)] == (3.0, 3.0, 1.0, 2.0, 30.0, 3)
    assert got["a", "o", at(2)][4:] == (5.0, 1) and got["b", "f", at(2)] == (7.0, 7.0, 7.0, 7.0, 1.0, 1)
    # Before the start: not taken; from it on: taken, though the folder still has all files
    updates(spark, u, "1h", ("a", "o", at(1, 4), 9, 9), ("b", "f", at(2, 0), 5, 3))
    assert night(spark, tmp_path)
    got = bars(spark, f"{tmp_path}/h")
    assert got["a", "o", at(1)][5] == 3 and got["b", "f", at(2)] == (5.0, 7.0, 5.0, 7.0, 2.0, 2)


def test_a_night_that_dies_can_be_run_again(spark, tmp_path, monkeypatch):
    u = f"{tmp_path}/u"
    updates(spark, u, "1h", ("a", "o", at(1, 5), 1, 10))
    night(spark, tmp_path)
    before = bars(spark, f"{tmp_path}/h")
    updates(spark, u, "1h", ("a", "o", at(1, 6), 2, 20), ("a", "o", at(2, 6), 2, 20))

    def dies(*_):
        raise RuntimeError("died")

    for step in ("_described", "_publish"):
        with monkeypatch.context() as m:
            m.setattr(Versions, step, dies)
            with pytest.raises(RuntimeError, match="died"):
                night(spark, tmp_path)
        assert bars(spark, f"{tmp_path}/h") == before
    assert night(spark, tmp_path)
    got = bars(spark, f"{tmp_path}/h")
    assert got["a", "o", at(1)][4:] == (15.0, 2) and got["a", "o", at(2)][4:] == (20.0, 1)
    assert not night(spark, tmp_path)


def test_files_of_coarser_timeframes_and_other_names_stay_out(spark, tmp_path):
    u = f"{tmp_path}/u"
    updates(spark, u, "1m", ("a", "o", at(1, 5, 7), 1, 10))
    updates(spark, u, "EOD", ("a", "o", at(1), 100, 100))
    night(spark, tmp_path, timeframe="1h")
    assert bars(spark, f"{tmp_path}/h") == {("a", "o", at(1, 5)): (1.0, 1.0, 1.0, 1.0, 10.0, 1)}


def test_files_that_changed_or_went_are_told(spark, tmp_path):
    import pathlib
    import shutil

    u = f"{tmp_path}/u"
    updates(spark, u, "1h", ("a", "o", at(1, 5), 1, 10), ("a", "o", at(1, 7), 1, 10))
    night(spark, tmp_path)
    old = next(pathlib.Path(u).rglob("file=2025-01-01T05*/*.parquet"))
    shutil.rmtree(old.parent)
    updates(spark, u, "1h", ("a", "o", at(2, 5), 1, 10))
    assert night(spark, tmp_path)  # another bin
    updates(spark, u, "1h", ("a", "o", at(2, 6), 1, 10))
    assert night(spark, tmp_path)
    with pytest.raises(ValueError, match="gone"):
        updates(spark, u, "1h", ("a", "o", at(1, 8), 1, 10))
        night(spark, tmp_path, start=at(1))
    two = next(pathlib.Path(u).rglob("file=2025-01-02T05*/*.parquet"))
    two.write_bytes(two.read_bytes() + b"x")
    with pytest.raises(ValueError, match="changed"):
        night(spark, tmp_path)


def test_late_batches_count_once(spark, tmp_path, monkeypatch):
    schema = spark.createDataFrame([], "asset_code string, timestamp timestamp_ntz, iv double, iv_sum double, iv_count long, year int").schema
    merge = L.merge_late(f"{tmp_path}/h", "EOD", ["asset_code"], {"iv": "mean"})
    batch = lambda *rows: spark.createDataFrame([("a", t, float(v)) for t, v in rows], "asset_code string, timestamp timestamp_ntz, iv double")
    got = lambda: {r["timestamp"]: (r["iv"], r["iv_count"]) for r in L.late_history(spark, f"{tmp_path}/h").read(schema).collect()}
    merge(batch((at(1, 1), 1), (at(1, 2), 2)), 0)
    one = batch((at(1, 3), 9), (datetime(2024, 1, 1), 5))
    with monkeypatch.context() as m:
        m.setattr(Versions, "_publish", lambda *_: (_ for _ in ()).throw(RuntimeError("died")))
        with pytest.raises(RuntimeError):
            merge(one, 1)
    assert got() == {at(1): (1.5, 2)}
    for _ in range(3):
        merge(one, 1)
    merge(batch(), 2)
    assert got() == {at(1): (4.0, 3), datetime(2024, 1, 1): (5.0, 1)}


def table_of(spark, path, days, file_rows=0):
    """A history of an asset for each letter, in many small files."""
    by = StructType([f for f in H.HISTORY.fields if f.name in H.PARTITIONS])
    rows = [("x", a, "o", "EOD", (d := at(1) + timedelta(days=k)), d.year, float(k)) for a in "a#%+ " for k in range(days if a == "a" else 20)]
    df = spark.createDataFrame(rows, "exchange_code string, base_asset_code string, asset_type string, timeframe string, timestamp timestamp_ntz, year int, price double")
    table = Versions(spark, str(path), by)
    table.write(df, "one", file_rows=file_rows)
    return table, df


def test_catalogue_newest_partitions_and_names_with_odd_letters(spark, tmp_path):
    table, df = table_of(spark, tmp_path, 800)
    assert table.read(H.HISTORY).count() == df.count()
    catalogue = table.partitions()
    assert {(r["base_asset_code"], r["year"], r["rows"]) for r in catalogue.collect()} == {("a", 2025, 365), ("a", 2026, 365), ("a", 2027, 70)} | {(x, 2025, 20) for x in "#%+ "}
    assert H.last_update_of(catalogue) == at(1) + timedelta(days=799)
    newest = table.read(H.HISTORY, H.newest_partitions(catalogue, "o"))
    assert not [f for f in newest.inputFiles() if "base_asset_code=a/" in f and "year=2027" not in f]
    assert newest.count() == 150
    # Neither plan reads the history's files.
    for df in (catalogue, H.list_years(catalogue)):
        assert all("/log/" in f for f in df.inputFiles())


def test_compaction(spark, tmp_path):
    table, df = table_of(spark, tmp_path, 300, 4)
    before = table.partitions().agg(F.sum("files")).first()[0]
    open_reader = table.read(H.HISTORY)
    assert table.compact(H.HISTORY, 4, 1 << 27, "pack")
    assert before == 95 and table.partitions().agg(F.max("files")).first()[0] == 1
    same = ["base_asset_code", "timestamp", "price"]
    for reader in (open_reader, table.read(H.HISTORY)):
        assert sorted(map(tuple, reader.select(same).collect())) == sorted(map(tuple, df.select(same).collect()))
    assert not table.compact(H.HISTORY, 4, 1 << 27, "again")


def test_bars_of_more_than_one_asset_are_refused(spark):
    df = spark.createDataFrame([("a", at(1), 1.0), ("b", at(1), 2.0), ("a", at(2), 3.0), (None, at(2), 3.0)], "asset_code string, timestamp timestamp_ntz, price double")
    with pytest.raises(Exception, match="more than one asset_code"):
        R.resample(df, "EOD", []).collect()
    assert R.resample(df.where(F.col("timestamp") > F.lit(at(1))), "EOD", []).count() == 1
