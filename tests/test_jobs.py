"""Scheduled jobs with a clock of their own, the switching of pairs, and reports as text."""

import json

import pytest
from pyspark.sql import functions as F

from bandflow import jobs
from bandflow.api import Engine
from bandflow.functions import expressions as X
from bandflow.sources.export import json_bundle, section
from bandflow.sources.trades import TRADE_SCHEMA
from bandflow.streaming import buffers, pipelines

HOUR = X.HOUR_MS
NOON = 1_704_110_400_000  # 2024-01-01 12:00


def test_due_times():
    assert jobs.next_dump(NOON - 1) == NOON and jobs.next_dump(NOON) == NOON + 8 * HOUR
    quarter = 15 * X.MINUTE_MS
    assert jobs.due_times(NOON, NOON + 16 * HOUR) == [NOON + quarter, NOON + 8 * HOUR + quarter]
    assert jobs.due_times(NOON + quarter, NOON + 8 * HOUR + quarter) == [NOON + 8 * HOUR + quarter]
    assert jobs.due_times(NOON + quarter, NOON + quarter) == []


def test_each_due_time_runs_once_and_what_failed_runs_again(spark, tmp_path):
    ran, broken = [], [True]

    def job(due):
        if due == jobs.due_times(NOON, NOON + 9 * HOUR)[1] and broken.pop():
            broken.append(False)
            raise OSError("the store is away")
        if len(ran) == 3:
            raise ValueError("nothing to do")
        ran.append(due)

    go = lambda now: jobs.run_due(spark, f"{tmp_path}/ledger", "job", now, NOON, job)
    assert go(NOON) == []
    assert len(go(NOON + HOUR)) == 1
    with pytest.raises(OSError):
        go(NOON + 9 * HOUR)
    assert ran == jobs.due_times(NOON, NOON + HOUR)
    assert go(NOON + 26 * HOUR) == jobs.due_times(NOON + HOUR, NOON + 26 * HOUR) and go(NOON + 26 * HOUR) == []
    assert len(ran) == len(set(ran)) == 3
    go(NOON + 40 * HOUR)
    ledger = spark.read.parquet(f"{tmp_path}/ledger").orderBy("due").collect()
    assert [r["due"] for r in ledger] == jobs.due_times(NOON, NOON + 40 * HOUR) and ledger[-1]["error"] == "nothing to do"


def test_scheduled_levels_of_the_files_of_their_time(spark, tmp_path):
    for name, price in (("2024-01-01_12-00", 100.0), ("2024-01-01_20-00", 200.0)):
        rows = [(1000 * j, price + j % 7 * 5, 50.0 + j, 0.5, j % 2, 2) for j in range(40)]
        (tmp_path / "SOLUSDT" / "spot").mkdir(parents=True, exist_ok=True)
        spark.createDataFrame(rows, TRADE_SCHEMA).toPandas().to_parquet(tmp_path / "SOLUSDT" / "spot" / f"{name}.parquet")
    engine = Engine(spark, str(tmp_path))
    assert len(engine.run_scheduled_levels("SOLUSDT", NOON + 9 * HOUR, NOON - 8 * HOUR)) == 3
    assert engine.run_scheduled_levels("SOLUSDT", NOON + 9 * HOUR, NOON - 8 * HOUR) == []
    got = {r["timestamp"]: (r["sesion"], r["precio_ref"] // 100) for r in engine.scheduled_levels("SOLUSDT").collect()}
    quarter = 15 * X.MINUTE_MS
    # There was no file yet at four o'clock: that run has an error in the ledger and no levels.
    assert got == {NOON + quarter: ("Londres", 1), NOON + 8 * HOUR + quarter: ("NY", 2)}
    assert [r["error"] is None for r in spark.read.parquet(f"{tmp_path}/_ledger").orderBy("due").collect()] == [False, True, True]
    assert engine.list_symbols() == ["SOLUSDT"]


def test_switching_pairs(spark, tmp_path):
    control = Engine(spark, str(tmp_path)).control()
    assert control.active() is None
    control.start("solusdt", -1)
    refused = control.change("SOLUSDT", 5, NOON)
    assert not refused.ok and refused.minutes == 0
    done = control.change("btcusdt", 10, NOON + 9 * HOUR)
    assert (done.ok, done.minutes, done.time) == (True, 7 * 60, "04:00 UTC (+1d)")
    assert control.active() == "BTCUSDT" and control.change("ethusdt", 11, NOON - HOUR).time == "12:00 UTC"
    assert control.change("btcusdt", 12, NOON).ok

    schema = "symbol string, market string, ord long, timestamp long, price double, volume_usdt double, side int, seg int"
    rows = [(s, "spot", i, 1000 + i, 1.0, 1.0, 0, 1) for i in range(20) for s in ("SOLUSDT", "BTCUSDT")]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/landing")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/landing")
    pipelines.run_now(buffers.buffered(stream, control.stream()), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    events = spark.read.schema(buffers.BUFFER).parquet(f"{tmp_path}/out")
    n = {(r["symbol"], r["event"]): r["n"] for r in events.where("market = 'spot'").groupBy("symbol", "event").agg(F.count("*").alias("n")).collect()}
    # SOLUSDT is followed up to its removal at 10; BTCUSDT's buffer is opened at 10, emptied at 11 and opened again at 12.
    assert n["SOLUSDT", "refused"] == 10 and n["BTCUSDT", "refused"] == 11
    assert buffers.held(spark, f"{tmp_path}/checkpoint").agg(F.min("ord"), F.max("symbol")).first()[:] == (12, "BTCUSDT")
    assert control.stop(20, NOON).ok and control.active() is None


def test_bounds_that_are_none_keep_the_old_ones(spark, tmp_path):
    engine = Engine(spark, str(tmp_path))
    engine.update_bands((1.0, 2.0))
    for wrong in ((2.0, 1.0), (0.0, 1.0), ()):
        with pytest.raises(ValueError):
            engine.update_bands(wrong)
    assert engine.bands.bounds == (1.0, 2.0)


def test_json_bundle(spark):
    df = spark.createDataFrame([("a", 2, 1.5), ("a", 1, None), ("b", 3, 2.0)], "k string, n int, x double")
    text = json_bundle({"all": section(df), "by": section(section(df, ["k"], "list", text=True)), "none": section(df.where("n > 9"))}).first()["json"]
    assert json.loads(text) == {
        "all": [{"k": "a", "n": 1, "x": None}, {"k": "a", "n": 2, "x": 1.5}, {"k": "b", "n": 3, "x": 2.0}],
        "by": [{"k": "a", "list": [{"n": "1", "x": "NULL"}, {"n": "2", "x": "1.5000"}]}, {"k": "b", "list": [{"n": "3", "x": "2.0000"}]}],
        "none": [],
    }
