"""The facade, the catalog of files and the live source."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from bandflow.api import Engine
from bandflow.operators import liquidations, live
from bandflow.sources import catalog, exchange
from bandflow.sources.trades import TRADE_SCHEMA, book_diffs, dense_trades, liquidation_orders, with_bands, write_trades


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("store")
    for i, name in enumerate(("2024-01-01_04-00", "2024-01-01_12-00", "2024-01-02_04-00")):
        rows = [(1000 * j, 100.0 + j, 50.0 * (j + 1), 0.5, j % 2, 2) for j in range(5 + i)]
        df = spark.createDataFrame(rows, TRADE_SCHEMA)
        df = df.drop("seg") if i == 0 else df
        (base / "SOLUSDT" / "spot").mkdir(parents=True, exist_ok=True)
        df.toPandas().to_parquet(base / "SOLUSDT" / "spot" / f"{name}.parquet")
    return Engine(spark, str(base))


def test_listing_and_choices(engine, spark):
    assert engine.list_symbols() == ["SOLUSDT"]
    assert [r["name"][:10] for r in engine.list_files("SOLUSDT", newest_first=True).collect()] == ["2024-01-02", "2024-01-01", "2024-01-01"]
    pick = lambda c: len(catalog.selected(spark, engine.base, "SOLUSDT", "spot", c))
    assert pick("") == 3 and pick("2024-01-01_04-00.parquet") == 1 and pick("rango:2024-01-01_04-00.parquet, none.parquet") == 1
    assert pick("2024-01-01_04-00.parquet..2024-01-01_12-00.parquet") == 2
    with pytest.raises(ValueError):
        pick("rango:none.parquet")


def test_analysis_and_errors(engine):
    got = engine.run_analysis("resumen", "SOLUSDT", "spot")
    assert got.error is None and got.frame.first()["trades"] == 18
    assert engine.run_analysis("nope", "SOLUSDT", "spot").error
    assert engine.run_analysis("resumen", "BTCUSDT", "spot").error


def test_written_store_is_read(spark, tmp_path):
    rows = [(1_704_067_200_000 + 3_600_000 * j, 100.0 + j, 50.0 * 4**j, 0.5, j % 2, "SOLUSDT", "spot") for j in range(30)]
    t = spark.createDataFrame(rows, "timestamp long, price double, volume_usdt double, volume_base double, side int, symbol string, market string")
    write_trades(with_bands(t), f"{tmp_path}/store")
    store = Engine(spark, f"{tmp_path}/store")
    assert store.list_symbols() == ["SOLUSDT"] and [r["name"] for r in store.list_files("SOLUSDT").collect()] == ["2024-01-01.parquet", "2024-01-02.parquet"]
    assert store.run_analysis("resumen", "SOLUSDT", "spot").frame.first()["trades"] == 30
    got = store.trades("SOLUSDT", "spot", "2024-01-01.parquet")
    assert got.count() == 24 and [r["price"] for r in got.orderBy("ord").collect()] == [100.0 + j for j in range(24)]
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(seg,10)" in plan(got.where("seg >= 10"))
    cvd = plan(live.cvd(store.trades("SOLUSDT", "spot"), hours=(1, 4)))
    assert cvd.count("FileScan") == 1 and "GreaterThanOrEqual(timestamp,1704157200000)" in cvd
    assert store.drop_file("SOLUSDT", "spot", "2024-01-01.parquet") and store.trades("SOLUSDT", "spot").count() == 6
    assert not store.drop_file("SOLUSDT", "spot", "2024-01-01.parquet")


def test_live_reports_and_dashboard(spark, tmp_path):
    events = "/root/testdata/sf0.001"
    if not Path(events).exists():
        pytest.skip("test tables are not here")
    t = dense_trades(spark, events)
    reports = Engine(spark, str(tmp_path)).live_report(t)
    assert all(df.count() > 0 for df in reports.values())
    # Futures are measured against the last spot price, and the book's steps are counted from it.
    futures, spot = t.where("market = 'futures'"), t.where("market = 'spot'")
    price = spot.orderBy(F.desc("ord")).first()["price"]
    for r in Engine(spark, str(tmp_path)).live_report(futures, spot=spot)["session_vwap"].collect():
        assert r["diff"] == (price - r["vwap"] if r["vwap"] > 0 else 0.0)
    assert "session_vwap" in Engine(spark, str(tmp_path)).live_report_json(futures, spot=spot).first()["json"]
    liqs = liquidations.events(liquidation_orders(spark, events))
    steps = Engine(spark, str(tmp_path)).dashboard(t, book_diffs(spark, events), liqs, spot=spot)["pairs"].collect()
    assert [(r["ask_precio"], r["bid_precio"]) for r in steps] == [(price // 1 + k, price // 1 - k) for k in range(1, 9)]
    assert all(df.count() > 0 for df in Engine(spark, str(tmp_path)).dashboard(t, book_diffs(spark, events), liqs).values())


def test_levels_history(engine):
    found = engine.levels_newest("SOLUSDT")
    engine.append_levels(found, 1, "Asia", "SOLUSDT")
    engine.append_levels(found, 2, "NY", "SOLUSDT")
    last = engine.last_levels("SOLUSDT")
    assert last.count() == found.count() > 0 and last.select("sesion").distinct().first()[0] == "NY"


def test_drop_file_refuses_paths(engine):
    for name in ("../x.parquet", "a/b.parquet", "x.csv"):
        with pytest.raises(ValueError):
            engine.drop_file("SOLUSDT", "spot", name)


def test_reconnect_and_urls():
    r = exchange.Reconnect()
    assert [r.failed() for _ in range(6)] == [5, 5, 5, 5, 30, 5]
    r.connected()
    assert r.failed() == 5
    assert exchange.stream_url("wss://x/ws/", "SOLUSDT") == "wss://x/ws/solusdt@trade"
    assert exchange.SourceConfig("solusdt", futures=False).markets == ["spot"]


def test_stream_source(spark, tmp_path):
    pairs = [exchange.SourceConfig("solusdt"), exchange.SourceConfig("btcusdt", spot=False)]
    lengths = {"spot/solusdt@trade": "5", "futures/btcusdt@trade": ""}
    for market in ("spot", "futures"):
        (tmp_path / market).mkdir()

    def run():
        for name, n in lengths.items():
            (tmp_path / name).write_text(n)
        s = exchange.streams(spark, pairs, "transport", **{"base.spot": f"{tmp_path}/spot", "base.futures": f"{tmp_path}/futures", "batch": "2"})
        s.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
        rows = spark.read.parquet(f"{tmp_path}/out").collect()
        return sorted((r["symbol"], r["market"], r["seq"], r["raw"]) for r in rows)

    want = lambda symbol, market, n: [(symbol, market, i, f"{symbol.lower()}@trade#{i}") for i in range(n)]
    assert run() == want("SOLUSDT", "futures", 3) + want("SOLUSDT", "spot", 5)
    lengths.update({"spot/solusdt@trade": "9", "futures/btcusdt@trade": "4"})
    assert run() == want("BTCUSDT", "futures", 4) + want("SOLUSDT", "futures", 3) + want("SOLUSDT", "spot", 9)
    assert run() == want("BTCUSDT", "futures", 4) + want("SOLUSDT", "futures", 3) + want("SOLUSDT", "spot", 9)


def test_stream_source_plans_ranges_and_waits_without_sleeping(tmp_path):
    reader = exchange.ExchangeReader({"symbols": "a,B", "markets": "spot", "transport": "transport", "batch": "2", "base": str(tmp_path)})
    (tmp_path / "b@trade").write_text("")
    assert reader.latestOffset() == {"A/spot/trade": 3, "B/spot/trade": 0}
    (tmp_path / "b@trade").write_text("7")
    assert reader.latestOffset()["B/spot/trade"] == 0  # its wait isn't over
    reader.next_try.clear()
    end = reader.latestOffset()
    ranges = reader.partitions({"A/spot/trade": 2}, end)
    assert [(r.symbol, r.begin, r.end) for r in ranges] == [("A", 2, 3), ("B", 0, 2), ("B", 2, 4), ("B", 4, 6), ("B", 6, 7)]
    (tmp_path / "fail_once").write_text("")
    with pytest.raises(OSError):
        list(reader.read(ranges[1]))
    assert list(reader.read(ranges[1])) == [(0, "B", "spot", "trade", "b@trade#0"), (1, "B", "spot", "trade", "b@trade#1")]
    with pytest.raises(ValueError):
        exchange.ExchangeReader({"transport": "transport"})


def test_books_and_liquidations_from_their_streams(spark, tmp_path):
    engine, pairs = Engine(spark, str(tmp_path)), [exchange.SourceConfig("a"), exchange.SourceConfig("c")]
    for symbol, n in (("a", 8), ("c", 3)):
        (tmp_path / f"{symbol}@depth@100ms").write_text(str(n))
        (tmp_path / f"{symbol}@forceOrder").write_text(str(n))
    go = lambda: {(r["symbol"], r["side"], r["price"]): r["qty"] for r in engine.follow_books(pairs, "transport", f"{tmp_path}/books", base=str(tmp_path)).collect()}
    # The snapshot is of update 44 and has one bid: messages 4 to 7 of A follow it; C has nothing that reaches it.
    want = {("A", "bid", 1.0): 2.0, **{("A", "bid", 50.0 - i): 1.0 for i in range(4, 8)}, ("A", "ask", 60.0): 7.0, ("C", "bid", 1.0): 2.0}
    assert go() == want
    (tmp_path / "a@depth@100ms").write_text("9")
    assert go() == {**want, ("A", "bid", 42.0): 1.0, ("A", "ask", 60.0): 8.0}
    kept = engine.follow_liquidations(pairs, "transport", f"{tmp_path}/liqs", base=str(tmp_path))
    assert {(r["symbol"], r["n"], r["usdt"]) for r in kept.groupBy("symbol").agg(F.count("*").alias("n"), F.sum("usdt").alias("usdt")).collect()} == {("A", 8, 280.0), ("C", 3, 30.0)}
