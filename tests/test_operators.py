"""Golden values and edge cases of the trade operators."""

import math

import pytest
from pyspark.sql import functions as F

from bandflow.functions import expressions as X
from bandflow.operators import book, lab, levels, live, normalize, windows

DAY = 86_400_000


def trades(spark, rows):
    """Rows of (timestamp, volume, side[, price]) in arrival order."""
    full = [(i, r[0], float(r[3]) if len(r) > 3 else 68000.0, float(r[1]), float(r[1]) / 68000.0, r[2], "spot") for i, r in enumerate(rows)]
    t = spark.createDataFrame(full, "ord long, timestamp long, price double, volume_usdt double, volume_base double, side int, market string")
    return t.withColumn("seg", X.Bands().of(F.col("volume_usdt")))


def values(spark, column, data, kind="double"):
    return [r[0] for r in spark.createDataFrame([(x,) for x in data], f"x {kind}").select(column).collect()]


def test_band_bounds_go_up(spark):
    assert values(spark, X.Bands().of(F.col("x")), [0.0, 39.99, 40.0, 100.0, 500.0, 10000.0, 1e7, 9999999.0]) == [1, 1, 2, 3, 4, 8, 14, 13]


def test_custom_bands(spark):
    custom = X.Bands((10.0, 50.0, 200.0, 500.0, 1e3, 2e3, 5e3, 1e4, 5e4, 1e5, 2.5e5, 5e5, 1e6))
    assert values(spark, custom.of(F.col("x")), [50.0, 10000.0]) == [3, 9]


@pytest.mark.parametrize("bounds", [(100.0, 50.0), (0.0, 5.0), (), (5.0, 5.0)])
def test_bands_must_ascend(bounds):
    with pytest.raises(ValueError):
        X.Bands(bounds)


def test_band_text(spark):
    assert values(spark, X.Bands().text(F.col("x")), [1, 2, 8, 14, 15], "int") == ["0 - 40", "40 - 100", "10000 - 50000", "10000000+", "inválido"]


def test_names_out_of_range(spark):
    assert values(spark, X.named(F.col("x"), X.SHORT_NAMES, "P??"), [0, 1, 14, 15], "int") == ["P1", "P1", "P14", "P??"]


def test_rounding_is_binary(spark):
    assert values(spark, X.rounded(F.col("x"), 2), [1.005, 0.285, -2.5]) == [1.0, 0.28, -2.5]


def test_sessions_and_dumps(spark):
    h = X.HOUR_MS
    at = [4 * h - 1, 4 * h, 12 * h, 20 * h, 23 * h]
    assert values(spark, X.session_of(F.col("x")), at, "long") == ["Asia", "Londres", "NY", "Asia", "Asia"]
    assert values(spark, X.next_dump(F.col("x")), at, "long") == [4 * h, 12 * h, 20 * h, 28 * h, 28 * h]
    assert [str(x) for x in values(spark, X.session_date(F.col("x")), [19 * h, 20 * h, 27 * h], "long")] == ["1970-01-01", "1970-01-02", "1970-01-02"]


RAW = '{"e":"trade","E":5,"s":"B","t":9,"p":"%s","q":"%s","T":%s,"m":%s}'


@pytest.mark.parametrize(
    ("raw", "kind", "usdt", "side"),
    [
        (RAW % ("68420.50", "0.00150000", "1712678400123", "false"), None, 102.63075, 0),
        (RAW % ("68420.50", "0.00250000", "1712678400456", "true"), None, 171.05125, 1),
        (RAW % ("68425.00", "0.010", "1712678400789", "false"), None, 684.25, 0),
        ("not json", "json", None, None),
        (None, "json", None, None),
        (RAW % ("0", "1", "5", "true"), "trade", None, None),
        (RAW % ("x", "1", "5", "true"), "number", None, None),
        (RAW % (" 1.5", "1", "5", "true"), "number", None, None),
        (RAW % ("1", "1", "-5", "true"), "json", None, None),
        ('{"p":1.5,"q":"1","T":5,"m":true}', "json", None, None),
        ('{"p":"1.5","q":"1","t":5,"m":true}', "json", None, None),
        ('{"p":"1.5","q":"1","T":5,"m":true}', "json", None, None),
        ('{"e":"trade","E":5,"t":9,"p":"1.5","q":"1","T":5,"m":true}', "json", None, None),
        ('{"e":"trade","E":"5","s":"B","t":9,"p":"1.5","q":"1","T":5,"m":true}', "json", None, None),
        (RAW % ("inf", "1", "5", "true"), None, float("inf"), 1),
        (RAW % ("NaN", "1", "5", "true"), "trade", None, None),
    ],
)
def test_normalise(spark, raw, kind, usdt, side):
    row = normalize.fields(spark.createDataFrame([(raw,)], "raw string")).first()
    assert row["reject_kind"] == kind
    if kind is None:
        assert row["volume_usdt"] == pytest.approx(usdt, abs=1e-9) and row["side"] == side


def window_of(spark, rows, n):
    p = windows.packets(trades(spark, rows), keep_open=True)
    return windows.rolling(p, (n,)).orderBy(F.desc("packet")).first()


def test_window_slides_by_packets(spark):
    rows = [(s * 5000, 100, 0) for s in range(180)]
    assert window_of(spark, rows, 180)["vol_total"] == 18000
    w = window_of(spark, [*rows, (900_000, 500, 1)], 180)
    assert (w["vol_total"], w["vol_buy"], w["vol_sell"], w["fill_pct"]) == (18400, 17900, 500, 100)


def test_open_packet_is_left_out_and_earlier_second_starts_a_packet(spark):
    p = windows.packets(trades(spark, [(1000, 10, 0), (1500, 10, 0), (2000, 10, 1), (1800, 10, 0), (3000, 10, 0)]))
    got = [(r["packet"], r["sec"], r["trades"]) for r in p.where("seg is null").orderBy("packet").collect()]
    assert got == [(1, 1, 2), (2, 2, 1), (3, 1, 1)]


def test_packet_shares(spark):
    p = windows.packets(trades(spark, [(1000, 70, 0), (1000, 30, 1), (2000, 1, 0)]))
    w = windows.latest(p, (180,)).where("seg = 2").first()
    assert w["buy_pct"] == 100.0 and w["pct_vol"] == pytest.approx(70.0)


def test_buffer(spark):
    t = trades(spark, [(10, 100, 0), (11, 200, 1), (12, 300, 0)])
    r = live.buffer_stats(t).first()
    assert (r["vol"], r["vol_buy"], r["vol_sell"], r["buys"], r["sells"]) == (600, 400, 200, 2, 1)
    assert live.retained(trades(spark, [(0, 5, 0), (25 * X.HOUR_MS, 500, 0)])).agg(F.sum("volume_usdt")).first()[0] == 500
    assert live.last_n(t, 1).first()["volume_usdt"] == 300
    assert live.in_range(trades(spark, [(s * 1000, 1, 0) for s in range(100)]), 20_000, 30_000).count() == 11


def test_empty_tables(spark):
    t = trades(spark, [(1, 1, 0)]).limit(0)
    assert lab.summary(t).count() == 0
    assert {r["hours"]: (r["trades"], r["dominance"]) for r in live.cvd(t, as_of=DAY).collect()} == dict.fromkeys(X.HORIZON_HOURS, (0, "EQ"))
    assert [r["retail_buy_pct"] for r in live.divergence(t, as_of=DAY).collect()] == [50.0] * 6
    assert {r["rsi"] for r in live.rsi(live.group_candles(t, as_of=DAY)).collect()} == {50.0}
    assert {r["macd"] for r in live.macd(live.group_candles(t, as_of=DAY)).collect()} == {0.0}
    assert live.session_vwap(t, as_of=DAY, price=1.0).count() == 3
    for a in lab.ANALYSES.values():
        assert a.run(t).count() == 0


def test_divergence_without_large_trades_is_nan(spark):
    r = lab.divergence(trades(spark, [(0, 50, 0)])).first()
    assert math.isnan(r["divergencia"]) and r["retail_buy_pct"] == 100.0


def test_rsi_all_gains(spark):
    rows = [(i * 60_000, 50, 0, 100 + i) for i in range(20)]
    got = {r["grp"]: r["rsi"] for r in live.rsi(live.group_candles(trades(spark, rows))).collect()}
    assert got["retail"] == 100.0 and got["inst"] == 50.0
    flat = [(i * 60_000, 50, 0, 100) for i in range(20)]
    assert {r["rsi"] for r in live.rsi(live.group_candles(trades(spark, flat))).collect()} == {50.0}


def test_macd_against_loop(spark):
    prices = [100 + 7 * math.sin(i / 3) for i in range(60)]
    got = {r["grp"]: r for r in live.macd(live.group_candles(trades(spark, [(i * 60_000, 50, 0, p) for i, p in enumerate(prices)]))).collect()}
    a = b = prices[0]
    s = 0.0
    for p in prices[1:]:
        a, b = p * (2 / 13) + a * (1 - 2 / 13), p * (2 / 27) + b * (1 - 2 / 27)
        s = (a - b) * 0.2 + s * 0.8
    assert got["retail"]["macd"] == pytest.approx(a - b) and got["retail"]["signal"] == pytest.approx(s)
    assert got["mid"]["macd"] == 0.0


def test_levels_ties_and_reference_bucket(spark):
    rows = [(0, 100, 0, 90), (1, 100, 0, 80), (2, 200, 1, 110), (3, 100, 0, 100)]
    got = levels.file_levels(trades(spark, rows), ["market"]).where("criterio = 'volumen'").orderBy("tipo", "rank").collect()
    assert [(r["tipo"], r["rank"], r["volumen_usdt"]) for r in got] == [("resistencia", 1, 200.0), ("soporte", 1, 100.0), ("soporte", 2, 100.0)]
    assert got[1]["precio_nivel"] < got[2]["precio_nivel"]  # equal volume: lower bucket first
    assert levels.file_levels(trades(spark, [(i, 50, 0, 100) for i in range(5)]), ["market"]).count() == 0


def test_dominant_band_ties(spark):
    rows = [(0, 100, 0, 90), (1, 50, 0, 90), (2, 50, 0, 90), (3, 1, 0, 100)]
    low = levels.file_levels(trades(spark, rows), ["market"]).first()["seg_dominante"]
    high = levels.horizon_levels(trades(spark, rows)).first()["seg_dominante"]
    assert (low, high) == (2, 3)


def diffs(spark, rows):
    return spark.createDataFrame(rows, "ord long, u_first long, u long, pu long, side string, price double, qty double")


def test_book(spark):
    d = diffs(spark, [(0, 1, 1, 0, "bid", 99.2, 5.0), (1, 2, 2, 1, "ask", 101.3, 2.0), (2, 3, 3, 2, "bid", 99.2, 0.0), (3, 4, 4, 3, "bid", 98.7, 1.0), (4, 9, 9, 8, "ask", 103.0, 4.0)])
    b = book.state(d)
    assert {(r["side"], r["price"]): r["qty"] for r in b.collect()} == {("bid", 98.7): 1.0, ("ask", 101.3): 2.0, ("ask", 103.0): 4.0}
    s = book.summary(b).first()
    assert s["spread"] == pytest.approx(2.6) and s["mid"] == pytest.approx(100.0)
    lv = {(r["side"], r["step"]): r["qty"] for r in book.integer_levels(b, 3, anchor=100.9).collect()}
    assert lv[("bid", 2)] == 1 and lv[("ask", 2)] == 2 and lv[("ask", 3)] == 4 and lv[("bid", 1)] == 0
    assert book.gaps(d).first()["u"] == 9
    assert book.integer_levels(b.where("side = 'bid'"), 3).count() == 0


def test_parse_levels(spark):
    m = spark.createDataFrame([(0, 1, 2, 0, [["1.5", "2"], ["x", "2"], ["3", "y"]])], "ord long, u_first long, u long, pu long, b array<array<string>>")
    assert [(float(r["price"]), r["qty"]) for r in book.parse_levels(m, "bid", "b").orderBy("price").collect()] == [(1.5, 2.0), (3.0, 0.0)]


def test_text_of_doubles_rounds_the_binary_value_half_to_even(spark):
    from bandflow.functions.expressions import fixed_text

    values = [84.625, 104.125, 1.015, 1.005, 0.125, 0.375, -84.625, -0.001, 0.0, -0.0, 5e-9, 1.5e-8, 0.00390625, 9.995, 9.999999995, 2.0**53 + 2, 1e15 + 0.125, float("inf"), float("-inf"), float("nan")]
    values += [k / 512 for k in range(400)] + [k / 1000 for k in range(0, 5000, 5)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", *(fixed_text(F.col("v"), n).alias(f"t{n}") for n in (2, 4, 8))).collect()
    for r in rows:
        for n in (2, 4, 8):
            assert r[f"t{n}"] == ("%.*f" % (n, r["v"])).replace("nan", "NaN")


@pytest.mark.parametrize("stretch", [3, 1000])
def test_last_value_before_each_row(spark, stretch):
    import random

    from bandflow.operators import asof

    rng = random.Random(stretch)
    left = [(rng.choice(["a", "b", "c", None]), rng.choice([rng.randint(0, 90), None]) if i % 20 == 0 else rng.randint(0, 90), i) for i in range(150)]
    right = [(rng.choice(["a", "b"]), rng.randint(20, 60) if i % 2 else rng.randint(0, 8), rng.choice([None, float(i)])) for i in range(25)]
    got = asof.last_before(spark.createDataFrame(left, "k string, at long, value_of long"), spark.createDataFrame(right, "k string, at long, price double"), ["k"], "price", "at", stretch).collect()
    assert len(got) == len(left)
    for r in got:
        known = [(at, p) for k, at, p in right if p is not None and k == r["k"] and r["at"] is not None and at <= r["at"]]
        assert r["price"] == (max(known)[1] if known else None)


def test_windows_are_infinite_only_while_they_hold_an_infinite_volume(spark):
    rows = [(1_000_000 + 1000 * i, v, 0) for i, v in enumerate([5.0, math.inf, 7.0, 1e-12, 1e-12, 2e-12, 9.0])]
    got = windows.rolling(windows.packets(trades(spark, rows)), (2,)).orderBy("packet").collect()
    assert [r["vol_total"] for r in got] == pytest.approx([5.0, math.inf, math.inf, 7.0 + 1e-12, 2e-12, 3e-12], rel=1e-9, abs=0)
