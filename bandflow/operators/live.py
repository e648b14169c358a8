"""Reports over the retained day: horizons, divergence, candles, indicators, sessions.

"Now" is always `as_of`, a value from the data or the caller. Horizons are
joined to trades by a handful of rows, so that the trades are read once for
all of them; empty horizons and groups still give rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandflow.functions import expressions as X

RSI_CANDLES, RSI_DELTAS, MACD_CANDLES = 15, 42, 26


def with_as_of(t: DataFrame, as_of: int | None = None) -> DataFrame:
    """`t` with the column `as_of`: given, or the newest time of the table.

    The time is a literal, found first where it isn't given, so that filters
    on it reach the scan.
    """
    if as_of is None:
        as_of = t.agg(F.max("timestamp")).first()[0]
    return t.withColumn("as_of", F.lit(as_of).cast("long"))


def in_horizons(t: DataFrame, hours=X.HORIZON_HOURS) -> DataFrame:
    """A row for each horizon that a trade lies in."""
    reached = F.filter(F.array(*map(F.lit, hours)), lambda h: F.col("timestamp") >= F.col("as_of") - h * X.HOUR_MS)
    return t.where(F.col("timestamp") >= F.col("as_of") - max(hours) * X.HOUR_MS).withColumn("hours", F.explode(reached))


def _horizons(t: DataFrame, hours) -> DataFrame:
    return t.sparkSession.createDataFrame([(h,) for h in hours], "hours int")


def cvd(t: DataFrame, as_of: int | None = None, hours=X.HORIZON_HOURS) -> DataFrame:
    """Bought minus sold volume by horizon; a side other than 0 counts as sold."""
    v, buy = F.col("volume_usdt"), F.col("side") == 0
    sums = in_horizons(with_as_of(t, as_of), hours).groupBy("hours").agg(X.sum_where(buy, v).alias("vol_buy"), X.sum_where(~buy, v).alias("vol_sell"), F.count("*").alias("trades"))
    out = _horizons(t, hours).join(sums, "hours", "left").na.fill(0)
    b, s = F.col("vol_buy"), F.col("vol_sell")
    return out.select("hours", "vol_buy", "vol_sell", (b - s).alias("cvd"), (b + s).alias("vol_total"), "trades", X.dominance(b, s, 1.05, ("BUY", "SELL")).alias("dominance"))


def divergence(t: DataFrame, as_of: int | None = None, hours=X.HORIZON_HOURS) -> DataFrame:
    """Buying share of four groups by horizon, and the signal of smart against retail."""
    v, buy = F.col("volume_usdt"), F.col("side") == 0
    rows = in_horizons(with_as_of(t, as_of), hours)
    aggs = []
    for name, (low, high) in X.LIVE_GROUPS.items():
        of = F.col("seg").between(low, high)
        aggs += [X.sum_where(of & buy, v).alias(f"{name}_buy"), X.sum_where(of & ~buy, v).alias(f"{name}_sell")]
    out = _horizons(t, hours).join(rows.groupBy("hours").agg(*aggs), "hours", "left").na.fill(0.0)
    for name in X.LIVE_GROUPS:
        total = F.col(f"{name}_buy") + F.col(f"{name}_sell")
        out = out.withColumns({f"{name}_vol": total, f"{name}_buy_pct": X.percent(F.col(f"{name}_buy"), total, 50.0)})
    gap = F.col("smart_buy_pct") - F.col("retail_buy_pct")
    return out.select("hours", *(f"{g}_{c}" for g in X.LIVE_GROUPS for c in ("buy_pct", "vol")), X.divergence_signal(gap).alias("signal"), F.abs(gap).alias("intensity"))


def group_candles(t: DataFrame, as_of: int | None = None, hours: int = 4, extra: tuple[Column, ...] = ()) -> DataFrame:
    """One-minute candles of each live group, with `extra` aggregates; minutes without trades have none."""
    rows = with_as_of(t, as_of).where(F.col("timestamp") >= F.col("as_of") - hours * X.HOUR_MS)
    rows = rows.withColumn("grp", X.live_group(F.col("seg"))).where("grp is not null")
    p, v = F.col("price"), F.col("volume_usdt")
    return rows.groupBy("grp", X.minute_start(F.col("timestamp")).alias("ts_min")).agg(F.min_by("price", "ord").alias("open"), F.max(p).alias("high"), F.min(p).alias("low"), F.max_by("price", "ord").alias("close"), F.sum(v).alias("vol_usdt"), X.sum_where(F.col("side") == 0, v).alias("vol_buy"), F.count("*").alias("trades"), *extra)


def _groups(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([(g,) for g in X.LIVE_GROUPS], "grp string")


def _closes(candles: DataFrame, *more: Column) -> DataFrame:
    """A group's closes in time order (at most a candle a minute of the horizon) and other aggregates."""
    in_order = F.array_sort(F.collect_list(F.struct("ts_min", "close")))
    return candles.groupBy("grp").agg(F.transform(in_order, lambda x: x["close"]).alias("c"), *more)


def rsi_of(c: str = "c") -> Column:
    """Relative strength: plain sums of gains and losses over the last 42
    changes; 50 with too few candles or no change, 100 without losses."""
    n = F.size(c)
    changes = F.zip_with(F.slice(c, F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice(c, F.lit(1), F.greatest(n - 1, F.lit(0))), lambda x, y: x - y)
    recent = F.slice(changes, F.greatest(n - RSI_DELTAS, F.lit(1)), F.lit(RSI_DELTAS))
    total = lambda keep: F.aggregate(recent, F.lit(0.0), lambda acc, d: acc + F.greatest(keep(d), F.lit(0.0)))
    g, loss = total(lambda d: d), total(lambda d: -d)
    return F.when(n < RSI_CANDLES, 50.0).when(loss == 0, F.when(g > 0, 100.0).otherwise(50.0)).otherwise(100.0 - 100.0 / (1.0 + g / F.when(loss > 0, loss)))


def macd_of(c: str = "c") -> Column:
    """MACD 12/26/9 as (macd, signal, histogram): averages seeded with the
    first close, folded in one pass; zeros with too few candles."""
    k12, k26, k9 = 2 / 13, 2 / 27, 2 / 10
    start = F.struct(F.get(c, F.lit(0)).alias("a"), F.get(c, F.lit(0)).alias("b"), F.lit(0.0).alias("s"))

    def step(acc: Column, x: Column) -> Column:
        a = x * k12 + acc["a"] * (1 - k12)
        b = x * k26 + acc["b"] * (1 - k26)
        return F.struct(a.alias("a"), b.alias("b"), ((a - b) * k9 + acc["s"] * (1 - k9)).alias("s"))

    def finish(x: Column) -> Column:
        line = x["a"] - x["b"]
        return F.struct(line.alias("macd"), x["s"].alias("signal"), (line - x["s"]).alias("histogram"))

    tail = F.slice(c, F.lit(2), F.greatest(F.size(c) - 1, F.lit(0)))
    nothing = F.struct(F.lit(0.0).alias("macd"), F.lit(0.0).alias("signal"), F.lit(0.0).alias("histogram"))
    return F.when(F.size(c) >= MACD_CANDLES, F.aggregate(tail, start, step, finish)).otherwise(nothing)


def rsi(candles: DataFrame) -> DataFrame:
    return _groups(candles).join(_closes(candles).select("grp", rsi_of().alias("rsi")), "grp", "left").na.fill({"rsi": 50.0})


def macd(candles: DataFrame) -> DataFrame:
    rows = _closes(candles).select("grp", macd_of().alias("m")).select("grp", "m.*")
    return _groups(candles).join(rows, "grp", "left").na.fill(0.0)


def vwap(candles: DataFrame) -> DataFrame:
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3.0
    sums = candles.groupBy("grp").agg(F.sum(typical * F.col("vol_usdt")).alias("pv"), F.sum("vol_usdt").alias("v"))
    out = sums.select("grp", F.when(F.col("v") > 0, F.col("pv") / F.when(F.col("v") > 0, F.col("v"))).otherwise(0.0).alias("vwap"))
    return _groups(candles).join(out, "grp", "left").na.fill(0.0)


def average_prices(t: DataFrame, as_of: int | None = None, hours: int = 4) -> DataFrame:
    """Mean price of bought and of sold trades by group, unweighted."""
    rows = with_as_of(t, as_of).where(F.col("timestamp") >= F.col("as_of") - hours * X.HOUR_MS).withColumn("grp", X.live_group(F.col("seg")))
    means = rows.groupBy("grp").agg(F.avg(F.when(F.col("side") == 0, F.col("price"))).alias("avg_bid"), F.avg(F.when(F.col("side") != 0, F.col("price"))).alias("avg_ask"))
    return _groups(t).join(means, "grp", "left").na.fill(0.0)


def indicators(t: DataFrame, as_of: int | None = None, hours: int = 4) -> DataFrame:
    """All indicators of the four groups, one row each, from one pass over the trades."""
    p, buy = F.col("price"), F.col("side") == 0
    prices = (F.sum(F.when(buy, p)).alias("bid"), F.count_if(buy).alias("bids"), F.sum(F.when(~buy, p)).alias("ask"), F.count_if(~buy).alias("asks"))
    candles = group_candles(t, as_of, hours, prices)
    v = F.col("vol_usdt")
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3.0
    rows = _closes(candles, F.sum(v).alias("vol_total"), F.sum("vol_buy").alias("_b"), F.sum("trades").alias("trades"), F.sum(typical * v).alias("_pv"), *(F.sum(x).alias(x) for x in ("bid", "bids", "ask", "asks")))
    rows = rows.select("grp", "vol_total", "_b", "trades", rsi_of().alias("rsi"), macd_of().alias("m"), F.try_divide("_pv", "vol_total").alias("vwap"), F.try_divide("bid", "bids").alias("avg_bid"), F.try_divide("ask", "asks").alias("avg_ask"))
    out = _groups(t).join(rows, "grp", "left").select("grp", "vol_total", "_b", "trades", "rsi", "m.macd", "m.signal", "m.histogram", "vwap", "avg_bid", "avg_ask")
    out = out.na.fill({"rsi": 50.0}).na.fill(0)
    return out.withColumn("buy_pct", X.percent(F.col("_b"), F.col("vol_total"), 50.0)).drop("_b")


def session_vwap(t: DataFrame, as_of: int | None = None, price: float | None = None, bounded: bool = False) -> DataFrame:
    """Per market session since its last start: VWAP, buying share and the
    distance of the price (by default the newest one). Sessions stay open
    ended unless `bounded`."""
    # No session began before yesterday's Asian one.
    rows = with_as_of(t, as_of).where(F.col("timestamp") >= (F.floor(F.col("as_of") / X.DAY_MS) - 1) * X.DAY_MS + 20 * X.HOUR_MS)
    last = t.agg(F.max_by("price", F.struct("timestamp", "ord")).alias("_last"))
    starts = F.array(*(F.struct(F.lit(name).alias("session"), F.lit(h).alias("h"), F.lit(back).alias("back")) for name, h, back in (("Asia", 20, 1), ("Londres", 4, 0), ("NY", 12, 0))))
    rows = rows.withColumn("x", F.explode(starts))
    begin = (F.floor(F.col("as_of") / X.DAY_MS) - F.col("x.back")) * X.DAY_MS + F.col("x.h") * X.HOUR_MS
    inside = F.col("timestamp") >= begin
    if bounded:
        inside = inside & (F.col("timestamp") < begin + 8 * X.HOUR_MS)
    v, buy = F.col("volume_usdt"), F.col("side") == 0
    sums = rows.where(inside).groupBy(F.col("x.session").alias("session")).agg(F.sum(F.col("price") * v).alias("pv"), F.sum(v).alias("v"), X.sum_where(buy, v).alias("b"), F.count("*").alias("trades"))
    names = t.sparkSession.createDataFrame([("Asia",), ("Londres",), ("NY",)], "session string")
    out = names.join(sums, "session", "left").na.fill(0).crossJoin(F.broadcast(last))  # one row
    mean = F.when(F.col("v") > 0, F.col("pv") / F.when(F.col("v") > 0, F.col("v"))).otherwise(0.0)
    out = out.withColumn("vwap", mean)
    now = F.col("_last") if price is None else F.lit(price)
    return out.select("session", "vwap", F.col("v").alias("vol_total"), "trades", X.percent(F.col("b"), F.col("v"), 50.0).alias("buy_pct"), F.when(F.col("vwap") > 0, now - F.col("vwap")).otherwise(0.0).alias("diff"))


def session_stats(t: DataFrame) -> DataFrame:
    """Totals of each session of each date; the dominant band is the lowest of equals."""
    keys = [X.session_date(F.col("timestamp")).cast("string").alias("session_date"), X.session_of(F.col("timestamp")).alias("session")]
    v, buy = F.col("volume_usdt"), F.col("side") == 0
    by_band = t.groupBy(*keys, "seg").agg(F.min_by("price", "ord").alias("o"), F.min("ord").alias("o_at"), F.max_by("price", "ord").alias("c"), F.max("ord").alias("c_at"), F.count("*").alias("n"), F.sum(v).alias("v"), X.sum_where(buy, v).alias("b"))
    rows = by_band.groupBy("session_date", "session").agg(F.min_by("o", "o_at").alias("open"), F.max_by("c", "c_at").alias("close"), F.sum("n").alias("trades"), F.sum("v").alias("volume"), F.sum("b").alias("_b"), F.max_by("seg", F.struct("v", -F.col("seg"))).alias("dominant_seg"), F.max_by(F.struct("b", "v"), F.struct("v", -F.col("seg"))).alias("_d"))
    share = X.percent(F.col("_b"), F.col("volume"))
    return rows.select("session_date", "session", "open", "close", "trades", X.rounded(F.col("volume"), 2).alias("volume"), X.rounded(share, 1).alias("buy_pct"), X.rounded(X.percent(F.col("volume") - F.col("_b"), F.col("volume")), 1).alias("sell_pct"), "dominant_seg", F.when(X.percent(F.col("_d.b"), F.col("_d.v")) >= 50, "BUY").otherwise("SELL").alias("dominant_side"))


def last_price(t: DataFrame) -> float | None:
    """The price of the newest arrival, a single value; null for no trades."""
    return t.agg(F.max_by("price", "ord")).first()[0]


def retained(t: DataFrame, as_of: int | None = None, ms: int = X.DAY_MS) -> DataFrame:
    """Trades of the last day before the newest one."""
    return with_as_of(t, as_of).where(F.col("timestamp") >= F.col("as_of") - ms).drop("as_of")


def buffer_stats(t: DataFrame, keys: tuple[str, ...] = ("market",)) -> DataFrame:
    v, buy = F.col("volume_usdt"), F.col("side") == 0
    rows = t.groupBy(*keys).agg(F.count("*").alias("trades"), F.count_if(buy).alias("buys"), F.count_if(~buy).alias("sells"), F.sum(v).alias("vol"), X.sum_where(buy, v).alias("vol_buy"), X.sum_where(~buy, v).alias("vol_sell"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"))
    return rows.withColumns({"delta": F.col("vol_buy") - F.col("vol_sell"), "buy_pct": X.percent(F.col("vol_buy"), F.col("vol")), "sell_pct": X.percent(F.col("vol_sell"), F.col("vol"))})


def last_n(t: DataFrame, n: int) -> DataFrame:
    """The n newest arrivals."""
    return t.orderBy(F.desc("ord")).limit(n)


def in_range(t: DataFrame, start: int, end: int) -> DataFrame:
    return t.where(F.col("timestamp").between(start, end))
