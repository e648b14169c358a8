"""The trade queries by name, each with its SQL twin over the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandflow.functions import expressions as X
from bandflow.operators import asof, book, lab, levels, liquidations, live, normalize, windows
from bandflow.sources import trades as T
from bandflow.sources.export import json_bundle, section
from bandflow.sources.shared import new_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

CASE = "CASE " + " ".join(f"WHEN volume_usdt < {b:.1f} THEN {i}" for i, b in enumerate(X.DEFAULT_BOUNDS, 1)) + " ELSE 14 END"
TRADES = f"""trades AS (SELECT *, {CASE} AS seg FROM (SELECT *, floor(price * volume_base * 1024.0::DOUBLE) / 1024.0::DOUBLE AS volume_usdt FROM (
  SELECT event_id AS ord, epoch_us(ts) // 1000 AS timestamp, 100.0::DOUBLE + value AS price, (event_id % 9 + 1) * pow(10.0::DOUBLE, (event_id // 9) % 7) / 10.0::DOUBLE AS volume_base,
  CASE WHEN event_type IN ('error', 'view') THEN 1 ELSE 0 END AS side, CASE WHEN user_id % 2 = 0 THEN 'spot' ELSE 'futures' END AS market, user_id, event_type, value FROM events)))"""
DENSE = TRADES + f""", dense AS (SELECT * REPLACE ({T.DENSE_START} + (timestamp - {T.DENSE_START}) // 30 AS timestamp) FROM trades), now AS (SELECT max(timestamp) AS as_of FROM dense)"""
HOURS = "hours(hours) AS (VALUES " + ", ".join(f"({h}::INTEGER)" for h in X.HORIZON_HOURS) + ")"
BUY = "CASE WHEN side = 0 THEN volume_usdt ELSE 0.0::DOUBLE END"
SELL = "CASE WHEN side = 1 THEN volume_usdt ELSE 0.0::DOUBLE END"
NOT_BUY = "CASE WHEN side <> 0 THEN volume_usdt ELSE 0.0::DOUBLE END"


def R(x: str, n: int) -> str:
    return f"(round(({x}) * {10**n}.0::DOUBLE) / {10**n}.0::DOUBLE)"


def P(part: str, whole: str, default: float = 0.0) -> str:
    return f"(CASE WHEN ({whole}) > 0 THEN ({part}) / ({whole}) * 100.0::DOUBLE ELSE {default}::DOUBLE END)"


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def on_events(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: f(T.event_trades(spark, d))


def on_dense(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: f(T.dense_trades(spark, d))


MEASURES = f"count(*) AS trades, {R('sum(volume_usdt)', 2)} AS vol_usdt, {R(f'sum({BUY}) / sum(volume_usdt) * 100.0', 1)} AS buy_pct, {R(f'sum({SELL}) / sum(volume_usdt) * 100.0', 1)} AS sell_pct"
GROUP = "CASE WHEN seg <= 4 THEN 'Retail (P1-P4)' WHEN seg <= 7 THEN 'Bisagra (P5-P7)' ELSE 'Smart Money (P8-P14)' END"
LIVE = "CASE " + " ".join(f"WHEN seg BETWEEN {a} AND {b} THEN '{g}'" for g, (a, b) in X.LIVE_GROUPS.items()) + " END"
LEVEL = R("floor(price / 0.5::DOUBLE) * 0.5::DOUBLE + 0.25::DOUBLE", 2)
ROLE = "CASE WHEN buy_pct >= 52 THEN 'SOPORTE' WHEN buy_pct <= 48 THEN 'RESISTENCIA' ELSE 'NEUTRAL' END"
DATE = "strftime(make_timestamp(timestamp * 1000), '%Y-%m-%d')"

# --- named analyses -------------------------------------------------------------
query("lab_summary", f"WITH {TRADES} SELECT count(*) AS trades, {R('sum(volume_usdt)', 2)} AS vol_total_usdt, {R('avg(price)', 2)} AS precio_avg, {R('min(price)', 2)} AS precio_min, {R('max(price)', 2)} AS precio_max, {R(f'sum({BUY}) / sum(volume_usdt) * 100.0', 1)} AS buy_pct, {R(f'sum({SELL}) / sum(volume_usdt) * 100.0', 1)} AS sell_pct FROM trades")(on_events(lab.summary))
query("lab_by_segment", f"WITH {TRADES} SELECT seg, count(*) AS trades, {R('sum(volume_usdt)', 2)} AS vol_usdt, {R('sum(volume_usdt) / (SELECT sum(volume_usdt) FROM trades) * 100.0', 2)} AS pct_vol, {R(f'sum({BUY}) / sum(volume_usdt) * 100.0', 1)} AS buy_pct, {R(f'sum({SELL}) / sum(volume_usdt) * 100.0', 1)} AS sell_pct FROM trades GROUP BY seg")(on_events(lab.by_segment))
query("lab_smart_vs_retail", f"WITH {TRADES} SELECT {GROUP} AS grupo, {MEASURES} FROM trades GROUP BY 1")(on_events(lab.smart_vs_retail))
query("lab_top_trades", f"WITH {TRADES} SELECT timestamp, {R('price', 2)} AS precio, {R('volume_usdt', 2)} AS usdt, {R('volume_base', 6)} AS base, side, seg FROM trades ORDER BY {R('volume_usdt', 2)} DESC, ord LIMIT 20")(on_events(lab.top_trades))
query("lab_by_hour", f"WITH {TRADES} SELECT ((timestamp // 3600000) % 24)::INTEGER AS hora_utc, {MEASURES} FROM trades GROUP BY 1")(on_events(lab.by_hour))
query("lab_minute_delta", f"WITH {TRADES} SELECT timestamp // 60000 * 60000 AS minuto, count(*) AS trades, {R(f'sum({BUY})', 2)} AS buy_vol, {R(f'sum({SELL})', 2)} AS sell_vol, {R('sum(CASE WHEN side = 0 THEN volume_usdt ELSE -volume_usdt END)', 2)} AS delta FROM trades GROUP BY 1")(on_events(lab.minute_delta))
query("lab_whales", f"WITH {TRADES} SELECT {DATE} AS fecha, {R('price', 2)} AS precio, {R('volume_usdt', 2)} AS usdt, CASE WHEN side = 0 THEN 'BUY' ELSE 'SELL' END AS side, seg FROM trades WHERE seg >= 10 ORDER BY {R('volume_usdt', 2)} DESC, ord LIMIT 50")(on_events(lab.whales))


def _share(cond: str) -> str:
    return R(f"sum(CASE WHEN {cond} AND side = 0 THEN volume_usdt ELSE 0.0::DOUBLE END) / (sum(CASE WHEN {cond} THEN volume_usdt ELSE 0.0::DOUBLE END) + 1e-9::DOUBLE) * 100.0", 1)


query("lab_divergence", f"WITH {TRADES}, m AS (SELECT timestamp // 60000 * 60000 AS minuto, {_share('seg <= 4')} AS r, {_share('seg >= 8')} AS s, sum(CASE WHEN seg >= 8 THEN volume_usdt ELSE 0.0 END) AS v FROM trades GROUP BY 1) SELECT minuto, r AS retail_buy_pct, CASE WHEN v > 0 THEN s END AS smart_buy_pct, CASE WHEN v > 0 THEN {R('s - r', 1)} END AS divergencia FROM m")(on_events(lambda t: lab.divergence(t, missing=None)))
query("lab_week_segments", f"WITH {TRADES} SELECT year(make_timestamp(timestamp * 1000)) || '-W' || week(make_timestamp(timestamp * 1000)) AS semana, seg, {MEASURES} FROM trades GROUP BY 1, 2")(on_events(lab.week_segments))
_LEVELS = f"count(*) AS trades, {R('sum(volume_usdt)', 2)} AS vol_total, {R(f'sum({BUY})', 2)} AS vol_buy, {R(f'sum({SELL})', 2)} AS vol_sell, {R(f'sum({BUY}) / sum(volume_usdt) * 100.0', 1)} AS buy_pct"
query("lab_daily_levels", f"WITH {TRADES} SELECT *, {ROLE} AS rol FROM (SELECT {DATE} AS fecha, {LEVEL} AS precio_nivel, {_LEVELS}, arg_min(seg, ord) AS seg_dom FROM trades GROUP BY 1, 2)")(on_events(lab.daily_levels))
query("lab_segment_levels", f"WITH {TRADES} SELECT *, {ROLE} AS rol FROM (SELECT seg, {LEVEL} AS precio_nivel, {_LEVELS}, {R(f'sum({SELL}) / sum(volume_usdt) * 100.0', 1)} AS sell_pct FROM trades GROUP BY 1, 2)")(on_events(lab.segment_levels))


@query("lab_registry", "SELECT t.*, (SELECT count(*) FROM events) AS trades FROM (VALUES " + ", ".join(f"('{a.id}', '{a.about}')" for a in lab.ANALYSES.values()) + ") AS t(id, about)")
def lab_registry(spark: SparkSession, d: str) -> DataFrame:
    """The named analyses with the number of trades that each would read."""
    known = spark.createDataFrame([(a.id, a.about) for a in lab.ANALYSES.values()], "id string, about string")
    return known.crossJoin(F.broadcast(T.event_trades(spark, d).agg(F.count("*").alias("trades"))))  # one row


# --- bands -----------------------------------------------------------------------
query("seg_classify", f"WITH {TRADES} SELECT ord, volume_usdt, seg FROM trades")(on_events(lambda t: t.select("ord", "volume_usdt", "seg")))
query("seg_names", f"WITH {TRADES} SELECT ord, seg, 'P' || seg AS short_name, (['" + "','".join(X.FULL_NAMES) + "'])[seg] AS full_name FROM trades")(on_events(lambda t: t.select("ord", "seg", X.named(F.col("seg"), X.SHORT_NAMES, "P??").alias("short_name"), X.named(F.col("seg"), X.FULL_NAMES, "desconocido").alias("full_name"))))
_EDGES = [0, *map(int, X.DEFAULT_BOUNDS)]
query("seg_range_text", f"WITH {TRADES} SELECT DISTINCT seg, (['" + "','".join([f"{a} - {b}" for a, b in zip(_EDGES, _EDGES[1:], strict=False)] + [f"{_EDGES[-1]}+"]) + "'])[seg] AS range_text FROM trades")(on_events(lambda t: t.select("seg", X.Bands().text(F.col("seg")).alias("range_text")).distinct()))
# Another pair's bounds.
CUSTOM = (10.0, 50.0, 200.0, 500.0, 1e3, 2e3, 5e3, 1e4, 5e4, 1e5, 2.5e5, 5e5, 1e6)
_CUSTOM_ROWS = ", ".join(f"('{m}', {i}, {a}::DOUBLE, {f'{b}::DOUBLE' if b else 'NULL'})" for m, bounds in (("spot", X.DEFAULT_BOUNDS), ("futures", CUSTOM)) for i, (a, b) in enumerate(zip([0.0, *bounds], [*bounds, None], strict=True), 1))


@query("seg_custom_bands", f"WITH {TRADES}, bands(market, band, lo, hi) AS (VALUES {_CUSTOM_ROWS}) SELECT ord, t.market, band FROM trades t JOIN bands b ON t.market = b.market AND volume_usdt >= lo AND (hi IS NULL OR volume_usdt < hi)")
def seg_custom_bands(spark: SparkSession, d: str) -> DataFrame:
    """Bands that differ by market: a range join with 28 rows."""
    rows = [(m, i, a, b) for m, bounds in (("spot", X.DEFAULT_BOUNDS), ("futures", CUSTOM)) for i, (a, b) in enumerate(zip([0.0, *bounds], [*bounds, None], strict=True), 1)]
    bands = F.broadcast(spark.createDataFrame(rows, "market string, band int, lo double, hi double"))
    t = T.event_trades(spark, d)
    v = F.col("volume_usdt")
    return t.join(bands, (t["market"] == bands["market"]) & (v >= F.col("lo")) & (F.col("hi").isNull() | (v < F.col("hi")))).select("ord", t["market"], "band")


# --- raw messages ------------------------------------------------------------------
_KIND = "CASE WHEN ord % 97 = 0 OR ord % 79 = 0 OR ord % 73 = 0 THEN 'json' WHEN ord % 89 = 0 THEN 'number' WHEN ord % 83 = 0 THEN 'trade' END"
_VALID = f"SELECT ord, market, timestamp, price, volume_base, {R('price * volume_base', 4)} AS volume_usdt, side FROM trades WHERE ({_KIND}) IS NULL"


def _normalised(market: str | None) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        raw = T.raw_messages(spark, d)
        out = normalize.trades(raw if market is None else raw.where(F.col("market") == market))
        return out.select("ord", "market", "timestamp", "price", "volume_base", X.rounded(F.col("volume_usdt"), 4).alias("volume_usdt"), "side")

    return run


query("norm_spot", f"WITH {TRADES} {_VALID} AND market = 'spot'")(_normalised("spot"))
query("norm_futures", f"WITH {TRADES} {_VALID} AND market = 'futures'")(_normalised("futures"))
query("norm_auto", f"WITH {TRADES} SELECT ord, 'spot' AS market, timestamp FROM trades WHERE ({_KIND}) IS NULL")(lambda spark, d: normalize.detected(T.raw_messages(spark, d)).select("ord", "market", "timestamp"))
query("norm_rejects", f"WITH {TRADES} SELECT ord, {_KIND} AS reject_kind FROM trades WHERE ({_KIND}) IS NOT NULL")(lambda spark, d: normalize.rejects(T.raw_messages(spark, d)).select("ord", "reject_kind"))
query("trade_text", f"WITH {TRADES} SELECT ord, '[' || timestamp || '] ' || strftime(make_timestamp(timestamp * 1000), '%Y-%m-%d %H:%M:%S.%g') || ' UTC | precio: ' || printf('%.2f', price) || ' | vol_usdt: ' || printf('%.2f', volume_usdt) || ' | vol_base: ' || printf('%.8f', volume_base) || ' | ' || CASE side WHEN 0 THEN 'BUY' ELSE 'SELL' END AS line FROM trades")(on_events(lambda t: t.select("ord", normalize.display(t).alias("line"))))

# --- selections and buffer ------------------------------------------------------------
_DAY = f"day AS (SELECT * FROM trades WHERE timestamp >= (SELECT max(timestamp) FROM trades) - {X.DAY_MS})"
query("retention_24h", f"WITH {TRADES}, {_DAY} SELECT ord, timestamp, volume_usdt, seg FROM day")(on_events(lambda t: live.retained(t).select("ord", "timestamp", "volume_usdt", "seg")))
query("buffer_stats", f"WITH {TRADES}, {_DAY} SELECT *, vol_buy - vol_sell AS delta, {P('vol_buy', 'vol')} AS buy_pct, {P('vol_sell', 'vol')} AS sell_pct FROM (SELECT market, count(*) AS trades, count(*) FILTER (side = 0) AS buys, count(*) FILTER (side <> 0) AS sells, sum(volume_usdt) AS vol, sum({BUY}) AS vol_buy, sum({NOT_BUY}) AS vol_sell, min(timestamp) AS first_ts, max(timestamp) AS last_ts FROM day GROUP BY market)")(on_events(lambda t: live.buffer_stats(live.retained(t))))
query("select_last_n", f"WITH {TRADES} SELECT ord, timestamp, price FROM trades ORDER BY ord DESC LIMIT 100")(on_events(lambda t: live.last_n(t, 100).select("ord", "timestamp", "price")))
query("select_range", f"WITH {TRADES} SELECT ord, timestamp, price FROM trades WHERE timestamp BETWEEN {T.DENSE_START + 5 * X.DAY_MS} AND {T.DENSE_START + 9 * X.DAY_MS}")(on_events(lambda t: live.in_range(t, T.DENSE_START + 5 * X.DAY_MS, T.DENSE_START + 9 * X.DAY_MS).select("ord", "timestamp", "price")))
query("grouping_segments", f"WITH {TRADES} SELECT market, seg, count(*) AS trades, sum(volume_usdt) AS vol FROM trades GROUP BY GROUPING SETS ((market, seg), (market))")(on_events(lambda t: t.groupingSets([[F.col("market"), F.col("seg")], [F.col("market")]], "market", "seg").agg(F.count("*").alias("trades"), F.sum("volume_usdt").alias("vol"))))

# --- packets and windows -----------------------------------------------------------------
_PACKETS = DENSE + f""", s AS (SELECT *, timestamp // 1000 AS sec FROM dense), f AS (SELECT *, CASE WHEN sec = lag(sec) OVER (PARTITION BY market ORDER BY ord) THEN 0 ELSE 1 END AS fresh FROM s),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY market ORDER BY ord ROWS UNBOUNDED PRECEDING)::BIGINT AS packet FROM f),
g AS (SELECT market, packet, sec, seg, sum(volume_usdt) AS vol_total, sum({BUY}) AS vol_buy, sum({SELL}) AS vol_sell, count(*) AS trades FROM i GROUP BY GROUPING SETS ((market, packet, sec, seg), (market, packet, sec))),
lastp AS (SELECT market, max(packet) AS lp FROM i GROUP BY market), closed AS (SELECT g.* FROM g JOIN lastp USING (market) WHERE packet < lp)"""
query("packets", f"WITH {_PACKETS} SELECT * FROM closed")(on_dense(windows.packets))
_SIZES = X.WINDOW_PACKETS
_ROLL = " UNION ALL ".join(f"SELECT market, packet, {n}::INTEGER AS \"window\", sum(vol_total) OVER w AS vol_total, sum(vol_buy) OVER w AS vol_buy, sum(vol_sell) OVER w AS vol_sell, (sum(trades) OVER w)::BIGINT AS trades, count(*) OVER w / {n}.0::DOUBLE * 100.0::DOUBLE AS fill_pct FROM closed WHERE seg IS NULL WINDOW w AS (PARTITION BY market ORDER BY packet ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in _SIZES)
query("rolling_windows", f"WITH {_PACKETS}, r AS ({_ROLL}) SELECT *, {P('vol_buy', 'vol_total')} AS buy_pct, {P('vol_sell', 'vol_total')} AS sell_pct FROM r")(on_dense(lambda t: windows.rolling(windows.packets(t), _SIZES)))
_WIN = ", ".join(f"({n}::INTEGER)" for n in X.WINDOW_PACKETS)
query("rolling_by_segment", f"WITH {_PACKETS}, sizes(n) AS (VALUES {_WIN}), lc AS (SELECT market, max(packet) AS lp FROM closed GROUP BY market), r AS (SELECT market, n AS \"window\", seg, sum(vol_total) AS vol_total, sum(vol_buy) AS vol_buy, sum(vol_sell) AS vol_sell, sum(trades)::BIGINT AS trades FROM closed JOIN lc USING (market) JOIN sizes ON n > lp - packet GROUP BY ALL), w AS (SELECT market, \"window\", vol_total AS a FROM r WHERE seg IS NULL) SELECT r.*, {P('vol_total', 'a')} AS pct_vol, {P('vol_buy', 'vol_total')} AS buy_pct, {P('vol_sell', 'vol_total')} AS sell_pct FROM r JOIN w USING (market, \"window\") WHERE seg IS NOT NULL")(on_dense(lambda t: windows.latest(windows.packets(t))))
query("time_windows", f"WITH {_PACKETS} SELECT market, packet, sec, sum(vol_total) OVER w AS vol_total, sum(vol_buy) OVER w AS vol_buy, sum(vol_sell) OVER w AS vol_sell, (sum(trades) OVER w)::BIGINT AS trades FROM closed WHERE seg IS NULL WINDOW w AS (PARTITION BY market ORDER BY sec RANGE BETWEEN 299 PRECEDING AND CURRENT ROW)")(on_dense(lambda t: windows.time_windows(windows.packets(t), 300)))

# --- horizons ----------------------------------------------------------------------------
_IN = f"{HOURS}, x AS (SELECT h.hours, d.* FROM hours h CROSS JOIN now LEFT JOIN dense d ON d.timestamp >= as_of - h.hours * {X.HOUR_MS})"
query("horizon_cvd", f"WITH {DENSE}, {_IN} SELECT *, vol_buy - vol_sell AS cvd, vol_buy + vol_sell AS vol_total, CASE WHEN vol_buy > vol_sell * 1.05::DOUBLE THEN 'BUY' WHEN vol_sell > vol_buy * 1.05::DOUBLE THEN 'SELL' ELSE 'EQ' END AS dominance FROM (SELECT hours, coalesce(sum({BUY}), 0.0) AS vol_buy, coalesce(sum({NOT_BUY}), 0.0) AS vol_sell, count(ord) AS trades FROM x GROUP BY hours)")(on_dense(live.cvd))
_G = ", ".join(f"coalesce(sum(CASE WHEN seg BETWEEN {a} AND {b} AND side = 0 THEN volume_usdt END), 0.0::DOUBLE) AS {g}_b, coalesce(sum(CASE WHEN seg BETWEEN {a} AND {b} THEN volume_usdt END), 0.0::DOUBLE) AS {g}_vol" for g, (a, b) in X.LIVE_GROUPS.items())
_GP = ", ".join(f"{g}_vol, {P(f'{g}_b', f'{g}_vol', 50.0)} AS {g}_buy_pct" for g in X.LIVE_GROUPS)
query("horizon_divergence", f"WITH {DENSE}, {_IN}, g AS (SELECT hours, {_G} FROM x GROUP BY hours), p AS (SELECT hours, {_GP} FROM g) SELECT *, CASE WHEN abs(smart_buy_pct - retail_buy_pct) < 5 THEN 'NEUTRAL' WHEN smart_buy_pct > retail_buy_pct THEN 'SMART_COMPRA' ELSE 'SMART_VENDE' END AS signal, abs(smart_buy_pct - retail_buy_pct) AS intensity FROM p")(on_dense(live.divergence))


def _levels_sql(source: str, keys: str, lowest: bool) -> str:
    tie = "-seg" if lowest else "seg"
    return f"""r AS (SELECT {keys}, arg_max(price, ord) AS ref FROM {source} GROUP BY {keys}), q AS (SELECT s.*, ref, ref * 0.006::DOUBLE AS bs, floor(price / (ref * 0.006::DOUBLE))::BIGINT AS idx, floor(ref / (ref * 0.006::DOUBLE))::BIGINT AS ri FROM {source} s JOIN r USING ({keys}) WHERE ref > 0),
b AS (SELECT {keys}, ref, bs, ri, idx, seg, sum(volume_usdt) AS v, sum({BUY}) AS b, count(*) AS n FROM q WHERE idx <> ri GROUP BY ALL),
k AS (SELECT {keys}, ref, bs, idx, idx < ri AS below, sum(v) AS v, sum(b) AS b, sum(n)::BIGINT AS trade_count, arg_max(seg, (v, {tie})) AS seg_dominante FROM b GROUP BY ALL),
m AS (SELECT *, CASE WHEN below THEN 'soporte' ELSE 'resistencia' END AS tipo, CASE WHEN below THEN b ELSE v - b END AS volumen_usdt FROM k),
o AS (SELECT *, 'volumen' AS criterio, row_number() OVER (PARTITION BY {keys}, tipo ORDER BY volumen_usdt DESC, idx)::INTEGER AS rank FROM m UNION ALL SELECT *, 'trades' AS criterio, row_number() OVER (PARTITION BY {keys}, tipo ORDER BY trade_count DESC, volumen_usdt DESC, idx)::INTEGER AS rank FROM m)
SELECT {keys}, ref AS precio_ref, {R('bs', 8)} AS bucket_size, tipo, criterio, rank, {R('(idx + 0.5::DOUBLE) * bs', 6)} AS precio_nivel, volumen_usdt, trade_count, {P('b', 'v')} AS buy_pct, {P('v - b', 'v')} AS sell_pct, seg_dominante, volumen_usdt AS score FROM o WHERE rank <= 3"""


def _tidy(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"bucket_size": X.rounded(F.col("bucket_size"), 8), "precio_nivel": X.rounded(F.col("precio_nivel"), 6)})


query("horizon_levels", f"WITH {DENSE}, {_IN}, src AS (SELECT * FROM x WHERE ord IS NOT NULL), {_levels_sql('src', 'hours', False)}")(on_dense(lambda t: _tidy(live_levels(t))))
query("levels_file", f"WITH {TRADES}, {_levels_sql('trades', 'market', True)}")(on_events(lambda t: _tidy(levels.file_levels(t, ["market"]))))


def live_levels(t: DataFrame) -> DataFrame:
    return levels.horizon_levels(t)


@query("levels_history_latest", f"WITH {TRADES}, src AS (SELECT * FROM trades WHERE market = 'spot'), l AS (WITH {_levels_sql('src', 'market', True)}) SELECT 2::BIGINT AS timestamp, 'NY' AS sesion, 'SOLUSDT' AS par, * EXCLUDE (market) FROM l")
def levels_history_latest(spark: SparkSession, d: str) -> DataFrame:
    """Two results appended to the history; the newest is read back."""
    path = new_path(spark, "history")
    t = T.event_trades(spark, d)
    for stamp, market in ((1, "futures"), (2, "spot")):
        found = levels.file_levels(t.where(F.col("market") == market), ["market"])
        levels.append_history(levels.history_rows(found, stamp, "NY", "SOLUSDT"), path)
    return _tidy(levels.latest_history(spark, path))


@query("history_union", f"WITH {TRADES}, h AS (SELECT market, seg, count(*) AS n FROM trades WHERE market = 'spot' GROUP BY ALL UNION ALL SELECT market, seg, count(*) AS n FROM trades WHERE market = 'futures' GROUP BY ALL) SELECT * FROM h")
def history_union(spark: SparkSession, d: str) -> DataFrame:
    """Old and new results one below the other."""
    t = T.event_trades(spark, d)
    part = lambda m: t.where(F.col("market") == m).groupBy("market", "seg").agg(F.count("*").alias("n"))
    return part("spot").unionByName(part("futures"))


# --- candles and indicators ------------------------------------------------------------------
_CANDLES = DENSE + f""", cd AS (SELECT {LIVE} AS grp, timestamp // 60000 * 60000 AS ts_min, * FROM dense, now WHERE timestamp >= as_of - {4 * X.HOUR_MS}), candles AS (SELECT grp, ts_min, arg_min(price, ord) AS open, max(price) AS high, min(price) AS low, arg_max(price, ord) AS close, sum(volume_usdt) AS vol_usdt, sum({BUY}) AS vol_buy, count(*) AS trades FROM cd WHERE grp IS NOT NULL GROUP BY grp, ts_min), groups(grp) AS (VALUES ('retail'), ('mid'), ('smart'), ('inst'))"""
_RSI = """ds AS (SELECT grp, close - lag(close) OVER (PARTITION BY grp ORDER BY ts_min) AS d, row_number() OVER (PARTITION BY grp ORDER BY ts_min DESC) AS age, count(*) OVER (PARTITION BY grp) AS n FROM candles),
ss AS (SELECT grp, max(n) AS n, coalesce(sum(d) FILTER (age <= 42 AND d > 0), 0.0::DOUBLE) AS g, coalesce(sum(-d) FILTER (age <= 42 AND d < 0), 0.0::DOUBLE) AS l FROM ds GROUP BY grp),
rsi AS (SELECT grp, CASE WHEN n IS NULL OR n < 15 THEN 50.0::DOUBLE WHEN l = 0 THEN CASE WHEN g > 0 THEN 100.0::DOUBLE ELSE 50.0::DOUBLE END ELSE 100.0::DOUBLE - 100.0::DOUBLE / (1.0::DOUBLE + g / l) END AS rsi FROM groups LEFT JOIN ss USING (grp))"""
_MACD = """cs AS (SELECT grp, close, row_number() OVER (PARTITION BY grp ORDER BY ts_min) AS i, count(*) OVER (PARTITION BY grp) AS n FROM candles),
e AS (WITH RECURSIVE w AS (SELECT grp, i, n, close AS a, close AS b, 0.0::DOUBLE AS s FROM cs WHERE i = 1 UNION ALL SELECT cs.grp, cs.i, cs.n, cs.close * (2.0::DOUBLE / 13) + a * (1 - 2.0::DOUBLE / 13), cs.close * (2.0::DOUBLE / 27) + b * (1 - 2.0::DOUBLE / 27), ((cs.close * (2.0::DOUBLE / 13) + a * (1 - 2.0::DOUBLE / 13)) - (cs.close * (2.0::DOUBLE / 27) + b * (1 - 2.0::DOUBLE / 27))) * 0.2::DOUBLE + s * (1 - 0.2::DOUBLE) FROM w JOIN cs ON cs.grp = w.grp AND cs.i = w.i + 1) SELECT * FROM w WHERE i = n),
macd AS (SELECT grp, coalesce(CASE WHEN n >= 26 THEN a - b END, 0.0::DOUBLE) AS macd, coalesce(CASE WHEN n >= 26 THEN s END, 0.0::DOUBLE) AS signal, coalesce(CASE WHEN n >= 26 THEN a - b - s END, 0.0::DOUBLE) AS histogram FROM groups LEFT JOIN e USING (grp))"""
_VWAP = "vw AS (SELECT grp, coalesce(sum((high + low + close) / 3.0::DOUBLE * vol_usdt) / nullif(sum(vol_usdt), 0), 0.0::DOUBLE) AS vwap FROM groups LEFT JOIN candles USING (grp) GROUP BY grp)"
_AVG = f"av AS (SELECT g.grp, coalesce(avg(price) FILTER (side = 0), 0.0::DOUBLE) AS avg_bid, coalesce(avg(price) FILTER (side <> 0), 0.0::DOUBLE) AS avg_ask FROM groups g LEFT JOIN cd USING (grp) GROUP BY g.grp)"
query("candles", f"WITH {_CANDLES} SELECT * FROM candles")(on_dense(live.group_candles))
query("rsi", f"WITH {_CANDLES}, {_RSI} SELECT grp, {R('rsi', 8)} AS rsi FROM rsi")(on_dense(lambda t: live.rsi(live.group_candles(t)).select("grp", X.rounded(F.col("rsi"), 8).alias("rsi"))))
query("macd", f"WITH {_CANDLES}, {_MACD} SELECT grp, {R('macd', 8)} AS macd, {R('signal', 8)} AS signal, {R('histogram', 8)} AS histogram FROM macd")(on_dense(lambda t: live.macd(live.group_candles(t)).select("grp", *(X.rounded(F.col(c), 8).alias(c) for c in ("macd", "signal", "histogram")))))
query("group_vwap", f"WITH {_CANDLES}, {_VWAP} SELECT grp, {R('vwap', 6)} AS vwap FROM vw")(on_dense(lambda t: live.vwap(live.group_candles(t)).select("grp", X.rounded(F.col("vwap"), 6).alias("vwap"))))
query("avg_price_side", f"WITH {_CANDLES}, {_AVG} SELECT grp, {R('avg_bid', 6)} AS avg_bid, {R('avg_ask', 6)} AS avg_ask FROM av")(on_dense(lambda t: live.average_prices(t).select("grp", X.rounded(F.col("avg_bid"), 6).alias("avg_bid"), X.rounded(F.col("avg_ask"), 6).alias("avg_ask"))))
_IND = ("rsi", "macd", "signal", "histogram", "vwap", "avg_bid", "avg_ask", "buy_pct")
query("group_indicators", f"WITH {_CANDLES}, {_RSI}, {_MACD}, {_VWAP}, {_AVG}, tt AS (SELECT grp, coalesce(sum(vol_usdt), 0.0::DOUBLE) AS vol_total, coalesce(sum(vol_buy), 0.0::DOUBLE) AS vb, coalesce(sum(trades), 0)::BIGINT AS trades FROM groups LEFT JOIN candles USING (grp) GROUP BY grp), j AS (SELECT *, {P('vb', 'vol_total', 50.0)} AS buy_pct FROM tt JOIN rsi USING (grp) JOIN macd USING (grp) JOIN vw USING (grp) JOIN av USING (grp)) SELECT grp, vol_total, trades, " + ", ".join(f"{R(c, 6)} AS {c}" for c in _IND) + " FROM j")(on_dense(lambda t: live.indicators(t).select("grp", "vol_total", "trades", *(X.rounded(F.col(c), 6).alias(c) for c in _IND))))

# --- spot price beside futures -----------------------------------------------------------------
_WITH_SYMBOL = f"(SELECT *, CASE WHEN user_id % 3 = 0 THEN 'SOLUSDT' ELSE 'BTCUSDT' END AS symbol FROM trades)"


@query("asof_spot", f"WITH {TRADES}, s AS (SELECT symbol, ord, price AS spot FROM {_WITH_SYMBOL} WHERE market = 'spot') SELECT f.symbol, f.ord, f.price, spot, f.price - spot AS basis FROM {_WITH_SYMBOL} f ASOF LEFT JOIN s ON f.symbol = s.symbol AND f.ord >= s.ord WHERE f.market = 'futures'")
def asof_spot(spark: SparkSession, d: str) -> DataFrame:
    """Each futures trade with its symbol's last spot price."""
    t = T.event_trades(spark, d).withColumn("symbol", F.when(F.col("user_id") % 3 == 0, "SOLUSDT").otherwise("BTCUSDT"))
    spot = t.where("market = 'spot'").select("symbol", "ord", F.col("price").alias("spot"))
    futures = t.where("market = 'futures'").select("symbol", "ord", "price")
    return asof.last_before(futures, spot, ["symbol"], "spot", stretch=512).withColumn("basis", F.col("price") - F.col("spot"))


# --- sessions ---------------------------------------------------------------------------------
_STARTS = f"""st AS (SELECT * FROM (VALUES ('Asia', 20, 1), ('Londres', 4, 0), ('NY', 12, 0)) AS s(session, h, back) CROSS JOIN now), lastp AS (SELECT arg_max(price, (timestamp, ord)) AS last FROM dense)"""
query("session_vwap", f"WITH {DENSE}, {_STARTS}, z AS (SELECT session, coalesce(sum(price * volume_usdt) / nullif(sum(volume_usdt), 0), 0.0::DOUBLE) AS vwap, coalesce(sum(volume_usdt), 0.0::DOUBLE) AS vol_total, count(ord) AS trades, coalesce(sum({BUY}), 0.0::DOUBLE) AS b FROM st LEFT JOIN dense d ON d.timestamp >= (as_of // {X.DAY_MS} - back) * {X.DAY_MS} + h * {X.HOUR_MS} GROUP BY session) SELECT session, {R('vwap', 6)} AS vwap, vol_total, trades, {P('b', 'vol_total', 50.0)} AS buy_pct, {R('CASE WHEN vwap > 0 THEN last - vwap ELSE 0.0::DOUBLE END', 6)} AS diff FROM z, lastp")(on_dense(lambda t: live.session_vwap(t).withColumns({"vwap": X.rounded(F.col("vwap"), 6), "diff": X.rounded(F.col("diff"), 6)})))
_SESSION = f"CASE WHEN (timestamp // {X.HOUR_MS}) % 24 >= 20 OR (timestamp // {X.HOUR_MS}) % 24 < 4 THEN 'Asia' WHEN (timestamp // {X.HOUR_MS}) % 24 < 12 THEN 'Londres' ELSE 'NY' END"
query("session_stats", f"WITH {TRADES}, k AS (SELECT *, strftime(make_timestamp((timestamp + {4 * X.HOUR_MS}) * 1000), '%Y-%m-%d') AS session_date, {_SESSION} AS session FROM trades), b AS (SELECT session_date, session, seg, sum(volume_usdt) AS v, sum({BUY}) AS b FROM k GROUP BY ALL), dd AS (SELECT session_date, session, arg_max(seg, (v, -seg)) AS dominant_seg, CASE WHEN arg_max(b, (v, -seg)) / max(v) * 100.0 >= 50 THEN 'BUY' ELSE 'SELL' END AS dominant_side FROM b GROUP BY ALL), s AS (SELECT session_date, session, arg_min(price, ord) AS open, arg_max(price, ord) AS close, count(*) AS trades, sum(volume_usdt) AS v, sum({BUY}) AS b FROM k GROUP BY ALL) SELECT session_date, session, open, close, trades, {R('v', 2)} AS volume, {R(P('b', 'v'), 1)} AS buy_pct, {R(P('v - b', 'v'), 1)} AS sell_pct, dominant_seg, dominant_side FROM s JOIN dd USING (session_date, session)")(on_events(live.session_stats))
query("next_dump", f"WITH {TRADES} SELECT ord, timestamp, ((timestamp - {4 * X.HOUR_MS}) // {8 * X.HOUR_MS} + 1) * {8 * X.HOUR_MS} + {4 * X.HOUR_MS} AS next_ts, (((timestamp - {4 * X.HOUR_MS}) // {8 * X.HOUR_MS} + 1) * {8 * X.HOUR_MS} + {4 * X.HOUR_MS} - timestamp) // 1000 AS seconds_left FROM trades")(on_events(lambda t: t.select("ord", "timestamp", X.next_dump(F.col("timestamp")).alias("next_ts"), F.floor((X.next_dump(F.col("timestamp")) - F.col("timestamp")) / 1000).alias("seconds_left"))))

# --- order book ----------------------------------------------------------------------------------
_DIFFS = """diffs AS (SELECT event_id AS ord, event_id * 3 + 1 AS U_, event_id * 3 + 3 AS u, CASE WHEN event_id % 500 = 499 THEN event_id * 3 - 1 ELSE event_id * 3 END AS pu, CASE WHEN event_id % 2 = 0 THEN 'bid' ELSE 'ask' END AS side,
CASE WHEN event_id % 2 = 0 THEN 150.0::DOUBLE - (floor(value * 100)::BIGINT % 2000) / 100.0::DOUBLE ELSE 150.5::DOUBLE + (floor(value * 100)::BIGINT % 2000) / 100.0::DOUBLE END AS price, (event_id % 11)::DOUBLE AS qty FROM events)"""
_BOOK = _DIFFS + ", book AS (SELECT *, price * qty AS usdt FROM (SELECT side, price, arg_max(qty, u) AS qty FROM diffs GROUP BY side, price) WHERE qty > 0)"


def on_book(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: f(book.state(T.book_diffs(spark, d)))


query("book_state", f"WITH {_BOOK} SELECT side, price, qty, {R('usdt', 6)} AS usdt FROM book")(on_book(lambda b: b.withColumn("usdt", X.rounded(F.col("usdt"), 6))))
_SUMMARY = f"""sm AS (SELECT max(price) FILTER (side = 'bid') AS best_bid, min(price) FILTER (side = 'ask') AS best_ask, coalesce(sum(usdt) FILTER (side = 'bid'), 0.0::DOUBLE) AS bid_usdt, coalesce(sum(usdt) FILTER (side = 'ask'), 0.0::DOUBLE) AS ask_usdt, count(*) FILTER (side = 'bid') AS bid_levels, count(*) FILTER (side = 'ask') AS ask_levels FROM book),
s2 AS (SELECT *, {P('bid_usdt', 'bid_usdt + ask_usdt')} AS bid_pct, {P('ask_usdt', 'bid_usdt + ask_usdt')} AS ask_pct, coalesce(best_ask - best_bid, 0.0::DOUBLE) AS spread, coalesce((best_ask + best_bid) / 2, 0.0::DOUBLE) AS mid, coalesce((best_ask - best_bid) / ((best_ask + best_bid) / 2) * 100, 0.0::DOUBLE) AS spread_pct, bid_usdt - ask_usdt AS cvd FROM sm)"""
_S = ("bid_usdt", "ask_usdt", "bid_pct", "ask_pct", "spread", "mid", "spread_pct", "cvd")
query("book_summary", f"WITH {_BOOK}, {_SUMMARY} SELECT best_bid, best_ask, bid_levels, ask_levels, " + ", ".join(f"{R(c, 4)} AS {c}" for c in _S) + " FROM s2")(on_book(lambda b: book.summary(b).withColumns({c: X.rounded(F.col(c), 4) for c in _S})))
_INT = f"""an AS (SELECT floor(mid)::BIGINT AS anchor FROM s2), il AS (SELECT side, CASE WHEN side = 'bid' THEN anchor - floor(price)::BIGINT ELSE ceil(price)::BIGINT - anchor END AS step, qty, usdt FROM book, an),
grid AS (SELECT side, step, anchor FROM (VALUES ('bid'), ('ask')) AS s(side), (SELECT unnest(generate_series(1, 8)) AS step), an WHERE anchor > 0),
lv AS (SELECT side, step, CASE WHEN side = 'bid' THEN anchor - step ELSE anchor + step END AS level, round(coalesce(q, 0.0::DOUBLE))::BIGINT AS qty, round(coalesce(v, 0.0::DOUBLE))::BIGINT AS usdt FROM grid LEFT JOIN (SELECT side, step, sum(qty) AS q, sum(usdt) AS v FROM il GROUP BY side, step) USING (side, step))"""
query("book_levels", f"WITH {_BOOK}, {_SUMMARY}, {_INT} SELECT * FROM lv")(on_book(lambda b: book.integer_levels(b, 8)))
query("book_ratio", f"WITH {_BOOK}, {_SUMMARY}, {_INT}, t AS (SELECT sum(usdt) FILTER (side = 'bid')::DOUBLE AS bid_usdt, sum(usdt) FILTER (side = 'ask')::DOUBLE AS ask_usdt FROM lv) SELECT *, {P('bid_usdt', 'bid_usdt + ask_usdt')} AS bid_pct, {P('ask_usdt', 'bid_usdt + ask_usdt')} AS ask_pct FROM t")(on_book(lambda b: book.ratio(book.integer_levels(b, 8))))
query("book_pairs", f"WITH {_BOOK}, {_SUMMARY}, {_INT} SELECT a.step AS paso, a.level::DOUBLE AS ask_precio, a.usdt::DOUBLE AS ask_usdt, b.level::DOUBLE AS bid_precio, b.usdt::DOUBLE AS bid_usdt, (a.usdt - b.usdt)::DOUBLE AS cvd, CASE WHEN a.usdt + b.usdt > 0 THEN (a.usdt - b.usdt)::DOUBLE / (a.usdt + b.usdt)::DOUBLE * 100.0::DOUBLE ELSE 0.0::DOUBLE END AS cvd_pct FROM lv a JOIN lv b ON a.step = b.step AND a.side = 'ask' AND b.side = 'bid'")(on_book(lambda b: book.pairs(book.integer_levels(b, 8))))
query("book_sequence_gaps", f"WITH {_DIFFS} SELECT ord, u, pu FROM (SELECT *, lag(u) OVER (ORDER BY u) AS last FROM diffs) WHERE last IS NOT NULL AND pu <> last")(lambda spark, d: book.gaps(T.book_diffs(spark, d)).select("ord", "u", "pu"))


@query("book_replay", f"WITH {_DIFFS}, h AS (SELECT (max(event_id) // 2) * 3 + 3 AS last_id FROM events), snap AS (SELECT side, price, qty FROM (SELECT side, price, arg_max(qty, u) AS qty FROM diffs, h WHERE u <= last_id GROUP BY side, price) WHERE qty > 0), al AS (SELECT side, price, qty, last_id AS u, -1 AS o FROM snap, h UNION ALL SELECT side, price, qty, u, ord FROM diffs, h WHERE u >= last_id) SELECT side, price, arg_max(qty, (u, o)) AS qty FROM al GROUP BY side, price HAVING arg_max(qty, (u, o)) > 0")
def book_replay(spark: SparkSession, d: str) -> DataFrame:
    """A snapshot at half of the updates, then the rest."""
    diffs = T.book_diffs(spark, d)
    half = F.broadcast(diffs.agg((F.floor(F.max("ord") / 2) * 3 + 3).alias("last_id")))  # one row
    first = book.state(diffs.crossJoin(half).where(F.col("u") <= F.col("last_id")))
    return book.replay(diffs, first.crossJoin(half).select("last_id", "side", "price", "qty")).select("side", "price", "qty")


# --- liquidations -----------------------------------------------------------------------------------
_LIQ = DENSE + f""", lq AS (SELECT *, {CASE.replace('volume_usdt', 'usdt')} AS seg FROM (SELECT ord, timestamp, CASE WHEN user_id % 3 = 0 THEN 'LONG liq' ELSE 'SHORT liq' END AS kind, price, CASE WHEN ord % 50 = 7 THEN 0.0::DOUBLE ELSE volume_base END AS qty, price * CASE WHEN ord % 50 = 7 THEN 0.0::DOUBLE ELSE volume_base END AS usdt FROM dense WHERE event_type = 'error')), ln AS (SELECT max(timestamp) AS now FROM lq)"""
_SIDES = "count(*) FILTER (kind = 'LONG liq') AS long_count, count(*) FILTER (kind <> 'LONG liq') AS short_count, " + R("coalesce(sum(usdt) FILTER (kind = 'LONG liq'), 0.0::DOUBLE)", 2) + " AS long_usdt, " + R("coalesce(sum(usdt) FILTER (kind <> 'LONG liq'), 0.0::DOUBLE)", 2) + " AS short_usdt"
_TWO = {"long_usdt": X.rounded, "short_usdt": X.rounded}


def on_liquidations(f: Callable[[DataFrame], DataFrame], *money: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        out = f(liquidations.events(T.liquidation_orders(spark, d)))
        return out.withColumns({c: X.rounded(F.col(c), 2) for c in money}) if money else out

    return run


query("liq_events", f"WITH {_LIQ} SELECT ord, timestamp, kind, price, qty, {R('usdt', 2)} AS usdt, seg FROM lq")(on_liquidations(lambda x: x, "usdt"))
query("liq_by_segment", f"WITH {_LIQ} SELECT seg, {_SIDES}, count(*) AS total_count FROM lq GROUP BY seg")(on_liquidations(liquidations.by_segment, "long_usdt", "short_usdt"))
_MIN = ", ".join(f"({m}::INTEGER)" for m in X.LIQUIDATION_MINUTES)
query("liq_windows", f"WITH {_LIQ}, mm(minutes) AS (VALUES {_MIN}), lw AS (SELECT minutes, {_SIDES}, count(ord) AS total_count FROM mm CROSS JOIN ln LEFT JOIN lq ON timestamp >= now - minutes * 60000 GROUP BY minutes) SELECT *, CASE WHEN long_usdt > short_usdt * 1.1::DOUBLE THEN 'LONG' WHEN short_usdt > long_usdt * 1.1::DOUBLE THEN 'SHORT' ELSE 'EQ' END AS dominance FROM lw")(on_liquidations(liquidations.windows, "long_usdt", "short_usdt"))
query("liq_steps", f"WITH {_LIQ}, g AS (SELECT floor(price)::BIGINT AS price, coalesce(sum(usdt) FILTER (kind = 'LONG liq'), 0.0::DOUBLE) AS l, coalesce(sum(usdt) FILTER (kind <> 'LONG liq'), 0.0::DOUBLE) AS s, count(*) AS n FROM lq, ln WHERE timestamp >= now - 1440 * 60000 GROUP BY 1) SELECT price, {R('l', 2)} AS long_usdt, {R('s', 2)} AS short_usdt, {R('l - s', 2)} AS cvd, {R('l + s', 2)} AS total, n FROM g")(on_liquidations(liquidations.price_steps, "long_usdt", "short_usdt", "cvd", "total"))
query("liq_recent", f"WITH {_LIQ} SELECT ord, timestamp, kind, price, qty, {R('usdt', 2)} AS usdt, seg FROM lq ORDER BY ord DESC LIMIT 20")(on_liquidations(liquidations.recent, "usdt"))
query("liq_large", f"WITH {_LIQ} SELECT ord, timestamp, kind, price, qty, {R('usdt', 2)} AS usdt, seg FROM lq WHERE usdt > 50000")(on_liquidations(liquidations.large, "usdt"))
query("liq_parse_json", f"WITH {_LIQ} SELECT ord, kind, {R('usdt', 2)} AS usdt FROM lq")(lambda spark, d: liquidations.events(liquidations.parse(T.liquidation_orders(spark, d).select("ord", F.to_json(F.struct(F.struct("S", "p", "q", "T").alias("o"))).alias("raw")))).select("ord", "kind", X.rounded(F.col("usdt"), 2).alias("usdt")))


# --- sinks ---------------------------------------------------------------------------------------------
@query("parquet_roundtrip", f"WITH {TRADES} SELECT market, seg::SMALLINT AS seg, count(*) AS trades, sum(volume_usdt) AS vol FROM trades GROUP BY ALL")
def parquet_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Trades written below symbol, market and date folders and read back."""
    path = new_path(spark, "trades")
    T.write_trades(T.event_trades(spark, d).withColumn("symbol", F.lit("SOLUSDT")), path)
    return spark.read.parquet(path).groupBy("market", "seg").agg(F.count("*").alias("trades"), F.sum("volume_usdt").alias("vol"))


@query("store_analysed", f"WITH {TRADES} SELECT seg, count(*) AS trades, sum(volume_usdt) AS vol FROM trades WHERE market = 'futures' AND seg >= 10 GROUP BY seg")
def store_analysed(spark: SparkSession, d: str) -> DataFrame:
    """Trades of two symbols written to a store, a part of one as an older single file without bands; found by the
    engine's catalog, read back and filtered by band."""
    from bandflow.api import Engine

    base = new_path(spark, "store")
    t = T.event_trades(spark, d).withColumn("symbol", F.when(F.col("user_id") % 3 == 0, "SOLUSDT").otherwise("BTCUSDT"))
    older = (F.col("symbol") == "BTCUSDT") & (F.col("market") == "futures") & (F.col("ord") % 10 == 0)
    T.write_trades(t.where(~older), base)
    columns = [F.col(n).cast(k).alias(n) for n, k in (x.split() for x in T.TRADE_SCHEMA.split(", ")) if n != "seg"]
    t.where(older).select(*columns).write.parquet(f"{base}/BTCUSDT/futures/2023-12-31_20-00.parquet")
    engine = Engine(spark, base)
    found = None
    for pair in engine.list_symbols():
        one = engine.trades(pair, "futures").where("seg >= 10").select("seg", "volume_usdt")
        found = one if found is None else found.unionAll(one)
    return found.groupBy("seg").agg(F.count("*").alias("trades"), F.sum("volume_usdt").alias("vol"))


_DAY15 = T.DENSE_START + 14 * X.DAY_MS


@query("levels_scheduled", f"WITH {TRADES}, src AS (SELECT * FROM trades WHERE market = 'spot' AND timestamp BETWEEN {_DAY15} AND {_DAY15 + X.DAY_MS - 1}), l AS (WITH {_levels_sql('src', 'market', True)}) SELECT {_DAY15}::BIGINT + due * 60000 AS timestamp, sesion, 'SOLUSDT' AS par, l.* EXCLUDE (market) FROM l, (VALUES (255, 'Asia'), (735, 'Londres'), (1215, 'NY')) x(due, sesion)")
def levels_scheduled(spark: SparkSession, d: str) -> DataFrame:
    """A day's three scheduled level jobs, caught up with in two calls after a stop."""
    from bandflow.api import Engine

    base = new_path(spark, "store")
    T.write_trades(T.event_trades(spark, d).where("market = 'spot'").withColumn("symbol", F.lit("SOLUSDT")), base)
    for now in (_DAY15 + 5 * X.HOUR_MS, _DAY15 + X.DAY_MS):
        Engine(spark, base).run_scheduled_levels("SOLUSDT", now, _DAY15)
    return _tidy(Engine(spark, base).scheduled_levels("SOLUSDT"))


_F4 = lambda *cols: ", ".join(f"'{c}': printf('%.4f', {c}::DOUBLE)" for c in cols)
_S4 = lambda *cols: ", ".join(f"'{c}': {c}::VARCHAR" for c in cols)


@query(
    "report_json",
    f"WITH {DENSE}, {_IN}, c AS (SELECT *, vol_buy - vol_sell AS cvd, vol_buy + vol_sell AS vol_total, CASE WHEN vol_buy > vol_sell * 1.05::DOUBLE THEN 'BUY' WHEN vol_sell > vol_buy * 1.05::DOUBLE THEN 'SELL' ELSE 'EQ' END AS dominance FROM (SELECT hours, coalesce(sum({BUY}), 0.0) AS vol_buy, coalesce(sum({NOT_BUY}), 0.0) AS vol_sell, count(ord) AS trades FROM x GROUP BY hours)), "
    f"g AS (SELECT market, seg, count(*) AS trades, sum(volume_usdt) AS vol_usdt FROM dense GROUP BY ALL), m AS (SELECT market, list({{{_S4('seg', 'trades')}, {_F4('vol_usdt')}}} ORDER BY seg) AS bands FROM g GROUP BY market) "
    f"SELECT to_json({{'cvd': (SELECT list({{{_S4('hours')}, {_F4('vol_buy', 'vol_sell', 'cvd', 'vol_total')}, {_S4('trades', 'dominance')}}} ORDER BY hours) FROM c), 'markets': (SELECT list({{'market': market, 'bands': bands}} ORDER BY market) FROM m)}})::VARCHAR AS json",
)
def report_json(spark: SparkSession, d: str) -> DataFrame:
    """Horizons and the bands of each market as one nested JSON text of display values."""
    t = T.dense_trades(spark, d)
    by_band = t.groupBy("market", "seg").agg(F.count("*").alias("trades"), F.sum("volume_usdt").alias("vol_usdt"))
    return json_bundle({"cvd": section(live.cvd(t), text=True), "markets": section(section(by_band, ["market"], "bands", text=True))})


@query("csv_text", f"WITH {TRADES} SELECT ord, concat_ws(',', timestamp, printf('%.4f', price), printf('%.4f', volume_usdt), side, seg) AS line FROM trades")
def csv_text(spark: SparkSession, d: str) -> DataFrame:
    from bandflow.sources.export import csv_line

    t = T.event_trades(spark, d)
    return t.select("ord", csv_line(t, ["timestamp", "price", "volume_usdt", "side", "seg"]).alias("line"))


@query("csv_quoted", f"WITH {TRADES} SELECT ord, timestamp || ',\"' || CASE side WHEN 0 THEN 'BUY' ELSE 'SELL' END || ', P' || seg || '\",' || printf('%.4f', price) AS line FROM trades")
def csv_quoted(spark: SparkSession, d: str) -> DataFrame:
    """CSV lines with a text that holds a comma."""
    from bandflow.sources.export import csv_line

    t = T.event_trades(spark, d).withColumn("what", F.concat(normalize.side_text(F.col("side")), F.lit(", P"), F.col("seg")))
    return t.select("ord", csv_line(t, ["timestamp", "what", "price"]).alias("line"))


query("trades_from_lineitem", f"SELECT {CASE} AS seg, count(*) AS trades FROM (SELECT l_extendedprice AS volume_usdt FROM lineitem) GROUP BY 1")(lambda spark, d: T.lineitem_trades(spark, d).groupBy("seg").agg(F.count("*").alias("trades")))


def queries() -> dict[str, Query]:
    from bandflow.streaming import queries as streaming

    return QUERIES | streaming.QUERIES


def oracle_sql() -> dict[str, str]:
    from bandflow.streaming import queries as streaming

    return SQL | streaming.SQL
