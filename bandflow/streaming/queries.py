"""Streaming jobs run over what is available and read back; their SQL is that of the batch."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bandflow.functions import expressions as X
from bandflow.operators import liquidations
from bandflow.plans import catalog
from bandflow.sources import trades as T
from bandflow.sources.shared import delete, new_path
from bandflow.streaming import books, buffers, dump, pipelines, windows

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _landed(spark: SparkSession, rows: DataFrame, label: str) -> DataFrame:
    """`rows` written as Parquet and opened again as a stream, in a file and a task for each core, however few row groups the source has: nothing is sorted or kept by trigger."""
    path, cores = new_path(spark, label), spark.sparkContext.defaultParallelism
    rows.repartition(cores).write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", max(4, cores)).parquet(path)


def _kept(spark: SparkSession, rows: DataFrame, label: str) -> DataFrame:
    """`rows` written once and read back."""
    path = new_path(spark, label)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


#: Rows of a trigger, which is what a task may have to sort and hold of one key.
TRIGGER_ROWS = 600_000


def _in_turns(spark: SparkSession, rows: DataFrame, label: str, run: Callable[[DataFrame], None], turns: int = 3, order: str = "ord", trigger_rows: int | None = TRIGGER_ROWS) -> None:
    """Lands `rows` in `turns` parts of their order, and lets `run` read each part from where it stopped before.

    A part lands in slices of about `trigger_rows` rows (None: in one), one
    file and one trigger each, in order: files are taken by the time of their
    writing. So memory doesn't grow with the table, only the number of triggers.
    """
    path = new_path(spark, label)
    low, high, n = rows.agg(F.min(order), F.max(order), F.count("*")).first()
    slices = max(1, math.ceil(n / turns / trigger_rows)) if trigger_rows else 1
    parts = turns * slices
    bounds = [low + (high + 1 - low) * i // parts for i in range(parts + 1)] if low is not None else [0] * (slices + 1)
    for i, (begin, end) in enumerate(zip(bounds, bounds[1:], strict=False), 1):
        part = rows.where((F.col(order) >= begin) & (F.col(order) < end))
        (part if slices == 1 else part.repartition(1)).write.mode("append").parquet(path)
        if i % slices == 0:
            stream = spark.readStream.schema(rows.schema)
            run((stream if slices == 1 else stream.option("maxFilesPerTrigger", 1)).parquet(path))
    delete(spark, path)


def _window_states(spark: SparkSession, d: str, kind: int) -> DataFrame:
    """Rows of one kind of the packets and windows of the dense day, in three runs that go on from one checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", pipelines.STATE_STORE)
    out, checkpoint = new_path(spark, "windows"), new_path(spark, "checkpoint")
    trades = T.dense_trades(spark, d).select("market", "ord", "timestamp", "seg", "side", "volume_usdt")
    _in_turns(spark, trades, "landing", lambda stream: pipelines.run_now(windows.states(stream, emit=(kind,)), out, checkpoint))
    return spark.read.schema(f"market string, {windows.SCHEMA}").parquet(out)


def stream_packets(spark: SparkSession, d: str) -> DataFrame:
    """Closed packets by band of a stream in three runs."""
    return windows.packets(_window_states(spark, d, windows.PACKET))


def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """All nine windows after every closed packet of a stream in three runs."""
    return windows.rolling(_window_states(spark, d, windows.WINDOW))


def stream_window_bands(spark: SparkSession, d: str) -> DataFrame:
    """The windows' bands at the end of a stream in three runs."""
    return windows.latest(_window_states(spark, d, windows.BAND))


def stream_minute(spark: SparkSession, d: str) -> DataFrame:
    """Minute totals of a stream, as its complete result stands at the end."""
    stream = _landed(spark, T.event_trades(spark, d).select("timestamp", "side", "volume_usdt"), "landing")
    out, checkpoint = new_path(spark, "minutes"), new_path(spark, "checkpoint")
    pipelines.run_now(pipelines.minute_totals(stream), out, checkpoint, "complete")
    return spark.read.parquet(out)


def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Raw messages of both markets through the ingest job; the stored trades by band."""
    stream = _landed(spark, T.raw_messages(spark, d).withColumn("symbol", F.lit("SOLUSDT")), "landing")
    out, checkpoint = new_path(spark, "trades"), new_path(spark, "checkpoint")
    pipelines.ingest(stream, out, checkpoint).awaitTermination()
    stored = spark.read.parquet(out)
    return stored.groupBy("symbol", "market", "seg").agg(F.count("*").alias("trades"))


#: Liquidations that `stream_liquidations` keeps.
KEPT = 300


def _symbols() -> Column:
    """Two symbols for the test trades."""
    return F.when(F.col("user_id") % 3 == 0, "SOLUSDT").otherwise("BTCUSDT")


def stream_buffer(spark: SparkSession, d: str) -> DataFrame:
    """Totals of the day's buffers after three runs; one market of one symbol is never registered."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", pipelines.STATE_STORE)
    out, checkpoint, landing = new_path(spark, "buffer"), new_path(spark, "checkpoint"), new_path(spark, "commands")
    known = [("solusdt", "spot"), ("btcusdt", "spot"), ("btcusdt", "futures")]
    spark.createDataFrame([(*k, -1, "register") for k in known], "symbol string, market string, ord long, command string").write.parquet(landing)
    commands = spark.readStream.schema("symbol string, market string, ord long, command string").parquet(landing)
    # Some trades come 26 hours late.
    late = F.col("timestamp") - F.when(F.col("ord") % 97 == 5, 26 * X.HOUR_MS).otherwise(0)
    trades = T.event_trades(spark, d).withColumns({"symbol": _symbols(), "timestamp": late}).select("symbol", "market", "ord", "timestamp", "price", "volume_usdt", "side", "seg")
    _in_turns(spark, trades, "landing", lambda stream: pipelines.run_now(buffers.buffered(stream, commands), out, checkpoint))
    rows = spark.read.schema(buffers.BUFFER).parquet(out)
    refused = rows.where("event = 'refused'").groupBy("symbol", "market").agg(F.count("*").alias("inserted")).select("symbol", "market", F.lit("refused").alias("event"), "inserted")
    last = rows.where("event = 'totals'").groupBy("symbol", "market").agg(F.max_by(F.struct(*rows.columns[3:]), "inserted").alias("x")).select("symbol", "market", "x.*")
    return last.unionByName(refused, allowMissingColumns=True)


def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions that were frozen during three runs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", pipelines.STATE_STORE)
    out, checkpoint = new_path(spark, "sessions"), new_path(spark, "checkpoint")
    trades = T.event_trades(spark, d).withColumn("symbol", _symbols()).select("symbol", "ord", "timestamp", "price", "volume_usdt", "side", "seg")
    _in_turns(spark, trades, "landing", lambda stream: pipelines.run_now(buffers.sessions(stream, "1 hour"), out, checkpoint), trigger_rows=None)
    return spark.read.schema(buffers.SESSION).parquet(out)


def stream_dump(spark: SparkSession, d: str) -> DataFrame:
    """Periods dumped in three runs, the last batch of which was run twice."""
    out, checkpoint = new_path(spark, "dump"), new_path(spark, "checkpoint")
    trades = T.event_trades(spark, d).withColumn("symbol", _symbols()).select("symbol", "market", "ord", "timestamp", "price", "volume_usdt", "volume_base", "side", "seg")
    _in_turns(spark, trades, "landing", lambda stream: dump.run_now(stream, out, checkpoint), trigger_rows=None)
    again = dump.stored(spark, out)
    batch = again.agg(F.max("batch")).first()[0]
    dump.store(_kept(spark, again.where(F.col("batch") == batch), "again"), batch, out)
    return dump.dumped(spark, out)


def stream_liquidations(spark: SparkSession, d: str) -> DataFrame:
    """Counters of all liquidations ever, and of the ones that are kept, by band."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", pipelines.STATE_STORE)
    out, checkpoint = new_path(spark, "liquidations"), new_path(spark, "checkpoint")
    events = liquidations.events(T.liquidation_orders(spark, d)).withColumn("symbol", F.lit("SOLUSDT"))
    _in_turns(spark, events, "landing", lambda stream: pipelines.run_now(buffers.liquidations(stream, KEPT), out, checkpoint))
    two = lambda df: df.select("seg", "long_count", "short_count", *(X.rounded(F.col(c), 2).alias(c) for c in ("long_usdt", "short_usdt")))
    ever = two(buffers.liquidation_counters(spark, checkpoint)).withColumn("of", F.lit("all"))
    return ever.unionByName(two(liquidations.by_segment(buffers.recent_liquidations(spark, checkpoint))).withColumn("of", F.lit("kept")))


def _followed(spark: SparkSession, d: str) -> str:
    """Books of five symbols followed in three runs; three start from the job's first state, two ask for a snapshot."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", pipelines.STATE_STORE)
    folder = new_path(spark, "books")
    start = spark.range(3).select(F.concat(F.lit("S"), "id").alias("symbol"), F.lit(0).cast("long").alias("u"))
    first = T.depth_snapshots(start)
    _in_turns(spark, T.depth_messages(spark, d), "landing", lambda stream: books.follow_at_once(stream, T.depth_snapshot, folder, first))
    return folder


def stream_book(spark: SparkSession, d: str) -> DataFrame:
    """The books after a stream with broken sequences, read from the state store."""
    return books.levels(spark, _followed(spark, d)).select("symbol", "side", "price", "qty")


def stream_book_log(spark: SparkSession, d: str) -> DataFrame:
    """What became of the messages and how many snapshots each book asked for."""
    return books.events(spark, _followed(spark, d)).groupBy("symbol", "kind").agg(F.count("*").alias("n"), F.max("u").alias("last_u"))


# A book's last snapshot is the answer to its last broken sequence; updates count from the one that spans it.
_BOOKS = f"""m AS (SELECT 'S' || event_id % {T.DEPTH_SYMBOLS} AS symbol, event_id // {T.DEPTH_SYMBOLS} AS j, event_id // {T.DEPTH_SYMBOLS} * 3 + 3 AS u, event_id AS i, floor(value * 100)::BIGINT AS cents FROM events),
breaks AS (SELECT symbol, j, u, (j + {T.AHEAD}) * 3 + 2 AS last_id FROM m WHERE j % {T.BROKEN_EVERY} = {T.BROKEN_AT}),
state AS (SELECT s.symbol, coalesce(max(b.u), 0) AS asked, coalesce(max(last_id), 2) AS last_id FROM (SELECT DISTINCT symbol FROM m) s LEFT JOIN breaks b USING (symbol) GROUP BY s.symbol),
lv AS (SELECT symbol, u, 1 AS k, 'bid' AS side, 150.0::DOUBLE - (cents % 2000) / 100.0::DOUBLE AS price, (i % 11)::DOUBLE AS qty FROM m UNION ALL SELECT symbol, u, 2, 'bid', 150.0::DOUBLE - (cents * 7 % 2000) / 100.0::DOUBLE, (i * 3 % 7)::DOUBLE FROM m UNION ALL SELECT symbol, u, 3, 'ask', 150.5::DOUBLE + (cents * 3 % 2000) / 100.0::DOUBLE, (i % 5)::DOUBLE FROM m
UNION ALL SELECT symbol, last_id, 0, 'bid', 100.25::DOUBLE, (asked % 7 + 1)::DOUBLE FROM state UNION ALL SELECT symbol, last_id, 0, 'ask', 200.75::DOUBLE, (asked % 5 + 1)::DOUBLE FROM state)"""
_KINDS = f"""k AS (SELECT m.symbol, m.u, CASE WHEN m.j % {T.BROKEN_EVERY} = {T.BROKEN_AT} THEN 'rejected' WHEN m.j > {T.BROKEN_AT} AND (m.j - {T.BROKEN_AT}) % {T.BROKEN_EVERY} < {T.AHEAD} THEN 'stale' ELSE 'applied' END AS kind FROM m
UNION ALL SELECT symbol, u, 'request' FROM breaks UNION ALL SELECT symbol, last_id, 'snapshot' FROM breaks
UNION ALL SELECT DISTINCT symbol, x.u, x.kind FROM m, (VALUES (0, 'request'), (2, 'snapshot')) x(u, kind) WHERE symbol IN ('S3', 'S4'))"""
QUERIES |= {"stream_packets": stream_packets, "stream_windows": stream_windows, "stream_window_bands": stream_window_bands}
SQL |= {"stream_packets": catalog.SQL["packets"], "stream_windows": catalog.SQL["rolling_windows"], "stream_window_bands": catalog.SQL["rolling_by_segment"]}
QUERIES |= {"stream_buffer": stream_buffer, "stream_sessions": stream_sessions, "stream_dump": stream_dump, "stream_liquidations": stream_liquidations}
_SYMBOL = "CASE WHEN user_id % 3 = 0 THEN 'SOLUSDT' ELSE 'BTCUSDT' END AS symbol"
# A purge takes the trades before the first one that is in the day; the last purge was at the last multiple of its step.
SQL["stream_buffer"] = f"""WITH {catalog.TRADES}, t AS (SELECT *, {_SYMBOL}, row_number() OVER (PARTITION BY {_SYMBOL[:-10]}, market ORDER BY ord) AS rn FROM (SELECT * REPLACE (timestamp - CASE WHEN ord % 97 = 5 THEN {26 * X.HOUR_MS} ELSE 0 END AS timestamp) FROM trades)),
p AS (SELECT symbol, market, count(*) // {buffers.PURGE_EVERY} * {buffers.PURGE_EVERY} AS m, count(*) AS n FROM t GROUP BY ALL), c AS (SELECT symbol, market, max(timestamp) - {X.DAY_MS} AS edge FROM t JOIN p USING (symbol, market) WHERE rn <= m GROUP BY ALL),
h AS (SELECT symbol, market, min(rn) AS head FROM t JOIN c USING (symbol, market) WHERE timestamp >= edge GROUP BY ALL), k AS (SELECT t.*, m, n, coalesce(head, 1) AS head FROM t JOIN p USING (symbol, market) LEFT JOIN h USING (symbol, market))
SELECT symbol, market, 'totals' AS event, count(*) AS trades, sum(volume_usdt) AS vol, sum({catalog.BUY}) AS vol_buy, sum({catalog.SELL}) AS vol_sell, count(*) FILTER (side = 0) AS buys, count(*) FILTER (side = 1) AS sells,
least(min(timestamp) FILTER (rn = head AND m > 0), min(timestamp) FILTER (rn > m)) AS first_ts, (SELECT max(timestamp) FROM t x WHERE x.symbol = k.symbol AND x.market = k.market) AS last_ts, any_value(n) AS inserted, any_value(head) - 1 AS purged FROM k WHERE rn >= head AND NOT (symbol = 'SOLUSDT' AND market = 'futures') GROUP BY symbol, market
UNION ALL SELECT symbol, market, 'refused', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, count(*), NULL FROM t WHERE symbol = 'SOLUSDT' AND market = 'futures' GROUP BY ALL"""
_ENDS = f"(timestamp - {4 * X.HOUR_MS}) // {8 * X.HOUR_MS} * {8 * X.HOUR_MS} + {12 * X.HOUR_MS}"
SQL["stream_sessions"] = catalog.SQL["session_stats"].replace("trades), b AS", f"(SELECT *, {_SYMBOL} FROM trades) WHERE {_ENDS} <= (SELECT max(timestamp) FROM trades) - {X.HOUR_MS}), b AS").replace("SELECT session_date, session,", "SELECT symbol, session_date, session,").replace("USING (session_date, session)", "USING (symbol, session_date, session)")
SQL["stream_dump"] = f"WITH {catalog.TRADES}, p AS (SELECT {_SYMBOL}, market, {_ENDS} AS period, count(*) AS trades, sum(volume_usdt) AS volume FROM trades GROUP BY ALL) SELECT * FROM p WHERE period < (SELECT max(period) FROM p q WHERE q.symbol = p.symbol AND q.market = p.market)"
SQL["stream_liquidations"] = f"WITH {catalog._LIQ}, r AS (SELECT *, row_number() OVER (ORDER BY ord DESC) AS age FROM lq) SELECT 'all' AS of, seg, {catalog._SIDES} FROM r GROUP BY seg UNION ALL SELECT 'kept', seg, {catalog._SIDES} FROM r WHERE age <= {KEPT} GROUP BY seg"
QUERIES |= {"stream_minute": stream_minute, "stream_ingest": stream_ingest, "stream_book": stream_book, "stream_book_log": stream_book_log}
SQL |= {
    "stream_minute": f"WITH {catalog.TRADES} SELECT timestamp // 60000 * 60000 AS minuto, count(*) AS trades, sum({catalog.BUY}) AS buy_vol, sum({catalog.SELL}) AS sell_vol FROM trades GROUP BY 1",
    "stream_ingest": f"WITH {catalog.TRADES} SELECT 'SOLUSDT' AS symbol, market, {catalog.CASE.replace('volume_usdt', '(price * volume_base)')} AS seg, count(*) AS trades FROM trades WHERE ({catalog._KIND}) IS NULL GROUP BY ALL",
    "stream_book": f"WITH {_BOOKS} SELECT symbol, side, price, qty FROM (SELECT symbol, side, price, arg_max(qty, (u, k)) AS qty FROM lv JOIN state USING (symbol) WHERE u >= last_id GROUP BY ALL) WHERE qty > 0",
    "stream_book_log": f"WITH {_BOOKS}, {_KINDS} SELECT symbol, kind, count(*) AS n, max(u) AS last_u FROM k GROUP BY ALL",
}
