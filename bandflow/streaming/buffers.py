"""The day's buffer, sessions and liquidations as keyed state of streams.

* `DayBuffer` holds a key's trades of the last 24 hours in order of arrival,
  with running totals. It is purged from the front only, at every
  `PURGE_EVERY`-th trade: a late row behind one that is kept stays until that
  one goes. Keys must be registered; see `control`.
* `Sessions` sums a market session and freezes it by an event-time timer when
  the watermark passes its end; rows that come later are left out by Spark.
* `Liquidations` keeps the last `RECENT` events and counters by band that
  never shrink.

A trigger's rows of one key are sorted in the task, so that a trigger's size
bounds its memory; the states are bounded by a day of trades, the open
sessions and `RECENT` events.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from bandflow.functions import expressions as X

# Trades from one purge to the next, and liquidations that are kept.
PURGE_EVERY, RECENT = 500, 5000
#: Trades of a block of the buffer.
BLOCK = 500

BUFFER = "symbol string, market string, ord long, event string, trades long, vol double, vol_buy double, vol_sell double, buys long, sells long, first_ts long, last_ts long, inserted long, purged long"


class DayBuffer(StatefulProcessor):
    """Rows of trades (`command` null) and commands (register, remove); a `BUFFER` row for each command, each refused trade and the end of a trigger."""

    def __init__(self, purge_every: int = PURGE_EVERY, window_ms: int = X.DAY_MS, block: int = BLOCK):
        self.purge_every, self.window_ms, self.block = purge_every, window_ms, block

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.stats = handle.getValueState("stats", "trades long, vol double, vol_buy double, vol_sell double, buys long, sells long, first_ts long, last_ts long, inserted long, purged long, head long")
        self.blocks = handle.getMapState("blocks", "block long", "trades array<struct<ord:long,timestamp:long,price:double,volume_usdt:double,side:int,seg:int>>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        state = list(self.stats.get()) if self.stats.exists() else None
        blocks: dict[int, list] = {}
        changed: set[int] = set()

        def block(b: int) -> list:
            if b not in blocks:
                found = self.blocks.getValue((b,)) if self.blocks.containsKey((b,)) else None
                blocks[b] = [tuple(t) for t in found[0]] if found else []
            return blocks[b]

        def count(t, times: int) -> None:
            _, _, _, v, side, _ = t
            state[0] += times
            state[1] = max(0.0, state[1] + times * v)
            if side in (0, 1):
                state[2 + side] = max(0.0, state[2 + side] + times * v)
                state[4 + side] += times

        def purge() -> None:
            # head: trades that have left; inserted: all that came.
            while state[10] < state[8]:
                front = block(state[10] // self.block)[state[10] % self.block]
                if front[1] >= state[7] - self.window_ms:
                    state[6] = front[1]
                    return
                count(front, -1)
                state[9] += 1
                state[10] += 1

        def drop(before: int, after: int) -> None:
            for b in range(before, after):
                blocks.pop(b, None)
                changed.discard(b)
                if self.blocks.containsKey((b,)):
                    self.blocks.removeKey((b,))

        def shown(event: str, at=None) -> Row:
            names = [x.split()[0] for x in BUFFER.split(", ")]
            return Row(**dict(zip(names, (*key, at, event, *(state[:10] if state else [None] * 10)), strict=True)))

        # A command comes before the trade of its place.
        for r in sorted(rows, key=lambda r: (r["ord"], r["command"] is None)):
            if r["command"] == "register":
                yield shown("known" if state else "registered", r["ord"])
                state = state or [0, 0.0, 0.0, 0.0, 0, 0, 0, 0, 0, 0, 0]
            elif r["command"] == "remove":
                yield shown("removed" if state else "unknown", r["ord"])
                if state:
                    drop(state[10] // self.block, state[8] // self.block + 1)
                    state = None
            elif not state:
                yield shown("refused", r["ord"])
            else:
                t = (r["ord"], r["timestamp"], r["price"], r["volume_usdt"], r["side"], r["seg"])
                at = state[8] // self.block
                block(at).append(t)
                changed.add(at)
                count(t, 1)
                state[6] = t[1] if not state[6] else min(state[6], t[1])
                state[7] = max(state[7], t[1])
                state[8] += 1
                if state[8] % self.purge_every == 0:
                    began = state[10] // self.block
                    purge()
                    drop(began, state[10] // self.block)
        for b in changed:
            self.blocks.updateValue((b,), (blocks[b],))
        if state:
            self.stats.update(tuple(state))
            yield shown("totals")
        else:
            self.stats.clear()

    def close(self) -> None:
        pass


def buffered(trades: DataFrame, commands: DataFrame, purge_every: int = PURGE_EVERY, window_ms: int = X.DAY_MS, block: int = BLOCK) -> DataFrame:
    """The events of the buffers of a stream of trades (symbol, market, ord, timestamp, price, volume_usdt, side, seg).

    `commands` is a stream of (symbol, market, ord, command) in the same order
    of arrival: `register` opens a buffer, `remove` empties and closes it.
    """
    t = trades.select(F.upper("symbol").alias("symbol"), "market", "ord", F.lit(None).cast("string").alias("command"), F.col("timestamp").cast("long"), "price", "volume_usdt", F.col("side").cast("int"), F.col("seg").cast("int"))
    nothing = [F.lit(None).cast(k).alias(c) for c, k in t.dtypes[4:]]
    both = t.unionByName(commands.select(F.upper("symbol").alias("symbol"), "market", "ord", "command", *nothing))
    return both.groupBy("symbol", "market").transformWithState(DayBuffer(purge_every, window_ms, block), BUFFER, "append", "none")


def held(spark: SparkSession, checkpoint: str, block: int = BLOCK) -> DataFrame:
    """The trades in the buffers, from the state store; those that have left a block that is still there are left out."""
    source = lambda name: spark.read.format("statestore").option("stateVarName", name).load(checkpoint)
    blocks = source("blocks").select(F.col("key.symbol").alias("symbol"), F.col("key.market").alias("market"), F.col("user_map_key.block").alias("block"), F.posexplode("user_map_value.trades").alias("i", "t"))
    heads = source("stats").select(F.col("key.symbol").alias("symbol"), F.col("key.market").alias("market"), F.col("value.head").alias("head"))
    size = blocks.groupBy("symbol", "market").agg(F.min("block").alias("least"))
    # Only the first block may hold trades that have left: all before it are gone.
    first = heads.join(size, ["symbol", "market"])
    return blocks.join(first, ["symbol", "market"]).where((F.col("block") > F.col("least")) | (F.col("i") >= F.col("head") % block)).select("symbol", "market", "t.*")


SESSION = "symbol string, session_date string, session string, open double, close double, trades long, volume double, buy_pct double, sell_pct double, dominant_seg int, dominant_side string"


class Sessions(StatefulProcessor):
    """A session's totals, given out once, when its time is over."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.prices = handle.getValueState("prices", "opened long, open double, closed long, close double, trades long")
        self.bands = handle.getMapState("bands", "seg int", "vol double, bought double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = self.prices.exists()
        opened, first, closed, last, n = self.prices.get() if known else (None, None, None, None, 0)
        sums: dict[int, list[float]] = {}
        for r in rows:
            if opened is None or r["ord"] < opened:
                opened, first = r["ord"], r["price"]
            if closed is None or r["ord"] > closed:
                closed, last = r["ord"], r["price"]
            n += 1
            x = sums.setdefault(r["seg"], [0.0, 0.0])
            x[0] += r["volume_usdt"]
            x[1] += r["volume_usdt"] if r["side"] == 0 else 0.0
        for seg, (v, b) in sums.items():
            old = self.bands.getValue((seg,)) if self.bands.containsKey((seg,)) else (0.0, 0.0)
            self.bands.updateValue((seg,), (old[0] + v, old[1] + b))
        self.prices.update((opened, first, closed, last, n))
        if not known:
            self.handle.registerTimer(key[1])
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        _, first, _, last, n = self.prices.get()
        bands = {k[0]: v for k, v in self.bands.iterator()}
        volume, bought = sum(v for v, _ in bands.values()), sum(b for _, b in bands.values())
        share = lambda part, whole: part / whole * 100.0 if whole > 0 else 0.0
        top = max(bands, key=lambda s: (bands[s][0], -s))
        v, b = bands[top]
        self.prices.clear()
        self.bands.clear()
        yield Row(symbol=key[0], ends=key[1], open=first, close=last, trades=n, volume=volume, buy=share(bought, volume), sell=share(volume - bought, volume), dominant_seg=top, dominant_side="BUY" if share(b, v) >= 50 else "SELL")

    def close(self) -> None:
        pass


def sessions(trades: DataFrame, late: str = "1 minute") -> DataFrame:
    """Frozen sessions of a stream of trades (symbol, ord, timestamp, price, volume_usdt, side, seg), once the watermark has passed them."""
    timed = trades.withColumn("at", F.timestamp_millis("timestamp")).withWatermark("at", late)
    rows = timed.select("symbol", X.next_dump(F.col("timestamp")).alias("ends"), "at", "ord", "price", "volume_usdt", F.col("side").cast("int"), F.col("seg").cast("int"))
    out = rows.groupBy("symbol", "ends").transformWithState(Sessions(), "symbol string, ends long, open double, close double, trades long, volume double, buy double, sell double, dominant_seg int, dominant_side string", "append", "EventTime")
    began = F.col("ends") - 8 * X.HOUR_MS
    return out.select("symbol", X.session_date(began).cast("string").alias("session_date"), X.session_of(began).alias("session"), "open", "close", "trades", X.rounded(F.col("volume"), 2).alias("volume"), X.rounded(F.col("buy"), 1).alias("buy_pct"), X.rounded(F.col("sell"), 1).alias("sell_pct"), "dominant_seg", "dominant_side")


LIQUIDATION = "symbol string, seg int, long_count long, short_count long, long_usdt double, short_usdt double, total long"


class Liquidations(StatefulProcessor):
    """A `LIQUIDATION` row for each band that a trigger changed."""

    def __init__(self, recent: int = RECENT):
        self.recent = recent

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.events = handle.getMapState("recent", "slot int", "ord long, timestamp long, kind string, price double, qty double, usdt double, seg int")
        self.bands = handle.getMapState("bands", "seg int", "long_count long, short_count long, long_usdt double, short_usdt double")
        self.total = handle.getValueState("total", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        n = self.total.get()[0] if self.total.exists() else 0
        changed: dict[int, list] = {}
        latest = []
        for r in sorted(rows, key=lambda r: r["ord"]):
            latest.append((n % self.recent, tuple(r[c] for c in ("ord", "timestamp", "kind", "price", "qty", "usdt", "seg"))))
            n += 1
            seg, short = r["seg"], r["kind"] != "LONG liq"
            if seg not in changed:
                changed[seg] = list(self.bands.getValue((seg,))) if self.bands.containsKey((seg,)) else [0, 0, 0.0, 0.0]
            changed[seg][short] += 1
            changed[seg][2 + short] += r["usdt"]
        # Only the last of a slot are written.
        for slot, event in dict(latest).items():
            self.events.updateValue((slot,), event)
        self.total.update((n,))
        for seg, x in sorted(changed.items()):
            self.bands.updateValue((seg,), tuple(x))
            yield Row(symbol=key[0], seg=seg, long_count=x[0], short_count=x[1], long_usdt=x[2], short_usdt=x[3], total=n)

    def close(self) -> None:
        pass


def liquidations(events: DataFrame, recent: int = RECENT) -> DataFrame:
    """Changes of the counters of a stream of liquidations (symbol, and the columns of `operators.liquidations.events`)."""
    rows = events.select("symbol", "ord", F.col("timestamp").cast("long"), "kind", "price", "qty", "usdt", F.col("seg").cast("int"))
    return rows.groupBy("symbol").transformWithState(Liquidations(recent), LIQUIDATION, "append", "none")


def _state(spark: SparkSession, checkpoint: str, name: str) -> DataFrame:
    return spark.read.format("statestore").option("stateVarName", name).load(checkpoint)


def recent_liquidations(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The events that are kept, from the state store: what windows and price steps are made of."""
    return _state(spark, checkpoint, "recent").select(F.col("key.symbol").alias("symbol"), "user_map_value.*")


def liquidation_counters(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Counters by band of all events ever, from the state store."""
    return _state(spark, checkpoint, "bands").select(F.col("key.symbol").alias("symbol"), F.col("user_map_key.seg").alias("seg"), "user_map_value.*")
