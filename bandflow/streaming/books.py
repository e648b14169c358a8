"""Order books of many symbols as keyed state that asks for snapshots and goes on from them.

A message is a row: symbol, ord (its place in the order of arrival), snapshot,
u_first, u, pu and the arrays `b` and `a` of (price, qty); for a snapshot `u`
is its last update. Books follow the exchange's rules: updates older than the
book are stale, the first one after a snapshot must span its number, each
later one must continue its predecessor. One that doesn't is rejected whole,
and the book asks for a snapshot; what comes meanwhile waits in the state and
is played back when the snapshot is there. Snapshots that no book waits for
change nothing, so that one may be delivered twice.

`follow_now` closes the loop: each batch's requests go to `fetch`, a function
from a table of requests to one of snapshots (`snapshots_by_url` runs a
transport on the executors), and the snapshots come back as a second input of
the same stream: a round for each broken sequence that a trigger holds, which
suits an exchange whose snapshot is ahead of all that waits. `follow_at_once`
has tasks fetch the snapshots themselves, so that one pass does for any number
of broken sequences. The books are read from the state store (`levels`), not
from a log of changes.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LEVELS = "array<struct<price:double,qty:double>>"
MESSAGE = f"symbol string, ord long, snapshot boolean, u_first long, u long, pu long, b {LEVELS}, a {LEVELS}"
EVENT = "symbol string, ord long, kind string, u long, reason string, epoch long"
#: From a symbol and the update that broke its sequence (0: none yet) to a snapshot's last update and its levels (price, qty), or None.
Answer = Callable[[str, int], tuple[int, list[tuple[float, float]], list[tuple[float, float]]] | None]
#: Levels of a side that a snapshot holds.
SNAPSHOT_LEVELS = 1000


def _pairs(levels) -> list[tuple[float, float]]:
    """(price, qty) of levels, which come as rows, or as dictionaries in a first state."""
    return [(x["price"], x["qty"]) if isinstance(x, dict) else (x[0], x[1]) for x in levels or ()]


class Books(StatefulProcessor):
    """One `EVENT` row for each message: applied, stale, rejected or snapshot; and one for each request.

    A trigger reads a book once, follows the messages in memory and writes
    what differs at its end. With `answer`, a function from (symbol, u) to a
    snapshot's (u, b, a) or None, a book that asks goes on at once, and one
    that asked in vain asks again at its next trigger.
    """

    def __init__(self, answer: Answer | None = None):
        self.answer = answer

    def init(self, handle: StatefulProcessorHandle) -> None:
        # A whole book in one value: a call for each level costs more than all of its levels at once.
        self.book = handle.getValueState("book", f"bids {LEVELS}, asks {LEVELS}")
        # last: the book's update; chained: the stream's last one, 0 right after a snapshot.
        self.place = handle.getValueState("place", "last long, chained long, waiting boolean, epoch long")
        self.waiting = handle.getListState("waiting", f"ord long, u_first long, u long, pu long, b {LEVELS}, a {LEVELS}")

    @staticmethod
    def _set(book: dict[tuple[str, float], float], b, a) -> None:
        for side, levels in (("bid", b), ("ask", a)):
            for price, qty in levels or ():
                if price is None:
                    continue
                if qty is not None and qty > 0:
                    book[side, price] = qty
                else:
                    book.pop((side, price), None)

    def _store(self, book: dict) -> None:
        of = lambda side: [(p, q) for (s, p), q in book.items() if s == side]
        self.book.update((of("bid"), of("ask")))

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        book = {}
        self._set(book, _pairs(initialState["b"]), _pairs(initialState["a"]))
        self._store(book)
        self.place.update((initialState["u"], 0, False, 1))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        symbol = key[0]
        began = self.place.exists()
        last, chained, waiting, epoch = self.place.get() if began else (0, 0, True, 0)
        book = {}
        if self.book.exists():
            self._set(book, *(_pairs(x) for x in self.book.get()))
        was = dict(book)
        event = lambda ord, kind, u, reason=None: Row(symbol=symbol, ord=ord, kind=kind, u=u, reason=reason, epoch=epoch)
        # What waited before this trigger is read only if there is a snapshot for it.
        stored, held = waiting and began, []

        def load(u: int, b, a) -> list:
            """Takes a snapshot and gives what waited for it."""
            nonlocal last, chained, waiting, epoch, stored, held
            book.clear()
            self._set(book, b, a)
            last, chained, waiting, epoch = u, 0, False, epoch + 1
            before = [(*r[:4], _pairs(r[4]), _pairs(r[5])) for r in map(tuple, self.waiting.get())] if stored else []
            if before:
                self.waiting.clear()
            stored, todo, held = False, before + held, []
            return todo

        def ask(u: int) -> tuple | None:
            return self.answer(symbol, u) if self.answer else None

        def follow(todo: list) -> Iterator[Row]:
            """Applies updates; those behind a broken sequence wait, unless the book gets its snapshot at once."""
            nonlocal last, chained, waiting, held
            for i, (place, first, u, pu, b, a) in enumerate(todo):
                if waiting:
                    held.extend(todo[i:])
                    return
                reason = None if u < last or (first <= last if not chained else pu == chained) else "first update does not span" if not chained else "sequence broken"
                if reason:
                    waiting = True
                    yield event(place, "rejected", u, reason)
                    yield event(place, "request", u, reason)
                    if got := ask(u):
                        load(*got)
                        yield event(-1, "snapshot", got[0])
                    continue
                if u >= last:
                    self._set(book, b, a)
                    last = chained = u
                yield event(place, "stale" if u < last else "applied", u)

        if not began or (waiting and self.answer):
            yield event(None, "request", last, "again" if began else "start")
            if got := ask(last):
                todo = load(*got)
                yield event(-1, "snapshot", got[0])
                yield from follow(todo)
        messages = [(r["ord"], r["u_first"], r["u"], r["pu"], _pairs(r["b"]), _pairs(r["a"]), r["snapshot"]) for r in rows]
        messages.sort(key=lambda m: m[0])
        for *update, snapshot in messages:
            if not snapshot:
                if waiting:
                    held.append(tuple(update))
                else:
                    yield from follow([update])
            elif waiting:
                todo = load(update[2], update[4], update[5])
                yield event(update[0], "snapshot", update[2])
                yield from follow(todo)
            else:
                yield event(update[0], "unasked", update[2])
        if held:
            self.waiting.appendList([tuple(u) for u in held])
        if book != was:
            self._store(book)
        self.place.update((last, chained, waiting, epoch))

    def close(self) -> None:
        pass


def books(messages: DataFrame, first: DataFrame | None = None, answer: Answer | None = None) -> DataFrame:
    """The events of a stream of `MESSAGE` rows; `first` holds a snapshot message for each symbol that starts with one."""
    start = None if first is None else first.groupBy("symbol")
    return messages.groupBy("symbol").transformWithState(Books(answer), EVENT, "append", "none", start)


def parsed(raw: DataFrame) -> DataFrame:
    """`MESSAGE` rows of depth updates and snapshots as JSON text (symbol, ord, raw).

    Prices that don't parse leave their level out, quantities that don't parse
    are zero; text that is neither an update nor a snapshot gives no row.
    """
    texts = "array<array<string>>"
    v = raw.select("symbol", "ord", F.inline(F.array(F.struct(F.try_parse_json("raw").alias("v")))))
    get = lambda k, kind: F.try_variant_get("v", f"$.{k}", kind)
    snapshot = get("lastUpdateId", "bigint").isNotNull()
    number = lambda c, kind: c.try_cast(kind)

    def levels(update: str, whole: str):
        pairs = F.coalesce(get(update, texts), get(whole, texts), F.array().cast(texts))
        both = F.transform(pairs, lambda p: F.struct(number(number(F.get(p, F.lit(0)), "decimal(38,8)"), "double").alias("price"), F.coalesce(number(F.get(p, F.lit(1)), "double"), F.lit(0.0)).alias("qty")))
        return F.filter(both, lambda p: p["price"].isNotNull())

    rows = v.select("symbol", "ord", snapshot.alias("snapshot"), get("U", "bigint").alias("u_first"), F.coalesce(get("lastUpdateId", "bigint"), get("u", "bigint")).alias("u"), get("pu", "bigint").alias("pu"), levels("b", "bids").alias("b"), levels("a", "asks").alias("a"))
    return rows.where(F.col("u").isNotNull() & (F.col("snapshot") | F.col("u_first").isNotNull() & F.col("pu").isNotNull()))


def snapshot_url(base: str, symbol: str, levels: int = SNAPSHOT_LEVELS) -> str:
    return f"{base.rstrip('/')}/fapi/v1/depth?symbol={symbol.upper()}&limit={levels}"


def snapshots_by_url(transport: str, base: str = "") -> Callable[[DataFrame], DataFrame]:
    """A `fetch` that calls `transport` (`module:function` from a URL to JSON text) on the executors.

    A request whose transport raises OSError gives no snapshot; its book waits on and `follow_now` asks again.
    """
    module, _, name = transport.partition(":")

    def fetched(batches):
        import pandas as pd

        call = getattr(importlib.import_module(module), name)
        for batch in batches:
            rows = []
            for symbol in batch["symbol"]:
                try:
                    rows.append((symbol, -1, call(snapshot_url(base, symbol))))
                except OSError:
                    continue
            yield pd.DataFrame(rows, columns=["symbol", "ord", "raw"])

    return lambda requests: parsed(requests.select("symbol").distinct().mapInPandas(fetched, "symbol string, ord long, raw string"))


def follow_now(messages: DataFrame, fetch: Callable[[DataFrame], DataFrame], folder: str, first: DataFrame | None = None, rounds: int = 100) -> None:
    """Brings the books below `folder` up to what `messages` has, fetching snapshots until no book asks for one.

    A book that asks in vain is asked for again, at most `rounds` times; the
    next call goes on from there. Events are stored by batch, so that a batch
    that is run twice is stored once.
    """
    spark = messages.sparkSession
    landing = f"{folder}/snapshots"
    spark.createDataFrame([], MESSAGE).write.mode("append").parquet(landing)
    snapshots = spark.readStream.schema(MESSAGE).parquet(landing)
    open_requests: list[int] = []

    def step(events: DataFrame, batch: int) -> None:
        path = f"{folder}/events/batch={batch}"
        events.write.mode("overwrite").parquet(path)
        requests = spark.read.schema(EVENT).parquet(path).where("kind = 'request'")
        open_requests.append(requests.count())
        if open_requests[-1]:
            fetch(requests).select(*snapshots.columns).write.mode("append").parquet(landing)

    for _ in range(rounds):
        open_requests.clear()
        both = messages.select(*snapshots.columns).unionByName(snapshots)
        query = books(both, first).writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        if not sum(open_requests):
            return


def follow_at_once(messages: DataFrame, answer: Answer, folder: str, first: DataFrame | None = None) -> None:
    """Brings the books below `folder` up to what `messages` has; tasks call `answer` for the snapshots, each where its sequence is broken.

    However many sequences are broken, each message is read once. A task that
    is run again asks again. Events are stored by batch, as in `follow_now`.
    """
    store = lambda events, batch: events.write.mode("overwrite").parquet(f"{folder}/events/batch={batch}")
    query = books(messages, first, answer).writeStream.foreachBatch(store).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def events(spark: SparkSession, folder: str) -> DataFrame:
    """All events so far."""
    return spark.read.schema(f"{EVENT}, batch long").parquet(f"{folder}/events").drop("batch")


def levels(spark: SparkSession, folder: str) -> DataFrame:
    """The books as they stand in the state store: symbol, side, price, qty, usdt."""
    rows = spark.read.format("statestore").option("stateVarName", "book").load(f"{folder}/checkpoint")
    side = lambda column, name: F.transform(F.col(f"value.{column}"), lambda x: F.struct(F.lit(name).alias("side"), x["price"].alias("price"), x["qty"].alias("qty")))
    both = rows.select(F.col("key.symbol").alias("symbol"), F.inline(F.concat(side("bids", "bid"), side("asks", "ask"))))
    return both.withColumn("usdt", F.col("price") * F.col("qty"))
