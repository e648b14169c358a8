"""Live message streams as a partitioned PySpark Python data source.

`spark.readStream.format("exchange")` yields (seq, symbol, market, kind, raw)
of many symbols, markets and kinds at once. How messages are fetched is the
transport's business: a module, named by the option `transport`, with

* `position(url) -> int`: how many messages the stream has so far, and
* `fetch(url, begin, end) -> list[str]`: the messages at these positions.

The driver asks only for positions; messages are fetched by tasks, each stream
in ranges of at most `batch` messages, so that one is lost and fetched again
alone. Offsets hold a position for each stream, so that a restart neither
loses nor repeats messages. A stream that can't be reached stays where it is
and isn't asked again before its wait is over; nothing sleeps. No network
client is bundled.
"""

from __future__ import annotations

import importlib
import time
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

# Waits of the reconnect policy, and stream names.
WAIT_S, LONG_WAIT_S, TRIES = 5, 30, 5
STREAMS = {"trade": "{symbol}@trade", "depth": "{symbol}@depth@100ms", "forced": "{symbol}@forceOrder"}


@dataclass(frozen=True)
class SourceConfig:
    """A pair and the markets to follow."""

    symbol: str
    spot: bool = True
    futures: bool = True

    def __post_init__(self):
        object.__setattr__(self, "symbol", self.symbol.upper())

    @property
    def markets(self) -> list[str]:
        return ["spot"] * self.spot + ["futures"] * self.futures


def stream_url(base: str, symbol: str, kind: str = "trade") -> str:
    return f"{base.rstrip('/')}/{STREAMS[kind].format(symbol=symbol.lower())}"


class Reconnect:
    """Waits after failures: short ones, a long one after five in a row; a connection resets the count."""

    def __init__(self):
        self.failures = 0

    def connected(self) -> None:
        self.failures = 0

    def failed(self) -> int:
        self.failures += 1
        if self.failures >= TRIES:
            self.failures = 0
            return LONG_WAIT_S
        return WAIT_S


@dataclass
class Range(InputPartition):
    """Messages of one stream between two positions."""

    symbol: str
    market: str
    kind: str
    begin: int
    end: int


class ExchangeReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        listed = lambda name, default: [x.strip() for x in options.get(name, default).split(",") if x.strip()]
        self.streams = [(s.upper(), m, k) for s in listed("symbols", "") for m in listed("markets", "spot") for k in listed("kinds", "trade")]
        if not self.streams:
            raise ValueError("no stream to follow")
        self.bases = {m: options.get(f"base.{m}", options.get("base", "")) for _, m, _ in self.streams}
        self.transport, self.batch = options["transport"], int(options.get("batch", "10000"))
        self.policies = {self._name(*s): Reconnect() for s in self.streams}
        self.next_try: dict[str, float] = {}
        self.known: dict[str, int] = {}

    @staticmethod
    def _name(symbol: str, market: str, kind: str) -> str:
        return f"{symbol}/{market}/{kind}"

    def _url(self, symbol: str, market: str, kind: str) -> str:
        return stream_url(self.bases[market], symbol, kind)

    def initialOffset(self) -> dict:
        return {self._name(*s): 0 for s in self.streams}

    def latestOffset(self) -> dict:
        call, now = importlib.import_module(self.transport).position, time.monotonic()
        out = {}
        for s in self.streams:
            name = self._name(*s)
            if now >= self.next_try.get(name, now):
                try:
                    # A position that has gone back, as after a reset, waits until it has caught up.
                    self.known[name] = max(call(self._url(*s)), self.known.get(name, 0))
                    self.policies[name].connected()
                except OSError:
                    self.next_try[name] = now + self.policies[name].failed()
            out[name] = self.known.get(name, 0)
        return out

    def partitions(self, start: dict, end: dict) -> Sequence[Range]:
        out = []
        for s in self.streams:
            name = self._name(*s)
            # A stream that was not followed before begins at its beginning; one that can't be reached yet is not read.
            begin, stop = start.get(name, 0), end.get(name, 0)
            out += [Range(*s, at, min(at + self.batch, stop)) for at in range(begin, stop, self.batch)]
        return out

    def read(self, partition: Range) -> Iterator[tuple]:
        url = self._url(partition.symbol, partition.market, partition.kind)
        messages = importlib.import_module(self.transport).fetch(url, partition.begin, partition.end)
        if len(messages) != partition.end - partition.begin:
            raise OSError(f"{url} gave {len(messages)} of {partition.end - partition.begin} messages")
        return iter([(partition.begin + i, partition.symbol, partition.market, partition.kind, m) for i, m in enumerate(messages)])

    def commit(self, end: dict) -> None:
        pass


class ExchangeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "exchange"

    def schema(self) -> str:
        return "seq long, symbol string, market string, kind string, raw string"

    def streamReader(self, schema) -> ExchangeReader:
        return ExchangeReader(self.options)


def streams(spark: SparkSession, configs: SourceConfig | Sequence[SourceConfig], transport: str, kinds: Sequence[str] = ("trade",), **options: str) -> DataFrame:
    """The markets of one or more pairs as one stream; pairs that follow the same markets share a reader."""
    spark.dataSource.register(ExchangeSource)
    by_markets: dict[tuple[str, ...], list[str]] = {}
    for c in [configs] if isinstance(configs, SourceConfig) else configs:
        if c.markets:
            by_markets.setdefault(tuple(c.markets), []).append(c.symbol)
    out = None
    for markets, symbols in by_markets.items():
        one = spark.readStream.format("exchange").options(symbols=",".join(symbols), markets=",".join(markets), kinds=",".join(kinds), transport=transport, **options).load()
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no market to follow")
    return out
