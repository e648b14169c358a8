"""Scheduled work: a ledger of what was done, a runner that catches up, and the switching of pairs.

Nothing here sleeps or reads the clock: callers give the time, so that a cron
job, a loop or a test drives it. The ledger and the control table are Parquet
folders that grow by a few rows at a time.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandflow.functions import expressions as X
from bandflow.operators import levels
from bandflow.sources import catalog
from bandflow.sources.trades import read_trades

# Levels follow a dump by so much; the hours of dumps.
AFTER_DUMP_MS = 15 * X.MINUTE_MS
DUMP_HOURS = (4, 12, 20)
LEDGER = "job string, due long, finished long, error string"
CONTROL = "symbol string, market string, ord long, command string"


def next_dump(now: int) -> int:
    """The dump after `now` (epoch milliseconds); at a dump's own instant the following one."""
    return ((now - 4 * X.HOUR_MS) // (8 * X.HOUR_MS) + 1) * 8 * X.HOUR_MS + 4 * X.HOUR_MS


def due_times(after: int, until: int, delay: int = AFTER_DUMP_MS) -> list[int]:
    """The instants `delay` after a dump in (after, until]."""
    out, at = [], next_dump(after - delay) + delay
    while at <= until:
        out.append(at)
        at += 8 * X.HOUR_MS
    return out


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a folder of Parquet files, none where there is no folder yet."""
    if not catalog._entries(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def run_due(spark: SparkSession, ledger: str, name: str, now: int, start: int, job: Callable[[int], None], delay: int = AFTER_DUMP_MS) -> list[int]:
    """Runs `job(due)` for every due time since the last one in the ledger (or since `start`), in order, and enters each.

    A job that raises ValueError is entered with the error and isn't run again;
    anything else that it raises ends the call before the entry, so that the
    next call runs it again: a job must replace what it wrote for a due time.
    """
    last = _table(spark, ledger, LEDGER).where(F.col("job") == name).agg(F.max("due")).first()[0]
    done = []
    for due in due_times(start if last is None else last, now, delay):
        error = None
        try:
            job(due)
        except ValueError as e:
            error = str(e)
        spark.createDataFrame([(name, due, now, error)], LEDGER).coalesce(1).write.mode("append").parquet(ledger)
        done.append(due)
    return done


def session_at(ms: int) -> str:
    """Name of the session that an instant lies in."""
    hour = ms // X.HOUR_MS % 24
    return "Asia" if hour >= 20 or hour < 4 else "Londres" if hour < 12 else "NY"


def levels_job(spark: SparkSession, base: str, symbol: str, market: str = "spot", bands: X.Bands | None = None) -> Callable[[int], None]:
    """A job that writes, for its due time, the levels of the pair's newest file that isn't of a later one; run again, it replaces them."""

    def job(due: int) -> None:
        # Names begin with the day, and single files go on with the time.
        limit = datetime.fromtimestamp(due / 1000, UTC).strftime("%Y-%m-%d_%H-%M~")
        path = catalog.selected(spark, base, symbol, market, f"0..{limit}")[-1]
        found = levels.file_levels(read_trades(spark, path, bands=bands).withColumn("file", F.lit(path)), ["file"]).drop("file")
        levels.history_rows(found, due, session_at(due - AFTER_DUMP_MS - 1), symbol).write.mode("overwrite").parquet(levels_path(base, symbol, due))

    return job


def levels_path(base: str, symbol: str, due: int) -> str:
    return f"{base}/{symbol}/indicadores/sr/due={due}"


def scheduled_levels(spark: SparkSession, base: str, symbol: str) -> DataFrame:
    """All levels that the job wrote, with their due time as `timestamp`."""
    return _table(spark, f"{base}/{symbol}/indicadores/sr", f"{levels.HISTORY_SCHEMA}, due long").drop("due")


@dataclass
class Change:
    """The answer to a request to switch pairs or to stop."""

    ok: bool
    message: str
    minutes: int = 0
    time: str = ""


class Control:
    """The pair that is followed, as a table of commands that streams read (`streaming.buffers.buffered`)."""

    def __init__(self, spark: SparkSession, path: str, markets: tuple[str, ...] = ("spot", "futures")):
        self.spark, self.path, self.markets = spark, path, markets

    def commands(self) -> DataFrame:
        return _table(self.spark, self.path, CONTROL)

    def stream(self) -> DataFrame:
        """The commands as a stream; the folder must exist, so begin with `start`."""
        return self.spark.readStream.schema(CONTROL).parquet(self.path)

    def active(self) -> str | None:
        """The pair that was registered last and not removed since."""
        last = self.commands().groupBy("symbol").agg(F.max(F.struct("ord", "command")).alias("x"))
        row = last.where("x.command = 'register'").orderBy(F.desc("x.ord")).first()
        return row["symbol"] if row else None

    def _enter(self, rows: list[tuple[str, str, int, str]]) -> None:
        self.spark.createDataFrame(rows, CONTROL).coalesce(1).write.mode("append").parquet(self.path)

    def start(self, symbol: str, ord: int) -> None:
        self._enter([(symbol.upper(), m, ord, "register") for m in self.markets])

    def change(self, symbol: str, ord: int, now: int) -> Change:
        """Takes the stream to another pair at its place `ord`: the old pair's buffers are emptied, the new one's opened."""
        new, old = symbol.upper(), self.active()
        if new == old:
            return Change(False, "already following this pair")
        gone = [(old, m, ord, "remove") for m in self.markets] if old else []
        self._enter(gone + [(new, m, ord, "register") for m in self.markets])
        return Change(True, f"change to {new} entered", *self._until_dump(now))

    def stop(self, ord: int, now: int) -> Change:
        """Empties the buffers of the pair that is followed; nothing is followed until the next change."""
        if old := self.active():
            self._enter([(old, m, ord, "remove") for m in self.markets])
        return Change(True, "stop entered", *self._until_dump(now))

    @staticmethod
    def _until_dump(now: int) -> tuple[int, str]:
        at = next_dump(now)
        # After the last dump of a day the next is tomorrow's.
        late = " (+1d)" if now // X.HOUR_MS % 24 >= DUMP_HOURS[-1] else ""
        return (at - now) // X.MINUTE_MS, f"{at // X.HOUR_MS % 24:02d}:00 UTC{late}"
