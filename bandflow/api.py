"""One object with the engine's calls: catalog, analyses, live reports, levels."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandflow import jobs
from bandflow.functions.expressions import Bands
from bandflow.operators import book, lab, levels, liquidations, live, windows
from bandflow.sources import catalog, exchange
from bandflow.sources.export import csv_line, json_bundle, section
from bandflow.sources.trades import read_trades
from bandflow.streaming import books, buffers, pipelines


@dataclass
class Outcome:
    """A result, or why there is none, and the milliseconds it took to plan."""

    frame: DataFrame | None
    error: str | None
    ms: int


class Engine:
    def __init__(self, spark: SparkSession, base: str, bands: Bands | None = None):
        self.spark, self.base, self.bands = spark, base.rstrip("/"), bands or Bands()

    def list_analyses(self) -> DataFrame:
        return self.spark.createDataFrame([(a.id, a.about) for a in lab.ANALYSES.values()], "id string, about string")

    def list_symbols(self) -> list[str]:
        return catalog.pairs(self.spark, self.base)

    def list_files(self, symbol: str, market: str | None = None, newest_first: bool = False) -> DataFrame:
        return catalog.files(self.spark, self.base, symbol, market, newest_first)

    def drop_file(self, symbol: str, market: str, name: str) -> bool:
        return catalog.drop_file(self.spark, self.base, symbol, market, name)

    def trades(self, symbol: str, market: str, choice: str = "") -> DataFrame:
        return read_trades(self.spark, *catalog.selected(self.spark, self.base, symbol, market, choice), bands=self.bands)

    def run_analysis(self, id: str, symbol: str, market: str, choice: str = "") -> Outcome:
        began = time.monotonic()
        took = lambda: int((time.monotonic() - began) * 1000)
        if id not in lab.ANALYSES:
            return Outcome(None, f"unknown analysis {id}", took())
        try:
            return Outcome(lab.ANALYSES[id].run(self.trades(symbol, market, choice)), None, took())
        except ValueError as e:
            return Outcome(None, str(e), took())

    def export_csv(self, frame: DataFrame, path: str) -> None:
        frame.select(csv_line(frame).alias("value")).write.mode("overwrite").text(path)

    def live_report(self, trades: DataFrame, as_of: int | None = None, hours: int = 4, spot: DataFrame | None = None) -> dict[str, DataFrame]:
        """All live reports over the retained day; sessions are measured against the last price of `spot`, by default of `trades`."""
        day = live.retained(trades, as_of)
        price = live.last_price(spot if spot is not None else trades) or 0.0
        return {"levels": levels.horizon_levels(day, as_of), "cvd": live.cvd(day, as_of), "divergence": live.divergence(day, as_of), "indicators": live.indicators(day, as_of, hours), "session_vwap": live.session_vwap(day, as_of, price)}

    def live_report_json(self, trades: DataFrame, as_of: int | None = None, hours: int = 4, spot: DataFrame | None = None) -> DataFrame:
        """The live report as one nested JSON text."""
        return json_bundle({name: section(df) for name, df in self.live_report(trades, as_of, hours, spot).items()})

    def dashboard(self, trades: DataFrame, diffs: DataFrame, liqs: DataFrame, depth: int = 8, spot: DataFrame | None = None) -> dict[str, DataFrame]:
        """What the dashboard shows; the book's steps are counted from the last price of `spot`, else from the book's middle."""
        p, b = windows.packets(trades), book.state(diffs)
        price = None if spot is None else live.last_price(spot)
        steps = book.integer_levels(b, depth, price if price and price > 0 else None)
        return {"windows": windows.latest(p), "book": book.summary(b), "pairs": book.pairs(steps), "liquidations": liquidations.by_segment(liqs), "liquidation_windows": liquidations.windows(liqs), "liquidation_steps": liquidations.price_steps(liqs), "recent_liquidations": liquidations.recent(liqs), "sessions": live.session_stats(trades)}

    def levels_for_file(self, path: str) -> DataFrame:
        t = read_trades(self.spark, path, bands=self.bands).withColumn("file", F.lit(path))
        return levels.file_levels(t, ["file"]).drop("file")

    def levels_newest(self, symbol: str, market: str = "spot") -> DataFrame:
        return self.levels_for_file(catalog.newest(self.spark, self.base, symbol, market))

    def append_levels(self, found: DataFrame, timestamp: int, session: str, symbol: str) -> None:
        levels.append_history(levels.history_rows(found, timestamp, session, symbol), f"{self.base}/{symbol}/indicadores/sr.parquet")

    def last_levels(self, symbol: str) -> DataFrame:
        return levels.latest_history(self.spark, f"{self.base}/{symbol}/indicadores/sr.parquet")

    def control(self, path: str | None = None) -> jobs.Control:
        """The pair that is followed; see `jobs.Control`."""
        return jobs.Control(self.spark, path or f"{self.base}/_control")

    def run_scheduled_levels(self, symbol: str, now: int, start: int, market: str = "spot") -> list[int]:
        """Runs the levels job for each due time up to `now` that it hasn't run for, and returns those times."""
        job = jobs.levels_job(self.spark, self.base, symbol, market, self.bands)
        return jobs.run_due(self.spark, f"{self.base}/_ledger", f"levels/{symbol}/{market}", now, start, job)

    def scheduled_levels(self, symbol: str) -> DataFrame:
        return jobs.scheduled_levels(self.spark, self.base, symbol)

    def update_bands(self, bounds: tuple[float, ...]) -> None:
        """Other bounds for what is read from now on; if they are no bounds, ValueError, and the old ones stay."""
        self.bands = Bands(bounds)

    def follow_books(self, pairs: Sequence[exchange.SourceConfig], transport: str, folder: str, rest: str = "", **options: str) -> DataFrame:
        """Brings the futures books of `pairs` up to now from their depth streams, fetching snapshots where they are asked for; their levels."""
        raw = exchange.streams(self.spark, [replace(p, spot=False) for p in pairs], transport, ("depth",), **options)
        books.follow_now(books.parsed(raw.select("symbol", F.col("seq").alias("ord"), "raw")), books.snapshots_by_url(f"{transport}:snapshot", rest), folder)
        return books.levels(self.spark, folder)

    def follow_liquidations(self, pairs: Sequence[exchange.SourceConfig], transport: str, folder: str, **options: str) -> DataFrame:
        """Counts the forced orders of `pairs` up to now; the last ones, for windows and price steps."""
        raw = exchange.streams(self.spark, [replace(p, spot=False) for p in pairs], transport, ("forced",), **options)
        orders = liquidations.parse(raw.select("symbol", F.col("seq").alias("ord"), "raw"), keep=("symbol",))
        found = liquidations.events(orders, self.bands, keep=("symbol",))
        pipelines.run_now(buffers.liquidations(found), f"{folder}/out", f"{folder}/checkpoint")
        return buffers.recent_liquidations(self.spark, f"{folder}/checkpoint")

    def stop_streams(self) -> None:
        for q in self.spark.streams.active:
            q.stop()
