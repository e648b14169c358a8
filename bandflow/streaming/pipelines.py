"""Structured Streaming jobs: ingest, minute totals, large liquidations.

Late data: stateful queries keep a day (`WATERMARK`); rows older than that
against the newest time seen are dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from bandflow.functions import expressions as X
from bandflow.operators import liquidations, normalize

WATERMARK = "24 hours"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def ingest(messages: DataFrame, path: str, checkpoint: str, bands: X.Bands | None = None) -> StreamingQuery:
    """Raw messages (raw, symbol, market) to stored trades below symbol, market and date."""
    rows = normalize.trades(messages)
    rows = rows.withColumn("seg", (bands or X.Bands()).of(F.col("volume_usdt"))).withColumn("date", X.day(F.col("timestamp")))
    return rows.writeStream.format("parquet").partitionBy("symbol", "market", "date").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def minute_totals(trades: DataFrame) -> DataFrame:
    """Bought and sold volume by minute of a stream of trades."""
    v = F.col("volume_usdt")
    timed = trades.withColumn("_t", F.timestamp_millis("timestamp")).withWatermark("_t", WATERMARK)
    out = timed.groupBy(F.window("_t", "1 minute").alias("w")).agg(F.count("*").alias("trades"), X.sum_where(F.col("side") == 0, v).alias("buy_vol"), X.sum_where(F.col("side") == 1, v).alias("sell_vol"))
    return out.select(F.unix_millis("w.start").alias("minuto"), "trades", "buy_vol", "sell_vol")


def run_now(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Runs what is available into Parquet; a complete result replaces the last one."""
    if mode == "append":
        q = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    else:
        q = stream.writeStream.outputMode(mode).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def on_large_liquidations(liqs: DataFrame, checkpoint: str, act: Callable[[DataFrame], None], least: float = 50_000.0) -> StreamingQuery:
    """Calls `act` with each batch's large liquidations."""
    return liquidations.large(liqs, least).writeStream.foreachBatch(lambda df, _: act(df)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
