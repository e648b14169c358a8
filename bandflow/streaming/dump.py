"""The eight-hour dump: trades stored by period, sessions frozen, each once.

Trades go below symbol, market and the end of their period (04:00, 12:00 and
20:00 UTC). A micro-batch owns one file folder in each period, named by its
number, and overwrites it, so that a batch that is run again after a failure
stores nothing twice. A period is dumped when its market has trades of a later
one; `dumped` lists those.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandflow.functions import expressions as X
from bandflow.sources.trades import TRADE_SCHEMA

PARTS = "symbol string, market string, period long, batch long"


def store(trades: DataFrame, batch: int, path: str) -> None:
    """A micro-batch's trades (with symbol, market, ord) below their periods; run again, it replaces what it stored."""
    casts = [F.col(n).cast(k).alias(n) for n, k in (x.split() for x in TRADE_SCHEMA.split(", "))]
    rows = trades.select(*casts, "ord", "symbol", "market", X.next_dump(F.col("timestamp")).alias("period"), F.lit(batch).cast("long").alias("batch"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("symbol", "market", "period", "batch").parquet(path)


def run_now(trades: DataFrame, path: str, checkpoint: str) -> None:
    """Stores what is available of a stream of trades."""
    query = trades.writeStream.foreachBatch(lambda df, batch: store(df, batch, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def stored(spark: SparkSession, path: str) -> DataFrame:
    """All stored trades with symbol, market, period and batch."""
    return spark.read.schema(f"{TRADE_SCHEMA}, ord long, {PARTS}").parquet(path)


def dumped(spark: SparkSession, path: str) -> DataFrame:
    """Periods with their trades that are complete: their market has trades of a later one."""
    periods = stored(spark, path).groupBy("symbol", "market", "period").agg(F.count("*").alias("trades"), F.sum("volume_usdt").alias("volume"))
    newest = periods.groupBy("symbol", "market").agg(F.max("period").alias("newest"))
    return periods.join(newest, ["symbol", "market"]).where("period < newest").drop("newest")
