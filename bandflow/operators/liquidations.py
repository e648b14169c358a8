"""Forced liquidations: parsing, counters, windows and price steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandflow.functions import expressions as X
from bandflow.operators.live import with_as_of


def parse(messages: DataFrame, raw: str = "raw", keep: tuple[str, ...] = ()) -> DataFrame:
    """Fields S, p, q, T below `o` of JSON text, and the columns `keep`; text that isn't JSON is left out."""
    v = messages.select("*", F.inline(F.array(F.struct(F.try_parse_json(F.col(raw)).alias("_v"))))).where("_v is not null")
    get = lambda k, kind: F.try_variant_get("_v", f"$.o.{k}", kind)
    return v.select("ord", *keep, get("S", "string").alias("S"), get("p", "string").alias("p"), get("q", "string").alias("q"), get("T", "bigint").alias("T"))


def events(orders: DataFrame, bands: X.Bands | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Liquidations from text fields: numbers that don't parse are zero; a sold
    order closed a long position, anything else a short one."""
    number = lambda c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0))
    rows = orders.select("ord", *keep, F.col("T").alias("timestamp"), F.when(F.col("S") == "SELL", "LONG liq").otherwise("SHORT liq").alias("kind"), number("p").alias("price"), number("q").alias("qty"))
    rows = rows.withColumn("usdt", F.col("price") * F.col("qty"))
    return rows.withColumn("seg", (bands or X.Bands()).of(F.col("usdt")))


def _sides(rows: DataFrame, *keys) -> DataFrame:
    long, usdt = F.col("kind") == "LONG liq", F.col("usdt")
    return rows.groupBy(*keys).agg(F.count_if(long).alias("long_count"), F.count_if(~long).alias("short_count"), X.sum_where(long, usdt).alias("long_usdt"), X.sum_where(~long, usdt).alias("short_usdt"), F.count("*").alias("total_count"))


def by_segment(liqs: DataFrame) -> DataFrame:
    return _sides(liqs, "seg")


def windows(liqs: DataFrame, as_of: int | None = None, minutes=X.LIQUIDATION_MINUTES) -> DataFrame:
    """Totals of the last minutes, for all windows in one pass; empty ones stay."""
    reached = F.filter(F.array(*map(F.lit, minutes)), lambda m: F.col("timestamp") >= F.col("as_of") - m * X.MINUTE_MS)
    rows = with_as_of(liqs, as_of).where(F.col("timestamp") >= F.col("as_of") - max(minutes) * X.MINUTE_MS)
    sums = _sides(rows.withColumn("minutes", F.explode(reached)), "minutes")
    all_windows = liqs.sparkSession.createDataFrame([(m,) for m in minutes], "minutes int")
    out = all_windows.join(sums, "minutes", "left").na.fill(0)
    return out.withColumn("dominance", X.dominance(F.col("long_usdt"), F.col("short_usdt"), 1.1, ("LONG", "SHORT")))


def price_steps(liqs: DataFrame, as_of: int | None = None, minutes: int = 1440) -> DataFrame:
    """Totals by whole price, highest first."""
    rows = with_as_of(liqs, as_of).where(F.col("timestamp") >= F.col("as_of") - minutes * X.MINUTE_MS)
    out = _sides(rows, F.floor("price").cast("long").alias("price"))
    return out.select("price", "long_usdt", "short_usdt", (F.col("long_usdt") - F.col("short_usdt")).alias("cvd"), (F.col("long_usdt") + F.col("short_usdt")).alias("total"), F.col("total_count").alias("n")).orderBy(F.desc("price"))


def recent(liqs: DataFrame, k: int = 20) -> DataFrame:
    return liqs.orderBy(F.desc("ord")).limit(k)


def large(liqs: DataFrame, least: float = 50_000.0) -> DataFrame:
    return liqs.where(F.col("usdt") > least)
