"""Support and resistance levels around a reference price."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bandflow.functions import expressions as X

HISTORY_SCHEMA = "timestamp long, sesion string, par string, precio_ref double, bucket_size double, tipo string, criterio string, rank int, precio_nivel double, volumen_usdt double, trade_count long, buy_pct double, sell_pct double, seg_dominante int, score double"


def top_levels(t: DataFrame, keys: list[str], lowest_band: bool) -> DataFrame:
    """The three best levels of each kind and criterion within `keys`.

    `t` carries `ref`, the reference price of its keys. Prices fall into
    buckets of 0.6 % of it; buckets below are supports, above resistances, its
    own bucket neither. Supports are measured by bought, resistances by sold
    volume, also where they are ranked by the number of trades. Of bands with
    equal volume the lowest is dominant if `lowest_band`, else the highest.
    """
    size = F.col("ref") * X.LEVEL_SHARE
    v, buy = F.col("volume_usdt"), F.col("side") == 0
    rows = t.where("ref > 0").withColumns({"bucket_size": size, "idx": F.floor(F.col("price") / size), "ref_idx": F.floor(F.col("ref") / size)})
    rows = rows.where("idx <> ref_idx")
    by_band = rows.groupBy(*keys, "ref", "bucket_size", "ref_idx", "idx", "seg").agg(F.sum(v).alias("v"), X.sum_where(buy, v).alias("b"), F.count("*").alias("n"))
    order = F.struct("v", -F.col("seg") if lowest_band else F.col("seg"))
    buckets = by_band.groupBy(*keys, "ref", "bucket_size", "ref_idx", "idx").agg(F.sum("v").alias("v"), F.sum("b").alias("b"), F.sum("n").alias("trade_count"), F.max_by("seg", order).alias("seg_dominante"))
    below = F.col("idx") < F.col("ref_idx")
    buckets = buckets.withColumns({"tipo": F.when(below, "soporte").otherwise("resistencia"), "volumen_usdt": F.when(below, F.col("b")).otherwise(F.col("v") - F.col("b"))})
    of = Window.partitionBy(*keys, "tipo")
    ranks = {"volumen": F.row_number().over(of.orderBy(F.desc("volumen_usdt"), "idx")), "trades": F.row_number().over(of.orderBy(F.desc("trade_count"), F.desc("volumen_usdt"), "idx"))}
    out = None
    for name, rank in ranks.items():
        best = buckets.withColumn("rank", rank).where("rank <= 3").withColumn("criterio", F.lit(name))
        out = best if out is None else out.unionByName(best)
    return out.select(
        *keys, F.col("ref").alias("precio_ref"), "bucket_size", "tipo", "criterio", "rank",
        ((F.col("idx") + 0.5) * F.col("bucket_size")).alias("precio_nivel"), "volumen_usdt", "trade_count",
        X.percent(F.col("b"), F.col("v")).alias("buy_pct"), X.percent(F.col("v") - F.col("b"), F.col("v")).alias("sell_pct"),
        "seg_dominante", F.col("volumen_usdt").alias("score"),
    )


def with_reference(t: DataFrame, keys: list[str], few: bool = False) -> DataFrame:
    """`t` with `ref`, the price of the last arrival within `keys`; `few` tells that there are few keys at any size."""
    last = t.groupBy(*keys).agg(F.max_by("price", "ord").alias("ref"))
    return t.join(F.broadcast(last) if few else last, keys)


def file_levels(t: DataFrame, keys: list[str]) -> DataFrame:
    """Levels of each stored file or other key; the last row is the reference."""
    return top_levels(with_reference(t, keys), keys, lowest_band=True)


def horizon_levels(t: DataFrame, as_of: int | None = None, hours=X.HORIZON_HOURS) -> DataFrame:
    from bandflow.operators.live import in_horizons, with_as_of

    rows = in_horizons(with_as_of(t, as_of), hours)
    return top_levels(with_reference(rows, ["hours"], few=True), ["hours"], lowest_band=False)


def history_rows(levels: DataFrame, timestamp: int, session: str, pair: str) -> DataFrame:
    row = levels.select(F.lit(timestamp).cast("long").alias("timestamp"), F.lit(session).alias("sesion"), F.lit(pair).alias("par"), "precio_ref", "bucket_size", "tipo", "criterio", "rank", "precio_nivel", "volumen_usdt", "trade_count", "buy_pct", "sell_pct", "seg_dominante", "score")
    return row.select(*(F.col(n).cast(k).alias(n) for n, k in (x.split() for x in HISTORY_SCHEMA.split(", "))))


def append_history(levels: DataFrame, path: str) -> None:
    levels.write.mode("append").parquet(path)


def latest_history(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the newest result; a second narrow scan finds its time."""
    rows = spark.read.schema(HISTORY_SCHEMA).parquet(path)
    newest = rows.agg(F.max("timestamp").alias("timestamp"))
    return rows.join(F.broadcast(newest), "timestamp")  # one row
