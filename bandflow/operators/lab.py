"""The eleven named analyses over stored trades."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bandflow.functions import expressions as X


def _buy() -> Column:
    return F.col("side") == 0


def _sell() -> Column:
    return F.col("side") == 1


def _v() -> Column:
    return F.col("volume_usdt")


def _measures() -> list[Column]:
    return [F.count("*").alias("trades"), X.rounded(F.sum(_v()), 2).alias("vol_usdt"), X.share_where(_buy(), _v()).alias("buy_pct"), X.share_where(_sell(), _v()).alias("sell_pct")]


def summary(t: DataFrame) -> DataFrame:
    """One row of totals; none for an empty table."""
    price = F.col("price")
    return (
        t.groupBy(F.lit(1).alias("_g"))
        .agg(F.count("*").alias("trades"), X.rounded(F.sum(_v()), 2).alias("vol_total_usdt"), X.rounded(F.avg(price), 2).alias("precio_avg"), X.rounded(F.min(price), 2).alias("precio_min"), X.rounded(F.max(price), 2).alias("precio_max"), X.share_where(_buy(), _v()).alias("buy_pct"), X.share_where(_sell(), _v()).alias("sell_pct"))
        .drop("_g")
    )


def by_segment(t: DataFrame) -> DataFrame:
    """Totals by band and each band's share of the volume. The grand total is
    summed over the fourteen band rows, so the trades are read once."""
    raw = t.groupBy("seg").agg(F.count("*").alias("trades"), F.sum(_v()).alias("_v"), X.share_where(_buy(), _v()).alias("buy_pct"), X.share_where(_sell(), _v()).alias("sell_pct"))
    whole = F.sum("_v").over(Window.partitionBy(F.lit(1)))
    out = raw.withColumn("pct_vol", X.rounded(F.try_divide(F.col("_v"), whole) * 100.0, 2))
    return out.select("seg", "trades", X.rounded(F.col("_v"), 2).alias("vol_usdt"), "pct_vol", "buy_pct", "sell_pct").orderBy("seg")


def smart_vs_retail(t: DataFrame) -> DataFrame:
    return t.groupBy(X.lab_group(F.col("seg")).alias("grupo")).agg(*_measures()).orderBy("grupo")


def top_trades(t: DataFrame, k: int = 20) -> DataFrame:
    """The k largest trades by rounded volume, earlier arrival first."""
    rows = t.select("timestamp", X.rounded(F.col("price"), 2).alias("precio"), X.rounded(_v(), 2).alias("usdt"), X.rounded(F.col("volume_base"), 6).alias("base"), "side", "seg", "ord")
    return rows.orderBy(F.desc("usdt"), "ord").limit(k).drop("ord")


def by_hour(t: DataFrame) -> DataFrame:
    return t.groupBy(X.hour(F.col("timestamp")).alias("hora_utc")).agg(*_measures()).orderBy("hora_utc")


def minute_delta(t: DataFrame) -> DataFrame:
    """Per minute: bought, sold and their difference; any other side counts against."""
    signed = F.sum(F.when(_buy(), _v()).otherwise(-_v()))
    return t.groupBy(X.minute_start(F.col("timestamp")).alias("minuto")).agg(F.count("*").alias("trades"), X.rounded(X.sum_where(_buy(), _v()), 2).alias("buy_vol"), X.rounded(X.sum_where(_sell(), _v()), 2).alias("sell_vol"), X.rounded(signed, 2).alias("delta")).orderBy("minuto")


def whales(t: DataFrame, k: int = 50) -> DataFrame:
    """The k largest trades of the tenth band and above."""
    rows = t.where("seg >= 10").select(X.day(F.col("timestamp")).cast("string").alias("fecha"), X.rounded(F.col("price"), 2).alias("precio"), X.rounded(_v(), 2).alias("usdt"), F.when(_buy(), "BUY").otherwise("SELL").alias("side"), "seg", "ord")
    return rows.orderBy(F.desc("usdt"), "ord").limit(k).drop("ord")


def divergence(t: DataFrame, missing: float | None = float("nan")) -> DataFrame:
    """Per minute: buying share of small and of large trades and their
    difference; `missing` stands where no large trade was made."""

    def share(of: Column) -> Column:
        return X.rounded(X.sum_where(of & _buy(), _v()) / (X.sum_where(of, _v()) + 1e-9) * 100.0, 1)

    small, large = F.col("seg") <= 4, F.col("seg") >= 8
    rows = t.groupBy(X.minute_start(F.col("timestamp")).alias("_m")).agg(share(small).alias("retail_buy_pct"), share(large).alias("_s"), X.sum_where(large, _v()).alias("_v"))
    any_large, none = F.col("_v") > 0, F.lit(missing).cast("double")
    return rows.select(F.col("_m").alias("minuto"), "retail_buy_pct", F.when(any_large, F.col("_s")).otherwise(none).alias("smart_buy_pct"), F.when(any_large, X.rounded(F.col("_s") - F.col("retail_buy_pct"), 1)).otherwise(none).alias("divergencia")).orderBy("minuto")


def week_segments(t: DataFrame) -> DataFrame:
    """By calendar year with ISO week number, and band."""
    d = X.day(F.col("timestamp"))
    label = F.concat(F.year(d).cast("string"), F.lit("-W"), F.weekofyear(d).cast("string"))
    return t.groupBy(label.alias("semana"), "seg").agg(*_measures()).orderBy("semana", "seg")


def _levels(t: DataFrame, *keys: Column, extra: list[Column]) -> DataFrame:
    rows = t.groupBy(*keys).agg(F.count("*").alias("trades"), X.rounded(F.sum(_v()), 2).alias("vol_total"), X.rounded(X.sum_where(_buy(), _v()), 2).alias("vol_buy"), X.rounded(X.sum_where(_sell(), _v()), 2).alias("vol_sell"), X.share_where(_buy(), _v()).alias("buy_pct"), *extra)
    return rows.withColumn("rol", X.level_role(F.col("buy_pct")))


def daily_levels(t: DataFrame) -> DataFrame:
    """Price levels by day; `seg_dom` is the band of the level's first trade."""
    rows = _levels(t, X.day(F.col("timestamp")).cast("string").alias("fecha"), X.level_centre(F.col("price")).alias("precio_nivel"), extra=[F.min_by("seg", "ord").alias("seg_dom")])
    return rows.select("fecha", "precio_nivel", "rol", "trades", "vol_total", "vol_buy", "vol_sell", "buy_pct", "seg_dom").orderBy("fecha", F.desc("vol_total"), "precio_nivel")


def segment_levels(t: DataFrame) -> DataFrame:
    rows = _levels(t, F.col("seg"), X.level_centre(F.col("price")).alias("precio_nivel"), extra=[X.share_where(_sell(), _v()).alias("sell_pct")])
    return rows.select("seg", "precio_nivel", "rol", "trades", "vol_total", "vol_buy", "vol_sell", "buy_pct", "sell_pct").orderBy("seg", F.desc("vol_total"), "precio_nivel")


@dataclass(frozen=True)
class Analysis:
    id: str
    about: str
    run: Callable[[DataFrame], DataFrame]


# The identifiers by which analyses are asked for.
ANALYSES = {
    a.id: a
    for a in (
        Analysis("resumen", "totals, price range and buying share", summary),
        Analysis("por_segmento", "volume by band", by_segment),
        Analysis("smart_vs_retail", "small, middle and large trades", smart_vs_retail),
        Analysis("top_trades", "the twenty largest trades", top_trades),
        Analysis("por_hora", "volume by hour of day, UTC", by_hour),
        Analysis("delta_minuto", "bought minus sold by minute", minute_delta),
        Analysis("ballenas", "the fifty largest trades of the highest bands", whales),
        Analysis("divergencia", "large against small buyers by minute", divergence),
        Analysis("seg_semana", "bands by week", week_segments),
        Analysis("sr_diario", "price levels by day", daily_levels),
        Analysis("sr_por_segmento", "price levels by band", segment_levels),
    )
}
