"""Per-second packets and sliding windows over the last N packets.

A packet is a run of trades of the same second in arrival order. The last run
is still open and belongs to no window. Windows count packets, not clock time;
`time_windows` counts seconds instead.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bandflow.functions.expressions import WINDOW_PACKETS, percent, sum_where
from bandflow.sources.shared import shared_dir

MEASURES = ("vol_total", "vol_buy", "vol_sell", "trades")
#: Volumes are summed exactly in this type, so that a window is a difference of two running sums; what it can't hold is summed beside it.
EXACT = "decimal(38,10)"


def packet_ids(t: DataFrame, key: str = "market") -> DataFrame:
    """`t` with its second and packet number, in arrival order within `key`.

    The arrival order is cut into stretches by range. Packets are numbered
    within a stretch; one row for each stretch tells how many the earlier ones
    hold and whether the first second goes on from the stretch before.
    """
    shared_dir(t.sparkSession)
    t = t.withColumn("sec", F.floor(F.col("timestamp") / 1000))
    t = t.repartitionByRange(key, "ord").withColumn("_stretch", F.spark_partition_id()).checkpoint(eager=True)
    order = Window.partitionBy(key, "_stretch").orderBy("ord")
    before = F.lag("sec").over(order)
    t = t.withColumn("_fresh", F.when(before.isNull() | (F.col("sec") == before), 0).otherwise(1)).withColumn("_local", F.sum("_fresh").over(order))
    ends = t.groupBy(key, "_stretch").agg(F.min_by("sec", "ord").alias("first"), F.max_by("sec", "ord").alias("last"), F.max("_local").alias("n"))
    stretches = Window.partitionBy(key).orderBy("_stretch")
    ends = ends.withColumn("starts", F.when(F.lag("last").over(stretches) == F.col("first"), 0).otherwise(1) + F.lag("n", 1, 0).over(stretches))
    offsets = ends.select(key, "_stretch", F.sum("starts").over(stretches).alias("_offset"))
    # One row for each range partition and key.
    return t.join(F.broadcast(offsets), [key, "_stretch"]).withColumn("packet", (F.col("_offset") + F.col("_local")).cast("long")).drop("_fresh", "_local", "_stretch", "_offset")


def packets(t: DataFrame, key: str = "market", keep_open: bool = False) -> DataFrame:
    """Per packet and band, and with a null band for all bands: volumes and count."""
    # Only what packets are made of is written for the numbering.
    rows = packet_ids(t.select(key, "ord", "timestamp", "seg", "side", "volume_usdt"), key)
    v, buy, sell = F.col("volume_usdt"), F.col("side") == 0, F.col("side") == 1
    rows = rows.where(buy | sell)
    grouped = rows.groupingSets([[F.col(key), F.col("packet"), F.col("sec"), F.col("seg")], [F.col(key), F.col("packet"), F.col("sec")]], key, "packet", "sec", "seg")
    out = grouped.agg(F.sum(v).alias("vol_total"), sum_where(buy, v).alias("vol_buy"), sum_where(sell, v).alias("vol_sell"), F.count("*").alias("trades"))
    if keep_open:
        return out
    last = rows.groupBy(key).agg(F.max("packet").alias("_last"))
    return out.join(F.broadcast(last), key).where("packet < _last").drop("_last")


def rolling(p: DataFrame, sizes: Sequence[int] = WINDOW_PACKETS, key: str = "market") -> DataFrame:
    """State of each window of all bands after every packet, in long form.

    Packets are numbered without gaps, so a window is a running sum less the
    one `n` packets earlier: one sort, one pass and one lag for each size. A
    key has at most a packet for each second, however many trades there are.
    Infinite volumes are counted, so that a window is infinite while it holds
    one and finite again afterwards; parts below 10^-10 are summed as doubles.
    """
    order = Window.partitionBy(key).orderBy("packet")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    sides = ("vol_buy", "vol_sell")  # packets hold no other trades, so that the total is their sum

    def sums(m: str) -> list:
        infinite = F.col(m) == float("inf")
        exact = F.when(infinite, F.lit(0).cast(EXACT)).otherwise(F.coalesce(F.col(m).try_cast(EXACT), F.lit(0).cast(EXACT)))
        rest = F.when(infinite, 0.0).otherwise(F.col(m) - exact.cast("double"))
        return [F.sum(exact).over(so_far).alias(m), F.sum(rest).over(so_far).alias(f"{m}_rest"), F.sum(infinite.cast("long")).over(so_far).alias(f"{m}_infinite")]

    whole = p.where("seg is null").select(key, "packet", *(c for m in sides for c in sums(m)), F.sum("trades").over(so_far).alias("trades"), F.count("*").over(so_far).alias("_n"))
    whole = whole.withColumn("_now", F.struct(*(c for c in whole.columns if c not in (key, "packet")))).select(key, "packet", "_now", *(F.lag("_now", n).over(order).alias(f"_{n}") for n in sizes))
    states = F.array(*(F.struct(F.lit(n).alias("window"), F.col(f"_{n}").alias("then")) for n in sizes))
    out = whole.select(key, "packet", "_now", F.inline(states))
    inside = lambda m: F.col(f"_now.{m}") - F.coalesce(F.col(f"then.{m}"), F.lit(0))

    def volume(*of: str):
        total = lambda suffix: reduce(add, (inside(f"{m}{suffix}") for m in of))
        return F.when(total("_infinite") > 0, float("inf")).otherwise(total("").cast("double") + total("_rest"))

    out = out.select(key, "packet", "window", volume(*sides).alias("vol_total"), *(volume(m).alias(m) for m in sides), inside("trades").cast("long").alias("trades"), (inside("_n") / F.col("window") * 100.0).alias("fill_pct"))
    return out.withColumns({"buy_pct": percent(F.col("vol_buy"), F.col("vol_total")), "sell_pct": percent(F.col("vol_sell"), F.col("vol_total"))})


def latest(p: DataFrame, sizes: Sequence[int] = WINDOW_PACKETS, key: str = "market") -> DataFrame:
    """Each window's totals by band at the last closed packet, with the band's
    share of all; bands without trades in a window are absent. A packet
    belongs to all windows that reach it, so the packets are read once."""
    last = p.groupBy(key).agg(F.max("packet").alias("_last"))
    age = F.col("_last") - F.col("packet")
    rows = p.join(F.broadcast(last), key).withColumn("window", F.explode(F.filter(F.array(*map(F.lit, sizes)), lambda n: n > age)))
    sums = rows.groupBy(key, "window", "seg").agg(*(F.sum(m).alias(m) for m in MEASURES))
    whole = sums.where("seg is null").select(key, "window", F.col("vol_total").alias("_all"))
    out = sums.where("seg is not null").join(F.broadcast(whole), [key, "window"])
    return out.withColumns({"pct_vol": percent(F.col("vol_total"), F.col("_all")), "buy_pct": percent(F.col("vol_buy"), F.col("vol_total")), "sell_pct": percent(F.col("vol_sell"), F.col("vol_total"))}).drop("_all")


def time_windows(p: DataFrame, seconds: int, key: str = "market") -> DataFrame:
    """As `rolling`, over clock seconds instead of packets."""
    frame = Window.partitionBy(key).orderBy("sec").rangeBetween(-(seconds - 1), 0)
    return p.where("seg is null").select(key, "packet", "sec", *(F.sum(m).over(frame).alias(m) for m in MEASURES))
