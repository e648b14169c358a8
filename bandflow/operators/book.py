"""Order books replayed from snapshots and updates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandflow.functions.expressions import percent


def parse_levels(messages: DataFrame, side: str, column: str) -> DataFrame:
    """Price levels of a message's array of [price, quantity] texts: prices that
    don't parse are left out, quantities that don't parse delete the level."""
    rows = messages.select("ord", "u_first", "u", "pu", F.lit(side).alias("side"), F.explode(column).alias("x"))
    price = F.get("x", F.lit(0)).try_cast("decimal(38,8)")
    return rows.select("ord", "u_first", "u", "pu", "side", price.alias("price"), F.coalesce(F.get("x", F.lit(1)).try_cast("double"), F.lit(0.0)).alias("qty")).where("price is not null")


def state(diffs: DataFrame) -> DataFrame:
    """Levels that stand after all updates: the last quantity of each, if positive."""
    return diffs.groupBy("side", "price").agg(F.max_by("qty", F.struct("u", "ord")).alias("qty")).where("qty > 0").withColumn("usdt", F.col("price") * F.col("qty"))


def replay(diffs: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Book after the newest snapshot `(last_id, side, price, qty)` and the
    updates that follow it."""
    newest = F.broadcast(snapshots.agg(F.max("last_id").alias("last_id")))  # one row
    base = snapshots.join(newest, "last_id").select("side", "price", "qty", F.col("last_id").alias("u"), F.lit(-1).cast("long").alias("ord"))
    later = diffs.crossJoin(newest).where(F.col("u") >= F.col("last_id")).select("side", "price", "qty", "u", "ord")
    return state(base.unionByName(later))


def gaps(diffs: DataFrame) -> DataFrame:
    """Updates that don't continue their predecessor: there the book must be loaded again."""
    chain = diffs.select("ord", "u_first", "u", "pu").distinct()
    # Neighbours meet by key, not in one sorted task: the predecessor ends where this one says.
    ends = chain.select(F.col("u").alias("pu"))
    first = F.broadcast(chain.agg(F.min("u").alias("u")))  # one row
    return chain.join(ends, "pu", "left_anti").join(first, "u", "left_anti").select("ord", "u_first", "u", "pu")


def summary(book: DataFrame) -> DataFrame:
    """Totals, shares, best prices, spread and middle; zeros where a side is empty."""
    bid, ask = F.col("side") == "bid", F.col("side") == "ask"
    s = book.agg(F.max(F.when(bid, F.col("price"))).alias("best_bid"), F.min(F.when(ask, F.col("price"))).alias("best_ask"), F.coalesce(F.sum(F.when(bid, F.col("usdt"))), F.lit(0.0)).alias("bid_usdt"), F.coalesce(F.sum(F.when(ask, F.col("usdt"))), F.lit(0.0)).alias("ask_usdt"), F.count_if(bid).alias("bid_levels"), F.count_if(ask).alias("ask_levels"))
    both, total = F.col("best_bid").isNotNull() & F.col("best_ask").isNotNull(), F.col("bid_usdt") + F.col("ask_usdt")
    spread, mid = F.col("best_ask") - F.col("best_bid"), (F.col("best_ask") + F.col("best_bid")) / 2.0
    return s.withColumns({
        "bid_pct": percent(F.col("bid_usdt"), total),
        "ask_pct": percent(F.col("ask_usdt"), total),
        "spread": F.when(both, spread).otherwise(0.0),
        "mid": F.when(both, mid).otherwise(0.0),
        "spread_pct": F.when(both & (mid > 0), spread / F.when(mid > 0, mid) * 100.0).otherwise(0.0),
        "cvd": F.col("bid_usdt") - F.col("ask_usdt"),
    })


def integer_levels(book: DataFrame, depth: int, anchor: float | None = None) -> DataFrame:
    """Quantity and value at whole-number steps 1..depth on both sides of the
    anchor, by default the middle of the book; bids round down, asks up, the
    anchor's own level belongs to neither; a null or non-positive anchor gives
    no rows."""
    spark = book.sparkSession
    if anchor is None:
        mid = summary(book).select(F.floor("mid").cast("long").alias("anchor"))
    else:
        mid = spark.createDataFrame([(anchor,)], "a double").select(F.floor("a").cast("long").alias("anchor"))
    mid = F.broadcast(mid.where("anchor > 0"))  # one row at most
    rows = book.crossJoin(mid).withColumn("level", F.when(F.col("side") == "bid", F.floor("price")).otherwise(F.ceil("price")).cast("long"))
    rows = rows.withColumn("step", F.when(F.col("side") == "bid", F.col("anchor") - F.col("level")).otherwise(F.col("level") - F.col("anchor"))).where(F.col("step").between(1, depth))
    sums = rows.groupBy("side", "step").agg(F.sum("qty").alias("qty"), F.sum("usdt").alias("usdt"))
    grid = spark.range(1, depth + 1).select(F.col("id").alias("step")).crossJoin(spark.createDataFrame([("bid",), ("ask",)], "side string")).crossJoin(mid)  # 2 x depth rows
    out = grid.join(sums, ["side", "step"], "left").na.fill(0.0)
    level = F.when(F.col("side") == "bid", F.col("anchor") - F.col("step")).otherwise(F.col("anchor") + F.col("step"))
    return out.select("side", "step", level.alias("level"), F.round("qty").cast("long").alias("qty"), F.round("usdt").cast("long").alias("usdt"))


def ratio(levels: DataFrame) -> DataFrame:
    """Value on both sides of the given levels, and shares."""
    s = levels.agg(*(F.coalesce(F.sum(F.when(F.col("side") == x, F.col("usdt"))), F.lit(0)).cast("double").alias(f"{x}_usdt") for x in ("bid", "ask")))
    total = F.col("bid_usdt") + F.col("ask_usdt")
    return s.withColumns({"bid_pct": percent(F.col("bid_usdt"), total), "ask_pct": percent(F.col("ask_usdt"), total)})


def pairs(levels: DataFrame) -> DataFrame:
    """Bid and ask of each step side by side; here the difference is ask minus bid."""
    of = lambda x: levels.where(F.col("side") == x).select("step", F.col("level").cast("double").alias(f"{x}_precio"), F.col("usdt").cast("double").alias(f"{x}_usdt"))
    out = of("ask").join(of("bid"), "step")
    cvd, total = F.col("ask_usdt") - F.col("bid_usdt"), F.col("ask_usdt") + F.col("bid_usdt")
    return out.select(F.col("step").alias("paso"), "ask_precio", "ask_usdt", "bid_precio", "bid_usdt", cvd.alias("cvd"), F.when(total > 0, cvd / F.when(total > 0, total) * 100.0).otherwise(0.0).alias("cvd_pct")).orderBy("paso")
