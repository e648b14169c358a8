"""Trade tables: the stored schema, Parquet selections, and views of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandflow.functions.expressions import Bands, ntz_millis

#: Stored trades. `timestamp` is signed, so that range predicates on it reach the Parquet scan.
TRADE_SCHEMA = "timestamp long, price double, volume_usdt double, volume_base double, side smallint, seg smallint"


def with_bands(trades: DataFrame, bands: Bands | None = None) -> DataFrame:
    return trades.withColumn("seg", (bands or Bands()).of(F.col("volume_usdt")))


def read_trades(spark: SparkSession, *paths: str, bands: Bands | None = None) -> DataFrame:
    """Stored trades with their arrival order `ord`.

    Files that hold unsigned times are cast on the way in, files without a
    band column get the bands of `bands`. What `write_trades` and `ingest`
    store (day folders) has one schema, so only one footer is read for it,
    predicates on its columns reach the scan, and it is ordered by time first;
    of other files all footers are read and missing bands filled in by row.
    """
    mixed = not all("/date=" in p for p in paths)
    raw = spark.read.option("mergeSchema", str(mixed).lower()).parquet(*paths)
    columns = {name: F.col(name).cast(kind) for name, kind in (x.split() for x in TRADE_SCHEMA.split(", ")) if name in raw.columns}
    place = F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row")
    order = F.struct(*place) if mixed else F.struct(columns["timestamp"].alias("timestamp"), *place)
    out = raw.select(*(c.alias(n) for n, c in columns.items()), order.alias("ord"))
    classified = (bands or Bands()).of(F.col("volume_usdt"))
    if "seg" not in raw.columns:
        return out.withColumn("seg", classified)
    seg = F.col("seg").cast("int")
    return out.withColumn("seg", F.coalesce(seg, classified) if mixed else seg)


def write_trades(trades: DataFrame, path: str, mode: str = "append") -> None:
    """Appends trades below symbol, market and date folders."""
    from bandflow.functions.expressions import day

    casts = [F.col(n).cast(k).alias(n) for n, k in (x.split() for x in TRADE_SCHEMA.split(", "))]
    rows = trades.select(*casts, "symbol", "market", day(F.col("timestamp")).alias("date"))
    rows.write.mode(mode).partitionBy("symbol", "market", "date").parquet(path)


def event_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades made from the `events` table: price and base volume follow from
    the row, notional volume is a multiple of 1/1024, so that its sums are
    exact in any order."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    base = (F.col("event_id") % 9 + 1) * F.pow(F.lit(10.0), F.floor(F.col("event_id") / 9) % 7) / 10.0
    price = F.lit(100.0) + F.col("value")
    return with_bands(
        e.select(
            F.col("event_id").alias("ord"),
            ntz_millis(F.col("ts")).alias("timestamp"),
            price.alias("price"),
            base.alias("volume_base"),
            (F.floor(price * base * 1024.0).cast("double") / 1024.0).alias("volume_usdt"),
            F.when(F.col("event_type").isin("error", "view"), 1).otherwise(0).alias("side"),
            F.when(F.col("user_id") % 2 == 0, "spot").otherwise("futures").alias("market"),
            "user_id",
            "event_type",
            "value",
        )
    )


#: Start of the day into which `dense_trades` folds the month.
DENSE_START = 1_704_067_200_000


def dense_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`event_trades` with thirty days folded into one."""
    t = event_trades(spark, sf_dir)
    return t.withColumn("timestamp", F.lit(DENSE_START) + F.floor((F.col("timestamp") - DENSE_START) / 30))


def lineitem_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items read as trades: a larger table for benchmarks."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return with_bands(
        li.select(
            (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ord"),
            ntz_millis(F.col("l_shipdate")).alias("timestamp"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
            F.col("l_extendedprice").alias("volume_usdt"),
            F.col("l_quantity").alias("volume_base"),
            F.when(F.col("l_linestatus") == "O", 1).otherwise(0).alias("side"),
        )
    )


def book_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth updates made from `events`: one level a row, with sequence numbers."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    i = F.col("event_id")
    offset = F.round(F.pmod(F.floor(F.col("value") * 100), F.lit(2000))) / 100.0
    return e.select(
        i.alias("ord"),
        (i * 3 + 1).alias("u_first"),
        (i * 3 + 3).alias("u"),
        F.when(i % 500 == 499, i * 3 - 1).otherwise(i * 3).alias("pu"),
        F.when(i % 2 == 0, "bid").otherwise("ask").alias("side"),
        F.when(i % 2 == 0, F.lit(150.0) - offset).otherwise(F.lit(150.5) + offset).alias("price"),
        (i % 11).cast("double").alias("qty"),
    )


#: Symbols of `depth_messages`, messages from one broken sequence to the next, the first broken one, and how many messages a snapshot is ahead.
DEPTH_SYMBOLS, BROKEN_EVERY, BROKEN_AT, AHEAD = 5, 1000, 199, 10


def depth_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth updates of several symbols made from `events`: three levels a message, some with a broken sequence."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    i, cents = F.col("event_id"), F.floor(F.col("value") * 100)
    j = F.floor(i / DEPTH_SYMBOLS)
    level = lambda price, qty: F.struct(price.alias("price"), qty.cast("double").alias("qty"))
    offset = lambda factor: F.pmod(cents * factor, F.lit(2000)) / 100.0
    return e.select(
        F.concat(F.lit("S"), i % DEPTH_SYMBOLS).alias("symbol"),
        i.alias("ord"),
        F.lit(False).alias("snapshot"),
        (j * 3 + 1).alias("u_first"),
        (j * 3 + 3).alias("u"),
        F.when(j % BROKEN_EVERY == BROKEN_AT, j * 3 - 1).otherwise(j * 3).alias("pu"),
        F.array(level(F.lit(150.0) - offset(1), i % 11), level(F.lit(150.0) - offset(7), i * 3 % 7)).alias("b"),
        F.array(level(F.lit(150.5) + offset(3), i % 5)).alias("a"),
    )


def depth_snapshots(requests: DataFrame) -> DataFrame:
    """What the exchange answers to requests (symbol, u) of `depth_messages`: one level a side, some messages ahead; the first update asks for the start."""
    j = F.floor((F.col("u") - 3) / 3)
    last = F.when(F.col("u") > 0, (j + AHEAD) * 3 + 2).otherwise(2)
    one = lambda price, qty: F.array(F.struct(F.lit(price).alias("price"), qty.cast("double").alias("qty")))
    return requests.select("symbol", F.lit(-1).cast("long").alias("ord"), F.lit(True).alias("snapshot"), F.lit(0).cast("long").alias("u_first"), last.cast("long").alias("u"), F.lit(0).cast("long").alias("pu"), one(100.25, F.col("u") % 7 + 1).alias("b"), one(200.75, F.col("u") % 5 + 1).alias("a"))


def depth_snapshot(symbol: str, u: int) -> tuple[int, list[tuple[float, float]], list[tuple[float, float]]]:
    """`depth_snapshots` of one request: last update, bids and asks."""
    last = ((u - 3) // 3 + AHEAD) * 3 + 2 if u > 0 else 2
    return last, [(100.25, float(u % 7 + 1))], [(200.75, float(u % 5 + 1))]


def liquidation_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forced orders made from `events` errors, as raw text fields."""
    t = dense_trades(spark, sf_dir).where("event_type = 'error'")
    return t.select("ord", F.when(F.col("user_id") % 3 == 0, "SELL").otherwise("BUY").alias("S"), F.col("price").cast("string").alias("p"), F.when(F.col("ord") % 50 == 7, "n/a").otherwise(F.col("volume_base").cast("string")).alias("q"), F.col("timestamp").alias("T"))


def raw_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trade messages as JSON text, some broken on purpose by the row's number."""
    t = event_trades(spark, sf_dir)
    o = F.col("ord")
    p = F.when(o % 89 == 0, "abc").when(o % 83 == 0, "0").otherwise(F.col("price").cast("string"))
    common = [F.lit("trade").alias("e"), F.col("timestamp").alias("E"), F.lit("SOLUSDT").alias("s"), o.alias("t"), p.alias("p"), F.col("volume_base").cast("string").alias("q")]
    last = [(F.col("side") == 1).alias("m")]
    whole = F.to_json(F.struct(*common, F.col("timestamp").alias("T"), *last))
    cut = F.to_json(F.struct(*common, *last))
    unnamed = F.to_json(F.struct(*(c for i, c in enumerate(common) if i != 2), F.col("timestamp").alias("T"), *last))
    return t.select("ord", "market", F.when(o % 97 == 0, "not json").when(o % 79 == 0, cut).when(o % 73 == 0, unnamed).otherwise(whole).alias("raw"))
