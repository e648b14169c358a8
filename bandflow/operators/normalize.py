"""Raw trade messages to typed trades and rejects.

Fields are taken from the JSON text by case-sensitive paths, because keys
differ only by case. Prices and quantities must be strings that parse as
numbers (infinity is one), event kind and symbol strings, times and the trade's
number non-negative integers, the maker flag a boolean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandflow.functions.expressions import fixed_text

NUMBER = r"^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:inf|infinity|nan))$"


def _field(v: str, key: str, kind: str) -> Column:
    return F.try_variant_get(F.col(v), f"$.{key}", kind)


def _number(text: Column) -> Column:
    """A double from text without surrounding blanks, else null."""
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def fields(messages: DataFrame, raw: str = "raw") -> DataFrame:
    """`messages` with timestamp, price, volume_base, volume_usdt, side and
    `reject_kind`: the first check that failed (json, number, trade), or null."""
    # A generator keeps the optimizer from copying the parse into every later use and filter.
    v = messages.select("*", F.inline(F.array(F.struct(F.try_parse_json(F.col(raw)).alias("_v")))))
    kind = lambda k: F.schema_of_variant(F.try_variant_get("_v", f"$.{k}", "variant"))
    count = lambda k: (kind(k) == "BIGINT") & (_field("_v", k, "bigint") >= 0)
    v = v.select(
        *messages.columns,
        F.when(kind("T") == "BIGINT", _field("_v", "T", "bigint")).alias("timestamp"),
        F.when(kind("p") == "STRING", _field("_v", "p", "string")).alias("_p"),
        F.when(kind("q") == "STRING", _field("_v", "q", "string")).alias("_q"),
        F.when(kind("m") == "BOOLEAN", _field("_v", "m", "boolean")).alias("_m"),
        ((kind("e") == "STRING") & (kind("s") == "STRING") & count("E") & count("t")).alias("_named"),
    )
    v = v.withColumns({"price": _number(F.col("_p")), "volume_base": _number(F.col("_q"))})
    v = v.withColumns({"volume_usdt": F.col("price") * F.col("volume_base"), "side": F.when(F.col("_m"), 1).otherwise(0)})
    positive = lambda c: (F.col(c) > 0) & ~F.isnan(c)
    shape = ~F.coalesce("_named", F.lit(False)) | F.col("timestamp").isNull() | (F.col("timestamp") < 0) | F.col("_p").isNull() | F.col("_q").isNull() | F.col("_m").isNull()
    good = (F.col("timestamp") > 0) & positive("price") & positive("volume_base") & positive("volume_usdt")
    reject = F.when(shape, "json").when(F.col("price").isNull() | F.col("volume_base").isNull(), "number").when(~good, "trade")
    return v.withColumn("reject_kind", reject).drop("_p", "_q", "_m", "_named")


def trades(messages: DataFrame, raw: str = "raw") -> DataFrame:
    """The valid trades among `messages`."""
    return fields(messages, raw).where("reject_kind is null").drop("reject_kind", raw)


def rejects(messages: DataFrame, raw: str = "raw") -> DataFrame:
    return fields(messages, raw).where("reject_kind is not null").select(*messages.columns, "reject_kind")


def detected(messages: DataFrame, raw: str = "raw") -> DataFrame:
    """Valid trades with the market found from the text alone: a well-formed
    message of either market reads as spot, since the only key that tells them
    apart has a default."""
    return trades(messages, raw).withColumn("market", F.lit("spot"))


def side_text(side: Column) -> Column:
    return F.when(side == 0, "BUY").when(side == 1, "SELL").otherwise("UNKNOWN")


def display(t: DataFrame) -> Column:
    """A trade as one line of text."""
    ms = F.col("timestamp")
    day = F.date_from_unix_date(F.floor(ms / 86_400_000).cast("int")).cast("string")
    part = lambda unit, size: F.lpad((F.floor(ms / unit) % size).cast("string"), 2, "0")
    clock = F.concat_ws(":", part(3_600_000, 24), part(60_000, 60), part(1000, 60))
    price, usdt, base = (fixed_text(F.col(c), n) for c, n in (("price", 2), ("volume_usdt", 2), ("volume_base", 8)))
    return F.format_string("[%d] %s %s.%03d UTC | precio: %s | vol_usdt: %s | vol_base: %s | %s", ms, day, clock, ms % 1000, price, usdt, base, side_text(F.col("side")))
