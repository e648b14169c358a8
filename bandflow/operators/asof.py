"""The last value before each row, without sorting a key in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Places of the order of a stretch.
STRETCH = 1 << 16


def last_before(left: DataFrame, right: DataFrame, by: Sequence[str], value: str, order: str = "ord", stretch: int = STRETCH) -> DataFrame:
    """`left` with the column `value` of the last row of `right` at or before its place in `order` (an integer), within `by`.

    Both sides are laid one over the other and cut into stretches of the order.
    A row looks back within its stretch; what a stretch begins with comes from
    one row for each earlier stretch that has a value. Where there is none the
    value is null; of values at the same place the greatest is taken; null
    values are passed over; rows with a null key or place stay with a null.
    """
    width = F.floor(F.col(order) / stretch)
    found = right.where(F.col(value).isNotNull() & F.col(order).isNotNull())
    for k in by:
        found = found.where(F.col(k).isNotNull())
    found = found.select(*(F.col(k).alias(f"_{k}") for k in by), width.alias("_stretch"), F.col(order).alias("_at"), F.col(value).alias("_value"))
    keys = [f"_{k}" for k in by]
    rows = left.select(*(F.col(k).alias(f"_{k}") for k in by), width.alias("_stretch"), F.col(order).alias("_at"), F.struct(*left.columns).alias("_row"))
    both = rows.unionByName(found, allowMissingColumns=True)
    within = Window.partitionBy(*keys, "_stretch").orderBy("_at", F.col("_row").isNotNull(), F.col("_value").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_here", F.last("_value", ignorenulls=True).over(within)).where("_row is not null")
    # A row for each stretch, with or without values, takes over the last value of the stretches before.
    ends = rows.select(*keys, "_stretch", F.lit(None).cast(found.schema["_at"].dataType).alias("_at"), F.lit(None).cast(found.schema["_value"].dataType).alias("_value")).unionAll(found)
    ends = ends.groupBy(*keys, "_stretch").agg(F.max(F.when(F.col("_value").isNotNull(), F.struct("_at", "_value")))["_value"].alias("_value"))
    earlier = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, "_stretch", F.last("_value", ignorenulls=True).over(earlier).alias("_before"))
    out = both.join(carried, [*keys, "_stretch"], "left")
    return out.select("_row.*", F.coalesce("_here", "_before").alias(value))
