"""Text forms of results: CSV lines, the four-decimal display and nested JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandflow.functions.expressions import fixed_text


def as_text(df: DataFrame, name: str) -> Column:
    """A cell as text: four decimals for numbers with a fraction, NULL for nothing."""
    return _shown(F.col(name), dict(df.dtypes)[name])


def _shown(c: Column, kind: str) -> Column:
    text = fixed_text(c.cast("double"), 4) if kind in ("double", "float") else c.cast("string")
    return F.when(c.isNull(), "NULL").otherwise(text)


def csv_line(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """A row as CSV: values are quoted if they hold a comma."""
    cells = [as_text(df, c) for c in columns or df.columns]
    return F.concat_ws(",", *(F.when(x.contains(","), F.concat(F.lit('"'), x, F.lit('"'))).otherwise(x) for x in cells))


def as_strings(df: DataFrame) -> DataFrame:
    return df.select(*(as_text(df, c).alias(c) for c in df.columns))


def section(df: DataFrame, keys: Sequence[str] = (), name: str = "rows", text: bool = False) -> DataFrame:
    """`df` as a list of structs in the column `name`: one row, or one for each value of `keys`.

    For reports, whose rows are few: a list is built in one task. It is sorted
    by the columns in their order; with `text` cells have their display text.
    """
    cells = [c for c in df.columns if c not in keys]
    row = F.struct(*cells)
    rows = df.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias(name))
    if not text:
        return rows
    kinds = dict(df.dtypes)
    shown = F.transform(name, lambda r: F.struct(*(_shown(r[c], kinds[c]).alias(c) for c in cells)))
    return rows.withColumn(name, shown)


def json_bundle(sections: dict[str, DataFrame]) -> DataFrame:
    """One row with the column `json`: an object with the list of each section (a frame of one row and one column)."""
    out = None
    for name, df in sections.items():
        one = df.select(F.col(df.columns[0]).alias(name))
        out = one if out is None else out.crossJoin(F.broadcast(one))  # one row each
    return out.select(F.to_json(F.struct(*out.columns), {"ignoreNullFields": "false"}).alias("json"))
