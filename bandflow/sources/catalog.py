"""Which trade files there are, and selections of them.

Listings go through the Hadoop file system, so they work on any store that
Spark reads; they hold one row for each file of a pair, never file contents.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

FILE_NAME = re.compile(r"[A-Za-z0-9_.=-]+\.parquet")


def _entries(spark: SparkSession, path: str) -> list:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return list(fs.listStatus(where)) if fs.exists(where) else []


def _listed(spark: SparkSession, base: str, pair: str, market: str) -> list[tuple[str, str, int]]:
    """(name, path, bytes) of a pair's trade files, by name: single files `pair/market/name.parquet`, and what
    `write_trades` and `ingest` store, `symbol=pair/market=market/date=day`, as one entry `day.parquet` for each day."""
    flat = [s for s in _entries(spark, f"{base}/{pair}/{market}") if s.getPath().getName().endswith(".parquet")]
    out = [(s.getPath().getName(), s.getPath().toString(), s.getLen()) for s in flat]
    for day in _entries(spark, f"{base}/symbol={pair}/market={market}"):
        name = day.getPath().getName()
        if name.startswith("date="):
            files = [x for x in _entries(spark, day.getPath().toString()) if x.getPath().getName().endswith(".parquet")]
            out.append((f"{name.removeprefix('date=')}.parquet", day.getPath().toString(), sum(x.getLen() for x in files)))
    return sorted(out)


def pairs(spark: SparkSession, base: str) -> list[str]:
    """Pairs with a folder below `base`, sorted."""
    names = [s.getPath().getName() for s in _entries(spark, base) if s.isDirectory()]
    return sorted({n.removeprefix("symbol=") for n in names if not n.startswith(("_", "."))})


def files(spark: SparkSession, base: str, pair: str, market: str | None = None, newest_first: bool = False) -> DataFrame:
    """(name, path, market, kib) of a pair's trade files."""
    rows = []
    for m in (market,) if market else ("spot", "futures"):
        found = _listed(spark, base, pair, m)
        rows += [(name, path, m, size // 1024) for name, path, size in (reversed(found) if newest_first else found)]
    return spark.createDataFrame(rows, "name string, path string, market string, kib long")


def selected(spark: SparkSession, base: str, pair: str, market: str, choice: str = "") -> list[str]:
    """Paths that `choice` names: all if blank, `rango:a,b,...` for a list, `first..last`
    for a range of names, else one file. Missing files of a list are left out;
    ValueError if nothing is left."""
    found = _listed(spark, base, pair, market)
    if not choice.strip():
        keep = lambda n: True
    elif choice.startswith("rango:"):
        wanted = {x.strip() for x in choice.removeprefix("rango:").split(",")}
        keep = wanted.__contains__
    elif ".." in choice:
        first, _, last = choice.partition("..")
        keep = lambda n: first <= n <= last
    else:
        keep = choice.__eq__
    picked = [path for name, path, _ in found if keep(name)]
    if not picked:
        raise ValueError(f"no trade files for {pair} {market} {choice}".rstrip())
    return picked


def newest(spark: SparkSession, base: str, pair: str, market: str) -> str:
    return selected(spark, base, pair, market)[-1]


def drop_file(spark: SparkSession, base: str, pair: str, market: str, name: str) -> bool:
    """Deletes one file, or one stored day; names with path parts are refused. Whether there was one."""
    if market not in ("spot", "futures") or not FILE_NAME.fullmatch(name) or not re.fullmatch(r"[A-Z0-9]+", pair):
        raise ValueError("not a file name of this catalog")
    gone = [path for found, path, _ in _listed(spark, base, pair, market) if found == name]
    for path in gone:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return bool(gone)
