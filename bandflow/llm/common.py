"""Shared plumbing: table reading, lineage cuts, connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys that `salted_join` may deal over several tasks, and rows up to which a key never needs it.
HOT_KEYS, HOT_ROWS = 10_000, 1000
#: Rows of an Arrow batch of texts or sets.
BATCH_ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The whole table `name` below `sf_dir`, read by Spark's Parquet reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(df: DataFrame) -> DataFrame:
    """`df`, after lowering the session's Arrow batches to `BATCH_ROWS` rows, so that a worker holds few long texts at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key)) <= BATCH_ROWS:
        df.sparkSession.conf.set(key, BATCH_ROWS)
    return df


#: What this Python process keeps over tasks, by name: one thing at most.
_kept: dict[str, object] = {}


def keeping(name: str, make: Callable[[], object]) -> object:
    """What `make` returned for `name` in this process; whatever else was kept goes. Workers live on through all stages of
    a job, so that tables and memories of one stage would stay beside those of the next."""
    if name not in _kept:
        _kept.clear()
        _kept[name] = make()
    return _kept[name]


def trimmed(run: Callable[[Iterator], Iterator], keeps: bool = False) -> Callable[[Iterator], Iterator]:
    """`run`, after whose last batch the worker returns freed memory to the system: workers are kept for later tasks and
    stages. What an earlier stage left with `keeping` goes first, unless `run` itself `keeps` something."""

    def wrapped(batches: Iterator) -> Iterator:
        if not keeps:
            dropped()
        yield from run(batches)
        released()

    return wrapped


def dropped() -> None:
    """Lets go of what `keeping` holds; a function of its own, as `wrapped` goes to workers with a copy of its globals."""
    if _kept:
        _kept.clear()
        released()


def released() -> None:
    """Gives freed memory of this process back to the system."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # no such call outside of glibc
        ctypes.CDLL(None).malloc_trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir`, else (tests) a local one."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="bandflow-checkpoint-"))
    return context.getCheckpointDir().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """`df` computed once into the shared folder, without its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def workspace(spark: SparkSession) -> Iterator[str]:
    """A folder in the shared one for what `stored` needs no longer than this block; deleted at its end."""
    folder = f"{shared_dir(spark)}/work-{uuid.uuid4().hex}"
    try:
        yield folder
    finally:
        delete(spark, folder)


def stored(df: DataFrame, label: str, folder: str | None = None) -> DataFrame:
    """`df` written once as Parquet in the shared folder, or in a `workspace`, and read back."""
    spark = df.sparkSession
    path = f"{folder or shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """`name`, with underscores before it until `df` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def salted_join(many: DataFrame, one: DataFrame, key: str, spread: str, sizes: DataFrame) -> DataFrame:
    """`many` joined with `one`, which has one row for each `key`, so that no task gets all rows of a frequent key.

    `sizes(key, count)` tells the rows of `many` by key. A key with more than
    one in `HOT_KEYS` of all rows (and more than `HOT_ROWS`) is dealt over
    several tasks by the column `spread`, with a copy of its row of `one` in
    each. At most `HOT_KEYS` keys can be so frequent, so their list can be
    broadcast at any size.
    """
    sizes = sizes.select(F.col(key).alias("_key"), F.col("count").alias("_rows"))
    limit = max(HOT_ROWS, (sizes.agg(F.sum("_rows")).first()[0] or 0) // HOT_KEYS)
    hot = cut(sizes.where(F.col("_rows") > limit).select("_key", F.ceil(F.col("_rows") / limit).cast("int").alias("_salts")))
    if hot.isEmpty():
        return many.join(one, key)
    hot = F.broadcast(hot)
    salts = F.coalesce("_salts", F.lit(1))
    left = many.join(hot, F.col(key) == F.col("_key"), "left").withColumn("_salt", F.pmod(F.xxhash64(spread), salts).cast("int")).drop("_key", "_salts")
    right = one.join(hot, F.col(key) == F.col("_key"), "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_key", "_salts")
    return left.join(right, [key, "_salt"]).drop("_salt")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the undirected graph `edges(a, b)` of longs.

    Returns `(id, component_id)` for every vertex that an edge names; the
    component is its smallest vertex. Each round contracts every vertex into
    its smallest neighbour, so at least half of a component's vertices go and
    the number of rounds is logarithmic. Nothing is gathered in one place: a
    hub's neighbours meet only in a partial minimum. No edges: no rows.
    """
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    edges = cut(edges)
    labels = None
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("v"), F.col("b").alias("w")).unionAll(edges.select(F.col("b").alias("v"), F.col("a").alias("w")))
        parent = cut(both.groupBy("v").agg(F.min("w").alias("w")).select("v", F.least("v", "w").alias("p")))
        if labels is None:
            labels = parent.select(F.col("v").alias("id"), F.col("p").alias("component_id"))
        else:
            labels = labels.join(parent, F.col("component_id") == F.col("v"), "left").select("id", F.coalesce("p", "component_id").alias("component_id"))
        labels = cut(labels)
        moved = edges.join(parent.select(F.col("v").alias("a"), F.col("p").alias("pa")), "a").join(parent.select(F.col("v").alias("b"), F.col("p").alias("pb")), "b")
        edges = cut(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).where("a < b").distinct())
    if labels is None:
        labels = edges.select(F.col("a").alias("id"), F.col("b").alias("component_id"))
    return labels
