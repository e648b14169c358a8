"""Document fingerprints of closed syncmers, with DataFrame functions only.

A text is a row of words (runs without white space); a word of more than
`LONG` characters, such as a blob or text of a script without spaces, stands
for the row of its overlapping `GRAM`-character parts, so that windows over it
are character k-mers. Of the text's k-word windows
those are chosen whose minimal inner s-word part, by hash, comes first or
last in the window. Whether a window is chosen depends on nothing outside it,
so the same passage is anchored alike wherever it stands. A fingerprint is
the hashes of the chosen windows in text order, each once; a text of fewer
than k words or without a chosen window has one anchor, the hash of all its words; null, empty and blank
texts have none. The likeness of two fingerprints is the share of anchors they
have in common, 2 * common / (both counts), and 1 for two empty ones.

All hashes have 64 bits. `anchor_positions` gives the anchors with their places.

Defined results: rows with equal ids follow each other by text hash; null ids
come after all others, by text hash; a single document follows itself; an empty table
gives an empty result; columns besides doc_id and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, fresh, table

#: Words in a window, and in the inner part that decides.
K, S = 5, 1
#: Characters from which on a word is split, and in the parts that it is split into.
LONG, GRAM = 16, 4
#: Documents in one stretch of the order of ids.
STRETCH_ROWS = 1024
#: Stretches known to at most this many rows (24 bytes each) are broadcast; more are joined by shuffle.
BROADCAST_STRETCHES = 200_000
BLANKS = r"[\x20\x09-\x0D]+"


def with_words(df: DataFrame, text: str, out: str) -> DataFrame:
    """`df` with the array column `out` of the hashes of the words of column `text`, long ones in parts."""
    raw = f"{out}_raw"

    def parts(w: Column) -> Column:
        of = lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - GRAM), lambda i: F.xxhash64(*(F.get(c, i + j) for j in range(GRAM))))
        return F.get(F.transform(F.array(F.split(w, "")), lambda c: of(c)), F.lit(0))  # characters are split off once a word

    long = lambda w: F.length(w) > LONG
    df = df.withColumn(raw, F.filter(F.split(F.coalesce(F.col(text), F.lit("")), BLANKS), lambda w: w != ""))
    split = F.flatten(F.transform(raw, lambda w: F.when(long(w), parts(w)).otherwise(F.array(F.xxhash64(w)))))
    return df.withColumn(out, F.when(F.exists(raw, long), split).otherwise(F.transform(raw, lambda w: F.xxhash64(w)))).drop(raw)


def with_windows(df: DataFrame, text: str, out: str, k: int = K, s: int = S) -> DataFrame:
    """`df` with the array column `out` of the chosen windows of column `text`, in text order, as structs (position, anchor)."""
    words, parts = fresh(df, f"_{out}_words"), fresh(df, f"_{out}_parts")
    df = with_words(df, text, words)
    inner = F.col(words)
    if s > 1:
        at = lambda i, j: F.get(F.col(words), i + j)
        inner = F.when(F.size(words) >= s, F.transform(F.sequence(F.lit(0), F.size(words) - s), lambda i: F.xxhash64(*(at(i, j) for j in range(s))))).otherwise(F.array().cast("array<long>"))
    df = df.withColumn(parts, inner)

    def chosen(i: Column) -> Column:
        row = [F.get(F.col(parts), i + j) for j in range(k - s + 1)]
        least = F.least(*row)
        whole = F.struct(i.alias("position"), F.xxhash64(*(F.get(F.col(words), i + j) for j in range(k))).alias("anchor"))
        return F.when((row[0] == least) | (row[-1] == least), whole)

    kind = "array<struct<position:int,anchor:bigint>>"
    many = F.filter(F.transform(F.sequence(F.lit(0), F.size(words) - k), chosen), lambda x: x.isNotNull())
    few = F.when(F.size(words) > 0, F.array(F.struct(F.lit(0).alias("position"), F.xxhash64(words).alias("anchor")))).otherwise(F.array().cast(kind))
    df = df.withColumn(out, F.when(F.size(words) >= k, many).otherwise(F.array().cast(kind)).cast(kind))
    return df.withColumn(out, F.when(F.size(out) > 0, F.col(out)).otherwise(few)).drop(words, parts)


def with_anchors(df: DataFrame, text: str, out: str, k: int = K, s: int = S) -> DataFrame:
    """`df` with the array column `out` of the anchors of column `text`, in text order, each once."""
    return with_windows(df, text, out, k, s).withColumn(out, F.array_distinct(F.col(f"{out}.anchor")))


def anchor_positions(df: DataFrame, text: str, k: int = K, s: int = S) -> DataFrame:
    """(doc_id, position, anchor): where the anchors of each text stand, for positional matching."""
    windows = with_windows(df.select("doc_id", F.col(text).alias("text")), "text", "of", k, s)
    return windows.select("doc_id", F.inline("of"))


def likeness(a: str, b: str) -> Column:
    """Share of anchors that the array columns `a` and `b` have in common."""
    both = F.size(a) + F.size(b)
    return F.when(both == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / both)


def fingerprint(anchors: str) -> Column:
    return F.array_join(F.transform(anchors, lambda x: x.cast("string")), " ")


def with_next(docs: DataFrame, columns: list[str], derive: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """`docs` with `next_<c>` for each of `columns`: the value of the next row by
    descending doc_id, and of the first row after the last.

    The order is cut into stretches of ids of about even size; a stretch is
    sorted in one task and also gets a copy of the first row of the next
    stretch. No task sees more than its stretch. `derive` adds columns to the
    rows before they are dealt out.
    """
    tag = "_next"
    while any(c.lower().startswith(tag) for c in docs.columns):
        tag = f"_{tag}"
    c_stretch, c_tie, c_of, c_top, c_top_tie, c_to, c_first, c_part, c_copy = (f"{tag}_{x}" for x in ("stretch", "tie", "of", "top", "top_tie", "to", "first", "part", "copy"))
    cuts_at = [i / 256 for i in range(257)]
    n, unnamed, cuts = docs.agg(F.count(F.lit(1)), F.count_if(F.col("doc_id").isNull()), F.percentile_approx("doc_id", cuts_at, 10_000)).first()
    cuts = sorted(set(cuts or [0]))
    fine = max(1, math.ceil(n / len(cuts) / STRETCH_ROWS))
    bounds = F.array(*(F.lit(int(c)).cast("long") for c in [*cuts, cuts[-1] + 1]))
    i = F.greatest(F.lit(0), F.size(F.filter(bounds, lambda c: c <= F.col("doc_id"))) - 1)
    low, high = F.get(bounds, i).cast("double"), F.get(bounds, i + 1).cast("double")
    within = F.least(F.lit(fine - 1), F.greatest(F.lit(0), F.floor((F.col("doc_id").cast("double") - low) / F.coalesce(high - low, F.lit(1.0)) * fine)))
    # Null ids are below all others and cut by text hash.
    below = F.floor((F.col(c_tie).cast("double") / float(1 << 63) + 1) / 2 * max(1, math.ceil(unnamed / STRETCH_ROWS)))
    stretch = F.when(F.col("doc_id").isNull(), -1 - below).otherwise(i.cast("long") * fine + F.coalesce(within, F.lit(0)))
    docs = docs.withColumn(c_tie, F.xxhash64("text")).withColumn(c_stretch, stretch)

    unnamed_part = max(1, math.ceil(unnamed / STRETCH_ROWS / 256))
    # The first row of a stretch goes to the next higher one; the highest stretch of a coarse part to the lowest of the next part.
    part = F.floor(F.col(c_of) / fine)
    first_row = F.max(F.struct(F.col("doc_id").isNotNull(), "doc_id", F.bitwise_not(c_tie).alias("t"))).alias(c_first)
    tops = cut(docs.groupBy(F.col(c_stretch).alias(c_of)).agg(first_row).withColumn(c_part, F.when(F.col(c_of) < 0, F.floor(F.col(c_of) / unnamed_part)).otherwise(part)))
    lowest = {r[c_part]: r["low"] for r in tops.groupBy(c_part).agg(F.min(c_of).alias("low")).collect()}  # at most 257 parts and 256 of null ids
    parts = sorted(lowest)
    following = F.create_map(*[F.lit(x) for p, q in zip(parts, parts[1:] + parts[:1], strict=True) for x in (p, lowest[q])]) if parts else F.lit(None)
    order = Window.partitionBy(c_part).orderBy(c_of)
    tops = tops.select(c_of, F.col(f"{c_first}.doc_id").alias(c_top), F.bitwise_not(F.col(f"{c_first}.t")).alias(c_top_tie), F.coalesce(F.lead(c_of).over(order), F.element_at(following, F.col(c_part)) if parts else F.lit(None)).cast("long").alias(c_to))
    tops = F.broadcast(tops) if tops.count() <= BROADCAST_STRETCHES else tops
    same = (F.col(c_stretch) == F.col(c_of)) & F.col("doc_id").eqNullSafe(F.col(c_top)) & (F.col(c_tie) == F.col(c_top_tie))
    first = docs.join(tops, same).drop(c_of, c_top, c_top_tie, c_stretch)
    both = docs.withColumn(c_copy, F.lit(False)).unionByName(first.withColumnRenamed(c_to, c_stretch).withColumn(c_copy, F.lit(True)))
    both = derive(both)
    rows = Window.partitionBy(c_stretch).orderBy(c_copy, F.desc_nulls_last("doc_id"), c_tie)
    return both.withColumns({f"next_{c}": F.lead(c).over(rows) for c in columns}).where(~F.col(c_copy)).drop(c_copy, c_tie, c_stretch)


def op10_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole document and of its edited text, and their likeness."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = with_next(docs, ["text", "anchors"], lambda df: with_anchors(df, "text", "anchors"))
    half = F.floor(F.length("text") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.left("text", F.length("text") - half), F.left("next_text", half)))
    rows = with_anchors(rows, "edited", "edited_anchors")
    return rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        fingerprint("anchors").alias("fingerprint"),
        fingerprint("edited_anchors").alias("edited_fingerprint"),
        likeness("anchors", "edited_anchors").alias("near_edited"),
        likeness("anchors", "next_anchors").alias("near_next"),
    )
