"""Line deduplication by pairwise alignment.

Overlapping documents are found through shared rare line hashes, aligned with
patience diff, and aligned common blocks are deleted from the later document.

A line is rare if at most `RARE` documents hold it; all pairs of these are
aligned. A common block none of whose lines is rare is found by the block
itself: `windows` lists the least blocks of enough words, at most two for each
line, and every document is aligned with the earliest one that holds the same
least block. So documents are paired wherever they have a block in common, but
a passage in very many documents makes one pair for each, not all pairs.

Patience diff takes lines that stand once in both documents, keeps their
longest ascending row, and goes on between them. Aligned runs of at least
`min_words` words are deleted. Common blocks that one ascending row can't hold,
moved or repeated ones, are aligned afterwards by their least blocks. What
goes is therefore the same for any order of the pairs: every line that lies in
a run of enough words which an earlier document holds as well.

Lines are compared without surrounding white space (so CRLF and LF are alike);
blank lines end a block. Lines and blocks are compared by 64-bit hashes.

Defined results: null text stays null and empty text empty; equal rows count
as one and lose the same lines; rows with equal ids and different texts are
not aligned with each other; a document whose lines are all deleted keeps an
empty text; a null id is left as it is; an empty table gives an empty result;
all columns of the input stay, `n_lines_cut` is overwritten, and `n_chars`, if
there, is that of the new text.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, salted_join, small_batches, stored, table, trimmed, workspace

#: Least words of an aligned block.
MIN_WORDS = 8
#: Documents that may hold a rare line.
RARE = 8
BLANKS = " \t\r\x0b\x0c"


def ascending(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of `pairs`, sorted by first, that ascends by second."""
    tails: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for i, (_, y) in enumerate(pairs):
        k = bisect_left(tails, y)
        back.append(at[k - 1] if k else -1)
        if k == len(tails):
            tails.append(y)
            at.append(i)
        else:
            tails[k], at[k] = y, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def windows(hashes: np.ndarray, words: np.ndarray, starts: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first line, line after the last, hash) of the least blocks of `min_words` words.

    `hashes` (unsigned, 64 bits) and `words` are those of all lines of some
    documents in a row, `starts` the first line of each; blank lines have 0 words.
    """
    n = len(words)
    at = np.arange(n)
    opens = words == 0
    opens[1:] |= words[:-1] == 0
    opens[starts[starts < n]] = True
    opens[:1] = True
    firsts = np.flatnonzero(opens)
    run = np.cumsum(opens) - 1
    total = np.concatenate(([0], np.cumsum(words)))
    end = np.searchsorted(total, total[:-1] + max(1, min_words), "left")  # the least block from each line on
    good = end <= np.append(firsts[1:], n)[run]
    begin = np.searchsorted(total, total[1:] - max(1, min_words), "right") - 1  # and up to each line
    also = begin >= firsts[run]
    also[also] &= ~(good[begin[also]] & (end[begin[also]] == at[also] + 1))
    first, after = np.concatenate((at[good], begin[also])), np.concatenate((end[good], at[also] + 1))
    size = after - first
    key = size.astype(np.uint64)
    for k in range(int(size.max(initial=0))):
        there = np.flatnonzero(size > k)
        x = (key[there] ^ hashes[first[there] + k]) + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        key[there] = x ^ (x >> np.uint64(31))
    return first, after, key


def patience(a: list[int], b: list[int]) -> dict[int, int]:
    """Positions of `a` aligned with equal ones of `b`, ascending in both."""
    out: dict[int, int] = {}
    work = [(0, len(a), 0, len(b))]
    while work:
        i, m, j, n = work.pop()
        while i < m and j < n and a[i] == b[j]:
            out[i] = j
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            out[m] = n
        if i == m or j == n:
            continue
        left, right = Counter(a[i:m]), Counter(b[j:n])
        at = {x: k for k, x in enumerate(b[j:n], j) if right[x] == 1 and left[x] == 1}
        anchors = ascending([(k, at[x]) for k, x in enumerate(a[i:m], i) if x in at])
        if not anchors:
            continue
        for (p, q), (r, s) in zip([(i - 1, j - 1), *anchors], [*anchors, (m, n)], strict=True):
            if p >= i:
                out[p] = q
            work.append((p + 1, r, q + 1, s))
    return out


def common_blocks(a: np.ndarray, words: np.ndarray, b: np.ndarray, blank: np.ndarray, least: int) -> np.ndarray:
    """Which lines of the later document `a` lie in blocks of `least` words that it has in common with `b`."""
    cut = np.zeros(len(a), bool)
    shared = np.isin(a, b) & (words > 0)
    if words[shared].sum() < least:
        return cut
    match = np.full(len(a), -2)
    for i, j in patience(a.tolist(), b.tolist()).items():
        match[i] = j
    match[words == 0] = -2
    edge = np.flatnonzero(np.concatenate(([True], (match[1:] != match[:-1] + 1) | (match[1:] < 0), [True])))
    size = np.add.reduceat(words, edge[:-1])
    for i in np.flatnonzero((size >= least) & (match[edge[:-1]] >= 0)):
        cut[edge[i] : edge[i + 1]] = True
    if (shared & ~cut).any():
        first, after, key = windows(np.concatenate((a, b)), np.concatenate((words, blank)), np.array([0, len(a)]), least)
        for i in np.flatnonzero(np.isin(key, key[first >= len(a)]) & (first < len(a))):
            cut[first[i] : after[i]] = True
    return cut


def word_count(line: Column) -> Column:
    """Words of a line without surrounding white space."""
    single = F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1
    return F.when(line == "", 0).when(line.contains("  ") | line.contains("\t"), F.size(F.split(line, r"[\x20\x09-\x0D]+"))).otherwise(single)


def unit() -> Column:
    """Names a document by its id and text."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def lined(docs: DataFrame) -> DataFrame:
    """(unit, doc_id, h, w): hashes and word counts of each different document's lines."""
    lines = F.transform(F.split(F.col("text").cast("string"), "\n"), lambda x: F.trim(x, F.lit(BLANKS)))
    hashes, words = F.transform(lines, lambda x: F.xxhash64(x)), F.transform(lines, word_count)
    rows = small_batches(docs).where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    return rows.select(unit().alias("unit"), F.col("doc_id").cast("long").alias("doc_id"), hashes.alias("h"), words.alias("w")).dropDuplicates(["unit"])


def arrays(column: pa.Array, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind)


def meeting_keys(rows: DataFrame, folder: str, min_words: int) -> DataFrame:
    """(key, rare, unit, doc_id): a document's rare shared lines, and its least blocks without a rare line."""
    lines = rows.select("unit", F.explode(F.array_distinct(F.filter(F.transform("h", lambda h, i: F.when(F.get("w", i) > 0, h)), lambda h: h.isNotNull()))).alias("h"))
    shared = stored(lines.groupBy("h").agg(F.count("*").alias("count")).where("count > 1"), "shared", folder)
    known = salted_join(lines, shared, "h", "unit", shared)
    levels = known.groupBy("unit").agg(F.collect_list(F.struct("h", (F.col("count") <= RARE).alias("rare"))).alias("of"))
    both = rows.join(levels, "unit").select("unit", "doc_id", "h", "w", "of")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, w, pairs = arrays(batch.column(2), np.int64).view(np.uint64), arrays(batch.column(3), np.int64), batch.column(4).flatten()
            starts = np.concatenate(([0], np.cumsum(batch.column(2).value_lengths().to_numpy(zero_copy_only=False))))
            of = np.searchsorted(starts, np.arange(len(h)), "right") - 1
            known, at = np.unique(pairs.field("h").to_numpy(zero_copy_only=False).view(np.uint64), return_index=True)
            rare = pairs.field("rare").to_numpy(zero_copy_only=False).astype(bool)[at]
            place = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
            held = (known[place] == h) & (w > 0) if len(known) else np.zeros(len(h), bool)
            is_rare = held & (rare[place] if len(known) else False)
            first, after, key = windows(h, w, starts[:-1], min_words)
            rest = np.concatenate(([0], np.cumsum(~(held & ~is_rare))))
            frequent = rest[after] == rest[first]
            lines_at = np.flatnonzero(is_rare)
            keys, where = np.concatenate((h[lines_at], key[frequent])), np.concatenate((of[lines_at], of[first[frequent]]))
            flags = np.arange(len(keys)) < len(lines_at)
            once = np.unique(np.stack((where, keys.view(np.int64), flags)), axis=1, return_index=True)[1] if len(keys) else np.empty(0, np.int64)
            where = pa.array(where[once].astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(keys[once].view(np.int64)), pa.array(flags[once]), batch.column(0).take(where), batch.column(1).take(where)], names=["key", "rare", "unit", "doc_id"])

    return both.mapInArrow(trimmed(run), "key long, rare boolean, unit long, doc_id long")


def overlapping(rows: DataFrame, folder: str, min_words: int) -> DataFrame:
    """(unit, other): documents to align with an earlier one."""
    keys = stored(meeting_keys(rows, folder, min_words), "keys", folder)
    groups = keys.where("rare").groupBy("key").agg(F.collect_list(F.struct("doc_id", "unit")).alias("of"))  # at most `RARE`
    first = groups.select("of", F.explode("of").alias("x"))
    earlier = F.explode(F.filter("of", lambda y: y["doc_id"] < F.col("x.doc_id")))
    by_line = first.select(F.col("x.unit").alias("unit"), earlier.alias("y")).select("unit", F.col("y.unit").alias("other"))
    blocks = keys.where("not rare").select("key", "unit", "doc_id")
    holders = blocks.groupBy("key").agg(F.min(F.struct("doc_id", "unit")).alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("count")).where("first.doc_id < last")
    holders = stored(holders.select("key", F.col("first.doc_id").alias("first_id"), F.col("first.unit").alias("other"), "count"), "holders", folder)
    by_block = salted_join(blocks, holders.drop("count"), "key", "unit", holders.select("key", "count")).where("doc_id > first_id").select("unit", "other")
    return by_line.unionAll(by_block).distinct()


def deletions(docs: DataFrame, folder: str, min_words: int = MIN_WORDS) -> DataFrame:
    """(unit, cut): the line positions that are deleted from each different document; reads what it stores in `folder`."""
    rows = stored(lined(docs), "lines", folder)
    pairs = stored(overlapping(rows, folder, min_words), "overlaps", folder)
    later = pairs.join(rows.select("unit", "h", "w"), "unit")
    earlier = rows.select(F.col("unit").alias("other"), F.col("h").alias("h2"), F.col("w").alias("w2"))
    both = salted_join(later, earlier, "other", "unit", pairs.groupBy("other").count()).select("unit", "h", "w", "h2", "w2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = [(arrays(c, np.int64), np.concatenate(([0], np.cumsum(c.value_lengths().to_numpy(zero_copy_only=False))))) for c in batch.columns[1:]]
            (h, at), (w, _), (h2, at2), (w2, _) = flat
            found = []
            for i in range(batch.num_rows):
                a, b = slice(at[i], at[i + 1]), slice(at2[i], at2[i + 1])
                found.append(np.flatnonzero(common_blocks(h[a].view(np.uint64), w[a], h2[b].view(np.uint64), w2[b], min_words)))
            of = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
            line = np.concatenate(found) if found else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(of), pa.array(line.astype(np.int32))], names=["unit", "line"])

    return both.mapInArrow(trimmed(run), "unit long, line int").groupBy("unit").agg(F.collect_set("line").alias("cut"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """`docs` with common blocks deleted from later documents, and `n_lines_cut`."""
    of, cut = fresh(docs, "_unit"), fresh(docs, "_cut")
    with workspace(docs.sparkSession) as folder:
        cuts = stored(deletions(docs, folder, min_words).select(F.col("unit").alias(of), F.col("cut").alias(cut)), "cuts")
    out = docs.join(cuts.hint("merge"), unit() == F.col(of), "left")
    kept = F.array_join(F.filter(F.split(F.col("text").cast("string"), "\n"), lambda line, i: ~F.array_contains(cut, i)), "\n")
    out = out.withColumn("text", F.when(F.col(cut).isNull(), F.col("text")).otherwise(kept))
    out = out.withColumn("n_lines_cut", F.coalesce(F.size(cut), F.lit(0))).drop(of, cut)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_lines_cut") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's deduplicated text, and how many lines went."""
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_chars", F.col("n_lines_cut").cast("long").alias("n_lines_cut"))
