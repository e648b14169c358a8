"""N-gram Jaccard join over parity sketches.

A document's shingles are dealt into blocks by hash, and a block keeps, for
each shingle code, whether it occurred an odd number of times; this parity
vector is held as the XOR of its codes. Two documents' sketches differ in at
most as many bits, so in at most as many blocks, as their sets have elements
apart. Documents that link at similarity t differ in at most
d = (1 - t) / t * size elements. So at most d of their blocks differ, and
documents of a size band meet on equal blocks.

All blocks have one order, rare shingles first, then those that hold many, empty
blocks last, and a document emits the first d + 1 of its own. Of the blocks that
two linking documents have in common, the first in that order is among those of
both, as at most d others can come before it. Passages that many documents share
stand last, so they make strangers meet only where there is hardly anything else.
A block holds several shingles, so strangers meet only where they share all of
them: keys of single shingles would meet more often the more documents there are.
`Frequent` only sets the order; a wrong count costs time and no pair.

Where many documents meet, they are verified exactly against one of them, their
pivot, not pair by pair. Components are contracted after each round, and the
next one takes a pivot in the largest component of a key for the documents of
its other components. What is in different components of a key after that is
compared in chunks by sketches, and pairs which these let link are verified.

Equal sets are one vertex throughout. Defined results: null, empty and blank
texts have no shingles and link with nothing; shorter texts than a shingle are
one shingle; repeated ids are one vertex; a null id has a null component; an
empty table gives an empty result; columns besides doc_id and text are carried
along by `deduplicate` and never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, salted_join, small_batches, stored, table, trimmed, workspace

#: Ids or block keys known to be at most this many are broadcast (some 40 bytes each); more are joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: Documents on one key of which all pairs are looked at; of more, pivots find the links, then chunks of documents.
FEW = 16
#: Further rounds of pivots at most, after which what is still in different components is compared in chunks; documents of a chunk.
STARS, CHUNK = 1, 2048
#: Frequent shingles that are known to all tasks (9 bytes each); they only order the blocks, so that the bound costs no pair.
FREQUENT = 1 << 18
#: Shingles of a stretch of documents that are counted at once, least count in it, and most that are passed on from it.
STRETCH_CODES, OFTEN, STRETCH_SHINGLES = 1 << 21, 4, 1 << 12
#: Shingles of a block on average, where that leaves twice as many blocks as a document has to emit.
HELD = 3
#: Width of a size band: its largest size over its smallest.
BAND = 1.5
U = np.uint64
RADIX, RADIX_INVERSE = U(0x9E3779B97F4A7C15), U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
CODES = np.random.Generator(np.random.PCG64(20)).integers(1, 1 << 63, 256, dtype=np.uint64)
CODES[65:91] = CODES[97:123]  # A-Z count as a-z
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
_powers = {RADIX: np.ones(1, np.uint64), RADIX_INVERSE: np.ones(1, np.uint64)}


def powers(base: np.uint64, n: int) -> np.ndarray:
    if len(_powers[base]) < n:
        row = np.full(max(n, 2 * len(_powers[base])), base, np.uint64)
        row[0] = 1
        _powers[base] = np.multiply.accumulate(row)
    return _powers[base][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit codes of the word n-grams of `text`."""
    data = np.frombuffer((text or "").encode("utf-8"), np.uint8)
    edge = np.diff(np.concatenate(([True], BLANK[data], [True])).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return np.empty(0, np.uint64)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(CODES[data] * powers(RADIX, len(data)), out=total[1:])
    word = mixed((total[end] - total[start]) * powers(RADIX_INVERSE, len(data))[start] + (end - start).astype(np.uint64))
    n = min(words, len(word))
    out = np.full(len(word) - n + 1, U(n), np.uint64)
    for i in range(n):
        out = out * U(0xD6E8FEB86659FD93) + word[i : len(word) - n + 1 + i]
    return np.unique(mixed(out))


@dataclass(frozen=True)
class Rule:
    """Documents link when den * intersection >= num * union of their `words`-word shingles."""

    words: int = 5
    num: int = 80
    den: int = 100
    #: Least bits of a sketch; it has at least as many as its set has elements.
    bits: int = 2048
    #: A set is cut into slices of at most about twice as many codes when intersections are counted.
    slice: int = 1024

    def apart(self, size: int) -> int:
        """Most elements by which a set of this size or larger can differ from a smaller or equal partner of at least this size."""
        return (self.den - self.num) * size // self.num

    def slices(self, size: int) -> int:
        """Into how many slices the codes of a set are cut."""
        return 1 << len(f"{size // self.slice:b}") - 1

    def bands(self, most: int) -> list[int]:
        """First sizes of the bands, up to beyond `most`."""
        out = [1]
        while out[-1] <= most:
            out.append(max(out[-1] + 1, int(out[-1] * BAND)))
        return out

    def keys(self, codes: np.ndarray, frequent: Frequent) -> np.ndarray:
        """Keys of the blocks on which the set meets its partners."""
        n, out = len(codes), []
        if not n:
            return codes
        bands = self.bands(n)
        own = len(bands) - 2
        common = frequent.of(codes)
        for band in range(own, -1, -1):
            last = bands[band + 1] - 1
            if self.den * last < self.num * n:
                break  # partners of that size are too small
            d = self.apart(last)
            if not d:
                continue  # only equal sets would link
            blocks = max(2 * (d + 1), -(-last // HELD))
            at = ((codes >> U(20)) % U(blocks)).astype(np.int64)
            order = np.argsort(at, kind="stable")
            at, row, rare = at[order], codes[order], common[order]
            first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
            parity, index, rare = np.bitwise_xor.reduceat(row, first), at[first], np.minimum.reduceat(rare, first)
            key = mixed(parity ^ mixed(U(band << 40) + index.astype(np.uint64)))
            held = np.diff(first, append=n)
            key = key[np.lexsort((key, -held, rare))[: d + 1]]
            if len(key) <= d:  # blocks without elements come last in the order
                empty = np.setdiff1d(np.arange(blocks), index)[: d + 1 - len(key)]
                key = np.concatenate((key, mixed(mixed(U(band << 40) + empty.astype(np.uint64)))))
            out.append(key)
        return np.concatenate(out) if out else np.empty(0, np.uint64)


def _rows(docs: DataFrame) -> DataFrame:
    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


class Frequent:
    """How frequent shingles are, as the bit length of their counts; others count as 0."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        order = np.argsort(codes)
        self.codes, self.levels = codes[order], np.frexp(counts[order].astype(np.float64))[1].astype(np.uint8)

    def of(self, codes: np.ndarray) -> np.ndarray:
        if not len(self.codes):
            return np.zeros(len(codes), np.uint8)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, self.levels[at], np.uint8(0))


def set_digests(docs: DataFrame, rule: Rule) -> DataFrame:
    """One pass over all texts with two kinds of rows: (doc_id, n_shingles, h1, h2), size and a 128-bit digest of each
    document's set; and (code, n), the shingles that many documents of one stretch of the input hold."""
    names = ["doc_id", "n_shingles", "h1", "h2", "code", "n"]

    def often(sets: list[np.ndarray]) -> pa.RecordBatch:
        codes, counts = np.unique(np.concatenate(sets), return_counts=True)
        top = np.flatnonzero(counts >= OFTEN)
        top = top[np.argsort(-counts[top], kind="stable")[:STRETCH_SHINGLES]]
        nothing = pa.nulls(len(top), pa.int64())
        return pa.RecordBatch.from_arrays([nothing] * 4 + [pa.array(codes[top].view(np.int64)), pa.array(counts[top].astype(np.int64))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, size = [], 0
        for batch in batches:
            n, h1, h2 = [], [], []
            for value in batch.column(1):
                codes = shingles(value.as_py(), rule.words)
                n.append(len(codes))
                h1.append(int(np.bitwise_xor.reduce(codes, initial=0).view(np.int64)) if len(codes) else 0)
                h2.append(int(mixed(codes ^ U(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).view(np.int64)) if len(codes) else 0)
                sets.append(codes)
                size += len(codes)
                if size > STRETCH_CODES:
                    yield often(sets)
                    sets, size = [], 0
            nothing = pa.nulls(len(n), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n, h1, h2)), nothing, nothing], names=names)
        if sets:
            yield often(sets)

    return _rows(docs).mapInArrow(trimmed(run), ", ".join(f"{x} long" for x in names))


def frequent_shingles(seen: DataFrame) -> Frequent:
    """The most frequent shingles of all documents, at most `FREQUENT` of them, from the (code, n) rows of `set_digests`."""
    top = seen.where("code is not null").groupBy("code").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "code").limit(FREQUENT).toArrow()
    return Frequent(top["code"].to_numpy().view(np.uint64), top["n"].to_numpy())


def block_keys(docs: DataFrame, rule: Rule, frequent: Frequent) -> DataFrame:
    """(key, doc) for each block on which a document meets its partners."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids, size = [], [], 0
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                got = rule.keys(shingles(value.as_py(), rule.words), shared.value).view(np.int64)
                keys.append(got)
                ids.append(np.full(len(got), doc, np.int64))
                size += len(got)
                if size > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(ids))], names=["key", "doc"])
                    keys, ids, size = [], [], 0
            if size:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(ids))], names=["key", "doc"])

    return _rows(docs).mapInArrow(trimmed(run), "key long, doc long")


def sketch(codes: np.ndarray, least: int) -> np.ndarray:
    """Parities of the codes' bit positions: two sketches differ in at most as many bits as the sets have elements apart."""
    bits = max(least, 1 << (len(codes) - 1).bit_length())
    counts = np.bincount(((codes >> U(20)) & U(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.uint64)


def folded(rows: list[bytes]) -> np.ndarray:
    """Sketches as one matrix; longer ones are folded to the length of the shortest, which keeps the bound."""
    width = min(map(len, rows)) // 8
    return np.stack([np.bitwise_xor.reduce(np.frombuffer(r, U).reshape(-1, width), axis=0) for r in rows])


def marked_sets(docs: DataFrame, rule: Rule) -> DataFrame:
    """(doc, size, sketch, slices, slice, codes): each document's parity sketch, in a row without codes, and its sorted codes
    in slices by their first bits, cut as its partners may need them. Sketch and codes are bytes."""
    names = ["doc", "size", "sketch", "slices", "slice", "codes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in names]
            held = 0
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                codes = shingles(value.as_py(), rule.words)
                rows = [(doc, len(codes), sketch(codes, rule.bits).tobytes(), 0, 0, None)]
                for n in sorted({rule.slices(len(codes)), rule.slices(-(-rule.num * len(codes) // rule.den))}):
                    at = np.searchsorted(codes, np.arange(1, n, dtype=np.uint64) << U(64 - n.bit_length() + 1)) if n > 1 else []
                    rows += [(doc, len(codes), None, n, i, x.tobytes()) for i, x in enumerate(np.split(codes, at))]
                for column, values in zip(out, zip(*rows, strict=True), strict=True):
                    column += values
                held += len(codes)
                if held > 1_000_000:
                    yield _marked(out, names)
                    out, held = [[] for _ in names], 0
            if out[0]:
                yield _marked(out, names)

    return _rows(docs).mapInArrow(trimmed(run), "doc long, size long, sketch binary, slices int, slice int, codes binary")


def _marked(columns: list[list], names: list[str]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def near(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, rule: Rule) -> np.ndarray:
    """Whether the Hamming distance of sketches `x` and `y` lets sets of sizes `n` and `m` link."""
    apart = np.maximum(np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64), np.abs(n - m))
    return (rule.den + rule.num) * apart <= (rule.den - rule.num) * (n + m)


def sifted(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """(pivot, doc, size2, size): the pairs that the Hamming distance of their sketches lets link."""
    marks = sets.where("sketch is not null").select("doc", "size", "sketch")
    other = marks.select(F.col("doc").alias("pivot"), F.col("size").alias("size2"), F.col("sketch").alias("sketch2"))
    both = salted_join(pairs.join(marks, "doc"), other, "pivot", "doc", pairs.groupBy("pivot").count()).select("pivot", "doc", "size2", "size", "sketch2", "sketch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            keep = np.zeros(len(x), bool)
            widths = np.array([(len(a), len(b)) for a, b in zip(x, y, strict=True)]).reshape(-1, 2)
            for w in np.unique(widths, axis=0):
                at = np.flatnonzero((widths == w).all(axis=1))
                rows = folded([x[i] for i in at] + [y[i] for i in at])
                keep[at] = near(rows[: len(at)], rows[len(at) :], batch.column(2).to_numpy()[at], batch.column(3).to_numpy()[at], rule)
            yield batch.select(["pivot", "doc", "size2", "size"]).filter(pa.array(keep))

    return both.mapInArrow(trimmed(run), "pivot long, doc long, size2 long, size long")


def linked(pairs: DataFrame, sets: DataFrame, rule: Rule, folder: str) -> DataFrame:
    """(a, b): the pairs (pivot, doc, size2, size) that link, by the exact sizes of their sets' intersection; reads what it stores in `folder`."""
    named = stored(pairs.select(F.explode(F.array("pivot", "doc")).alias("doc")).distinct(), "named", folder)
    codes = sets.where("codes is not null").join(F.broadcast(named) if named.count() <= BROADCAST_ROWS else named, "doc", "left_semi")
    smaller = F.least("size", "size2")
    slices = F.pow(F.lit(2), F.length(F.bin(F.floor(smaller / rule.slice))) - 1).cast("int")
    cut = pairs.withColumn("slices", slices).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    one = cut.join(codes.select("doc", "slices", "slice", "codes"), ["doc", "slices", "slice"])
    other = codes.select(F.struct(F.col("doc").alias("pivot"), "slices", "slice").alias("of"), F.col("codes").alias("pivot_codes"))
    of = F.struct("pivot", "slices", "slice").alias("of")
    both = salted_join(one.select("*", of), other, "of", "doc", cut.groupBy(of).count()).select("pivot", "doc", "size2", "size", "pivot_codes", "codes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            common = [len(np.intersect1d(np.frombuffer(x.as_py(), U), np.frombuffer(y.as_py(), U), assume_unique=True)) for x, y in zip(batch.column(4), batch.column(5), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(common, pa.int64())], names=["pivot", "doc", "size2", "size", "common"])

    counted = both.mapInArrow(trimmed(run), "pivot long, doc long, size2 long, size long, common long").groupBy("pivot", "doc", "size2", "size").agg(F.sum("common").alias("common"))
    return counted.where(rule.den * F.col("common") >= rule.num * (F.col("size") + F.col("size2") - F.col("common"))).select(F.col("pivot").alias("a"), F.col("doc").alias("b"))


def met(docs: DataFrame, rule: Rule, frequent: Frequent, folder: str) -> tuple[DataFrame, DataFrame]:
    """Pairs (pivot, doc) of the documents that share a key, and the keys (key, doc) of more than `FEW` documents.

    Of a key with up to `FEW` documents all pairs are made; with more, each
    with a pivot, the document that meets others most often: it lies near the
    middle of its group. The result reads what this stores in `folder`.
    """
    keys = block_keys(docs, rule, frequent)
    groups = stored(keys.groupBy("key").agg(F.count("*").alias("n"), F.min("doc").alias("pivot"), F.max("doc").alias("doc")).where("n > 1"), "groups", folder)
    more = groups.where("n > 2").select("key", "n")
    members = keys.join(F.broadcast(more), "key") if more.count() <= BROADCAST_ROWS else salted_join(keys, more, "key", "doc", more.withColumnRenamed("n", "count"))
    members = stored(members.select("key", "doc", "n"), "members", folder)
    lists = members.where(f"n <= {FEW}").groupBy("key").agg(F.collect_list("doc").alias("of"))
    first = lists.select("of", F.explode("of").alias("pivot"))
    every = first.select("pivot", F.explode(F.filter("of", lambda y: y > F.col("pivot"))).alias("doc"))
    large = members.where(f"n > {FEW}")
    meetings = large.groupBy("doc").agg(F.sum("n").alias("meetings"))
    pivots = large.join(meetings, "doc").groupBy("key").agg(F.max_by("doc", F.struct("meetings", -F.col("doc"))).alias("pivot"))
    star = salted_join(large, pivots, "key", "doc", large.groupBy("key").count()).where("doc <> pivot").select("pivot", "doc")
    pairs = groups.where("n = 2 and pivot < doc").select("pivot", "doc").unionAll(every).unionAll(star)
    return stored(pairs.distinct(), "pairs", folder), stored(large.select("key", "doc"), "large", folder)


def apart(large: DataFrame, labels: DataFrame, folder: str) -> DataFrame:
    """(key, doc, of): the keys whose documents lie in several components `of`."""
    named = stored(large.join(labels, F.col("doc") == F.col("id"), "left").select("key", "doc", F.coalesce("component_id", "doc").alias("of")), "named", folder)
    several = named.groupBy("key").agg(F.min("of").alias("x"), F.max("of").alias("y"), F.count("*").alias("count")).where("x < y").select("key", "count")
    return stored(salted_join(named, several.select("key"), "key", "doc", several), "apart", folder)


def stars(rows: DataFrame, turn: int) -> DataFrame:
    """Pairs (pivot, doc) of each key's documents outside of its largest component with a document of that component."""
    parts = rows.groupBy("key", "of").agg(F.count("*").alias("n"), F.min_by("doc", F.xxhash64("doc", F.lit(turn))).alias("pivot"))
    pivots = parts.groupBy("key").agg(F.max_by(F.struct("of", "pivot"), F.struct("n", "of")).alias("x")).select("key", F.col("x.of").alias("largest"), F.col("x.pivot").alias("pivot"))
    return salted_join(rows, pivots, "key", "doc", rows.groupBy("key").count()).where("of <> largest").select("pivot", "doc").distinct()


def across(rows: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """Pairs (pivot, doc, size2, size) of documents of one key in different components whose sketches let them link.

    The documents of a key are dealt into chunks, and a task compares the
    sketches of two chunks, so no task holds more than two of them.
    """
    marks = sets.where("sketch is not null").select("doc", "size", "sketch")
    chunks = rows.groupBy("key").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"), F.count("*").alias("count"))
    dealt = salted_join(rows, chunks.select("key", "chunks"), "key", "doc", chunks.select("key", "count")).join(marks, "doc").withColumn("own", F.pmod(F.xxhash64("doc"), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("key", F.least("own", "with").alias("x"), F.greatest("own", "with").alias("y"), "own", "doc", "of", "size", "sketch")

    def compare(group: pa.Table) -> pa.Table:
        x, y = group["x"][0].as_py(), group["y"][0].as_py()
        own, ids, of, size = (group[c].to_numpy() for c in ("own", "doc", "of", "size"))
        marks = folded(group["sketch"].to_pylist())
        left, right = np.flatnonzero(own == x), np.flatnonzero(own == y)
        found = [np.empty((0, 2), np.int64)]
        for part in np.array_split(left, max(1, len(left) * len(right) * marks.shape[1] // 2_000_000)):
            hit = near(marks[part][:, None], marks[right][None], size[part][:, None], size[right][None], rule) & (of[part][:, None] != of[right][None])
            i, j = np.nonzero(hit)
            found.append(np.stack((part[i], right[j]), axis=1))
        at = np.concatenate(found)
        at = at[ids[at[:, 0]] < ids[at[:, 1]]] if x == y else at
        at = np.where((ids[at[:, 0]] < ids[at[:, 1]])[:, None], at, at[:, ::-1])
        return pa.table({"pivot": ids[at[:, 0]], "doc": ids[at[:, 1]], "size2": size[at[:, 0]], "size": size[at[:, 1]]})

    return dealt.groupBy("key", "x", "y").applyInArrow(compare, "pivot long, doc long, size2 long, size long").distinct()


def only(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """`docs` whose doc_id is (left_semi) or isn't (left_anti) in `ids(doc_id)`."""
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, "doc_id", how)


def links(docs: DataFrame, seen: DataFrame, rule: Rule) -> DataFrame:
    """Links (a, b) that connect exactly the documents which links of `rule`
    connect, among one document for each different set. `seen` is stored rows of `set_digests`."""
    digests = seen.where("code is null")
    with workspace(docs.sparkSession) as folder:
        representatives = digests.where("n_shingles > 0").groupBy("n_shingles", "h1", "h2").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
        copies = stored(digests.select("doc_id").distinct().join(representatives, "doc_id", "left_anti"), "copies", folder)
        docs = docs.where(F.col("doc_id").isNotNull())
        docs = only(docs.dropDuplicates(["doc_id"]) if has_repeats(digests) else docs, copies, "left_anti")
        pairs, large = met(docs, rule, frequent_shingles(seen), folder)
        named = stored(pairs.select(F.explode(F.array("pivot", "doc")).alias("doc_id")).distinct(), "named", folder)
        sets = stored(marked_sets(only(docs, named, "left_semi"), rule), "sets", folder)
        new = stored(linked(stored(sifted(pairs, sets, rule), "sifted", folder), sets, rule, folder), "links")
        edges, turn = new, 0
        while True:
            labels = components(edges)
            large = apart(large, labels, folder)
            edges = stored(labels.select(F.col("id").alias("a"), F.col("component_id").alias("b")), "links")  # one for each document that links
            if large.isEmpty():
                return edges
            last = turn == STARS or new.isEmpty()
            if last:
                pairs = across(large.select("key", "doc", "of"), sets, rule)
            else:
                pairs = sifted(stored(stars(large, turn), "stars", folder), sets, rule)
            pairs = stored(pairs, "sifted", folder)
            new = stored(linked(pairs, sets, rule, folder), "links")
            edges = edges.unionAll(new)
            if last:
                return edges
            turn += 1


def has_repeats(digests: DataFrame) -> bool:
    n, ids = digests.agg(F.count("doc_id"), F.count_distinct("doc_id")).first()
    return n != ids


def classes(docs: DataFrame, rule: Rule) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    seen = stored(set_digests(docs, rule), "digests")
    labels = components(links(docs, seen, rule))
    digests = seen.where("code is null").select("doc_id", "n_shingles", "h1", "h2")
    first = digests.where("n_shingles > 0").groupBy("n_shingles", "h1", "h2").agg(F.min("doc_id").alias("first"))
    named = first.join(labels, F.col("first") == F.col("id"), "left").select("n_shingles", "h1", "h2", F.coalesce("component_id", "first").alias("component_id"))
    out = digests.join(named, ["n_shingles", "h1", "h2"], "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def deduplicate(docs: DataFrame, rule: Rule | None = None) -> DataFrame:
    """`docs` without the documents that have a smaller id in their class."""
    rule = rule or Rule()
    dropped = stored(classes(docs, rule).where("doc_id <> component_id").select("doc_id").distinct(), "dropped")
    return only(docs, dropped, "left_anti")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and class of every document at 3 words and similarity 0.9."""
    return classes(table(spark, sf_dir, "documents"), Rule(words=3, num=90))
