"""Benchmark decontamination: Wu-Manber search for all windows of a benchmark at once.

The patterns are windows of consecutive words of the benchmark items. A block
of items becomes tables over word numbers: `shift` tells for every pair of
neighbouring words how far the search may jump, because no pattern can end
sooner; where it says zero, the last words select a bucket of patterns, and
direct comparison with the words before confirms an occurrence. Documents are
scanned where they are read, so nothing is shuffled.

Benchmarks of any size are searched for in blocks of at most `BLOCK_BYTES` of
text (at least an item), one broadcast at a time; each block is held against
all documents and the findings are joined afterwards.

Defined results: words are maximal runs of a-z, 0-9 and characters beyond
ASCII after A-Z were lower-cased; a null or empty text has no words and is
clean; an item without words has no window, and an item without an id goes by
the empty text; items with equal ids are one item; repeated documents give
repeated rows; very long texts are scanned in parts that overlap by a window;
an empty benchmark finds nothing and an empty table gives an empty result;
columns besides the two named ones are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, stored, table, workspace

#: Words of a window.
WINDOW = 10
#: Text of items that is searched for at once, and text of a document that is split into words at once, in bytes.
BLOCK_BYTES, PART_BYTES = 4 << 20, 4 << 20
#: Neighbouring words that decide a shift, and words that select a bucket.
BLOCK_WORDS, SUFFIX_WORDS = 2, 4

#: Bytes as they count: A-Z in lower case, a-z, digits and all beyond ASCII as they are, anything else a blank.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

FOUND = "doc_id long, text_key binary, n_words long, spans array<long>, items array<string>"
EMPTY = hashlib.sha256(b"").hexdigest()


def words(text: bytes) -> list[bytes]:
    return text.translate(LETTERS).split()


def parts(text: bytes, size: int = PART_BYTES) -> Iterator[list[bytes]]:
    """The words of `text`, split off in parts that end between words."""
    text, at = text.translate(LETTERS), 0
    while at < len(text):
        end = len(text)
        if end - at > size:
            end = text.rfind(b" ", at, at + size)
            if end <= at:
                end = text.find(b" ", at + size)
                end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


class Patterns:
    """Patterns of one length as shift table and buckets."""

    def __init__(self, length: int, base: int):
        self.length, self.base = length, base
        self.block, self.suffix = min(BLOCK_WORDS, length), min(SUFFIX_WORDS, length)
        self.farthest = length - self.block + 1
        self.shift: dict[int, int] = {}
        self.buckets: dict[tuple[int, ...], list[tuple[list[int], int]]] = {}

    def add(self, pattern: list[int], number: int) -> None:
        for end in range(self.block, self.length + 1):
            key = pattern[end - 1] if self.block == 1 else pattern[end - 2] * self.base + pattern[end - 1]
            self.shift[key] = min(self.shift.get(key, self.farthest), self.length - end)
        self.buckets.setdefault(tuple(pattern[-self.suffix :]), []).append((pattern, number))

    def search(self, text: list[int]) -> Iterator[tuple[int, int]]:
        """(last word's place, pattern's number) of every occurrence."""
        at, n, shift, farthest, base, single = self.length - 1, len(text), self.shift.get, self.farthest, self.base, self.block == 1
        while at < n:
            jump = shift(text[at] if single else text[at - 1] * base + text[at], farthest)
            if jump:
                at += jump
                continue
            begin = at - self.length + 1
            for pattern, number in self.buckets.get(tuple(text[at - self.suffix + 1 : at + 1]), ()):
                if text[begin : at + 1] == pattern:
                    yield at, number
            at += 1


class Searcher:
    """All windows of a block of items [(id, text)]."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        known = [(name, words(text)) for name, text in items]
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        for _, w in known:
            for x in w:
                self.vocabulary.setdefault(x, len(self.vocabulary) + 1)
        self.items_of: list[set[str]] = []
        numbers: dict[tuple[int, ...], int] = {}
        self.by_length: dict[int, Patterns] = {}
        for name, w in known:
            ids = [self.vocabulary[x] for x in w]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                pattern = ids[i : i + window]
                key = tuple(pattern)
                if key not in numbers:
                    numbers[key] = len(self.items_of)
                    self.items_of.append(set())
                    self.by_length.setdefault(len(pattern), Patterns(len(pattern), len(self.vocabulary) + 1)).add(pattern, numbers[key])
                self.items_of[numbers[key]].add(name)

    def search(self, text: bytes, size: int = PART_BYTES) -> tuple[int, list[int], set[str]]:
        """Number of words, begins and ends of the stretches of hit words in turn, and the items found."""
        of, n, carried, spans, found = self.vocabulary.get, 0, [], [], set()
        for part in parts(text, size):
            ids = carried + list(map(of, part, repeat(0)))
            base = n - len(carried)
            n += len(part)
            for length, patterns in self.by_length.items():
                for last, number in patterns.search(ids):
                    spans.append((base + last - length + 1, base + last + 1))
                    found.add(number)
            carried = ids[-(self.window - 1) :] if self.window > 1 else []
        return n, merged(spans), set().union(*(self.items_of[i] for i in found))


def merged(spans: list[tuple[int, int]]) -> list[int]:
    """Begins and ends in turn of the stretches that half-open spans cover."""
    out: list[int] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [begin, end]
    return out


_searchers: dict[str, Searcher] = {}


def _searcher(key: str, items, window: int) -> Searcher:
    """One searcher for the block at hand in each worker process."""
    if key not in _searchers:
        _searchers.clear()
        _searchers[key] = Searcher(items.value, window)
    return _searchers[key]


def _scanned(docs: DataFrame, items: list[tuple[str, bytes]], window: int, hits_only: bool) -> DataFrame:
    """Findings of one block of items in all documents, or only in those that have some."""
    shared = docs.sparkSession.sparkContext.broadcast(items)
    digest = hashlib.sha256(repr((window, items)).encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = _searcher(digest, shared, window)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or b""
                n, spans, found = searcher.search(text)
                if spans or not hits_only:
                    rows.append((doc_id, hashlib.sha256(text).digest(), n, spans, sorted(found)))
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string())), strict=True)], names=["doc_id", "text_key", "n_words", "spans", "items"])

    return docs.mapInArrow(run, FOUND)


def _blocks(benchmark: DataFrame, size: int) -> Iterator[list[tuple[str, bytes]]]:
    """The items in blocks of at most `size` bytes, or of one item; the driver holds a block and a partition."""
    block, held = [], 0
    for name, text in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), F.col("text").cast("string").cast("binary")).toLocalIterator():
        text = bytes(text or b"")
        if block and held + len(text) > size:
            yield block
            block, held = [], 0
        block.append((name, text))
        held += len(text)
    yield block


def _joined(first: DataFrame, more: list[DataFrame]) -> DataFrame:
    """Findings of the first block in all documents with those of further blocks."""
    rest = more[0]
    for x in more[1:]:
        rest = rest.unionAll(x)
    # Rows of equal documents have equal findings in a block, so one of each is enough.
    rest = rest.distinct().groupBy(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key")).agg(F.flatten(F.collect_list("spans")).alias("_spans"), F.flatten(F.collect_list("items")).alias("_items"))
    both = first.join(rest, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_key") == F.col("_key")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, c, d = (batch.column(i).to_pylist() for i in (3, 4, 5, 6))
            spans = [merged([*zip(x[::2], x[1::2], strict=True), *zip((y or [])[::2], (y or [])[1::2], strict=True)]) for x, y in zip(a, c, strict=True)]
            items = [sorted({*x, *(y or [])}) for x, y in zip(b, d, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], names=["doc_id", "text_key", "n_words", "spans", "items"])

    return both.select("doc_id", "text_key", "n_words", "spans", "items", "_spans", "_items").mapInArrow(run, FOUND)


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, `spans` (begins and ends in turn, in words, of the stretches hit) and `items` (sorted ids) of every document."""
    docs = small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary"))
    blocks = _blocks(benchmark, block_bytes)
    first = _scanned(docs, next(blocks), window, False)
    block = next(blocks, None)
    if block is None:
        return first.drop("text_key")
    with workspace(docs.sparkSession) as folder:
        more = []
        while block is not None:
            more.append(stored(_scanned(docs, block, window, True), "block", folder))
            block = next(blocks, None)
        return stored(_joined(first, more).drop("text_key"), "findings")


def flagged(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Numbers of words, hit words and items, digest of the items and the decision for every document."""
    s = F.col("spans")
    hit = F.aggregate(F.sequence(F.lit(0), F.size(s) - 2, F.lit(2)), F.lit(0).cast("long"), lambda acc, i: acc + F.get(s, i + 1) - F.get(s, i))
    out = find(docs, benchmark, window).select("doc_id", "n_words", F.when(F.size(s) > 0, hit).otherwise(0).cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document against all windows of ten words of the whole benchmark."""
    return flagged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
