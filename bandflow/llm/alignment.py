"""Alignment of two tokenizers' tokens, with each distinct segment tokenised once.

Texts are split before runs of white space whose first character is one that no
piece of either vocabulary holds behind another (`split_characters` verifies
it), so neither tokenizer merges across a split and the tokens of a text are
those of its segments. Documents become numbers into the distinct segments of
their chunk. The chunks' segments meet in buckets of equal hash, where each
distinct one is tokenised and aligned once; alignments are joined back by the
chunks that hold them and composed into the documents.

How often an id pair is linked in the corpus follows from the segments' counts.
Up to `PAIRS_AT_HAND` distinct pairs, their counts go to the tasks as a
broadcast; more are joined by shuffle.

Defined results: `align` gives null, empty and unfaithful texts (those whose
joined token bytes differ from a blank and the text under either vocabulary)
no tokens, zeros and an empty text of groups; other documents' counts don't
see them. Repeated documents count as often as they occur; very long texts are
split in parts and make a chunk of their own; an empty table gives an empty
result; columns besides the two named ones are never read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import byte_letters
from .common import small_batches, stored, table, workspace

#: Characters of the texts of a chunk, and of a text that is split at once.
CHUNK_CHARS, PART_CHARS = 8 << 20, 1 << 20
#: Distinct pairs whose counts are broadcast (17 bytes each).
PAIRS_AT_HAND = 2_000_000
#: Segments that are tokenised in one call, chunks that a row of an alignment names, and places that are packed at once.
CALL_SEGMENTS, ROW_CHUNKS, PACKED_PLACES = 5_000, 1_000, 200_000


def default_vocabularies() -> tuple[str, str]:
    """Paths of the byte-level and of the piece vocabulary installed with the tokenizer files."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Tokenizers:
    """Both tokenizers over segments of a blank and a text."""

    def __init__(self, a_path: str, b_path: str):
        import json
        import os

        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        spec = json.loads(self.a.to_str())
        before = spec.get("pre_tokenizer") or {}
        # Byte-level pre-tokens hold white space only at their beginning.
        if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or spec.get("normalizer"):
            raise ValueError(f"{a_path} may merge across white space")
        byte_of = {c: i for i, c in enumerate(byte_letters())}
        size = max(self.a.get_vocab(with_added_tokens=True).values()) + 1
        self.a_bytes = [b""] * size
        for piece, i in self.a.get_vocab(with_added_tokens=True).items():
            known = all(c in byte_of for c in piece)
            self.a_bytes[i] = bytes(byte_of[c] for c in piece) if known else piece.encode()
        b = self.b
        self.b_bytes = [bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in range(b.get_piece_size())]
        self.blank = b.piece_to_id("▁")
        whole = [b.id_to_piece(i).replace("▁", " ") for i in range(b.get_piece_size()) if not b.is_byte(i) and not b.is_control(i)]
        # A blank may follow blanks in a piece; another split character may only begin one, since B's own blank is taken off.
        self.split_characters = "".join(w for w in " \n\t" if not any(re.search(r"[^ ] " if w == " " else f".{w}", p, re.S) for p in whole))
        if " " not in self.split_characters:
            raise ValueError(f"{b_path} has pieces that go on over a blank")
        w = re.escape(self.split_characters)
        self.other_space = re.compile(rf"[^\S{w}]")
        self.segment = re.compile(rf"[{w}]*[^{w}]+|[{w}]+")
        self.bounds = re.compile(rf"(?<=\S)(?=[{w}])")

    def segments(self, text: str, part: int = PART_CHARS) -> Iterator[list[str]]:
        """The segments of a blank and `text`, in order, in lists from parts of the text."""
        text = f" {text}"
        plain = not self.other_space.search(text)
        at = 0
        while at < len(text):
            end = len(text)
            if end - at > part:
                found = self.bounds.search(text, at + part)
                end = found.start() if found else end
            yield self.segment.findall(text, at, end) if plain else [x for x in self.bounds.split(text[at:end]) if x]
            at = end

    def of_segments(self, segments: list[str]) -> list[tuple[list[int], list[int]]]:
        """Ids of both tokenizers for each segment."""
        a = self.a.encode_batch(segments, add_special_tokens=False)
        # B puts a blank before what it gets: the segment's own one, else one that is taken off again.
        b = self.b.encode([s[1:] if s[0] == " " else s for s in segments], num_threads=1)
        own = [[self.blank] if s == " " else ids if s[0] == " " else ids[1:] if ids[0] == self.blank else [] for s, ids in zip(segments, b, strict=True)]
        return list(zip([x.ids for x in a], own, strict=True))

    def aligned(self, segment: str, a: list[int], b: list[int]) -> tuple[bool, int, str, list[int]]:
        """Whether both ids stand for the segment's bytes; number of groups, the groups as text, and the links as a << 32 | b."""
        a_of, b_of, raw = self.a_bytes, self.b_bytes, segment.encode()
        if b"".join([a_of[i] for i in a]) != raw or b"".join([b_of[i] for i in b]) != raw:
            return False, 0, "", []
        if len(a) == 1 == len(b):
            return True, 1, f"{a[0]}|{b[0]}", [a[0] << 32 | b[0]]
        links, groups, i, j, from_a, from_b = [], [], 0, 0, 0, 0
        a_end, b_end = len(a_of[a[0]]), len(b_of[b[0]])
        while True:
            links.append(a[i] << 32 | b[j])
            together = a_end == b_end
            step_a, step_b = a_end <= b_end, b_end <= a_end
            i, j = i + step_a, j + step_b
            if together:
                groups.append(f"{','.join(map(str, a[from_a:i]))}|{','.join(map(str, b[from_b:j]))}")
                from_a, from_b = i, j
                if i == len(a):
                    return True, len(groups), ";".join(groups), links
            if step_a:
                a_end += len(a_of[a[i]])
            if step_b:
                b_end += len(b_of[b[j]])


@lru_cache(maxsize=2)
def tokenizers(a_path: str, b_path: str) -> Tokenizers:
    """One pair of tokenizers for each worker process."""
    return Tokenizers(a_path, b_path)


CHUNKS = "chunk long, bucket int, doc_ids array<long>, lengths array<long>, codes binary, segments array<string>, places array<int>, counts array<long>"


def packed(codes: np.ndarray) -> bytes:
    """Numbers as compressed planes of bytes, since the high bytes of most are zero."""
    return pa.compress(codes.astype(np.int32).view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)


def unpacked(planes: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int32)
    raw = pa.decompress(planes, decompressed_size=4 * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view(np.int32).ravel()


def chunks(docs: DataFrame, paths: tuple[str, str], chunk_chars: int = CHUNK_CHARS, buckets: int = 64) -> DataFrame:
    """Documents as numbers into the distinct segments of their chunk: a row for each chunk, and one for each of its buckets of segments."""
    kinds = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int64()))
    names = [x.split()[0] for x in CHUNKS.split(", ")]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, chunk = tokenizers(*paths), TaskContext.get().partitionId() << 32
        known, ids, lengths, codes, held = {}, [], [], [], 0

        def rows() -> Iterator[pa.RecordBatch]:
            of = np.concatenate(codes) if codes else np.zeros(0, np.int32)
            yield made([(chunk, None, ids, lengths, packed(of), None, None, None)])
            counts = np.bincount(of, minlength=len(known))
            segments = list(known)
            bucket = np.fromiter((zlib.crc32(s.encode()) % buckets for s in segments), np.int32, len(segments))
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=buckets))
            for begin, end in zip(cuts, cuts[1:], strict=False):
                at = order[begin:end]
                yield made([(chunk, bucket[at[0]], None, None, None, [segments[i] for i in at], at, counts[at])])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text, n = text.as_py() or "", 0
                for part in both.segments(text) if text else ():
                    for s in set(part).difference(known):
                        known[s] = len(known)
                    codes.append(np.fromiter(map(known.__getitem__, part), np.int32, len(part)))
                    n += len(part)
                ids.append(doc_id)
                lengths.append(n)
                held += len(text)
                if held >= chunk_chars:
                    yield from rows()
                    known, ids, lengths, codes, held, chunk = {}, [], [], [], 0, chunk + 1
        if ids:
            yield from rows()

    return small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, CHUNKS)


ALIGNED = "n long, faithful boolean, groups string, links array<long>, chunks array<long>, places array<int>"


def aligned(parts: DataFrame, paths: tuple[str, str], row_chunks: int = ROW_CHUNKS) -> DataFrame:
    """The alignment of each distinct segment with its count and its numbers in the chunks that hold it.

    Equal segments stand in one bucket; they are sorted there, so that one is
    tokenised when its run begins. A segment of more than `row_chunks` chunks
    takes several rows, each with a part of its chunks and of its count.
    """
    kinds = (pa.int64(), pa.bool_(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()))
    names = [x.split()[0] for x in ALIGNED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers(*paths)
        last: tuple | None = None

        def solved(runs: list[list]) -> pa.RecordBatch:
            nonlocal last
            fresh = list(dict.fromkeys(r[0] for r in runs if last is None or r[0] != last[0]))
            known = dict(zip(fresh, both.of_segments(fresh), strict=True)) if fresh else {}
            out = []
            for segment, n, of, places in runs:
                if last is None or last[0] != segment:
                    good, _, groups, links = both.aligned(segment, *known[segment])
                    last = (segment, good, groups, links)
                out.append((n, *last[1:], of, places))
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        runs: list[list] = []
        for batch in batches:
            for segment, chunk, place, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if runs and runs[-1][0] == segment and len(runs[-1][2]) < row_chunks:
                    runs[-1][1] += n
                    runs[-1][2].append(chunk)
                    runs[-1][3].append(place)
                    continue
                if len(runs) >= CALL_SEGMENTS:
                    yield solved(runs)
                    runs = []
                runs.append([segment, n, [chunk], [place]])
        if runs:
            yield solved(runs)

    rows = parts.repartition("bucket").select("chunk", F.inline(F.arrays_zip("segments", "places", "counts"))).select(F.col("segments").alias("segment"), "chunk", F.col("places").alias("place"), F.col("counts").alias("n"))
    return rows.sortWithinPartitions("segment").mapInArrow(run, ALIGNED)


def _by_place(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.select(*columns, F.inline(F.arrays_zip("chunks", "places"))).select(*columns, F.col("chunks").alias("place_chunk"), F.col("places").alias("place"))


def _without_unfaithful(segments: DataFrame, documents: DataFrame) -> DataFrame:
    """`segments` with what they count in documents that hold an unfaithful segment taken off."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        counts: dict[int, int] = {}
        if left.num_rows and right.num_rows:
            lengths = np.array(left["lengths"][0].as_py(), np.int64)
            codes = unpacked(left["codes"][0].as_py(), int(lengths.sum()))
            wrong, ends = np.isin(codes, right["place"].to_numpy()), np.cumsum(lengths)
            for begin, end in zip(ends - lengths, ends, strict=True):
                if wrong[begin:end].any():
                    for c, n in zip(*np.unique(codes[begin:end], return_counts=True), strict=True):
                        counts[int(c)] = counts.get(int(c), 0) + int(n)
        return pa.table({"of_chunk": pa.array([key[0].as_py()] * len(counts), pa.int64()), "of_place": pa.array(list(counts), pa.int32()), "less": pa.array(list(counts.values()), pa.int64())})

    wrong = _by_place(segments.where("not faithful"))
    inside = documents.join(wrong.select("place_chunk").distinct(), F.col("chunk") == F.col("place_chunk"), "left_semi").select("chunk", "lengths", "codes")
    less = inside.groupBy("chunk").cogroup(wrong.groupBy("place_chunk")).applyInArrow(run, "of_chunk long, of_place int, less long")
    places = _by_place(segments, "id").join(less, (F.col("place_chunk") == F.col("of_chunk")) & (F.col("place") == F.col("of_place")))
    less = places.groupBy(F.col("id").alias("_id")).agg(F.sum("less").alias("less"))
    return segments.join(less, F.col("id") == F.col("_id"), "left").withColumn("n", F.col("n") - F.coalesce("less", F.lit(0))).drop("_id", "less")


def pair_counts(segments: DataFrame) -> DataFrame:
    """Links of each id pair in the corpus: pair (a << 32 | b), a, b, count, and whether no pair of its b has more."""
    links = segments.where("n > 0").select("n", F.explode("links").alias("pair"))
    counts = links.groupBy("pair").agg(F.sum("n").alias("count"))
    counts = counts.select("pair", F.shiftright("pair", 32).cast("int").alias("a"), F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("b"), "count")
    most = counts.groupBy("b").agg(F.max("count").alias("most"))  # a row for each id of B at most
    return counts.join(F.broadcast(most), "b").select("pair", "a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


SCORED = "faithful boolean, groups string, n_best long, count_sum long, chunks array<long>, places array<int>"


def scored(segments: DataFrame, pairs: DataFrame, at_hand: int = PAIRS_AT_HAND) -> DataFrame:
    """Segments with n_best and count_sum of their links."""
    if pairs.count() <= at_hand:
        rows = pairs.select("pair", "count", "best").toArrow().sort_by("pair")
        shared = pairs.sparkSession.sparkContext.broadcast((rows["pair"].to_numpy(), rows["count"].to_numpy(), rows["best"].to_numpy().astype(np.int64)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pair, count, best = shared.value
            for batch in batches:
                links = batch.column("links")
                ends = np.cumsum(np.concatenate([[0], links.value_lengths().fill_null(0).to_numpy()]))
                flat = links.flatten().to_numpy()
                # Only segments of unfaithful texts alone have pairs without a count; nothing reads their sums.
                at = np.minimum(np.searchsorted(pair, flat), max(0, len(pair) - 1)) if len(pair) else np.zeros(0, np.int64)
                totals = [np.concatenate([[0], np.cumsum(x[at])]) if len(pair) else np.zeros(len(flat) + 1, np.int64) for x in (best, count)]
                sums = [pa.array(x[ends[1:]] - x[ends[:-1]], pa.int64()) for x in totals]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *sums, batch.column(3), batch.column(4)], names=[x.split()[0] for x in SCORED.split(", ")])

        return segments.select("faithful", "groups", "links", "chunks", "places").mapInArrow(run, SCORED)
    # Segments meet their pairs by shuffle; a pair in very many segments is dealt out by Spark's skew join.
    links = segments.select("id", F.explode("links").alias("pair")).groupBy("id", "pair").agg(F.count("*").alias("times"))
    sums = links.join(pairs, "pair").groupBy(F.col("id").alias("_id")).agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    return segments.join(sums, F.col("id") == F.col("_id"), "left").na.fill({"n_best": 0, "count_sum": 0}).select("faithful", "groups", "n_best", "count_sum", "chunks", "places")


def by_chunk(scored_segments: DataFrame) -> DataFrame:
    """Alignments gathered by the chunks that hold them, many in a row: numbers and scores as bytes, groups as one compressed text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def rows() -> pa.RecordBatch:
            good, best, total = (np.concatenate([np.asarray(b.column(i).to_numpy(zero_copy_only=False), np.int64) for b in held]) for i in (0, 2, 3))
            groups = [g for b in held for g in b.column(1).to_pylist()]
            of = np.repeat(np.arange(len(groups)), np.concatenate([b.column(4).value_lengths().to_numpy() for b in held]))
            chunk, place = (np.concatenate([b.column(i).flatten().to_numpy() for b in held]) for i in (4, 5))
            order = np.argsort(chunk, kind="stable")
            cuts = np.flatnonzero(np.concatenate([[True], np.diff(chunk[order]) != 0, [True]]))
            out = []
            for begin, end in zip(cuts, cuts[1:], strict=False):
                at = order[begin:end]
                rows_at = of[at]
                text = "\n".join([groups[i] for i in rows_at]).encode()
                numbers = np.stack([place[at].astype(np.int64), good[rows_at], best[rows_at], total[rows_at]])
                out.append((chunk[at[0]], len(at), pa.compress(numbers.tobytes(), codec="zstd", asbytes=True), len(text), pa.compress(text, codec="zstd", asbytes=True)))
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary()), strict=True)], names=["place_chunk", "n", "numbers", "n_bytes", "groups"])

        for batch in batches:
            held.append(batch)
            n += len(batch.column(4).flatten())
            if n >= PACKED_PLACES:
                yield rows()
                held, n = [], 0
        if n:
            yield rows()

    return scored_segments.mapInArrow(run, "place_chunk long, n long, numbers binary, n_bytes long, groups binary")


MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def composed(documents: DataFrame, alignments: DataFrame, digest: bool) -> DataFrame:
    """Documents from their chunk's numbers and the alignments of its segments."""
    name = "groups_sha256" if digest else "groups"

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        ids, lengths = (np.array([], object), np.zeros(0, np.int64)) if not left.num_rows else (left["doc_ids"][0].as_py(), np.array(left["lengths"][0].as_py(), np.int64))
        codes = unpacked(left["codes"][0].as_py(), int(lengths.sum())) if left.num_rows else np.zeros(0, np.int32)
        n = int(sum(right["n"].to_pylist()))
        groups, good, best, total = [""] * n, *(np.zeros(n, np.int64) for _ in range(3))
        for k, numbers, size, text in zip(*(right[c].to_pylist() for c in ("n", "numbers", "n_bytes", "groups")), strict=True):
            place, *values = np.frombuffer(pa.decompress(numbers, decompressed_size=32 * k, codec="zstd", asbytes=True), np.int64).reshape(4, k)
            for whole, part in zip((good, best, total), values, strict=True):
                whole[place] = part
            shown = pa.decompress(text, decompressed_size=size, codec="zstd", asbytes=True).decode().split("\n") if size else [""] * k
            for i, g in zip(place.tolist(), shown, strict=True):
                groups[i] = g
        # A group of x and y tokens ends together once, so that it has x + y - 1 links.
        n_groups = np.fromiter((g.count("|") for g in groups), np.int64, n)
        n_both = np.fromiter((g.count(",") for g in groups), np.int64, n) + 2 * n_groups
        n_a = np.fromiter((sum(x.count(",") + 1 for x in [y.partition("|")[0] for y in g.split(";")]) if g else 0 for g in groups), np.int64, n)
        measures = dict(zip(MEASURES, (n_a, n_both - n_a, n_groups, n_both - n_groups, best, total), strict=True))
        ends = np.cumsum(lengths)
        begins = ends - lengths
        sums = lambda x: (lambda c: c[ends] - c[begins])(np.concatenate([[0], np.cumsum(x[codes])]))
        fine = sums(1 - good) == 0
        out = {m: pa.array(np.where(fine, sums(x), 0), pa.int64()) for m, x in measures.items()}
        texts = []
        for begin, end, whole in zip(begins, ends, fine, strict=True):
            text = ";".join([groups[c] for c in codes[begin:end].tolist()]) if whole else ""
            texts.append(hashlib.sha256(text.encode()).hexdigest() if digest and text else text)
        return pa.table({"doc_id": pa.array(list(ids), pa.int64()), **out, name: pa.array(texts, pa.string())})

    schema = "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES) + f", {name} string"
    left = documents.select("chunk", "doc_ids", "lengths", "codes").groupBy("chunk")
    return left.cogroup(alignments.groupBy("place_chunk")).applyInArrow(run, schema)


def align(docs: DataFrame, paths: tuple[str, str] | None = None, digest: bool = False, chunk_chars: int = CHUNK_CHARS, at_hand: int = PAIRS_AT_HAND, row_chunks: int = ROW_CHUNKS) -> tuple[DataFrame, DataFrame]:
    """Documents and id pairs.

    Documents have doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and
    `groups` (`a1,a2|b1;a3|b2,b3`), or with `digest` their SHA-256; pairs are
    those of `pair_counts`. Both are written to the shared folder; all that led
    to them is deleted.
    """
    paths, spark = paths or default_vocabularies(), docs.sparkSession
    with workspace(spark) as folder:
        buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
        held = stored(chunks(docs, paths, chunk_chars, buckets), "chunks", folder)
        documents = held.where("bucket is null")
        known = aligned(held.where("bucket is not null"), paths, row_chunks)
        segments = stored(known.withColumn("id", F.monotonically_increasing_id()), "aligned", folder)
        if not segments.where("not faithful").isEmpty():
            segments = stored(_without_unfaithful(segments, documents), "counted", folder)
        pairs = stored(pair_counts(segments), "pairs")
        return stored(composed(documents, by_chunk(scored(segments, pairs, at_hand)), digest), "composed"), pairs


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups, links and link counts of every whole document under both vocabularies."""
    return align(table(spark, sf_dir, "documents"), digest=True)[0]
