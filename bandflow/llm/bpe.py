"""BPE encoding and decoding with a public byte-level vocabulary.

`BytePairCodec` merges symbols of a doubly linked list in the order of a
priority queue of merge ranks, skips stale queue entries, and decodes by
concatenating the vocabulary's byte strings. `encode` and `decode` are the
general Spark operators; `op8_bpe` derives digests of their results.

Defined results: null or empty text has no tokens and decodes to the empty
text; one very long word is merged in n log n steps and not cached; repeated
rows give repeated results; an empty table gives an empty result; other columns
of the input are never read. A vocabulary file that asks for another
pre-tokenisation raises ValueError.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keeping, small_batches, table, trimmed

# The published pre-tokenisation pattern of byte-level BPE.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces longer than this are encoded each time; shorter ones are remembered.
REMEMBERED_CHARS = 48
#: Pieces kept in each of the two generations of the memory.
GENERATION = 250_000


def default_vocabulary() -> str:
    """Path of the 50k byte-level vocabulary installed with the tokenizer files."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    letters, spare = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in letters:
            letters[b], spare = chr(spare), spare + 1
    return [letters[b] for b in range(256)]


class BytePairCodec:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before = spec.get("pre_tokenizer") or {}
        if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or spec.get("normalizer"):
            raise ValueError(f"{path} asks for another pre-tokenisation than byte level without a prefix space")
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.of_byte = [vocab[c] for c in letters]
        self.strings: dict[int, bytes] = {i: bytes(byte_of[c] for c in s) for s, i in vocab.items()}
        #: A pair of ids as one integer -> its rank; and by rank the pair and what it becomes.
        self.ranks: dict[int, int] = {}
        self.pair_at: list[int] = []
        self.merged_at: list[int] = []
        for rank, merge in enumerate(merges):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.pair_at.append(vocab[left] << 32 | vocab[right])
            self.merged_at.append(vocab[left + right])
            self.ranks[self.pair_at[-1]] = rank
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.strings.update((i, s.encode()) for s, i in self.special.items())
        by_length = sorted(self.special, key=len, reverse=True)
        self.split_special = regex.compile("|".join(map(regex.escape, by_length))) if by_length else None
        self.find_pieces = regex.compile(PIECES).findall
        self.decimals: dict[int, str] = {i: str(i) for i in self.strings}
        #: Array type of ids. A remembered piece is kept as its packed ids only, some 170 bytes with its key and place.
        self.packed = "H" if max(self.strings) < 1 << 16 else "I"
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece: repeatedly join the adjacent pair of lowest rank, leftmost first."""
        ids = [self.of_byte[b] for b in piece]
        n, rank_of, pair_at = len(ids), self.ranks.get, self.pair_at
        if n < 2:
            return ids
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        # A queue entry is the rank with the left symbol's position below it.
        queue = [r << 32 | i for i, r in enumerate([rank_of(x << 32 | y) for x, y in zip(ids, ids[1:], strict=False)]) if r is not None]
        heapify(queue)
        while queue:
            entry = heappop(queue)
            rank, i = entry >> 32, entry & 0xFFFFFFFF
            j = after[i]
            if j < 0 or ids[i] << 32 | ids[j] != pair_at[rank]:
                continue  # stale: a neighbour was merged since
            ids[i] = merged = self.merged_at[rank]
            ids[j] = -1
            k = after[i] = after[j]
            after[j] = -1
            if k >= 0:
                before[k] = i
                r = rank_of(merged << 32 | ids[k])
                if r is not None:
                    heappush(queue, r << 32 | i)
            h = before[i]
            if h >= 0:
                r = rank_of(ids[h] << 32 | merged)
                if r is not None:
                    heappush(queue, r << 32 | h)
        return [x for x in ids if x >= 0]

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.strings.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", errors="replace")

    def _result(self, piece: str) -> bytes:
        return array(self.packed, self.merge(piece.encode("utf-8"))).tobytes()

    def _plain(self, text: str) -> list[bytes]:
        found = self.find_pieces(text)
        if len(self.young) >= GENERATION:
            self.old, self.young = self.young, {}
        young, old, long = self.young, self.old, {}
        for piece in set(found).difference(young):
            if len(piece) <= REMEMBERED_CHARS:
                young[piece] = old.get(piece) or self._result(piece)
            else:
                long[piece] = self._result(piece)
        if long:
            return [long.get(piece) or young[piece] for piece in found]
        return list(map(young.__getitem__, found))

    def ids(self, text: str) -> array:
        """The ids of `text`."""
        if not any(s in text for s in self.special):
            return array(self.packed, b"".join(self._plain(text)))
        out, at = [], 0
        for m in self.split_special.finditer(text):
            out += self._plain(text[at : m.start()])
            out.append(array(self.packed, [self.special[m[0]]]).tobytes())
            at = m.end()
        return array(self.packed, b"".join(out + self._plain(text[at:])))

    def encode(self, text: str) -> list[int]:
        return self.ids(text).tolist()


def codec(path: str) -> BytePairCodec:
    """One codec for each worker process, until a task of something else runs there."""
    return keeping(f"bpe {path}", lambda: BytePairCodec(path))


def encode(docs: DataFrame, path: str | None = None, text: str = "text", out: str = "ids") -> DataFrame:
    """`docs` with the array column `out` of token ids of column `text`."""
    path = path or default_vocabulary()

    @F.pandas_udf("array<int>")
    def ids_of(texts):
        return texts.map(lambda t: codec(path).encode(t or ""))

    return docs.withColumn(out, ids_of(F.col(text)))


def decode(docs: DataFrame, path: str | None = None, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """`docs` with the text column `out` that the array column `ids` stands for (null: empty)."""
    path = path or default_vocabulary()

    @F.pandas_udf("string")
    def text_of(rows):
        return rows.map(lambda r: "" if r is None else codec(path).decode(list(r)))

    return docs.withColumn(out, text_of(F.col(ids)))


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document.

    The encoded ids and the decoded text of a document live only inside one
    task, so that neither is shuffled or kept beside the result.
    """
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            counts, of_ids, of_text = [], [], []
            for value in batch.column(1):
                ids = c.encode(value.as_py() or "")
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(",".join(map(c.decimals.__getitem__, ids)).encode()).hexdigest())
                of_text.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(trimmed(run, keeps=True), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded text of every whole document."""
    return digests(table(spark, sf_dir, "documents"))
