"""Secret scans through nested encodings.

A document is a worklist of layers. The first layer is the text itself; each
decoder (percent escapes, Unicode escapes, base64, compressed bytes) turns a
layer into further ones, which are scanned and decoded in turn until nothing
new appears. A layer that was seen before is not taken up again, so cycles
end. Every layer knows which span of the original text each of its characters
came from, and findings are reported there. Decoded bytes that are neither
UTF-8 nor compressed are scanned byte by byte and, where every second one is
zero, as UTF-16.

Spans are those of whole matches, in code points, end exclusive. Defined
results: null or empty text has no findings; a text without any escape costs
one pass; equal spans of a kind found on several layers are reported once;
repeated rows give repeated results; other columns are carried along by
`find_secrets` and never read.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import codecs
import hashlib
import lzma
import re
import zlib
from bisect import bisect_right
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate, chain
from urllib.parse import unquote_to_bytes

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, small_batches, table

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
#: Tokens in which percent escapes may spell compressed bytes, and how these begin.
TOKEN = re.compile(r"""[^\s"'<>&]++""")
PACKED = re.compile(r"%1f%8b|(?:x|%78)%(?:01|5e|9c|da)|x\^|BZh[1-9]1AY|%fd7zXZ%00", re.IGNORECASE)
UNICODE_ONE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|x([0-9A-Fa-f]{2}))")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Shorter runs can hold a finding only if they are compressed; of the formats only zlib is so short, and begins so.
SHORT = re.compile(r"(?<![A-Za-z0-9+/_-])e[A-P][A-Za-z0-9+/_-]{8,13}(?![A-Za-z0-9+/_-])={0,2}")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Base64 lines over single line breaks; the last line may be short.
WRAPPED = re.compile(r"[A-Za-z0-9+/_-]{16,}+(?:\r?\n[A-Za-z0-9+/_-]++)++={0,2}")
#: Expanded bytes of one layer beyond which it is scanned as a stream, in pieces that end between tokens. Only a
#: single token longer than this is cut, and `complete` turns false.
MAX_EXPANDED = 64 << 20
#: Bytes inflated at once.
STEP = 1 << 20
#: What no finding and no encoded run goes across: a character outside of tokens.
BETWEEN = re.compile(r"[^A-Za-z0-9+/_=%\\\x20\r\n.:\"'-]|(?<=[A-Za-z0-9])\x20(?=[A-Za-z0-9])")

#: Two bytes a character, and the least runs that a finding or an encoded run makes in bytes.
WIDE = "utf-16-le"
NARROW_RUN, WIDE_RUN = re.compile(rb"[\x20-\x7e]{10}"), re.compile(rb"(?:[\x20-\x7e]\x00){10}")

Span = tuple[int, int]


def base_matches(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the plain findings of `text`, by start, then kind as listed."""
    found = []
    if ":" in text or "=" in text:
        lower = text.lower()
        if any(w in lower for w in WORDS):
            found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    found.sort(key=lambda x: (x[0], x[2]))
    return [(s, e, KINDS[k]) for s, e, k in found]


class Layer:
    """Decoded text with the place its characters came from.

    `starts` are offsets where runs begin; run i maps character c to
    origin[i] + (c - starts[i]) if it is `plain`, else to the whole origin
    span.
    """

    def __init__(self, text: str, starts: list[int], origins: list[Span], plain: list[bool]):
        self.text, self.starts, self.origins, self.plain = text, starts, origins, plain

    @classmethod
    def whole(cls, text: str) -> Layer:
        return cls(text, [0], [(0, len(text))], [True])

    @classmethod
    def inside(cls, text: str, span: Span) -> Layer:
        return cls(text, [0], [span], [False])

    @classmethod
    def grouped(cls, text: str, groups: list[Span], encoding: str = "utf-8", skipped: int = 0) -> Layer:
        """Text whose bytes in `encoding`, after `skipped` ones, came in threes from `groups`."""
        if text.isascii() and encoding != WIDE:
            starts = list(range(0, len(text), 3))
            return cls(text, starts, groups[: len(starts)], [False] * len(starts))
        at, origins, last = skipped, [], len(groups) - 1
        for c in text:
            end = at + len(c.encode(encoding))
            origins.append((groups[min(at // 3, last)][0], groups[min((end - 1) // 3, last)][1]))
            at = end
        return cls(text, list(range(len(text))), origins, [False] * len(text))

    def place(self, start: int, end: int) -> Span:
        """Span of the original text that characters start..end came from."""
        i, j = bisect_right(self.starts, start) - 1, bisect_right(self.starts, end - 1) - 1
        first = self.origins[i][0] + (start - self.starts[i] if self.plain[i] else 0)
        last = self.origins[j][0] + (end - self.starts[j]) if self.plain[j] else self.origins[j][1]
        return first, last


def replaced(layer: Layer, pieces: list[tuple[int, int, str]]) -> Layer:
    """`layer` with each (start, end, decoded) put in place; the rest keeps its places."""
    text, out, starts, origins, plain = layer.text, [], [], [], []
    at = size = 0

    def keep(start: int, end: int) -> None:
        nonlocal size
        while start < end:  # a kept run is cut where the layer's own runs meet
            i = bisect_right(layer.starts, start) - 1
            stop = min(end, layer.starts[i + 1] if i + 1 < len(layer.starts) else end)
            starts.append(size)
            origins.append(layer.place(start, stop))
            plain.append(layer.plain[i])
            size += stop - start
            start = stop

    for start, end, decoded in pieces:
        keep(at, start)
        out += (text[at:start], decoded)
        if decoded:
            starts.append(size)
            origins.append(layer.place(start, end))
            plain.append(False)
            size += len(decoded)
        at = end
    keep(at, len(text))
    out.append(text[at:])
    return Layer("".join(out), starts or [0], origins or [(0, 0)], plain or [False])


def readable(data: bytes) -> str | None:
    """`data` as text if it is UTF-8 with hardly any control characters."""
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return None
    odd = sum(c < " " and c not in "\t\n\r" or c == "\x7f" for c in text)
    return text if text and odd * 20 <= len(text) else None


def loose_texts(data: bytes) -> list[tuple[str, str, int]]:
    """(text, encoding, bytes left out before it) of bytes that are no plain UTF-8 text but hold a run that could be a finding:
    each byte as a character, and every second zero taken away."""
    out = []
    if NARROW_RUN.search(data):
        out.append((data.decode("latin-1"), "latin-1", 0))
    if m := WIDE_RUN.search(data):
        # From here on pairs begin with the letter, whichever byte order it is.
        out.append((data[m.start() % 2 :].decode(WIDE, "replace"), WIDE, m.start() % 2))
    return out


def percent_pieces(text: str) -> list[tuple[int, int, str]]:
    """One piece for each character that percent escapes spell; bytes that are no UTF-8 stay escaped."""
    out = []
    for m in PERCENT.finditer(text):
        at = m.start()
        for c in bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "surrogateescape"):
            if "\udc80" <= c <= "\udcff":
                at += 3
                continue
            end = at + 3 * len(c.encode("utf-8"))
            out.append((at, end, c))
            at = end
    return out


def percent_blobs(text: str) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, bytes) of what looks like compressed bytes in percent escapes."""
    for token in TOKEN.finditer(text):
        if "%" in token[0]:
            for m in PACKED.finditer(token[0]):
                yield token.start() + m.start(), token.end(), unquote_to_bytes(token[0][m.start() :])


def unicode_pieces(text: str) -> list[tuple[int, int, str]]:
    """One piece for each character that Unicode escapes spell; surrogates count in pairs."""
    out: list[tuple[int, int, str]] = []
    for m in UNICODE_ONE.finditer(text):
        point = int(m[1] or m[2] or m[3], 16)
        if point >= 0x110000:
            continue
        if 0xDC00 <= point < 0xE000:
            if out and out[-1][1] == m.start() and 0xD800 <= ord(out[-1][2]) < 0xDC00:
                start, _, high = out.pop()
                out.append((start, m.end(), chr(0x10000 + (ord(high) - 0xD800 << 10) + point - 0xDC00)))
            continue
        out.append((m.start(), m.end(), chr(point)))
    return [x for x in out if not 0xD800 <= ord(x[2]) < 0xDC00]


def blobs(text: str) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, bytes) of base64 runs, also over line breaks, and of their parts between slashes."""
    if "\n" in text:
        for m in WRAPPED.finditer(text):
            for start, end in wrapped(m[0]):
                if (data := from_base64(m[0][start:end].replace("\r", "").replace("\n", ""))) is not None:
                    yield m.start() + start, m.start() + end, data
    for m in SHORT.finditer(text):
        if (data := from_base64(m[0], 10)) is not None:
            yield m.start(), m.end(), data
    for m in BASE64.finditer(text):
        if (data := from_base64(m[0])) is not None:
            yield m.start(), m.end(), data
        if "/" in m[0]:
            for part in re.finditer(r"[A-Za-z0-9+_-]{16,}={0,2}", m[0]):
                if part[0] != m[0] and (data := from_base64(part[0])) is not None:
                    yield m.start() + part.start(), m.start() + part.end(), data


def wrapped(run: str) -> list[Span]:
    """Spans of `run` to decode: the whole, and lines of one width with and without a shorter last one."""
    lines = [m.span() for m in re.finditer(r"[^\r\n]+", run)]
    out, i = {(0, len(run)): None}, 0
    while i < len(lines):
        width, j = lines[i][1] - lines[i][0], i + 1
        while j < len(lines) and lines[j][1] - lines[j][0] == width:
            j += 1
        if width >= 16:
            if j > i + 1:
                out[lines[i][0], lines[j - 1][1]] = None
            if j < len(lines) and lines[j][1] - lines[j][0] < width:
                out[lines[i][0], lines[j][1]] = None
        i = j
    return list(out)


def groups_of(run: str, start: int) -> list[Span]:
    """Places of each four base64 characters of `run`, line breaks not counted."""
    if "\n" not in run:
        return [(start + i, start + min(i + 4, len(run))) for i in range(0, len(run), 4)]
    at = [start + i for i, c in enumerate(run) if c not in "\r\n"]
    return [(at[i], at[min(i + 3, len(at) - 1)] + 1) for i in range(0, len(at), 4)]


def from_base64(blob: str, least: int = 16) -> bytes | None:
    core = blob.rstrip("=")
    if len(core) % 4 == 1 or len(core) < least:
        return None
    alphabet = core.replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(alphabet + "=" * (-len(core) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


BROKEN = (zlib.error, OSError, lzma.LZMAError, EOFError, ValueError)
MAGIC = ((b"\x1f\x8b", lambda: zlib.decompressobj(31)), (b"x", zlib.decompressobj), (b"BZh", bz2.BZ2Decompressor), (b"\xfd7zXZ\x00", lzma.LZMADecompressor))


class Inflated:
    """Decompressed pieces of compressed `parts`, member by member; `whole` tells in the end whether that was all."""

    def __init__(self, parts: Iterable[bytes]):
        self.parts, self.whole = iter(parts), False

    def __iter__(self) -> Iterator[bytes]:
        data, machine = next(self.parts, b""), None
        while data is not None:
            if machine is None:
                while len(data) < 6 and (more := next(self.parts, None)) is not None:
                    data += more
                make = next((make for magic, make in MAGIC if data.startswith(magic)), None)
                if make is None:
                    self.whole = not data.strip(b"\0")  # padding at most
                    return
                machine = make()
            try:
                out = machine.decompress(data, STEP)
            except BROKEN:
                return
            if out:
                yield out
            if machine.eof:
                data, machine = machine.unused_data or next(self.parts, None), None
                if data is None:
                    self.whole = True
            else:
                data = getattr(machine, "unconsumed_tail", b"")
                if not data and not (len(out) == STEP if hasattr(machine, "unconsumed_tail") else not machine.needs_input):
                    data = next(self.parts, None)


def scan_stream(parts: Iterator[bytes], span: Span, found: set[tuple[int, int, str]]) -> bool:
    """Scans inflated `parts` without holding them; whether all was seen."""
    head = next(parts, b"")
    if readable(head[: STEP // 2].decode("utf-8", "ignore").encode()) is None or any(head.startswith(m) for m, _ in MAGIC if m != b"x"):
        taken: list[bytes] = [head]

        def rest() -> Iterator[bytes]:
            for part in parts:
                if taken:
                    taken.append(part)
                yield part

        inner = Inflated(chain([head], rest()))
        first = next(pieces := iter(inner), None)
        if first is not None:
            taken.clear()
            return scan_stream(chain([first], pieces), span, found) and inner.whole
        head, parts = b"".join(taken), parts
    # What is no text is scanned as if it were: the characters of findings are the same bytes in UTF-8 and in the older codes.
    wide = WIDE_RUN.search(head)
    decoder, held, whole = codecs.getincrementaldecoder(WIDE if wide else "utf-8")("replace"), "", True
    head = head[wide.start() % 2 :] if wide else head

    def look(text: str) -> None:
        nonlocal whole
        whole &= explore(Layer.inside(text, span), found)

    for part in chain([head], parts, [b""]):
        held += decoder.decode(part, final=not part)
        if len(held) < 8 * STEP and part:
            continue
        tail = held[-STEP:]
        cut = max((m.end() for m in BETWEEN.finditer(tail)), default=0)
        cut = cut or max((m.end() for m in re.finditer(r"(?<![A-Za-z0-9+/_=-])\r?\n", tail)), default=0)
        if cut and part:
            at = len(held) - len(tail) + cut
            look(held[:at])
            held = held[at:]
        elif part and len(held) > MAX_EXPANDED:
            look(held)
            held, whole = held[-4096:], False
    if held:
        look(held)
    return whole


def settled(tried: list[tuple[int, int, bool | None]]) -> bool:
    """Whether each run that was opened in part lies in one that was opened whole: a part of it, cut off."""
    good = sorted((s, e) for s, e, whole in tried if whole)
    ends = list(accumulate((e for _, e in good), max))
    return all(whole is not False or (i := bisect_right(good, (s, len(good) and ends[-1]))) > 0 and ends[i - 1] >= e for s, e, whole in tried)


def explore(first: Layer, found: set[tuple[int, int, str]]) -> bool:
    """Adds the findings of a layer and of all below it; whether every layer was opened whole."""
    complete = True
    seen: set = set()
    work: deque[Layer] = deque()

    def push(layer: Layer) -> None:
        key = (layer.text, layer.origins[0], layer.origins[-1])
        if key not in seen:
            seen.add(key)
            work.append(layer)

    def opened(data: bytes, span: Span, groups: Callable[[], list[Span]] | None = None) -> bool | None:
        """Whether all of `data` was seen; None if it is not compressed and holds no run that could be a finding. `groups` are the places of its threes of bytes."""
        known, whole = None, True
        while True:
            plain = readable(data)
            if plain is not None:
                push(Layer.inside(plain, span) if groups is None or known is not None else Layer.grouped(plain, groups()))
                return whole
            stream = Inflated([data])
            pieces, held, size = iter(stream), [], 0
            for piece in pieces:
                held.append(piece)
                size += len(piece)
                if size > MAX_EXPANDED:
                    return scan_stream(chain(held, pieces), span, found) and stream.whole and whole
            if not held:
                loose = loose_texts(data)
                for text, encoding, skipped in loose:
                    push(Layer.inside(text, span) if groups is None or known is not None else Layer.grouped(text, groups(), encoding, skipped))
                return whole if loose else known
            whole &= stream.whole
            data, known = b"".join(held), whole

    push(first)
    while work:
        layer = work.popleft()
        found.update((*layer.place(s, e), kind) for s, e, kind in base_matches(layer.text))
        if "%" in layer.text and (pieces := percent_pieces(layer.text)):
            push(replaced(layer, pieces))
        if "\\" in layer.text and (pieces := unicode_pieces(layer.text)):
            push(replaced(layer, pieces))
        places = lambda start, end: lambda: [layer.place(s, e) for s, e in groups_of(layer.text[start:end], start)]
        tried = [(start, end, opened(data, layer.place(start, end), places(start, end))) for start, end, data in blobs(layer.text)]
        if "%" in layer.text:
            tried += [(start, end, opened(data, layer.place(start, end))) for start, end, data in percent_blobs(layer.text)]
        complete &= settled(tried)
    return complete


def scan(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]], bool]:
    """(plain findings, all findings, whether every layer was opened whole)."""
    base = base_matches(text)
    if "%" not in text and "\\" not in text and not BASE64.search(text) and not SHORT.search(text):
        return base, base, True
    found = set(base)
    complete = explore(Layer.whole(text), found)
    order = sorted(found, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))
    return base, order, complete


def joined(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{s}:{e}" for s, e, kind in found)


def find_secrets(docs: DataFrame, text: str = "text", out: str = "secrets") -> DataFrame:
    """`docs` with the column `out`: an array of (kind, start, end, layer_only),
    and `<out>_complete`: whether every layer was opened whole.

    `layer_only` is true for findings that only a decoded layer shows.
    """

    @F.pandas_udf("found array<struct<kind:string,start:int,end:int,layer_only:boolean>>, complete boolean")
    def spans(texts: pd.Series) -> pd.DataFrame:
        found, wholes = [], []
        for value in texts:
            base, every, complete = scan(value or "")
            plain = set(base)
            found.append([{"kind": k, "start": s, "end": e, "layer_only": (s, e, k) not in plain} for s, e, k in every])
            wholes.append(complete)
        return pd.DataFrame({"found": found, "complete": wholes})

    scanned = fresh(docs, "_scanned")
    rows = docs.withColumn(scanned, spans(F.col(text)))
    return rows.withColumn(out, F.col(f"{scanned}.found")).withColumn(f"{out}_complete", F.col(f"{scanned}.complete")).drop(scanned)


def digests(docs: DataFrame) -> DataFrame:
    """Counts and digests of the findings of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, list[int]] = {k: [] for k in KINDS}
            shas, spans, wholes = [], [], []
            for value in batch.column(1):
                base, every, complete = scan(value.as_py() or "")
                kinds = [k for _, _, k in base]
                for k in KINDS:
                    counts[k].append(kinds.count(k))
                shas.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(every))
                wholes.append(complete)
            columns = [batch.column(0), *(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(shas, pa.string()), pa.array(spans, pa.string()), pa.array(wholes, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "complete"])

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, complete boolean"
    return small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole document: counts and digest of plain findings, spans of all."""
    return digests(table(spark, sf_dir, "documents"))
