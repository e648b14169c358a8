"""Tokens of two vocabularies against whole-text tokenisation."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from bandflow.llm import alignment
from bandflow.llm.bpe import byte_letters

SCHEMA = "doc_id long, text string, pair string, chunk string"


@pytest.fixture(scope="module")
def whole():
    """Ids and token bytes of a whole text under both vocabularies, by the libraries alone."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_path, b_path = alignment.default_vocabularies()
    a, b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
    a.encode_special_tokens = True
    byte_of = {c: i for i, c in enumerate(byte_letters())}

    def tokens(text):
        ids_a = a.encode(" " + text, add_special_tokens=False).ids
        ids_b = b.encode(text)
        raw_a = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in ids_a]
        raw_b = [bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        good = text and b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode()
        return [*zip(ids_a, raw_a)] if good else [], [*zip(ids_b, raw_b)] if good else []

    return tokens


def ranges(tokens):
    out, at = [], 0
    for i, raw in tokens:
        out.append((i, at, at + len(raw)))
        at += len(raw)
    return out


def by_brute_force(rows, tokens):
    docs, counts = [], Counter()
    for doc_id, text in rows:
        a, b = map(ranges, tokens(text or ""))
        # Tokens are sorted, so the first that may overlap is never before the last one's first.
        links, low = [], 0
        for i, begin, end in a:
            while low < len(b) and b[low][2] <= begin:
                low += 1
            for j, first, last in b[low:]:
                if first >= end:
                    break
                links.append((i, j))
        counts.update(links)
        ends = sorted({e for *_, e in a} & {e for *_, e in b})
        groups = ";".join(",".join(str(i) for i, _, e in a if s < e <= t) + "|" + ",".join(str(i) for i, _, e in b if s < e <= t) for s, t in zip([0, *ends], ends, strict=False)) if len(ends) < 3000 else None
        docs.append((doc_id, len(a), len(b), len(ends), links, groups))
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return [(d, a, b, g, len(x), sum(counts[p] == most[p[1]] for p in x), sum(counts[p] for p in x), t) for d, a, b, g, x, t in docs], counts


def odd_texts():
    rng = random.Random(5)
    parts = ["the", " the", "  ", "\n", "\n\n", "\t", "\r\n", "é", "é", "　", "\xa0", "\x1c", "\x85", "<s>", "<0x41>", "<|endoftext|>", "don't", "123", ";", "{\r", "ﬁ", "日本語", "🙂", "\x00", "a" * 40, " of", ".", "ing"]
    return [*("".join(rng.choices(parts, k=rng.randint(1, 25))) for _ in range(400)), " ", "  ", "\n", "x ", " x", "a▁b", "▁", "plain text a▁b", "the the the", "", None]


@pytest.mark.parametrize("chunk_chars, at_hand, row_chunks", [(1 << 20, 1 << 20, 1000), (300, 0, 3), (1000, 1 << 20, 2)])
def test_equals_whole_texts(spark, whole, chunk_chars, at_hand, row_chunks):
    rows = list(enumerate([*odd_texts(), "the same text", "the same text"]))
    want, counts = by_brute_force(rows, whole)
    frame = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA).repartition(3)
    docs, pairs = alignment.align(frame, chunk_chars=chunk_chars, at_hand=at_hand, row_chunks=row_chunks)
    got = {r["doc_id"]: (r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups"]) for r in docs.collect()}
    assert len(got) == len(rows) and any(w[1] == 0 and rows[w[0]][1] for w in want)
    for w in want:
        assert got[w[0]] == w, rows[w[0]]
    assert {(r["a"], r["b"]): r["count"] for r in pairs.where("count > 0").collect()} == counts


def test_query_on_test_table(spark, whole, sf_dir="/root/testdata/sf0.001"):
    from pathlib import Path

    if not Path(sf_dir).exists():
        pytest.skip("test tables are not here")
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want, _ = by_brute_force(rows, whole)
    got = {r["doc_id"]: tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")) + (r["groups_sha256"],) for r in alignment.op11_alignment(spark, sf_dir).collect()}
    for w in want:
        assert got[w[0]][:7] == w[:7]
        if w[7] is not None:
            assert got[w[0]][7] == (hashlib.sha256(w[7].encode()).hexdigest() if w[7] else "")


def test_long_texts_are_split_in_parts(whole):
    both = alignment.tokenizers(*alignment.default_vocabularies())
    for text in ("word next.\n" * 3000, "one two three " * 500, "x" * 5000, "  spaced   out  " * 400):
        parts = list(both.segments(text, part=100))
        assert "".join(s for p in parts for s in p) == " " + text
        for k in (0, 1):
            assert [i for p in parts for ids in both.of_segments(p) for i in ids[k]] == [i for i, _ in whole(text)[k]]


def test_only_split_characters_that_no_piece_goes_on_over():
    both = alignment.tokenizers(*alignment.default_vocabularies())
    assert both.split_characters == " \n\t"
    assert both.segment.findall(" a\r\n b\tc\n\nd") == [" a\r", "\n b", "\tc", "\n\nd"]


def test_empty_table_and_equal_ids(spark):
    docs, pairs = alignment.align(spark.createDataFrame([], SCHEMA))
    assert docs.count() == pairs.count() == 0
    rows = spark.createDataFrame([(1, "some text", None, None), (1, "some text", None, None), (None, "other", None, None), (1, None, None, None)], SCHEMA)
    got = alignment.align(rows)[0]
    assert got.count() == 4 and got.where("n_a = 0").count() == 1 and got.where(F.col("doc_id").isNull()).first()["n_a"] == 1
