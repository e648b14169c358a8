"""Benchmark search against a scan of every place for every window."""

import hashlib
import random
import re

import pytest

from bandflow.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def by_brute_force(docs, items, window=10):
    patterns = set()
    for name, text in items:
        w = words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            patterns.add(("" if name is None else str(name), tuple(w[i : i + window])))
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for name, p in patterns:
            for i in range(len(w) - len(p) + 1):
                if tuple(w[i : i + len(p)]) == p:
                    hit |= set(range(i, i + len(p)))
                    found.add(name)
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def tables(seed):
    rng = random.Random(seed)
    few = ["the", "of", "and", "a1", "é", "日本", "x", "Über"]
    say = lambda n: rng.choice([" ", "-", "\n", "\x00", ", "]).join(rng.choices(few, k=n))
    items = [(i, say(rng.choice([1, 4, 9, 10, 11, 30]) if i < 8 else 25)) for i in range(30)]
    items += [(3, say(14)), (30, items[20][1]), (None, say(12)), (31, None), (32, "... !")]
    docs = [(i, say(rng.randint(0, 60))) for i in range(120)]
    docs += [(200 + i, f"{say(20)} {items[rng.randrange(8, 30)][1].upper()} {say(9)}") for i in range(20)]
    docs += [docs[130], docs[130], (300, None), (301, ""), (None, items[9][1]), (302, items[9][1][:-1])]
    return docs, items


def of(spark, docs, items, **options):
    got = D.find(*frames(spark, docs, items), **options).collect()
    count = lambda s: sum(s[1::2]) - sum(s[::2])
    return sorted(((r["doc_id"], r["n_words"], count(r["spans"]), len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), bool(r["spans"])) for r in got), key=str)


def frames(spark, docs, items):
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, spans string, n_words int").repartition(3)
    return d, spark.createDataFrame([(*r, 0) for r in items], "item_id long, text string, doc_id int")


@pytest.mark.parametrize("block_bytes", [1 << 20, 150])
def test_equals_a_scan_of_every_place(spark, block_bytes):
    docs, items = tables(block_bytes)
    want = by_brute_force(docs, items)
    assert of(spark, docs, items, block_bytes=block_bytes) == want
    assert sum(r[5] for r in want) > 20
    if block_bytes > 1000:
        assert sorted((tuple(r) for r in D.flagged(*frames(spark, docs, items)).collect()), key=str) == want


def test_only_long_items(spark):
    docs, items = tables(4)
    items = [x for x in items if len(words(x[1])) >= 10]
    want = by_brute_force(docs, items)
    assert of(spark, docs, items) == want and any(r[5] for r in want) and not all(r[5] for r in want)


def test_parts_of_a_long_text():
    rng = random.Random(2)
    text = " ".join(rng.choices(["aa", "b", "ccc", "é"], k=3000)).encode()
    item = text[2000:2100]
    whole = D.Searcher([("q", item), ("one", b"ccc b")])
    assert whole.search(text, size=37) == whole.search(text) and whole.search(text)[1]
    assert [x for p in D.parts(b"x" * 100 + b" y", 10) for x in p] == [b"x" * 100, b"y"]


def test_nothing_to_find(spark):
    docs, items = tables(5)
    clean = by_brute_force(docs, [])
    assert of(spark, docs, []) == clean and of(spark, [], items) == []
