"""The prefix trie against a trie built one turn at a time."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from bandflow.llm import prefixtrie

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "conv_id long, turn long, role string, text string, depth long, n_convs string"


def rem(c):
    return c - 20 * int(c / 20)


def by_brute_force(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append((turn is not None, turn or 0, role, hashlib.md5(text.encode()).hexdigest(), text))
    own = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in own.items()}
    members = {}
    built = {}
    for c, turns in own.items():
        base = c - rem(c)
        h = 0 if base == c else zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(base, [])[:h] + turns[h:] if h else turns
        for d in range(len(built[c]) + 1):
            members.setdefault(tuple(built[c][:d]), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        mine = (len(members[p]) - 1) * (len(WORDS.findall(p[-1][1])) if p else 0)
        leaves[p] = sum(leaves[k] for k in kids.get(p, [])) or 1
        saved[p] = mine + sum(saved[k] for k in kids.get(p, []))
    out = []
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(p))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def of(spark, rows, **options):
    frame = spark.createDataFrame([(*r, 7, "clash") for r in rows], SCHEMA).repartition(3)
    got = prefixtrie.trie(frame, **options)
    return sorted((tuple(r) for r in got.collect()), key=str)


def conversations(rng, n):
    texts = ["hello", "hello there", "", "tell me\x0bmore", " spaced ", "ünï cödé", None]
    rows = []
    for c in rng.sample(range(-60, 400), n):
        for t in range(rng.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c, rng.choice([t, t, t, None, 3]), rng.choice(["user", "assistant", None]), rng.choice(texts)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_a_trie_built_by_turns(spark, seed):
    rng = random.Random(seed)
    rows = conversations(rng, 90)
    rows += rng.choices(rows, k=20) + [(None, 1, "user", "nobody's"), (101, 1, "", "x"), (101, 1, None, "x")]
    assert of(spark, rows) == by_brute_force(rows)


def test_long_conversation_in_stretches(spark):
    rng = random.Random(3)
    rows = [(c, t, "user", rng.choice(["a", "b c"]) if c != 40 else "a") for c in (40, 60, 61, 67) for t in range(70 if c != 67 else 3)]
    rows += [(80, None, "user", "same")] * 50
    want = by_brute_force(rows)
    assert max(r[1] for r in want) == 70
    assert of(spark, rows, stretch=8) == want


def test_one_conversation_over_all_ranges(spark):
    rows = [(5, t, "user", f"turn {t}") for t in range(300)]
    assert of(spark, rows) == by_brute_force(rows)


def test_copies_of_a_conversation(spark):
    rows = [(20 * c, t, "user", f"turn {t}") for c in range(200) for t in range(3)]
    got = of(spark, rows)
    assert got == by_brute_force(rows) and len(got) == 4 and got[0][3] == 200


def test_pieces_of_long_lists(spark, monkeypatch):
    monkeypatch.setattr(prefixtrie, "PIECE", 40)
    ids = list(range(1000, 1500))
    rows = [(d, c) for c in ids for d in (1, 2)]
    ends = spark.createDataFrame(rows, "depth long, conv_id long").select("depth", F.lit(5).cast("long").alias("p1"), F.lit(-6).cast("long").alias("p2"), "conv_id").repartition(4)
    want = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert {(r["depth"], r["ends_sha256"]) for r in prefixtrie.digests_of_ends(ends).collect()} == {(1, want), (2, want)}


def test_empty_and_turnless(spark):
    assert of(spark, []) == []
    # 41 takes its first turns from 40, which is not there: it is rebuilt without turns.
    c = next(x for x in range(41, 60) if zlib.crc32(str(x).encode()) % 4 == 1)
    rows = [(c, 0, "user", "gone")]
    assert of(spark, rows) == by_brute_force(rows) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
