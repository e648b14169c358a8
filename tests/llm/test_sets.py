"""Similarity, language, mixing, fingerprints, archives and the pipeline."""

import hashlib
import random
import re
import struct
from pathlib import Path

import corpus_pipeline
import helpers
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from bandflow.llm import common, jaccard_join, langid, mixing, neardup, syncmers, warc

SF = "/root/testdata/sf0.001"
WORDS = [f"w{i}" for i in range(3000)]


def family(seed, n):
    r = random.Random(seed)
    base = [r.choice(WORDS) for _ in range(120)]
    rows = []
    for i in range(n):
        t = list(base)
        for _ in range(r.randint(0, 5)):
            j, how = r.randrange(len(t)), r.random()
            if how < 0.5:
                t[j] = r.choice(WORDS)
            elif how < 0.7:
                del t[j]
            elif how < 0.9:
                t.insert(j, r.choice(WORDS))
            else:
                t = t[: len(t) - r.randint(1, 12)]
        rows.append((i * 7 % 1009, " ".join(t)))
    return rows


@pytest.mark.parametrize(("n", "num"), [(3, 90), (5, 80)])
def test_jaccard_classes(spark, n, num):
    r = random.Random(1)
    rows = family(2, 90) + [(2000 + i, " ".join(r.choices(WORDS[:5], k=r.randint(0, 9)))) for i in range(80)] + [(3000, None), (3001, " \t"), (3002, "one two"), (3003, "One two")]
    d = spark.createDataFrame([(*x, "clash") for x in rows], "doc_id long, text string, key string")
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard_join.classes(d, jaccard_join.Rule(n, num)).collect()}
    assert got == helpers.jaccard_classes(rows, n, num)
    assert jaccard_join.classes(d.limit(0), jaccard_join.Rule(n, num)).count() == 0
    kept = jaccard_join.deduplicate(d, jaccard_join.Rule(n, num))
    assert {x["doc_id"] for x in kept.collect()} == {i for i, (_, c) in got.items() if i == c}


def test_jaccard_large_groups_take_pivots(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "FEW", 2)
    monkeypatch.setattr(jaccard_join, "CHUNK", 8)
    monkeypatch.setattr(jaccard_join, "STARS", 1)
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    rows = family(5, 70)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard_join.classes(d, jaccard_join.Rule(3, 90, bits=64, slice=16)).collect()}
    assert got == helpers.jaccard_classes(rows, 3, 90)


@pytest.mark.parametrize(("n", "num"), [(3, 90), (5, 80)])
def test_jaccard_strangers_of_few_words_hardly_meet(spark, n, num):
    """Texts of so few words that any shingle is in several of them: each meets its copy and hardly anyone else."""
    r, rule = random.Random(6), jaccard_join.Rule(n, num)
    texts = [r.choices("abcdefghijkl" if n == 3 else "abcdef", k=r.randint(60, 120)) for _ in range(150)]
    d = spark.createDataFrame([(2 * i + j, " ".join(t[j:])) for i, t in enumerate(texts) for j in (0, 1)], "doc_id long, text string")
    with common.workspace(spark) as folder:
        pairs, _ = jaccard_join.met(d, rule, jaccard_join.frequent_shingles(jaccard_join.set_digests(d, rule)), folder)
        met = {frozenset(p) for p in pairs.collect()}
    assert all(frozenset((2 * i, 2 * i + 1)) in met for i in range(150)) and len(met) < 300


def test_components(spark):
    edges = [(i, i + 1) for i in range(40, 60)] + [(1, 50), (7, 8), (9, 9), (8, 7), (100, 99)]
    got = {r["id"]: r["component_id"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = helpers.roots({x for e in edges for x in e}, edges)
    want.pop(9)
    assert got == want


def vectors(seed):
    r = np.random.default_rng(seed)
    rows, at = [], 0
    for label in (1, 2, None):
        for _ in range(12):
            base = r.standard_normal(16)
            for _ in range(r.integers(1, 8)):
                rows.append((at, [float(x) for x in (base + r.standard_normal(16) * 0.07)], label))
                at += 1
    rows += [(at, [0.0] * 16, 1), (at + 1, None, 1), (at + 2, [float("nan")] * 16, 1), (at + 3, [None] * 16, 1), (at + 4, [], 1), (at + 5, rows[0][1], 1), (at + 6, [2 * x for x in rows[0][1]], 1), (at + 7, [1.0, 2.0], 1)]
    return rows


def test_embedding_links(spark, monkeypatch):
    monkeypatch.setattr(neardup, "CHUNK", 4)
    rows = vectors(3)
    t = spark.createDataFrame([(*x, 5) for x in rows], "vec_id long, embedding array<double>, label int, uid int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in neardup.near_duplicates(t).collect()}
    assert got == helpers.cosine_classes(rows, 0.98)
    assert neardup.near_duplicates(t.limit(0)).count() == 0


def test_embeddings_of_any_size_and_repeats(spark):
    r = np.random.default_rng(5)
    base = r.standard_normal(24)
    rows = [(i, [float(x) for x in (base + r.standard_normal(24) * 0.04) * scale], "a") for i, scale in enumerate((1e200, 1e-200, 1.0, 3e150))]
    rows += [rows[0], rows[2], (9, [-x for x in rows[2][1]], "a"), (10, rows[2][1], None)]
    got = {(x["vec_id"], x["n_links"], x["component_id"], x["kept"]) for x in neardup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()}
    assert got == {(0, 5, 0, True), (1, 5, 0, False), (2, 5, 0, False), (3, 5, 0, False), (9, 0, 9, True), (10, 0, 10, True)}


def test_embedding_bounds_hold():
    r = np.random.default_rng(0)
    a, b = r.standard_normal((200, 32)), r.standard_normal((200, 32))
    exact = neardup.unit(a) @ neardup.unit(b).T
    signs, factor = neardup.codes(b, 256)
    estimate, upper = neardup.upper_bounds(neardup.in_bytes(a).astype(float), signs, factor)
    assert (exact <= upper).mean() > 0.9999 and abs((estimate - exact).mean()) < 0.002
    near = b + r.standard_normal((200, 32)) * 0.1
    exact = np.einsum("ij,ij->i", neardup.unit(near), neardup.unit(b))
    assert (exact <= np.diag(neardup.upper_bounds(neardup.in_bytes(near).astype(float), signs, factor)[1])).all()


def test_language_sample_of_equal_ids_and_rows(spark):
    """Rows that share an id, or none, are drawn apart; a document that repeats is one of the sample."""
    rows = [(None, f"some words of text number {i} and a few more of them", "en") for i in range(900)] + [(7, "the same text again and again", "fr")] * 700 + [(i, "rare", f"l{i}") for i in range(80)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = langid.sample(d, langid.Training(docs_per_lang=50))
    n = {lang: sum(x == lang for x, _ in got) for lang in {x for x, _ in got}}
    assert n["en"] == 50 and n.get("fr", 0) <= 1 and len(n) > 50
    assert len({x for x, _ in langid.sample(d, langid.Training(docs_per_lang=50, langs=2))}) <= 2


def test_language_gradients():
    net = langid.Recogniser(["a", "b"], 4, 0)
    ids, target = np.random.default_rng(0).integers(0, 256, (6, 3)).astype(np.uint8), np.array([0, 1, 0])
    _, grads = net.gradients(ids, target)
    for p, g in zip(net.parameters(), grads, strict=True):
        i = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = p[i]
        p[i] = old + 0.01
        up = net.gradients(ids, target)[0]
        p[i] = old - 0.01
        down = net.gradients(ids, target)[0]
        p[i] = old
        assert (up - down) / 0.02 == pytest.approx(g[i], rel=0.02)


@pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not here")
def test_language_held_out(spark):
    docs = common.table(spark, SF, "documents")
    got = langid.op2_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.9 and got["score"].between(0, 1).all()
    texts = [None, "123 !", "", "½ ² ① Ⅷ"]
    odd = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, score string, _text int")
    assert [(r["lang_pred"], r["score"], r["_text"]) for r in langid.predictions(odd, langid.learn(docs), odd.columns).collect()] == [("und", 0.0, 1)] * 4
    assert langid.learn(odd.limit(0)) is None
    assert langid.predictions(docs, None, ["doc_id"]).where("lang_pred <> 'und'").count() == 0


def corpus(spark, n=300):
    r = random.Random(4)
    rows = [(i, " ".join(r.choices(WORDS, k=r.randint(0, 60))), r.choice(["en", "fr", None]), r.choice(["a", "a", "b"]), 0) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_mixing_sample_meets_marginals(spark):
    """Expected drawn tokens, with cells that are drawn whole among them."""
    d = corpus(spark).withColumns({"topic": F.when(F.col("doc_id") % 10 == 0, "sports").otherwise("news"), "weight": F.lit("clash"), "_lang": F.lit(1)})
    how = mixing.Targets(shares={"source": {"a": 0.35, "b": 0.65, "gone": 5.0}, "topic": {"sports": 0.2, "news": 0.8}}, budget=0.45)
    out = mixing.mix(d, how).toPandas()
    w = out["n_tokens"] * out["probability"]
    shares = {c: w.groupby(out[c].fillna("(none)")).sum() / w.sum() for c in ("source", "topic", "lang")}
    assert (out["probability"] == 1).any() and set(out["topic"]) == {"sports", "news"} and set(out["_lang"]) == {1}
    assert shares["source"]["b"] == pytest.approx(0.65, abs=0.01) and shares["topic"]["sports"] == pytest.approx(0.2, abs=0.01)
    tokens = out.groupby(out["lang"].fillna("(none)"))["n_tokens"].sum() ** 0.5
    assert (shares["lang"] - tokens / tokens.sum()).abs().max() < 0.01
    assert w.sum() == pytest.approx(0.45 * out["n_tokens"].sum(), rel=0.01)
    assert out["n_tokens"][out["drawn"]].sum() == pytest.approx(w.sum(), rel=0.1)
    assert np.allclose(out["weight"] * 0.45, out["probability"]) and mixing.mix(d.limit(0)).count() == 0
    with pytest.warns(UserWarning, match="missed.*source=a reaches"):
        mixing.mix(d.withColumn("lang", F.col("source")), mixing.Targets(shares={"source": {"a": 0.9, "b": 0.1}, "lang": {"a": 0.1, "b": 0.9}}, budget=0.2))


@pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not here")
def test_mixing_tables_meet_targets(spark):
    out = mixing.op9_mixing(spark, SF).toPandas()
    w = out["n_tokens"] * out["probability"]
    for c in mixing.DIMENSIONS:
        of = out[c].fillna("(none)")
        totals = out["n_tokens"].groupby(of).sum()
        want = mixing.goal(totals.to_numpy(float), list(totals.index), None, mixing.Targets())
        assert np.abs(w.groupby(of).sum().to_numpy() - want).max() < 0.01 * want.sum()


def test_topics_are_found_in_every_language(spark):
    """Three subjects in two languages that share no word: a topic is a subject, in each language."""
    r = random.Random(4)
    subject = {(lang, k): [f"{lang}{k}{c}" for c in "abcdefghij"] for lang in ("x", "y") for k in range(3)}
    rows = []
    for i in range(240):
        lang, k = "xy"[i % 2], i % 3
        rows.append((i, " ".join(r.choices(subject[lang, k], k=30) + r.choices([f"{lang}common{j}" for j in range(20)], k=30)), lang, "s"))
    rows += [(240, "  ", "x", "s"), (241, None, None, "s"), (242, "words of no known language", None, "s"), (243, " ".join(["x0a x0b x0c"] * 20_000), "x", "s")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    how = mixing.Topics(k=6, sample=150)
    got = {x["doc_id"]: x for x in mixing.mix(d, topics=how).collect()}
    again = {x["doc_id"]: x["topic"] for x in mixing.mix(d.repartition(5), topics=how).collect()}
    assert {i: x["topic"] for i, x in got.items()} == again
    of = {}
    for i in range(240):
        of.setdefault((i % 2, i % 3), []).append(got[i]["topic"])
    main = {key: max(set(v), key=v.count) for key, v in of.items()}
    assert all(v.count(main[key]) >= 0.95 * len(v) for key, v in of.items())
    assert len({main[0, k] for k in range(3)}) == len({main[1, k] for k in range(3)}) == 3
    assert got[240]["topic"] == got[241]["topic"] == "(empty)" and got[240]["n_tokens"] == 0 and got[0]["n_tokens"] == 60 and got[243]["topic"] == main[0, 0]


def test_topics_are_learnt_from_all_documents(spark):
    """Means are those of all vectors, more than the 4,000 of a sample, and topics don't depend on how rows are dealt."""
    r = random.Random(5)
    subject = [[f"{k}{c}" for c in "abcdefghij"] for k in "pq"]
    rows = [(i, " ".join(r.choices(subject[i >= 4995], k=12)), "x", "s") for i in range(5000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    models = [mixing.learn_topics(d.repartition(n), mixing.Topics(k=2, trials=2)) for n in (2, 5)]
    assert np.array_equal(models[0].centres, models[1].centres)
    vectors = np.array([mixing.word_vector(t.encode(), 64)[0] for _, t, *_ in rows])
    assert np.allclose(models[0].mean, vectors.mean(axis=0), atol=1e-6)


def test_mixing_reads_texts_once(spark, tmp_path):
    """What follows the word vectors reads what is stored with them, with columns of any type, and no text where none is asked for."""
    corpus(spark, 30).write.parquet(str(tmp_path / "docs"))
    d = spark.read.parquet(str(tmp_path / "docs")).withColumns({"_measured": F.lit(1), "none": F.lit(None)})
    whole, few = mixing.mix(d), mixing.mix(d, keep=["doc_id", "source", "lang"])
    assert not set(d.inputFiles()) & set(whole.inputFiles() + few.inputFiles())
    assert whole.columns == [*d.columns, "topic", "n_tokens", "probability", "weight", "drawn"] and set(whole.columns) - set(few.columns) == {"text", "n_chars", "_measured", "none"}
    assert sorted(whole.select(few.columns).collect()) == sorted(few.collect()) and {r["text"] for r in whole.collect()} == {r["text"] for r in d.collect()}


def test_mixing_large_equals_small(spark):
    how = mixing.Targets(rounds=4, tolerance=0.0)
    a = mixing.mix(corpus(spark, 60), how).orderBy("doc_id").toPandas()
    b = mixing.mix(corpus(spark, 60), how, small_cells=0).orderBy("doc_id").toPandas()
    assert np.allclose(a["weight"], b["weight"], atol=1e-6) and np.allclose(a["probability"], b["probability"], atol=1e-6)


def test_next_and_fingerprints(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(syncmers, "STRETCH_ROWS", 3)
    r = random.Random(8)
    texts = [" ".join(r.choices(WORDS, k=r.randint(0, 40))) for _ in range(50)] + ["", "é", "zwei Wörter"]
    rows = [(i * i, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x["doc_id"]: x for x in syncmers.op10_syncmers(spark, str(tmp_path)).collect()}
    order = sorted(rows, reverse=True)
    for (i, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[i]["n_chars"] == len(t)
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
    assert syncmers.with_next(spark.createDataFrame(rows, "doc_id long, text string").limit(0), ["text"]).count() == 0
    odd = spark.createDataFrame([(None, "n"), (1, None), (1, "b"), (5, "c")], "doc_id long, text string")
    assert sorted((x["text"] or "", x["next_text"] or "") for x in syncmers.with_next(odd, ["text"]).collect()) in ([("", "b"), ("b", "n"), ("c", ""), ("n", "c")], [("", "n"), ("b", ""), ("c", "b"), ("n", "c")])  # equal ids: by text hash


def test_syncmers_are_closed_and_context_free(spark):
    words = random.Random(9).choices(WORDS, k=60)
    d = spark.createDataFrame([(0, " ".join(words)), (1, " ".join(["x", "y", *words, "z"]))], "doc_id long, text string")
    a, b = (x["a"] for x in syncmers.with_anchors(d, "text", "a").orderBy("doc_id").collect())
    assert set(a) <= set(b) and len(a) > 10
    at = syncmers.anchor_positions(d, "text").toPandas()
    assert at[at.doc_id == 0].anchor.tolist() == a
    joined = at[at.doc_id == 0].merge(at[at.doc_id == 1], on="anchor")
    assert set(joined.position_y - joined.position_x) == {2}


def anchors_by_loop(text):
    """Anchors by plain loops over windows of words."""
    words = []
    for w in re.split(r"[\x20\x09-\x0D]+", text or ""):
        if len(w) > syncmers.LONG:
            words += [chained(w[i : i + syncmers.GRAM]) for i in range(len(w) - syncmers.GRAM + 1)]
        elif w:
            words.append(chained([w]))
    out = []
    for i in range(len(words) - syncmers.K + 1):
        row = words[i : i + syncmers.K]
        if min(row) in (row[0], row[-1]):
            out.append(chained(row))
    return list(dict.fromkeys(out)) or ([chained(words)] if words else [])


def chained(values):
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack("<q", v), seed=h)
    return h - (1 << 64) if h >> 63 else h


def test_fingerprints_by_brute_force(spark, tmp_path):
    r = random.Random(12)
    texts = [" ".join(r.choices(WORDS[:40], k=r.randint(0, 50))) + r.choice(["", "\t\n", " " + "".join(r.choices("0123456789abcdefé漢", k=40))]) for _ in range(60)]
    texts += [None, "", " ", texts[0], "x" * 17, "漢字" * 30]
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x["doc_id"]: x for x in syncmers.op10_syncmers(spark, str(tmp_path)).collect()}
    alike = lambda a, b: 1.0 if not a and not b else 2 * len(set(a) & set(b)) / (len(a) + len(b))
    order = sorted(((i, t or "") for i, t in rows), reverse=True)
    for (i, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        half = len(t) // 2
        own, edited, following = (anchors_by_loop(x) for x in (t, t[: len(t) - half] + after[:half], after))
        assert [int(x) for x in got[i]["fingerprint"].split()] == own and [int(x) for x in got[i]["edited_fingerprint"].split()] == edited
        assert got[i]["near_edited"] == pytest.approx(alike(own, edited)) and got[i]["near_next"] == pytest.approx(alike(own, following))


def test_next_of_null_and_equal_ids(spark, monkeypatch):
    monkeypatch.setattr(syncmers, "STRETCH_ROWS", 2)
    rows = [(i if i % 3 else None, f"t{i}") for i in range(40)] + [(7, "again"), (None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"_top": F.lit(1), "_next_of": F.lit("x")})
    tie = {(x["doc_id"], x["text"]): x["h"] for x in d.withColumn("h", F.xxhash64("text")).collect()}
    order = sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0), tie[x]))
    want = {x: y[1] for x, y in zip(order, order[1:] + order[:1], strict=True)}
    assert {(x["doc_id"], x["text"]): x["next_text"] for x in syncmers.with_next(d, ["text"]).collect()} == want


def test_short_and_unspaced_texts_have_anchors(spark, tmp_path):
    r = random.Random(5)
    short = [" ".join("".join(r.choices("etaoinshr", k=6)) for _ in range(n)) for n in (5, 6, 7) for _ in range(40)]
    texts = ["".join(chr(0x4E00 + r.randrange(3000)) for _ in range(n)) for n in (400, 900)] + ["".join(r.choices("0123456789abcdef", k=3000))] + short
    texts = [texts[0], short[0], texts[1], short[1], texts[2], *short[2:], "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x["doc_id"]: x for x in syncmers.op10_syncmers(spark, str(tmp_path)).collect()}
    assert [i for i, x in got.items() if not x["fingerprint"]] == [i for i in got if not texts[i]]
    assert all(x["near_next"] == 0 for i, x in got.items() if texts[i])
    assert all(got[i]["near_edited"] > 0.5 and len(got[i]["fingerprint"].split()) > len(texts[i]) / 5 for i in (0, 2, 4))
    long = ["x" + texts[0][20:200], texts[0][50:120]]
    a, b = (set(x["a"]) for x in syncmers.with_anchors(spark.createDataFrame(list(enumerate(long)), "doc_id long, text string"), "text", "a").orderBy("doc_id").collect())
    assert b <= a and len(b) > 10


def test_archive(spark, tmp_path):
    rows = [(1, "u\n x", "<a>"), (2, "u", "<a>"), (3, None, None), (4, "é", ""), (5, "z", "é"), (None, "z", "é"), (5, "y", "é")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string")
    for packed in ("none", "gzip"):
        path = f"file://{tmp_path}/{packed}"
        warc.archive(pages, path, compression=packed)
        back = spark.read.format("warc").option("verify", "true").load(path)
        got = back.collect()
        assert len(got) == 7 and all(r["digest_ok"] for r in got if r["record_type"] == "response")
        assert {(r["record_id"], r["refers_to"]) for r in got if r["record_type"] == "revisit"} == {("urn:page:1", "urn:page:2"), ("urn:page:3", "urn:page:4"), ("urn:page:", "urn:page:5")}
        assert {bytes(r["payload"]) for r in got if r["payload"] is not None} == {b"<a>", b"", "é".encode()}
        assert back.where("record_type = 'revisit'").count() == 3 and back.where(F.col("target_uri").isin("u", "é")).count() == 2
        assert back.where("target_uri = ''").count() == 0
    warc.archive(pages, f"file://{tmp_path}/big", min_revisit_bytes=3)
    assert spark.read.format("warc").load(f"file://{tmp_path}/big").where("record_type = 'revisit'").count() == 1
    warc.archive(pages.limit(0), f"file://{tmp_path}/none0")
    assert spark.read.format("warc").load(f"file://{tmp_path}/none0").count() == 0


@pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not here")
def test_pipeline(spark):
    docs = common.table(spark, SF, "documents")
    ids = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES][2] == "n-gram Jaccard join"
    kept = corpus_pipeline.without_near_copies(spark, docs, SF)
    want = helpers.jaccard_classes(list(ids.items()), 5, 80)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, (_, c) in want.items() if i == c}
    assert corpus_pipeline.by_language(spark, docs, SF).count() >= 0.99 * len(ids)
    out = corpus_pipeline.run(spark, SF)
    assert 0 < out.count() < len(ids) and out.columns[0] == "doc_id"


def test_pipeline_stages_on_odd_tables(spark):
    """Nulls in every column, empty and repeated rows, ties, a very long text and clashing columns, stage by stage."""
    line = "the quick brown fox jumps over the lazy dog again"
    long = "\n".join(f"row {i} of a long text with words {i * 7}" for i in range(4000))
    rows = [(1, f"{line}\nfirst", "en", "a", 5), (2, f"{line}\nsecond one", "en", None, None), (2, f"{line}\nsecond one", "en", None, None), (3, None, None, None, None), (4, "", "en", "b", 0), (None, "no id at all here", "en", "b", 3), (5, long, "en", "c", 9), (6, "123 456", "en", "c", 7)]
    clash = {n: F.lit("x") for n in ("topic", "weight", "score", "_unit", "_id", "pivot", "key", "lang_pred", "n_tokens")}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").withColumns(clash)
    kept = corpus_pipeline.by_language(spark, docs, SF)
    assert kept.columns == corpus_pipeline.COLUMNS
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 2, 2, 5]
    out = corpus_pipeline.without_repeated_lines(spark, docs, SF)
    texts = sorted(((r["doc_id"] or 0), r["text"]) for r in out.where("text is not null").collect())
    assert texts == [(0, "no id at all here"), (1, f"{line}\nfirst"), (2, "second one"), (2, "second one"), (4, ""), (5, long), (6, "123 456")]
    one = corpus_pipeline.without_near_copies(spark, docs, SF)
    assert sorted((r["doc_id"] or 0) for r in one.collect()) == [0, 1, 2, 2, 3, 4, 5, 6]
    assert corpus_pipeline.mixed(spark, docs, SF).columns == corpus_pipeline.COLUMNS
    assert corpus_pipeline.tokenised(spark, docs, SF).count() == len(rows)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


@pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not here")
def test_pipeline_equals_its_steps_by_brute_force(spark):
    """Line dedup and near copies by all pairs, language, sample and tokens by their own plain versions, on what each stage keeps."""
    docs = common.table(spark, SF, "documents").where("doc_id < 120")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    net = langid.learn(docs)
    lang = [(i, t) for i, t in rows if t and langid.has_letter(t) and max(net.pooled([t.encode()])[0]) >= corpus_pipeline.LEAST_SCORE]
    got = corpus_pipeline.by_language(spark, docs, SF)
    assert sorted(r["doc_id"] for r in got.collect()) == [i for i, _ in lang]
    cut = helpers.cut_by_brute_force([t for _, t in lang], 8)
    lines = [(i, c) for (i, t), c in zip(lang, cut, strict=True) if c == t or c.strip()]
    got = corpus_pipeline.without_repeated_lines(spark, got, SF)
    assert sorted((r["doc_id"], r["text"]) for r in got.collect()) == lines
    classes = helpers.jaccard_classes(lines, 5, 80)
    got = corpus_pipeline.without_near_copies(spark, got, SF)
    assert sorted(r["doc_id"] for r in got.collect()) == [i for i, _ in lines if classes[i][1] == i]
    drawn = corpus_pipeline.mixed(spark, got, SF)
    assert {r["doc_id"] for r in drawn.collect()} == {r["doc_id"] for r in mixing.mix(got).where("drawn").collect()}
    from tokenizers import Tokenizer

    from bandflow.llm import bpe

    t = Tokenizer.from_file(bpe.default_vocabulary())
    texts = {r["doc_id"]: r["text"] for r in drawn.collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.tokenised(spark, drawn, SF).collect()} == {i: len(t.encode(x, add_special_tokens=False).ids) for i, x in texts.items()}
