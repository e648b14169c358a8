"""Language identification by a bidirectional gated recurrent network over bytes.

Two gated recurrent layers read a window of bytes from both ends; every
position gets a distribution over languages, and a document's distribution is
the mean over all positions of all its windows. The network is trained in
numpy by backpropagation through time on a bounded sample of labelled
documents (`Training.docs_per_lang` documents of each language, drawn by a
hash of their id, `Training.windows` windows of each); prediction reads every
byte of every document.

Defined results: null text or text without a letter is `und` with score 0;
without any labelled document to learn from, everything is `und`; repeated
rows give repeated results; an empty table gives an empty result; extra columns
are carried along by `predictions` and never read, but for those named
lang_pred and score, which are overwritten.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, small_batches, table, trimmed

UNKNOWN = "und"
#: Bytes of a window at prediction, and windows computed at once.
WINDOW, BATCH = 128, 2048


@dataclass(frozen=True)
class Training:
    docs_per_lang: int = 400
    langs: int | None = None  #: languages learnt at most, the most frequent ones; by default all
    windows: int = 4
    length: int = 64
    hidden: int = 12
    steps: int = 260
    batch: int = 192
    rate: float = 0.02
    seed: int = 5


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Direction:
    """A gated recurrent layer whose input is a byte: table rows for z, r and n, then the state."""

    def __init__(self, hidden: int, rng: np.random.Generator):
        self.h = hidden
        self.table = (rng.standard_normal((256, 3 * hidden)) * 0.3).astype(np.float32)
        self.u = (rng.standard_normal((hidden, 3 * hidden)) / np.sqrt(hidden)).astype(np.float32)

    def run(self, ids: np.ndarray) -> tuple[np.ndarray, list]:
        """States (time, batch, hidden) for bytes (time, batch), and what backward needs."""
        h, kept = np.zeros((ids.shape[1], self.h), np.float32), []
        out = np.empty((*ids.shape, self.h), np.float32)
        k = self.h
        for t in range(len(ids)):
            x, s = self.table[ids[t]], h @ self.u
            gates = sigmoid(x[:, : 2 * k] + s[:, : 2 * k])
            z, r = gates[:, :k], gates[:, k:]
            n = np.tanh(x[:, 2 * k :] + r * s[:, 2 * k :])
            kept.append((h, z, r, n, s[:, 2 * k :]))
            h = n + z * (h - n)
            out[t] = h
        return out, kept

    def states(self, ids: np.ndarray) -> np.ndarray:
        """`run` without a record, on reused memory."""
        k, b = self.h, ids.shape[1]
        out = np.empty((*ids.shape, k), np.float32)
        h = np.zeros((b, k), np.float32)
        half = self.table.copy()
        half[:, : 2 * k] *= 0.5  # sigmoid(x) = tanh(x / 2) / 2 + 1 / 2
        u = self.u.copy()
        u[:, : 2 * k] *= 0.5
        x, s = np.empty((b, 3 * k), np.float32), np.empty((b, 3 * k), np.float32)
        g, n = np.empty((b, 2 * k), np.float32), np.empty((b, k), np.float32)
        for t in range(len(ids)):
            np.take(half, ids[t], axis=0, out=x, mode="clip")
            np.matmul(h, u, out=s)
            np.add(x[:, : 2 * k], s[:, : 2 * k], out=g)
            np.tanh(g, out=g)
            g *= 0.5
            g += 0.5
            np.multiply(g[:, k:], s[:, 2 * k :], out=n)
            n += x[:, 2 * k :]
            np.tanh(n, out=n)
            h -= n
            h *= g[:, :k]
            h += n
            out[t] = h
        return out

    def back(self, ids: np.ndarray, kept: list, d_out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of the table and of u for gradients of the states."""
        k = self.h
        d_u, d_x = np.zeros_like(self.u), np.empty((*ids.shape, 3 * k), np.float32)
        carry = np.zeros_like(d_out[0])
        for t in range(len(ids) - 1, -1, -1):
            h, z, r, n, sn = kept[t]
            d = d_out[t] + carry
            d_n = d * (1 - z) * (1 - n * n)
            d_z = d * (h - n) * z * (1 - z)
            d_r = d_n * sn * r * (1 - r)
            d_s = np.concatenate((d_z, d_r, d_n * r), axis=1)
            d_x[t] = np.concatenate((d_z, d_r, d_n), axis=1)
            d_u += h.T @ d_s
            carry = d * z + d_s @ self.u.T
        flat, order = d_x.reshape(-1, 3 * k), np.argsort(ids.ravel(), kind="stable")
        seen, first = np.unique(ids.ravel()[order], return_index=True)
        d_table = np.zeros_like(self.table)
        d_table[seen] = np.add.reduceat(flat[order], first, axis=0)
        return d_table, d_u


class Recogniser:
    def __init__(self, langs: list[str], hidden: int, seed: int):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.langs = langs
        self.forward, self.backward = Direction(hidden, rng), Direction(hidden, rng)
        self.w = (rng.standard_normal((2 * hidden, len(langs))) * 0.1).astype(np.float32)
        self.b = np.zeros(len(langs), np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.forward.table, self.forward.u, self.backward.table, self.backward.u, self.w, self.b]

    def gradients(self, ids: np.ndarray, target: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean loss over all positions, and its gradients, by backpropagation through time."""
        hf, kept_f = self.forward.run(ids)
        hb, kept_b = self.backward.run(ids[::-1])
        h = np.concatenate((hf, hb[::-1]), axis=2)
        p = softmax(h @ self.w + self.b)
        hot = np.eye(len(self.langs), dtype=np.float32)[target][None]
        loss = -float((np.log(p + 1e-9) * hot).sum(axis=2).mean())
        d = (p - hot) / ids.size
        d_w = np.einsum("tbh,tbc->hc", h, d)
        d_h = d @ self.w.T
        k = self.forward.h
        table_f, u_f = self.forward.back(ids, kept_f, np.ascontiguousarray(d_h[:, :, :k]))
        table_b, u_b = self.backward.back(ids[::-1], kept_b, np.ascontiguousarray(d_h[::-1, :, k:]))
        return loss, [table_f, u_f, table_b, u_b, d_w, d.sum(axis=(0, 1))]

    def train(self, windows: np.ndarray, target: np.ndarray, how: Training) -> list[float]:
        """Adam over random batches of (windows, bytes); returns the losses."""
        rng = np.random.Generator(np.random.PCG64(how.seed))
        mean, square = [np.zeros_like(p) for p in self.parameters()], [np.zeros_like(p) for p in self.parameters()]
        by_lang = [np.flatnonzero(target == i) for i in range(len(self.langs))]
        losses = []
        for step in range(1, how.steps + 1):
            pick = rng.choice(np.concatenate([rng.choice(x, max(1, how.batch // len(by_lang))) for x in by_lang]), how.batch)
            loss, grads = self.gradients(np.ascontiguousarray(windows[pick].T), target[pick])
            losses.append(loss)
            rate = how.rate * min(1.0, 2.0 * (1 - step / (how.steps + 1)))
            scale = min(1.0, 1.0 / (np.sqrt(sum(float((g * g).sum()) for g in grads)) + 1e-9))
            for p, g, m, s in zip(self.parameters(), grads, mean, square, strict=True):
                m += 0.1 * (scale * g - m)
                s += 0.001 * ((scale * g) ** 2 - s)
                p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-6)).astype(np.float32)
        return losses

    def positions(self, ids: np.ndarray) -> np.ndarray:
        """Distribution at every position of bytes (time, batch)."""
        logits = self.forward.states(ids) @ self.w[: self.forward.h]
        logits += self.backward.states(ids[::-1])[::-1] @ self.w[self.forward.h :]
        logits += self.b
        return softmax(logits)

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """Mean distribution over all bytes of each text."""
        sums, ends = np.zeros((len(texts), len(self.langs))), np.cumsum([0, *map(len, texts)])
        data = np.frombuffer(b"".join(texts) + b" " * WINDOW, np.uint8)
        counts = [-(-len(t) // WINDOW) for t in texts]
        doc = np.repeat(np.arange(len(texts)), counts)
        start = np.concatenate([np.arange(c) * WINDOW + e for c, e in zip(counts, ends, strict=False)] or [np.empty(0)]).astype(np.int64)
        size = np.minimum(WINDOW, ends[doc + 1] - start) if len(doc) else np.empty(0, np.int64)
        order = np.argsort(size, kind="stable")
        for part in np.array_split(order, max(1, -(-len(order) // BATCH))) if len(order) else []:
            longest = int(size[part].max())
            steps = np.arange(longest)
            ids = data[start[part] + steps[:, None]]
            inside = steps[:, None] < size[part]
            p = self.positions(np.where(inside, ids, 32))
            np.add.at(sums, doc[part], np.einsum("tbc,tb->bc", p, inside.astype(np.float32)))
        return sums / np.maximum(1, np.diff(ends))[:, None]


def softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=-1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(axis=-1, keepdims=True)
    return x


def has_letter(text: str) -> bool:
    """Whether any character is a letter: numerals, ordinals and marks are none."""
    return any(map(str.isalpha, text))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, how: Training) -> list[tuple[str, list[bytes]]]:
    """(lang, windows) of at most `docs_per_lang` labelled documents of each language.

    About twice as many are drawn by a hash of id and text and reach the
    driver; equal rows have one draw and are one document of the sample.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    frequent = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang")
    sizes = {r["lang"]: r["count"] for r in (frequent if how.langs is None else frequent.limit(how.langs)).collect()}
    if not sizes:
        return []
    draw = F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.col("text"), F.lit(how.seed)), 11) / F.lit(float(1 << 53))
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, 2.0 * how.docs_per_lang / n))])
    at = [F.substring("text", (F.length("text") * F.lit(i / how.windows)).cast("int") + 1, how.length) for i in range(how.windows)]
    got = rows.withColumn("u", draw).where(F.col("u") < F.coalesce(F.try_element_at(share, F.col("lang")), F.lit(0.0))).select("lang", "u", F.array(*at).alias("w")).groupBy("lang", "u").agg(F.first("w").alias("w")).collect()
    out, taken = [], dict.fromkeys(sizes, 0)
    for r in sorted(got, key=lambda r: (r["u"], r["w"])):
        if taken[r["lang"]] < how.docs_per_lang:
            taken[r["lang"]] += 1
            out.append((r["lang"], [w.encode()[: how.length] for w in r["w"] if w.strip()]))
    return out


def learn(docs: DataFrame, how: Training | None = None) -> Recogniser | None:
    """A network trained on labelled documents that aren't held out; None without any."""
    how = how or Training()
    rows = [(lang, w) for lang, windows in sample(docs, how) for w in windows if len(w) >= 8]
    if not rows:
        return None
    langs = sorted({lang for lang, _ in rows})
    windows = np.frombuffer(b"".join(w.ljust(how.length, b" ") for _, w in rows), np.uint8).reshape(len(rows), how.length)
    net = Recogniser(langs, how.hidden, how.seed)
    net.train(windows, np.array([langs.index(lang) for lang, _ in rows]), how)
    return net


def predictions(docs: DataFrame, net: Recogniser | None, keep: list[str]) -> DataFrame:
    """Columns `keep`, lang_pred and score for every row of `docs`; only `text` is looked at."""
    keep, text = [c for c in keep if c.lower() not in ("lang_pred", "score")], fresh(docs, "_text")
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
                known = [i for i, t in enumerate(texts) if net is not None and has_letter(t)]
                langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
                if known:
                    p = net.pooled([texts[i].encode() for i in known])
                    for i, row in zip(known, p, strict=True):
                        best = int(row.argmax())
                        langs[i], scores[i] = net.langs[best], min(1.0, float(row[best]))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names[:-1], "lang_pred", "score"])

    return small_batches(docs).select(*keep, F.col("text").cast("string").alias(text)).mapInArrow(trimmed(run), schema)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every whole document."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return predictions(rows, learn(docs), ["doc_id", "held_out"])
