"""Mixing sources to target weights by iterative proportional fitting.

Token weights of the cells (source, language, topic) are raked until the
marginals of all three dimensions meet their targets within the token budget.
What is raked is the share of a cell that is drawn, which can't exceed one:
where a cell is full, the others of its row make up for it in the next round.
So the drawn documents, and not only the weights, meet the targets. A target
above what its value has is lowered to that, and the rest raised in
proportion. Documents are drawn by a hash of their id with their cell's
probability, so that a run can be repeated; `weight` is the probability over
the budget. If the marginals can't be met together, a warning says by how much
they are missed.

The topic is the column `topic` if there is one, or a given expression, else a
cluster of word vectors: words are hashed to `dims` places, counts damped, and
the mean of the document's language taken off, so that topics don't repeat
languages. Language means and k-means centres are learnt from all documents,
in passes over their stored vectors; only sums come back. Vectors are kept as
whole multiples of 1/`STEP`, so that sums, and with them the topics, don't
depend on how rows are dealt over tasks.

Defined results: null in a dimension is a value of its own, `(none)`; a
document without words has no tokens and is drawn at the probability of its
cell; target values without documents are left out and the rest is scaled to
one; rows with equal ids share their fate; an empty table gives an empty
result; a column named like a result (except topic) is overwritten.
"""

from __future__ import annotations

import warnings
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh, small_batches, stored, table, trimmed

DIMENSIONS = ("source", "lang", "topic")
#: Contingency tables of at most this many cells are raked on the driver and broadcast; larger ones on Spark.
SMALL_CELLS = 50_000
#: Vectors are learnt from in parts of this many to one.
STEP = 2**20
#: Vectors that a task compares with the centres at once.
GATHERED = 4096


@dataclass
class Targets:
    """Shares by dimension: given shares, or the corpus' own tempered by a power below one."""

    shares: dict[str, dict[str, float]] = field(default_factory=dict)
    power: float = 0.5
    budget: float = 0.6  #: tokens to draw, as a share of the corpus
    rounds: int = 300
    tolerance: float = 1e-6
    seed: int = 17


@dataclass
class Topics:
    """How topics are learnt: from all documents, or, if `sample` is given, from that many at most."""

    k: int = 8
    dims: int = 64
    sample: int | None = None
    rounds: int = 25
    trials: int = 8
    seed: int = 11


def word_vector(text: bytes, dims: int) -> tuple[np.ndarray, int]:
    """Damped counts of the hashed words of `text`, of length one (or zero), and the number of words."""
    words = text.split()
    out = np.zeros(dims)
    if words:
        counts = Counter(words)
        at = np.fromiter(map(zlib.crc32, counts), np.int64, len(counts)) % dims
        out = np.log1p(np.bincount(at, np.fromiter(counts.values(), float, len(counts)), dims))
        out /= np.linalg.norm(out)
    return out, len(words)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1)


class TopicModel:
    """Means of the languages and centres of the topics."""

    def __init__(self, dims: int, mean: np.ndarray, means: dict[str, np.ndarray], centres: np.ndarray | None = None):
        self.dims, self.mean, self.means = dims, mean, means
        self.centres = np.zeros((1, dims)) if centres is None else centres

    def centred(self, vectors: np.ndarray, langs: list[str]) -> np.ndarray:
        return vectors - np.array([self.means.get(lang, self.mean) for lang in langs]).reshape(vectors.shape)

    def topics(self, vectors: np.ndarray, langs: list[str], n: list[int]) -> list[str]:
        """Topics of vectors in steps; a text without words has the topic `(empty)`."""
        near = nearest(self.centred(vectors / STEP, langs), self.centres)
        return [f"topic {c}" if k else "(empty)" for c, k in zip(near, n, strict=True)]


def _measured(docs: DataFrame, how: Topics, keep: list[str]) -> tuple[DataFrame, str]:
    """Columns `keep` of the documents and a struct of the returned name, stored once: `DIMENSIONS` but the topic, a hash,
    n_tokens and the vector (null without words). The texts are read for this only."""

    @F.arrow_udf("n_tokens long, v binary")
    def vector(texts: pa.Array) -> pa.Array:
        found = [word_vector(t or b"", how.dims) for t in texts.cast(pa.binary()).to_pylist()]
        vectors = [np.rint(v * STEP).astype(np.int32).tobytes() if v.any() else None for v, _ in found]
        return pa.StructArray.from_arrays([pa.array([n for _, n in found], pa.int64()), pa.array(vectors, pa.binary())], ["n_tokens", "v"])

    of, seen = fresh(docs, "_measured"), fresh(docs, "_vector")
    rows = small_batches(docs).withColumn(seen, vector(F.col("text").cast("string")))
    named = [F.coalesce(F.col(d).cast("string"), F.lit("(none)")).alias(d) for d in ("source", "lang")]
    whole = F.struct(*named, F.xxhash64("doc_id", "text").alias("draw"), F.col(f"{seen}.n_tokens"), F.col(f"{seen}.v"))
    return stored(rows.select(*keep, whole.alias(of)), "vectors"), of


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int32).reshape(-1, dims)


def _means(vectors: DataFrame, how: Topics) -> TopicModel:
    """The means of all vectors and of each language's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            x, of = _matrix(batch["v"], how.dims), np.array(batch["lang"].to_pylist(), dtype=object)
            for lang in set(of):
                mine = x[of == lang]
                sums[lang] = sums.get(lang, 0) + np.append(mine.sum(axis=0), len(mine))
        yield pa.record_batch([pa.array(list(sums), pa.string()), pa.array([s.tolist() for s in sums.values()], pa.list_(pa.int64()))], ["lang", "sums"])

    parts = vectors.select("lang", "v").mapInArrow(run, "lang string, sums array<long>")
    got = parts.groupBy("lang").agg(F.array(*(F.sum(F.get("sums", F.lit(i))) for i in range(how.dims + 1))).alias("sums")).orderBy("lang").collect()
    sums = {r["lang"]: np.array(r["sums"], float) for r in got}
    total = sum(sums.values()) if sums else np.ones(how.dims + 1) * 0.0
    return TopicModel(how.dims, total[:-1] / max(1.0, total[-1]) / STEP, {k: x[:-1] / x[-1] / STEP for k, x in sums.items()})


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `GATHERED`: Arrow batches of a session with texts are small."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= GATHERED:
            yield pa.concat_batches(held)
            held, n = [], 0
    if n:
        yield pa.concat_batches(held)


def _centred(batch: pa.RecordBatch, mean: np.ndarray, means: dict[str, np.ndarray], dims: int) -> np.ndarray:
    """A batch's vectors less the means of their languages: whole steps, as floats, whose sums are exact."""
    langs = batch["lang"].dictionary_encode()
    offsets = np.rint(np.array([means.get(k, mean) for k in langs.dictionary.to_pylist()]) * STEP).reshape(-1, dims)
    return _matrix(batch["v"], dims) - offsets[langs.indices.to_numpy(zero_copy_only=False)]


def _farthest(vectors: DataFrame, model: TopicModel, how: Topics, starts: list[list[np.ndarray]]) -> list:
    """The next centre of each trial, (trial, best): a vector drawn in proportion to its squared distance to the trial's `starts`."""
    shared = vectors.sparkSession.sparkContext.broadcast((model.mean, model.means))
    sizes = np.array([len(c) for c in starts])
    centres = np.array([c for trial in starts for c in trial]).reshape(-1, how.dims)
    seeds = np.array([(how.seed * 1_000_003 + trial * 8191 + n) * 0x9E3779B97F4A7C15 % 2**64 for trial, n in enumerate(sizes.tolist())], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[float, list[int]]] = {}
        for batch in _gathered(batches):
            x = _centred(batch, *shared.value, how.dims)
            d = np.ones((len(x), len(sizes)))
            if len(centres):
                far = _far(x, centres)
                for trial, (end, n) in enumerate(zip(np.cumsum(sizes), sizes, strict=True)):
                    if n:
                        d[:, trial] = far[:, end - n : end].min(axis=1)
            # The greatest of u ** (1 / d) is a draw in proportion to d; u comes from the row's hash.
            mixed = (batch["draw"].to_numpy(zero_copy_only=False).astype(np.uint64)[:, None] ^ seeds) * np.uint64(0xBF58476D1CE4E5B9)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            u = ((mixed ^ (mixed >> np.uint64(32))) >> np.uint64(11)).astype(float) / 2.0**53
            ranks = np.where(d > 0, np.log(u + 2.0**-60) / np.maximum(d, 1e-300), -np.inf)
            for trial, i in enumerate(ranks.argmax(axis=0).tolist()):
                if (rank := float(ranks[i, trial])) > -np.inf:
                    best[trial] = max(best.get(trial, (-np.inf, [])), (rank, x[i].astype(np.int64).tolist()))
        yield pa.record_batch([pa.array(list(best), pa.int32()), pa.array([r for r, _ in best.values()], pa.float64()), pa.array([v for _, v in best.values()], pa.list_(pa.int64()))], ["trial", "rank", "best"])

    parts = vectors.select("lang", "draw", "v").mapInArrow(trimmed(run), "trial int, rank double, best array<long>")
    got = parts.groupBy("trial").agg(F.max(F.struct("rank", "best")).alias("x")).select("trial", "x.best").collect()
    shared.unpersist()
    return sorted(got, key=lambda r: r["trial"])


def _nearest(vectors: DataFrame, model: TopicModel, how: Topics, at: list[np.ndarray]) -> list:
    """Of each trial's centres `at`, (trial, centre, sums, cost) of the vectors to which they are the nearest; the last sum is their number."""
    shared = vectors.sparkSession.sparkContext.broadcast((model.mean, model.means))
    ends = np.cumsum([len(c) for c in at]).tolist()
    begins, centres = [0, *ends[:-1]], np.concatenate(at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, costs = np.zeros((len(centres), how.dims + 1)), np.zeros(len(centres), np.int64)
        for batch in _gathered(batches):
            x = _centred(batch, *shared.value, how.dims)
            scores, far = x @ centres.T - (centres**2).sum(axis=1) / 2, _far(x, centres)
            mine = np.zeros(scores.shape)
            for begin, end in zip(begins, ends, strict=True):
                of = begin + scores[:, begin:end].argmax(axis=1)
                mine[np.arange(len(x)), of] = 1.0
                d = far[:, begin:end].min(axis=1) // STEP
                costs += np.bincount(of, d, len(centres)).astype(np.int64)
            sums += mine.T @ np.column_stack((x, np.ones(len(x))))
        hit = np.flatnonzero(sums[:, -1])
        trials = np.searchsorted(ends, hit, side="right")
        rows = pa.array(sums[hit].astype(np.int64).tolist(), pa.list_(pa.int64()))
        yield pa.record_batch([pa.array(trials, pa.int32()), pa.array(hit - np.array(begins)[trials], pa.int32()), rows, pa.array(costs[hit], pa.int64())], ["trial", "centre", "sums", "cost"])

    parts = vectors.select("lang", "v").mapInArrow(trimmed(run), "trial int, centre int, sums array<long>, cost long")
    sums = F.array(*(F.sum(F.get("sums", F.lit(i))) for i in range(how.dims + 1))).alias("sums")
    got = parts.groupBy("trial", "centre").agg(sums, F.sum("cost").alias("cost")).collect()
    shared.unpersist()
    return got


def _far(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances to each of `centres`, both in steps, as whole numbers."""
    return np.maximum(0.0, np.rint((x**2).sum(axis=1)[:, None] - 2.0 * (x @ centres.T) + (centres**2).sum(axis=1)))


def learn_topics(docs: DataFrame, how: Topics | None = None) -> TopicModel:
    """A model of the documents with words: k-means from several starts at once, a pass over all vectors for each round."""
    how = how or Topics()
    rows, of = _measured(docs, how, [])
    return _learnt(rows.select(f"{of}.*"), how)


def _learnt(measured: DataFrame, how: Topics) -> TopicModel:
    vectors = measured.where("v is not null")
    if how.sample is not None:
        vectors = stored(vectors.orderBy("draw", "lang").limit(how.sample), "sampled")
    model = _means(vectors, how)
    if not model.means:
        return model
    starts: list[list[np.ndarray]] = [[] for _ in range(how.trials)]
    for _ in range(how.k):
        for r in (got := _farthest(vectors, model, how, starts)):
            starts[r["trial"]].append(np.array(r["best"], float))
        if not got:
            break
    at = [np.array(s) for s in starts]
    costs = [0] * how.trials
    for i in range(how.rounds + 1):  # the last one for the costs
        moved, costs = [c.copy() for c in at], [0] * how.trials
        for r in _nearest(vectors, model, how, at):
            moved[r["trial"]][r["centre"]] = np.array(r["sums"][:-1], float) / r["sums"][-1]
            costs[r["trial"]] += r["cost"]
        if i == how.rounds or all(np.allclose(a, b, atol=STEP * 1e-8) for a, b in zip(moved, at, strict=True)):
            break
        at = moved
    model.centres = at[int(np.argmin(costs))] / STEP
    return model


def _topic(model: TopicModel, spark: SparkSession) -> Callable[[Column, Column, Column], Column]:
    """The topic by a stored vector, language and number of words."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("string")
    def topic(vectors: pa.Array, langs: pa.Array, n: pa.Array) -> pa.Array:
        none = np.zeros(shared.value.dims, np.int32).tobytes()
        x = np.frombuffer(b"".join(v or none for v in vectors.to_pylist()), np.int32).reshape(-1, shared.value.dims)
        return pa.array(shared.value.topics(x, langs.to_pylist(), n.to_pylist()), pa.string())

    return topic


def n_tokens() -> Column:
    """Words separated by white space."""
    t = F.trim(F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), r"\s+", " "))
    return F.when(t == "", F.lit(0)).otherwise(F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1).cast("long")


def goal(totals: np.ndarray, values: list[str], given: dict[str, float] | None, targets: Targets) -> np.ndarray:
    """Tokens to draw of each of `values`, whose totals are `totals`: none above its total."""
    want = np.array([given.get(v, 0.0) for v in values]) if given else np.power(totals, targets.power)
    want = np.where(totals > 0, want, 0.0)
    left, full = targets.budget * totals.sum(), np.zeros(len(totals), bool)
    out = np.zeros(len(totals))
    while want[~full].sum() > 0:
        out = np.where(full, totals, want / want[~full].sum() * max(0.0, left - totals[full].sum()))
        over = ~full & (out > totals)
        if not over.any():
            break
        full |= over
    return np.minimum(out, totals)


def report(worst: float, targets: Targets, reached: list[tuple[str, float, float]] = ()) -> None:
    """Warns if targets can't be met together; `reached` are names, wanted and reached shares of the tokens to draw."""
    if worst > max(targets.tolerance, 1e-3):
        nearest_ones = "; ".join(f"{name} reaches {have:.2%} of {want:.2%}" for name, want, have in sorted(reached, key=lambda x: -abs(x[1] - x[2])) if abs(want - have) > 1e-3)
        warnings.warn(f"targets are missed by up to {worst:.2%} of the drawn tokens" + (f": {nearest_ones}" if nearest_ones else ""), stacklevel=3)


def rake_small(cells, targets: Targets):
    """Adds the `share` to draw to a pandas table of cells with `tokens`."""
    tokens, share = cells["tokens"].to_numpy(float), np.full(len(cells), targets.budget)
    margins, worst = [], 0.0
    for d in DIMENSIONS:
        code, values = cells[d].factorize(sort=True)
        margins.append((code, goal(np.bincount(code, tokens, len(values)), list(values), targets.shares.get(d), targets)))
    for _ in range(targets.rounds):
        worst = 0.0
        for code, want in margins:
            have = np.bincount(code, tokens * share, len(want))
            worst = max(worst, np.abs(have - want).max(initial=0.0) / max(targets.budget * tokens.sum(), 1.0))
            scale = np.divide(want, have, out=np.zeros_like(want), where=have > 0)
            share = np.where(tokens > 0, np.minimum(1.0, share * scale[code]), share)
        if worst < targets.tolerance:
            break
    budget = max(targets.budget * tokens.sum(), 1.0)
    names = [[f"{d}={v}" for v in cells[d].factorize(sort=True)[1]] for d in DIMENSIONS]
    report(worst, targets, [x for of, (code, want) in zip(names, margins, strict=True) for x in zip(of, want / budget, np.bincount(code, tokens * share, len(want)) / budget, strict=True)])
    return cells.assign(share=share)


def rake_large(cells: DataFrame, targets: Targets) -> DataFrame:
    """`rake_small` for tables of cells that the driver should not hold."""
    total = cells.agg(F.sum("tokens")).first()[0] or 0.0
    wants, worst = {}, 0.0
    for d in DIMENSIONS:
        sums = cells.groupBy(d).agg(F.sum("tokens").alias("has"))
        if given := targets.shares.get(d):
            pairs = F.create_map(*[F.lit(x) for kv in given.items() for x in kv])
            ask = F.coalesce(F.try_element_at(pairs, F.col(d)), F.lit(0.0))
        else:
            ask = F.pow("has", F.lit(targets.power))
        sums = cut(sums.select(d, "has", F.when(F.col("has") > 0, ask).otherwise(0.0).alias("ask"), F.lit(False).alias("full")))
        while True:  # as in `goal`
            held, asked = sums.agg(F.sum(F.when(F.col("full"), F.col("has")).otherwise(0.0)), F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("ask")))).first()
            want = F.when(F.col("full"), F.col("has")).otherwise(F.col("ask") / (asked or 1.0) * max(0.0, targets.budget * total - (held or 0.0)))
            if not asked or sums.where(~F.col("full") & (want > F.col("has"))).isEmpty():
                break
            sums = cut(sums.withColumn("full", F.col("full") | (want > F.col("has"))))
        wants[d] = cut(sums.select(d, F.least(want, F.col("has")).alias("want")))
    cells = cells.withColumn("share", F.lit(targets.budget))
    for _ in range(targets.rounds):
        worst = 0.0
        for d in DIMENSIONS:
            have = cells.groupBy(d).agg(F.sum(F.col("tokens") * F.col("share")).alias("have")).join(wants[d], d)
            both = cut(cells.select(*DIMENSIONS, "tokens", "share").join(have, d))
            worst = max(worst, (both.agg(F.max(F.abs(F.col("have") - F.col("want")))).first()[0] or 0.0) / max(targets.budget * total, 1.0))
            scaled = F.least(F.lit(1.0), F.col("share") * F.when(F.col("have") > 0, F.col("want") / F.col("have")).otherwise(0.0))
            cells = both.select(*DIMENSIONS, "tokens", F.when(F.col("tokens") > 0, scaled).otherwise(F.col("share")).alias("share"))
        if worst < targets.tolerance:
            break
    report(worst, targets)
    return cut(cells)


def mix(docs: DataFrame, targets: Targets | None = None, small_cells: int = SMALL_CELLS, topic: Column | None = None, topics: Topics | None = None, keep: list[str] | None = None) -> DataFrame:
    """`docs`, or their columns `keep` (doc_id, source and lang among them), with topic, n_tokens, weight, probability and the decision `drawn`."""
    targets = targets or Targets()
    has_topic = "topic" in (c.lower() for c in docs.columns)
    named = docs.drop("n_tokens", "weight", "probability", "drawn")
    if topic is None and not has_topic:
        # Texts are read once: what follows reads the stored columns. Parquet holds no columns without a type.
        keep = keep or named.columns
        void = [c for c, kind in named.select(*keep).dtypes if kind == "void"]
        kept, of = _measured(named, topics or Topics(), [c for c in keep if c not in void])
        kept = kept.select(*(F.lit(None).alias(c) if c in void else c for c in keep), of)
        topic_of = _topic(_learnt(kept.select(f"{of}.*"), topics or Topics()), docs.sparkSession)
        named = kept.withColumns({"topic": topic_of(F.col(f"{of}.v"), F.col(f"{of}.lang"), F.col(f"{of}.n_tokens")), "n_tokens": F.col(f"{of}.n_tokens")}).drop(of)
    else:
        named = named.withColumn("n_tokens", n_tokens())
        named = named if topic is None else named.withColumn("topic", topic)
        named = named if keep is None else named.select(*dict.fromkeys((*keep, "topic", "n_tokens")))
    names = {d: fresh(named, f"_{d}") for d in DIMENSIONS}
    named = named.withColumns({names[d]: F.coalesce(F.col(d).cast("string"), F.lit("(none)")) for d in DIMENSIONS})
    cells = cut(named.groupBy(*(F.col(names[d]).alias(d) for d in DIMENSIONS)).agg(F.sum("n_tokens").cast("double").alias("tokens")))
    small = cells.count() <= small_cells
    if small:
        local = rake_small(cells.toPandas().sort_values(list(DIMENSIONS), ignore_index=True), targets)
        raked = docs.sparkSession.createDataFrame(local, cells.schema.add("share", "double"))
    else:
        raked = rake_large(cells, targets)
    raked = raked.select(*(F.col(d).alias(names[d]) for d in DIMENSIONS), F.col("share").alias("probability"))
    chance = F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.lit(targets.seed)), 11) / F.lit(float(1 << 53))
    out = named.join(F.broadcast(raked) if small else raked, list(names.values()), "left").drop(*names.values())
    out = out.withColumn("weight", F.col("probability") / targets.budget)
    return out.withColumn("drawn", chance < F.col("probability"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raked weight, inclusion probability and decision of every document."""
    return mix(table(spark, sf_dir, "documents"), keep=["doc_id", "source", "lang"]).select("doc_id", "source", "lang", "topic", "n_tokens", "weight", "probability", "drawn")
