"""Embedding near-duplicates by rotated binary codes.

A vector is scaled to length one and turned by a random orthonormal frame; the
signs of its coordinates are its code. Beside the code stands a correction
factor, the inner product of the coded and the turned vector: dividing by it
makes the inner product of a code with another unit vector an unbiased
estimate of the cosine, whose error lies within a bound known from the factor.
`coded` computes code, factor and the unit vector in bytes (the other side of
an estimate) once for each vector, and only these are compared. Pairs whose
upper bound is below the threshold are rejected by it; for all others the
vectors themselves are fetched and the cosine is computed again in double
precision, and only those exact values decide.

Which pairs are looked at follows from the code, too: it is cut into bands of
bits, and vectors of one label meet where they agree on a band. The bits of a
band grow with the logarithm of the largest label and the number of bands
follows from the bits, so that a pair at the threshold is missed with a
probability of at most `MISS`; closer pairs are missed less often still.

Equal vectors are one vertex with a count. The members of a band's value are
dealt into chunks by hash and each task compares two chunks, however many
vectors agree. It passes on, for each vector, which of the other chunk stay
open, and after the exact comparison how many links each vector has and a
spanning forest of them, so no list of all links is ever made. A pair that
agrees on several bands is taken from the first.

Defined results: a vector that is null, empty, zero or holds null or
non-finite components, or whose label or id is null, links with nothing;
vectors of different lengths don't link; rows that repeat id and vector count
as copies; rows with equal ids and different vectors share the larger count and
the smaller component; an empty table gives an empty result; extra columns are
not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, salted_join, stored, table, trimmed, workspace

#: Chance of missing a pair at the threshold.
MISS = 1e-6
#: Standard errors that a bound allows.
ERRORS = 5.0
#: Vectors of a chunk, on average.
CHUNK = 256
#: Vectors up to which all groups of a batch are sieved together.
SMALL_GROUP = 64
#: Least bits of a code, which set the error of estimates.
LEAST_BITS = 256
SEED = 29
_frames: dict[tuple[int, int], np.ndarray] = {}


def frame(bits: int, size: int) -> np.ndarray:
    """A random `bits` x `size` matrix with orthonormal columns, the same everywhere."""
    if (bits, size) not in _frames:
        g = np.random.Generator(np.random.PCG64(SEED)).standard_normal((max(bits, size), size))
        _frames[bits, size] = np.linalg.qr(g)[0]
    return _frames[bits, size]


def bands_for(bits: int, threshold: float) -> int:
    agree = 1 - math.acos(threshold) / math.pi
    return math.ceil(math.log(MISS) / math.log1p(-(agree**bits)))


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # squares of very large or small components stay finite
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def codes(rows: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Signs of the turned unit vectors and their correction factors."""
    turned = unit(rows) @ frame(bits, rows.shape[1]).T
    signs = turned > 0
    return signs, np.abs(turned).sum(axis=1) / math.sqrt(turned.shape[1])


def in_bytes(rows: np.ndarray) -> np.ndarray:
    """Unit vectors with components in steps of 1/127 of one."""
    return np.rint(unit(rows) * 127).astype(np.int8)


def decoding(signs: np.ndarray, factor: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """What codes stand for, corrected, and by how much an estimate with each may be too low."""
    length = signs.shape[1]
    decoded = np.where(signs, 1.0, -1.0) @ frame(length, size) / math.sqrt(length) / factor[:, None]
    error = ERRORS * np.sqrt((1 - factor**2) / factor**2 / max(1, length - 1))
    return decoded, error + np.linalg.norm(decoded, axis=1) * math.sqrt(size) / 254


def upper_bounds(small: np.ndarray, signs: np.ndarray, factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimates of the cosines of vectors `in_bytes` with coded ones, and upper bounds of them."""
    decoded, slack = decoding(signs, factor, small.shape[1])
    estimate = (small / 127.0) @ decoded.T
    return estimate, estimate + slack


def valid_vectors(table_: DataFrame) -> DataFrame:
    rows = table_.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.where("vec_id is not null and label is not null and size(v) > 0")
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(~odd & F.exists("v", lambda x: x != 0))


def distinct_vectors(valid: DataFrame) -> DataFrame:
    """(uid, label, v, copies): one row for each different vector of a label."""
    return valid.groupBy("label", "h1", "h2").agg(F.min("vec_id").alias("uid"), F.count("*").alias("copies"), F.first("v").alias("v"))


def coded(vectors: DataFrame, bits: int, bands: int) -> DataFrame:
    """(uid, label, size, code, factor, small): what estimates need of each vector, in bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            sizes = lists.value_lengths().to_numpy()
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                for part in np.array_split(at, max(1, len(at) // 1000)):
                    rows = np.array(lists.take(pa.array(part)).flatten()).reshape(len(part), size)
                    signs, factor = codes(rows, max(LEAST_BITS, bits * bands))
                    packed = np.packbits(signs, axis=1)
                    columns = [batch.column(0).take(pa.array(part)), batch.column(1).take(pa.array(part)), pa.array(np.full(len(part), size, np.int32))]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([x.tobytes() for x in packed], pa.binary()), pa.array(factor), pa.array([x.tobytes() for x in in_bytes(rows)], pa.binary())], names=["uid", "label", "size", "code", "factor", "small"])

    return vectors.select("uid", "label", "v").mapInArrow(run, "uid long, label string, size int, code binary, factor double, small binary")


def signs_of(packed: list[bytes]) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), -1), axis=1).astype(bool)


def band_values(signs: np.ndarray, bits: int, bands: int) -> np.ndarray:
    return signs[:, : bits * bands].reshape(len(signs), bands, bits) @ (1 << np.arange(bits, dtype=np.int64))


def band_keys(marks: DataFrame, bits: int, bands: int) -> DataFrame:
    """(key, band, uid) for each band of each coded vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                n = part.num_rows
                by_width: dict[int, list[int]] = {}
                for i, code in enumerate(part.column(3).to_pylist()):
                    by_width.setdefault(len(code), []).append(i)
                for rows in by_width.values():
                    values = band_values(signs_of(part.column(3).take(pa.array(rows)).to_pylist()), bits, bands)
                    of = pa.array(np.repeat(rows, bands))
                    yield pa.RecordBatch.from_arrays([*(part.column(c).take(of) for c in (0, 1, 2)), pa.array(np.tile(np.arange(bands, dtype=np.int32), len(rows))), pa.array(values.ravel())], names=["uid", "label", "size", "band", "value"])

    rows = marks.select("uid", "label", "size", "code").mapInArrow(run, "uid long, label string, size int, band int, value long")
    return rows.select(F.xxhash64("label", "size", "band", "value").alias("key"), "band", "uid")


def by_group(rows: DataFrame, names: tuple[str, ...], work: Callable[[pa.Table], pa.Table], schema: str, sieve: Callable[[pa.Table, np.ndarray, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """`work` on each group of rows with equal `names` (numbers), many groups in a call.

    Groups come sorted, so that a task holds a batch and the group that goes on
    in the next one. `sieve` tells, for all groups of a batch at once, which
    need work at all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in chain(batches, [None]):
            parts = ([held] if held is not None else []) + ([pa.Table.from_batches([batch])] if batch is not None else [])
            if not parts or not sum(p.num_rows for p in parts):
                continue
            t = pa.concat_tables(parts).combine_chunks()
            keys = np.stack([t[c].to_numpy() for c in names])
            starts = np.flatnonzero(np.concatenate([[True], (np.diff(keys) != 0).any(axis=0)]))
            ends = np.append(starts[1:], t.num_rows)
            held = None
            if batch is not None:
                held, starts, ends = t.slice(starts[-1]), starts[:-1], ends[:-1]
            if sieve and len(starts):
                keep = sieve(t, starts, ends)
                starts, ends = starts[keep], ends[keep]
            for begin, end in zip(starts, ends, strict=True):
                yield from work(t.slice(begin, end - begin)).to_batches()

    return rows.repartition(*names).sortWithinPartitions(*names).mapInArrow(trimmed(run), schema)


def forest(pairs: np.ndarray) -> np.ndarray:
    """Those of `pairs` that join what wasn't joined before."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    keep = []
    for i, (a, b) in enumerate(pairs.tolist()):
        a, b = root(a), root(b)
        if a != b:
            parent[b] = a
            keep.append(i)
    return pairs[keep]


def still_open(marks: DataFrame, threshold: float, bits: int, bands: int, folder: str) -> DataFrame:
    """(key, x, y, uid, right, mask): the vectors of two chunks of a band's value whose upper bounds leave a pair open. The
    `mask` of a vector of chunk x has a bit for each listed vector of chunk y, by uid."""
    keys = stored(band_keys(marks, bits, bands), "keys", folder)
    common = stored(keys.groupBy("key").agg(F.count("*").alias("count"), F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks")).where("count > 1"), "common", folder)
    members = salted_join(keys, common.drop("count"), "key", "uid", common.select("key", "count"))
    members = members.withColumn("own", F.pmod(F.xxhash64("uid"), F.col("chunks")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    members = members.select("key", "band", "uid", "own", F.least("own", "with").alias("x"), F.greatest("own", "with").alias("y"))
    rows = members.join(marks.select("uid", "code", "factor", "small"), "uid")

    def sieve(t: pa.Table, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Groups with a pair that bounds leave open, and all that are not small."""
        sizes = ends - starts
        keep = sizes > SMALL_GROUP
        own, x, y, band = (t[c].to_numpy() for c in ("own", "x", "y", "band"))
        widths = np.stack([pc.binary_length(t[c]).to_numpy() for c in ("code", "small")])
        small_ones = np.flatnonzero((sizes > 1) & ~keep)
        for width in np.unique(widths[:, starts[small_ones]], axis=1).T:
            groups = small_ones[(widths[:, starts[small_ones]] == width[:, None]).all(axis=0)]
            # Rows of these groups, and all their pairs by group size.
            at = np.concatenate([np.arange(starts[g], ends[g]) for g in groups])
            first = np.concatenate([[0], np.cumsum(sizes[groups])])[:-1]
            i, j, of = [], [], []
            for n in np.unique(sizes[groups]):
                same = np.flatnonzero(sizes[groups] == n)
                a, b = np.triu_indices(n, 1)
                i.append((first[same][:, None] + a).ravel())
                j.append((first[same][:, None] + b).ravel())
                of.append(np.repeat(groups[same], len(a)))
            i, j, of = (np.concatenate(z) for z in (i, j, of))
            # Of two chunks only pairs across are compared.
            across = (x[at[i]] == y[at[i]]) | (own[at[i]] != own[at[j]])
            i, j, of = i[across], j[across], of[across]
            rows_at = pa.array(at)
            signs, factor = signs_of(t["code"].take(rows_at).to_pylist()), t["factor"].to_numpy()[at]
            small = np.frombuffer(b"".join(t["small"].take(rows_at).to_pylist()), np.int8).reshape(len(at), -1) / 127.0
            values = band_values(signs, bits, bands)
            decoded, slack = decoding(signs, factor, small.shape[1])
            for part in np.array_split(np.arange(len(i)), len(i) // 20_000 + 1):
                p, q = i[part], j[part]
                earlier = np.arange(bands) < band[at[p]][:, None]
                fresh = ~((values[p] == values[q]) & earlier).any(axis=1)
                part, p, q = part[fresh], p[fresh], q[fresh]
                maybe = np.einsum("ij,ij->i", small[p], decoded[q]) + slack[q] >= threshold
                maybe[maybe] = np.einsum("ij,ij->i", small[q[maybe]], decoded[p[maybe]]) + slack[p[maybe]] >= threshold
                keep[of[part[maybe]]] = True
        return keep

    def compare(group: pa.Table) -> pa.Table:
        group = group.sort_by("uid")
        x, y, band = (group[c][0].as_py() for c in ("x", "y", "band"))
        own, ids = group["own"].to_numpy(), group["uid"].to_numpy()
        signs, factor = signs_of(group["code"].to_pylist()), group["factor"].to_numpy()
        small = np.frombuffer(b"".join(group["small"].to_pylist()), np.int8).reshape(len(ids), -1).astype(np.float64)
        i, j = np.flatnonzero(own == x), np.flatnonzero(own == y)
        maybe = upper_bounds(small[i], signs[j], factor[j])[1] >= threshold
        maybe &= upper_bounds(small[j], signs[i], factor[i])[1].T >= threshold
        if x == y:
            maybe &= i[:, None] < j[None, :]
        values = band_values(signs, bits, band) if band else None
        for k in range(band):  # a pair that agreed on an earlier band was taken there
            maybe &= values[i, k][:, None] != values[j, k][None, :]
        rows, columns = maybe.any(axis=1), maybe.any(axis=0)
        masks = [m.tobytes() for m in np.packbits(maybe[rows][:, columns], axis=1)]
        uid = np.concatenate((ids[i[rows]], ids[j[columns]]))
        right = np.arange(len(uid)) >= rows.sum()
        n = len(uid)
        return pa.table({"key": pa.array([group["key"][0].as_py()] * n, pa.int64()), "x": pa.array(np.full(n, x, np.int32)), "y": pa.array(np.full(n, y, np.int32)), "uid": uid, "right": right, "mask": pa.array(masks + [None] * int(columns.sum()), pa.binary())})

    return by_group(rows, ("key", "x", "y"), compare, "key long, x int, y int, uid long, right boolean, mask binary", sieve)


def links(vectors: DataFrame, threshold: float, folder: str) -> DataFrame:
    """(uid, n, to): rows of counts of linked others by vector, and rows of links (uid, to) that span all. Links have an exact cosine of at least `threshold`."""
    largest = vectors.groupBy("label").count().agg(F.max("count")).first()[0] or 1
    bits = min(40, max(8, math.ceil(math.log2(largest)) + 2))
    bands = bands_for(bits, threshold)
    marks = stored(coded(vectors, bits, bands), "codes", folder)
    rows = stored(still_open(marks, threshold, bits, bands, folder), "open", folder).join(vectors.select("uid", "v", "copies"), "uid")

    def exact(group: pa.Table) -> pa.Table:
        group = group.sort_by("uid")
        right, ids, copies = (group[c].to_numpy() for c in ("right", "uid", "copies"))
        v = unit(np.array(group["v"].combine_chunks().flatten()).reshape(len(ids), -1))
        a, b = np.flatnonzero(~right), np.flatnonzero(right)
        mask = np.unpackbits(np.frombuffer(b"".join(group["mask"].take(pa.array(a)).to_pylist()), np.uint8).reshape(len(a), -1), axis=1, count=len(b)).astype(bool)
        i, j = np.nonzero(mask)
        i, j = a[i], b[j]
        cosine = np.concatenate([np.einsum("ij,ij->i", v[p], v[q]) for p, q in zip(np.array_split(i, len(i) // 50_000 + 1), np.array_split(j, len(i) // 50_000 + 1), strict=True)])
        i, j = i[cosine >= threshold], j[cosine >= threshold]
        n = np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))
        some, spanning = np.flatnonzero(n), forest(np.stack((ids[i], ids[j]), axis=1))
        uid = np.concatenate((ids[some], spanning[:, 0])).astype(np.int64)
        return pa.table({"uid": uid, "n": pa.array([*n[some].astype(np.int64).tolist(), *[None] * len(spanning)], pa.int64()), "to": pa.array([*[None] * len(some), *spanning[:, 1].tolist()], pa.int64())})

    return by_group(rows, ("key", "x", "y"), exact, "uid long, n long, to long")


def near_duplicates(table_: DataFrame, threshold: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector."""
    valid = valid_vectors(table_).withColumns({"h1": F.xxhash64("label", "v"), "h2": F.xxhash64(F.lit(SEED), "v", "label")})
    with workspace(table_.sparkSession) as folder:
        vectors = stored(distinct_vectors(valid), "vectors")
        found = stored(links(vectors, threshold, folder), "links")
    degree = found.where("n is not null").groupBy("uid").agg(F.sum("n").alias("others"))
    labels = components(found.where("to is not null").select(F.col("uid").alias("a"), F.col("to").alias("b"))).select(F.col("id").alias("uid"), "component_id")
    # A vector that very many rows share is dealt over several tasks.
    named = F.concat_ws(":", "h1", "h2", "label").alias("vector")
    known = vectors.join(degree, "uid", "left").join(labels, "uid", "left").select(named, F.col("copies").alias("count"), (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "uid").alias("component_id"))
    known = stored(known, "known")
    of_valid = salted_join(valid.select("vec_id", named), known.drop("count"), "vector", "vec_id", known.select("vector", "count")).groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = table_.select(F.col("vec_id").cast("long").alias("vec_id")).join(of_valid, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, component and decision of every embedding at cosine 0.98 within its label."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))
