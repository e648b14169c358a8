"""The trie of conversation prefixes, rolled up by pointer jumping.

Every turn becomes two 64-bit codes of its place, role and text, and a prefix
is known by the XOR of its turns' codes, so that a node's parent edge follows
from its own row: parent digest = digest XOR last turn. Leaf counts and saved
tokens then reach all ancestors in rounds that double the distance: after
round k a node holds the sums of its descendants nearer than 2^k, and adds
those of the nodes whose pointer, 2^k up, is it. Nodes without a pointer and
without an addition leave the rounds. Texts are never shuffled, only their
MD5; a conversation of any length is numbered and summed in stretches, and a
node's members are only counted.

Defined results: turns are ordered by number (null first), those of equal
numbers by role and then by the MD5 of the text, and repeated turns count as
often as they occur; a null role or text is empty; rows without conv_id belong
to no conversation and are left out; a conversation that is rebuilt without
turns is a member of the root alone; conv_id - conv_id % 20 is computed as SQL
does, so that negative ids lean on ids nearer to zero; an empty table has no
nodes; columns besides the four named ones are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored, table, workspace

#: Conversations lean on the first of so many, by at most `HEAD` turns.
FAMILY, HEAD = 20, 3
#: Turns of a conversation that are summed in one task.
STRETCH = 4096
#: Characters of a piece of a list of members.
PIECE = 1 << 16


def ordered(turns: DataFrame, folder: str) -> DataFrame:
    """conv_id, pos (from 1), two content codes and the words of every turn.

    Equal turns are counted before the shuffle. The order is cut into ranges;
    turns are numbered within a range, and a conversation that began in an
    earlier one gets the number of its turns there: at most one conversation
    in each range, so these numbers can be broadcast.
    """
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    n_words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = turns.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"), F.md5(text).alias("code"), n_words.alias("words"))
    rows = rows.groupBy("conv_id", "turn", "role", "code").agg(F.first("words").alias("words"), F.count("*").alias("n"))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("code")]
    rows = stored(rows.repartitionByRange("conv_id", *order).withColumn("range", F.spark_partition_id()), "turns", folder)
    rows = rows.withColumn("end", F.sum("n").over(Window.partitionBy("conv_id", "range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    firsts = rows.groupBy("range").agg(F.min("conv_id").alias("conv_id"))
    within = rows.join(F.broadcast(firsts.select("conv_id").distinct()), "conv_id").groupBy("conv_id", "range").agg(F.sum("n").alias("n"))
    before = within.select("conv_id", "range", F.sum("n").over(Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)).alias("before")).where("before is not null")
    rows = rows.join(F.broadcast(before), ["conv_id", "range"], "left").withColumn("end", F.col("end") + F.coalesce("before", F.lit(0)))
    pos = F.explode(F.sequence(F.col("end") - F.col("n") + 1, F.col("end"))).alias("pos")
    return rows.select("conv_id", pos, F.xxhash64("role", "code").alias("c1"), F.xxhash64("code", "role").alias("c2"), "words")


def rebuilt(own: DataFrame) -> DataFrame:
    """Turns of the rebuilt conversations with their number of turns `len`, and a textless one at place 0 for each."""
    heads = own.where((F.col("conv_id") % FAMILY == 0) & (F.col("pos") <= HEAD)).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "c1", "c2", "words"))).alias("turns"))
    c, taken = F.col("conv_id"), F.least(F.col("h"), F.coalesce(F.size("turns"), F.lit(0)))
    plan = own.groupBy("conv_id").agg(F.max("pos").alias("n"))
    plan = plan.withColumn("h", F.when(c % FAMILY == 0, 0).otherwise(F.crc32(c.cast("string")) % (HEAD + 1)).cast("int"))
    plan = plan.join(heads.select((F.col("conv_id")).alias("base"), "turns"), (c - c % FAMILY == F.col("base")) & (F.col("h") > 0), "left").withColumn("k", F.when(F.col("h") > 0, taken).otherwise(0))
    plan = plan.withColumn("len", F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    kept = own.join(plan.select("conv_id", "h", "k", "len"), "conv_id").where(F.col("pos") > F.col("h"))
    kept = kept.select("conv_id", "len", (F.col("pos") - F.col("h") + F.col("k")).alias("pos"), "c1", "c2", "words")
    lent = plan.where("k > 0").select("conv_id", "len", F.inline(F.slice("turns", F.lit(1), F.col("k")))).select("conv_id", "len", "pos", "c1", "c2", "words")
    nothing = [F.lit(0).cast("long").alias(x) for x in ("pos", "c1", "c2", "words")]
    return kept.unionAll(lent).unionAll(plan.select("conv_id", "len", *nothing))


def prefixes(turns: DataFrame, folder: str, stretch: int = STRETCH) -> DataFrame:
    """`turns` with their own codes z1, z2 and the digests p1, p2 of the prefixes that they end."""
    code = lambda *c: F.when(F.col("pos") > 0, F.xxhash64(*c)).otherwise(F.lit(0))
    rows = turns.select("conv_id", "len", "pos", "words", code("pos", "c1", "c2").alias("z1"), code("c2", "c1", "pos").alias("z2"), F.floor(F.col("pos") / stretch).alias("stretch"))
    so_far = Window.partitionBy("conv_id", "stretch").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = stored(rows.withColumns({"p1": F.bit_xor("z1").over(so_far), "p2": F.bit_xor("z2").over(so_far)}), "prefixes", folder)
    long = F.col("len") >= stretch
    if rows.where(long).isEmpty():
        return rows
    sums = rows.where(long).groupBy("conv_id", "stretch").agg(F.bit_xor("z1").alias("z1"), F.bit_xor("z2").alias("z2"))
    earlier = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("conv_id", "stretch", F.bit_xor("z1").over(earlier).alias("b1"), F.bit_xor("z2").over(earlier).alias("b2"))
    joined = rows.where(long).join(before, ["conv_id", "stretch"], "left")
    moved = lambda p, b: F.col(p).bitwiseXOR(F.coalesce(F.col(b), F.lit(0))).alias(p)
    return rows.where(~long).unionByName(joined.select(*(c for c in rows.columns if c not in ("p1", "p2")), moved("p1", "b1"), moved("p2", "b2")))


def digests_of_ends(ends: DataFrame) -> DataFrame:
    """The digest of the ascending, comma-joined conv_ids of each (depth, p1, p2).

    Ranges of the sorted ids give pieces of text, and each node's pieces are
    hashed one after the other: a task holds a piece, however many ids there are.
    """
    key = ["depth", "p1", "p2"]
    types = [pa.int64(), pa.int64(), pa.int64()]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, first, held, size, out = None, 0, [], 0, []
        for batch in batches:
            for *at, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != node or size > PIECE:
                    if held:
                        out.append((*node, first, ",".join(held)))
                    node, first, held, size = at, conv, [], 0
                held.append(str(conv))
                size += len(held[-1]) + 1
            if out:
                yield made(out, [*types, pa.int64(), pa.string()], [*key, "first", "text"])
                out = []
        if held:
            yield made([(*node, first, ",".join(held))], [*types, pa.int64(), pa.string()], [*key, "first", "text"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state, out = None, None, []
        for batch in batches:
            for *at, _, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at == node:
                    state.update(b"," + text.encode())
                    continue
                if node is not None:
                    out.append((*node, state.hexdigest()))
                node, state = at, hashlib.sha256(text.encode())
            if out:
                yield made(out, [*types, pa.string()], [*key, "ends_sha256"])
                out = []
        if node is not None:
            yield made([(*node, state.hexdigest())], [*types, pa.string()], [*key, "ends_sha256"])

    def made(rows, kinds, names) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    cut = ends.repartitionByRange(*key, "conv_id").sortWithinPartitions(*key, "conv_id").select(*key, "conv_id").mapInArrow(pieces, "depth long, p1 long, p2 long, first long, text string")
    return cut.repartition(*key).sortWithinPartitions(*key, "first").mapInArrow(hashed, "depth long, p1 long, p2 long, ends_sha256 string")


NODE = ("depth", "p1", "p2")


def _keyed(prefix: str) -> list[Column]:
    return [F.col(c).alias(f"{prefix}_{c}") for c in NODE]


def _meets(prefix: str) -> Column:
    out = F.col("depth") == F.col(f"{prefix}_depth")
    for c in NODE[1:]:
        out = out & (F.col(c) == F.col(f"{prefix}_{c}"))
    return out


def rolled_up(nodes: DataFrame, measures: list[str], folder: str) -> DataFrame:
    """`nodes` (depth, p1, p2, up1, up2: the parent's digest) with each of `measures` summed over the subtree.

    One round for each doubling of the depth; what no longer changes is set aside.
    """
    live, aside, step = nodes, [], 1
    while True:
        added = live.where(F.col("depth") >= step).groupBy((F.col("depth") - step).alias("_depth"), F.col("up1").alias("_p1"), F.col("up2").alias("_p2")).agg(*(F.sum(m).alias(f"_{m}") for m in measures))
        after = live.join(added, _meets(""), "left")
        sums = [(F.col(m) + F.coalesce(F.col(f"_{m}"), F.lit(0))).alias(m) for m in measures]
        rest = [c for c in nodes.columns if c not in (*measures, "up1", "up2")]
        after = after.select(*rest, "up1", "up2", *sums, F.col("_depth").isNotNull().alias("_added"))
        # The pointer twice as far up is the pointer's pointer.
        higher = live.where(F.col("depth") >= step).select(*_keyed("to"), F.col("up1").alias("_up1"), F.col("up2").alias("_up2"))
        far = F.col("depth") >= 2 * step
        pointers = (F.col("depth") - step == F.col("to_depth")) & (F.col("up1") == F.col("to_p1")) & (F.col("up2") == F.col("to_p2"))
        jumped = after.where(far).join(higher, pointers).select(*rest, F.col("_up1").alias("up1"), F.col("_up2").alias("up2"), *measures, F.lit(True).alias("_live"))
        near = after.where(~far).select(*rest, F.lit(None).cast("long").alias("up1"), F.lit(None).cast("long").alias("up2"), *measures, F.col("_added").alias("_live"))
        now = stored(jumped.unionAll(near), f"round-{step}", folder)
        aside.append(now.where("not _live").drop("_live"))
        live, step = now.where("_live").drop("_live"), 2 * step
        if live.isEmpty():
            break
    out = aside[0]
    for x in aside[1:]:
        out = out.unionAll(x)
    return out


def trie(turns: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """A row for each distinct prefix of the rebuilt conversations.

    The result is written to the shared folder; all that led to it is deleted.
    """
    with workspace(turns.sparkSession) as folder:
        own = stored(ordered(turns, folder), "own", folder)
        rows = prefixes(rebuilt(own), folder, stretch).withColumnRenamed("pos", "depth")
        nodes = rows.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("words"), F.min("z1").alias("z1"), F.min("z2").alias("z2"))
        # A node's pointer starts at its parent; the root has none.
        up = lambda p, z: F.when(F.col("depth") > 0, F.col(p).bitwiseXOR(F.col(z)))
        nodes = stored(nodes.select(*NODE, up("p1", "z1").alias("up1"), up("p2", "z2").alias("up2"), "conv_id", "n_convs", ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens")), "nodes", folder)
        root = nodes.where("depth = 0").agg(F.min("conv_id")).first()[0]
        # All first turns share the root, so that they don't look for it in the join.
        parents = nodes.select(*_keyed("to"), F.col("conv_id").alias("parent_conv_id"))
        inner = nodes.where("depth > 1").join(parents, (F.col("depth") - 1 == F.col("to_depth")) & (F.col("up1") == F.col("to_p1")) & (F.col("up2") == F.col("to_p2")))
        top = nodes.where("depth <= 1").withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(root)).cast("long"))
        nodes = inner.select(*nodes.columns, "parent_conv_id").unionByName(top)
        children = stored(nodes, "edges", folder)
        counts = children.where("depth > 0").groupBy((F.col("depth") - 1).alias("_depth"), F.col("up1").alias("_p1"), F.col("up2").alias("_p2")).agg(F.count("*").alias("n_children"))
        nodes = children.join(counts, _meets(""), "left").select(*children.columns, F.coalesce("n_children", F.lit(0)).alias("n_children"))
        nodes = stored(nodes.withColumn("n_leaves", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long")), "start", folder)
        sums = rolled_up(nodes, ["n_leaves", "saved_tokens"], folder)
        ends = digests_of_ends(rows.where("depth = len").select(*NODE, "conv_id")).select(*_keyed("e"), "ends_sha256")
        out = sums.join(ends, _meets("e"), "left")
        columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
        return stored(out.select(*(F.col(c).cast("long") for c in columns), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")), "trie")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All distinct prefixes of all rebuilt conversations."""
    return trie(table(spark, sf_dir, "conversations"))
