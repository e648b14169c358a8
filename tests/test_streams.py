"""Keyed state of streams against plain loops, over several runs from one checkpoint."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from bandflow.operators import liquidations
from bandflow.streaming import books, buffers, dump, pipelines, queries, windows


@pytest.fixture
def folder(tmp_path):
    return f"file://{tmp_path}"


def in_runs(spark, folder, parts, schema, run):
    """Lands the parts one after the other and runs after each."""
    for part in parts:
        spark.createDataFrame(part, schema).repartition(2).write.mode("append").parquet(f"{folder}/landing")
        run(spark.readStream.schema(schema).parquet(f"{folder}/landing"))


# --- packets and windows
TRADES = "market string, ord long, timestamp long, seg int, side int, volume_usdt double"


def window_states(spark, folder, parts, sizes, block):
    run = lambda s: pipelines.run_now(windows.states(s, ("market",), sizes, block), f"{folder}/out", f"{folder}/checkpoint")
    in_runs(spark, folder, parts, TRADES, run)
    return spark.read.schema(f"market string, {windows.SCHEMA}").parquet(f"{folder}/out")


def by_loop(trades, sizes):
    """Packets in order of arrival and their windows, summed anew each time."""
    out = {}
    for market in {t[0] for t in trades}:
        packets = []
        for t in sorted((t for t in trades if t[0] == market), key=lambda t: t[1]):
            if not packets or packets[-1][0] != t[2] // 1000:
                packets.append((t[2] // 1000, []))
            packets[-1][1].append(t)
        for i in range(1, len(packets)):
            for n in sizes:
                inside = [t for _, p in packets[max(0, i - n) : i] for t in p if t[4] in (0, 1)]
                sums = [math.fsum(t[5] for t in inside if keep(t[4])) if not any(math.isinf(t[5]) and keep(t[4]) for t in inside) else math.inf for keep in (lambda s: True, lambda s: s == 0, lambda s: s == 1)]
                out[market, i, n] = (*sums, len(inside), min(i, n) / n * 100.0)
    return out


def test_windows_over_runs(spark, folder):
    rng = random.Random(1)
    trades, now = [], 5_000_000
    for i in range(400):
        now += rng.choice([0, 300, 900, 5000, -2500])  # seconds repeat, are left out, and come back
        trades.append((rng.choice(["spot", "futures"]), i, now, rng.randint(1, 14), rng.choice([0, 0, 1, 1, 7]), rng.choice([0.1, 1e-12, 250.5, 1e15 + 0.3, 3.3])))
    trades[150] = (*trades[150][:4], 0, math.inf)
    trades[200] = ("spot", 200, 9_000_000, 3, 1, 1e-12)
    parts = [trades[:130], trades[130:131], trades[131:290], trades[290:]]
    sizes = (1, 3, 7, 20)
    got = windows.rolling(window_states(spark, folder, parts, sizes, 4)).collect()
    want = by_loop(trades, sizes)
    assert len(got) == len(want) == len({(r["market"], r["packet"], r["window"]) for r in got})
    assert any(math.isinf(x[0]) for x in want.values()) and any(x[0] < 1e-9 for x in want.values())
    for r in got:
        x = want[r["market"], r["packet"], r["window"]]
        assert (r["vol_total"], r["vol_buy"], r["vol_sell"]) == pytest.approx(x[:3], rel=1e-12, abs=0), r
        assert (r["trades"], r["fill_pct"]) == x[3:]
    # The ring holds no more than the longest window and a block.
    ring = spark.read.format("statestore").option("stateVarName", "ring").load(f"{folder}/checkpoint")
    assert ring.groupBy("key").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] <= 20 / 4 + 2


def test_last_windows_never_reset(spark, folder):
    """Two hundred sold seconds after two hundred bought ones: of 180 packets all are sold."""
    trades = [("spot", i, 1_000_000 + 1000 * i, 1, int(i >= 200), 100.0) for i in range(401)]
    last = windows.latest(window_states(spark, folder, [trades[:250], trades[250:]], (180, 300), 64))
    row = last.where("window = 180").first()
    assert (row["vol_total"], row["sell_pct"], row["pct_vol"], row["trades"]) == (18000.0, 100.0, 100.0, 180)


# --- books
def message(symbol, ord, u_first, u, pu, b=(), a=(), snapshot=False):
    return (symbol, ord, snapshot, u_first, u, pu, list(b), list(a))


def exchange(seed, n=60):
    """Messages of a symbol with gaps, the book after each, and the snapshots that may be asked for."""
    rng = random.Random(seed)
    u, out, books_at = 0, [], [(0, {})]
    book = {}
    for i in range(n):
        first, u = u + 1, u + rng.randint(1, 3)
        b = [(float(rng.randint(90, 99)), float(rng.choice([0, 1, 2]))) for _ in range(rng.randint(0, 3))]
        a = [(float(rng.randint(101, 109)), float(rng.choice([0, 1, 2]))) for _ in range(rng.randint(0, 3))]
        for side, levels in (("bid", b), ("ask", a)):
            for p, q in levels:
                book[side, p] = q
        out.append(message("X", i, first, u, first - 1, b, a))
        books_at.append((u, {k: q for k, q in book.items() if q}))
    return out, books_at


@pytest.mark.parametrize("lost", [(), (20,), (20, 21, 40, 59)])
def test_book_is_the_exchanges_after_lost_messages(spark, folder, lost):
    """With snapshots of the exchange's book, lost messages leave no trace."""
    sent, at = exchange(len(lost))
    kept = [m for m in sent if m[1] not in lost]
    other = [("Y", *m[1:]) for m in sent]
    snapshots = {}

    def fetch(requests):
        rows = []
        for r in requests.collect():
            # The exchange has gone on meanwhile: one or two messages more.
            later = next(((u, b) for u, b in at if u > r["u"] + 1), at[-1])
            snapshots.setdefault(r["symbol"], []).append(later[0])
            level = lambda s: [(p, q) for (side, p), q in later[1].items() if side == s]  # noqa: E731, B023
            rows.append(message(r["symbol"], -1, 0, later[0], 0, level("bid"), level("ask"), True))
        return spark.createDataFrame(rows, books.MESSAGE)

    first = spark.createDataFrame([message("Y", -1, 0, 1, 0, snapshot=True)], books.MESSAGE)
    cut = len(kept) // 3
    parts = [kept[:cut] + other[:25], kept[cut : 2 * cut] + other[25:26], kept[2 * cut :] + other[26:]]
    in_runs(spark, folder, parts, books.MESSAGE, lambda s: books.follow_now(s, fetch, folder, first, rounds=8))
    got = {}
    for r in books.levels(spark, folder).collect():
        got.setdefault(r["symbol"], {})[r["side"], r["price"]] = r["qty"]
    want = at[-1][1]
    assert got.get("Y", {}) == want and "Y" not in snapshots
    kinds = {(r["symbol"], r["kind"]): r["n"] for r in books.events(spark, folder).groupBy("symbol", "kind").agg(F.count("*").alias("n")).collect()}
    assert kinds["Y", "applied"] == len(sent) and kinds["X", "request"] >= 1
    if 59 not in lost:
        assert got.get("X", {}) == want


class Exchange:
    """Answers with the book one update after the one that broke the sequence; requests of `vain` get nothing."""

    def __init__(self, at, vain=()):
        self.at, self.vain = at, vain

    def __call__(self, symbol, u):
        if u in self.vain:
            return None
        u, book = next(((x, b) for x, b in self.at if x > u + 1), self.at[-1])
        return u, *([(p, q) for (side, p), q in book.items() if side == s] for s in ("bid", "ask"))


def test_each_message_is_read_once_however_many_sequences_are_broken(spark, folder):
    """Thirty lost messages in one trigger: one batch, and the book is the exchange's."""
    sent, at = exchange(7, n=400)
    kept = [m for m in sent if m[1] % 13 != 6]
    run = lambda s: books.follow_at_once(s, Exchange(at), folder)
    in_runs(spark, folder, [kept[:350], kept[350:]], books.MESSAGE, run)
    assert {(r["side"], r["price"]): r["qty"] for r in books.levels(spark, folder).collect()} == at[-1][1]
    events = spark.read.parquet(f"{folder}/events").groupBy("kind", "batch").agg(F.count("*").alias("n")).collect()
    n = {(r["kind"], r["batch"]): r["n"] for r in events}
    assert n["request", 0] == n["snapshot", 0] > 20 and {r["batch"] for r in events} == {0, 1}
    assert sum(n.get((k, b), 0) for k in ("applied", "stale", "rejected") for b in (0, 1)) == len(kept)


def test_a_book_that_asked_in_vain_asks_again_at_its_next_trigger(spark, folder):
    sent, at = exchange(8, n=60)
    kept = [m for m in sent if m[1] != 20]
    broken = sent[21][4]
    first = spark.createDataFrame([message("X", -1, 0, 1, 0, snapshot=True)], books.MESSAGE)
    for i, part in enumerate((kept[:30], kept[30:40], kept[40:])):
        answer = Exchange(at, range(1000) if i < 2 else ())
        in_runs(spark, folder, [part], books.MESSAGE, lambda s: books.follow_at_once(s, answer, folder, first))  # noqa: B023
        if i < 2:
            assert not [r for r in books.events(spark, folder).collect() if r["kind"] == "snapshot"]
    events = books.events(spark, folder).collect()
    rejected = [r["u"] for r in events if r["kind"] == "rejected"]
    assert min(rejected) == broken and sum(r["kind"] == "request" for r in events) == 2 + len(rejected)
    assert {(r["side"], r["price"]): r["qty"] for r in books.levels(spark, folder).collect()} == at[-1][1]


def test_slices_are_triggers_in_order(spark, folder):
    """A part larger than a trigger comes in order, a slice after the other; gaps and skew in the order don't mix them."""
    rows = spark.range(100).select(F.when(F.col("id") < 60, F.col("id")).otherwise(F.col("id") + 5000).alias("ord")).repartition(5)
    seen = []
    note = lambda df, batch: seen.append(sorted(r["ord"] for r in df.collect()))
    run = lambda s: s.writeStream.foreachBatch(note).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    queries._in_turns(spark, rows, "slices", run, trigger_rows=10)
    assert [x for part in seen for x in part] == sorted(r["ord"] for r in rows.collect()) and len([x for x in seen if x]) > 1


def test_messages_of_both_kinds_from_text(spark):
    rows = [
        ("A", 1, '{"e":"depthUpdate","U":5,"u":7,"pu":4,"b":[["1.50","2"],["x","1"],["1.4","bad"]],"a":[]}'),
        ("A", 2, '{"lastUpdateId":9,"bids":[["3","1"]],"asks":[["4","0.5"]]}'),
        ("A", 3, "not json"),
        ("A", 4, '{"e":"other"}'),
    ]
    got = books.parsed(spark.createDataFrame(rows, "symbol string, ord long, raw string")).orderBy("ord").collect()
    assert [(r["ord"], r["snapshot"], r["u_first"], r["u"], r["pu"]) for r in got] == [(1, False, 5, 7, 4), (2, True, None, 9, None)]
    assert [tuple(x) for x in got[0]["b"]] == [(1.5, 2.0), (1.4, 0.0)] and got[0]["a"] == []
    assert [tuple(x) for x in got[1]["a"]] == [(4.0, 0.5)]


def test_snapshots_by_a_transport(spark):
    requests = spark.createDataFrame([("A", 0), ("B", 0), ("A", 3)], "symbol string, u long")
    got = books.snapshots_by_url("transport:snapshot", "https://exchange")(requests).collect()
    assert [(r["symbol"], r["u"], [tuple(x) for x in r["b"]]) for r in got] == [("A", 44, [(1.0, 2.0)])]
    assert books.snapshot_url("https://exchange/", "solusdt") == "https://exchange/fapi/v1/depth?symbol=SOLUSDT&limit=1000"




# --- the day's buffer
BUFFERED = "symbol string, market string, ord long, timestamp long, price double, volume_usdt double, side int, seg int"
COMMANDS = "symbol string, market string, ord long, command string"


def buffer_by_loop(rows, every, window):
    """The reference's buffer: a list, purged from the front at every `every`-th trade."""
    kept, n, newest = [], 0, 0
    for r in rows:
        kept.append(r)
        n, newest = n + 1, max(newest, r[3])
        while n % every == 0 and kept and kept[0][3] < newest - window:
            kept.pop(0)
    return kept, n


def test_buffer_with_late_rows_and_commands(spark, folder):
    rng = random.Random(4)
    rows, now = [], 1_000_000
    for i in range(300):
        now += rng.randint(0, 40)
        rows.append((rng.choice(["a", "A", "B"]), "spot", 10 * i, now - rng.choice([0, 0, 0, 900, 2500]), 1.0, float(rng.randint(1, 9)), rng.choice([0, 1, 3]), 1))
    commands = [("a", "spot", -1, "register"), ("A", "spot", 505, "register"), ("b", "spot", 700, "register"), ("B", "spot", 1995, "remove"), ("b", "spot", 2205, "register"), ("C", "spot", 5, "remove")]
    run = {"out": f"{folder}/out", "checkpoint": f"{folder}/checkpoint"}

    def go(stream):
        asked = spark.readStream.schema(COMMANDS).parquet(f"{folder}/commands")
        pipelines.run_now(buffers.buffered(stream, asked, 7, 1000, 10), run["out"], run["checkpoint"])

    for begin, end in ((0, 900), (900, 1800), (1800, 3000)):
        low = begin if begin else -10
        spark.createDataFrame([c for c in commands if low <= c[2] < end], COMMANDS).write.mode("append").parquet(f"{folder}/commands")
        in_runs(spark, folder, [[r for r in rows if begin <= r[2] < end]], BUFFERED, go)
    a, n_a = buffer_by_loop([r for r in rows if r[0] in "aA"], 7, 1000)
    b, n_b = buffer_by_loop([r for r in rows if r[0] == "B" and r[2] > 2205], 7, 1000)
    assert len(a) > 20 and any(r[3] < max(x[3] for x in a) - 1000 for r in a)  # a late row outlives the window
    got = buffers.held(spark, run["checkpoint"], 10).collect()
    for symbol, want in (("A", a), ("B", b)):
        assert sorted((r["ord"], r["timestamp"], r["volume_usdt"]) for r in got if r["symbol"] == symbol) == [(r[2], r[3], r[5]) for r in want]
    events = spark.read.schema(buffers.BUFFER).parquet(run["out"]).collect()
    of = lambda e: sorted((r["symbol"], r["ord"]) for r in events if r["event"] == e)
    assert of("registered") == [("A", -1), ("B", 700), ("B", 2205)] and of("known") == [("A", 505)]
    assert of("removed") == [("B", 1995)] and of("unknown") == [("C", 5)]
    assert of("refused") == sorted(("B", r[2]) for r in rows if r[0] == "B" and (r[2] < 700 or 1995 < r[2] < 2205))
    last = {r["symbol"]: r for r in sorted((r for r in events if r["event"] == "totals"), key=lambda r: r["inserted"])}
    assert (last["A"]["trades"], last["A"]["vol"], last["A"]["inserted"], last["A"]["purged"]) == (len(a), sum(r[5] for r in a), n_a, n_a - len(a))
    assert (last["A"]["buys"], last["A"]["sells"]) == tuple(sum(r[6] == s for r in a) for s in (0, 1))


# --- liquidations
def test_counters_never_shrink_and_windows_see_what_is_kept(spark, folder):
    rng = random.Random(6)
    rows = [("X", i, 1_000_000 + i, rng.choice(["LONG liq", "SHORT liq"]), 10.0, 1.0, float(rng.randint(1, 90)), rng.randint(1, 2)) for i in range(5600)]
    schema = "symbol string, ord long, timestamp long, kind string, price double, qty double, usdt double, seg int"
    in_runs(spark, folder, [rows[:3000], rows[3000:5400], rows[5400:]], schema, lambda s: pipelines.run_now(buffers.liquidations(s), f"{folder}/out", f"{folder}/checkpoint"))
    ever = {r["seg"]: (r["long_count"], r["short_usdt"]) for r in buffers.liquidation_counters(spark, f"{folder}/checkpoint").collect()}
    assert ever == {s: (sum(r[7] == s and r[3] == "LONG liq" for r in rows), sum(r[6] for r in rows if r[7] == s and r[3] != "LONG liq")) for s in (1, 2)}
    kept = buffers.recent_liquidations(spark, f"{folder}/checkpoint")
    assert sorted(r["ord"] for r in kept.collect()) == list(range(600, 5600))
    day = liquidations.windows(kept).where("minutes = 1440").first()
    assert day["total_count"] == 5000 and day["long_usdt"] == sum(r[6] for r in rows[600:] if r[3] == "LONG liq")


# --- sessions and dumps
def test_sessions_freeze_once_and_leave_late_trades_out(spark, folder):
    hour = 3_600_000
    row = lambda i, h, price, v, side=0, seg=1: ("X", i, int(h * hour), price, v, side, seg)
    first = [row(0, 12.5, 5.0, 10.0), row(1, 13, 7.0, 30.0, 1, 3), row(2, 14, 6.0, 30.0, 0, 2)]
    second = [row(3, 20.2, 8.0, 1.0), row(4, 19.9, 9.0, 2.0)]  # late by less than the watermark
    third = [row(5, 21.5, 1.0, 1.0), row(6, 28.5, 2.0, 1.0)]
    fourth = [row(7, 19.0, 99.0, 99.0)]
    schema = "symbol string, ord long, timestamp long, price double, volume_usdt double, side int, seg int"
    in_runs(spark, folder, [first, second, third, fourth], schema, lambda s: pipelines.run_now(buffers.sessions(s, "1 hour"), f"{folder}/out", f"{folder}/checkpoint"))
    got = spark.read.schema(buffers.SESSION).parquet(f"{folder}/out").orderBy("session_date", "session").collect()
    assert [tuple(r) for r in got] == [("X", "1970-01-01", "NY", 5.0, 9.0, 4, 72.0, 58.3, 41.7, 2, "BUY")]


def test_a_batch_stored_twice_is_there_once(spark, folder):
    schema = "symbol string, market string, ord long, timestamp long, price double, volume_usdt double, volume_base double, side int, seg int"
    row = lambda i, h: ("X", "spot", i, h * 3_600_000, 1.0, 2.0, 2.0, 0, 1)
    one, two = (spark.createDataFrame(x, schema) for x in ([row(0, 1), row(1, 5)], [row(2, 5), row(3, 13)]))
    dump.store(one, 0, f"{folder}/d")
    for _ in range(2):
        dump.store(two, 1, f"{folder}/d")
    assert sorted(r["ord"] for r in dump.stored(spark, f"{folder}/d").collect()) == [0, 1, 2, 3]
    assert [(r["period"], r["trades"]) for r in dump.dumped(spark, f"{folder}/d").orderBy("period").collect()] == [(4 * 3_600_000, 1), (12 * 3_600_000, 2)]


def test_digits_add_up_exactly():
    """Sums of digits are those of fractions, over all magnitudes and signs."""
    rng = random.Random(9)
    x = np.array([rng.choice([-1, 1]) * rng.random() * 2.0 ** rng.randint(-190, 400) for _ in range(200)] + [0.0, 0.1, 2.0**1000, -(2.0**1000)])
    low = windows.lowest_bit(x) // 32 * 32
    d = windows.digits(x, low)
    assert [sum(int(k) << 32 * i for i, k in enumerate(c)) * Fraction(2) ** low for c in d.T] == [Fraction(float(v)) for v in x]
    total = windows.values(d[:, :150].sum(axis=1, keepdims=True), low)[0]
    assert total == pytest.approx(float(sum(Fraction(float(v)) for v in x[:150])), rel=1e-15)


def test_a_triggers_size_is_bounded(spark, folder):
    """Windows are the same in one trigger or in many, of which none sorts more than its slice."""
    trades = spark.createDataFrame([("spot", i, 1000 * (i // 3), 1 + i % 4, i % 2, 0.1 * i) for i in range(300)], TRADES)
    got = []
    for name, size in (("one", None), ("many", 25)):
        run = lambda s: pipelines.run_now(windows.states(s, ("market",), (2, 40), 8), f"{folder}/{name}", f"{folder}/{name}-checkpoint")  # noqa: B023, E731
        queries._in_turns(spark, trades, "bounded", run, turns=1, trigger_rows=size)
        out = spark.read.schema(f"market string, {windows.SCHEMA}").parquet(f"{folder}/{name}")
        got.append([sorted(f(out).collect()) for f in (windows.rolling, windows.latest)])
    assert got[0] == got[1] and got[0][0]
    log = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/many-checkpoint/commits")
    files = log.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(log)
    assert sum(f.getPath().getName().isdigit() for f in files) >= 12


def test_landed_rows_have_a_task_for_each_core(spark):
    """One file of one row group: all cores read what lands, in one trigger."""
    rows = spark.range(1000).coalesce(1)
    stream = queries._landed(spark, rows, "cores").withColumn("file", F.input_file_name())
    files, seen = [], []
    q = stream.writeStream.foreachBatch(lambda df, _: (files.append(df.select("file").distinct().count()), seen.append(df.count()))).option("checkpointLocation", queries.new_path(spark, "checkpoint")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sum(seen) == 1000 and files == [spark.sparkContext.defaultParallelism]
