"""Packets and sliding windows as keyed state of a stream.

`PacketWindows` keeps, for each key, the open second, a ring of the last
86,400 closed packets and the totals of the nine windows. A packet is closed
by the first trade of another second, be that an earlier one, in the order of
arrival; windows hold a count of packets, across triggers and restarts.

The ring is kept in blocks of `BLOCK` packets, so that a trigger reads each
block it needs once, and a block leaves the state when the longest window has
passed it. A trigger's packets and windows are computed by prefix sums over
arrays. A window's total is exact: volumes are split into 32-bit digits of
multiples of 2^-256 (`digits`), digits are summed as integers, and infinite
volumes are counted, so that a window is finite again when they have left it.

A trigger's trades of one key are sorted in the task, so that a trigger's size
is the bound on its memory; the state of a key is bounded by the ring.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from bandflow.functions.expressions import N_BANDS, WINDOW_PACKETS, percent

#: Packets of a block of the ring.
BLOCK = 512
#: Sums count in parts of this many bits behind the point: exact for volumes from 10^-61 on.
UNIT_BITS = 256
#: Rows of a frame that a task gives out.
OUT_ROWS = 100_000

#: Kinds of rows: a closed packet's band; a window after a closed packet; a window's band at the last packet of a trigger.
PACKET, WINDOW, BAND = 0, 1, 2
#: Band 0 stands for all bands.
SCHEMA = "kind int, packet long, sec long, window int, seg int, vol_total double, vol_buy double, vol_sell double, trades long"
MEASURES = ("vol_total", "vol_buy", "vol_sell", "trades")
LOW = np.uint64(2**32 - 1)
HALF = np.uint64(32)


def _mantissas(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Integers and exponents of two whose products are the absolute values of `x`."""
    m, e = np.frexp(np.abs(x))
    return (m * 2.0**53).astype(np.uint64), e.astype(np.int64) - 53


def lowest_bit(x: np.ndarray) -> int:
    """The exponent of the least bit set in any of `x`, which are finite."""
    m, e = _mantissas(x[x != 0])
    if not len(m):
        return 0
    bit = m & (~m + np.uint64(1))
    return int((e + np.frexp(bit.astype(float))[1] - 1).min())


def digits(x: np.ndarray, low: int) -> np.ndarray:
    """Signed 32-bit digits of finite `x` in multiples of 2^low, the least first, as an array of (digits, len(x))."""
    m, e = _mantissas(x)
    shift = e - low
    m >>= np.minimum(np.maximum(-shift, 0), 63).astype(np.uint64)
    q, r = np.divmod(np.where(m > 0, np.maximum(shift, 0), 0), 32)
    r = r.astype(np.uint64)
    lo, hi = (m & LOW) << r, (m >> HALF) << r
    out, at = np.zeros((int(q.max(initial=0)) + 3, len(x)), np.int64), np.arange(len(x))
    out[q, at] = (lo & LOW).astype(np.int64)
    out[q + 1, at] = ((lo >> HALF) + (hi & LOW)).astype(np.int64)
    out[q + 2, at] = (hi >> HALF).astype(np.int64)
    return out * np.where(x < 0, -1, 1)


def _carried(d: np.ndarray) -> np.ndarray:
    for k in range(len(d) - 1):
        over = d[k] >> 32
        d[k] -= over << 32
        d[k + 1] += over
    return d


def values(sums: np.ndarray, low: int) -> np.ndarray:
    """Doubles of sums of digits."""
    d = _carried(sums.copy())
    negative = d[-1] < 0
    if negative.any():
        d[:, negative] = _carried(-d[:, negative])
    out = np.zeros(d.shape[1])
    for k in range(len(d)):
        out += np.ldexp(d[k].astype(float), 32 * k + low)
    return np.where(negative, -out, out)


class PacketWindows(StatefulProcessor):
    """Frames with ord, sec, seg, side and volume_usdt; see the module. `emit` are the kinds of rows wanted."""

    def __init__(self, keys: Sequence[str], sizes: Sequence[int] = WINDOW_PACKETS, block: int = BLOCK, emit: Sequence[int] = (PACKET, WINDOW, BAND)):
        self.keys, self.sizes, self.block, self.emit = tuple(keys), tuple(sizes), block, tuple(emit)

    def init(self, handle: StatefulProcessorHandle) -> None:
        sums = "seg array<int>, vol_total array<double>, vol_buy array<double>, vol_sell array<double>, trades array<long>"
        # began: the first packet with a bought or sold trade.
        self.open = handle.getValueState("open", f"packet long, sec long, began long, {sums}")
        self.ring = handle.getMapState("ring", "block long", f"packet array<long>, {sums}")
        self.totals = handle.getValueState("totals", "window array<int>, seg array<int>, units array<array<string>>, infinite array<array<long>>, trades array<long>")

    @staticmethod
    def _entries(packet, seg, *sums) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Packet, band (0: all), the three volumes and the count of each."""
        return np.array(packet, np.int64), np.array(seg, np.int64), np.array(sums[:3], float).reshape(3, -1), np.array(sums[3], np.int64)

    @staticmethod
    def _stored(pk, seg, v, n) -> tuple:
        return seg.tolist(), *(x.tolist() for x in v), n.tolist()

    def _frames(self, key, n: int, **columns) -> Iterator[pd.DataFrame]:
        for i in range(0, n, OUT_ROWS):
            part = {c: x[i : i + OUT_ROWS] if isinstance(x, np.ndarray) else x for c, x in columns.items()}
            yield pd.DataFrame({**dict(zip(self.keys, key, strict=True)), **part}, index=range(min(OUT_ROWS, n - i)))[[*self.keys, *(c.split()[0] for c in SCHEMA.split(", "))]]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        t = pd.concat(list(rows), ignore_index=True).sort_values("ord", kind="stable")
        number, was, began, *open_ = self.open.get() if self.open.exists() else (0, None, None, [], [], [], [], [])
        sec, side, v, band = (t[c].to_numpy() for c in ("sec", "side", "volume_usdt", "seg"))
        fresh = np.append(was is None or sec[0] != was, sec[1:] != sec[:-1])
        of = number + np.cumsum(fresh)
        c0, c1 = max(number, 1), int(of[-1]) - 1
        secs = np.append([was] if number else [], sec[fresh]).astype(np.int64)

        # Sums by packet and band in order of arrival, behind those of the open packet.
        kept = (side == 0) | (side == 1)
        of, side, v, band = of[kept], side[kept], v[kept].astype(float), band[kept].astype(np.int64)
        several = lambda x: np.concatenate([x, x])
        before = self._entries([number] * len(open_[0]), *open_)
        pk = np.concatenate([before[0], several(of)])
        seg = np.concatenate([before[1], np.zeros(len(of), np.int64), band])
        parts = np.concatenate([before[2], np.array([several(v), several(np.where(side == 0, v, 0.0)), several(np.where(side == 1, v, 0.0))])], axis=1)
        first, place = self._pairs(pk, seg)
        sums = np.array([np.bincount(place, x, len(first)) for x in parts]).reshape(3, -1)
        counts = np.bincount(place, np.concatenate([before[3], np.ones(2 * len(of), np.int64)]), len(first)).astype(np.int64)
        pk, seg = pk[first], seg[first]
        closed = pk <= c1
        new = tuple(x[..., closed] for x in (pk, seg, sums, counts))
        rest = tuple(x[..., ~closed] for x in (pk, seg, sums, counts))
        if began is None and closed.any():
            began = int(new[0][0])
        if c1 >= c0:
            yield from self._closed(key, c0, c1, secs, began, new)
        self.open.update((c1 + 1, int(secs[-1]), began, *self._stored(*rest)))

    @staticmethod
    def _pairs(pk: np.ndarray, seg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each pair of packet and band comes first, in their order, and the pair of each row."""
        low, high = (seg.min(), seg.max()) if len(seg) else (0, 0)
        _, first, place = np.unique((pk - pk.min(initial=0)) * (high - low + 1) + (seg - low), return_index=True, return_inverse=True)
        return first, place

    def _closed(self, key, c0: int, c1: int, secs: np.ndarray, began: int | None, new: tuple) -> Iterator[pd.DataFrame]:
        """Takes packets c0 to c1 into the ring and the totals."""
        longest = max(self.sizes)
        needed = {b for n in self.sizes for b in range((max(1, c0 - n) - 1) // self.block, (min(c1 - n, c0 - 1) - 1) // self.block + 1)} | {(c0 - 1) // self.block}
        blocks = {b: self._entries(*self.ring.getValue((b,))) for b in sorted(needed) if self.ring.containsKey((b,))}
        pk, seg, v, n = (np.concatenate(x, axis=-1) for x in zip(*blocks.values(), new, strict=True))
        totals = {(w, s): ([int(u) for u in units], list(inf), k) for w, s, units, inf, k in zip(*self.totals.get(), strict=True)} if self.totals.exists() else {}

        # Digits of the three volumes, counts of infinite ones, and trades: a column for each packet and band.
        infinite = np.isinf(v)
        finite = np.where(infinite, 0.0, v)
        units = [u for x in totals.values() for u in x[0] if u]
        low = min([lowest_bit(finite), *((u & -u).bit_length() - 1 - UNIT_BITS for u in units)])
        low = max(-UNIT_BITS, low // 32 * 32)
        parts = [digits(x, low) for x in finite]
        size = max([*map(len, parts), *((abs(u) >> (UNIT_BITS + low)).bit_length() // 32 + 2 for u in units)])
        m = np.concatenate([*(np.pad(x, ((0, size - len(x)), (0, 0))) for x in parts), infinite.astype(np.int64), n[None]])

        def column(w: int, s: int) -> np.ndarray:
            us, inf, k = totals.get((w, s)) or ([0, 0, 0], [0, 0, 0], 0)
            out = []
            for u in us:
                u >>= UNIT_BITS + low
                out += [(abs(u) >> 32 * i & (2**32 - 1)) * (-1 if u < 0 else 1) for i in range(size)]
            return np.array([*out, *inf, k], np.int64)

        def shown(x: np.ndarray) -> dict[str, np.ndarray]:
            names = ("vol_total", "vol_buy", "vol_sell")
            return {c: np.where(x[3 * size + i] > 0, np.inf, values(x[size * i : size * (i + 1)], low)) for i, c in enumerate(names)} | {"trades": x[-1]}

        if PACKET in self.emit:
            yield from self._frames(key, len(new[0]), kind=PACKET, packet=new[0], sec=secs[new[0] - c0], window=0, seg=new[1], vol_total=new[2][0], vol_buy=new[2][1], vol_sell=new[2][2], trades=new[3])
        if WINDOW in self.emit and began is not None:
            base, begin = max(1, c0 - longest), max(c0, began)
            dense = np.zeros((len(m), c1 - base + 2), np.int64)
            whole = (seg == 0) & (pk >= base)
            dense[:, pk[whole] - base + 1] = m[:, whole]
            sums = np.cumsum(dense, axis=1)  # up to a packet, at its number less base plus 1
            at = np.arange(begin, c1 + 1)
            came = sums[:, at - base + 1] - sums[:, [c0 - base]]
            for w in self.sizes:
                left = sums[:, np.maximum(at - w - base + 1, 0)] - sums[:, [max(c0 - w - base, 0)]]
                yield from self._frames(key, len(at), kind=WINDOW, packet=at, sec=secs[at - c0], window=w, seg=0, **shown(came - left + column(w, 0)[:, None]))

        # Totals at the last closed packet, by band.
        order = np.lexsort((pk, seg))
        ordered, run = pk[order], np.concatenate([np.zeros((len(m), 1), np.int64), np.cumsum(m[:, order], axis=1)], axis=1)
        bands, starts = np.unique(seg[order], return_index=True)
        for s, begin, end in zip(bands.tolist(), starts, [*starts[1:], len(order)], strict=True):
            mine = ordered[begin:end]
            upto = lambda p, side: run[:, begin + np.searchsorted(mine, p, side)]  # noqa: B023, E731
            came = run[:, end] - upto(c0, "left")
            for w in self.sizes:
                x = column(w, s) + came - (upto(c1 - w, "right") - upto(c0 - w, "left"))
                us = [sum(int(d) << 32 * i for i, d in enumerate(x[size * j : size * (j + 1)])) << UNIT_BITS + low for j in range(3)]
                totals[w, s] = us, x[3 * size : -1].tolist(), int(x[-1])
        if BAND in self.emit and totals:
            live = [k for k in sorted(totals) if totals[k][2]]
            if live:
                ws, ss = np.array(live, np.int64).T
                yield from self._frames(key, len(live), kind=BAND, packet=c1, sec=0, window=ws, seg=ss, **shown(np.stack([column(*k) for k in live], axis=1)))
        self.totals.update(tuple(map(list, zip(*((w, s, [str(u) for u in us], inf, k) for (w, s), (us, inf, k) in totals.items()), strict=True))) if totals else ([], [], [], [], []))

        # Packets that no window will need again are not kept.
        oldest = max(0, c1 - longest) // self.block
        for (b,) in [k for k in self.ring.keys() if k[0] < oldest]:
            self.ring.removeKey((b,))
        of = (pk - 1) // self.block
        for b in range(max(oldest, (c0 - 1) // self.block), (c1 - 1) // self.block + 1):
            mine = of == b
            if mine.any():
                i, j = mine.argmax(), len(mine) - mine[::-1].argmax()
                self.ring.updateValue((b,), (pk[i:j].tolist(), *self._stored(pk[i:j], seg[i:j], v[:, i:j], n[i:j])))

    def close(self) -> None:
        pass


def states(trades: DataFrame, keys: Sequence[str] = ("market",), sizes: Sequence[int] = WINDOW_PACKETS, block: int = BLOCK, emit: Sequence[int] = (PACKET, WINDOW, BAND)) -> DataFrame:
    """The stream of `SCHEMA` rows of a stream of trades, by `keys` (texts)."""
    rows = trades.select(*keys, "ord", F.floor(F.col("timestamp") / 1000).alias("sec"), F.col("seg").cast("int"), F.coalesce(F.col("side").cast("int"), F.lit(-1)).alias("side"), F.col("volume_usdt").cast("double"))
    return rows.groupBy(*keys).transformWithStateInPandas(PacketWindows(keys, sizes, block, emit), ", ".join(f"{k} string" for k in keys) + f", {SCHEMA}", "append", "none")


def packets(states: DataFrame, keys: Sequence[str] = ("market",)) -> DataFrame:
    """Closed packets by band, and with a null band for all, as `operators.windows.packets` gives them."""
    seg: Column = F.when(F.col("seg") != 0, F.col("seg")).alias("seg")
    return states.where(F.col("kind") == PACKET).select(*keys, "packet", "sec", seg, *MEASURES)


def _shares(rows: DataFrame) -> DataFrame:
    share = lambda c: percent(F.col(c), F.col("vol_total"))
    return rows.withColumns({"buy_pct": share("vol_buy"), "sell_pct": share("vol_sell")})


def rolling(states: DataFrame, keys: Sequence[str] = ("market",)) -> DataFrame:
    """Each window after every closed packet, as `operators.windows.rolling` gives it."""
    fill = F.least("packet", "window") / F.col("window") * 100.0
    return _shares(states.where(F.col("kind") == WINDOW).select(*keys, "packet", "window", *MEASURES, fill.alias("fill_pct")))


def latest(states: DataFrame, keys: Sequence[str] = ("market",)) -> DataFrame:
    """Each window's bands at the last closed packet, as `operators.windows.latest` gives them.

    Works on stored states: the last report of each key holds all windows.
    """
    reports = states.where(F.col("kind") == BAND)
    last = reports.groupBy(*keys).agg(F.max("packet").alias("packet"))
    rows = reports.join(F.broadcast(last), [*keys, "packet"]).select(*keys, "window", "seg", *MEASURES)
    whole = rows.where("seg = 0").select(*keys, "window", F.col("vol_total").alias("_all"))
    return _shares(rows.where("seg != 0").join(whole, [*keys, "window"]).withColumn("pct_vol", percent(F.col("vol_total"), F.col("_all"))).drop("_all"))


assert N_BANDS <= 99  # Band 0 stands for all bands in the state.
