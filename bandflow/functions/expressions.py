"""Column expressions shared by the trade operators.

Percentages are guarded, so that ANSI mode never divides by zero. Times are
epoch milliseconds and are taken apart by integer arithmetic, which keeps every
result independent of the session's time zone.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper bounds of the notional bands (a bound belongs to the band above it).
DEFAULT_BOUNDS = (40.0, 100.0, 500.0, 1e3, 2.5e3, 5e3, 1e4, 5e4, 1e5, 5e5, 1e6, 5e6, 1e7)
N_BANDS = 14
# Live groups by band, and the horizons and windows that reports use.
LIVE_GROUPS = {"retail": (1, 3), "mid": (4, 6), "smart": (7, 9), "inst": (10, 12)}
HORIZON_HOURS = (1, 2, 3, 4, 6, 8)
WINDOW_PACKETS = (180, 300, 900, 3600, 7200, 14400, 28800, 43200, 86400)
LIQUIDATION_MINUTES = (15, 60, 120, 240, 1440)
LEVEL_STEP = 0.5
LEVEL_SHARE = 0.006
HOUR_MS, MINUTE_MS, DAY_MS = 3_600_000, 60_000, 86_400_000


def rounded(c: Column, digits: int) -> Column:
    """Half away from zero on the binary value (Spark's own rounding looks at the decimal text)."""
    scale = float(10**digits)
    return F.round(c * F.lit(scale), 0) / F.lit(scale)


def fixed_text(c: Column, digits: int) -> Column:
    """A double as text with `digits` (at most 8) decimals, its exact binary value rounded half to even.

    Spark's own formatting rounds the shortest decimal text, half up. The
    fraction is taken as a whole number of 2^-62 and multiplied in two halves
    of 31 bits, so that the decimals and what is left of them are exact; what a
    tiny value holds below 2^-62 is added to what is left. From 2^53 on there
    is no fraction.
    """
    half, mask, tens, top = 31, 2**31 - 1, 10**digits, F.abs(c)
    scaled = (top - F.floor(top)) * float(2**62)
    fraction = scaled.cast("long")
    low = fraction.bitwiseAND(F.lit(mask)) * tens
    high = F.shiftright(fraction, half) * tens + F.shiftright(low, half)
    down, left = F.shiftright(high, half), F.shiftleft(high.bitwiseAND(F.lit(mask)), half) + low.bitwiseAND(F.lit(mask))
    over = (left - 2**61).cast("double") + (scaled - F.floor(scaled)) * float(tens)
    shown = down + F.when((over > 0) | ((over == 0) & (down % 2 == 1)), 1).otherwise(0)
    before = (F.floor(top) + F.when(shown >= tens, 1).otherwise(0)).cast("string")
    sign = F.when(c.cast("string").startswith("-"), "-").otherwise("")
    exact = F.concat(sign, before, F.lit("."), F.lpad((shown % tens).cast("string"), digits, "0"))
    return F.when(F.isnan(c), "NaN").when(c == float("inf"), "inf").when(c == float("-inf"), "-inf").when(top >= 2.0**53, F.format_string(f"%.{digits}f", c)).otherwise(exact)


def percent(part: Column, whole: Column, default: float = 0.0) -> Column:
    return F.when(whole > 0, part / F.when(whole > 0, whole) * 100.0).otherwise(F.lit(default))


def sum_where(condition: Column, value: Column) -> Column:
    return F.sum(F.when(condition, value).otherwise(F.lit(0.0)))


def share_where(condition: Column, value: Column, digits: int = 1) -> Column:
    """Rounded percentage of a sum; null where the sum is zero."""
    total = F.sum(value)
    return rounded(F.try_divide(sum_where(condition, value), total) * 100.0, digits)


def day(ms: Column) -> Column:
    """The UTC date of epoch milliseconds."""
    return F.date_from_unix_date(F.floor(ms / DAY_MS).cast("int"))


def hour(ms: Column) -> Column:
    return F.pmod(F.floor(ms / HOUR_MS), F.lit(24)).cast("int")


def minute_start(ms: Column) -> Column:
    return (F.floor(ms / MINUTE_MS) * MINUTE_MS).cast("long")


def ntz_millis(ts: Column) -> Column:
    """Epoch milliseconds of a time-zone-free timestamp read as UTC."""
    ts = ts.cast("timestamp_ntz")
    seconds = F.unix_date(ts.cast("date")).cast("long") * 86_400 + F.hour(ts) * 3600 + F.minute(ts) * 60
    return seconds * 1000 + F.floor(F.date_part(F.lit("SECOND"), ts).cast("decimal(8,6)") * 1000).cast("long")


@dataclass(frozen=True)
class Bands:
    """Ascending upper bounds of bands 1..n; the last band is open."""

    bounds: tuple[float, ...] = DEFAULT_BOUNDS

    def __post_init__(self):
        if not self.bounds or self.bounds[0] <= 0 or any(a >= b for a, b in zip(self.bounds, self.bounds[1:], strict=False)):
            raise ValueError("bounds must be positive and strictly ascending")

    def of(self, volume: Column) -> Column:
        """Number of the band that holds `volume`."""
        out = F.when(volume < self.bounds[0], F.lit(1))
        for i, bound in enumerate(self.bounds[1:], 2):
            out = out.when(volume < bound, F.lit(i))
        return out.otherwise(F.lit(len(self.bounds) + 1)).cast("int")

    def text(self, band: Column) -> Column:
        """The band's range as text."""
        edges = [0.0, *self.bounds]
        names = [f"{int(a)} - {int(b)}" for a, b in zip(edges, edges[1:], strict=False)] + [f"{int(edges[-1])}+"]
        return named(band, names, "inválido", clamp=False)


# Short and full names of the bands.
SHORT_NAMES = tuple(f"P{i}" for i in range(1, N_BANDS + 1))
FULL_NAMES = (
    "micro_retail", "retail_puro", "retail_pequeno", "retail_activo", "retail_plus", "bisagra_bajo", "bisagra_alto",
    "profesional", "institucional_bajo", "institucional_alto", "ballena_baby", "ballena_azul", "whale_evento", "market_maker",
)


def named(band: Column, names: Sequence[str], unknown: str, clamp: bool = True) -> Column:
    """The name at 1-based `band`; with `clamp`, band 0 takes the first."""
    at = F.greatest(band, F.lit(1)) if clamp else band
    return F.when((at >= 1) & (at <= len(names)), F.element_at(F.array(*map(F.lit, names)), F.when((at >= 1) & (at <= len(names)), at).otherwise(1).cast("int"))).otherwise(unknown)


def lab_group(band: Column) -> Column:
    return F.when(band <= 4, "Retail (P1-P4)").when(band <= 7, "Bisagra (P5-P7)").otherwise("Smart Money (P8-P14)")


def live_group(band: Column) -> Column:
    """Group of the live reports; null for the two highest bands."""
    out = None
    for name, (low, high) in LIVE_GROUPS.items():
        out = F.when(band.between(low, high), name) if out is None else out.when(band.between(low, high), name)
    return out


def level_role(buy_pct: Column) -> Column:
    return F.when(buy_pct >= 52, "SOPORTE").when(buy_pct <= 48, "RESISTENCIA").otherwise("NEUTRAL")


def level_centre(price: Column, step: float = LEVEL_STEP) -> Column:
    return rounded(F.floor(price / step) * step + step / 2, 2)


def dominance(a: Column, b: Column, factor: float, names: tuple[str, str]) -> Column:
    return F.when(a > b * factor, names[0]).when(b > a * factor, names[1]).otherwise("EQ")


def divergence_signal(difference: Column) -> Column:
    return F.when(F.abs(difference) < 5, "NEUTRAL").when(difference > 0, "SMART_COMPRA").otherwise("SMART_VENDE")


def session_of(ms: Column) -> Column:
    """Market session of an instant: the Asian one spans midnight."""
    h = hour(ms)
    return F.when((h >= 20) | (h < 4), "Asia").when(h < 12, "Londres").otherwise("NY")


def session_date(ms: Column) -> Column:
    """Date that all of a session's hours share."""
    return day(ms + 4 * HOUR_MS)


def next_dump(ms: Column) -> Column:
    """The next of 04:00, 12:00 and 20:00 UTC strictly after an instant."""
    return ((F.floor((ms - 4 * HOUR_MS) / (8 * HOUR_MS)) + 1) * (8 * HOUR_MS) + 4 * HOUR_MS).cast("long")
