"""Column expressions over numbers and timestamps held as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_number(c: Column) -> Column:
    """Text to double; what is not a number becomes null."""
    return F.trim(c.cast("string")).try_cast("double")


def finite(c: Column) -> Column:
    """Infinite and not-a-number values become null, before any aggregate can see them."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def parse_ts(c: Column, fmt: str | None = None) -> Column:
    return F.try_to_timestamp(c, F.lit(fmt)) if fmt else F.try_to_timestamp(c)


def epoch_ts(c: Column) -> Column:
    """Seconds since 1970 as a timestamp; bad text becomes null."""
    return F.timestamp_seconds(F.trim(c.cast("string")).try_cast("double"))


def half_day_fixed(ts: Column, cutoff: int = 8) -> Column:
    """Clock without am/pm: hours before ``cutoff`` belong to the afternoon."""
    return F.when(F.hour(ts) < cutoff, ts + F.expr("interval 12 hours")).otherwise(ts)


def ratio(num: Column, den: Column) -> Column:
    """num / den as double, 0 where the denominator is 0."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def equal_width_bin(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """0-based equal-width bin with the last bin closed; null outside [lo, hi]; everything in bin 0 if lo = hi."""
    raw = F.floor(F.try_divide((x - lo) * bins, hi - lo)).cast("bigint")
    slot = F.when(hi == lo, F.lit(0).cast("bigint")).otherwise(F.least(raw, F.lit(bins - 1).cast("bigint")))
    return F.when((x >= lo) & (x <= hi), slot)
