"""Time keys over epoch milliseconds."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch_ms(ts: str | Column) -> Column:
    """Milliseconds since the epoch, cut (not rounded) below the millisecond."""
    return F.unix_millis(_col(ts).cast("timestamp"))


def now_ms() -> Column:
    return F.unix_millis(F.current_timestamp())


def floor_window(ts: str | Column, width_ms: int) -> Column:
    return F.floor(_col(ts) / F.lit(width_ms)).cast("bigint")


def round_window(ts: str | Column, width_ms: int) -> Column:
    """Nearest window, halves to the even one."""
    return F.rint(_col(ts) / F.lit(width_ms)).cast("bigint")


def window_key(ts: str | Column, width_ms: int, rounding: str = "floor") -> Column:
    if rounding == "floor":
        return floor_window(ts, width_ms)
    if rounding == "round":
        return round_window(ts, width_ms)
    raise ValueError(f"rounding must be 'floor' or 'round', got {rounding!r}")


def window_start(key: str | Column, width_ms: int) -> Column:
    return _col(key) * F.lit(width_ms).cast("bigint")
