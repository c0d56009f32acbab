"""Typed settings. Time is epoch milliseconds everywhere."""

from __future__ import annotations

from dataclasses import dataclass

DAY_MS = 86_400_000
HOUR_MS = 3_600_000


@dataclass(frozen=True)
class AlignSettings:
    reference_sensor: str = "gyroscope"
    step_ms: int = 15_000
    require_all: bool = True
    # Width of the pieces an ordered pass is cut into; None only when the
    # grouping key itself bounds the group (for example user and epoch).
    piece_ms: int | None = HOUR_MS


@dataclass(frozen=True)
class NoveltySettings:
    threshold: float = 0.15
    window_rows: int = 20
    rate_threshold: float = 0.1
    rule: str = "any"  # "any" or "majority"


@dataclass(frozen=True)
class MetricSettings:
    post_size: int = 50
    table_prefix: str = "raw_"
