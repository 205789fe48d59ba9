"""Frame schedule and window arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_SEED = 2**31 - 1


def detection_due(index: Column, cut: Column, interval: int) -> Column:
    """Part of the detection schedule that needs no tracker state."""
    return cut | (index % max(1, int(interval)) == 0)


def full_scan_due(index: Column, cut: Column, full_interval: int) -> Column:
    return cut | (index % max(1, int(full_interval)) == 0)


def crossfade_weight(offset: Column, overlap: Column) -> Column:
    """Share of the incoming window inside an overlap; rises along half a cosine, never 0 or 1."""
    return 0.5 - 0.5 * F.cos(math.pi * (offset + 1) / (overlap + 1))


def window_seed(start: Column, seed: int, mode: str = "absolute_frame") -> Column:
    if mode == "fixed":
        return F.lit(seed).cast("long")
    if mode != "absolute_frame":
        raise ValueError("mode must be 'fixed' or 'absolute_frame'")
    return ((F.lit(seed) + start) % MAX_SEED).cast("long")
