"""Numeric coding: bins, body-mass index, rounding helpers."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V
from .missing import column, number


def _bound(x: float) -> str:
    return "Inf" if math.isinf(x) else f"{x:g}"


def bin_right_closed(c: str | Column, breaks: Sequence[float], labels: Sequence[str] | None = None,
                     include_lowest: bool = True) -> Column:
    """Bins ``(a, b]``; the first is ``[a, b]`` with ``include_lowest``. Outside: NULL."""
    c = column(c)
    out = F.lit(None).cast("string")
    for i in reversed(range(len(breaks) - 1)):
        low, high = breaks[i], breaks[i + 1]
        first = i == 0 and include_lowest
        label = labels[i] if labels else f"{'[' if first else '('}{_bound(low)},{_bound(high)}]"
        inside = (c >= low) if first else (c > low)
        if not math.isinf(high):
            inside = inside & (c <= high)
        out = F.when(inside, F.lit(label)).otherwise(out)
    return out


def bin_left_closed(c: str | Column, breaks: Sequence[float], labels: Sequence[str]) -> Column:
    """Bins ``[a, b)`` with the given labels. Outside: NULL."""
    c = column(c)
    out = F.lit(None).cast("string")
    for i in reversed(range(len(breaks) - 1)):
        inside = c >= breaks[i]
        if not math.isinf(breaks[i + 1]):
            inside = inside & (c < breaks[i + 1])
        out = F.when(inside, F.lit(labels[i])).otherwise(out)
    return out


def delay_bin(days: str | Column) -> Column:
    return bin_right_closed(days, V.DELAY_BREAKS)


def smoking_code(cigarettes: str | Column) -> Column:
    return bin_left_closed(number(cigarettes), V.SMOKING_BREAKS, V.SMOKING_CODES)


def body_mass_index(weight_kg: str | Column, height_cm: str | Column) -> Column:
    metres = column(height_cm) / F.lit(100.0)
    return F.try_divide(column(weight_kg), F.pow(metres, F.lit(2)))


def safe_ratio(a: str | Column, b: str | Column) -> Column:
    """NULL instead of an infinite or undefined ratio."""
    return F.try_divide(column(a).cast("double"), column(b).cast("double"))
