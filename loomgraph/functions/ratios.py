"""Ratios in double arithmetic: 100 * a / b, null or a given value for b = 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent(part: Column, whole: Column, empty: float | None = None) -> Column:
    out = F.try_divide(F.lit(100.0) * part, whole.cast("double"))
    return out if empty is None else F.coalesce(out, F.lit(empty))
