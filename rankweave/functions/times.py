"""Time expressions in epoch milliseconds."""

from __future__ import annotations

import datetime as dt
import math
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_millis(value: Any) -> int | float | None:
    """A finite number, a datetime or an ISO string as epoch milliseconds; anything else is None."""
    if isinstance(value, bool) or value is None:
        return None
    if isinstance(value, (int, float)):
        return value if math.isfinite(value) else None
    if isinstance(value, dt.datetime):
        return int((value if value.tzinfo else value.replace(tzinfo=dt.timezone.utc)).timestamp() * 1000)
    if isinstance(value, str):
        try:
            return to_millis(dt.datetime.fromisoformat(value.replace("Z", "+00:00")))
        except ValueError:
            return None
    return None


def millis(time: Column) -> Column:
    """Epoch milliseconds of a timestamp, a date or a string; null where a string is no timestamp."""
    return F.unix_millis(time.try_cast("timestamp"))


def decay(time_ms: Column, now_ms: int, half_life_ms: float) -> Column:
    """0.5 to the power of the age in half-lives; 1 in the future, 0 without a time or a positive half-life."""
    if half_life_ms <= 0:
        return F.lit(0.0)
    age = F.greatest(F.lit(0.0), F.lit(float(now_ms)) - time_ms.cast("double"))
    return F.when(time_ms.isNull(), F.lit(0.0)).otherwise(F.pow(F.lit(0.5), age / F.lit(float(half_life_ms))))
