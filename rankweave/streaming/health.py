"""Health of the legs: a bounded ring of samples in the driver, and the same measure over streams."""

from __future__ import annotations

import threading
import time
from collections import deque
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.legs import Legs

CAPACITY = 512
HOUR_MS = 3_600_000


@dataclass(frozen=True)
class LegSample:
    at_ms: int
    degraded: bool
    lexical_blocked: bool
    semantic_blocked: bool
    lexical_empty: bool
    semantic_empty: bool


@dataclass(frozen=True)
class LegHealth:
    """Counts over a trailing window; rate is None without samples.  truncated says that older samples of the window
    may have been pushed out of the ring."""

    window_ms: int
    samples: int
    degraded: int
    lexical_blocked: int
    semantic_blocked: int
    lexical_empty: int
    semantic_empty: int
    degraded_rate: float | None
    oldest_ms: int | None
    newest_ms: int | None
    truncated: bool


def sample_of_legs(legs: Legs, at_ms: int) -> LegSample:
    """A leg that could not be attempted is blocked; one counts as empty only if both ran and the other brought rows."""
    a, b = legs.lexical, legs.semantic
    ran = a.status == "ran" and b.status == "ran"
    return LegSample(at_ms, legs.degraded, a.blocked is not None, b.blocked is not None, ran and not a.candidates and b.candidates > 0, ran and not b.candidates and a.candidates > 0)


def summarise_leg_samples(samples: list[LegSample], window_ms: int, now_ms: int, capacity: int = CAPACITY) -> LegHealth:
    begin = now_ms - window_ms
    inside = [s for s in samples if s.at_ms >= begin]
    n = len(inside)
    count = lambda name: sum(getattr(s, name) for s in inside)
    oldest, newest = (min(s.at_ms for s in inside), max(s.at_ms for s in inside)) if n else (None, None)
    truncated = n == len(samples) >= capacity and begin < (oldest or 0)
    return LegHealth(window_ms, n, count("degraded"), count("lexical_blocked"), count("semantic_blocked"), count("lexical_empty"), count("semantic_empty"), count("degraded") / n if n else None, oldest, newest, truncated)


class LegHealthRing:
    def __init__(self, capacity: int = CAPACITY):
        self._samples: deque[LegSample] = deque(maxlen=capacity)
        self._seen, self._lock, self.capacity = 0, threading.Lock(), capacity

    def observe(self, legs: Legs, at_ms: int | None = None) -> Legs:
        """Adds a sample and returns its argument; never raises."""
        try:
            sample = sample_of_legs(legs, int(time.time() * 1000) if at_ms is None else at_ms)
            with self._lock:
                self._samples.append(sample)
                self._seen += 1
        except Exception:  # health is a side channel
            pass
        return legs

    def read(self, window_ms: int = HOUR_MS, now_ms: int | None = None) -> LegHealth:
        with self._lock:
            samples = list(self._samples)
        return summarise_leg_samples(samples, window_ms, int(time.time() * 1000) if now_ms is None else now_ms, self.capacity)

    @property
    def observed(self) -> int:
        """All samples ever observed, those no longer held included."""
        return self._seen

    def reset(self) -> None:
        with self._lock:
            self._samples.clear()
            self._seen = 0


_ring = LegHealthRing()
observe_legs, read_leg_health, reset_leg_health = _ring.observe, _ring.read, _ring.reset


def leg_health_observed_count() -> int:
    return _ring.observed


FLAGS = ("degraded", "lexical_blocked", "semantic_blocked", "lexical_empty", "semantic_empty")


def _counts() -> list:
    return [F.count("*").alias("samples"), *(F.count_if(F.col(f)).alias(f) for f in FLAGS), F.min("at_ms").alias("oldest_ms"), F.max("at_ms").alias("newest_ms")]


def trailing_health(samples: DataFrame, window_ms: int, now_ms: int) -> DataFrame:
    """One row over the samples (at_ms and the five flags) of a trailing window; degraded_rate is null if there are none."""
    out = samples.where((F.col("at_ms") >= now_ms - window_ms) & (F.col("at_ms") <= now_ms)).agg(*_counts())
    return out.withColumn("degraded_rate", F.when(F.col("samples") > 0, F.col("degraded") / F.col("samples")))


def windowed_health(samples: DataFrame, window: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts by tumbling or sliding windows of event time `at` (timestamp); works on streams, where samples later than
    `late` behind the watermark are dropped, and on tables."""
    span = F.window("at", window, slide) if slide else F.window("at", window)
    timed = samples.withWatermark("at", late) if samples.isStreaming else samples
    out = timed.groupBy(span.alias("w")).agg(*_counts())
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "samples", *FLAGS, (F.col("degraded") / F.col("samples")).alias("degraded_rate"))
