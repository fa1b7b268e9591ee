"""The query embedder, which runs beside the lexical legs and may have a time budget."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from ..schema import Signal


class EmbedTimeoutError(TimeoutError):
    def __init__(self, budget_ms: float):
        super().__init__(f"query embedding exceeded {budget_ms:g}ms budget")
        self.budget_ms = budget_ms


class Embedding:
    """Starts an embedder at once on a daemon thread, which a lost wait leaves running without holding up the exit."""

    def __init__(self, embedder: Callable[[str], list[float]], text: str):
        self._done, self._value, self._error, self._begun = threading.Event(), None, None, time.monotonic()
        self._ended = self._begun

        def work():
            try:
                self._value = list(embedder(text))
            except BaseException as e:  # handed to the waiting thread
                self._error = e
            self._ended = time.monotonic()
            self._done.set()

        threading.Thread(target=work, daemon=True).start()

    def result(self, budget_ms: float | None = None, signal: Signal | None = None) -> list[float]:
        """The vector.  The budget counts from the start to the embedder's end, whenever it is asked for; none, or one that
        isn't positive, is unbounded.  An empty vector is a failure."""
        bounded = budget_ms is not None and budget_ms > 0
        end = self._begun + (budget_ms or 0) / 1000
        while not self._done.wait(min(0.02, max(0.0, end - time.monotonic())) if bounded else 0.02):
            if signal is not None:
                signal.check()
            if bounded and time.monotonic() >= end:
                raise EmbedTimeoutError(budget_ms)
        if bounded and self._ended >= end:  # it ended too late while the term legs ran
            raise EmbedTimeoutError(budget_ms)
        if self._error is not None:
            raise self._error
        if not self._value:
            raise ValueError("the embedder returned an empty vector")
        return self._value
