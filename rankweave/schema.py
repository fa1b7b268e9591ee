"""Requests and the one intermediate table, the listing: hits of one ranker and source in best-first order."""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import types as T

#: A listing's columns.  pos is 1-based within (query_id, input_ord) and is recomputed after every filter; appended says
#: that a widening added the row.
LISTING = T.StructType(
    [
        T.StructField("query_id", T.LongType()),
        T.StructField("source", T.StringType()),
        T.StructField("source_id", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("ranker", T.StringType()),
        T.StructField("input_ord", T.IntegerType()),
        T.StructField("pos", T.IntegerType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("appended", T.BooleanType()),
    ]
)
#: What a source gives for each row that is asked for by its id, and their types.
ROW = {"source_id": "string", "ts_ms": "long", "scope": "string", "excerpt": "string", "rerank_score": "double", "meta": "map<string,string>"}

LEXICAL, FRESH, EMBEDDINGS = "lexical", "lexical-fresh", "embeddings"


class Unset:
    """Says that a caller gave no value, which differs from turning a feature off with False."""

    def __repr__(self) -> str:
        return "UNSET"


UNSET = Unset()


@dataclass(frozen=True)
class Filters:
    """Predicates that a source applies to the columns it has; the others are ignored.

    since is inclusive and until exclusive, both in epoch milliseconds.
    """

    owners: tuple[str, ...] | None = None
    speaker: str | None = None
    session_id: str | None = None
    source_kind: str | None = None
    since: int | None = None
    until: int | None = None


@dataclass(frozen=True)
class Recency:
    """Time decay mixed into relevance.  time is an expression for epoch milliseconds, by default ts_ms."""

    half_life_ms: float
    weight: float = 0.3
    mode: str = "linear"  # or 'multiply'
    fresh_window_ms: int = 0
    now_ms: int | None = None
    time: Column | None = None

    @property
    def clamped(self) -> float:
        return min(1.0, max(0.0, self.weight))


@dataclass(frozen=True)
class Params:
    """A scan request, consumed while a source builds its DataFrame.

    want_highlight is False for a source that may leave headlines out, as it gives them later for a page's ids; words
    are the query's lexemes.
    """

    limit: int
    workspace_id: Any = None
    scope: str | None = None
    filters: Filters = Filters()
    lexical_mode: str | None = None
    anchor_df_budget: int | None = None
    want_highlight: bool | None = None
    words: tuple[str, ...] = ()


class Aborted(Exception):
    """The caller gave up; no partial result is returned."""


@dataclass
class Signal:
    """A caller's way to give up.  Jobs that carry `tag` are interrupted when it is set."""

    tag: str | None = None
    _event: threading.Event = field(default_factory=threading.Event)

    def abort(self, spark=None) -> None:
        self._event.set()
        if spark is not None and self.tag:
            spark.interruptTag(self.tag)

    def check(self) -> None:
        if self._event.is_set():
            raise Aborted("the request was aborted")


@dataclass(frozen=True)
class Request:
    """What to look for and how.  None, False and UNSET are told apart where a policy may step in.

    defer_highlight leaves the headlines to the end, for the rows of the page alone; without it every candidate gets its
    own.  materialize_legs runs each leg by itself, so that a source that fails at run time degrades the result only.
    """

    query: str | None = None
    limit: int = 10
    workspace_id: Any = None
    scope: str | None = None
    filters: Filters = Filters()
    signal: Signal | None = None
    mode: str = "hybrid"  # or 'embeddings'
    embedder: Callable[[str], list[float]] | None = None
    embed_timeout_ms: float | None = None
    recency: Any = UNSET
    min_score: Any = UNSET
    group_by: Column | None = None
    defer_highlight: bool = False
    lexical_mode: str | None = None
    anchor_df_budget: int | None = None
    lexical_cascade: bool = True
    materialize_legs: bool = True
    log: Callable[[str], None] | None = None

    def params(self, limit: int, words: tuple[str, ...] = ()) -> Params:
        """A mode that is the default is not passed on, so a source can't tell it from none."""
        mode = self.lexical_mode if self.lexical_mode != "and" else None
        return Params(limit, self.workspace_id, self.scope, self.filters, mode, self.anchor_df_budget, None, words)
