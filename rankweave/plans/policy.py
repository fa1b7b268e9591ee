"""Session-wide defaults: resolvers for score floors and recency that requests may override or turn off."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from ..schema import UNSET, Request


@dataclass(frozen=True)
class PolicyContext:
    """What a resolver is told; embedder is the caller's own object."""

    query: str | None
    limit: int
    mode: str  # 'fulltext', 'hybrid' or 'embeddings'
    embedder: Any


@dataclass(frozen=True)
class Defaults:
    min_score: Callable[[PolicyContext], Any] | None = None
    recency: Callable[[PolicyContext], Any] | None = None


_host: Defaults | None = None


def configure_defaults(host: Defaults) -> None:
    """Replaces the registered defaults as a whole."""
    global _host
    _host = host


def reset_defaults() -> None:
    global _host
    _host = None


def defaults_host() -> Defaults | None:
    return _host


def resolve_default(given: Any, resolver: Callable[[PolicyContext], Any] | None, context: PolicyContext) -> tuple[Any, bool]:
    """The value in force and whether the policy supplied it: a given value wins, False is off, and UNSET asks the
    policy, whose failure counts as no value."""
    if given is False:
        return None, False
    if given is not UNSET and given is not None:
        return given, False
    if resolver is None:
        return None, False
    try:
        value = resolver(context)
    except Exception:  # a policy never breaks a request
        return None, False
    return (None, False) if value is None or value is False else (value, True)


@dataclass(frozen=True)
class Applied:
    """The floors in force, or None; whether recency was mixed in; and whether a policy was registered."""

    min_score: dict[str, float] | None = None
    recency: bool = False
    policy_registered: bool = False


@dataclass(frozen=True)
class Resolved:
    min_score: dict[str, float]
    recency: Any
    applied: Applied


def resolve_defaults(request: Request, mode: str) -> Resolved:
    """Floors and recency in force, and which of the two are in force at all.  A full-text request applies no recency
    and reports none."""
    host = _host or Defaults()
    context = PolicyContext(request.query, request.limit, mode, request.embedder if mode != "fulltext" else None)
    floors, _ = resolve_default(request.min_score, host.min_score, context)
    recency, _ = (None, False) if mode == "fulltext" else resolve_default(request.recency, host.recency, context)
    return Resolved(floors or {}, recency, Applied(floors, recency is not None, _host is not None))
