"""What each leg of a request contributed, and whether the result is degraded."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.provenance import is_lexical_ranker, lexical_name

NAMED_FAILURES = 3


@dataclass
class LegAccumulator:
    """candidates: rows given to fusion, after floor, dedupe and seats; stage2_added counts before the floor."""

    attempted: bool = False
    candidates: int = 0
    floored: int = 0
    stage2_added: int = 0
    calls_run: int = 0
    calls_failed: int = 0
    failures: list[tuple[str, str]] = field(default_factory=list)
    blocked: str | None = None

    def failed(self, source: str, error: Exception) -> None:
        self.calls_failed += 1
        self.failures.append((source, str(error).splitlines()[0] if str(error) else type(error).__name__))


@dataclass(frozen=True)
class LegReport:
    status: str  # 'ran', 'not-run' or 'errored'
    candidates: int = 0
    floored: int = 0
    stage2_added: int = 0
    calls_run: int = 0
    calls_failed: int = 0
    failures: tuple[tuple[str, str], ...] = ()
    blocked: str | None = None


@dataclass(frozen=True)
class Legs:
    lexical: LegReport
    semantic: LegReport
    degraded: bool
    warning: str | None


def leg_of_ranker(ranker: str) -> str:
    return "lexical" if is_lexical_ranker(ranker) else "semantic"


def leg_column(ranker: Column) -> Column:
    return F.when(lexical_name(ranker), "lexical").otherwise("semantic")


def leg_status(attempted: bool, blocked: bool, run: int, failed: int) -> str:
    if not attempted:
        return "not-run"
    if blocked or (run == 0 and failed > 0):
        return "errored"
    return "ran" if run else "not-run"


def status_column(attempted: Column, blocked: Column, run: Column, failed: Column) -> Column:
    return F.when(~attempted, "not-run").when(blocked | ((run == 0) & (failed > 0)), "errored").when(run == 0, "not-run").otherwise("ran")


def finalise_leg(a: LegAccumulator) -> LegReport:
    status = leg_status(a.attempted, a.blocked is not None, a.calls_run, a.calls_failed)
    return LegReport(status, a.candidates, a.floored, a.stage2_added, a.calls_run, a.calls_failed, tuple(a.failures), a.blocked)


def empty_legs() -> Legs:
    return Legs(LegReport("not-run"), LegReport("not-run"), False, None)


def failure_text(failures: tuple[tuple[str, str], ...]) -> str:
    named = [f"{source} ({error})" for source, error in failures[:NAMED_FAILURES]]
    more = len(failures) - len(named)
    return ", ".join(named) + (f" +{more} more" if more > 0 else "")


def summarise_legs(lexical: LegReport, semantic: LegReport) -> Legs:
    """A request is degraded if a leg was blocked or failed, wholly or in part, or if one leg brought nothing while the
    other did.  Two legs that both found nothing are healthy."""
    reasons = []
    both = (("lexical", lexical), ("semantic", semantic))
    reasons += [f"{name} leg blocked: {leg.blocked}" for name, leg in both if leg.blocked is not None]
    reasons += [f"every {name} source call failed: {failure_text(leg.failures)}" for name, leg in both if leg.blocked is None and leg.status == "errored"]

    def empty(name: str, leg: LegReport, other: LegReport, only: str) -> list[str]:
        if leg.candidates or not other.candidates:
            return []
        cause = f" (the score floor removed all {leg.floored})" if leg.floored else ""
        return [f"{name} leg contributed 0 candidates{cause}: the result is {only}-only"]

    if lexical.status != "not-run":
        reasons += empty("lexical", lexical, semantic, "semantic")
    if semantic.status != "not-run" and semantic.blocked is None:
        reasons += empty("semantic", semantic, lexical, "lexical")
    reasons += [f"{leg.calls_failed} {name} source call(s) failed: {failure_text(leg.failures)}" for name, leg in both if leg.calls_failed and leg.calls_run]
    return Legs(lexical, semantic, bool(reasons), "; ".join(reasons) or None)
