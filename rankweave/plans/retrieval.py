"""The two entry points: full text, and hybrid retrieval fused by reciprocal rank.

Everything is planned for a batch of queries; one query is a batch of one.  Legs are independent branches of one plan,
or, for one request, small tables that each came from a run of its own.
The order of steps is fixed: cap, cascade, floor, new positions, fresh dedupe, seats, fusion, columns, recency, rollup,
cut, headlines.  Columns of the rows are joined after the cut where no step needs them before.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import query_lexemes
from ..operators import floors, fusion, lexical, recency, rollup
from ..schema import EMBEDDINGS, FRESH, LEXICAL, LISTING, ROW, Params, Recency, Request
from ..sources.tables import TableSource
from ..streaming.health import observe_legs
from . import legs as L
from .embedding import Embedding
from .policy import Applied, resolve_defaults

log = logging.getLogger("rankweave")
OVERFETCH = 3
Queries = DataFrame | list[tuple[int, str]]


@dataclass
class Result:
    """hits (ordered by pos), the number of hits before the cut, and what the legs did."""

    hits: DataFrame
    total_hits: int
    legs: L.Legs
    applied: Applied
    total_groups: int | None = None
    embedder_available: bool | None = None


@dataclass
class Pool:
    """Listings of a batch with their counts still to be taken."""

    listings: list[DataFrame] = field(default_factory=list)
    raw: list[tuple[str, str, str, float | None, DataFrame]] = field(default_factory=list)  # leg, ranker, source, floor, before the floor
    lexical: L.LegAccumulator = field(default_factory=L.LegAccumulator)
    semantic: L.LegAccumulator = field(default_factory=L.LegAccumulator)


def _say(request: Request, message: str) -> None:
    log.info(message)
    if request.log is not None:
        request.log(message)


def _held(spark: SparkSession, leg: DataFrame, eager: bool) -> DataFrame:
    """A leg that runs by itself if asked to, so that its failure is its own; a leg has at most its cap of rows a query."""
    return spark.createDataFrame(leg.toArrow()) if eager else leg


def _check(request: Request) -> None:
    if request.signal is not None:
        request.signal.check()


def gather(spark: SparkSession, sources: list[TableSource], request: Request, queries: Queries, cap: int, mode: str, min_score: dict[str, float], rec: Recency | None, now_ms: int, vectors: Callable[[], list] | None = None) -> Pool:
    """Listings of all legs.  vectors is a function that waits for the query vectors, or None; the term legs don't wait."""
    pool, n = Pool(), len(sources)
    eager = request.materialize_legs and isinstance(queries, list) and len(queries) * cap <= lexical.BROADCAST_ROWS
    widen = request.lexical_cascade and request.lexical_mode is None
    params = request.params(cap)
    since = recency.fresh_since(rec, mode, request.filters.since, now_ms)

    def call(acc: L.LegAccumulator, leg: str, ranker: str, s: TableSource, scan: Callable[[], DataFrame]) -> DataFrame | None:
        """The listing of one call after its floor, or None if the call failed."""
        _check(request)
        acc.attempted = True
        floor = floors.resolve_floor(min_score, ranker)
        try:
            found = _held(spark, scan(), eager)
        except Exception as e:
            _check(request)
            acc.failed(s.name, e)
            _say(request, f"{ranker} {s.name} skipped: {e}")
            return None
        acc.calls_run += 1
        pool.raw.append((leg, ranker, s.name, floor, found))
        return floors.apply_floor(found, floor)

    if mode != "embeddings":
        terms = lexical.query_terms(spark, queries)
        fresh_params = replace(params, filters=replace(params.filters, since=since))
        for i, s in enumerate(sources):
            main = call(pool.lexical, "lexical", LEXICAL, s, lambda s=s, i=i: s.lexical(params, terms, widen, LEXICAL, 2 * i))
            if main is not None:
                pool.listings.append(main)
            if since is not None:
                fresh = call(pool.lexical, "lexical", FRESH, s, lambda s=s, i=i: s.lexical(fresh_params, terms, False, FRESH, 2 * i + 1))
                if fresh is not None:
                    pool.listings.append(recency.fresh_rows(fresh, main, recency.fresh_seats(request.limit)))
    found: list[tuple[int, list[float]]] = []
    if vectors is not None:
        try:
            found = vectors()
        except Exception as e:
            _check(request)
            pool.semantic.attempted = True
            pool.semantic.blocked = f"query embed failed: {e}"
            _say(request, pool.semantic.blocked)
    for i, s in enumerate(sources if found else []):
        if s.vectors is not None:
            near = call(pool.semantic, "semantic", EMBEDDINGS, s, lambda s=s, i=i: s.embedding(params, found, 2 * n + i))
            if near is not None:
                pool.listings.append(near)
    return pool


def _listings(spark: SparkSession, pool: Pool) -> list[DataFrame]:
    return [x.drop("appended") for x in pool.listings or [spark.createDataFrame([], LISTING)]]


def with_columns(ranking: DataFrame, sources: list[TableSource], p: Params, small: bool, hydrate: bool = False) -> DataFrame:
    """The sources' columns for the rows of a ranking; with hydrate, sources that give headlines later leave them out."""
    parts = []
    for s in sources:
        want = replace(p, want_highlight=False) if hydrate and s.hydrates else p
        parts.append(s.attached(ranking.where(F.col("source") == s.name), want, small))
    columns = [c for c in ranking.columns if c != "source_id"]
    if not parts:
        return ranking.select(*(F.col(n) if n in ranking.columns else F.lit(None).cast(t).alias(n) for n, t in (ROW | {"highlight": "string"}).items()), *columns)
    return reduce(DataFrame.unionByName, (x.select(*ROW, "highlight", *columns) for x in parts))


def page_of(ranking: DataFrame, limit: int, group_by: Column | None) -> DataFrame:
    return rollup.first_of_groups(ranking, group_by, limit) if group_by is not None else rollup.cut(ranking, limit)


def highlighted(page: DataFrame, sources: list[TableSource], words: list[str], request: Request) -> DataFrame:
    """Fills highlight for the rows of a page, in one pass over each source that it holds; where that fails, or finds
    nothing, the highlight stays as it is."""
    parts = []
    for s in sources:
        _check(request)
        if not s.hydrates:
            continue
        try:
            made = s.highlights(page.where(F.col("source") == s.name), words).select(F.lit(s.name).alias("source"), "source_id", F.col("highlight").alias("made"))
            parts.append(_held(page.sparkSession, made, request.materialize_legs))
        except Exception as e:
            _check(request)
            _say(request, f"highlight {s.name} skipped: {e}")
    if not parts:
        return page
    made = F.broadcast(reduce(DataFrame.unionByName, parts))  # rows of the page
    return page.join(made, ["source", "source_id"], "left").withColumn("highlight", F.coalesce("made", "highlight")).drop("made")


def leg_counts(pool: Pool) -> DataFrame | None:
    """Rows by call (k, its number): n before its floor, kept by it, added by a widening; and given to fusion."""
    parts = []
    for k, (_, _, _, floor, raw) in enumerate(pool.raw):
        kept = F.lit(True) if floor is None else ~F.isnan("score") & (F.col("score") >= F.lit(floor))
        parts.append(raw.select(F.lit(k).alias("k"), F.lit(1).alias("n"), kept.cast("int").alias("kept"), F.col("appended").cast("int").alias("added"), F.lit(0).alias("given")))
    for k, listing in enumerate(pool.listings):
        parts.append(listing.select(F.lit(k).alias("k"), F.lit(0).alias("n"), F.lit(0).alias("kept"), F.lit(0).alias("added"), F.lit(1).alias("given")))
    return reduce(DataFrame.unionByName, parts).groupBy("k").agg(*(F.sum(c).alias(c) for c in ("n", "kept", "added", "given"))) if parts else None


def count_legs(pool: Pool, request: Request) -> None:
    """Fills the accumulators from one aggregate over all listings: a row for each call."""
    counts = leg_counts(pool)
    rows = {r["k"]: r for r in counts.collect()} if counts is not None else {}
    for k, (leg, ranker, source, floor, _) in enumerate(pool.raw):
        if k in rows:
            acc, r = getattr(pool, leg), rows[k]
            acc.floored += r["n"] - r["kept"]
            acc.stage2_added += r["added"]
            acc.candidates += r["given"]
            if floor is not None and r["n"] > r["kept"]:
                _say(request, floors.floor_message(ranker, source, floor, r["n"] - r["kept"], r["n"]))


def report(pool: Pool, request: Request) -> L.Legs:
    count_legs(pool, request)
    return observe_legs(L.summarise_legs(L.finalise_leg(pool.lexical), L.finalise_leg(pool.semantic)))


def fulltext_ranking(spark: SparkSession, sources: list[TableSource], request: Request, queries: Queries) -> tuple[DataFrame, Pool, Applied]:
    """All rows of all sources' term listings by native score; ties go by source, then by place.  No dedupe."""
    resolved = resolve_defaults(request, "fulltext")
    pool = gather(spark, sources, request, queries, request.limit, "fulltext", resolved.min_score, None, 0)
    rows = reduce(DataFrame.unionByName, _listings(spark, pool))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "input_ord", "pos")
    ranking = rows.withColumn("final", F.row_number().over(order)).withColumn("pos", F.col("final"))
    ranking = ranking.withColumns({"rankers": F.array("ranker"), "ranker_scores": F.create_map("ranker", "score")})
    return ranking.drop("final", "ranker", "input_ord"), pool, resolved.applied


@contextmanager
def _tagged(spark: SparkSession, request: Request):
    """Spark jobs of a request carry its signal's tag, so that abort can interrupt them; an interrupted job is an abort."""
    tag = request.signal.tag if request.signal is not None else None
    _check(request)
    if tag:
        spark.addTag(tag)
    try:
        yield
    except Exception:
        _check(request)
        raise
    finally:
        if tag:
            spark.removeTag(tag)


def run_full_text(spark: SparkSession, sources: list[TableSource], request: Request) -> Result:
    """Term retrieval over all sources, ranked by native score."""
    with _tagged(spark, request):
        words = tuple(query_lexemes(request.query))
        ranking, pool, applied = fulltext_ranking(spark, sources, request, [(0, request.query)])
        legs = report(pool, request)
        page = with_columns(rollup.cut(ranking, request.limit), sources, request.params(request.limit, words), True, request.defer_highlight)
        hits = highlighted(page, sources, list(words), request) if request.defer_highlight else page
        return Result(_held(spark, hits, request.materialize_legs), legs.lexical.candidates, legs, applied)


def run_hybrid(spark: SparkSession, sources: list[TableSource], request: Request) -> Result:
    """Term and vector retrieval fused by reciprocal rank, or vector retrieval alone in mode 'embeddings'."""
    with _tagged(spark, request):
        return _hybrid(spark, sources, request)


def _hybrid(spark: SparkSession, sources: list[TableSource], request: Request) -> Result:
    resolved = resolve_defaults(request, request.mode)
    rec = resolved.recency
    now_ms = rec.now_ms if rec is not None and rec.now_ms is not None else int(time.time() * 1000)
    embedding = Embedding(request.embedder, request.query) if request.embedder is not None else None
    vectors = (lambda: [(0, embedding.result(request.embed_timeout_ms, request.signal))]) if embedding else None
    cap, words = OVERFETCH * request.limit, tuple(query_lexemes(request.query))
    pool = gather(spark, sources, request, [(0, request.query)], cap, request.mode, resolved.min_score, rec, now_ms, vectors)
    legs = report(pool, request)
    params, defer = request.params(cap, words), request.defer_highlight
    ranking = fusion.fuse(_listings(spark, pool))
    early = rec is not None or request.group_by is not None  # a step before the cut looks at the columns
    if early:
        ranking = with_columns(ranking, sources, params, True, defer)
    if rec is not None:
        ranking = recency.rerank(ranking, rec, now_ms)
    ranking = _held(spark, ranking, request.materialize_legs)  # at most three listings of 3 * limit rows a source
    total, groups = ranking.count(), None
    if request.group_by is not None:
        first = rollup.group_counts(ranking, request.group_by).first()
        groups = first["total_groups"] if first else 0
    _check(request)
    page = page_of(ranking, request.limit, request.group_by)
    if not early:
        page = with_columns(page, sources, params, True, defer)
    page = highlighted(page, sources, list(words), request) if defer else page
    return Result(_held(spark, page, request.materialize_legs), total, legs, resolved.applied, groups, embedding is not None and pool.semantic.blocked is None)


def hybrid_batch(spark: SparkSession, sources: list[TableSource], request: Request, queries: Queries, vectors: list[tuple[int, list[float]]] | None = None) -> DataFrame:
    """The fused ranking of every query of a batch (query_id, text), as one lazy plan; pos is the place in it.

    Rows have keys and scores; with_columns() adds the sources' columns, as recency does on its way.
    """
    resolved = resolve_defaults(request, request.mode)
    rec: Any = resolved.recency
    now_ms = rec.now_ms if rec is not None and rec.now_ms is not None else int(time.time() * 1000)
    lazy = replace(request, materialize_legs=False)
    pool = gather(spark, sources, lazy, queries, OVERFETCH * request.limit, request.mode, resolved.min_score, rec, now_ms, (lambda: vectors) if vectors else None)
    ranking = fusion.fuse(_listings(spark, pool))
    if rec is None:
        return ranking
    few = isinstance(queries, list) and len(queries) * 4 * OVERFETCH * request.limit * len(sources) <= lexical.BROADCAST_ROWS
    return recency.rerank(with_columns(ranking, sources, request.params(request.limit), few, True), rec, now_ms)
