"""Time decay mixed into a fused ranking, and the window that gives fresh rows a bounded number of seats."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import decay
from ..schema import Recency
from .floors import reposition

TAG = "recency"


def rerank(fused: DataFrame, recency: Recency, now_ms: int) -> DataFrame:
    """Replaces score by the blend of relevance and decay, and pos by its order; equal blends keep the fused order.

    linear: (1 - w) * relevance + w * decay, relevance being 1 - (rows strictly above) / (n - 1), and 1 if n is 1.
    multiply: score / (greatest score) * decay ** w, 0 if no score is positive.
    Rows with a time get the ranker `recency` if the weight is positive.
    """
    w, per_query = recency.clamped, Window.partitionBy("query_id")
    time = recency.time if recency.time is not None else F.col("ts_ms")
    fade = decay(time, now_ms, recency.half_life_ms)
    if recency.mode == "multiply":
        top = F.max("score").over(per_query)
        blend = F.when(top > 0, F.col("score") / top).otherwise(F.lit(0.0)) * F.pow(fade, F.lit(w))
    else:
        relevance = F.lit(1.0) - F.percent_rank().over(per_query.orderBy(F.desc("score")))
        blend = F.lit(1 - w) * relevance + F.lit(w) * fade
    tagged = F.when(time.isNotNull() & F.lit(w > 0), F.concat("rankers", F.array(F.lit(TAG)))).otherwise(F.col("rankers"))
    out = fused.select("*", F.round(blend, 12).alias("blend"), tagged.alias("tagged")).drop("score", "rankers").withColumnsRenamed({"blend": "score", "tagged": "rankers"})
    return out.withColumn("pos", F.row_number().over(per_query.orderBy(F.desc("score"), "pos")))


def fresh_since(recency: Recency | None, mode: str, since: int | None, now_ms: int) -> int | None:
    """Where the fresh window begins, or None if no fresh leg runs: only hybrid mode with weight and window has one, and
    none is needed if the caller's own bound is as late."""
    if recency is None or mode != "hybrid" or recency.clamped <= 0 or recency.fresh_window_ms <= 0:
        return None
    begin = now_ms - int(recency.fresh_window_ms)
    return None if since is not None and since >= begin else begin


def fresh_seats(limit: int) -> int:
    return max(1, limit // 4)


def fresh_rows(fresh: DataFrame, main: DataFrame | None, seats: int) -> DataFrame:
    """The first `seats` rows of a fresh listing that the source's main listing lacks, from place 1 on."""
    if main is not None:
        fresh = fresh.join(main.select("query_id", "key"), ["query_id", "key"], "left_anti")
    return reposition(fresh).where(F.col("pos") <= seats)
