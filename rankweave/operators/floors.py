"""Score floors, applied to each ranker's listing before fusion."""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def resolve_floor(floors: dict[str, float] | Any, ranker: str) -> float | None:
    """A ranker's own floor, else that of its family (the name before the first dash), else none.  NaN is no floor."""

    def entry(name: str) -> float | None:
        f = floors.get(name) if isinstance(floors, dict) else None
        return None if f is None or math.isnan(f) else float(f)

    own, dash = entry(ranker), ranker.find("-")
    return own if own is not None or dash <= 0 else entry(ranker[:dash])


def keep_from(listing: DataFrame, floor: float | None) -> DataFrame:
    """Rows with a score of at least the floor; without one all rows, NaN among them, and no filter in the plan."""
    return listing if floor is None else listing.where(~F.isnan("score") & (F.col("score") >= F.lit(floor)))


def reposition(listing: DataFrame, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Closes the gaps in pos that a filter left."""
    return listing.withColumn("pos", F.row_number().over(Window.partitionBy(*by).orderBy("pos")))


def apply_floor(listing: DataFrame, floor: float | None) -> DataFrame:
    return listing if floor is None else reposition(keep_from(listing, floor))


def floor_counts(listing: DataFrame, floor: float | None) -> DataFrame:
    """query_id, candidates and dropped of a listing."""
    kept = F.lit(True) if floor is None else ~F.isnan("score") & (F.col("score") >= F.lit(floor))
    return listing.groupBy("query_id").agg(F.count_if(kept).alias("candidates"), F.count_if(~kept).alias("dropped"))


def floor_message(ranker: str, source: str, floor: float, dropped: int, total: int) -> str:
    return f"{ranker} {source} minScore {floor:g} dropped {dropped}/{total}"
