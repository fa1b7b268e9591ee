"""Reciprocal rank fusion of listings (Cormack, Clarke and Buettcher, SIGIR 2009)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 60
#: Fused scores are rounded so that the order of additions never splits a tie.
DIGITS = 12


def fuse(listings: list[DataFrame], k: int = K) -> DataFrame:
    """One row per query and key: the sum of 1 / (k + pos) over the listings that hold it.

    A key that a listing holds twice counts at its first place.  Ties go by the first entry's (input_ord, pos); rankers
    are in the order in which they first contributed, and ranker_scores has each ranker's native score from its first
    entry.  One shuffle, by query and key.
    """
    entries = reduce(DataFrame.unionByName, listings)
    entry = F.struct("input_ord", "pos", "ranker", "score", "source", "source_id")
    lists = entries.groupBy("query_id", "key").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    inputs = F.array_distinct(F.transform("e", lambda x: x["input_ord"]))
    once = F.transform(inputs, lambda o: F.get(F.filter("e", lambda x: x["input_ord"] == o), F.lit(0)))
    names = F.array_distinct(F.transform("e", lambda x: x["ranker"]))
    native = F.map_from_arrays(names, F.transform(names, lambda r: F.get(F.filter("e", lambda x: x["ranker"] == r), F.lit(0))["score"]))
    score = F.aggregate(once, F.lit(0.0), lambda acc, x: acc + F.lit(1.0) / (F.lit(k) + x["pos"]))
    head = F.get("e", F.lit(0))
    fused = lists.select("query_id", "key", head["source"].alias("source"), head["source_id"].alias("source_id"), F.round(score, DIGITS).alias("score"), names.alias("rankers"), native.alias("ranker_scores"), head["input_ord"].alias("input_ord"), head["pos"].alias("input_pos"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "input_ord", "input_pos")
    return fused.withColumn("pos", F.row_number().over(order)).drop("input_ord", "input_pos")
