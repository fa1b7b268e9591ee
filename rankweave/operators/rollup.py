"""One row per group, in the order of the ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_of_groups(ranking: DataFrame, group: Column, limit: int) -> DataFrame:
    """Each group's first row by pos, at most `limit` of a query; a null group is a slot of its own and merges with none."""
    if limit <= 0:
        return ranking.where("false")
    slot = F.struct(group.isNull().alias("alone"), F.coalesce(group.cast("string"), F.col("key")).alias("name"))
    tops = ranking.withColumn("_slot", slot).withColumn("_nth", F.row_number().over(Window.partitionBy("query_id", "_slot").orderBy("pos"))).where("_nth = 1").drop("_slot", "_nth")
    return cut(tops.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy("pos"))), limit)


def cut(ranking: DataFrame, limit: int) -> DataFrame:
    return ranking.where(F.col("pos") <= limit)


def group_counts(ranking: DataFrame, group: Column) -> DataFrame:
    """query_id and total_groups: distinct groups plus rows without one, over the whole ranking."""
    by_group = ranking.groupBy("query_id", group.cast("string").alias("_g")).agg(F.count("*").alias("n"))
    return by_group.groupBy("query_id").agg(F.sum(F.when(F.col("_g").isNull(), F.col("n")).otherwise(F.lit(1))).alias("total_groups"))
