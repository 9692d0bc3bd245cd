"""Samples of pairs for estimates, in a fixed pseudo-random order, and whether they suffice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_hash(seed: str, *keys: str) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(seed), *(F.col(k).cast("string") for k in keys)), 256)


def matched_pairs(observations: DataFrame, seed: str, most: int) -> DataFrame:
    """(person, left_id, right_id): each person's latest observations by its first two managers in hash order; `most` persons in hash order.

    observations: (id, person, manager, at). Only two rows a person meet, so a person of many rows makes no more pairs.
    """
    latest = Window.partitionBy("person", "manager").orderBy(F.desc("at"), F.desc("id"))
    one = observations.where("person is not null and manager is not null").withColumn("_n", F.row_number().over(latest)).where("_n = 1")
    turn = one.withColumn("_n", F.row_number().over(Window.partitionBy("person").orderBy(order_hash(seed, "manager"), "manager"))).where("_n <= 2")
    pairs = turn.groupBy("person").agg(F.max(F.when(F.col("_n") == 1, F.col("id"))).alias("left_id"), F.max(F.when(F.col("_n") == 2, F.col("id"))).alias("right_id")).where("right_id is not null")
    return pairs.orderBy(order_hash(seed, "person"), "person").limit(most)


def unmatched_pairs(observations: DataFrame, seed: str, most: int) -> DataFrame:
    """(block, left_id, right_id): neighbours in hash order within a block that are different persons; `most` of them in hash order.

    observations: (id, person, block). n rows make n - 1 pairs and not their square.
    """
    w = Window.partitionBy("block").orderBy(order_hash(seed, "id"), "id")
    next_ = observations.where("block is not null and person is not null").withColumn("right_id", F.lead("id").over(w)).withColumn("_other", F.lead("person").over(w))
    pairs = next_.where("right_id is not null and _other <> person").select("block", F.col("id").alias("left_id"), "right_id")
    return pairs.orderBy(order_hash(seed, "left_id", "right_id"), "left_id", "right_id").limit(most)


def sufficiency(pairs: DataFrame, by: list[str], least_pairs: int, least_groups: int) -> DataFrame:
    """(*by, pairs, groups, contradictory, sufficient) of labelled pairs (a, b, truth, grp): pairs are counted once in either order;
    a pair with both labels, or none, makes its stratum insufficient."""
    once = pairs.groupBy(*by, F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.countDistinct("truth").alias("labels"), F.min("grp").alias("grp"))
    out = once.groupBy(*by).agg(F.count("*").alias("pairs"), F.countDistinct("grp").alias("groups"), F.count_if(F.col("labels") != 1).alias("contradictory"))
    return out.withColumn("sufficient", (F.col("pairs") >= least_pairs) & (F.col("groups") >= least_groups) & (F.col("contradictory") == 0))
