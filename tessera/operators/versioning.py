"""Versions of facts and survivorship of fields, set-based."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def new_versions(df: DataFrame, key: list[str], order: list[Column], content: list[str]) -> DataFrame:
    """Rows whose content differs from the row before of the same key, with `version` from 1; others are re-deliveries."""
    w = Window.partitionBy(*key).orderBy(*order)
    # As JSON, in which neither separators nor nulls can be mistaken for content.
    hashed = df.withColumn("content_hash", F.sha2(F.to_json(F.array(*(F.col(c).cast("string") for c in content))), 256))
    marked = hashed.withColumn("redelivery", F.coalesce(F.lag("content_hash").over(w) == F.col("content_hash"), F.lit(False)))
    return marked.where("not redelivery").drop("redelivery").withColumn("version", F.row_number().over(w))


def intervals(versions: DataFrame, key: list[str], start: str) -> DataFrame:
    """valid_from, valid_to (the next version's start) and status of each version."""
    w = Window.partitionBy(*key).orderBy("version")
    end = F.lead(start).over(w)
    return versions.withColumn("valid_from", F.col(start)).withColumn("valid_to", end).withColumn("status", F.when(end.isNull(), "CURRENT").otherwise("HISTORIC"))


def survivor(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The best row of each key; every tie-break is in order."""
    return df.withColumn("_place", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_place = 1").drop("_place")


def golden(df: DataFrame, key: list[str], fields: list[str], order: list[Column]) -> DataFrame:
    """For each key and field, the best row's non-null value, how many values there are, and whether they agree."""
    cols = []
    for f in fields:
        rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.col(f).isNull(), *order))
        df = df.withColumn(f"_r_{f}", rank)
        n = F.countDistinct(f)
        cols += [F.max(F.when(F.col(f"_r_{f}") == 1, F.col(f))).alias(f), F.when(n == 0, "ABSENT").when(n == 1, F.when(F.count(f) > 1, "CONFIRMED").otherwise("BASELINE")).otherwise("DIVERGENT").alias(f"{f}_state")]
    return df.groupBy(*key).agg(*cols)


def merged_rollup(target: DataFrame, source: DataFrame, key: list[str], sums: list[str], mins: list[str] = (), maxs: list[str] = ()) -> DataFrame:
    """target with source merged in: keys in both add up, others are inserted. Both have one row a key; keys may be null."""
    t, s = target.alias("t"), source.alias("s")
    on = [F.col(f"t.{k}").eqNullSafe(F.col(f"s.{k}")) for k in key]
    both = t.join(s, on, "full")
    zero = lambda c: F.coalesce(F.col(f"t.{c}"), F.lit(0)) + F.coalesce(F.col(f"s.{c}"), F.lit(0))
    return both.select(*(F.coalesce(f"t.{k}", f"s.{k}").alias(k) for k in key), *(zero(c).alias(c) for c in sums), *(F.least(f"t.{c}", f"s.{c}").alias(c) for c in mins), *(F.greatest(f"t.{c}", f"s.{c}").alias(c) for c in maxs))
