"""Frozen snapshots: sorted Parquet parts beside a manifest of their digests, written once and verified before use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _parts(spark: SparkSession, path: str) -> DataFrame:
    """(part, bytes, sha256) of the files of a snapshot, digested where they are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{path}/data")
    return files.select(F.element_at(F.split("path", "/"), -1).alias("part"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def capture(df: DataFrame, path: str, keys: list[str], rows_a_part: int = 1_000_000) -> DataFrame:
    """Write df in order of keys in parts of at most rows_a_part rows, then its manifest (part, bytes, sha256). A path that exists is an error."""
    df.orderBy(*keys).write.option("maxRecordsPerFile", rows_a_part).mode("error").parquet(f"{path}/data")
    _parts(df.sparkSession, path).write.mode("error").parquet(f"{path}/manifest")
    return df.sparkSession.read.parquet(f"{path}/manifest")


def verify(spark: SparkSession, path: str) -> DataFrame:
    """(part, problem) of parts that are MISSING, EXTRA or CHANGED since the capture; no rows when the snapshot is whole."""
    was = spark.read.parquet(f"{path}/manifest").select("part", F.col("sha256").alias("was"))
    both = was.join(_parts(spark, path).select("part", F.col("sha256").alias("now")), "part", "full_outer")
    problem = F.when(F.col("now").isNull(), "MISSING").when(F.col("was").isNull(), "EXTRA").when(F.col("was") != F.col("now"), "CHANGED")
    return both.select("part", problem.alias("problem")).where("problem is not null")


def replay(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a snapshot that verifies; one that doesn't is an error."""
    bad = verify(spark, path).limit(5).collect()
    if bad:
        raise ValueError(f"snapshot {path} is not what was captured: {[(r.part, r.problem) for r in bad]}")
    return spark.read.parquet(f"{path}/data")
