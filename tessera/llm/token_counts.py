"""Token counts by an exact length histogram.

Documents are aggregated by their encoded length, and suffix sums over the lengths answer totals, quantiles and truncated
totals for every context limit. Only lengths leave the tokenizer's tasks. Suffix sums have two levels, within ranges of
RANGE lengths and over the ranges, so no task holds more than RANGE rows or one row a range.

Null and empty texts have length 0. Repeated rows count each. An empty table gives an empty histogram. Other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize, small_batches

RANGE = 1024


def token_lengths(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(n_tokens) of each row; path: a file of ranks, pattern: what splits text before the merges."""
    small_batches(docs.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(encoding.encode_ordinary(t)) if t else 0 for t in b.column("text").to_pylist()], pa.int64())], ["n_tokens"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(counted, "n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """A row for each length L (n_tokens): n_docs of that length, docs_at_least and tokens_at_least (suffix sums),
    docs_at_most, and truncated_total: the sum of min(length, L) over all documents."""
    counts = materialize(lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs")).withColumn("range", F.floor(F.col("n_tokens") / RANGE)), "histogram")
    ranges = counts.groupBy("range").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t"))
    above = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranges = ranges.select("range", *(F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_above") for c in "dt"), *(F.sum(c).over(every).alias(f"{c}_all") for c in "dt"))
    within = Window.partitionBy("range").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = counts.join(ranges, "range").withColumn("docs_at_least", F.col("d_above") + F.sum("n_docs").over(within))
    out = out.withColumn("tokens_at_least", F.col("t_above") + F.sum(F.col("n_docs") * F.col("n_tokens")).over(within))
    return out.select(
        "n_tokens", "n_docs", "docs_at_least", "tokens_at_least", (F.col("d_all") - F.col("docs_at_least") + F.col("n_docs")).alias("docs_at_most"),
        (F.col("t_all") - F.col("tokens_at_least") + F.col("docs_at_least") * F.col("n_tokens")).alias("truncated_total"),
    )


def for_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, n_fit, total, truncated_total) for any context limits: the next length at or above a limit answers it."""
    spark = histogram.sparkSession
    asked = spark.createDataFrame([(x,) for x in limits], "context_limit long")
    total = histogram.agg(F.sum("n_docs").alias("docs"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("total"))
    longer = histogram.join(F.broadcast(asked), F.col("n_tokens") > F.col("context_limit")).groupBy("context_limit").agg(F.max("docs_at_least").alias("d"), F.max("tokens_at_least").alias("t"))
    out = asked.join(longer, "context_limit", "left").join(F.broadcast(total), F.lit(True)).na.fill(0, ["d", "t", "docs", "total"])
    return out.select("context_limit", (F.col("docs") - F.col("d")).alias("n_fit"), "total", (F.col("total") - F.col("t") + F.col("d") * F.col("context_limit")).alias("truncated_total"))


def quantiles(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the smallest length that at least this share of the documents doesn't exceed."""
    asked = histogram.sparkSession.createDataFrame([(x,) for x in shares], "share double")
    total = histogram.agg(F.sum("n_docs").alias("docs"))
    return histogram.join(F.broadcast(total), F.lit(True)).join(F.broadcast(asked), F.col("docs_at_most") >= F.col("share") * F.col("docs")).groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))
