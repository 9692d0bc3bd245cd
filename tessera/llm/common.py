"""Helpers shared by the corpus operators: scratch tables, skew-safe lookups, components."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most keys that skew_safe_lookup() broadcasts; a key beyond them holds at most 1/HOT_KEYS of the rows.
HOT_KEYS = 512
#: Rows in an Arrow batch sent to Python, so that a batch of very long texts stays small.
BATCH_ROWS = 512

#: Hadoop's local file system starts a chmod for a task's folder, for its file and for the checksum file, and a process just forked counts as a
#: second copy of its executor. Scratch tables in a local folder do without the checksum file, the third of the three; other stores don't read these options.
LOCAL_WRITES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: ASCII white space: space and \t \n \v \f \r.
SPACES = " \t\n\x0b\x0c\r"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for scratch tables: spark.checkpoint.dir. Where it is unset, a temporary folder on a local master, and an error on a cluster."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = os.path.join(tempfile.gettempdir(), "tessera-scratch")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared scratch folder and read it back: lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**LOCAL_WRITES).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of Python stages in this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else; text without other characters takes the fast path."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, ASCII_UPPER, ASCII_UPPER.lower()))


def skew_safe_lookup(rows: DataFrame, table: DataFrame, keys: list[str], values: list[str], weight: str, spread: Column) -> DataFrame:
    """rows LEFT JOIN table (unique by keys), whatever share of rows one key holds.

    The HOT_KEYS keys of the largest weight (rows of the key) are broadcast, at most HOT_KEYS rows whatever the input;
    rows they answer get a salt that spreads them over all tasks, the others meet the table by an ordinary shuffle join.
    """
    hot = table.orderBy(F.desc(weight), *keys).limit(HOT_KEYS).select(*keys, F.struct(*values).alias("_hot"))
    salted = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.when(F.col("_hot").isNotNull(), 1 + F.pmod(F.xxhash64(spread), F.lit(1 << 20))).otherwise(F.lit(0).cast("long")))
    # Always 0, but nothing that the optimizer can know: it would join by the keys alone, and hot rows would meet in a task again.
    cold_salt = F.pmod(F.coalesce(F.col(weight).cast("long"), F.lit(0)), F.lit(1)).cast("long")
    found = salted.join(table.select(*keys, F.struct(*values).alias("_cold"), cold_salt.alias("_salt")), [*keys, "_salt"], "left")
    got = F.coalesce("_hot", "_cold")
    return found.select(*rows.columns, *(got[v].alias(v) for v in values))


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, component): the smallest node reachable over edges (src, dst), for each node that has an edge.

    Each round takes the smallest label of the neighbours, then jumps to the label of the label, so that
    chains shorten by halves. Rounds are written to the shared scratch folder.
    """
    both = materialize(edges.select("src", "dst").union(edges.select("dst", "src")).where("src <> dst").distinct(), "edges")
    labels = materialize(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.col("src")).alias("component")), "labels")
    for _ in range(rounds):
        near = both.join(labels, both.dst == labels.node).groupBy("src").agg(F.min("component").alias("near"))
        step = labels.join(near, labels.node == near.src).select("node", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        top = step.select(F.col("node").alias("component"), F.col("component").alias("above"))
        new = materialize(step.join(top, "component", "left").select("node", "was", F.least("component", "above").alias("component")), "labels")
        labels = new.select("node", "component")
        if new.where("component <> was").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")
