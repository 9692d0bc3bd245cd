"""The corpus pipeline: STAGES of (name, function), each (spark, docs, sf_dir) -> DataFrame; run() applies them to documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bpe import round_trip
from tessera.llm.common import materialize
from tessera.llm.decontaminate import drop_contaminated
from tessera.llm.line_dedup import drop_repeated_lines
from tessera.llm.ngram_jaccard import keep_one_of_each
from tessera.llm.quality_rules import keep_good, trusted_documents


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the log-likelihood ratio reject go."""
    trusted = trusted_documents(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return keep_good(docs, trusted)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines repeated over documents go; n_chars follows the text."""
    return drop_repeated_lines(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def jaccard_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles, similarity of 0.8 or more."""
    return keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document that is left, and the digest of the text that they decode to."""
    import public_tokenizers

    out = round_trip(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "lang", "source", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("n-gram Jaccard join", jaccard_dedup), ("benchmark decontamination", decontamination), ("BPE encoding and decoding", bpe)]

#: Tokenizer and component stages are beyond SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
