"""Quality rules: base counts and an n-gram log-likelihood ratio, in DataFrame functions only.

Word unigrams and bigrams are hashed into BUCKETS; a trusted-target and a raw-corpus multinomial over the buckets give
log(p_target / p_raw) of each bucket. A document's score is the sum over its n-grams divided by their number, and
a document is kept when its base rules hold and its score reaches the threshold. The raw corpus is every document, so its
counts grow with the input; the ratios are one number a bucket, so they reach the scan as a constant.

Nulls and texts without words have no n-grams: n_words 0, base_failed, score 0. A null doc_id is never trusted; other
columns pass through, but those named like a result column, which are replaced. Without any trusted document all ratios are 0
and the base rules decide. Rows that repeat count each. Empty tables give empty tables.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.bloom import BlockedBloom
from tessera.llm.common import SPACES, materialize

BUCKETS = 1 << 15  # a power of two
#: Least mean log-likelihood ratio of a kept document.
THRESHOLD = -0.3
#: Added to each bucket's count, as a share of the mean count, and the bound of a bucket's log ratio.
SMOOTHING, BOUND = 0.05, 4.0
WINDOW = 5
RESULT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"]


def words_of(text: str | Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", -1), "")


def word_hashes(words: str | Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def gram_buckets(hashes: str) -> Column:
    """Buckets of the unigrams and bigrams of a column of word hashes."""
    bucket = lambda h: h.bitwiseAND(BUCKETS - 1).cast("int")
    one = F.transform(hashes, bucket)
    two = F.transform(F.sequence(F.lit(0), F.size(hashes) - 2), lambda i: bucket(F.xxhash64(F.get(hashes, i), F.get(hashes, i + 1))))
    return F.when(F.size(hashes) < 2, one).otherwise(F.concat(one, two))


def repeated_words(hashes: str) -> Column:
    """Words in WINDOW-word windows that the text holds twice or more, from word hashes of the text."""
    n = F.size(hashes)
    at = lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(WINDOW)))
    return F.when(n < WINDOW, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), n - WINDOW), at))


def base_counts(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) plus _wh (word hashes) and the base columns."""
    d = docs.withColumn("_text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    d = d.withColumn("_words", words_of("_text")).withColumn("_wh", word_hashes("_words"))
    d = d.withColumn("_win", repeated_words("_wh"))
    # Most texts have no window twice; only the others are sorted.
    d = d.withColumn("_sorted", F.when(F.size("_win") > F.size(F.array_distinct("_win")), F.sort_array(F.transform("_win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda i, j: F.get("_sorted", i).h == F.get("_sorted", j).h
    again = F.filter(F.sequence(F.lit(0), F.size("_sorted") - 1), lambda i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)))
    d = d.withColumn("_at", F.when(F.col("_sorted").isNotNull(), F.sort_array(F.transform(again, lambda i: F.get("_sorted", i).i))))
    covered = F.aggregate(F.transform("_at", lambda p, k: F.when(k + 1 < F.size("_at"), F.least(F.get("_at", k + 1) - p, F.lit(WINDOW))).otherwise(WINDOW)), F.lit(0).cast("long"), lambda a, x: a + x)
    d = d.withColumn("_lines", F.filter(F.split("_text", "\n", -1), lambda x: F.char_length(F.btrim(x, F.lit(SPACES))) > 0))
    n_words = F.size("_words").cast("long")
    out = d.withColumns({
        "n_words": n_words,
        "word_chars": F.char_length(F.array_join("_words", "")).cast("long"),
        "n_symbols": F.char_length(F.regexp_replace("_text", "[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": F.coalesce(covered, F.lit(0).cast("long")),
    })
    out = out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    return out.drop("_text", "_words", "_win", "_sorted", "_at", "_lines")


def log_ratios(docs: DataFrame, trusted: DataFrame) -> list[float]:
    """log(p_target / p_raw) of each bucket. trusted: doc_id of trusted documents; target: all of them; raw: all of docs.

    Texts stay where they are but for a few: a Bloom filter of the trusted ids tells what may be trusted, and a second one of the ids that
    the first lets through wrongly tells what surely is. Only documents that pass both meet the ids in an exact join.
    """
    ids = materialize(trusted.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType)).where("doc_id is not null"), "trusted")
    key = F.xxhash64("doc_id")
    maybe = BlockedBloom.build(ids, key)
    # A null id that passes is among the wrong ones.
    wrong = materialize(maybe.possible(docs.select("doc_id"), key).join(ids, "doc_id", "left_anti").distinct(), "wrong")
    tested = BlockedBloom.build(wrong, key).tested(maybe.tested(docs.select("doc_id", "text"), key, "_maybe"), key, "_unsure")
    hashes = word_hashes(words_of(F.col("text").cast("string"))).alias("wh")
    grams = tested.select(F.lit(1).alias("r"), F.expr("int(_maybe and not _unsure)").alias("t"), hashes)
    grams = grams.union(tested.where("_maybe and _unsure").join(ids, "doc_id", "left_semi").select(F.lit(0), F.lit(1), hashes))
    # explode_outer: for explode, the optimizer adds a filter that evaluates the whole array once more, inlined in its lambdas.
    counts = grams.select("r", "t", F.explode_outer(gram_buckets("wh")).alias("bucket")).where("bucket is not null").groupBy("bucket").agg(F.sum("r").alias("raw"), F.sum("t").alias("target"))
    raw, target = [0] * BUCKETS, [0] * BUCKETS
    for r in counts.collect():  # BUCKETS rows at most
        raw[r.bucket], target[r.bucket] = r.raw, r.target
    if not sum(target):
        return [0.0] * BUCKETS
    def smooth(counts: list[int]) -> list[float]:
        n = sum(counts)
        return [(x + SMOOTHING * n / BUCKETS) / (n * (1 + SMOOTHING)) for x in counts]

    return [round(min(BOUND, max(-BOUND, math.log(t / r))), 6) for t, r in zip(smooth(target), smooth(raw), strict=True)]


def judge(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs plus the base columns, score and kept, one row for each row of docs."""
    ratios = F.from_json(F.lit(json.dumps(log_ratios(docs, trusted))), "array<double>")
    d = base_counts(docs)
    total = F.aggregate(gram_buckets("_wh"), F.lit(0.0), lambda a, b: a + F.get(ratios, b))
    d = d.withColumn("score", F.when(F.size("_wh") == 0, 0.0).otherwise(total / F.greatest(2 * F.size("_wh") - 1, F.lit(1))))
    d = d.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
    # Behind a generator, since filters on columns of projections are pushed down by inlining the whole chain, once for each use.
    return d.select(*(c for c in docs.columns if c not in RESULT), F.inline_outer(F.array(F.struct(*RESULT))))


def keep_good(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that judge() keeps, with the columns of docs."""
    return judge(docs, trusted, threshold).where("kept").select(docs.columns)


def trusted_documents(labels: DataFrame) -> DataFrame:
    """doc_id of documents labelled good and not toxic, but for the fifth that is held out: crc32(doc_id as text) mod 5 = 0."""
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return labels.where((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0) & ~held_out).select("doc_id").distinct()
