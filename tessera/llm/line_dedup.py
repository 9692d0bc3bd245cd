"""Line dedup over a corpus, in DataFrame functions only.

Explode normalised lines, hash, count distinct documents per hash, drop lines over the threshold, reassemble by position.

Only (hash, doc_id, position) of lines long enough to count travel to the count and to the drop decision; texts are shuffled
once, to meet the positions that they lose. The count combines before its shuffle and the drop decision uses
skew_safe_lookup(), so one line in a third of all documents doesn't gather in a task.

A line's key: the line stripped of ASCII white space at both ends, A-Z lower-cased. Null or empty text: one empty line.
Rows without a doc_id are not counted and keep all lines. Rows that repeat a doc_id count as one document, and a line
stays in all rows of the largest doc_id that hold it.
An empty table gives an empty table. Other columns pass through, but n_lines and n_dropped, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SPACES, ascii_lower, materialize, skew_safe_lookup

MIN_CHARS, MIN_DOCS = 20, 3


def lines_of(text: str | Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def drop_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs (doc_id, text, ...) with text rebuilt from the lines that stay, and columns n_lines and n_dropped (long).

    A key of at least min_chars code points in at least min_docs documents loses all its lines except those of the
    largest doc_id that holds it.
    """
    tagged = docs.withColumn("_text_hash", F.xxhash64("text"))
    keys = F.transform(lines_of("text"), lambda line, i: F.struct(line_key(line).alias("key"), i.alias("pos")))
    long_keys = F.filter(keys, lambda x: F.char_length(x.key) >= min_chars)
    # Two seeds make 128 bits.
    hashed = F.transform(long_keys, lambda x: F.struct(F.xxhash64(x.key).alias("h1"), F.xxhash64(F.lit(1), x.key).alias("h2"), x.pos.alias("pos")))
    per_doc = tagged.where("doc_id is not null and char_length(text) >= " + str(min_chars)).select("doc_id", "_text_hash", hashed.alias("hs"))
    # inline_outer, as for inline the optimizer adds a filter that evaluates the array once more.
    lines = materialize(per_doc.select("doc_id", "_text_hash", F.inline_outer("hs")).where("pos is not null"), "lines")
    # First by document, so that a line in a third of all documents is spread over all tasks; what each leaves combines to a row a task.
    holders = lines.groupBy("h1", "h2", "doc_id").agg(F.count("*").alias("n"))
    frequent = holders.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n"), F.max("doc_id").alias("keeper"))
    frequent = materialize(frequent.where(F.col("n_docs") >= min_docs), "frequent")
    judged = skew_safe_lookup(lines.select("doc_id", "_text_hash", "h1", "h2", "pos"), frequent, ["h1", "h2"], ["keeper"], "n", F.col("doc_id"))
    losses = judged.where("keeper <> doc_id").groupBy("doc_id", "_text_hash").agg(F.collect_set("pos").alias("_lost"))
    met = tagged.join(losses, ["doc_id", "_text_hash"], "left").withColumn("_lines", lines_of("text"))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_lost"), lambda i: F.get("_lines", i))
    text = F.when(F.col("_lost").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(kept, "\n"))
    rest = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    counts = (F.size("_lines").cast("long").alias("n_lines"), F.coalesce(F.size("_lost"), F.lit(0)).cast("long").alias("n_dropped"))
    return met.select(*rest, text.alias("text"), *counts)
