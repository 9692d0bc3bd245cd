"""Counts of pairs from the sizes of groups, without making a pair: n rows that agree make n (n - 1) / 2 pairs that agree.

A pair is two rows of different ids, neither null. Pairs of rows that repeat an id are counted in the same way and taken off.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pairs_of(n: str) -> Column:
    return F.expr(f"`{n}` * (`{n}` - 1) div 2")


def without_repeats(rows: DataFrame, id_col: str, count: Callable[[DataFrame, list[str]], DataFrame], by: list[str]) -> DataFrame:
    """count(rows, by) plus, negative, the same of pairs of one id; `count` gives the number of pairs inside the groups of `by` as n.

    Looks for repeated ids at once, by the ids alone.
    """
    there = rows.where(F.col(id_col).isNotNull())
    again = there.groupBy(id_col).agg(F.count("*").alias("_rows")).where("_rows > 1").select(id_col)
    if again.isEmpty():
        return count(there, by)
    return count(there, by).unionByName(count(there.join(again, id_col), [*by, id_col]).withColumn("n", -F.col("n")))


def level_counts(rows: DataFrame, id_col: str, block: list[str], features: list[str], term: str, added: str) -> DataFrame:
    """(feature, state, added, n): pairs of one block by the state of each feature and by what an equal `term` adds, 0.0 if terms differ.

    States: SAME, OTHER, or null where either side is missing. Rows with a missing part of the block are in none. `added` depends on `term`.
    """
    whole = rows.where(" and ".join(f"`{b}` is not null" for b in block))

    def counts(d: DataFrame, by: list[str]) -> DataFrame:
        # Each row counts in its block, and once more among the rows with its term.
        entry = lambda f, t, w: F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("value"), t.alias("_term"), w.alias("_added"))
        key = [k for f in features for k in (entry(f, F.lit(None).cast("string"), F.lit(0.0)), F.when(F.col(term).isNotNull(), entry(f, F.col(term), F.col(added))))]
        each = d.select(*by, F.inline(F.filter(F.array(*key), lambda k: k.isNotNull())))
        values = each.groupBy(*by, "_term", "_added", "feature", "value").agg(F.count("*").alias("c"))
        is_there = lambda n: F.sum(F.when(F.col("value").isNotNull(), n).otherwise(0))
        s = values.groupBy(*by, "_term", "_added", "feature").agg(F.sum("c").alias("all"), is_there(F.col("c")).alias("there"), is_there(pairs_of("c")).alias("same"))
        state = lambda name, n: F.struct(F.lit(name).cast("string").alias("state"), n.alias("n"))
        s = s.select("feature", "_term", "_added", F.inline(F.array(state("SAME", F.col("same")), state("OTHER", pairs_of("there") - F.col("same")), state(None, pairs_of("all") - pairs_of("there")))))
        # Pairs of equal terms leave those of the block, for which nothing is added.
        apart = F.struct(F.lit(0.0).alias("added"), F.when(F.col("_term").isNull(), F.col("n")).otherwise(-F.col("n")).alias("n"))
        alike = F.struct(F.col("_added").alias("added"), F.when(F.col("_term").isNull(), 0).otherwise(F.col("n")).alias("n"))
        return s.select("feature", "state", F.explode(F.array(apart, alike)).alias("k")).groupBy("feature", "state", "k.added").agg(F.sum("k.n").alias("n"))

    return without_repeats(whole, id_col, counts, block).groupBy("feature", "state", "added").agg(F.sum("n").alias("n")).where("n > 0")


def pattern_counts(rows: DataFrame, id_col: str, keys: dict[str, Column], passes: list[str]) -> DataFrame:
    """(*keys boolean, n): pairs by which of the keys they share, of all pairs that share one of `passes` (names of keys). A null key is shared with none.

    Pairs that share at least a set of keys come from the sizes of groups, those that share just that set by inclusion and exclusion.
    """
    names = list(keys)
    sets = [s for k in range(1, len(names) + 1) for s in combinations(names, k) if set(s) & set(passes)]
    place = {s: i for i, s in enumerate(sets)}
    whole = rows.select(F.col(id_col).alias("_id"), *(k.cast("string").alias(n) for n, k in keys.items()))

    def counts(d: DataFrame, by: list[str]) -> DataFrame:
        some = d.groupBy(*by, *names).agg(F.count("*").alias("w"))
        entry = lambda s: F.when(F.expr(" and ".join(f"`{n}` is not null" for n in s)), F.struct(F.lit(place[s]).alias("_set"), F.array(*(F.col(n) for n in s)).alias("_key")))
        each = some.select(*by, "w", F.inline(F.filter(F.array(*map(entry, sets)), lambda k: k.isNotNull())))
        return each.groupBy(*by, "_set", "_key").agg(F.sum("w").alias("c")).groupBy("_set").agg(F.sum(pairs_of("c")).alias("n"))

    found = without_repeats(whole, "_id", counts, []).groupBy("_set").agg(F.sum("n").alias("n"))
    share = {s: [(place[t], (-1) ** (len(s) - len(t))) for t in sets if set(t) <= set(s)] for s in sets}
    signs = F.array(*(F.array(*(F.struct(F.lit(t).alias("_at"), F.lit(sign).alias("_sign")) for t, sign in share[s])) for s in sets))
    exact = found.select("n", F.inline(F.get(signs, F.col("_set")))).groupBy("_at").agg(F.sum(F.col("n") * F.col("_sign")).alias("n")).where("n > 0")
    return exact.select(*(F.col("_at").isin([place[s] for s in sets if n in s]).alias(n) for n in names), "n")
