"""Pairs counted from the sizes of groups, and best candidates found without pairs, against every pair."""

import datetime
import itertools
import random
from collections import Counter

from pyspark.sql import functions as F

from tessera.functions import dates
from tessera.operators import blocking, identity, linkage, pair_counts


def drawn(spark, n, seed, ids=None):
    """Rows with missing values, of few values, so that groups are large; a repeated id repeats its row."""
    rnd = random.Random(seed)
    pick = lambda *xs: rnd.choice([*xs, None])
    rows = [(i, pick("x", "y"), pick("A", "B", "C"), pick("m", "n"), pick("1", "2")) for i in (ids or range(n))]
    rows += [(None, "x", "A", "m", "1"), rows[3], rows[3], rows[5]]
    return rows, spark.createDataFrame(rows, "id long, block string, first string, mother string, birth string")


def test_level_counts(spark):
    rows, d = drawn(spark, 60, 1)
    adds = {"A": -1.0, "B": 2.0, "C": 0.0, None: 0.0}
    d = d.join(spark.createDataFrame([(k, v) for k, v in adds.items() if k], "first string, added double"), "first", "left").fillna(0.0, ["added"])
    want = Counter()
    for x, y in itertools.combinations(rows, 2):
        if None not in (x[0], y[0], x[1], y[1]) and x[0] != y[0] and x[1] == y[1]:
            for f, at in (("first", 2), ("mother", 3), ("birth", 4)):
                want[f, None if None in (x[at], y[at]) else "SAME" if x[at] == y[at] else "OTHER", adds[x[2]] if x[2] == y[2] else 0.0] += 1
    got = pair_counts.level_counts(d, "id", ["block"], ["first", "mother", "birth"], "first", "added").collect()
    assert {(r.feature, r.state, r.added): r.n for r in got} == want


def test_pattern_counts(spark):
    rows, d = drawn(spark, 60, 2)
    want = Counter()
    for x, y in itertools.combinations(rows, 2):
        alike = tuple(a is not None and a == b for a, b in zip(x[1:], y[1:], strict=True))
        if None not in (x[0], y[0]) and x[0] != y[0] and (alike[0] or alike[1]):
            want[alike] += 1
    got = pair_counts.pattern_counts(d, "id", {c: d[c] for c in d.columns[1:]}, ["block", "first"]).collect()
    assert {tuple(r[:4]): r.n for r in got} == want


def test_best_two(spark):
    """Two blocks, missing values that say nothing or count as other, a repeated row and a null id; a score with a part of the left row's own."""
    rows, d = drawn(spark, 70, 3)
    worth = {"first": {"SAME": 3.0, "OTHER": -1.0, None: 0.0}, "mother": {"SAME": 1.0, "OTHER": -2.0, None: 0.0}}
    for missing in (None, "OTHER"):
        score = lambda s: F.lit(sum(worth[f][v] for f, v in s.items())) + (F.when(F.col("birth") == "1", 0.5).otherwise(0.0) if s["first"] == "SAME" else 0.0)
        blocks = {"b": (F.col("block"), ["first", "mother"]), "t": (F.col("first"), ["mother"])}
        want = {}
        for x in rows:
            found = set()
            for y in rows:
                if None not in (x[0], y[0]) and y[0] < x[0] and (x[1] is not None and x[1] == y[1] or x[2] is not None and x[2] == y[2]):
                    state = lambda i: missing if None in (x[i], y[i]) else "SAME" if x[i] == y[i] else "OTHER"  # noqa: B023, E731
                    found.add((-worth["first"][state(2)] - worth["mother"][state(3)] - (0.5 if x[4] == "1" and state(2) == "SAME" else 0.0), y[0]))
            want |= {(x[0], k + 1): (r, -o) for k, (o, r) in enumerate(sorted(found)[:2])}
        got = linkage.best_two(d, "id", blocks, ["first", "mother"], score, missing).collect()
        assert len(got) == len(want) > 80 and {(r.left_id, r["rank"]): (r.right_id, r.odds) for r in got} == want


def test_shared_document_counts(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.choice(["s", "t", None]), rnd.choice(["Ana Souza", "ana  souza", "ANA SOUSA", "Bruno Lima", "Zélia", None]), rnd.choice(["2000-01-01", "1990-05-05", None])) for i in range(60)]
    rows += [(7, "s", "Bruno Lima", "1990-05-05"), (7, "s", "Ana", "2000-01-01"), (None, "s", "Ana", "2000-01-01")]
    d = spark.createDataFrame(rows, "id long, size string, n string, b string")
    pairs = d.toDF("x_id", "size", "x_n", "x_b").join(d.toDF("y_id", "size", "y_n", "y_b"), "size").where("x_id < y_id")
    want = Counter((r["size"], r.conflict) for r in identity.shared_document_conflicts(pairs, ("x_n", "x_b"), ("y_n", "y_b")).collect())
    assert len(want) == 4
    assert {(r["size"], r.conflict): r.n for r in identity.shared_document_counts(d, "id", "size", "n", "b").collect()} == want


def test_birth_pass_counts(spark):
    """Against the pairs of birth_candidates; days that are no date when swapped or in another year among them."""
    rnd = random.Random(6)
    births = [datetime.date(y, m, d) for y in (1999, 2000, 2001, 2002) for m, d in ((1, 2), (2, 1), (2, 2), (1, 31), (3, 12), (12, 3))] + [datetime.date(2000, 2, 29), None]
    rows = [(i, rnd.choice(births), rnd.choice([" Ana", "ana", "Bruno", " ", None]), rnd.choice(["Maria", "Ana", "", None])) for i in range(150)]
    d = spark.createDataFrame([*rows, (None, births[0], "Ana", None)], "id long, birth date, name string, mother string")
    for tolerance in (0, 1, 2):
        want = Counter((r.passes, r.first_pass) for r in dates.birth_candidates(d, d, tolerance).where("left_id <> right_id").collect())
        assert len(want) == 5 + (tolerance > 0)
        for again in (d, d.union(d.where("id = 4"))):
            got = {(r.passes, r.first_pass): r.n for r in blocking.birth_pass_counts(again, tolerance).collect()}
            assert got == want if again is d else sum(got.values()) >= sum(want.values())


def test_pass_counts(spark):
    """Against the pairs of candidates: several keys in a pass, none in some, classes of one and of two keys of their own."""
    rnd = random.Random(9)
    for n, own in ((40, 3), (60, 12), (9, 1)):
        sets = [(i, rnd.choice([[], *([f"o{k}"] for k in range(own))]), rnd.sample(["s", "t", "u", "v"], rnd.randrange(3)), rnd.choice([[], ["1"], ["2"]])) for i in range(n)]
        d = spark.createDataFrame(sets, "id long, own array<string>, many array<string>, one array<string>")
        keys = spark.createDataFrame([(s[0], p, k) for s in sets for p, ks in zip(("own", "many", "one"), s[1:], strict=True) for k in ks], "id long, pass string, key string")
        want = {}
        for r in blocking.candidates(keys, keys).where("left_id < right_id").collect():
            c, lo, hi = want.get(r.passes, (0, r.left_id, r.right_id))
            want[r.passes] = (c + 1, min(lo, r.left_id), max(hi, r.right_id))
        assert {r.passes: tuple(r[1:]) for r in blocking.pass_counts(d, ["own", "many", "one"], "own").collect()} == want
