"""Decision thresholds by exact counts, fronts of candidates, and the search for blocking rules."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most features of a rule search: agreements are counted by mask.
MOST_FEATURES = 16


def error_budget(positives: int, basis_points: int) -> int:
    """False positives that are allowed for so many labelled positives."""
    return math.ceil(positives * basis_points / 10_000)


def grid(values: list[float], most: int) -> list[float]:
    """At most `most` of the sorted distinct values, both ends included, evenly thinned."""
    at = sorted(set(values))
    return at if len(at) <= most else sorted({at[round(i * (len(at) - 1) / (most - 1))] for i in range(most)})


def outcomes(scenarios: DataFrame, thresholds: list[float], margins: list[float]) -> DataFrame:
    """(threshold, margin, tp, fp, fn) of each point of the grid.

    scenarios: (truth, best, odds, margin): ids, null truth for none; margin null without a second candidate. A decision links
    to best when odds >= threshold and margin >= the least margin. A link to a wrong id is a fp and a fn. Scenarios are
    first counted by the grid cell that they fall in, so what is expanded is bounded by the grid and not by the scenarios.
    """
    ts, ms = sorted(thresholds), sorted(margins)
    reach = lambda c, bounds: sum((F.when(c >= b, 1).otherwise(0) for b in bounds), F.lit(0))
    best = F.col("best").isNotNull()
    cell = scenarios.select(
        F.when(best, reach(F.col("odds"), ts)).otherwise(0).alias("t"), F.when(best & F.col("margin").isNull(), len(ms)).when(best, reach(F.col("margin"), ms)).otherwise(0).alias("m"),
        F.coalesce(F.col("truth") == F.col("best"), F.lit(False)).alias("hit"), F.col("truth").isNotNull().alias("known"),
    )
    counts = cell.groupBy("t", "m").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), F.count_if("known").alias("known"))
    every = F.explode(F.array(*(F.struct(F.lit(i).alias("ti"), F.lit(float(t)).alias("threshold"), F.lit(j).alias("mi"), F.lit(float(m)).alias("least_margin")) for i, t in enumerate(ts, 1) for j, m in enumerate(ms, 1))))
    at = counts.select("*", every.alias("g")).select("*", "g.*").withColumn("linked", (F.col("t") >= F.col("ti")) & (F.col("m") >= F.col("mi")))
    n = lambda c: F.sum(F.when(F.col("linked"), F.col(c)).otherwise(0))
    return at.groupBy("threshold", "least_margin").agg(n("hits").alias("tp"), n("misses").alias("fp"), (F.sum("known") - n("hits")).alias("fn")).withColumnRenamed("least_margin", "margin")


def front(points: list[dict], a: str = "fp", b: str = "fn") -> list[dict]:
    """Points that no other point is at most equal to in both counts and below in one; ties stay. One pass in sorted order."""
    out, least, at = [], math.inf, None
    for p in sorted(points, key=lambda p: (p[a], p[b])):
        if p[b] < least or (p[a], p[b]) == at:
            out.append(p)
            least, at = p[b], (p[a], p[b])
    return out


def calibrate(validation: DataFrame, test: DataFrame, thresholds: list[float], margins: list[float], basis_points: int = 0, test_basis_points: int = 0, most: int = 48) -> dict:
    """The grid point of the least fn within the validation budget (then least fp, highest threshold, highest margin), its counts
    on the test scenarios and whether they pass the test budget."""
    ts, ms = grid(thresholds, most), grid(margins, most)
    known = {k: d.where("truth is not null").count() for k, d in (("validation", validation), ("test", test))}
    points = [r.asDict() for r in outcomes(validation, ts, ms).collect()]  # most x most rows
    within = [p for p in front(points) if p["fp"] <= error_budget(known["validation"], basis_points)]
    if not within:
        raise ValueError("no threshold keeps the budget of false positives")
    chosen = min(within, key=lambda p: (p["fn"], p["fp"], -p["threshold"], -p["margin"]))
    seen = outcomes(test, [chosen["threshold"]], [chosen["margin"]]).collect()[0].asDict()
    return {"chosen": chosen, "test": seen, "passes": seen["fp"] <= error_budget(known["test"], test_basis_points)}


def rule_search(pairs: DataFrame, features: list[str], truth: str, fields: int = 3, passes: int = 2, pool: int = 64, cap: int = 2048) -> list[dict]:
    """Blocking rules (unions of up to `passes` conjunctions of up to `fields` features) by recall and retained pairs, best first.

    pairs: a boolean for each feature (null counts as false) and a boolean truth. Pairs are counted once by the mask of the
    features that agree; all rules are judged on these at most 2 ^ len(features) counts. The pool takes conjunctions by recall and
    by reduction in turns. More rules than cap are an error, never a partial result.
    """
    if len(features) > MOST_FEATURES:
        raise ValueError(f"more than {MOST_FEATURES} features")
    mask = sum((F.when(F.coalesce(F.col(f), F.lit(False)), 1 << i).otherwise(0) for i, f in enumerate(features)), F.lit(0))
    counted = pairs.groupBy(mask.alias("mask")).agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.col(truth), F.lit(False))).alias("true")).collect()
    n, true = sum(r.n for r in counted), sum(r.true for r in counted)

    def judged(rule: tuple[int, ...]) -> dict:
        hit = [r for r in counted if any(r.mask & c == c for c in rule)]
        kept, found = sum(r.n for r in hit), sum(r.true for r in hit)
        return {"rule": [[f for i, f in enumerate(features) if c >> i & 1] for c in rule], "recall": found / true if true else None, "kept": kept, "reduction": 1 - kept / n if n else None, "masks": rule}

    single = [judged((sum(1 << i for i in c),)) for k in range(1, fields + 1) for c in combinations(range(len(features)), k)]
    by_recall = sorted(single, key=lambda s: (-(s["recall"] or 0), s["kept"], s["masks"]))
    by_reduction = sorted(single, key=lambda s: (s["kept"], -(s["recall"] or 0), s["masks"]))
    taken: list[int] = []
    for pair in zip(by_recall, by_reduction, strict=True):
        taken += [s["masks"][0] for s in pair if s["masks"][0] not in taken and len(taken) < pool]
    rules = [r for k in range(1, passes + 1) for r in combinations(sorted(set(taken)), k) if not any(a != b and a & b == a for a in r for b in r)]
    if len(rules) > cap:
        raise ValueError(f"{len(rules)} rules, over {cap}")
    return [{k: v for k, v in r.items() if k != "masks"} for r in sorted(map(judged, rules), key=lambda r: (-(r["recall"] or 0), r["kept"], r["masks"]))]
