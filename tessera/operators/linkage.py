"""Record linkage: blocking passes, Fellegi-Sunter scores, ranks, decisions and clusters."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.blocking import candidates  # noqa: F401


def keyed(df: DataFrame, id_col: str, passes: dict[str, list[Column]]) -> DataFrame:
    """(id, pass, key) of every pass whose features are all there; within a pass features are combined, passes are alternatives."""
    keys = [F.struct(F.lit(name).alias("pass"), F.when(reduce(Column.__and__, (c.isNotNull() for c in cols)), F.concat_ws("|", *(c.cast("string") for c in cols))).alias("key")) for name, cols in passes.items()]
    return df.select(F.col(id_col).alias("id"), F.explode(F.array(*keys)).alias("k")).select("id", "k.*").where("key is not null")


def pair_census(keys: DataFrame) -> DataFrame:
    """(pass, blocks, largest, pairs) by block sizes, without making a pair."""
    sizes = keys.groupBy("pass", "key").agg(F.countDistinct("id").alias("n"))
    return sizes.groupBy("pass").agg(F.count("*").alias("blocks"), F.max("n").alias("largest"), F.sum(F.expr("n * (n - 1) div 2")).alias("pairs"))


def log_ratio(m: float, u: float) -> float:
    bound = lambda p: min(1 - 1e-9, max(1e-9, p))
    return math.log(bound(m) / bound(u))


def log_odds(states: dict[str, Column], weights: dict[str, dict[str, tuple[float, float]]], prior: float) -> Column:
    """logit(prior) plus the log ratio of each feature's state; a null state adds nothing."""
    prior = min(1 - 1e-7, max(1e-7, prior))
    total = F.lit(math.log(prior / (1 - prior)))
    for feature, state in states.items():
        w = F.lit(0.0)
        for name, (m, u) in weights[feature].items():
            w = F.when(state == name, F.lit(log_ratio(m, u))).otherwise(w)
        total = total + w
    return total


def posterior(odds: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), odds))))


def evidence(states: dict[str, Column], weights: dict[str, dict[str, tuple[float, float]]]) -> Column:
    """array<struct<evidence, state, m, u, llr>>: what each feature adds to the odds, in the order of states; a null state adds nothing."""
    out = []
    for feature, state in states.items():
        value = lambda pick: F.coalesce(*(F.when(state == name, F.lit(float(pick(m, u)))) for name, (m, u) in weights[feature].items()))  # noqa: B023, E731
        bound = lambda p: min(1 - 1e-9, max(1e-9, p))
        out.append(F.struct(F.lit(feature).alias("evidence"), state.alias("state"), value(lambda m, u: bound(m)).alias("m"), value(lambda m, u: bound(u)).alias("u"), F.coalesce(value(log_ratio), F.lit(0.0)).alias("llr")))
    return F.array(*out)


def term_frequency(left: Column, right: Column, reference_u: float, weight: float = 1.0, least_u: float = 0.0, mode: str = "symmetric") -> Column:
    """What the frequencies of an equal term add to the log odds: weight ln(u / max(left, right, least_u)); asymmetric: never above 0; zero: 0.
    Null frequencies add nothing."""
    if not (0 < reference_u <= 1 and weight >= 0 and 0 <= least_u <= 1) or mode not in ("zero", "symmetric", "asymmetric"):
        raise ValueError("frequencies are in (0, 1], weights not negative")
    if mode == "zero" or weight == 0:
        return F.lit(0.0)
    effective = F.greatest(left, right, F.lit(least_u)) if least_u > 0 else F.greatest(left, right)
    added = F.lit(weight) * F.ln(F.lit(reference_u) / effective)
    return F.when(left.isNotNull() & right.isNotNull(), F.least(added, F.lit(0.0)) if mode == "asymmetric" else added).otherwise(0.0)


def with_frequencies(pairs: DataFrame, frequencies: DataFrame, left: str, right: str, exact: Column, out: str) -> DataFrame:
    """pairs plus {out}_left and {out}_right: the frequencies (term, frequency) of both sides' first tokens where `exact` holds, else null."""
    first = lambda c: F.when(exact, F.get(F.split(F.col(c), " "), F.lit(0)))
    d = pairs.withColumn("_l", first(left)).withColumn("_r", first(right))
    side = lambda k, s: frequencies.select(F.col("term").alias(k), F.col("frequency").alias(f"{out}_{s}"))
    return d.join(side("_l", "left"), "_l", "left").join(side("_r", "right"), "_r", "left").drop("_l", "_r")


def joint_odds(pairs: DataFrame, cells: DataFrame, person: str = "person_level", mother: str = "mother_level") -> DataFrame:
    """pairs plus joint_llr: ln(m / u) of the cell (person_level, mother_level, m, u) of both names' levels. Levels are nine, so cells are
    81 rows at most and are broadcast; a pair without a cell is an error."""
    bound = lambda c: F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), F.col(c)))
    c = cells.select(F.col("person_level").alias("_p"), F.col("mother_level").alias("_q"), F.ln(bound("m") / bound("u")).alias("joint_llr"))
    met = pairs.join(F.broadcast(c), (F.col(person) == F.col("_p")) & (F.col(mother) == F.col("_q")), "left").drop("_p", "_q")
    return met.withColumn("joint_llr", F.coalesce("joint_llr", F.raise_error(F.lit("a pair of levels has no cell")).cast("double")))


def ranked(scored: DataFrame, by: str = "left_id", score: str = "odds", tie: str = "right_id") -> DataFrame:
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), tie)))


def best_two(rows: DataFrame, id_col: str, blocks: dict[str, tuple[Column, list[str]]], features: list[str], score: Callable[[dict[str, str | None]], Column], missing: str | None = None) -> DataFrame:
    """(left_id, right_id, odds, rank): the best two candidates of each id among the smaller ids that share the key of a block, by odds, then id; pairs are not made.

    blocks: name -> (key, the features that may differ where the key is the same); a null key is shared with none. A feature's state is SAME, OTHER,
    or `missing` where a side is null. score gives the odds of states as a column of the left row; OTHER must not score above another state.
    Rows of one id must be the same.

    Candidates that are at least as good as a combination of states are a group, whose smallest ids are its best: of a group a row needs the two
    smallest ids alone, and a candidate's true odds are the most that any of its groups says. A block is sorted in one task, with spilling.
    """
    varied = sorted({f for _, fs in blocks.values() for f in fs})
    assert set(varied) <= set(features)
    entry = [F.when(key.isNotNull(), F.struct(F.lit(i).alias("_block"), key.cast("string").alias("_key"))) for i, (key, _) in enumerate(blocks.values())]
    data = [c for c in rows.columns if c != id_col]
    base = rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("left_id"), *data, F.explode(F.filter(F.array(*entry), lambda k: k.isNotNull())).alias("_b")).select("left_id", *data, "_b.*")
    # A number, since small tasks would be joined by the bytes of rows that are about to be multiplied.
    base = base.repartition(4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_block", "_key").dropDuplicates(["_block", "_key", "left_id"])
    # Digits of a group's code, by feature: 0 any state, 1 the same value, 2 a missing one.
    options = []
    for i, (_, fs) in enumerate(blocks.values()):
        for levels in product((0, 1) if missing == "OTHER" else (0, 1, 2), repeat=len(fs)):
            at = dict(zip(fs, levels, strict=True))
            there = {f: F.col(f).isNotNull() for f in fs}
            member = [there[f] if v == 1 else ~there[f] for f, v in at.items() if v]
            # A left row with a value asks for all three; one without gets the same state from any candidate.
            asking = [there[f] for f, v in at.items() if v]
            held = lambda cs: reduce(Column.__and__, cs, F.col("_block") == i)
            odds = lambda f_at: score({f: "SAME" if f not in fs else ("OTHER", "SAME", missing)[f_at[f]] for f in features})  # noqa: B023, E731
            worth = odds(at)
            if missing != "OTHER":
                for blank in product((False, True), repeat=len(fs)):
                    gone = [f for f, b in zip(fs, blank, strict=True) if b]
                    if gone and not any(at[f] for f in gone):
                        states = {f: missing if f in gone else "SAME" if f not in fs else ("OTHER", "SAME", missing)[at[f]] for f in features}
                        worth = F.when(reduce(Column.__and__, (~there[f] for f in gone)) & reduce(Column.__and__, (there[f] for f in fs if f not in gone), F.lit(True)), score(states)).otherwise(worth)
            code = sum(v * 3**k for k, v in enumerate(at.values()))
            values = [F.when(F.lit(at.get(f) == 1), F.col(f).cast("string")).alias(f"_v_{f}") for f in varied]
            options.append(F.when(held(member) | held(asking), F.struct(F.lit(code).alias("_code"), *values, held(member).alias("_in"), F.when(held(asking), worth).alias("_odds"))))
    each = base.select("left_id", "_block", "_key", F.inline(F.filter(F.array(*options), lambda k: k.isNotNull())))
    before = Window.partitionBy("_block", "_key", "_code", *(f"_v_{f}" for f in varied)).orderBy("left_id").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.when(F.col("_in"), F.col("left_id"))
    found = each.withColumn("_one", F.first(seen, ignorenulls=True).over(before)).withColumn("_two", F.nth_value(seen, 2, ignoreNulls=True).over(before)).where("_odds is not null and _one is not null")
    worse = (F.lit(0.0) - F.col("_odds")).alias("worse")
    pairs = F.array(F.struct(worse, F.col("_one").alias("right_id")), F.struct(worse, F.col("_two").alias("right_id")))
    top = found.groupBy("_block", "_key", "left_id").agg(_two_of(F.flatten(F.collect_list(pairs))).alias("top"))
    top = top.groupBy("left_id").agg(_two_of(F.flatten(F.collect_list("top"))).alias("top"))
    return top.select("left_id", F.posexplode("top").alias("rank", "k")).select("left_id", "k.right_id", (F.lit(0.0) - F.col("k.worse")).alias("odds"), (F.col("rank") + 1).alias("rank"))


def _two_of(found: Column) -> Column:
    """The first two right_ids of array<struct<worse, right_id>>, by worse, then right_id."""
    order = F.array_sort(F.filter(found, lambda k: k.right_id.isNotNull()))
    first = F.slice(order, 1, 1)
    return F.concat(first, F.slice(F.filter(order, lambda k: k.right_id != F.get(first, F.lit(0)).right_id), 1, 1))


def decisions(rank_rows: DataFrame, universe: DataFrame, threshold: float, margin: float) -> DataFrame:
    """One row for each left_id of universe: the best two candidates and RESOLVED, UNRESOLVED or CONFLICT with a reason."""
    top = rank_rows.where("rank <= 2").groupBy("left_id").agg(*(F.max(F.when(F.col("rank") == k, F.col(c))).alias(f"{c}_{k}") for k in (1, 2) for c in ("right_id", "odds")))
    d = universe.join(top, "left_id", "left")
    gap = F.col("odds_1") - F.col("odds_2")
    status = F.when(F.col("odds_1").isNull(), "UNRESOLVED").when(F.col("odds_1") < threshold, "UNRESOLVED").when(gap < margin, "CONFLICT").otherwise("RESOLVED")
    reason = F.when(F.col("odds_1").isNull(), "NO_CANDIDATE").when(F.col("odds_1") < threshold, "BELOW_THRESHOLD").when(gap < margin, "MARGIN")
    return d.select("left_id", F.col("right_id_1").alias("best"), F.col("right_id_2").alias("second"), F.col("odds_1").alias("best_odds"), gap.alias("gap"), status.alias("status"), reason.alias("reason"))


def one_row_each(scored: DataFrame, keys: tuple[str, ...] = ("left_id", "right_id")) -> DataFrame:
    """scored without repeated rows; rows of a pair that differ are an error."""
    rest = [c for c in scored.columns if c not in keys]
    g = scored.groupBy(*keys).agg(F.count_distinct(F.to_json(F.struct(*rest), {"ignoreNullFields": "false"})).alias("_n"), *(F.first(c).alias(c) for c in rest))
    sure = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("a candidate has different rows: "), F.col(keys[1]).cast("string"))).cast("boolean")).otherwise(True)
    return g.where(sure).select(scored.columns)


def resolved(scored: DataFrame, universe: DataFrame, threshold: float, margin: float, unique_core: bool = False, dual: bool = False, conflict_floor: float | None = None, no_candidate: str = "SEM_CANDIDATO_NO_RULESET_BLOCKING") -> DataFrame:
    """One row for each left_id of universe: status, person, the best two candidates, the margin of their odds and the reason.

    scored: (left_id, right_id, score, odds, exact_core); a repeated pair must be the same. In order: no candidate; best score below the threshold;
    with unique_core, a best candidate of the very name and birth; with dual, a second candidate at the threshold or at conflict_floor; a margin too
    small; else resolved.
    """
    order = ranked(one_row_each(scored)).where("rank <= 2")
    top = order.groupBy("left_id").agg(*(F.max(F.when(F.col("rank") == k, F.col(c))).alias(f"{c}_{k}") for k in (1, 2) for c in ("right_id", "score", "odds", "exact_core")))
    d = universe.select("left_id").join(top, "left_id", "left").withColumn("margin", F.col("odds_1") - F.col("odds_2"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    floor = threshold if conflict_floor is None else conflict_floor
    cases = [(F.col("right_id_1").isNull(), "NAO_RESOLVIDO", no_candidate), (F.col("score_1") < threshold, "NAO_RESOLVIDO", "ABAIXO_T_LINKAGE")]
    if unique_core:
        cases.append((yes(F.col("exact_core_1")), "CONFLITO", "NUCLEO_DEMOGRAFICO_EXATO_NAO_UNICO"))
    if dual:
        cases.append((yes(F.col("score_2") >= floor), "CONFLITO", "DOIS_CANDIDATOS_ACIMA_T_LINKAGE" if conflict_floor is None else "SEGUNDO_CANDIDATO_ACIMA_PISO_CONFLITO"))
    cases.append((yes(F.col("margin") < margin), "CONFLITO", "MARGEM_ENTRE_CANDIDATOS_INSUFICIENTE"))
    status, reason = F.lit("RESOLVIDO"), F.lit(None).cast("string")
    for held, s, r in reversed(cases):
        status, reason = F.when(held, s).otherwise(status), F.when(held, r).otherwise(reason)
    return d.select("left_id", status.alias("status"), F.when(status == "RESOLVIDO", F.col("right_id_1")).alias("person"), F.col("right_id_1").alias("best"), F.coalesce("score_1", F.lit(0.0)).alias("best_score"), F.col("right_id_2").alias("second"), F.col("score_2").alias("second_score"), "margin", reason.alias("reason"))


def open_triads(edges: DataFrame) -> DataFrame:
    """(a, b, c): a-b and b-c are linked and a-c is not, a < c. Edges: (src, dst), src < dst."""
    both = edges.select("src", "dst").union(edges.select("dst", "src")).distinct().toDF("x", "y")
    paths = both.select(F.col("y").alias("b"), F.col("x").alias("a")).join(both.select(F.col("x").alias("b"), F.col("y").alias("c")), "b").where("a < c")
    return paths.join(edges.select(F.col("src").alias("a"), F.col("dst").alias("c")), ["a", "c"], "left_anti").select("a", "b", "c")


def smallest_labels(edges: DataFrame, nodes: DataFrame, rounds: int = 30) -> DataFrame:
    """(id, component) of nodes (id): the smallest id that edges (src, dst) reach."""
    both = edges.select("src", "dst").union(edges.select("dst", "src")).distinct()
    labels = nodes.select("id", F.col("id").alias("component"))
    for _ in range(rounds):
        near = both.join(labels, both.dst == labels.id).groupBy(F.col("src").alias("id")).agg(F.min("component").alias("near"))
        step = labels.join(near, "id", "left").select("id", "component", F.least("component", F.coalesce("near", "component")).alias("step"))
        # The label of the label: chains shorten by halves.
        above = step.select(F.col("id").alias("step"), F.col("step").alias("above"))
        new = step.join(above, "step", "left").select("id", "component", F.least("step", F.coalesce("above", "step")).alias("new")).checkpoint()
        labels = new.select("id", F.col("new").alias("component"))
        if new.where("new <> component").isEmpty():
            return labels
    raise RuntimeError(f"labels did not settle in {rounds} rounds")
