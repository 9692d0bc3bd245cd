"""Complete-link groups of observations.

Only strong edges between compatible observations can ever join, so their connected components isolate the work: each component
is folded by itself, strongest edge first. A component may be large, but a fold keeps edges and groups of a bounded
size, never its pairs; `most` bounds a component, and a larger one raises an error instead of a partial result.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.linkage import smallest_labels

CAP = 16


def fold(edges: list[tuple[int, int, float]], cap: int) -> dict[int, int]:
    """node -> smallest member of its group. edges: distinct strong (a, b, strength), a < b."""
    strong = {(a, b) for a, b, _ in edges}
    group = {x: {x} for e in edges for x in e[:2]}
    for a, b, _ in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        left, right = group[a], group[b]
        if left is right or len(left) + len(right) > cap or not all((min(x, y), max(x, y)) in strong for x in left for y in right):
            continue
        left |= right
        for x in right:
            group[x] = left
    return {x: min(g) for x, g in group.items()}


def complete_link(observations: DataFrame, edges: DataFrame, least: float, guard: list[str], apart: str, cap: int = CAP, most: int = 2_000_000) -> DataFrame:
    """(id, group_id) of each observation (id, *guard, apart).

    edges: (a, b, ab, ba), a < b, each once, with the log odds in both directions. An edge counts when both are at least
    `least`, all guard columns are there and equal, and `apart` differs. Edges join in the order of their weaker direction
    when all pairs across the two groups are such edges and the group stays within cap.
    """
    keys = observations.select("id", *guard, apart)
    side = lambda s: keys.select(*(F.col(c).alias(f"{s}_{c}") for c in keys.columns))
    good = edges.where((F.col("ab") >= least) & (F.col("ba") >= least)).join(side("x"), F.col("a") == F.col("x_id")).join(side("y"), F.col("b") == F.col("y_id"))
    for c in guard:
        good = good.where(F.col(f"x_{c}") == F.col(f"y_{c}"))
    good = good.where(F.col(f"x_{apart}") != F.col(f"y_{apart}")).select("a", "b", F.least("ab", "ba").alias("strength")).checkpoint()
    ends = good.select(F.col("a").alias("id")).union(good.select("b")).distinct()
    label = smallest_labels(good.select(F.col("a").alias("src"), F.col("b").alias("dst")), ends)

    def groups(t: pa.Table) -> pa.Table:
        if t.num_rows > most:
            raise ValueError(f"a component has {t.num_rows} edges, over {most}")
        found = fold(list(zip(*(t.column(c).to_pylist() for c in ("a", "b", "strength")), strict=True)), cap)
        return pa.table({"id": pa.array(found, pa.int64()), "group_id": pa.array(found.values(), pa.int64())})

    folded = good.join(label, good.a == label.id).select("component", "a", "b", "strength").groupBy("component").applyInArrow(groups, "id long, group_id long")
    return observations.select("id").join(folded, "id", "left").select("id", F.coalesce("group_id", "id").alias("group_id"))
