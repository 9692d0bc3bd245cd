"""N-gram Jaccard join in the metric space of Jaccard distance.

Sets of word shingles under d = 1 - |x & y| / |x | y| form a metric space. Pivots create regions, the triangle
inequality gives the windows in which boundary documents are replicated, and regions join recursively and exactly:

1. Documents of one set collapse to a representative (a hash aggregate, so groups of copies cost one row a task).
2. Sets that share nothing are all at distance 1, where no pivot separates them. So pivots are taken where distances are
   informative: a set of size n is cut by hash into more parts than two linked sets can differ in elements, so two linked
   sets agree in a non-empty part. The members of one (size region, part, content) form a cell of radius 0 in the
   projection on that part, and the cell's pivot is its first member in a fixed pseudo-random order (its hash names the region). The region of a pivot
   is the union of its cells; a document is in the region of each pivot that it meets, which is where boundary documents
   are replicated. Sizes have regions too: d <= t bounds the ratio of sizes, and a set near the upper end of its size
   region is replicated to the next.
3. A region over BLOCK_DOCS documents or BLOCK_SHINGLES shingles is split by metric pivots of its own, in rounds: PIVOTS of its members, those
   not linked yet first and of them the most central (those whose parts most others share, as a near copies' original has them), a cell for each and one for what is far from all of them, and x in cell j when d(x, p_j) <= d(x, nearest) + 2 t
   and it is not much farther from p_j than what lives there (voronoi()), so no link is lost. Members within t of
   a pivot are linked to it, and pivots that share such a member are one group; a cell of one group is done, which is
   how a group of near copies of any size costs a few distances a member and no pairs. What is still large after ROUNDS rounds, or makes no more progress, is joined by pairs
   of blocks, but for blocks of one large group. The members of a cell are dealt to tasks by salts in each round.
4. In a task, members without a rare shingle in common with any other are set aside, and others are joined recursively: the most
   central pivot and others far from one another, links to them, such cells, until a cell is of one group, or has LEAF members, or its cells have hardly
   fewer pairs; then its members are compared one by one with those of other groups.
   Tasks return a spanning star of each group that they find, never its pairs.
5. Links between representatives become components by rounds of smallest labels.

Nulls: a document without words, text or doc_id is linked with nothing (n_shingles 0 for the first two); a null
doc_id has a null component. Rows that share a doc_id count as one document with the links of each of its texts.
An empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.bloom import BlockedBloom
from tessera.llm.common import components, materialize, skew_safe_lookup, small_batches
from tessera.llm.shingles import U, WordHashes, mix, shingle_set

#: Ratio of the bounds of size regions.
RATIO = 1.5
#: More than the size regions that a set can be in.
REGIONS = 64
#: Most documents and shingles of a block of a region.
BLOCK_DOCS, BLOCK_SHINGLES = 2_000, 3_000_000
#: Recursion in a task ends at so many documents; pivots of a step, in tasks and between them; rounds of splitting large regions.
LEAF, PIVOTS, ROUNDS = 16, 6, 4


def size_bounds() -> np.ndarray:
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, int(out[-1] * RATIO)))
    return np.array(out, np.int64)


BOUNDS = size_bounds()


def most_differing(largest: int, percent: int) -> int:
    """Elements in which two linked sets of at most this size can differ: |x ^ y| <= (|x| + |y|) (1 - s) / (1 + s)."""
    return 2 * largest * (100 - percent) // (100 + percent)


def spare_parts(c: int, differing: int, percent: int) -> int:
    """Parts of size region c beyond those that linked sets can differ in: more than a set leaves empty, but for rare ones."""
    least, spare = percent * int(BOUNDS[c]) / 100, 2 + differing // 16
    for _ in range(4):
        m = differing + 1 + spare
        spare = max(spare, 2 + math.ceil(1.5 * m * math.exp(-least / m)))
    return spare


def part_keys(s: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys (size region, part, content) of a set, and for each how many the set can do without.

    Two linked different sets agree in spare + 1 parts of a region at least. Each can leave out its spare most crowded
    parts, by a common order of parts, and they still have one in common: the least crowded of those they share.
    Empty parts are the most crowded; sets with more than spare empty parts keep all their parts.
    """
    n = len(s)
    own = int(np.searchsorted(BOUNDS, n, "right")) - 1
    out, codes = [], []
    last = int(np.searchsorted(BOUNDS, 100 * n // percent, "right")) - 1
    for c in range(own, last + 1):
        differing = most_differing(int(BOUNDS[c + 1]) - 1, percent)
        if differing == 0:
            continue
        spare = spare_parts(c, differing, percent)
        m = differing + 1 + spare
        part = (mix(s, 11) >> U(20)) % U(m)
        order = np.argsort(part, kind="stable")
        at = part[order]
        starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        content = np.add.reduceat(mix(s, 12)[order], starts)
        key = content ^ mix(at[starts] * U(64) + U(c), 13)
        empty = m - len(starts)
        if empty > spare:
            key = np.r_[key, mix(np.setdiff1d(np.arange(m, dtype=U), at[starts], assume_unique=True) * U(64) + U(c), 14)]
        out.append(mix(key, 15))
        codes.append(np.full(len(key), REGIONS * max(0, spare - empty) + c - own, np.int32))
    return (np.concatenate(out), np.concatenate(codes)) if out else (np.zeros(0, U), np.zeros(0, np.int32))


def set_rows(n: int, percent: int):
    """Arrow batches (doc_id, text) -> (doc_id, n_shingles, s1, s2, keys, codes); s1, s2: 128 bits of the set."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for b in batches:
            size, s1, s2, keys, codes, offsets = [], [], [], [], [], [0]
            for t in b.column("text").cast(pa.binary()).to_pylist():
                s = shingle_set(t, n, cache)
                k, code = part_keys(s, percent)
                size.append(len(s))
                s1.append(mix(s, 1).sum(dtype=U))
                s2.append(mix(s, 2).sum(dtype=U))
                keys.append(k)
                codes.append(code)
                offsets.append(offsets[-1] + len(k))
            lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(x).view(t) if x else np.zeros(0, t))) for x, t in ((keys, np.int64), (codes, np.int32))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(size, pa.int64()), pa.array(np.array(s1, U).view(np.int64)), pa.array(np.array(s2, U).view(np.int64)), *lists], ["doc_id", "n_shingles", "s1", "s2", "keys", "codes"])

    return rows


class Groups:
    """Union-find over the documents of a task."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        self.up[max(a, b)] = min(a, b)


def voronoi(d: np.ndarray, t: float, radius: float) -> np.ndarray:
    """d: distances, a row for each pivot -> who is in each pivot's cell, and in a last row who is in the cell of the rest.

    The home of x is its nearest pivot's cell, or the rest when that is farther than radius. x is in the cell of p too when
    d(x, p) <= min(d(x, nearest) + 2 t, radius + t): if y has its home there and d(x, y) <= t, then d(x, p) <= d(y, p) + t is
    within both, and two homeless ones are both in the rest. So every link has its ends in a cell together.
    """
    nearest = d.min(axis=0)
    return np.vstack([d <= np.minimum(nearest + 2 * t, radius + t) + 1e-9, nearest > radius])


def middle_radius(t: float) -> float:
    """Between what is near and what has nothing in common, with a window of t on the way."""
    return max(t, (1 - t) / 2)


class Region:
    """The sets of a task: distances of all of some members to one set, and the recursive join."""

    def __init__(self, sets: list[np.ndarray], percent: int, groups: Groups, side: np.ndarray | None = None):
        """side: only pairs of different sides count (None: all pairs)."""
        self.size = np.array([len(x) for x in sets], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.codes = np.unique(np.concatenate([np.zeros(0, U), *sets]), return_inverse=True)[1]
        self.seen = np.zeros(len(self.codes) + 1, bool)
        self.percent, self.groups, self.side = percent, groups, side
        self.splits = self.leaves = self.compared = 0

    def subset(self, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes of members one after the other, where each begins)."""
        size = self.size[members]
        starts = np.cumsum(size) - size
        return self.codes[np.arange(size.sum()) + np.repeat(self.at[members] - starts, size)], starts

    def common(self, pivot: int, subset: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """|x & pivot| for each x of a subset; no set is empty."""
        own = self.codes[self.at[pivot] : self.at[pivot] + self.size[pivot]]
        self.seen[own] = True
        out = np.add.reduceat(self.seen[subset[0]], subset[1], dtype=np.int64)
        self.seen[own] = False
        self.compared += len(out)
        return out

    def linked(self, common: np.ndarray, pivot: int, members: np.ndarray) -> np.ndarray:
        return 100 * common >= self.percent * (self.size[members] + self.size[pivot] - common)

    def distance(self, common: np.ndarray, pivot: int, members: np.ndarray) -> np.ndarray:
        return 1 - common / (self.size[members] + self.size[pivot] - common)

    def done(self, members: np.ndarray) -> bool:
        """There is no pair left to compare: one group, or one side."""
        root = self.groups.find(int(members[0]))
        return all(self.groups.find(int(i)) == root for i in members[1:]) or (self.side is not None and len(np.unique(self.side[members])) == 1)

    def join(self, members: np.ndarray) -> None:
        """Join in groups what is linked among members."""
        if len(members) < 2 or self.done(members):
            return
        subset = self.subset(members)
        if len(members) > LEAF:
            # The first pivot is the one with the most common shingles: near copies link to their original.
            shared = np.bincount(subset[0], minlength=1)[subset[0]]
            nearest, rows, pivot = np.full(len(members), np.inf), [], int((np.add.reduceat(shared, subset[1]) / self.size[members]).argmax())
            while len(rows) < PIVOTS and (not rows or nearest.max() > 0):
                common = self.common(int(members[pivot]), subset)
                for i in members[self.linked(common, int(members[pivot]), members)]:
                    self.groups.join(int(i), int(members[pivot]))
                rows.append(self.distance(common, int(members[pivot]), members))
                nearest = np.minimum(nearest, rows[-1])
                pivot = int(nearest.argmax())
            if self.done(members):
                return
            t = 1 - self.percent / 100
            pairs = lambda cells: int((cells.sum(axis=1).astype(np.int64) ** 2).sum())
            cells = min((voronoi(np.array(rows), t, r) for r in (t, middle_radius(t), 1.0)), key=pairs)
            # Windows replicate: cells must have far fewer pairs together than there are.
            if pairs(cells) <= len(members) ** 2 * 3 // 4:
                self.splits += 1
                for cell in cells:
                    self.join(members[cell])
                return
        self.leaves += 1
        roots = np.array([self.groups.find(int(i)) for i in members])
        for k, i in enumerate(members[:-1]):
            others = roots[k + 1 :] != roots[k]
            if self.side is not None:
                others &= self.side[members[k + 1 :]] != self.side[i]
            if not others.any():
                continue
            hit = np.flatnonzero(others & self.linked(self.common(int(i), (subset[0][subset[1][k + 1] :], subset[1][k + 1 :] - subset[1][k + 1])), int(i), members[k + 1 :]))
            if len(hit):
                for j in members[k + 1 :][hit]:
                    self.groups.join(int(i), int(j))
                roots = np.array([self.groups.find(int(x)) for x in members])


def may_link(sets: list[np.ndarray], members: np.ndarray, percent: int) -> list[np.ndarray]:
    """members split into groups of which no two can have a link between them; members that can have none are left out.

    Two linked sets share one of their rarest |x| - ceil(s |x|) + 1 shingles, rare counted within members.
    """
    size = np.array([len(sets[i]) for i in members])
    flat, owner = np.concatenate([sets[i] for i in members]), np.repeat(np.arange(len(members)), size)
    _, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
    order = np.lexsort((inverse, count[inverse], owner))
    place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    prefix = order[(place < (size - -(-percent * size // 100) + 1)[owner]) & (count[inverse[order]] > 1)]
    prefix = prefix[np.argsort(inverse[prefix], kind="stable")]
    same = np.flatnonzero(inverse[prefix[1:]] == inverse[prefix[:-1]])
    groups = Groups(len(members))
    for a, b in zip(owner[prefix[same]].tolist(), owner[prefix[same + 1]].tolist(), strict=True):
        groups.join(a, b)
    roots = np.array([groups.find(i) for i in range(len(members))])
    by = np.argsort(roots, kind="stable")
    return [members[g] for g in np.split(by, np.flatnonzero(np.diff(roots[by])) + 1) if len(g) > 1]


def sets_of(table: pa.Table, n: int) -> list[np.ndarray]:
    cache = WordHashes()
    return [shingle_set(t, n, cache) for t in table.column("text").cast(pa.binary()).to_pylist()]


def join_region(ids: list[int], sets: list[np.ndarray], known: list[int | None], side: np.ndarray | None, percent: int) -> tuple[list[tuple[int, int]], Region | None]:
    """Stars (id, smallest id of its group) of what is linked, and the region with its counts; known: groups that are linked already."""
    groups = Groups(len(ids))
    first: dict[int, int] = {}
    for i, g in enumerate(known):
        if g is not None:
            groups.join(i, first.setdefault(g, i))
    order = np.lexsort((ids, [len(s) for s in sets]))
    apart = may_link(sets, order, percent)
    region = Region(sets, percent, groups, side) if apart else None
    for members in apart:
        region.join(members)
    least: dict[int, int] = {}
    roots = [groups.find(i) for i in range(len(ids))]
    for r, x in zip(roots, ids, strict=True):
        least[r] = min(x, least.get(r, x))
    return sorted({(x, least[r]) for r, x in zip(roots, ids, strict=True) if x != least[r]}), region


def region_links(n: int, percent: int):
    """One cell or pair of blocks -> stars (src, dst) of the groups in it."""

    def links(table: pa.Table) -> pa.Table:
        blocks = np.array(table.column("block").to_pylist())
        side = blocks if len(np.unique(blocks)) > 1 else None
        pairs, _ = join_region(table.column("rep").to_pylist(), sets_of(table, n), table.column("grp").to_pylist(), side, percent)
        return pa.table({"src": pa.array([p[0] for p in pairs], pa.int64()), "dst": pa.array([p[1] for p in pairs], pa.int64())})

    return links


def pivot_rows(n: int, percent: int):
    """Members (part -1) and pivots (part from 0) of a cell -> (cell, rep, size, central, grp, stars, linked, near) of members.

    stars: pivots within t; linked, near: masks of the pivots within t, and of those whose cell the member is in.
    """
    schema = pa.schema([("cell", pa.int64()), ("rep", pa.int64()), ("size", pa.int64()), ("central", pa.float64()), ("grp", pa.int64()), ("stars", pa.list_(pa.int64())), ("linked", pa.int32()), ("near", pa.int32())])

    def rows(table: pa.Table) -> pa.Table:
        part, reps = np.array(table.column("part").to_pylist()), table.column("rep").to_pylist()
        members, pivots = np.flatnonzero(part < 0), np.flatnonzero(part >= 0)
        if not len(members) or not len(pivots):
            return schema.empty_table()
        region = Region(sets_of(table, n), percent, Groups(0))
        subset = region.subset(members)
        common = [region.common(int(p), subset) for p in pivots]
        within = np.array([region.linked(c, int(p), members) for c, p in zip(common, pivots, strict=True)])
        d = np.array([region.distance(c, int(p), members) for c, p in zip(common, pivots, strict=True)])
        near = voronoi(d, 1 - percent / 100, middle_radius(1 - percent / 100))
        bits = (1 << np.append(part[pivots], PIVOTS)).astype(np.int32)[:, None]
        masks = [np.bitwise_or.reduce(np.where(x, b, 0), axis=0) for x, b in ((within, bits[:-1]), (near, bits))]
        stars = [{reps[int(p)] for p in pivots[w]} for w in within.T]
        # A doc_id with several texts is one member, with what each of them is near to.
        first: dict[int, int] = {}
        for k, i in enumerate(members):
            j = first.setdefault(reps[int(i)], k)
            if j != k:
                stars[j] |= stars[k]
                for m in masks:
                    m[j] |= m[k]
        kept = list(first.values())
        rows = table.select(["cell", "rep", "size", "central", "grp"]).take(pa.array(members[kept]))
        return pa.Table.from_arrays([*(c.combine_chunks() for c in rows.columns), pa.array([sorted(stars[k]) for k in kept], pa.list_(pa.int64())), *(pa.array(m[kept]) for m in masks)], schema=schema)

    return rows


def merged_groups(table: pa.Table) -> pa.Table:
    """The distinct (grp, linked) of a cell -> for each the group that they make together: a few values a pivot, however many members."""
    cell, known, masks = table.column("cell")[0].as_py(), table.column("grp").to_pylist(), table.column("linked").to_pylist()
    tokens = {("grp", g): g for g in known if g is not None} | {("bit", k): int(mix(np.array([cell & (1 << 64) - 1], U), 40 + k).view(np.int64)[0]) for k in range(PIVOTS)}
    at = {t: i for i, t in enumerate(tokens)}
    groups = Groups(len(tokens))
    each = [[at[t] for t in ([("grp", g)] if g is not None else []) + [("bit", k) for k in range(PIVOTS) if m >> k & 1]] for g, m in zip(known, masks, strict=True)]
    for held in each:
        for i in held[1:]:
            groups.join(held[0], i)
    names = list(tokens.values())
    new = [names[groups.find(held[0])] if held else None for held in each]
    return pa.table({"cell": pa.array([cell] * len(new), pa.int64()), "grp": pa.array(known, pa.int64()), "linked": pa.array(masks, pa.int32()), "merged": pa.array(new, pa.int64())})


def open_cells(members: DataFrame) -> DataFrame:
    """(cell, docs, known, blocks) of cells (cell, rep, size, grp) with something left to compare."""
    g = members.groupBy("cell").agg(F.count("*").alias("docs"), F.sum("size").alias("shingles"), F.count("grp").alias("known"), F.min("grp").alias("a"), F.max("grp").alias("b"))
    g = g.where("docs > 1 and (known < docs or a <> b)")
    return g.select("cell", "docs", "known", F.greatest(F.ceil(F.col("docs") / BLOCK_DOCS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))


def split_round(members: DataFrame, big: DataFrame, texts: DataFrame, n: int, percent: int, turn: int) -> tuple[DataFrame, DataFrame]:
    """(members in new cells, edges to pivots) of the cells in big."""
    hot = materialize(skew_safe_lookup(members, big, ["cell"], ["blocks"], "docs", F.col("rep")).where("blocks is not null"), "hot")
    h = F.xxhash64("rep", F.lit(turn))
    first = F.min(F.struct(F.col("grp").isNotNull().alias("known"), (-F.col("central")).alias("far"), h.alias("h"), "rep", "blocks")).alias("p")
    pivots = hot.groupBy("cell", F.pmod(h, F.lit(PIVOTS)).cast("int").alias("part")).agg(first).select("cell", "part", "p.rep", "p.blocks")
    plain = hot.join(texts, "rep").select("cell", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("salt"), "rep", "size", "central", "grp", F.lit(-1).alias("part"), "text")
    spread = pivots.join(texts, "rep").select("cell", F.explode_outer(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("salt"), "rep", F.lit(0).cast("long").alias("size"), F.lit(0.0).alias("central"), F.lit(None).cast("long").alias("grp"), "part", "text")
    schema = "cell long, rep long, size long, central double, grp long, stars array<long>, linked int, near int"
    near = materialize(plain.union(spread).groupBy("cell", "salt").applyInArrow(pivot_rows(n, percent), schema), "near")
    edges = near.select(F.col("rep").alias("src"), F.explode("stars").alias("dst")).where("src <> dst")
    states = near.groupBy("cell", "grp", "linked").agg(F.count("*").alias("n"))
    merged = states.select("cell", "grp", "linked").groupBy("cell").applyInArrow(merged_groups, "cell long, grp long, linked int, merged long")
    # What pairs of blocks would read. A cell splits when its parts read far less than it would; else it goes on whole, with other pivots.
    counts = near.groupBy("cell").agg(F.count("*").alias("docs"), *(F.sum(F.shiftright("near", k).bitwiseAND(1)).cast("double").alias(f"n{k}") for k in range(PIVOTS + 1)))
    parts = [F.col(f"n{k}") for k in range(PIVOTS + 1)]
    reads = lambda n: n * F.ceil(n / BLOCK_DOCS)
    splits = sum(map(reads, parts), F.lit(0.0)) <= 0.6 * reads(F.col("docs"))
    plan = materialize(counts.select("cell", "docs", splits.alias("splits")).join(merged.groupBy("cell").agg(F.collect_list(F.struct("grp", "linked", "merged")).alias("states")), "cell"), "plan")
    told = skew_safe_lookup(near, plan, ["cell"], ["splits", "states"], "docs", F.col("rep"))
    state = F.get(F.filter("states", lambda x: x.grp.eqNullSafe(F.col("grp")) & (x.linked == F.col("linked"))), F.lit(0))
    whole = F.array(F.xxhash64("cell", F.lit(turn), F.lit(-1)))
    cells = F.when(F.col("splits"), F.array_compact(F.array(*(F.when(F.shiftright("near", k).bitwiseAND(1) == 1, F.xxhash64("cell", F.lit(turn), F.lit(k))) for k in range(PIVOTS + 1))))).otherwise(whole)
    return told.select(F.explode_outer(cells).alias("cell"), "rep", "size", "central", state.merged.alias("grp")), edges


def block_pairs(members: DataFrame, big: DataFrame) -> DataFrame:
    """(cell, pair, block, rep, grp): the members of large cells in pairs of blocks. A group of over BLOCK_DOCS members has blocks of its own, which don't
    meet one another; all other members share blocks, so small groups make no more of them."""
    hot = skew_safe_lookup(members, big, ["cell"], ["blocks"], "docs", F.col("rep")).where("blocks is not null")
    large = hot.where("grp is not null").groupBy("cell", "grp").agg(F.count("*").alias("_n")).where(F.col("_n") > BLOCK_DOCS).withColumn("_large", F.lit(True))
    hot = skew_safe_lookup(hot, large, ["cell", "grp"], ["_large"], "_n", F.col("rep")).withColumn("g", F.when(F.col("_large"), F.col("grp")).otherwise(0)).drop("_large")
    sizes = hot.groupBy("cell", "g").agg(F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("of"), F.count("*").alias("docs"))
    sizes = materialize(sizes, "blocks")
    block = sizes.select("cell", "g", F.explode_outer(F.sequence(F.lit(0), F.col("of") - 1)).alias("b"))
    side = lambda s: block.select("cell", *(F.col(c).alias(f"{s}_{c}") for c in ("g", "b")))
    order = F.struct("x_g", "x_b") <= F.struct("y_g", "y_b")
    # A pair of blocks, not of members: a cell has as many blocks as it has members by BLOCK_DOCS.
    pairs = side("x").join(side("y"), "cell").where(order & ((F.col("x_g") != F.col("y_g")) | (F.col("x_g") == 0)))
    ends = pairs.select("cell", F.xxhash64("x_g", "x_b", "y_g", "y_b").alias("pair"), F.array_distinct(F.array(F.struct(F.col("x_g").alias("g"), F.col("x_b").alias("b")), F.struct(F.col("y_g").alias("g"), F.col("y_b").alias("b")))).alias("ends"))
    ends = ends.select("cell", "pair", F.explode_outer("ends").alias("e")).select("cell", "pair", "e.g", "e.b")
    dealt = skew_safe_lookup(hot, sizes, ["cell", "g"], ["of"], "docs", F.col("rep")).withColumn("b", F.pmod(F.xxhash64("rep"), F.col("of")).cast("int"))
    return dealt.join(ends, ["cell", "g", "b"]).select("cell", "pair", F.xxhash64("g", "b").alias("block"), "rep", "grp")


def region_edges(members: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Edges (src, dst) between the members (cell, rep, size, central) of all regions, which have the components of their links."""
    members = members.withColumn("grp", F.lit(None).cast("long"))
    edges, small, left = [], [], math.inf
    for turn in range(ROUNDS + 1):
        cells = materialize(open_cells(members), "cells")
        one = skew_safe_lookup(members, cells.where("blocks = 1"), ["cell"], ["blocks"], "docs", F.col("rep")).where("blocks is not null")
        small.append(one.select("cell", F.lit(0).cast("long").alias("pair"), F.lit(0).cast("long").alias("block"), "rep", "grp"))
        big = cells.where("blocks > 1")
        unknown = big.agg(F.sum(F.col("docs") - F.col("known"))).first()[0]
        if unknown is None:
            break
        # Without much progress, as where all are as far from one another, more pivots would not help.
        if turn == ROUNDS or unknown > 0.9 * left:
            small.append(block_pairs(members, big))
            break
        left = unknown
        members, to_pivots = split_round(members, big, texts, n, percent, turn)
        members = materialize(members, "members")
        edges.append(to_pivots)
    placed = reduce(DataFrame.union, small)
    edges.append(placed.join(texts, "rep").select("cell", "pair", "block", "rep", "grp", "text").groupBy("cell", "pair").applyInArrow(region_links(n, percent), "src long, dst long"))
    return reduce(DataFrame.union, edges)


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of docs (doc_id long, text string).

    Two documents link when 100 |x & y| >= percent |x | y| for their sets of n-word shingles; percent is 1 to 100.
    """
    if not 1 <= percent <= 100:
        raise ValueError(f"percent {percent} is not in 1 to 100")
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = materialize(docs.mapInArrow(set_rows(n, percent), "doc_id long, n_shingles long, s1 long, s2 long, keys array<long>, codes array<int>"), "sets")
    full = sets.where("n_shingles > 0 and doc_id is not null")
    classes = materialize(full.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.max("n_shingles").alias("size")), "classes")
    reps = classes.select("rep", "size")
    keyed = full.join(reps.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("rep"), F.explode(F.arrays_zip("keys", "codes")).alias("k")).select("rep", "k.keys", "k.codes").toDF("rep", "key", "code")
    cells = materialize(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min(F.xxhash64("rep")).alias("pivot")).where("n > 1"), "cells")
    bloom = BlockedBloom.build(cells.select("key"), F.xxhash64("key"))
    met = skew_safe_lookup(bloom.possible(keyed, F.xxhash64("key")), cells, ["key"], ["pivot", "n"], "n", F.col("rep")).where("pivot is not null")
    # How many share its parts with a set, over all parts: the original of many near copies, if it is there, has the most.
    met = met.withColumn("central", F.sum("n").over(Window.partitionBy("rep")).cast("double"))
    crowded = F.row_number().over(Window.partitionBy("rep", "code").orderBy(F.desc("n"), "key"))
    pairs = met.withColumn("crowded", crowded).where("crowded > code div " + str(REGIONS)).select("pivot", "rep", "central").distinct()
    members = materialize(pairs.join(reps, "rep").select("pivot", "rep", "size", "central"), "members")
    linked_ids = BlockedBloom.build(members.select("rep").distinct(), F.xxhash64("rep"))
    texts = linked_ids.possible(docs.where("doc_id is not null").withColumnRenamed("doc_id", "rep"), F.xxhash64("rep"))
    edges = region_edges(members.withColumnRenamed("pivot", "cell"), texts, n, percent)
    # A doc_id of several texts links the representatives of them all.
    key = F.struct("s1", "s2")
    several = materialize(full.groupBy("doc_id").agg(F.min(key).alias("a"), F.max(key).alias("b")).where("a <> b").select("doc_id"), "several")
    own = full.select("doc_id", "s1", "s2").join(several, "doc_id", "left_semi").distinct()
    edges = edges.union(own.join(classes.select("s1", "s2", "rep"), ["s1", "s2"]).select("doc_id", "rep").where("doc_id <> rep"))
    labels = components(edges)
    classes = classes.join(labels, classes.rep == labels.node, "left").select("s1", "s2", "copies", F.coalesce("component", "rep").alias("component"))
    out = skew_safe_lookup(sets.select("doc_id", "n_shingles", "s1", "s2"), classes, ["s1", "s2"], ["component"], "copies", F.col("doc_id"))
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))).alias("component_id"))


def keep_one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its component; rows without a doc_id stay."""
    dropped = jaccard_components(docs, n, percent).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(docs.columns)
