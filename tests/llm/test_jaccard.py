"""Components against brute force over exact word shingles."""

import random

import numpy as np
import pytest

from tessera.llm import ngram_jaccard
from tessera.llm.ngram_jaccard import jaccard_components, keep_one_of_each
from tessera.llm.shingles import WordHashes, words


def exact_set(text, n):
    w = words((text or "").encode())
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def brute(rows, n, percent):
    sets = [(d, exact_set(t, n)) for d, t in rows]
    up = {d: d for d, _ in sets if d is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, x in sets:
        for b, y in sets:
            if a is not None and b is not None and a < b and x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(a), find(b)))
                up[q] = p
    return sorted(((d, len(s), find(d) if d is not None else None) for d, s in sets), key=str)


def shown(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80)])
def test_edges(spark, edges, nothing, n, percent):
    assert shown(jaccard_components(edges, n, percent)) == brute([(r.doc_id, r.text) for r in edges.collect()], n, percent)
    assert jaccard_components(nothing, n, percent).count() == 0


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80)])
def test_near_copies(spark, n, percent):
    rng = random.Random(n)
    rows = []
    for base in range(12):
        text = [f"b{base}w{rng.randrange(400)}" for _ in range(rng.choice([9, 30, 120, 400]))]
        for _ in range(12):
            copy = list(text)
            for _ in range(rng.randrange(0, 1 + len(copy) // 30)):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(9999)}"
            rows.append((len(rows), " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, n, percent)
    assert shown(jaccard_components(df, n, percent)) == want
    assert sorted(r.doc_id for r in keep_one_of_each(df, n, percent).collect()) == sorted({c for _, _, c in want})


def test_linked_sets_share_a_part():
    """The keys that a set keeps when it leaves out its most crowded parts still meet those of any set linked to it."""
    rng = np.random.default_rng(1)
    for percent in (80, 90):
        for size in (12, 40, 150, 700):
            x = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
            for _ in range(5):
                drop = int(len(x) * (100 - percent) // 100)
                y = np.sort(rng.permutation(x)[drop:])
                kx, ky = (dict(zip(*ngram_jaccard.part_keys(s, percent), strict=True)) for s in (x, y))
                assert not drop or len(set(kx) & set(ky)) > max(max(kx.values(), default=0), max(ky.values(), default=0)) // 2 or len(set(kx) & set(ky)) > 0


def chains(rng, clusters, copies, length):
    """Clusters of copies, each a few words from one before it, so that many are linked over others only."""
    out = []
    for c in range(clusters):
        texts = [[f"c{c}w{rng.randrange(10**6)}" for _ in range(length)]]
        while len(texts) < copies:
            copy = list(rng.choice(texts[-20:]))
            for _ in range(1 + rng.randrange(1 + length // 30)):
                copy[rng.randrange(length)] = f"e{rng.randrange(10**6)}"
            texts.append(copy)
        out += texts
    rng.shuffle(out)
    return [" ".join(x) for x in out]


@pytest.mark.parametrize("percent,n", [(80, 5), (90, 3), (60, 1)])
@pytest.mark.parametrize("clusters,copies", [(8, 40), (1, 150), (120, 1)])
def test_regions_join_recursively(percent, n, clusters, copies):
    """A task's join in this process: it links to pivots, splits by them, and finds what all pairs do, with fewer comparisons."""
    rng = random.Random(clusters * percent)
    texts = chains(rng, clusters, copies, 60)
    cache = WordHashes()
    sets = [ngram_jaccard.shingle_set(t.encode(), n, cache) for t in texts]
    ids = rng.sample(range(10_000), len(texts))
    pairs, region = ngram_jaccard.join_region(ids, sets, [None] * len(ids), None, percent)
    label = {x: x for x in ids} | dict(pairs)
    assert sorted(label.items()) == sorted((d, c) for d, _, c in brute(list(zip(ids, texts, strict=True)), n, percent))
    if copies == 1:
        assert region is None
    else:
        assert region.compared <= len(ids) * (len(ids) - 1) / 2 + 6 * len(ids) and (clusters == 1 or region.compared < len(ids) ** 2 / 9)


def test_voronoi_cells_recur(monkeypatch):
    """Cells of cells: with small leaves, clusters are told apart by several levels of pivots."""
    monkeypatch.setattr(ngram_jaccard, "LEAF", 4)
    rng = random.Random(4)
    # All share some words, so that no shingle prefilter tells clusters apart, and distances to pivots differ.
    texts = [" ".join(f"s{k}" for k in range(24)) + " " + t for t in chains(rng, 30, 8, 50)]
    cache = WordHashes()
    sets = [ngram_jaccard.shingle_set(t.encode(), 1, cache) for t in texts]
    region = ngram_jaccard.Region(sets, 85, ngram_jaccard.Groups(len(sets)))
    region.join(np.arange(len(sets)))
    want = {d: c for d, _, c in brute(list(enumerate(texts)), 1, 85)}
    assert [region.groups.find(i) for i in range(len(sets))] == [want[i] for i in range(len(sets))]
    assert region.splits > 3


@pytest.mark.parametrize("docs,rounds", [(5, 4), (5, 1), (30, 2)])
def test_large_regions_split_and_pair_up(spark, monkeypatch, docs, rounds):
    """Regions far over the size of a block: rounds of pivots, groups that are done, and pairs of blocks for the rest."""
    monkeypatch.setattr(ngram_jaccard, "BLOCK_DOCS", docs)
    monkeypatch.setattr(ngram_jaccard, "ROUNDS", rounds)
    rng = random.Random(docs)
    base = [f"w{j}" for j in range(100)]
    rows = [(i, " ".join(w for j, w in enumerate(base) if j != i)) for i in range(60)]
    rows += [(1000 + i, t + " " + " ".join(base[:30])) for i, t in enumerate(chains(rng, 3, 40, 40))]
    # A doc_id of two texts, each linked to another cluster.
    rows += [(5000, rows[0][1]), (5000, rows[-1][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert shown(jaccard_components(df, 3, 90)) == brute(rows, 3, 90)


def test_pairs_of_blocks_leave_out_blocks_of_one_group(spark, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "BLOCK_DOCS", 10)
    members = spark.range(100).selectExpr("7L cell", "id rep", "1L size", "case when id < 60 then 1L when id < 90 then 2L end grp")
    big = ngram_jaccard.open_cells(members)
    assert [(r.docs, r.blocks) for r in big.collect()] == [(100, 10)]
    out = ngram_jaccard.block_pairs(members, big).collect()
    met = {}
    for r in out:
        met.setdefault(r.pair, []).append(r)
    together = {(min(a.rep, b.rep), max(a.rep, b.rep)) for rs in met.values() for a in rs for b in rs if a.rep != b.rep and (a.block != b.block or len({x.block for x in rs}) == 1)}
    group = lambda i: 1 if i < 60 else 2 if i < 90 else None
    assert together == {(a, b) for a in range(100) for b in range(a + 1, 100) if group(a) is None or group(a) != group(b)}


def test_hash_cache_is_bounded(monkeypatch):
    monkeypatch.setattr("tessera.llm.shingles.CACHE_WORDS", 10)
    c = WordHashes()
    c.of([str(i).encode() for i in range(100)])
    assert len(c) <= 10


@pytest.mark.parametrize("percent", [20, 50, 66])
def test_links_over_several_size_regions(spark, percent):
    """Pairs of a set and a part of it, down to the smallest part that links."""
    rows = []
    for size in (5, 19, 38, 75, 240):
        whole = [f"s{size}w{i}" for i in range(size)]
        for part in (-(-percent * size // 100), -(-percent * size // 100) - 1):
            own = [f"{w}p{part}" for w in whole]
            rows += [(len(rows), " ".join(own)), (len(rows) + 1, " ".join(own[:part]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 1, percent)
    assert any(d != c for d, _, c in want)
    assert shown(jaccard_components(df, 1, percent)) == want
