"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are short and documents may be long, where the Jaccard similarity of an item and a whole document says nothing. So
items are partitioned by size. Those of up to BASE shingles are looked up exactly: a document that holds need of an item's s
shingles holds one of any s - need + 1 of them, so that many of each item go to an index in which all shingles of a document
are looked up. For a partition of larger items, of up to S shingles, a document is cut into overlapping windows of 2 S shingles.
An item of more than S/2 that stands whole in the document fills over a quarter of a window, and none of PERMUTATIONS
MinHash values agrees with a chance of about 1e-8; with only 80 % of its shingles there, in one passage, it may be down to
0.19 of the union, and the chance is about 1.3e-6 (for S/2 + 1 shingles, the worst size; for S under 1e-12). Shingles that
lie scattered over a document in different windows are missed more often.
The minima of small blocks are computed once and combined to the windows of each partition. Each candidate is verified by
the exact containment of its shingles in those of the whole document. Documents are judged where they stand: no shuffle, and
no group of documents can get hot.

The items of BLOCK_ITEMS or BLOCK_BYTES at a time are indexed on the driver, once, and the index goes to the tasks, so its size is
bounded; more items take more passes. An item longer than BLOCK_BYTES makes a block of its own.

Words: [^\\x20\\x09-\\x0D]+ with A-Z lower-cased; shingles of n words, or the whole item where it is shorter (which only
documents as short can contain). Null or empty items and documents contain nothing. Repeated rows are judged each for itself.
Items that repeat an item_id count as items of their own. Empty tables give empty results. Columns of documents other than doc_id
and text are ignored by contained_items() and kept by drop_contaminated(), whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import small_batches
from tessera.llm.shingles import U, WordHashes, mix, windows, words

N, PERCENT = 5, 80
PERMUTATIONS = 64
#: Shingles of the smallest block; items of up to so many are looked up exactly, the sizes of others are partitioned by BASE times powers of two.
BASE = 16
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 16 << 20
MULTIPLIERS = mix(np.arange(1, PERMUTATIONS + 1, dtype=U), 21) | U(1)


class ItemIndex:
    def __init__(self, items: list[tuple[int, bytes]], n: int, percent: int):
        cache = WordHashes()
        self.ids, self.sets = [], []
        for item_id, text in items:
            s = np.unique(windows(cache.of(words(text)), n))
            if len(s):
                self.ids.append(item_id)
                self.sets.append(s)
        self.need = [-(-percent * len(s) // 100) for s in self.sets]
        by_level: dict[int, list[int]] = {}
        short: list[int] = []
        for i, s in enumerate(self.sets):
            if len(s) <= BASE:
                short.append(i)
            else:
                by_level.setdefault(int(np.ceil(np.log2(len(s) / BASE))), []).append(i)
        #: Shingles of short items in order, of each item as many as it can't do without, and the items.
        sought = [self.sets[i][: len(self.sets[i]) - self.need[i] + 1] for i in short]
        self.short, order = np.concatenate([np.zeros(0, U), *sought]), np.repeat(np.array(short, np.int64), [len(x) for x in sought])
        at = np.argsort(self.short, kind="stable")
        self.short, self.short_items = self.short[at], order[at]
        #: level -> items, and for each permutation their sorted minima and the items in this order.
        self.levels = {}
        for level, members in sorted(by_level.items()):
            flat, starts = np.concatenate([self.sets[i] for i in members]), np.cumsum([0] + [len(self.sets[i]) for i in members[:-1]])
            minima = np.array([np.minimum.reduceat(flat * a, starts) for a in MULTIPLIERS], U)
            order = np.argsort(minima, axis=1, kind="stable")
            self.levels[level] = (np.array(members), np.take_along_axis(minima, order, 1), order)
        self.add_maps()

    def add_maps(self) -> None:
        """Bitmaps of the low bits of what is looked up."""
        bits = max(16, int(np.ceil(np.log2(16 * len(self.sets) + 1))))
        self.mask = U((1 << bits) - 1)
        self.short_map = np.zeros(1 << bits, bool)
        self.short_map[self.short & self.mask] = True
        self.maps = {}
        for level, (_, minima, _) in self.levels.items():
            seen = self.maps[level] = np.zeros((PERMUTATIONS, 1 << bits), bool)
            for k in range(PERMUTATIONS):
                seen[k, minima[k] & self.mask] = True

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("mask", "short_map", "maps")}

    def __setstate__(self, state: dict) -> None:
        """Bitmaps are larger than all else and don't travel."""
        self.__dict__.update(state)
        self.add_maps()

    def candidates(self, shingles: np.ndarray, sizes: np.ndarray) -> set[tuple[int, int]]:
        """(document, item) candidates; shingles: of all documents in order; sizes: how many each document has."""
        found: set[tuple[int, int]] = set()
        if not len(shingles) or not self.sets:
            return found
        begin = np.cumsum(sizes) - sizes
        hit = np.flatnonzero(self.short_map[shingles & self.mask]) if len(self.short) else np.zeros(0, np.int64)
        lo, hi = np.searchsorted(self.short, shingles[hit], "left"), np.searchsorted(self.short, shingles[hit], "right")
        for d, a, b in zip(np.searchsorted(begin + sizes, hit, "right").tolist(), lo.tolist(), hi.tolist(), strict=True):
            found.update((d, int(x)) for x in self.short_items[a:b])
        if not self.levels:
            return found
        blocks = -(-sizes // BASE)
        doc = np.repeat(np.arange(len(sizes)), blocks)
        within = np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        starts = begin[doc] + BASE * within
        plans = []
        for level in self.levels:
            head = np.flatnonzero(within % (1 << level) == 0)
            owner = doc[head]
            plans.append((level, head, owner, np.append(owner[1:] == owner[:-1], False)))
        for k in range(PERMUTATIONS):
            least = np.minimum.reduceat(shingles * MULTIPLIERS[k], starts)
            for level, head, owner, goes_on in plans:
                m = np.minimum.reduceat(least, head)
                window = np.where(goes_on, np.minimum(m, np.append(m[1:], m[-1:])), m)
                hit = np.flatnonzero(self.maps[level][k][window & self.mask])
                if not len(hit):
                    continue
                members, minima, order = self.levels[level]
                lo, hi = np.searchsorted(minima[k], window[hit], "left"), np.searchsorted(minima[k], window[hit], "right")
                for h, a, b in zip(hit[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
                    found.update((int(owner[h]), int(members[x])) for x in order[k, a:b])
        return found

    def matches(self, texts: list[bytes | None], cache: WordHashes, n: int) -> list[tuple[int, int, int]]:
        """(document, item, shared shingles) of verified containments."""
        each = [windows(cache.of(words(t)), n) for t in texts]
        sizes = np.array([len(s) for s in each], np.int64)
        out = []
        for d, i in sorted(self.candidates(np.concatenate(each), sizes)) if len(each) else []:
            shared = int(np.isin(self.sets[i], each[d]).sum())
            if shared >= self.need[i]:
                out.append((d, i, shared))
        return out


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, bytes]]]:
    """Items, BLOCK_ITEMS or BLOCK_BYTES at a time."""
    block: list[tuple[int, bytes]] = []
    held = 0
    for r in benchmark.select("item_id", F.col("text").cast("string").alias("text")).where("text is not null").toLocalIterator():
        block.append((r.item_id, r.text.encode()))
        held += len(block[-1][1])
        if len(block) == BLOCK_ITEMS or held >= BLOCK_BYTES:
            yield block
            block, held = [], 0
    if block:
        yield block


def contained_items(docs: DataFrame, benchmark: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """(doc_id, item_id, n_shared, n_shingles) for each item of which at least percent of the shingles are in the document."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, n_shared long, n_shingles long"

    def search(index: ItemIndex):
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cache = WordHashes()
            for b in batches:
                got = index.matches(b.column("text").cast(pa.binary()).to_pylist(), cache, n)
                ids = b.column("doc_id").to_pylist()
                columns = [[ids[d] for d, _, _ in got], [index.ids[i] for _, i, _ in got], [s for _, _, s in got], [len(index.sets[i]) for _, i, _ in got]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "item_id", "n_shared", "n_shingles"])

        return rows

    out = docs.sparkSession.createDataFrame([], schema)
    for items in item_blocks(benchmark):
        out = out.union(docs.mapInArrow(search(ItemIndex(items, n, percent)), schema))
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """The rows of docs (with a text column) that contain no item; rows with a null or empty text contain none and stay."""
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def clean(index: ItemIndex):
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cache = WordHashes()
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                keep[[d for d, _, _ in index.matches(b.column(at).cast(pa.binary()).to_pylist(), cache, n)]] = False
                yield b.filter(pa.array(keep))

        return rows

    for items in item_blocks(benchmark):
        docs = docs.mapInArrow(clean(ItemIndex(items, n, percent)), docs.schema)
    return docs
