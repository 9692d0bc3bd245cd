"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting fits a shallow tree on one feature at a time, round after round, and adds it to the feature's lookup table;
then the pairs of features that explain most of what is left get tables of their own in the same way. Scoring looks up the bins of
all features with numpy and adds.

It is fitted on TRAIN_ROWS labelled rows at most (those of the smallest hashes; only training rows), so what reaches the driver
is bounded; every row of the table is scored, its whole text read. Nothing but the text goes into a score.

Null and empty texts have the features of an empty text and get a score. Null labels are left out of training; equal
labels and rows that repeat a doc_id count once there. Repeated documents are scored each. Without both classes in training, the score is the
rate of the class that is there, or 0.5. Empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import small_batches

TRAIN_ROWS = 20_000
BINS, PAIR_BINS, PAIRS = 64, 12, 8
ROUNDS, PAIR_ROUNDS, RATE = 200, 60, 0.1
CUTOFF = 0.3
NAMES = [
    "log_words", "chars_a_word", "upper", "digits", "spaces", "newlines", "periods", "commas", "exclamations", "bars", "marks", "other_punctuation",
    "non_ascii", "distinct_words", "same_as_next", "same_as_second", "long_words", "short_words", "words_a_line", "repeated_lines", "capitalised", "letter_entropy",
]
_CLASS = {"upper": range(65, 91), "digits": range(48, 58), "spaces": [32], "newlines": [10], "periods": [46], "commas": [44], "exclamations": [33], "bars": [124], "marks": b"#*$%&<>", "non_ascii": range(128, 256)}
_PUNCTUATION = [b for b in range(33, 127) if not chr(b).isalnum() and b not in b".,!|#*$%&<>"]


def features(text: bytes | None) -> np.ndarray:
    """The NAMES of one text in UTF-8."""
    b = text or b""
    n = max(1, len(b))
    count = np.bincount(np.frombuffer(b, np.uint8), minlength=256)
    share = {k: count[list(v)].sum() / n for k, v in _CLASS.items()}
    words = b.split()
    m = max(1, len(words))
    size = np.fromiter(map(len, words), np.int64, len(words))
    code = np.fromiter(map(hash, words), np.int64, len(words))
    lines = [x for x in b.split(b"\n") if x.strip()]
    letters = count[97:123] + count[65:91]
    p = letters[letters > 0] / max(1, letters.sum())
    capital = sum(1 for w in words if 65 <= w[0] <= 90)
    return np.array([
        np.log1p(len(words)), size.mean() if len(size) else 0.0, share["upper"], share["digits"], share["spaces"], share["newlines"], share["periods"], share["commas"], share["exclamations"], share["bars"], share["marks"],
        count[_PUNCTUATION].sum() / n, share["non_ascii"], len(np.unique(code)) / m, (code[1:] == code[:-1]).sum() / m, (code[2:] == code[:-2]).sum() / m, (size > 12).sum() / m, (size < 3).sum() / m,
        len(words) / max(1, len(lines)), 1 - len(set(lines)) / max(1, len(lines)), capital / m, -(p * np.log(p)).sum(),
    ])


def _newton(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + 1.0)


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """The best cut of sums by bin: (gain, first bin of the right side)."""
    if len(g) < 2:
        return 0.0, 0
    cg, ch = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gains = _gain(cg, ch) + _gain(g.sum() - cg, h.sum() - ch) - _gain(g.sum(), h.sum())
    at = int(np.argmax(gains))
    return float(gains[at]), at + 1


def shallow_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree of depth two on sums by bin, as a value for each bin."""
    out = np.zeros(len(g))
    _, at = _cut(g, h)
    for lo, hi in ((0, at), (at, len(g))):
        _, cut = _cut(g[lo:hi], h[lo:hi])
        for a, b in ((lo, lo + cut), (lo + cut, hi)):
            out[a:b] = _newton(g[a:b].sum(), h[a:b].sum())
    return out


def shallow_tree_2d(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree of depth two on sums by two bins: each half of the best cut is cut once more, along either."""
    out = np.zeros(g.shape)

    def best(g: np.ndarray, h: np.ndarray) -> tuple[int, int]:
        x, y = _cut(g.sum(1), h.sum(1)), _cut(g.sum(0), h.sum(0))
        return (0, x[1]) if x[0] >= y[0] else (1, y[1])

    def parts(shape: tuple, axis: int, at: int) -> list:
        return [(slice(0, at), slice(None)), (slice(at, shape[0]), slice(None))] if axis == 0 else [(slice(None), slice(0, at)), (slice(None), slice(at, shape[1]))]

    for p in parts(g.shape, *best(g, h)):
        gp, hp, op = g[p], h[p], out[p]
        if gp.size:
            for q in parts(gp.shape, *best(gp, hp)):
                op[q] = _newton(gp[q].sum(), hp[q].sum())
    return out


@dataclass
class AdditiveModel:
    cuts: list[np.ndarray] = field(default_factory=list)
    pair_cuts: list[np.ndarray] = field(default_factory=list)
    intercept: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        rate = y.mean() if len(y) else 0.5
        if rate in (0.0, 1.0) or not len(y) or x.shape[0] < 2:
            self.intercept = float(np.log((rate + 1e-6) / (1 - rate + 1e-6)))
            return self
        self.intercept = float(np.log(rate / (1 - rate)))
        quantiles = lambda n: [np.unique(np.quantile(c, np.linspace(0, 1, n + 1)[1:-1])) for c in x.T]
        self.cuts, self.pair_cuts = quantiles(BINS), quantiles(PAIR_BINS)
        bins = [np.searchsorted(c, v, "right") for c, v in zip(self.cuts, x.T, strict=True)]
        self.tables = [np.zeros(len(c) + 1) for c in self.cuts]
        logit = np.full(len(y), self.intercept)
        for _ in range(ROUNDS):
            for b, table in zip(bins, self.tables, strict=True):
                p = 1 / (1 + np.exp(-logit))
                step = RATE * shallow_tree(np.bincount(b, y - p, len(table)), np.bincount(b, p * (1 - p), len(table)))
                table += step
                logit += step[b]
        coarse = [np.searchsorted(c, v, "right") for c, v in zip(self.pair_cuts, x.T, strict=True)]
        width = [len(c) + 1 for c in self.pair_cuts]
        p = 1 / (1 + np.exp(-logit))
        flat = lambda i, j: coarse[i] * width[j] + coarse[j]
        sums = lambda i, j, v: np.bincount(flat(i, j), v, width[i] * width[j]).reshape(width[i], width[j])
        gains = {(i, j): _gain(sums(i, j, y - p), sums(i, j, p * (1 - p))).sum() for i in range(len(width)) for j in range(i)}
        self.pairs = sorted(gains, key=lambda k: (-gains[k], k))[:PAIRS]
        self.pair_tables = [np.zeros((width[i], width[j])) for i, j in self.pairs]
        for _ in range(PAIR_ROUNDS):
            for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
                p = 1 / (1 + np.exp(-logit))
                step = RATE * shallow_tree_2d(sums(i, j, y - p), sums(i, j, p * (1 - p)))
                table += step
                logit += step[coarse[i], coarse[j]]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 for rows of features: bins looked up and added."""
        logit = np.full(len(x), self.intercept)
        for c, v, table in zip(self.cuts, x.T, self.tables, strict=False):
            logit += table[np.searchsorted(c, v, "right")]
        for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
            logit += table[np.searchsorted(self.pair_cuts[i], x[:, i], "right"), np.searchsorted(self.pair_cuts[j], x[:, j], "right")]
        return 1 / (1 + np.exp(-logit))


def held_out(doc_id: str | Column) -> Column:
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = [features(t).tolist() for t in b.column("text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "label", "x"])


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> AdditiveModel:
    """Fit on at most `rows` labelled rows (doc_id, quality) that are not held out. Rows that repeat a doc_id or a label count once, so
    no more than that reaches the driver; contradictory labels of a document count one each."""
    some = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id")).select("doc_id", F.col("quality").cast("double").alias("label")).distinct()
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(rows)
    met = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(some), "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), "label", "text")
    once = met.mapInArrow(feature_rows, "doc_id long, label double, x array<double>").groupBy("doc_id", "label").agg(F.min("x").alias("x"))
    got = sorted((r.label, tuple(r.x)) for r in once.collect())  # `rows` rows at most
    return AdditiveModel().fit(np.array([x for _, x in got]).reshape(len(got), len(NAMES)), np.array([y for y, _ in got]))


def score_documents(docs: DataFrame, model: AdditiveModel, cutoff: float = CUTOFF) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of docs."""
    small_batches(docs.sparkSession)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(model.score(np.array([features(t) for t in texts]).reshape(len(texts), len(NAMES))))], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id").alias("held_out"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(scored, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", F.when(F.col("score") >= cutoff, 1).otherwise(0))
