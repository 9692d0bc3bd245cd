"""Versions of facts folded from a stream of operations, with the state of each fact kept between micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FIRST, AGAIN, LAST = "INCLUSAO", ("ALTERACAO", "RETIFICACAO"), "EXCLUSAO"
OUT = "fact string, seq long, operation string, result string, version int"
STATE = "version int, content string, operation string"


def step(state: tuple | None, operation: str, content: str) -> tuple[str, tuple | None]:
    """(result, new state) of an operation; state: (version, content, last operation), None before the first.

    The same content and operation as the last is a retransmission. A fact starts with an inclusion, which also reopens it
    after an exclusion; a change must change the content; other orders are rejected and change nothing.
    """
    if state and (content, operation) == state[1:]:
        return "RETRANSMITIDO", state
    n = state[0] + 1 if state else 1
    if operation == FIRST and state is None:
        return "INCLUIDO", (n, content, operation)
    if operation == FIRST and state[2] == LAST:
        return "REABERTO", (n, content, operation)
    if state and state[2] != LAST and operation in AGAIN and content != state[1]:
        return "VERSIONADO", (n, content, operation)
    if state and state[2] != LAST and operation == LAST:
        return "EXCLUIDO", (n, content, operation)
    return "REJEITADO", state


def _fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    now = tuple(state.get) if state.exists else None
    # Rows of a micro-batch come in no order, and a fact's order is by seq.
    rows = pd.concat(list(frames)).sort_values("seq", kind="stable")
    out = []
    for r in rows.itertuples():
        result, now = step(now, r.operation, r.content)
        out.append((key[0], r.seq, r.operation, result, now[0] if now else 0))
    if now:
        state.update(now)
    yield pd.DataFrame(out, columns=["fact", "seq", "operation", "result", "version"])


def folded(stream: DataFrame) -> DataFrame:
    """(fact, seq, operation, result, version) of each operation (fact, seq, operation, content), in append mode.

    Operations of a fact must come in order over micro-batches; within one they are sorted by seq.
    """
    return stream.select("fact", "seq", "operation", "content").groupBy("fact").applyInPandasWithState(_fold, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def folded_batch(operations: DataFrame) -> DataFrame:
    """The same of a table. Facts are dealt by hash and read in order of (fact, seq); a task holds the state of one fact and a batch of rows."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fact, state = None, None
        for b in batches:
            out = []
            for r in b.itertuples():
                if r.fact != fact:
                    fact, state = r.fact, None
                result, state = step(state, r.operation, r.content)
                out.append((r.fact, r.seq, r.operation, result, state[0] if state else 0))
            yield pd.DataFrame(out, columns=["fact", "seq", "operation", "result", "version"])

    return operations.select(F.col("fact").cast("string").alias("fact"), F.col("seq").cast("long").alias("seq"), "operation", "content").where("fact is not null").repartition("fact").sortWithinPartitions("fact", "seq").mapInPandas(fold, OUT)
