"""A blocked Bloom filter of 64-bit keys, in DataFrame operations.

A key sets one bit in each of the WORDS words of a single block, so a test touches one row of the filter.
Blocks are rows (block, w0..w3) made by a bit_or aggregate that combines before the shuffle.
The filter never outgrows MAX_BLOCKS rows, so it can always be broadcast; beyond its capacity it only lets more
false positives through, which the exact step behind it removes.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize

WORDS = 4
#: Keys to a block (256 bits): under 1 % false positives.
PER_BLOCK = 20
#: Most blocks: 40 bytes each, so 10 MB of data at most.
MAX_BLOCKS = 1 << 18


def _bit(h: Column, i: int) -> Column:
    """The bit of hash h in word i: six bits of the hash each."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 40 + 6 * i).bitwiseAND(63).cast("int"))


@dataclass
class BlockedBloom:
    table: DataFrame
    blocks: int

    @staticmethod
    def build(keys: DataFrame, hashed: Column) -> BlockedBloom:
        """keys: rows to insert; hashed: a 64-bit hash of the key."""
        n = keys.count()
        blocks = min(MAX_BLOCKS, max(16, n // PER_BLOCK))
        h = keys.select(hashed.alias("h"))
        h = h.select(F.pmod("h", F.lit(blocks)).cast("int").alias("_block"), *(_bit(F.col("h"), i).alias(f"_w{i}") for i in range(WORDS)))
        return BlockedBloom(materialize(h.groupBy("_block").agg(*(F.bit_or(f"_w{i}").alias(f"_w{i}") for i in range(WORDS))), "bloom"), blocks)

    def tested(self, rows: DataFrame, hashed: Column, name: str = "possible") -> DataFrame:
        """rows and a boolean: false means that the key is surely not in the filter. The filter is broadcast: MAX_BLOCKS bounds it."""
        h = rows.withColumn("_h", hashed).withColumn("_block", F.pmod("_h", F.lit(self.blocks)).cast("int")).join(F.broadcast(self.table), "_block", "left")
        hit = reduce(Column.__and__, (F.col(f"_w{i}").bitwiseAND(_bit(F.col("_h"), i)) != 0 for i in range(WORDS)))
        return h.select(*rows.columns, F.coalesce(hit, F.lit(False)).alias(name))

    def possible(self, rows: DataFrame, hashed: Column) -> DataFrame:
        return self.tested(rows, hashed, "_possible").where("_possible").drop("_possible")
