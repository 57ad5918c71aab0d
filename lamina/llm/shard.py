"""Sharding by a keyed permutation of global row numbers.

Rows are numbered 0 to n-1; a Feistel network permutes the smallest even-width bit domain that holds n,
and cycle walking (apply it again until the value is below n) makes that a permutation of the row
numbers. Position p goes to shard p mod S, slot p div S, so shard sizes differ by one at most, and shard and
slot of a row, or the row of a shard and slot, are computed without any table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import materialise, mix64, salted_rank, text_of
from lamina.session import ship

ROUNDS = 6


class Feistel:
    """A permutation of 0..n-1 for a seed, and its inverse, on numpy arrays."""

    def __init__(self, n: int, seed: int) -> None:
        self.n = n
        self.half = np.uint64(max(1, -(-max(n - 1, 1).bit_length() // 2)))
        self.mask = (np.uint64(1) << self.half) - np.uint64(1)
        self.keys = mix64(np.arange(1, ROUNDS + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(1000003))

    def _once(self, x: np.ndarray, keys: np.ndarray, inverse: bool) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for k in keys:
            if inverse:
                left, right = right ^ (mix64(left ^ k) & self.mask), left
            else:
                left, right = right, left ^ (mix64(right ^ k) & self.mask)
        return (left << self.half) | right

    def _walk(self, x, inverse: bool) -> np.ndarray:
        y = np.array(x, np.uint64)
        keys = self.keys[::-1] if inverse else self.keys
        todo = np.arange(len(y))
        while len(todo):
            y[todo] = self._once(y[todo], keys, inverse)
            todo = todo[y[todo] >= np.uint64(self.n)]
        return y.astype(np.int64)

    def forward(self, x) -> np.ndarray:
        return self._walk(x, False)

    def inverse(self, x) -> np.ndarray:
        return self._walk(x, True)


def locate(row: int, n: int, shards: int, seed: int = 42) -> tuple[int, int]:
    """(shard, slot) of a row number."""
    p = int(Feistel(n, seed).forward([row])[0])
    return p % shards, p // shards


def row_at(shard: int, slot: int, n: int, shards: int, seed: int = 42) -> int:
    """The row number that is at a slot of a shard."""
    return int(Feistel(n, seed).inverse([slot * shards + shard])[0])


def permute_rows(df: DataFrame, keys: list[str], shards: int, seed: int = 42) -> DataFrame:
    """Add row_no, shard and slot to a narrow frame; gapless slots from 0 in each shard.

    Row numbers follow (hash group, keys). Rows equal in all keys are interchangeable. No rows: no rows.
    """
    df = materialise(df, "rows")
    n = df.count()
    order = Feistel(n, seed)
    ship(df.sparkSession)

    @F.pandas_udf("long")
    def position(rows: pd.Series) -> pd.Series:
        return pd.Series(order.forward(rows.to_numpy()))

    placed = salted_rank(df, keys).withColumn("_p", position("row_no"))
    return placed.withColumn("shard", (F.col("_p") % shards).cast("int")).withColumn("slot", F.expr(f"_p div {shards}")).drop("_p")


def shard_documents(docs: DataFrame, shards: int = 16, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) for every row, by the law ``rows``.

    Size is the UTF-8 length plus one; a null text is empty. A null id is a value like any other.
    """
    text = text_of(docs, text_col)
    narrow = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = permute_rows(narrow, ["id", "text_crc32", "size"], shards, seed)
    return placed.select("id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_no")
