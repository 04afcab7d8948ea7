"""Reproducible shuffle into shards by a Feistel permutation over global row numbers.

Rows get numbers 0 .. n-1; a Feistel network permutes the smallest power-of-two range that holds n, and numbers that
fall outside are permuted again until they land inside (cycle walking), which leaves a permutation of 0 .. n-1. Position
p goes to slot p // shards of shard p % shards, so shard sizes differ by at most one row, and both directions can be
computed for any single row without a look at the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from normlake.llm.common import saved, scratch

ROUNDS = 6
BUCKETS = 1024  # fixed, since row numbers depend on it


class Feistel:
    """A seeded permutation of 0 .. n-1 on arrays."""

    def __init__(self, n: int, seed: int):
        bits = max(2, (max(n, 1) - 1).bit_length())
        self.n, self.low = np.uint64(max(n, 1)), np.uint64(bits // 2)
        self.masks = np.uint64((1 << (bits - bits // 2)) - 1), np.uint64((1 << (bits // 2)) - 1)
        self.keys = np.random.default_rng(seed).integers(0, 1 << 63, ROUNDS, dtype=np.uint64)

    def _mixed(self, half: np.ndarray, turn: int) -> np.ndarray:
        h = (half + self.keys[turn]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return (h ^ (h >> np.uint64(29))) & self.masks[turn % 2]

    def _network(self, x: np.ndarray, turns: Iterator[int]) -> np.ndarray:
        sides = [x >> self.low, x & self.masks[1]]
        for turn in turns:
            sides[turn % 2] = sides[turn % 2] ^ self._mixed(sides[1 - turn % 2], turn)
        return sides[0] << self.low | sides[1]

    def _walk(self, x: np.ndarray, turns: range) -> np.ndarray:
        y = self._network(x.astype(np.uint64), turns)
        while (out := y >= self.n).any():
            y[out] = self._network(y[out], turns)
        return y.astype(np.int64)

    def position(self, row: np.ndarray) -> np.ndarray:
        return self._walk(row, range(ROUNDS))

    def row(self, position: np.ndarray) -> np.ndarray:
        return self._walk(position, range(ROUNDS - 1, -1, -1))


def locate(row: np.ndarray, n: int, shards: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(shard, slot) of row numbers."""
    at = Feistel(n, seed).position(np.asarray(row))
    return at % shards, at // shards


def row_at(shard: np.ndarray, slot: np.ndarray, n: int, shards: int, seed: int) -> np.ndarray:
    """Row numbers that stand at (shard, slot)."""
    return Feistel(n, seed).row(np.asarray(slot) * shards + np.asarray(shard))


def numbered(rows: DataFrame, out: str = "row") -> DataFrame:
    """``rows`` with global numbers 0 .. n-1 that depend on their values only, not on files or partitions.

    Equal rows are counted before anything is sorted and take consecutive numbers. Ranks run inside hash buckets; the
    buckets' own offsets are a table of ``BUCKETS`` rows.
    """
    names = rows.columns
    each = saved(rows.groupBy(*names).agg(F.count("*").alias("_n")).withColumn("_bucket", F.pmod(F.xxhash64(*names), F.lit(BUCKETS))), f"{scratch(rows.sparkSession)}/rows")
    before = Window.partitionBy("_bucket").orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    offsets = each.groupBy("_bucket").agg(F.sum("_n").alias("_all"))
    earlier = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.select("_bucket", F.coalesce(F.sum("_all").over(earlier), F.lit(0)).alias("_offset"))
    ranked = each.withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0))).join(F.broadcast(offsets), "_bucket")
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))
    return ranked.select(*names, (F.col("_offset") + F.col("_first")).alias("_first"), copies.alias("_copy")).select(*names, (F.col("_first") + F.col("_copy")).alias(out))


def shard_documents(docs: DataFrame, shards: int = 16, seed: int = 20) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row; the law is ``rows``.

    Size is the UTF-8 length of the text (null: empty) plus 1. Rows with equal id and text are interchangeable; null ids
    are ordinary values; other columns are not read; an empty table gives an empty table.
    """
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = numbered(docs.select("doc_id", (F.length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32")))
    n = docs.count()

    @F.pandas_udf("long")
    def position(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        permutation = Feistel(n, seed)
        for part in parts:
            yield pd.Series(permutation.position(part.to_numpy()))

    at = rows.withColumn("_at", position("row"))
    return at.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("_at") % shards).cast("int").alias("shard"),
                     F.expr(f"_at div {shards}").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
