"""SimHash fingerprints and the search for all fingerprints within a Hamming radius.

A term's 64-bit hash votes +1 or -1 on each bit of its document. Sixty-four counters per document would be slow, so two
counters share a long: bit k and bit k+32 of a hash are its lanes of 32 bits, and 32 sums hold all votes. A bit is set
when more than half of the votes (weights included) set it, which is the sign of the signed vote.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 64
_PAIR = 0x0000000100000001
_LOW = 0xFFFFFFFF


def shingles(df: DataFrame, keys: list[str], words: Column, width: int, second: int | None = None) -> DataFrame:
    """Keys, ``pos`` and ``hash`` of every run of ``width`` words, repeats included.

    Fewer words: the whole sequence is one shingle. No words: one row whose hash is 0, so that the row stays. With
    ``second``, ``hash2`` is the hash of the run of so many words from there; ``whole`` says whether there is one.
    """
    df = df.select(*keys, words.alias("_w"))
    last = F.greatest(F.size("_w") - width, F.lit(0))
    df = df.select(*keys, "_w", F.explode(F.sequence(F.lit(0), last)).alias("pos"))

    def run(size: int) -> Column:
        hashed = F.xxhash64(F.concat_ws(" ", *[F.get("_w", F.col("pos") + i) for i in range(size)]))
        return F.when(F.size("_w") > 0, hashed).otherwise(F.lit(0).cast("long"))

    if second is None:
        return df.select(*keys, "pos", run(width).alias("hash"))
    whole = (F.col("pos") == 0) | (F.col("pos") <= F.size("_w") - second)
    return df.select(*keys, "pos", run(width).alias("hash"), whole.alias("whole"), F.when(whole, run(second)).otherwise(F.lit(0).cast("long")).alias("hash2"))


def votes(weight: Column | None = None, hash_: str = "hash", lanes: str = "v", n: str = "n") -> list[Column]:
    """Sums to aggregate over a document's terms: the total ``n`` and the lanes ``v0`` .. ``v31``."""
    def lane(k: int) -> Column:
        picked = F.shiftrightunsigned(hash_, k).bitwiseAND(F.lit(_PAIR))
        return picked if weight is None else picked * weight

    total = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return [total.alias(n), *[F.sum(lane(k)).alias(f"{lanes}{k}") for k in range(32)]]


def fingerprint(lanes: str = "v", n: str = "n") -> Column:
    """The 64 signs as one long, from the sums of :func:`votes`."""
    out = F.lit(0).cast("long")
    for k in range(32):
        low = F.col(f"{lanes}{k}").bitwiseAND(F.lit(_LOW))
        high = F.shiftrightunsigned(f"{lanes}{k}", 32)
        for bit, count in ((k, low), (k + 32, high)):
            out = out.bitwiseOR(F.when(count * 2 > F.col(n), F.shiftleft(F.lit(1).cast("long"), bit)).otherwise(F.lit(0).cast("long")))
    return out


def hex64(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def likeness(a: Column, b: Column) -> Column:
    """Cosine that the angle between two fingerprints stands for, nothing below zero."""
    return F.greatest(F.cos(distance(a, b) * (3.141592653589793 / BITS)), F.lit(0.0))


def block_tables(radius: int, blocks: int) -> list[list[int]]:
    """Bit positions whose equality each table demands: all choices of ``blocks - radius`` blocks.

    Fingerprints within the radius differ in at most ``radius`` blocks, so they agree in all blocks of some choice.
    """
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    spans = [list(range(edges[i], edges[i + 1])) for i in range(blocks)]
    return [sum((spans[i] for i in chosen), []) for chosen in combinations(range(blocks), blocks - radius)]


def search(index: DataFrame, queries: DataFrame, radius: int = 3, blocks: int = 6, fp: str = "fp") -> DataFrame:
    """All (query_fp, fp, distance) within ``radius`` for the distinct fingerprints of ``queries`` against ``index``.

    Permuted block tables: each table masks the fingerprint to its blocks; equal masked values in a table meet in one
    equi-join and are verified by the full distance inside that join. A pair is reported once, by the first table that
    holds it. Null fingerprints match nothing.
    """
    tables = block_tables(radius, blocks)
    masks = [_signed(sum(1 << b for b in bits)) for bits in tables]

    def keyed(df: DataFrame, name: str) -> DataFrame:
        df = df.where(F.col(fp).isNotNull()).select(F.col(fp).alias(name)).distinct()
        keys = F.array(*[F.struct(F.lit(t).alias("t"), F.col(name).bitwiseAND(F.lit(m)).alias("k")) for t, m in enumerate(masks)])
        return df.select(name, F.explode(keys).alias("_k")).select(name, "_k.t", "_k.k")

    left, right = keyed(queries, "query_fp"), keyed(index, "fp")
    apart = F.col("query_fp").bitwiseXOR(F.col("fp"))
    first = F.lit(len(masks))
    for t in reversed(range(len(masks))):
        first = F.when(apart.bitwiseAND(F.lit(masks[t])) == 0, F.lit(t)).otherwise(first)
    met = left.alias("a").join(right.alias("b"), (F.col("a.t") == F.col("b.t")) & (F.col("a.k") == F.col("b.k"))
                               & (F.bit_count(apart) <= radius) & (first == F.col("a.t")))
    return met.select("query_fp", "fp", F.bit_count(apart).alias("distance"))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask
