"""Exact running values and ranks without one task per key.

Rows are cut into runs at splitters that Spark samples from the data (range partitioning on the key and the whole order),
so a key with a third of the rows, timestamps as order numbers or a million equal edges are spread alike. Windows run inside
(key, run); one summary row per run carries the state across. The runs are a written table: both the windows and the
summaries have to see the same ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from normlake.session import stored


def runs_of(df: DataFrame, key: str, order: list[Column], out: str = "_b") -> DataFrame:
    """``df`` with the number of each row's run; all rows of a key in an earlier run come before those in a later one."""
    return stored(df.repartitionByRange(F.col(key), *order).withColumn(out, F.spark_partition_id()), "runs")


def running_max(df: DataFrame, key: str, order: str, value: str, out: str) -> DataFrame:
    """Maximum of ``value`` over all rows of the key up to and including this one; equal places count in no fixed order."""
    df = runs_of(df, key, [F.col(order)])
    inside = Window.partitionBy(key, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = df.groupBy(key, "_b").agg(F.max(value).alias("_m")).select(key, "_b", F.max("_m").over(before).alias("_carry"))
    return df.withColumn(out, F.max(value).over(inside)).join(carry, [key, "_b"]).withColumn(out, F.greatest(out, "_carry")).drop("_b", "_carry")


def ranked(df: DataFrame, key: str, order: list[Column], out: str) -> DataFrame:
    """Zero-based position inside the key. ``order`` has to tell all rows of a key apart."""
    df = runs_of(df, key, order)
    inside = Window.partitionBy(key, "_b").orderBy(*order)
    before = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = df.groupBy(key, "_b").agg(F.count("*").alias("_n")).select(key, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    ranks = df.withColumn("_r", F.row_number().over(inside)).join(offsets, [key, "_b"])
    return ranks.withColumn(out, (F.col("_off") + F.col("_r") - 1).cast("long")).drop("_b", "_r", "_off")


def newest(df: DataFrame, key: str, order: list[Column], n: int, spread: Column, salts: int = 64) -> DataFrame:
    """The first ``n`` rows of each key by ``order``: first per salt, then over the survivors."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)))
    local = Window.partitionBy(key, "_salt").orderBy(*order)
    kept = salted.withColumn("_r", F.row_number().over(local)).where(F.col("_r") <= n)
    final = Window.partitionBy(key).orderBy(*order)
    return kept.withColumn("_r", F.row_number().over(final)).where(F.col("_r") <= n).drop("_r", "_salt")
