"""Shared pieces of the corpus operators: tables, scratch storage, row keys, token rules.

Row keys. Operators that take a text apart and sum its parts again group by (doc_id, digest of the text) and count
how many rows share that key, then give every one of them its row back. Rows that repeat an id with another text
stay apart, null ids form ordinary keys, and nothing depends on the order in which rows arrive.
"""

from __future__ import annotations

import pickle
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from normlake.session import ensure_checkpoint_dir

CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
TASK_BYTES, MOST_TASKS = 16 << 20, 4096
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACES = " \t\n\x0b\f\r"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/llm-{uuid.uuid4().hex}"


def saved(df: DataFrame, path: str) -> DataFrame:
    """Written once, read from then on: later jobs restart from these files, not from the scan."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def saved_once(df: DataFrame, path: str) -> DataFrame:
    """As :func:`saved`, for steps that shuffle much: their shuffle files go once the table stands."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP_KEY, None)
    conf.set(CLEANUP_KEY, "true")
    try:
        return saved(df, path)
    finally:
        conf.unset(CLEANUP_KEY) if before is None else conf.set(CLEANUP_KEY, before)


def same_twice(df: DataFrame) -> bool:
    """Whether ``df`` gives the same rows to the same tasks whenever it is read: files or literal rows, filtered at most."""
    plan = df._jdf.queryExecution().optimizedPlan()
    nodes = {re.match(r"[\s:+-]*(\w*)", line)[1] for line in plan.toString().splitlines()}
    return plan.deterministic() and nodes <= {"Project", "Filter", "Relation", "LocalRelation"}


def task_count(df: DataFrame, size: int = TASK_BYTES) -> int:
    """Tasks for a shuffle of about the bytes of ``df``: the session's number, more where the planner knows that these are many."""
    spark = df.sparkSession
    known = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    wanted = -(-known // size) if known < 1 << 50 else 0  # a larger one stands for an unknown size
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(wanted, MOST_TASKS))


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z only. Texts without other characters take the built-in lower, which agrees on them and is faster."""
    return F.when(text.rlike("[^\\x00-\\x7F]"), F.translate(text, UPPER, UPPER.lower())).otherwise(F.lower(text))


def space_words(text: Column) -> Column:
    """Runs of characters other than space and 0x09-0x0D."""
    trimmed = F.btrim(text, F.lit(SPACES))
    none = F.array().cast("array<string>")
    return F.when(trimmed == "", none).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+", -1))


def crc_id(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))


def per_copy(df: DataFrame, copies: str = "copies") -> DataFrame:
    """One row for each of the counted rows."""
    return df.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies).cast("long"))).alias("_copy")).drop("_copy", copies)


def sent(spark: SparkSession, thing: object) -> Callable[[], object]:
    """A function that gives ``thing`` inside tasks. A worker unpacks it once and keeps it, with what it remembers."""
    shared = spark.sparkContext.broadcast({"packed": cloudpickle.dumps(thing)})

    def get() -> object:
        held = shared.value
        if "thing" not in held:
            held["thing"] = pickle.loads(held["packed"])
        return held["thing"]

    return get


def row_slices(batches: Iterator[pa.RecordBatch], column: int, limit: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``limit`` bytes in a text column, so that a task's arrays don't grow with its batches."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = np.cumsum(size) // limit
        starts = np.flatnonzero(np.diff(group, prepend=-1))
        for lo, hi in zip(starts, [*starts[1:], batch.num_rows]):
            yield batch.slice(int(lo), int(hi - lo))
