"""Turning array columns into rows, and filtering on computed columns.

A plain ``explode`` or ``where`` over a long chain of computed columns makes the optimizer copy the filter
(size > 0, or the condition) down to the scan with every definition spelled out again, once per use. The
outer explode keeps the chain evaluated once: the filter stands on the position it produces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_rows(df: DataFrame, keep: list, records: Column, position: str | None = None, struct: bool = True, name: str = "value") -> DataFrame:
    """One row per array element: kept columns, optional position, and the element's fields (or ``name``)."""
    out = df.select(*keep, F.posexplode_outer(records).alias("_pos", "_rec")).where(F.col("_pos").isNotNull())
    names = [c for c in out.columns if c not in ("_pos", "_rec")]
    at = [F.col("_pos").alias(position)] if position else []
    return out.select(*names, *at, "_rec.*" if struct else F.col("_rec").alias(name))


def keep_rows(df: DataFrame, condition: Column) -> DataFrame:
    """``where`` for conditions on expensive computed columns."""
    mark = F.when(F.coalesce(condition, F.lit(False)), F.array(F.lit(1)))
    return df.select("*", F.posexplode_outer(mark).alias("_pos", "_rec")).where(F.col("_pos").isNotNull()).drop("_pos", "_rec")


def settled(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with ``columns`` computed once per row, whatever later columns make of them.

    The optimizer copies the definition of a column into the columns that use it where it can; it does not look
    through the one-element explode that these go through here.
    """
    others = [c for c in df.columns if c not in columns]
    return df.select(*others, F.explode(F.array(F.struct(*columns))).alias("_settled")).select(*others, "_settled.*")
