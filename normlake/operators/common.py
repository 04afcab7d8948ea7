"""Join shapes shared by the audits, chosen so that no key has to fit in one task.

Set comparisons group by (key, element), never by key alone. Verdicts first reduce failures to distinct
(run, code) pairs on the map side; the codes of one check are a small closed vocabulary.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unmatched(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Elements present on one side only, with ``in_left`` / ``in_right``; one shuffle, no join."""
    both = left.select(*on, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(
        right.select(*on, F.lit(0).alias("_l"), F.lit(1).alias("_r"))
    )
    sides = both.groupBy(*on).agg(F.max("_l").alias("_l"), F.max("_r").alias("_r"))
    return sides.where(F.col("_l") != F.col("_r")).select(
        *on, (F.col("_l") == 1).alias("in_left"), (F.col("_r") == 1).alias("in_right")
    )


def linked_codes(links: list[tuple[str, str, DataFrame, DataFrame, bool]], key: str = "run_id") -> DataFrame:
    """(key, code) of elements of a left list that a right one lacks, or, where both ways count, the reverse too.

    links: (code, id column, left, right, both ways). All lists meet in one shuffle by (key, link, element).
    """
    sides = [rows.select(key, F.lit(i).alias("_link"), F.col(column).cast("string").alias("_id"), F.lit(side).alias("_side"))
             for i, (_, column, left, right, _) in enumerate(links) for side, rows in ((1, left), (2, right))]
    seen = union_all(sides).groupBy(key, "_link", "_id").agg(F.bit_or("_side").alias("_side"))
    alone = F.lit(None).cast("string")
    for i, (code, _, _, _, both) in enumerate(links):
        lacking = F.col("_side") != 3 if both else (F.col("_side") == 1) | ((F.col("_side") == 3) & (F.col(key).isNull() | F.col("_id").isNull()))
        alone = F.when((F.col("_link") == i) & lacking, F.lit(code)).otherwise(alone)
    return seen.select(key, alone.alias("code")).where("code IS NOT NULL")


def ranges(parts: list[tuple[DataFrame, dict[str, str]]], key: str = "run_id") -> DataFrame:
    """(key, name_low, name_high for each name): smallest and largest values in the parts, {name: column}, from one shuffle."""
    kinds = {name: rows.schema[column].dataType for rows, own in parts for name, column in own.items()}
    rows = [rows.select(key, *[(F.col(own[name]) if name in own else F.lit(None).cast(kind)).alias(name) for name, kind in kinds.items()]) for rows, own in parts]
    return union_all(rows).groupBy(key).agg(*[f(name).alias(f"{name}_{end}") for name in kinds for f, end in ((F.min, "low"), (F.max, "high"))])


def apart(name: str, other: str) -> Column:
    """Whether some value of one name differs from some value of the other, in a row of :func:`ranges`."""
    return (F.col(f"{name}_low") != F.col(f"{other}_high")) | (F.col(f"{name}_high") != F.col(f"{other}_low"))


def coded(rows: DataFrame, code: str | Column, when: Column | None = None, key: str = "run_id") -> DataFrame:
    """(key, code) rows for the rows that satisfy ``when``."""
    kept = rows if when is None else rows.where(F.coalesce(when, F.lit(False)))
    return kept.select(key, (F.lit(code) if isinstance(code, str) else code).alias("code"))


def codes_of(rows: DataFrame, rules: list[tuple[str, Column]], key: str = "run_id") -> DataFrame:
    """All codes whose condition holds, from one pass over ``rows``."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(code)) for code, cond in rules]))
    return rows.select(key, F.explode(found).alias("code"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def verdict(
    runs: DataFrame, failures: DataFrame, check: str, passed: str, failed: str,
    required: Column | None = None, skip: list[tuple[Column, str, str]] = (), key: str = "run_id",
) -> DataFrame:
    """One row per run: (run_id, type, status, required, summary_code, failures).

    ``skip`` holds (condition, status, summary) cases tried before PASS and FAIL.
    """
    found = failures.select(key, "code").distinct().groupBy(key).agg(F.array_sort(F.collect_set("code")).alias("failures"))
    return judged(runs.join(found, key, "left"), check, passed, failed, required, skip, key)


def judged(
    df: DataFrame, check: str, passed: str, failed: str,
    required: Column | None = None, skip: list[tuple[Column, str, str]] = (), key: str = "run_id",
) -> DataFrame:
    """The verdict of runs that come with their codes in ``failures``; null is none."""
    none = F.array().cast("array<string>")
    bad = F.size(F.coalesce("failures", none)) > 0
    status = F.when(bad, F.lit("FAIL")).otherwise(F.lit("PASS"))
    summary = F.when(bad, F.lit(failed)).otherwise(F.lit(passed))
    skipped = F.lit(False)
    for cond, s, code in reversed(list(skip)):
        status = F.when(F.coalesce(cond, F.lit(False)), F.lit(s)).otherwise(status)
        summary = F.when(F.coalesce(cond, F.lit(False)), F.lit(code)).otherwise(summary)
        skipped = skipped | F.coalesce(cond, F.lit(False))
    return df.select(
        key, F.lit(check).alias("type"), status.alias("status"),
        (F.lit(True) if required is None else required).alias("required"), summary.alias("summary_code"),
        F.when(skipped, none).otherwise(F.coalesce("failures", none)).alias("failures"),
    )


def code_map(table: dict[str, str | Column]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
