"""Code-point property dimension: about 40 thousand rows, fixed by the Unicode standard, so it broadcasts.

The large uniform blocks (ideographs, syllables, private use) are answered by range rules instead of rows.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from normlake.functions.text import scripts_of

# --- fixed values: uniform blocks (first, last, category, script) -----------------------------------
UNIFORM_BLOCKS = (
    (0x3400, 0x4DBF, "Lo", "HAN"),
    (0x4E00, 0x9FFF, "Lo", "HAN"),
    (0xAC00, 0xD7A3, "Lo", "HANGUL"),
    (0xE000, 0xF8FF, "Co", "OTHER"),
    (0x17000, 0x187F7, "Lo", "OTHER"),
    (0x20000, 0x2A6DF, "Lo", "HAN"),
    (0x2A700, 0x2EBE0, "Lo", "HAN"),
    (0x30000, 0x323AF, "Lo", "HAN"),
    (0xF0000, 0xFFFFD, "Co", "OTHER"),
    (0x100000, 0x10FFFD, "Co", "OTHER"),
)


def unicode_props(spark: SparkSession) -> DataFrame:
    """cp, category, script, ccc for every assigned code point outside the uniform blocks."""
    rows = []
    for cp in range(0x110000):
        if 0xD800 <= cp <= 0xDFFF or any(low <= cp <= high for low, high, _, _ in UNIFORM_BLOCKS):
            continue
        char = chr(cp)
        category = unicodedata.category(char)
        if category != "Cn":
            rows.append((cp, char, category, unicodedata.combining(char)))
    table = spark.createDataFrame(pd.DataFrame(rows, columns=["cp", "c", "category", "ccc"]))
    script = F.coalesce(
        F.get(scripts_of(F.col("c")), F.lit(0)),
        F.when(F.col("c").rlike(r"\p{IsInherited}"), F.lit("INHERITED")).otherwise(F.lit("COMMON")),
    )
    return table.select(
        F.col("cp").cast("int").alias("cp"), "category", script.alias("script"), F.col("ccc").cast("int").alias("ccc")
    )


def block_rule(cp: Column, field: int, default: str) -> Column:
    """Category (field 2) or script (field 3) of a code point by its uniform block."""
    rule = F.lit(None).cast("string")
    for block in UNIFORM_BLOCKS:
        rule = F.when(cp.between(block[0], block[1]), F.lit(block[field])).otherwise(rule)
    return F.coalesce(rule, F.lit(default))
