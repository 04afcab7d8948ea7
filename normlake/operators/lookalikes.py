"""Look-alike skeletons from a prototype table, and the words that share one.

prototypes(char, prototype): what a character looks like, in one or more characters, as in the published confusables table.
A character is one code point, so the table has at most as many rows as there are; it goes to the tasks, and each distinct
word is drawn anew where it lies.
"""

from __future__ import annotations

import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normlake.session import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have the package


def _skeleton(word: str, prototypes: DataFrame) -> Column:
    known = prototypes.where(F.char_length("char") == 1).groupBy("char").agg(F.min("prototype").alias("prototype")).where("prototype IS NOT NULL").toArrow()
    shapes = prototypes.sparkSession.sparkContext.broadcast({ord(c): p for c, p in zip(known["char"].to_pylist(), known["prototype"].to_pylist())})

    @F.arrow_udf("string")
    def drawn(words: pa.Array) -> pa.Array:
        table = shapes.value
        return pa.array([None if w is None else w.translate(table) for w in words.to_pylist()], pa.string())

    return drawn(F.col(word))


def skeletons(words: DataFrame, prototypes: DataFrame, word: str = "token") -> DataFrame:
    """(word, skeleton) for each distinct word, every character replaced by its prototype. Null words are left out."""
    distinct = words.where(F.col(word).isNotNull()).select(word).distinct()
    return distinct.withColumn("skeleton", _skeleton(word, prototypes))


def look_alike_index(tokens: DataFrame, prototypes: DataFrame) -> DataFrame:
    """Look-alikes among the words of tokens(source_id, token); see :func:`look_alikes`."""
    return look_alikes(tokens.select("source_id", "token").distinct().groupBy("token").agg(F.count("*").alias("sources")), prototypes)


def look_alikes(held: DataFrame, prototypes: DataFrame) -> DataFrame:
    """(token, skeleton, twin, sources, tokens): words of which another word has the same skeleton.

    held(token, sources) has each word once. ``twin`` is the group's word with the fewest characters outside ASCII, the
    smallest of equals, so a group of any size is one row for each of its words and never all pairs; ``sources`` counts the
    texts that hold the word and ``tokens`` the words of the group. The words are stored once: the groups and their members
    both start from there, and not from the texts.
    """
    drawn = stored(held.where("token IS NOT NULL").withColumn("skeleton", _skeleton("token", prototypes)), "words")
    foreign = F.length(F.regexp_replace("token", r"[\x00-\x7F]", ""))
    groups = drawn.groupBy("skeleton").agg(F.min(F.struct(foreign.alias("n"), "token")).alias("first"), F.count("*").alias("tokens")).where("tokens > 1")
    return drawn.join(groups, "skeleton").select("token", "skeleton", F.col("first.token").alias("twin"), "sources", "tokens")
