"""License scans by diagonal voting.

Every rolling two-word gram of every text is hashed and joined to the positions of that gram in a small set of license
templates, word equality included. A match votes for a diagonal: its text position minus its template position. A full
diagonal is a place where the template stands word for word. Neighbouring diagonals of a template are merged, since
inserted or dropped words shift what follows: a span is a diagonal with all diagonals up to an allowance of words behind
it, so it is never longer than the template and that allowance. A span is verified by the most of its matches whose
positions rise in the text and in the template alike, and counts if they cover enough of the template.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from normlake.llm.common import ascii_lower, per_copy, text_of

# Base phrases and their labels.
BASE = (
    ("cc-by", "cc by"),
    ("gpl", "general public license"),
    ("reserved", "all rights reserved"),
)
# Wording of common licenses and notices, and the labels given for it.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl-or-later", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("mit", "released under the mit license"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)
GAP = 3  # words that a span may lose or gain,
GAP_SHARE = 8  # or one in so many words of a longer template
COVER = 0.8
WORD_BREAKS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def license_words(text: Column) -> Column:
    """Words of digits, small letters and characters beyond ASCII, after A-Z were lowered."""
    parts = F.split(ascii_lower(text), WORD_BREAKS, -1)
    lead = F.when(F.get(parts, F.lit(0)) == "", F.lit(1)).otherwise(F.lit(0))
    tail = F.when(F.get(parts, F.size(parts) - 1) == "", F.lit(1)).otherwise(F.lit(0))
    return F.slice(parts, lead + 1, F.greatest(F.size(parts) - lead - tail, F.lit(0)))


def template_rows(base: Sequence[tuple[str, str]], templates: Sequence[tuple[str, str]]) -> list[tuple]:
    """(template, label, base, size, allow, position, first, second) of every two-word gram of every template."""
    out = []
    for number, (label, text) in enumerate([*base, *templates]):
        words = text.split()
        if len(words) < 2:
            raise ValueError(f"a template has at least 2 words: {text}")
        allow = max(GAP, len(words) // GAP_SHARE)
        out += [(number, label, number < len(base), len(words) - 1, allow, i, words[i], words[i + 1]) for i in range(len(words) - 1)]
    return out


def template_table(templates: DataFrame) -> DataFrame:
    """The same rows from a table (label, text) of templates of any length; those of fewer than two words match nothing."""
    words = templates.select(F.xxhash64("label", "text").alias("template"), "label", license_words(text_of()).alias("_w")).dropDuplicates(["template"])
    words = words.where(F.size("_w") >= 2).select(
        "template", "label", F.lit(False).alias("base"), (F.size("_w") - 1).alias("size"),
        F.greatest(F.lit(GAP), F.floor(F.size("_w") / GAP_SHARE).cast("int")).alias("allow"), "_w", F.explode(F.sequence(F.lit(0), F.size("_w") - 2)).alias("at"))
    return words.select("template", "label", "base", "size", "allow", "at", F.get("_w", F.col("at")).alias("first"), F.get("_w", F.col("at") + 1).alias("second"))


def rising(spans: Column) -> Column:
    """The most matches of spans (diagonal, seen) whose positions rise in text and template alike."""
    pairs = F.flatten(F.transform(spans, lambda v: F.transform(v["seen"], lambda a: F.struct((v["diagonal"] + a).alias("pos"), (-a).alias("back")))))
    # The last of every best chain of each length; of matches at one place in the text only one can take part.
    ends = F.aggregate(F.array_sort(pairs), F.expr("CAST(array() AS ARRAY<INT>)"), lambda acc, pair: F.concat(
        F.filter(acc, lambda t: t < -pair["back"]), F.array(-pair["back"]), F.slice(F.filter(acc, lambda t: t >= -pair["back"]), 2, 2147483647)))
    return F.when(F.size(spans) == 1, F.size(spans[0]["seen"])).otherwise(F.size(ends))


def scan(docs: DataFrame, base: Sequence[tuple[str, str]] = BASE, templates: Sequence[tuple[str, str]] | DataFrame = TEMPLATES, cover: float = COVER) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row.

    ``templates`` is a fixed list, sent to all tasks, or a table (label, text) of any size, which is joined as any other.
    ``score`` is the largest share of a template that a verified span covers. Null and empty texts have no words and no
    labels; repeated rows stay repeated; rows that share an id but not the text stay apart; columns besides doc_id and
    text are not read; an empty table gives no row.
    """
    spark = docs.sparkSession
    listed = not isinstance(templates, DataFrame)
    shape = "template long, label string, base boolean, size int, allow int, at int, first string, second string"
    # One more row meets the row that every text has for itself, whose gram is two empty words.
    known = spark.createDataFrame([(-1, "", False, 0, GAP, 0, "", ""), *template_rows(base, templates if listed else [])], shape)
    reach = max([GAP, *(len(text.split()) // GAP_SHARE for _, text in [*base, *(templates if listed else [])])])
    if not listed:
        table = template_table(templates)
        known = known.unionByName(table)
        reach = max(reach, table.agg(F.max("allow")).first()[0] or GAP)
    known = known.withColumn("hash", F.xxhash64("first", "second"))
    if listed:
        known = F.broadcast(known)

    texts = docs.select("doc_id", text_of().alias("text"))
    words = texts.select("doc_id", F.xxhash64("text").alias("digest"), license_words(F.col("text")).alias("_w"))
    words = words.select("doc_id", "digest", "_w", F.explode(F.sequence(F.lit(-1), F.greatest(F.size("_w") - 2, F.lit(-1)))).alias("pos"))
    grams = words.select("doc_id", "digest", "pos", F.size("_w").cast("long").alias("n_words"),
                         F.when(F.col("pos") < 0, F.lit("")).otherwise(F.get("_w", F.col("pos"))).alias("w1"), F.when(F.col("pos") < 0, F.lit("")).otherwise(F.get("_w", F.col("pos") + 1)).alias("w2"))
    grams = grams.withColumn("hash", F.xxhash64("w1", "w2"))
    hits = grams.join(known, "hash").where((F.col("w1") == F.col("first")) & (F.col("w2") == F.col("second")))
    own = F.col("size") == 0
    hits = hits.select("doc_id", "digest", "n_words", "template", "label", "base", "size", "allow", "at", F.when(own, F.lit(0)).otherwise(F.col("pos") - F.col("at")).alias("diagonal"))

    doc = ["doc_id", "digest"]
    votes = hits.repartition(*doc).groupBy(*doc, "n_words", "template", "label", "base", "size", "allow", "diagonal").agg(F.count("*").alias("votes"), F.collect_set("at").alias("seen"))
    behind = Window.partitionBy(*doc, "template").orderBy("diagonal").rangeBetween(0, reach)
    near = F.filter(F.collect_list(F.struct("diagonal", "seen")).over(behind), lambda v: v["diagonal"] <= F.col("diagonal") + F.col("allow"))
    share = F.when(own, F.lit(0.0)).otherwise(rising(F.col("_near")) / F.col("size"))
    spans = votes.withColumn("_near", near).withColumn("share", share).withColumn("place", F.col("base") & (F.size("seen") == F.col("size")))
    held = F.when(F.col("base"), F.col("place")).otherwise(~own & (F.col("share") >= cover))
    found = spans.groupBy(*doc, "n_words").agg(
        F.max(F.when(own, F.col("votes"))).alias("copies"), F.count_if("place").alias("n_base"), F.min(F.when(F.col("place"), F.col("diagonal"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("place"), F.col("diagonal"))).cast("long").alias("last_word"), F.sort_array(F.collect_set(F.when(F.col("place"), F.col("label")))).alias("_base"),
        F.sort_array(F.collect_set(F.when(held, F.col("label")))).alias("_all"), F.max("share").alias("score"))
    return per_copy(found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.concat_ws(",", "_base").alias("base_labels"), F.concat_ws(",", "_all").alias("labels"), "score", "copies"))


def oracle() -> str:
    """The same scan in DuckDB: chains of matches are grown one match at a time."""
    values = ", ".join(f"({n}, '{label}', {str(b).upper()}, {size}, {allow}, {at}, '{w1}', '{w2}')" for n, label, b, size, allow, at, w1, w2 in template_rows(BASE, TEMPLATES))
    return f"""
    WITH RECURSIVE known(template, label, base, size, allow, spot, w1, w2) AS (VALUES {values}),
    words AS (
      SELECT doc_id, row_number() OVER () AS k,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
      FROM documents),
    grams AS (SELECT k, unnest(range(1, len(w))) AS i, w FROM words),
    hits AS (SELECT g.k, t.template, t.label, t.base, t.size, t.allow, t.spot, g.i - 1 AS pos FROM grams g JOIN known t ON g.w[g.i] = t.w1 AND g.w[g.i + 1] = t.w2),
    -- a chain: where it may lie at least and at most, its last match and how many it has
    chains(k, template, size, allow, low, high, pos, spot, n) AS (
      SELECT k, template, size, allow, pos - spot, pos - spot, pos, spot, 1 FROM hits
      UNION
      SELECT c.k, c.template, c.size, c.allow, least(c.low, h.pos - h.spot), greatest(c.high, h.pos - h.spot), h.pos, h.spot, c.n + 1
      FROM chains c JOIN hits h ON h.k = c.k AND h.template = c.template AND h.pos > c.pos AND h.spot > c.spot
      WHERE greatest(c.high, h.pos - h.spot) - least(c.low, h.pos - h.spot) <= c.allow),
    shares AS (SELECT k, template, max(n / size) AS share FROM chains GROUP BY k, template),
    places AS (SELECT k, label, pos - spot AS place FROM hits WHERE base GROUP BY k, template, label, size, pos - spot HAVING count(*) = size),
    bases AS (SELECT k, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS found FROM places GROUP BY k),
    names AS (SELECT DISTINCT template, label, base FROM known),
    others AS (SELECT k, list(DISTINCT label) FILTER (WHERE NOT base AND share >= {COVER}) AS found, max(share) AS score FROM shares JOIN names USING (template) GROUP BY k)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word,
           CAST(last_word AS BIGINT) AS last_word, coalesce(array_to_string(list_sort(b.found), ','), '') AS base_labels,
           coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.found, []), coalesce(o.found, [])))), ','), '') AS labels,
           CAST(coalesce(score, 0) AS DOUBLE) AS score
    FROM words LEFT JOIN bases b USING (k) LEFT JOIN others o USING (k)"""
