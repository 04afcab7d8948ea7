"""Mixing sources to target weights by hierarchical budgeting.

Leaves are the sources of a language of a domain. A leaf can give its tokens up to ``epochs`` times; a node can give what
its leaves can. A budget goes down the tree: among siblings it is shared by weight, a child that can't fill its share
gives all it has, and its shortage is shared among its siblings by weight again. Only what a whole family can't fill is
left to the relatives of its parent. All amounts are exact whole tokens.

A leaf then takes its budget as a prefix of its token stream: whole epochs first, then documents in the seeded order of
the last epoch as long as their first token lies inside the budget. The place where that epoch stops is found from sums
over 1024 ranges of the order, then inside the one range where the budget ends, so no leaf is ever sorted as a whole.
Everything is DataFrame functions; documents are not shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from normlake.llm.common import saved, scratch

LEVELS = ("domain", "lang", "source")
RANGE_BITS = 10
ORDER_BITS = 60


def domain_of(source: Column) -> Column:
    """Stand-in for a catalogue of domains: the number at the end of the source's name modulo 4; ``other`` without one."""
    digits = F.regexp_extract(source, "([0-9]{1,9})$", 1)
    return F.when(F.coalesce(digits, F.lit("")) == "", F.lit("other")).otherwise(F.concat(F.lit("d"), (F.try_to_number(digits, F.lit("999999999")).cast("long") % 4).cast("string")))


def _levels() -> list[Column]:
    return [domain_of(F.col("source")).alias("_domain"), F.coalesce("lang", F.lit("")).alias("_lang"), F.coalesce("source", F.lit("")).alias("_source")]


def _order(seed: int, epoch: Column, doc_id: Column) -> Column:
    """Place of a document in an epoch's order, below 2 ** ORDER_BITS."""
    text = F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), doc_id.cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def _shared(children: DataFrame, family: list[str], name: str) -> DataFrame:
    """``children`` (family.., name, weight, cap, total: the family's budget) with ``budget``."""
    ratio = F.when(F.col("weight") > 0, F.col("cap").cast("double") / F.col("weight").cast("double")).otherwise(F.lit(float("inf")))
    whole = Window.partitionBy(*family)
    by_ratio = whole.orderBy("_ratio", name)
    big = "decimal(19,0)"
    df = children.withColumn("_ratio", ratio).withColumns({
        "_gone": F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "_left": F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
        "_place": F.row_number().over(by_ratio)})
    full = F.col("cap").cast(big) * F.col("_left").cast(big) <= F.col("weight").cast(big) * (F.col("total") - F.col("_gone")).cast(big)
    df = df.withColumn("_stop", F.min(F.when(~full, F.struct("_place", "_gone", "_left"))).over(whole))
    open_ = F.col("_stop").isNotNull() & (F.col("_place") >= F.col("_stop._place"))
    part = F.expr(f"CAST(weight AS {big}) * CAST(total - _stop._gone AS {big}) div CAST(_stop._left AS {big})")
    df = df.withColumn("_open", open_)
    df = df.withColumn("budget", F.when(~F.col("_open"), F.col("cap")).when(F.col("_stop._left") > 0, F.least("cap", part)).otherwise(F.lit(0)))
    df = df.withColumns({"_rest": F.col("total") - F.sum("budget").over(whole),
                         "_turn": F.row_number().over(whole.orderBy((~F.col("_open")).cast("int"), (F.col("weight") == 0).cast("int"), name))})
    more = (F.col("_open") & (F.col("weight") > 0) & (F.col("_turn") <= F.col("_rest")) & (F.col("budget") < F.col("cap"))).cast("long")
    return df.withColumn("budget", (F.col("budget") + more).cast("long")).drop("_ratio", "_gone", "_left", "_place", "_stop", "_open", "_rest", "_turn", "weight", "total")


def _weight(weights: Mapping[str, int], name: str) -> Column:
    out = F.lit(1)
    for value, weight in weights.items():
        out = F.when(F.col(name) == value, F.lit(int(weight))).otherwise(out)
    return out.cast("long").alias("weight")


def plan(docs: DataFrame, weights: Sequence[Mapping[str, int]], budget_share: tuple[int, int], epochs: int, seed: int) -> DataFrame:
    """One row per leaf: _domain, _lang, _source, tokens, budget, whole (epochs), until_order, until_id.

    ``weights``: per level, whole-number weights by name (1 where absent, 0 gives nothing). The total budget is
    ``budget_share`` (a fraction) of the corpus, as far as the leaves can fill it.
    """
    folder = scratch(docs.sparkSession)
    levels = ["_domain", "_lang", "_source"]
    tokens = F.regexp_count(F.coalesce("text", F.lit("")), F.lit("[^\\x09-\\x0D\\x20]+")).cast("long")
    rows = saved(docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("_id"), *_levels(), tokens.alias("_tokens")), f"{folder}/tokens")

    leaves = rows.groupBy(*levels).agg(F.sum("_tokens").alias("tokens"))
    barred = [F.col(name) == value for name, level in zip(levels, weights) for value, weight in level.items() if weight <= 0]
    leaves = leaves.withColumn("cap", F.when(reduce(or_, barred, F.lit(False)), F.lit(0)).otherwise(F.col("tokens") * epochs).cast("long"))
    leaves = saved(leaves, f"{folder}/leaves")
    root = leaves.agg(F.expr(f"sum(tokens) * {budget_share[0]} div {budget_share[1]}").alias("asked"), F.sum("cap").alias("cap")).first()
    total = min(int(root["asked"] or 0), int(root["cap"] or 0))
    node, family = None, []
    for depth, name in enumerate(levels):
        children = leaves.groupBy(*levels[:depth + 1]).agg(F.sum("cap").alias("cap")).withColumn("weight", _weight(weights[depth], name))
        children = children.join(node, family) if family else children.withColumn("total", F.lit(total).cast("long"))
        node = _shared(children, family, name)
        family = levels[:depth + 1]
        node = node.select(*family, F.col("budget").alias("total"))
    leaf = leaves.join(node, levels).select(*levels, "tokens", F.col("total").alias("budget"))
    whole = F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(F.lit(0))
    leaf = saved(leaf.withColumn("whole", whole).withColumn("rest", F.col("budget") - F.col("whole") * F.col("tokens")), f"{folder}/budgets")

    placed = rows.join(leaf.where("rest > 0").select(*levels, "whole", "rest"), levels).withColumn("_order", _order(seed, F.col("whole"), F.col("_id")))
    placed = placed.withColumn("_range", F.shiftright("_order", ORDER_BITS - RANGE_BITS))
    sums = placed.groupBy(*levels, "rest", "_range").agg(F.sum("_tokens").alias("_sum"))
    running = Window.partitionBy(*levels).orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.withColumn("_before", F.sum("_sum").over(running) - F.col("_sum"))
    last = sums.where((F.col("_before") < F.col("rest")) & (F.col("_before") + F.col("_sum") >= F.col("rest"))).select(*levels, "_range", "_before")
    last = saved(last, f"{folder}/ranges")
    inside = placed.join(last, [*levels, "_range"]).groupBy(*levels, "rest", "_before", "_order", "_id").agg(F.sum("_tokens").alias("_sum"))
    running = Window.partitionBy(*levels).orderBy("_order", "_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = inside.where(F.col("_sum") > 0).withColumn("_start", F.col("_before") + F.sum("_sum").over(running) - F.col("_sum")).where(F.col("_start") < F.col("rest"))
    until = inside.groupBy(*levels).agg(F.max(F.struct("_order", "_id")).alias("_until"))
    out = leaf.join(until, levels, "left").select(*levels, "tokens", "budget", "whole", F.col("_until._order").alias("until_order"), F.col("_until._id").alias("until_id"))
    return saved(out, f"{folder}/plan")


def mix(docs: DataFrame, weights: Sequence[Mapping[str, int]], budget_share: tuple[int, int] = (3, 5), epochs: int = 2, seed: int = 7) -> DataFrame:
    """All columns of ``docs`` and ``_domain``, ``_lang``, ``_source``, ``_budget``, ``_epochs``: how often a row is taken.

    ``docs`` has doc_id, text, lang, source. Null lang and source form leaves of their own under the empty name; a null
    id counts as -1; rows that share an id in a leaf enter an epoch together; texts without tokens go with their place
    in the order. Columns of ``docs`` that start with the five names are replaced. An empty table gives an empty table.
    """
    levels = ["_domain", "_lang", "_source"]
    chosen = plan(docs, weights, budget_share, epochs, seed)
    plain = docs.drop(*[c for c in docs.columns if c in (*levels, "_budget", "_epochs")])
    rows = plain.select("*", *_levels()).join(chosen.select(*levels, F.col("budget").alias("_budget"), "whole", "until_order", "until_id"), levels, "left")
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(-1))
    order = _order(seed, F.col("whole"), own)
    part = (order < F.col("until_order")) | ((order == F.col("until_order")) & (own <= F.col("until_id")))
    taken = F.col("whole") + F.coalesce(part, F.lit(False)).cast("long")
    return rows.select(*plain.columns, *levels, "_budget", F.coalesce(taken, F.lit(0)).cast("long").alias("_epochs"))


def oracle(weights: Sequence[Mapping[str, int]], budget_share: tuple[int, int] = (3, 5), epochs: int = 2, seed: int = 7) -> str:
    """The same plan and choice in DuckDB, with whole leaves sorted."""
    def family(depth: int) -> str:
        names = LEVELS[:depth + 1]
        own, kin = names[-1], ", ".join(names[:-1])
        weight = "CASE " + own + "".join(f" WHEN '{k}' THEN {v}" for k, v in weights[depth].items()) + " ELSE 1 END" if weights[depth] else "1"
        source = f"leaf JOIN n{depth - 1} USING ({kin})" if kin else "leaf, root"
        part = f"PARTITION BY {kin} " if kin else ""
        return f"""
    a{depth} AS (SELECT *, CASE WHEN w > 0 THEN cap::DOUBLE / w::DOUBLE ELSE 'inf'::DOUBLE END AS ratio FROM (SELECT {", ".join(names)}, sum(cap) AS cap, {weight} AS w, any_value(total) AS total FROM {source} GROUP BY {", ".join(names)})),
    b{depth} AS (SELECT *, coalesce(sum(cap) OVER (q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone, sum(w) OVER (q ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_w, row_number() OVER q AS place FROM a{depth} WINDOW q AS ({part}ORDER BY ratio, {own})),
    c{depth} AS (SELECT *, cap::HUGEINT * rest_w > w::HUGEINT * (total - gone) AS short FROM b{depth}),
    d{depth} AS (SELECT *, min(place) FILTER (WHERE short) OVER q AS stop, arg_min(gone, place) FILTER (WHERE short) OVER q AS gone0, arg_min(rest_w, place) FILTER (WHERE short) OVER q AS w0 FROM c{depth} WINDOW q AS ({part})),
    e{depth} AS (SELECT *, coalesce(place >= stop, FALSE) AS open, CASE WHEN NOT coalesce(place >= stop, FALSE) THEN cap WHEN w0 > 0 THEN least(cap, (w::HUGEINT * (total - gone0)) // w0) ELSE 0 END AS b FROM d{depth}),
    f{depth} AS (SELECT *, total - sum(b) OVER ({part}) AS rest, row_number() OVER ({part}ORDER BY CAST(NOT open AS INT), CAST(w = 0 AS INT), {own}) AS turn FROM e{depth}),
    n{depth} AS (SELECT {", ".join(names)}, b + CASE WHEN open AND w > 0 AND turn <= rest AND b < cap THEN 1 ELSE 0 END AS total FROM f{depth})"""

    keys = ", ".join(LEVELS)
    barred = " OR ".join(f"{name} = '{value}'" for name, level in zip(LEVELS, weights) for value, weight in level.items() if weight <= 0) or "FALSE"
    return f"""
    WITH t AS (SELECT doc_id, coalesce(doc_id, -1) AS id, CASE WHEN coalesce(regexp_extract(source, '([0-9]{{1,9}})$', 1), '') = '' THEN 'other' ELSE 'd' || (CAST(regexp_extract(source, '([0-9]{{1,9}})$', 1) AS BIGINT) % 4) END AS domain,
      coalesce(lang, '') AS lang, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\\x09-\\x0D\\x20]+')) AS tok FROM documents),
    leaf AS (SELECT {keys}, sum(tok) AS tokens, CASE WHEN {barred} THEN 0 ELSE sum(tok) * {epochs} END AS cap FROM t GROUP BY {keys}),
    root AS (SELECT least(sum(tokens) * {budget_share[0]} // {budget_share[1]}, sum(cap)) AS total FROM leaf),{",".join(family(d) for d in range(3))},
    got AS (SELECT {keys}, tokens, total AS budget, CASE WHEN tokens > 0 THEN total // tokens ELSE 0 END AS whole FROM leaf JOIN n2 USING ({keys})),
    placed AS (SELECT t.*, got.budget, got.whole, got.budget - got.whole * got.tokens AS rest, CAST('0x' || substr(md5('{seed}|' || CAST(got.whole AS VARCHAR) || '|' || CAST(t.id AS VARCHAR)), 1, 15) AS BIGINT) AS h FROM t JOIN got USING ({keys})),
    grouped AS (SELECT {keys}, rest, h, id, sum(tok) AS s FROM placed GROUP BY ALL),
    running AS (SELECT *, sum(s) OVER (PARTITION BY {keys} ORDER BY h, id) - s AS start FROM grouped),
    until AS (SELECT {keys}, max(ROW(h, id)) AS last FROM running WHERE s > 0 AND start < rest GROUP BY {keys})
    SELECT doc_id, domain, lang, source, CAST(budget AS BIGINT) AS leaf_budget, CAST(whole + CASE WHEN ROW(h, id) <= last THEN 1 ELSE 0 END AS BIGINT) AS epochs
    FROM placed LEFT JOIN until USING ({keys})"""
