"""Queries whose time or memory grew faster than their input: the work each does, and that its rows stay the same."""

import random
import re

from pyspark.sql import functions as F

from normlake.dims import charclass as cc
from normlake.operators import lookalikes, review, text_findings, text_inventory, urls, verification


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_normal_form_findings_need_the_forms_only(spark):
    rows = [(1, "éa ﬁx é ①"), (2, "plain"), (3, None), (4, ""), (5, "Å\U0001d400가 Å"), (6, "﷐é")]
    src = spark.createDataFrame(rows, "source_id int, text string").withColumn("source_kind", F.lit("PLAIN_TEXT"))
    own = text_findings.normalization_findings(src)
    whole = text_findings.text_findings(src).where("block_id = 'TXT-002'").select(*own.columns)
    assert sorted(map(str, own.collect())) == sorted(map(str, whole.collect()))
    assert {r.source_id for r in own.collect()} == {1, 5, 6}
    assert plan(own).count("ArrowEvalPython") == 1


def test_look_alikes_are_drawn_from_each_word_once(spark):
    texts = [(1, "rnodern modern modern"), (1, "modern paypal"), (2, "pаypal it's a.b"), (3, None), (4, ""), (None, "\U00010400x m")]
    src = spark.createDataFrame(texts, "source_id int, text string").withColumn("source_kind", F.lit("PLAIN_TEXT"))
    shapes = spark.createDataFrame([("m", "rn"), ("а", "a"), ("\U00010400", "O"), ("xy", "z"), (None, "q"), ("a", None)], "char string, prototype string")
    held = text_inventory.word_holders(src)
    assert "EvalPython" not in plan(held)
    tokens = text_inventory.token_security(src)
    want = tokens.select("source_id", "token").distinct().groupBy("token").agg(F.count("*").alias("sources"))
    assert sorted(map(tuple, held.collect())) == sorted(map(tuple, want.collect()))
    got = {r.token: tuple(r)[1:] for r in lookalikes.look_alikes(held, shapes).collect()}
    assert got == {"modern": ("rnodern", "modern", 1, 2), "rnodern": ("rnodern", "modern", 1, 2), "paypal": ("paypal", "paypal", 1, 2), "pаypal": ("paypal", "paypal", 1, 2)}
    drawn = {r.token: r.skeleton for r in lookalikes.skeletons(held, shapes).collect()}
    assert drawn["\U00010400x"] == "Ox" and drawn["it's"] == "it's"


def test_hosts_are_searched_with_the_same_matches():
    rng = random.Random(5)
    parts = ["a", "ab-", "-", ".", "..", "com", "x1", "@", " ", "/p(", ":80", "a" * 63, "b" * 64, "é", "9."]
    as_python = lambda p: re.compile(p.replace(r"{0,62}+", r"{0,62}"))  # no difference inside a look-ahead to a dot
    searched = as_python(urls._SCHEMELESS)
    assert searched.pattern != cc.SCHEMELESS
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 14)))
        assert [m.span() for m in searched.finditer(text)] == [m.span() for m in re.finditer(cc.SCHEMELESS, text)]


def test_hosts_of_many_labels_are_still_counted(spark):
    texts = [(1, "see " + "a." * 4000 + "com/x."), (2, "x." * 48 + "org"), (3, "x." * 47 + "org and docs.example.net/help/1!")]
    src = spark.createDataFrame(texts, "source_id int, text string")
    got = {(r.source_id, r.target) for r in urls.extract_schemeless(src).collect()}
    assert got == {(1, "a." * 4000 + "com/x"), (2, "x." * 48 + "org"), (3, "x." * 47 + "org"), (3, "docs.example.net/help/1")}


def test_rewriting_looks_parts_up_without_sorting_texts(spark):
    src = spark.createDataFrame([(1, "\U0001f600 see A and B."), (2, "none"), (3, "A"), (4, "AB")], "source_id int, text string")
    at = [(1, "t0", 6, 7), (1, "t1", 12, 13), (3, "t0", 0, 1), (4, "t0", 0, 2), (4, "t1", 1, 2)]
    cands = spark.createDataFrame([(*a, "ABSOLUTE", "x") for a in at], "source_id int, token_id string, start int, end int, kind string, display string")
    tokens = spark.createDataFrame([(1, "t0", "first"), (1, "t1", "second"), (4, "t0", "x"), (4, "t1", "y")], "source_id int, token_id string, final_text string")
    out = urls.rewrite_urls(src, cands, tokens)
    assert {r.source_id: (r.text, r.error) for r in out.collect()} == {
        1: ("\U0001f600 see first and second.", None), 2: ("none", None), 3: (None, None), 4: (None, "OVERLAPPING_URL_CANDIDATES")}
    # Bytes that are no text are spliced in the JVM as before.
    odd = src.where("source_id = 1").withColumn("text", F.expr("cast(concat(cast(text as binary), X'ff') as string)"))
    assert urls.rewrite_urls(odd, cands, tokens).select(F.hex("text").alias("h")).first().h == ("\U0001f600 see first and second.".encode() + b"\xff").hex().upper()
    last = plan(out)[: plan(out).find("Exchange")]
    assert "ShuffledHashJoin" in last and "SortMergeJoin" not in last


def test_manifest_neighbours_meet_across_stretches(spark):
    rng = random.Random(7)
    rows = [(1, i, i) for i in range(2100)] + [(2, i, i) for i in range(1024)] + [(2, 1024, 5)] + [(3, i, 1) for i in (0, 0, 2)] + [(4, None, 1), (4, None, 0)]
    rows += [(5, -1, 9), (5, 0, 9), (6, 0, None), (6, 1, 0), (7, 0, 3), (7, 1, None), (7, 1, 4)]
    rows += [(run, rng.randrange(1020, 1030), rng.randrange(40)) for run in range(10, 40) for _ in range(rng.randrange(1, 6))]
    got = {r.run_id: (r.n, r.low, r.high, r.top, r.twice, bool(r.falling))
           for r in verification._manifest_shape(spark.createDataFrame(rows, "run_id int, seq int, execution_revision long").repartition(5)).collect()}
    for run in {r[0] for r in rows}:
        own = [r[1:] for r in rows if r[0] == run]
        seqs, revs = [s for s, _ in own if s is not None], [v for _, v in own if v is not None]
        falling = any(a[0] is not None and b[0] == a[0] + 1 and None not in (a[1], b[1]) and a[1] >= b[1] for a in own for b in own) if len(own) < 1500 else False
        want = (len(own), min(seqs, default=None), max(seqs, default=None), max(revs), len({s for s, _ in own}) < len(own), falling)
        assert got[run] == want, run


def test_document_references_are_counted_and_not_joined(spark):
    make = lambda rows, kind: spark.createDataFrame(rows, kind)
    blocks = make([(1, "a", "u", "r"), (1, "a", None, None), (2, "b", "u", None), (None, "c", "u", None), (3, "d", None, "r")], "doc_id int, block_id string, url_token_id string, region_id string")
    order = make([(1, 0, "a"), (2, 0, "b"), (2, 1, "b"), (3, 0, "x")], "doc_id int, ordinal int, block_id string")
    tokens = make([(1, "u"), (None, "u"), (4, None), (4, None)], "doc_id int, token_id string")
    regions = make([(1, "r", "k"), (1, "r", None), (3, "s", "k")], "doc_id int, region_id string, decision_id string")
    out = review.document_integrity(blocks, order, tokens, regions, make([(3, "k"), (3, "k")], "doc_id int, decision_id string"))
    assert {tuple(r) for r in out.collect()} == {
        (1, "DUPLICATE_BLOCK_ID"), (2, "DUPLICATE_READING_ORDER_ENTRY"), (3, "READING_ORDER_BLOCK_SET_MISMATCH"), (None, "READING_ORDER_BLOCK_SET_MISMATCH"),
        (2, "URL_TOKEN_REFERENCE_MISSING"), (None, "URL_TOKEN_REFERENCE_MISSING"), (4, "DUPLICATE_URL_TOKEN"),
        (1, "DUPLICATE_REGION_ID"), (3, "REGION_REFERENCE_MISSING"), (1, "DECISION_REFERENCE_MISSING")}
    assert "Join" not in plan(out)
