"""Text rules on small literal inputs."""

import unicodedata

from pyspark.sql import functions as F

from normlake.operators import text_findings as fnd
from normlake.operators import text_inventory as inv
from normlake.operators import text_transform as tt
from normlake.operators import verification as v

ROWS = [
    ("code", "prefix `a  −  b` user_раypal suffix"),
    ("dash", "wait—now"),
    ("ctrl", "private\u0000canary"),
    ("emoji", "A😀e\u0301"),
    ("lines", "  1. Café\r\n\r\nnext"),
    ("mixed", "раypal fi ﬁ"),
    ("bidi", "a‮b ‍7 x️"),
    ("empty", ""),
]


def frame(spark):
    return spark.createDataFrame(ROWS, "source_id string, text string")


def rows(df, *keys):
    return [tuple(r) for r in df.orderBy(*keys).collect()]


def test_scalars_and_graphemes(spark):
    src = frame(spark).where("source_id = 'emoji'")
    scalars = inv.scalar_inventory(src).orderBy("scalar_idx").collect()
    assert [(r.utf16_start, r.utf16_end, r.cp) for r in scalars] == [(0, 1, 65), (1, 3, 0x1F600), (3, 4, 0x65), (4, 5, 0x301)]
    assert inv.grapheme_inventory(src).count() == 3


def test_line_structure(spark):
    got = rows(inv.line_structure(frame(spark).where("source_id = 'lines'")).select("line_idx", "indentation", "blank", "list_marker"), "line_idx")
    assert got == [(0, 2, False, "  1."), (1, 0, True, None), (2, 0, False, None)]


def test_normalization_deltas_match_unicodedata(spark):
    got = {(r.source_id, r.scalar_start, r.form, r.after) for r in inv.normalization_deltas(frame(spark)).collect()}
    want = {
        ("mixed", 10, form, unicodedata.normalize(form, "ﬁ")) for form in ("NFKC", "NFKD")
    }
    assert want <= got
    assert all(a != "" for _, _, _, a in got)


def test_protected_spans_survive_even_with_replacements(spark):
    src = frame(spark).where("source_id = 'code'")
    ap = spark.createDataFrame(
        [("code", list(fnd.REVIEW_BLOCK), {"user_раypal": "user_paypal"})],
        "source_id string, approved_codes array<string>, replacements map<string,string>")
    out = tt.canonicalize_text(src, ap).canonical().collect()[0]
    assert "`a  −  b`" in out.text and "user_раypal" in out.text


def test_dash_is_proposed_but_not_applied(spark):
    c = tt.canonicalize_text(frame(spark).where("source_id = 'dash'"))
    p = c.proposals().collect()
    assert [(r.block_id, r.applied, r.review_code) for r in p] == [("TXT-014", False, "PUNCTUATION_SEMANTICS_REVIEW")]
    assert [(r.text, r.locked) for r in c.canonical().collect()] == [("wait—now", False)]


def test_control_fails_without_echo(spark):
    failures = inv.text_failures(frame(spark)).collect()
    assert [(r.source_id, r.code, r.scalar_idx) for r in failures] == [("ctrl", "UNSUPPORTED_SCALAR", 7)]
    assert "canary" not in str(failures)


def test_flag_codes_equal_finding_codes(spark):
    a = {r.source_id: set(r.review_codes) for r in fnd.inspect(frame(spark)).select("source_id", "review_codes").collect()}
    b = {r.source_id: set(r.review_codes) for r in fnd.with_review_codes(frame(spark)).select("source_id", "review_codes").collect()}
    assert a == b


def test_collisions(spark):
    got = tt.normalization_collisions(frame(spark)).collect()
    assert [(r.source_id, r.normal_form, sorted(r.originals)) for r in got] == [("mixed", "fi", ["fi", "ﬁ"])]


def test_merge_of_overlapping_spans_by_brute_force(spark):
    spans = [(0, 5, "A", False), (3, 4, "B", True), (5, 8, "C", False), (7, 12, "USER_LOCKED", False), (11, 13, "D", True), (20, 21, "E", False)]
    src = spark.createDataFrame([("x", " " * 30, spans)], f"source_id string, text string, explicit_spans {inv.SPAN}")
    got = rows(inv.merge_spans(src).select("start", "end", "kind", "locked"), "start")
    assert got == [(0, 5, "B", True), (5, 13, "USER_LOCKED", True), (20, 21, "E", False)]


def test_newline_round_trip(spark):
    src = spark.createDataFrame([("a", "x\ny"), ("b", "x\r\ny")], "source_id string, text string")
    out = tt.serialize_newlines(src, "CRLF")
    back = {r.source_id: r.text for r in tt.reparse_newlines(out, "CRLF").collect()}
    assert back["a"] == "x\ny"
    assert {r.source_id: r.error for r in out.collect()}["b"] == "SERIALIZER_SCALAR_MISMATCH"


def test_second_pass_changes_nothing(spark):
    src = spark.createDataFrame([("a", "  “Café” —  x y… "), ("b", "plain")], "source_id string, text string").withColumn("source_kind", F.lit("PLAIN_TEXT"))
    assert {r.status for r in v.idempotence_audit(src).collect()} == {"PASS"}


def test_applied_changes_are_numbered_per_source(spark):
    rows = [("a", "x  y \u00a0 `code`  z\u2026"), ("b", "plain"), ("c", "e\u0301  and `k` \u2026")]
    src = spark.createDataFrame(rows, "source_id string, text string").withColumn("source_kind", F.lit("PLAIN_TEXT"))
    ids = {}
    for r in tt.canonicalize_text(src, form="NFC").ledger().collect():
        ids.setdefault(r.source_id, []).append((int(r.change_id.removeprefix("text-c-")), r.block_id))
    assert set(ids) == {"a", "c"}
    order = ["TXT-016", "TXT-015", "TXT-010", "TXT-011", "TXT-012", "TXT-013", "TXT-014"]
    for made in ids.values():
        made.sort()
        assert [n for n, _ in made] == list(range(len(made)))
        assert [order.index(b) for _, b in made] == sorted(order.index(b) for _, b in made)


def test_positions_are_counted_without_the_texts_characters_as_rows_or_arrays(spark):
    src = spark.createDataFrame([("a", " x  y — z \n"), ("b", "A\U0001F600é\r\n"), ("c", ""), ("d", None)], "source_id string, text string")
    spaces = [tuple(r) for r in inv.whitespace_inventory(src).orderBy("source_id", "scalar_idx").select("source_id", "scalar_idx", "leading", "trailing", "repeated").collect()]
    assert spaces == [("a", 0, True, False, False), ("a", 2, False, False, False), ("a", 3, False, False, True), ("a", 5, False, False, False),
                      ("a", 7, False, False, False), ("a", 9, False, True, False), ("a", 10, False, True, False), ("b", 4, False, True, False), ("b", 5, True, True, False)]
    graphemes = inv.grapheme_inventory(src)
    assert [tuple(r)[1:] for r in graphemes.where("source_id = 'b'").orderBy("cluster_idx").collect()] == [(0, 0, 1, 0, 1), (1, 1, 2, 1, 3), (2, 2, 4, 3, 5), (3, 4, 6, 5, 7)]
    for made in (graphemes, inv.whitespace_inventory(src)):
        assert "split(" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_large_classes_are_searched_and_hold_the_same_characters(spark):
    import re

    from normlake.dims import charclass as cc
    from normlake.functions import text as tx

    made = [cc.EMOJI_SEARCHED, *(tx._risky_class(form) for form in ("NFC", "NFD", "NFKC", "NFKD")), tx.compatibility_class()]
    # No set of brackets tries more than four ranges one after the other.
    assert all(len(part) <= 4 for c in made for part in (re.findall(r"\\x\{\w+\}-\\x\{\w+\}", inner) for inner in re.findall(r"\[([^\[\]&]*)\]", c)))
    points = spark.range(0x20000).where("id NOT BETWEEN 55296 AND 57343").select(F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    assert points.where(F.col("c").rlike(cc.EMOJI) != F.col("c").rlike(cc.EMOJI_SEARCHED)).count() == 0
    kept = spark.createDataFrame([("a\u200db",), ("\U0001f468\u200db",), ("b\u200d\U0001f468",), ("\u200d",), ("x\u00ad\u200d7",)], "t string")
    assert [r[0] for r in kept.select(tt.drop_ignorables(F.col("t"))).collect()] == ["ab", "\U0001f468\u200db", "b\u200d\U0001f468", "", "x\u200d7"]
