"""All text evidence as findings, plus the inspection columns the transforms reuse."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normlake.dims import charclass as cc
from normlake.functions import text as tx
from normlake.functions.rows import to_rows
from normlake.operators import text_inventory as inv

FINDING = inv.FINDING
_GREEK_OR_CYRILLIC = r"[[^\x00-\x{36F}]&&[\p{IsGreek}\p{IsCyrillic}]]"

# --- fixed values: block each review code belongs to -------------------------------------------------
REVIEW_BLOCK = {
    "MALFORMED_UNICODE_REVIEW": "TXT-001",
    "UNSUPPORTED_CONTROL_REVIEW": "TXT-001",
    "BIDI_DISPLAY_REVIEW": "TXT-003",
    "LANGUAGE_SENSITIVE_CONTROL_REVIEW": "TXT-003",
    "MIXED_SCRIPT_CONFUSABLE_REVIEW": "TXT-005",
    "IDENTIFIER_CONFUSABLE_REVIEW": "TXT-005",
    "PUNCTUATION_SEMANTICS_REVIEW": "TXT-006",
    "MATH_AND_RANGE_PUNCTUATION_REVIEW": "TXT-006",
    "LANGUAGE_POLICY_REVIEW": "TXT-008",
    "CODE_REGION_REVIEW": "TXT-009",
    "COMPATIBILITY_NORMALIZATION_REVIEW": "TXT-010",
    "NORMALIZATION_COLLISION_REVIEW": "TXT-010",
    "VIEWPORT_WRAP_REVIEW": "TXT-015",
    "VISIBLE_TEXT_LINK_TARGET_REVIEW": "TXT-016",
}
RETAIN_MEANING = ("CODE_REGION_REVIEW", "MATH_AND_RANGE_PUNCTUATION_REVIEW", "IDENTIFIER_CONFUSABLE_REVIEW")


def _finding(block, category, severity, confidence, start, end, title, risk, review) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v).cast("string")
    return F.struct(
        lit(block).alias("block_id"), lit(category).alias("category"), lit(severity).alias("severity"),
        lit(confidence).alias("confidence"), start.cast("int").alias("scalar_start"), end.cast("int").alias("scalar_end"),
        lit(title).alias("title"), lit(risk).alias("semantic_risk"), lit(review).alias("review_code"),
    )


def _gated(review: Column, plain, gated) -> Column:
    return F.when(review.isNull(), F.lit(plain)).otherwise(F.lit(gated))


def evidence(
    sources: DataFrame, compatibility_only: bool, facts: dict[str, Column] | None = None, placed: dict[str, Column] | None = None, then: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Adds spans, segments, changed clusters, mixed tokens and controls; row-local throughout.

    Two Arrow steps make them: what the text alone gives, with the caller's ``facts``, of which ``then`` makes what it
    needs, and what is looked up in the merged spans, with the caller's ``placed``.
    """
    text = F.col("text")
    foreign = text.rlike(r"[^\x00-\x{24F}\p{IsLatin}\p{IsCommon}\p{IsInherited}]")
    staged = inv.with_text_facts(
        sources, norm_hits=inv.norm_array(text, compatibility_only), _hits=inv.word_array(text, foreign), controls=inv.control_array(text), **(facts or {}))
    staged = inv.with_spans(staged if then is None else then(staged))
    staged = inv.with_segments(staged, _ends=inv.ends_in_spans(inv.starts_of("_hits")), **(placed or {}))
    staged = inv.with_tokens(staged, "_tokens")
    return staged.withColumn("mixed_tokens", F.filter("_tokens", lambda t: t["mixed"])).drop("_tokens")


def inspect(sources: DataFrame, allowed_scripts: tuple[str, ...] = (), allowed_languages: tuple[str, ...] = ()) -> DataFrame:
    """Evidence columns plus ``findings`` and the review codes among them."""
    text, shaping = F.col("text"), F.lit(any(s in cc.SHAPING_SCRIPTS for s in allowed_scripts))
    staged = evidence(sources, compatibility_only=False, facts={
        "_invisibles": inv.invisible_array(text, shaping), "_spaces": inv.whitespace_array(text, regular=False),
        "_variants": tx.char_hits(text, tx.wide(cc.char_class(cc.PUNCTUATION_VARIANT_RANGES))),
    }, placed={"_math_ends": inv.ends_in_spans(F.transform("_variants", lambda h: h["at"]), "MATHEMATICS")})
    staged = staged.withColumn(
        "findings", _finding_array(text, bool(allowed_scripts or allowed_languages))
    ).drop("_invisibles", "_spaces", "_variants", "_math_ends")
    codes = F.array_distinct(F.filter(F.transform("findings", lambda f: f["review_code"]), lambda c: c.isNotNull()))
    return staged.withColumn("review_codes", codes)


def with_review_codes(sources: DataFrame, allowed_scripts: tuple[str, ...] = (), allowed_languages: tuple[str, ...] = (),
                      then: Callable[[DataFrame], DataFrame] | None = None, **facts: Column) -> DataFrame:
    """Evidence columns plus ``review_codes`` by whole-text tests: the codes ``inspect`` finds, without
    building a record per finding. The transforms need no more than this, and what they make of ``facts`` (:func:`evidence`)."""
    staged = evidence(sources, compatibility_only=True, facts=facts, then=then)
    text, kind = F.col("text"), F.col("source_kind")
    joiners = r"[\x{200C}\x{200D}]"
    beside = f"(?:(?<={cc.EMOJI_BEFORE}{joiners})|(?={cc.EMOJI_SEARCHED}))"
    sensitive = text.rlike(f"{tx.wide(cc.char_class(cc.VARIATION_RANGES))}|{joiners}{beside}")
    if any(s in cc.SHAPING_SCRIPTS for s in allowed_scripts):
        sensitive = sensitive | text.rlike(joiners)
    letters = r"[\p{L}\p{Nd}]"
    compat = F.exists(
        "norm_hits",
        lambda h: h["f"]["value"].rlike(letters)
        & (((h["f"]["nfkc"] != h["f"]["value"]) & (h["f"]["nfc"] == h["f"]["value"]))
           | ((h["f"]["nfkd"] != h["f"]["value"]) & (h["f"]["nfd"] == h["f"]["value"]))),
    )
    in_math = lambda g: F.coalesce(g["kind"] == "MATHEMATICS", F.lit(False))
    variant, dash = (tx.wide(cc.char_class(r)) for r in (cc.PUNCTUATION_VARIANT_RANGES, cc.DASH_RANGES))
    has_mixed = F.size("mixed_tokens") > 0
    policy_given = bool(allowed_scripts or allowed_languages)
    tests = {
        "MALFORMED_UNICODE_REVIEW": ~F.is_valid_utf8(text),
        "UNSUPPORTED_CONTROL_REVIEW": F.size("controls") > 0,
        "BIDI_DISPLAY_REVIEW": text.rlike(tx.wide(cc.char_class(cc.BIDI_RANGES))),
        "LANGUAGE_SENSITIVE_CONTROL_REVIEW": text.rlike(tx.wide(cc.INVISIBLE)) & sensitive,
        "MIXED_SCRIPT_CONFUSABLE_REVIEW": has_mixed & (kind != "IDENTIFIER"),
        "IDENTIFIER_CONFUSABLE_REVIEW": has_mixed & (kind == "IDENTIFIER"),
        "PUNCTUATION_SEMANTICS_REVIEW": text.rlike(dash) & F.exists("segments", lambda g: ~in_math(g) & g["value"].rlike(dash)),
        "MATH_AND_RANGE_PUNCTUATION_REVIEW": text.contains("\u2212")
        | (text.rlike(variant) & F.exists("segments", lambda g: in_math(g) & g["value"].rlike(variant))),
        "LANGUAGE_POLICY_REVIEW": F.lit(not policy_given) & ~has_mixed & text.rlike(_GREEK_OR_CYRILLIC) & text.rlike(r"\p{IsLatin}"),
        "CODE_REGION_REVIEW": kind == "CODE_BLOCK",
        "COMPATIBILITY_NORMALIZATION_REVIEW": compat,
        "VIEWPORT_WRAP_REVIEW": F.size("wrap_offsets") > 0,
        "VISIBLE_TEXT_LINK_TARGET_REVIEW": F.col("hidden_alt") | (kind == "HTML_CLIPBOARD"),
    }
    codes = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(code)) for code, test in tests.items()]))
    return staged.withColumn("review_codes", codes)


def _delta_array() -> Column:
    """TXT-002 over ``norm_hits``."""

    def delta(hit: Column, form: str) -> Column:
        forms = hit["f"]
        before, after = forms["value"], forms[form.lower()]
        base = {"NFKC": "nfc", "NFKD": "nfd"}.get(form)
        compat = (forms[base] == before) if base else F.lit(False)
        review = F.when(compat & before.rlike(r"[\p{L}\p{Nd}]"), F.lit("COMPATIBILITY_NORMALIZATION_REVIEW"))
        made = _finding(
            "TXT-002", "UNICODE", _gated(review, "LOW", "MEDIUM"), "CERTAIN_BY_PARSER", hit["start"], hit["end"],
            F.when(compat, F.lit("COMPATIBILITY_NORMALIZATION_DELTA")).otherwise(F.lit("CANONICAL_NORMALIZATION_DELTA")),
            _gated(review, "NONE", "POSSIBLE_MEANING_CHANGE"), review,
        )
        return F.when(after != before, made)

    return F.coalesce(
        F.filter(
            F.flatten(F.transform("norm_hits", lambda h: F.array(*[delta(h, form) for form in inv._FORMS]))),
            lambda f: f.isNotNull(),
        ).cast(FINDING),
        F.array().cast(FINDING),
    )


def _finding_array(text: Column, policy_given: bool) -> Column:
    empty = F.array().cast(FINDING)
    n = F.length(text)
    kind = F.col("source_kind")

    malformed = F.when(
        ~F.is_valid_utf8(text),
        F.array(_finding("TXT-001", "UNICODE", "HIGH", "CERTAIN_BY_PARSER", F.lit(0), n, "MALFORMED_UTF", "HIGH_IMPACT", "MALFORMED_UNICODE_REVIEW")),
    ).otherwise(empty)
    controls = F.transform(
        "controls",
        lambda r: _finding("TXT-001", "UNICODE", "HIGH", "CERTAIN_BY_PARSER", r["scalar_idx"], r["scalar_idx"] + 1,
                           "UNSUPPORTED_CANONICAL_CONTROL", "HIGH_IMPACT", "UNSUPPORTED_CONTROL_REVIEW"),
    )

    deltas = _delta_array()

    def invisible(r: Column) -> Column:
        review = F.when(r["bidi"], F.lit("BIDI_DISPLAY_REVIEW")).when(
            r["language_sensitive"], F.lit("LANGUAGE_SENSITIVE_CONTROL_REVIEW")
        )
        return _finding("TXT-003", "UNICODE", _gated(review, "LOW", "HIGH"), "CERTAIN_BY_PARSER", r["scalar_idx"],
                        r["scalar_idx"] + 1, "DEFAULT_IGNORABLE_OR_CONTROL",
                        _gated(review, "NONE", "POSSIBLE_MEANING_CHANGE"), review)

    invisibles = F.transform("_invisibles", invisible)
    spaces = F.transform(
        F.filter(
            "_spaces",
            lambda r: (r["cp"] != 32) | r["line_terminator"] | r["leading"] | r["trailing"] | r["repeated"],
        ),
        lambda r: _finding("TXT-004", "UNICODE", "LOW", "CERTAIN_BY_PARSER", r["scalar_idx"], r["scalar_idx"] + 1,
                           "NON_CANONICAL_WHITESPACE", "NONE", None),
    )
    token_code = F.when(kind == "IDENTIFIER", F.lit("IDENTIFIER_CONFUSABLE_REVIEW")).otherwise(
        F.lit("MIXED_SCRIPT_CONFUSABLE_REVIEW")
    )
    mixed = F.transform(
        "mixed_tokens",
        lambda t: _finding("TXT-005", "CONFUSABLE", "HIGH", "STRONG_HEURISTIC", t["start"], t["end"],
                           "MIXED_SCRIPT_TOKEN", "HIGH_IMPACT", token_code),
    )

    def punctuation(at: Column, math_end: Column) -> Column:
        cp = tx.code_point(at["c"])
        review = F.when((cp == 0x2212) | (math_end > 0), F.lit("MATH_AND_RANGE_PUNCTUATION_REVIEW")).when(
            cp.between(0x2010, 0x2015), F.lit("PUNCTUATION_SEMANTICS_REVIEW")
        )
        return _finding("TXT-006", "PUNCTUATION", _gated(review, "LOW", "MEDIUM"), "CERTAIN_BY_PARSER",
                        at["at"], at["at"] + 1, "PUNCTUATION_VARIANT",
                        _gated(review, "NONE", "POSSIBLE_MEANING_CHANGE"), review)

    variants = F.zip_with("_variants", "_math_ends", punctuation)
    wraps = F.transform(
        "wrap_offsets",
        lambda w: _finding("TXT-007", "LAYOUT", "MEDIUM", "WEAK_HEURISTIC", w, w + 1, "POSSIBLE_VIEWPORT_WRAP",
                           "POSSIBLE_MEANING_CHANGE", "VIEWPORT_WRAP_REVIEW"),
    )

    def whole(block, category, severity, confidence, title, risk, review) -> Column:
        return F.array(_finding(block, category, severity, confidence, F.lit(0), n, title, risk, review)).cast(FINDING)

    language = empty
    if not policy_given:
        language = F.when(
            (F.size("mixed_tokens") == 0) & text.rlike(_GREEK_OR_CYRILLIC) & text.rlike(r"\p{IsLatin}"),
            whole("TXT-008", "SEMANTIC", "MEDIUM", "WEAK_HEURISTIC", "MULTILINGUAL_POLICY_UNRESOLVED",
                  "POSSIBLE_MEANING_CHANGE", "LANGUAGE_POLICY_REVIEW"),
        ).otherwise(empty)
    code = F.when(
        kind == "CODE_BLOCK",
        whole("TXT-009", "SEMANTIC", "MEDIUM", "CERTAIN_BY_PARSER", "CODE_REGION_LOCKED", "HIGH_IMPACT", "CODE_REGION_REVIEW"),
    ).otherwise(empty)
    rich = (
        F.when(
            F.col("hidden_alt") | (kind == "HTML_CLIPBOARD"),
            whole("TXT-016", "SEMANTIC", "HIGH", "CERTAIN_BY_PARSER", "RICH_ALTERNATIVE_DISCARDED",
                  "POSSIBLE_MEANING_CHANGE", "VISIBLE_TEXT_LINK_TARGET_REVIEW"),
        )
        .when(
            F.col("rich") | (kind == "STYLED_TEXT"),
            whole("TXT-016", "SEMANTIC", "LOW", "CERTAIN_BY_PARSER", "RICH_REPRESENTATION_DISCARDED", "NONE", None),
        )
        .otherwise(empty)
    )
    parts = [malformed, controls, deltas, invisibles, spaces, mixed, variants, wraps, language, code, rich]
    return F.concat(*[p.cast(FINDING) for p in parts])


def _with_status(rows: DataFrame) -> DataFrame:
    gated = F.col("review_code").isNotNull()
    status = F.when(gated, F.lit("REVIEW_REQUIRED")).otherwise(F.lit("DETECTED"))
    return rows.select("*", gated.alias("requires_decision"), status.alias("status"))


def explode_findings(inspected: DataFrame, prefix: str = "text") -> DataFrame:
    rows = to_rows(inspected, ["source_id"], F.col("findings"), "i")
    return _with_status(rows.select(
        "source_id",
        F.concat(F.lit(f"{prefix}-f-"), F.col("i")).alias("finding_id"),
        *[c for c in rows.columns if c not in ("source_id", "i")],
    ))


def text_findings(sources: DataFrame, allowed_scripts: tuple[str, ...] = ()) -> DataFrame:
    """One row per evidence item; ids number the findings inside their source."""
    return explode_findings(inspect(sources, allowed_scripts))


def normalization_findings(sources: DataFrame) -> DataFrame:
    """The TXT-002 rows of T12 from the normal forms alone, without the ids, which number all findings of a source."""
    return _with_status(to_rows(inv.with_normal_forms(sources), ["source_id"], _delta_array()))
