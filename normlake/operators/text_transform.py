"""Text transforms.

Order: wraps, normal form, ignorables, look-alikes, white space, punctuation. Each acts on free segments
only. A source's segments stay an array in its row for the whole chain, so the job is one narrow stage
(plus the join that brings in approvals); tables of segments, proposals and ledger rows are exploded from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normlake.dims import charclass as cc
from normlake.functions import text as tx
from normlake.functions.rows import keep_rows, settled, to_rows
from normlake.operators import text_findings as fnd
from normlake.operators import text_inventory as inv

_URL_JOIN = ("/", "?", "&", "=", "#", "-", "_", ".")
_IGNORABLE_BUT_JOINER = "[" + cc.class_body(cc.DEFAULT_IGNORABLE_RANGES) + r"\p{Cf}&&[^\x{200D}]]"
_ANY_IGNORABLE = "[" + cc.class_body(cc.DEFAULT_IGNORABLE_RANGES) + r"\p{Cf}]"
_GAP = "\ufdd0"


# ------------------------------------------------------------------------------------ column functions
def drop_wraps(value: Column, start: Column, approved: Column) -> Column:
    """Drop approved line feeds; a space replaces one unless a neighbour is missing or joins URLs."""

    def rebuild(r: Column) -> Column:
        lines, last = r["lines"], F.size(r["lines"]) - 1

        def one(line: Column, k: Column) -> Column:
            above = F.get(lines, k - 1)
            # The neighbour of a line feed is a character of its line or another line feed; the text's ends have none.
            missing = ((k == 1) & (above == "")) | ((k == last) & (line == ""))
            spaced = ~missing & ~F.right(above, F.lit(1)).isin(*_URL_JOIN) & ~F.left(line, F.lit(1)).isin(*_URL_JOIN)
            mark = F.when(~F.get(r["wraps"], k - 1), F.lit("\n")).when(spaced, F.lit(" ")).otherwise(F.lit(""))
            return F.when(k == 0, line).otherwise(F.concat(mark, line))

        return F.array_join(F.transform(lines, one), "")

    feeds = F.array_compact(F.transform(tx.chars(value), lambda c, i: F.when(c == "\n", start + i)))
    parts = F.struct(F.split(value, "\n", -1).alias("lines"), tx.among(feeds, approved).alias("wraps"))
    return F.when(value.contains("\n"), tx.let(parts, rebuild)).otherwise(value)


def drop_ignorables(value: Column, keep_emoji_joiners: bool = True) -> Column:
    """Remove ignorable and Format characters; a joiner next to an emoji-property character stays."""
    if not keep_emoji_joiners:
        return F.regexp_replace(value, tx.wide(_ANY_IGNORABLE), "")
    # The joiner comes first, so that its neighbours are looked at behind one only.
    pattern = tx.wide(_IGNORABLE_BUT_JOINER) + rf"|\x{{200D}}(?<!{cc.EMOJI_BEFORE}\x{{200D}})(?!{cc.EMOJI_SEARCHED})"
    return F.when(value.rlike(tx.wide(_ANY_IGNORABLE)), F.regexp_replace(value, pattern, "")).otherwise(value)


def swap_tokens(value: Column, replacements: Column) -> Column:
    """Whole-token replacement from the reviewer's map."""
    parts = F.split(F.regexp_replace(F.translate(value, _GAP, "�"), cc.WORD, f"{_GAP}$0{_GAP}"), _GAP)
    swapped = F.transform(parts, lambda p: F.coalesce(F.element_at(replacements, p), p))
    return F.when(F.size(replacements) > 0, F.array_join(swapped, "")).otherwise(value)


def clean_spaces(value: Column, profile: str, content_before: Column, content_after: Column) -> Column:
    """One line feed for every terminator, single spaces, none at line ends; edges follow neighbours."""
    if profile == "CODE":
        return value
    out = F.regexp_replace(value, r"\r\n|[\r\x{85}\x{2028}\x{2029}]", "\n")
    out = F.regexp_replace(out, r"[[^!-~\n]&&[" + cc.class_body(cc.WHITESPACE_RANGES) + "]]+", " ")
    out = F.regexp_replace(out, " ?\n ?", "\n")
    def edges(text: Column) -> Column:
        lead = F.when(text.startswith(" ") & ~content_before, F.lit(2)).otherwise(F.lit(1))
        kept = F.length(text) - lead + F.when(text.endswith(" ") & ~content_after, F.lit(0)).otherwise(F.lit(1))
        alone = F.when(content_after, F.lit(" ")).otherwise(F.lit(""))
        return F.when(text == " ", alone).otherwise(F.substr(text, lead, kept))

    return tx.let(out, edges)


def plain_punctuation(value: Column, profile: str, dashes: Column) -> Column:
    """Plain quotes and ellipsis; dash variants become `` - `` only behind the dash gate."""
    if profile == "PRESERVE_LANGUAGE":
        return value
    out = F.translate(value, "«»“”„‟‘’‚‛", "\"\"\"\"\"\"''''")
    out = F.replace(out, F.lit("…"), F.lit("..."))
    spaced = F.regexp_replace(out, " *" + cc.char_class(cc.DASH_RANGES) + " *", _GAP)
    spaced = F.replace(F.regexp_replace(spaced, f"{_GAP}(?!{_GAP})", " - "), F.lit(_GAP), F.lit(" -"))
    return F.when(dashes, spaced).otherwise(out)


# ---------------------------------------------------------------------------------------- N01 - N08
def segment(sources: DataFrame) -> DataFrame:
    """Free and protected segments, with the facts about neighbours that later steps need."""
    staged = inv.with_segments(inv.with_spans(sources))

    def facts(segs: Column) -> Column:
        return F.transform(
            segs,
            lambda g, i: F.struct(
                i.cast("int").alias("seg_idx"), g["start"].alias("start"), g["value"].alias("value"), g["protected"].alias("protected"),
                _ends_content(F.get(segs, i - 1)["value"]).alias("content_before"),
                _starts_content(F.get(segs, i + 1)["value"]).alias("content_after"),
            ),
        )

    return to_rows(staged, ["source_id"], facts(F.col("segments")))


def _ends_content(value: Column) -> Column:
    return F.coalesce((F.length(value) > 0) & ~value.endswith("\n"), F.lit(False))


def _starts_content(value: Column) -> Column:
    return F.coalesce((F.length(value) > 0) & ~value.startswith("\n"), F.lit(False))


def _step(segments: DataFrame, after: Column, review: str | None = None) -> DataFrame:
    changed = F.when(F.col("protected"), F.col("value")).otherwise(after)
    return segments.select(
        "source_id", "seg_idx", F.col("value").alias("before"), changed.alias("after"),
        (changed != F.col("value")).alias("changed"), F.lit(review).cast("string").alias("review_code"),
    )


def remove_wraps(segments: DataFrame, approvals: DataFrame) -> DataFrame:
    """N02 over a segments table; approvals(source_id, wrap_offsets)."""
    joined = segments.join(approvals.select("source_id", F.col("wrap_offsets").alias("_w")), "source_id", "left")
    none = F.array().cast("array<int>")
    return _step(joined, drop_wraps(F.col("value"), F.col("start"), F.coalesce("_w", none)), "VIEWPORT_WRAP_REVIEW")


def normalize_text(segments: DataFrame, form: str = "NFKC") -> DataFrame:
    """A normal form on the runs between white space; the spaces stay as they are."""
    risky = F.when(~F.col("protected") & tx.needs_normalizing(F.col("value"), form), F.array("value"))
    fixed = segments.withColumn("_n", tx.normalize_all(risky, form, keep_spaces=True))
    return _step(fixed, F.coalesce(F.get("_n", F.lit(0)), F.col("value")))


def remove_ignorables(segments: DataFrame, keep_emoji_joiners: bool = True) -> DataFrame:
    return _step(segments, drop_ignorables(F.col("value"), keep_emoji_joiners))


def replace_confusables(segments: DataFrame, approvals: DataFrame) -> DataFrame:
    """N05 over a segments table; approvals(source_id, replacements MAP)."""
    joined = segments.join(approvals.select("source_id", "replacements"), "source_id", "left")
    none = F.create_map().cast("map<string,string>")
    return _step(joined, swap_tokens(F.col("value"), F.coalesce("replacements", none)), "MIXED_SCRIPT_CONFUSABLE_REVIEW")


def canonicalize_whitespace(segments: DataFrame, profile: str = "DOCUMENT") -> DataFrame:
    return _step(segments, clean_spaces(F.col("value"), profile, F.col("content_before"), F.col("content_after")))


def canonicalize_punctuation(segments: DataFrame, profile: str = "ASCII_STABLE", dashes_approved: bool = False) -> DataFrame:
    return _step(segments, plain_punctuation(F.col("value"), profile, F.lit(dashes_approved)), "PUNCTUATION_SEMANTICS_REVIEW" if dashes_approved else None)


def _with_words(sources: DataFrame, form: str) -> DataFrame:
    """Adds ``_words`` of texts that the form can change, and ``_odd``, those among them that it can change."""
    # Only words that can change leave the JVM; the others are their own normal form.
    risky = tx.needs_normalizing(F.col("text"), form) & F.lit(form in ("NFKC", "NFKD"))
    words = F.array_distinct(F.regexp_extract_all(F.col("text"), F.lit(cc.COLLISION_WORD), F.lit(0)))
    staged = sources.withColumn("_words", F.when(risky, words))
    return staged.withColumn("_odd", F.filter("_words", lambda w: tx.needs_normalizing(w, form)))


def _odd_forms(form: str) -> Column:
    return tx.normalize_all(F.when(F.size("_odd") > 0, F.col("_odd")), form)


def with_collisions(sources: DataFrame, form: str) -> DataFrame:
    """Adds ``collisions``: (normal_form, originals) groups of distinct words sharing a normal form."""
    return _collided(_with_words(sources, form).withColumn("_norms", _odd_forms(form)), form)


def _collided(staged: DataFrame, form: str) -> DataFrame:
    kind = "array<struct<normal_form:string,originals:array<string>>>"
    plain = F.filter("_words", lambda w: ~tx.needs_normalizing(w, form))

    def groups(pairs: Column) -> Column:
        # Equal forms stand together, so a group is a slice between two heads.
        heads = F.array_compact(F.transform(pairs, lambda p, i: F.when((i == 0) | (p["n"] != F.get(pairs, i - 1)["n"]), i)))

        def group(at: Column, k: Column, all_heads: Column) -> Column:
            members = F.slice(pairs, at + 1, F.coalesce(F.get(all_heads, k + 1), F.size(pairs)) - at)
            return F.struct(F.get(pairs, at)["n"].alias("normal_form"), F.transform(members, lambda p: p["w"]).alias("originals"))

        made = tx.let(heads, lambda all_heads: F.transform(all_heads, lambda at, k: group(at, k, all_heads)))
        return F.filter(made, lambda g: F.size(g["originals"]) > 1)

    changed = F.zip_with("_norms", "_odd", lambda n, w: F.struct(n.alias("n"), w.alias("w")))
    pairs = F.array_sort(F.concat(changed, F.transform(plain, lambda w: F.struct(w.alias("n"), w.alias("w")))))
    shared = (F.size(F.array_distinct("_norms")) < F.size("_odd")) | F.arrays_overlap("_norms", plain)
    found = F.when(F.size("_norms") > 0, F.when(shared, tx.let(pairs, groups)))
    return staged.withColumn("collisions", F.coalesce(found.cast(kind), F.array().cast(kind))).drop("_words", "_odd", "_norms")


def normalization_collisions(sources: DataFrame, form: str = "NFKC") -> DataFrame:
    """Distinct words of one text with the same compatibility form."""
    return to_rows(with_collisions(sources, form), ["source_id"], F.col("collisions"))


def strip_rich(sources: DataFrame) -> DataFrame:
    """A ledger row without before and after for each styled, HTML or hidden alternative."""
    sources = inv.with_source_defaults(sources)
    hidden = F.col("hidden_alt") | (F.col("source_kind") == "HTML_CLIPBOARD")
    styled = F.col("rich") | (F.col("source_kind") == "STYLED_TEXT")
    return sources.where(hidden | styled).select(
        "source_id", F.lit("TXT-016").alias("block_id"), F.lit(None).cast("string").alias("before"),
        F.lit(None).cast("string").alias("after"),
        F.when(hidden, F.lit("VISIBLE_TEXT_LINK_TARGET_REVIEW")).alias("review_code"),
    )


# ------------------------------------------------------------------------------------------------ N10
NO_APPROVALS = {
    "approved_codes": "array<string>",
    "replacements": "map<string,string>",
    "approved_wraps": "array<int>",
}


def gate_ok(code: str, approvals_all: bool = False) -> Column:
    """R02 rule for one review code over the inspection columns (approved code plus the extra rule)."""
    base = F.array_contains("approved_codes", code)
    has = lambda c: F.array_contains("review_codes", c)
    if code in ("MALFORMED_UNICODE_REVIEW", "UNSUPPORTED_CONTROL_REVIEW"):
        return F.lit(False)
    if code == "MIXED_SCRIPT_CONFUSABLE_REVIEW":
        keys = F.map_keys("replacements")
        free = F.transform(F.filter("mixed_tokens", lambda t: ~t["protected"]), lambda t: t["token"])
        return base & (F.size(F.array_except(free, keys)) == 0)
    if code == "VIEWPORT_WRAP_REVIEW":
        return base & (F.size(F.array_except("wrap_offsets", "approved_wraps")) == 0)
    if code == "NORMALIZATION_COLLISION_REVIEW":
        other = "COMPATIBILITY_NORMALIZATION_REVIEW"
        return base & (~has(other) | F.array_contains("approved_codes", other))
    if code == "BIDI_DISPLAY_REVIEW":
        other = "LANGUAGE_SENSITIVE_CONTROL_REVIEW"
        return base & (~has(other) | F.array_contains("approved_codes", other))
    return base


def prepare(
    sources: DataFrame, approvals: DataFrame | None = None, form: str = "NFKC", allowed_scripts: tuple[str, ...] = ()
) -> DataFrame:
    """Inspection columns plus approvals and gate states, still one row per source."""
    collided = lambda df: settled(_collided(df, form), ["collisions"])
    staged = fnd.with_review_codes(_with_words(sources, form), allowed_scripts, then=collided, _norms=_odd_forms(form))
    if approvals is not None:
        wanted = [c for c in NO_APPROVALS if c in approvals.columns]
        staged = staged.join(approvals.select("source_id", *wanted), "source_id", "left")
    empties = {
        "approved_codes": F.array().cast("array<string>"),
        "replacements": F.create_map().cast("map<string,string>"),
        "approved_wraps": F.array().cast("array<int>"),
    }
    for name, empty in empties.items():
        staged = staged.withColumn(name, F.coalesce(F.col(name), empty) if name in staged.columns else empty)
    staged = staged.withColumn(
        "gate_codes",
        F.array_sort(F.when(F.size("collisions") > 0, F.array_append("review_codes", "NORMALIZATION_COLLISION_REVIEW")).otherwise(F.col("review_codes"))),
    )
    ok = F.array_compact(F.array(*[F.when(F.array_contains("gate_codes", c) & gate_ok(c), F.lit(c)) for c in fnd.REVIEW_BLOCK]))
    staged = staged.withColumn("approved_gates", ok)
    return staged.withColumn("blocked_input", (F.size("controls") > 0) | ~F.is_valid_utf8("text"))


def canonical_stages(
    sources: DataFrame, approvals: DataFrame | None = None, form: str = "NFKC", whitespace: str = "DOCUMENT",
    punctuation: str = "ASCII_STABLE", keep_emoji_joiners: bool = True, allowed_scripts: tuple[str, ...] = (),
) -> DataFrame:
    """One row per source with ``stages``: for each transform (block, gate, applied, proposed values)."""
    staged = prepare(sources, approvals, form, allowed_scripts)
    staged = settled(staged, ["segments", "collisions", "gate_codes", "approved_gates", "blocked_input", "mixed_tokens", "wrap_offsets"])
    has = lambda c: F.array_contains("gate_codes", c)
    approved = lambda gate: gate.isNull() | F.array_contains("approved_gates", gate)
    staged = staged.withColumn("v0", F.transform("segments", lambda g: g["value"]))

    def advance(df: DataFrame, k: int, block: str, gate: Column, proposed: Column, when: Column | None = None) -> DataFrame:
        active = ~F.col("blocked_input") if when is None else ~F.col("blocked_input") & when
        df = df.withColumn(f"gate{k}", gate.cast("string"))
        df = df.withColumn(f"p{k}", F.when(active, proposed).otherwise(F.col(f"v{k - 1}")))
        return df.withColumn(f"v{k}", F.when(approved(F.col(f"gate{k}")), F.col(f"p{k}")).otherwise(F.col(f"v{k - 1}")))

    def free(values: str, fn) -> Column:
        return F.zip_with(values, "segments", lambda v, g: F.when(g["protected"], v).otherwise(fn(v, g)))

    null = F.lit(None).cast("string")
    staged = advance(staged, 1, "TXT-015", F.lit("VIEWPORT_WRAP_REVIEW"),
                     free("v0", lambda v, g: drop_wraps(v, g["start"], F.col("approved_wraps"))), F.size("wrap_offsets") > 0)

    # Normal forms leave the JVM once per row, with only the runs that can change.
    compat = form in ("NFKC", "NFKD")
    norm_gate = F.when(F.size("collisions") > 0, F.lit("NORMALIZATION_COLLISION_REVIEW")).when(
        F.lit(compat) & has("COMPATIBILITY_NORMALIZATION_REVIEW"), F.lit("COMPATIBILITY_NORMALIZATION_REVIEW")
    )
    risky = F.zip_with("v1", "segments", lambda v, g: F.when(~g["protected"] & tx.needs_normalizing(v, form), v))
    staged = staged.withColumn("_risky", F.when(~F.col("blocked_input"), risky))
    sent = F.when(F.exists("_risky", lambda v: v.isNotNull()), F.col("_risky"))
    staged = staged.withColumn("_fixed", tx.normalize_all(sent, form, keep_spaces=True))
    normalized = F.when(F.col("_fixed").isNotNull(), F.zip_with("v1", "_fixed", lambda v, f: F.coalesce(f, v))).otherwise(F.col("v1"))
    staged = advance(staged, 2, "TXT-010", norm_gate, normalized).drop("_risky", "_fixed")

    ignorable_gate = F.when(has("BIDI_DISPLAY_REVIEW"), F.lit("BIDI_DISPLAY_REVIEW")).when(
        has("LANGUAGE_SENSITIVE_CONTROL_REVIEW"), F.lit("LANGUAGE_SENSITIVE_CONTROL_REVIEW")
    )
    staged = advance(staged, 3, "TXT-011", ignorable_gate, free("v2", lambda v, g: drop_ignorables(v, keep_emoji_joiners)))
    staged = advance(staged, 4, "TXT-012", F.lit("MIXED_SCRIPT_CONFUSABLE_REVIEW"),
                     free("v3", lambda v, g: swap_tokens(v, F.col("replacements"))),
                     F.exists("mixed_tokens", lambda t: ~t["protected"]))

    def spaced(zipped: Column) -> Column:
        return F.transform(
            zipped,
            lambda z, i: F.when(z["p"], z["v"]).otherwise(
                clean_spaces(z["v"], whitespace, _ends_content(F.get(zipped, i - 1)["v"]), _starts_content(F.get(zipped, i + 1)["v"]))
            ),
        )

    staged = staged.withColumn("_zipped", F.zip_with("v4", "segments", lambda v, g: F.struct(v.alias("v"), g["protected"].alias("p"))))
    staged = advance(staged, 5, "TXT-013", null, spaced(F.col("_zipped"))).drop("_zipped")
    dash_gate = F.when(has("PUNCTUATION_SEMANTICS_REVIEW"), F.lit("PUNCTUATION_SEMANTICS_REVIEW"))
    staged = advance(staged, 6, "TXT-014", dash_gate,
                     free("v5", lambda v, g: plain_punctuation(v, punctuation, F.col("gate6").isNotNull())))
    pending = F.array_except("gate_codes", "approved_gates")
    return staged.withColumn("canonical", F.array_join("v6", "")).withColumn("pending", pending).withColumn(
        "locked", ~F.col("blocked_input") & (F.size("pending") == 0)
    )


_STEPS = ("TXT-015", "TXT-010", "TXT-011", "TXT-012", "TXT-013", "TXT-014")
_CATEGORY = {"TXT-010": "UNICODE", "TXT-011": "UNICODE", "TXT-013": "UNICODE", "TXT-012": "CONFUSABLE",
             "TXT-014": "PUNCTUATION", "TXT-015": "LAYOUT", "TXT-016": "SEMANTIC"}


class Canonicalization:
    """The five output tables of N10, all views over one staged DataFrame."""

    def __init__(self, staged: DataFrame):
        self.staged = staged

    def canonical(self) -> DataFrame:
        return self.staged.select("source_id", F.col("canonical").alias("text"), "locked")

    def _changes(self) -> Column:
        """All proposals of a source as one array, in the order of steps and segments."""
        hidden = F.col("hidden_alt") | (F.col("source_kind") == "HTML_CLIPBOARD")
        strip = F.when(
            ~F.col("blocked_input") & (hidden | F.col("rich") | (F.col("source_kind") == "STYLED_TEXT")),
            F.array(
                F.struct(
                    F.lit("TXT-016").alias("block_id"), F.lit(-1).alias("seg_idx"), F.lit(0).alias("step"),
                    F.lit(None).cast("string").alias("before"), F.lit(None).cast("string").alias("after"),
                    F.when(hidden, F.lit("VISIBLE_TEXT_LINK_TARGET_REVIEW")).alias("review_code"),
                    (~hidden | F.array_contains("approved_gates", "VISIBLE_TEXT_LINK_TARGET_REVIEW")).alias("applied"),
                )
            ),
        )
        def step(k: int, block: str) -> Column:
            gate = F.col(f"gate{k}")
            applied = gate.isNull() | F.array_contains("approved_gates", gate)
            rows = F.transform(
                F.arrays_zip(F.col(f"v{k - 1}").alias("b"), F.col(f"p{k}").alias("a")),
                lambda z, i: F.struct(
                    F.lit(block).alias("block_id"), i.cast("int").alias("seg_idx"), F.lit(k).alias("step"),
                    z["b"].alias("before"), z["a"].alias("after"), gate.alias("review_code"), applied.alias("applied"),
                ),
            )
            return F.filter(rows, lambda p: p["before"] != p["after"])

        steps = [step(k, block) for k, block in enumerate(_STEPS, start=1)]
        kind = "array<struct<block_id:string,seg_idx:int,step:int,before:string,after:string,review_code:string,applied:boolean>>"
        return F.concat(F.coalesce(strip.cast(kind), F.array().cast(kind)), *[s.cast(kind) for s in steps])

    def proposals(self) -> DataFrame:
        return to_rows(self.staged, ["source_id"], self._changes())

    def ledger(self) -> DataFrame:
        """Applied changes with their ids; the id counts the source's applied changes from 0, in order of steps and segments."""
        made = F.filter(self._changes(), lambda p: p["applied"])
        numbered = F.transform(made, lambda p, i: p.withField("change_id", F.concat(F.lit("text-c-"), i.cast("string"))))
        rows = to_rows(self.staged, ["source_id"], numbered)
        impact = F.when(F.col("review_code").isNull(), F.lit("NONE")).otherwise(F.lit("POSSIBLE"))
        category = F.create_map(*[F.lit(x) for kv in _CATEGORY.items() for x in kv])
        return rows.select(
            "source_id", "change_id", "block_id", F.lit(1).alias("block_version"), category[F.col("block_id")].alias("category"),
            "before", "after", impact.alias("semantic_impact"), "review_code",
        )

    def gates(self) -> DataFrame:
        states = F.transform(
            "gate_codes", lambda c: F.struct(c.alias("review_code"), F.array_contains("approved_gates", c).alias("done")))
        rows = to_rows(self.staged, ["source_id"], states)
        done = F.col("done")
        return rows.select(
            "source_id", "review_code", F.lit(True).alias("blocking"),
            F.when(done, F.lit("APPROVED")).otherwise(F.lit("PENDING")).alias("status"),
        )

    def failures(self) -> DataFrame:
        blocks = F.create_map(*[F.lit(x) for kv in fnd.REVIEW_BLOCK.items() for x in kv])
        pending = F.array_distinct(F.transform("pending", lambda c: blocks[c]))
        unresolved = to_rows(self.staged, ["source_id", F.lit("UNRESOLVED_REVIEW").alias("code")], pending, struct=False, name="block_id")
        hard = keep_rows(self.staged, F.col("blocked_input")).select(
            "source_id",
            F.when(~F.is_valid_utf8("text"), F.lit("MALFORMED_UTF")).otherwise(F.lit("UNSUPPORTED_SCALAR")).alias("code"),
            F.lit("TXT-001").alias("block_id"),
        )
        return hard.unionByName(unresolved)


def canonicalize_text(sources: DataFrame, approvals: DataFrame | None = None, **policy) -> Canonicalization:
    """Canonical text, proposals, ledger, gates and failures of every source."""
    return Canonicalization(canonical_stages(sources, approvals, **policy))


# ------------------------------------------------------------------------------------------ N11, N12
def serialize_newlines(texts: DataFrame, profile: str = "LF") -> DataFrame:
    """LF or CRLF output; text with CR or NUL cannot be reproduced and gets an error instead."""
    text = F.col("text")
    error = (
        F.when(text.contains("\x00") | ~F.is_valid_utf8(text), F.lit("SERIALIZER_UNSUPPORTED_SCALAR"))
        .when(text.contains("\r"), F.lit("SERIALIZER_SCALAR_MISMATCH"))
    )
    out = F.replace(text, F.lit("\n"), F.lit("\r\n")) if profile == "CRLF" else text
    return texts.select(
        "source_id", F.when(error.isNull(), out).alias("serialized"),
        F.when(error.isNull(), F.length(text)).alias("scalar_count"), error.alias("error"),
    )


def reparse_newlines(serialized: DataFrame, profile: str = "LF") -> DataFrame:
    """N11 back: canonical LF text, or an error for a stray CR, a bare LF or an unsupported scalar."""
    text = F.col("serialized")
    stray = text.rlike(r"\r(?!\n)|(?<!\r)\n") if profile == "CRLF" else text.contains("\r")
    error = F.when(text.contains("\x00") | ~F.is_valid_utf8(text), F.lit("SERIALIZER_UNSUPPORTED_SCALAR")).when(
        stray, F.lit("SERIALIZER_SCALAR_MISMATCH")
    )
    back = F.replace(text, F.lit("\r\n"), F.lit("\n")) if profile == "CRLF" else text
    return serialized.select("source_id", F.when(error.isNull(), back).alias("text"), error.alias("error"))


# --- fixed values: plain labels of message roles ---
ROLE_LABELS = {"AUTHOR": "Author", "RECIPIENT": "Recipient", "SYSTEM": "System", "UNKNOWN": "Message"}


def render_blocks(blocks: DataFrame, urls: DataFrame | None = None, role_labels: bool = False, image_labels: bool = True) -> DataFrame:
    """The plain text of each document block by its kind."""
    columns = {"text": "string", "items": "array<string>", "ordered": "boolean", "role": "string",
               "rows": "array<array<string>>", "url_token_id": "string", "label": "string"}
    for name, kind in columns.items():
        if name not in blocks.columns:
            blocks = blocks.withColumn(name, F.lit(None).cast(kind))
    if urls is not None:
        blocks = blocks.join(urls.select(F.col("token_id").alias("url_token_id"), F.col("final_text").alias("_target")), "url_token_id", "left")
    else:
        blocks = blocks.withColumn("_target", F.lit(None).cast("string"))
    kind, text, target = F.col("kind"), F.coalesce("text", F.lit("")), F.col("_target")
    listed = F.array_join(
        F.transform("items", lambda x, i: F.concat(F.when(F.col("ordered"), F.concat(i + 1, F.lit(". "))).otherwise(F.lit("- ")), x)), "\n"
    )
    labels = F.create_map(*[F.lit(x) for kv in ROLE_LABELS.items() for x in kv])
    message = F.concat(F.coalesce(labels[F.col("role")], F.lit("Message")), F.lit(": "), text) if role_labels else text
    link = (
        F.when(target.rlike(r"^\s*$"), text)
        .when(text.rlike(r"^\s*$") | (text == target), target)
        .otherwise(F.concat(text, F.lit(" ("), target, F.lit(")")))
    )

    def placeholder(name: str) -> Column:
        if not image_labels:
            return F.lit("")
        return F.when(F.col("label").isNull(), F.lit(f"[{name}]")).otherwise(F.concat(F.lit(f"[{name}: "), "label", F.lit("]")))

    body = (
        F.when(kind == "LIST", listed)
        .when(kind == "QUOTE", F.concat(F.lit("> "), F.regexp_replace(text, r"\r\n|[\n\r]", "\n> ")))
        .when(kind == "MESSAGE", message)
        .when(kind == "TABLE", F.array_join(F.transform("rows", lambda r: F.array_join(r, "\t")), "\n"))
        .when(kind == "LINK", link)
        .when(kind == "IMAGE_PLACEHOLDER", placeholder("Image"))
        .when(kind == "REDACTION", placeholder("Redacted"))
        .when(kind == "UNKNOWN_REGION", F.lit("[Unknown region]"))
        .otherwise(text)
    )
    return blocks.select("doc_id", "block_id", "ordinal", body.alias("body"))


def serialize_document(blocks: DataFrame, urls: DataFrame | None = None, role_labels: bool = False, image_labels: bool = True) -> DataFrame:
    """Blocks in reading order joined by a blank line.

    The result is one string per document, so a document's blocks meet in one group by definition; the
    group holds what the output row itself must hold.
    """
    rendered = render_blocks(blocks, urls, role_labels, image_labels)
    pieces = F.array_sort(F.collect_list(F.struct("ordinal", "body")))
    return rendered.groupBy("doc_id").agg(
        F.array_join(F.transform(pieces, lambda p: p["body"]), "\n\n").alias("text"), F.count("*").alias("blocks")
    )
