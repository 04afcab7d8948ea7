"""Position-level inventories of text.

Each inventory is first an array column of its row (``*_array``), then a table made by one explode. The
arrays need no shuffle and no window: neighbours are read from the row's own character array.
Offsets are code points; UTF-16 offsets are given where the output asks for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normlake.dims import charclass as cc
from normlake.dims.unicode_props import block_rule, unicode_props
from normlake.functions import text as tx
from normlake.functions.rows import settled, to_rows

SPAN = "array<struct<start:int,end:int,kind:string,locked:boolean>>"
FINDING = (
    "array<struct<block_id:string,category:string,severity:string,confidence:string,scalar_start:int,"
    "scalar_end:int,title:string,semantic_risk:string,review_code:string>>"
)

def with_source_defaults(sources: DataFrame) -> DataFrame:
    """Fill in the source attributes a caller left out."""
    defaults = {
        "source_kind": lambda: F.lit("PLAIN_TEXT"),
        "explicit_spans": lambda: F.array().cast(SPAN),
        "rich": lambda: F.lit(False),
        "hidden_alt": lambda: F.lit(False),
        "wrap_offsets": lambda: F.array().cast("array<int>"),
    }
    missing = {name: make() for name, make in defaults.items() if name not in sources.columns}
    return sources.withColumns(missing) if missing else sources


def _char_records(text: Column, pattern: str, record) -> Column:
    """Records for the characters that match ``pattern``; ``record(i, c, previous, following)`` builds each."""
    return F.transform(tx.char_hits(text, pattern), lambda h: record(h["at"], h["c"], h["p"], h["n"]))


# ---------------------------------------------------------------------------------------------- T01, T02
def scalar_inventory(sources: DataFrame) -> DataFrame:
    """One row per code point with UTF-16 range, general category, script and combining class."""
    spark = sources.sparkSession
    exploded = to_rows(sources, ["source_id"], tx.indexed_chars(F.col("text")), "scalar_idx")
    cp = tx.code_point(F.col("c"))
    rows = exploded.select(
        "source_id",
        "scalar_idx",
        F.col("u16").alias("utf16_start"),
        (F.col("u16") + F.when(cp > 0xFFFF, 2).otherwise(1)).alias("utf16_end"),
        cp.alias("cp"),
    )
    joined = rows.join(F.broadcast(unicode_props(spark)), "cp", "left")
    return joined.select(
        "source_id", "scalar_idx", "utf16_start", "utf16_end", "cp",
        F.coalesce("category", block_rule(F.col("cp"), 2, "Cn")).alias("category"),
        F.coalesce("script", block_rule(F.col("cp"), 3, "OTHER")).alias("script"),
        F.coalesce("ccc", F.lit(0)).alias("ccc"),
    )


def grapheme_inventory(sources: DataFrame) -> DataFrame:
    """Extended grapheme clusters with code-point and UTF-16 bounds."""
    found = to_rows(sources, ["source_id"], tx.clusters(F.col("text")), "cluster_idx")
    return found.withColumn("cluster_idx", F.col("cluster_idx").cast("int"))


# --------------------------------------------------------------------------------------------------- T03
_FORMS = tx.FORMS


def with_normal_forms(sources: DataFrame, compatibility_only: bool = False) -> DataFrame:
    """Adds ``norm_hits``: grapheme clusters (start, end, value, four forms) that some form changes.

    Only texts that hold a character a form can change go to the Arrow worker, and only changed clusters return.
    ``compatibility_only`` looks at texts that hold a character with a compatibility mapping at all.
    """
    return settled(sources.withColumn("norm_hits", norm_array(F.col("text"), compatibility_only)), ["norm_hits"])


def norm_array(text: Column, compatibility_only: bool = False) -> Column:
    risky = text.rlike(tx.compatibility_class()) if compatibility_only else tx.needs_normalizing(text, "NFKD")
    return tx.changed_clusters(F.when(risky, text))


def normalization_deltas(sources: DataFrame) -> DataFrame:
    """Clusters whose NFC, NFD, NFKC or NFKD form differs, one row per form."""
    rows = to_rows(with_normal_forms(sources), ["source_id"], F.col("norm_hits"))
    per_form = F.array(
        *[F.struct(F.lit(form).alias("form"), F.col(f"f.{form.lower()}").alias("after")) for form in _FORMS]
    )
    kept = ["source_id", F.col("start").alias("scalar_start"), F.col("end").alias("scalar_end"), F.col("f.value").alias("before")]
    return to_rows(rows, kept, per_form).where("after <> before")


# ---------------------------------------------------------------------------------------------- T04-T06
def invisible_array(text: Column, shaping: Column) -> Column:
    emoji_near = lambda p, n: F.coalesce(p.rlike(cc.EMOJI), F.lit(False)) | F.coalesce(n.rlike(cc.EMOJI), F.lit(False))
    variation = lambda c: c.rlike(cc.char_class(cc.VARIATION_RANGES))

    def record(i, c, p, n):
        return F.struct(
            i.cast("int").alias("scalar_idx"), tx.code_point(c).alias("cp"),
            c.rlike(cc.char_class(cc.DEFAULT_IGNORABLE_RANGES)).alias("default_ignorable"),
            c.rlike(cc.char_class(cc.BIDI_RANGES)).alias("bidi"),
            variation(c).alias("variation"),
            F.when(c.isin("\u200c", "\u200d"), emoji_near(p, n) | shaping).otherwise(variation(c)).alias(
                "language_sensitive"
            ),
        )

    return _char_records(text, tx.wide(cc.INVISIBLE), record)


def _expand(ranges: str) -> list[str]:
    out = []
    for item in ranges.split():
        low, _, high = item.partition("-")
        out += [chr(cp) for cp in range(int(low, 16), int(high or low, 16) + 1)]
    return out


def whitespace_array(text: Column, regular: bool = True) -> Column:
    """Spaces and terminators; without ``regular`` single blanks inside a line are left out."""
    spaces, terminators = _expand(cc.WHITESPACE_RANGES), _expand(cc.LINE_TERMINATOR_RANGES)
    plain = [s for s in spaces if s not in terminators]

    def record(i, c, p, n):
        return F.struct(
            i.cast("int").alias("scalar_idx"), tx.code_point(c).alias("cp"),
            c.isin(*terminators).alias("line_terminator"),
            (p.isNull() | p.isin("\n", "\r")).alias("leading"),
            (n.isNull() | n.isin("\n", "\r")).alias("trailing"),
            (c.isin(*plain) & F.coalesce(p.isin(*plain), F.lit(False))).alias("repeated"),
        )

    pattern = cc.WHITESPACE
    if not regular:
        between = "[" + cc.class_body(cc.WHITESPACE_RANGES) + "&&[^" + cc.class_body(cc.LINE_TERMINATOR_RANGES) + "]]"
        # A letter meets two tests only: neighbours are looked at behind a blank.
        pattern = rf"[[^ -~]&&{cc.WHITESPACE}]| (?:(?<![^\n\r] )|(?![^\n\r])|(?<={between} ))"
    return _char_records(text, pattern, record)


def punctuation_array(text: Column) -> Column:
    wanted = r"[\p{Pc}\p{Pd}\p{Ps}\p{Pe}\p{Pi}\p{Pf}\p{Po}\x{2212}]"
    variants = _expand(cc.PUNCTUATION_VARIANT_RANGES)

    def record(i, c, p, n):
        return F.struct(
            i.cast("int").alias("scalar_idx"), tx.code_point(c).alias("cp"),
            (c == "\u2212").alias("sensitive"), c.isin(*variants).alias("variant"),
        )

    return _char_records(text, wanted, record)


def _explode_records(sources: DataFrame, records: Column) -> DataFrame:
    return to_rows(sources, ["source_id"], records)


def invisible_inventory(sources: DataFrame, allowed_scripts: tuple[str, ...] = ()) -> DataFrame:
    """Ignorable, bidi, variation and Format characters; ZWNJ/ZWJ are sensitive by neighbour or policy."""
    shaping = F.lit(any(s in cc.SHAPING_SCRIPTS for s in allowed_scripts))
    return _explode_records(sources, invisible_array(F.col("text"), shaping))


def whitespace_inventory(sources: DataFrame) -> DataFrame:
    """Every Unicode space and line terminator with its position flags."""
    return _explode_records(sources, whitespace_array(F.col("text")))


def punctuation_inventory(sources: DataFrame) -> DataFrame:
    """Punctuation of the seven categories and the minus sign."""
    return _explode_records(sources, punctuation_array(F.col("text")))


# --------------------------------------------------------------------------------------------------- T07
def line_structure(sources: DataFrame) -> DataFrame:
    """Lines with indentation, blank flag, list marker and declared visual wrap."""
    sources = with_source_defaults(sources)
    breaks = tx.hits(F.col("text"), r"\r\n|[\n\r\x{85}\x{2028}\x{2029}]")
    contents = F.split(F.col("text"), r"\r\n|[\n\r\x{85}\x{2028}\x{2029}]", -1)

    def lines(pair: Column) -> Column:
        found = pair["found"]
        return F.transform(
            contents,
            lambda content, k: F.struct(
                k.cast("int").alias("line_idx"),
                F.coalesce(F.get(found, k - 1)["end"], F.lit(0)).alias("start"),
                F.coalesce(F.get(found, k)["start"], F.length("text")).alias("end"),
                content.alias("content"),
                F.coalesce(F.get(pair["wraps"], k), F.lit(False)).alias("wrap"),
            ),
        )

    wraps = lambda found: tx.among(F.transform(found, lambda b: b["end"] - 1), F.col("wrap_offsets"))
    both = tx.let(breaks, lambda found: F.struct(found.alias("found"), wraps(found).alias("wraps")))
    rows = to_rows(sources, ["source_id"], tx.let(both, lines))
    indent = F.length(F.regexp_extract("content", "^" + cc.WHITESPACE + "*", 0))
    marker = F.regexp_extract("content", cc.LIST_MARKER, 0)
    return rows.select(
        "source_id", "line_idx", "start", "end",
        indent.alias("indentation"),
        F.col("content").rlike("^[" + cc.class_body(cc.WHITESPACE_RANGES) + r"\x{1C}-\x{1F}]*$").alias("blank"),
        F.when(marker != "", marker).alias("list_marker"),
        "wrap",
    )


# ---------------------------------------------------------------------------------------------- T10, T11
def protected_array(text: Column, source_kind: Column, explicit_spans: Column) -> Column:
    """Unmerged spans: explicit ones, the whole text of code and identifiers, then the pattern kinds."""
    whole_kind = F.when(source_kind == "CODE_BLOCK", F.lit("CODE")).when(
        source_kind == "IDENTIFIER", F.lit("IDENTIFIER")
    )
    whole = F.when(
        whole_kind.isNotNull() & (text != ""),
        F.array(F.struct(F.lit(0).alias("start"), F.length(text).alias("end"), whole_kind.alias("kind"), F.lit(True).alias("locked"))),
    ).otherwise(F.array().cast(SPAN))
    def spans_of(kind: str, pattern: str, needle: tuple[str, ...]) -> Column:
        return F.transform(
            tx.hits(text, pattern, needle),
            lambda h: F.struct(
                h["start"].alias("start"), h["end"].alias("end"), F.lit(kind).alias("kind"), F.lit(True).alias("locked")
            ),
        )

    found = [spans_of(*rule) for rule in cc.PROTECTED_PATTERNS]
    return F.concat(explicit_spans.cast(SPAN), whole.cast(SPAN), *found)


def with_text_facts(sources: DataFrame, **facts: Column) -> DataFrame:
    """Adds the unmerged spans as ``_raw`` and ``facts``, columns that Arrow functions make of the text alone.

    Together they are one Arrow step. Each further step in a stage is a worker process of its own beside each task.
    """
    sources = with_source_defaults(sources)
    facts = {"_raw": protected_array(F.col("text"), F.col("source_kind"), F.col("explicit_spans")), **facts}
    return settled(sources.withColumns(facts), list(facts))


def with_spans(sources: DataFrame) -> DataFrame:
    """Adds ``spans``: the merged protected spans of each source (T11 in one row).

    Union of overlapping spans without a running maximum: with starts and ends sorted apart, a new island
    begins at k exactly when the k-th end so far is not past the k-th start. Islands are index ranges of the
    (start, -end) order, so the last member is a lookup. The steps are columns of their own: deeply nested
    lambdas would make the planner slow.
    """
    df = sources if "_raw" in sources.columns else with_text_facts(sources)
    keyed = F.transform("_raw", lambda s, i: F.struct(s["start"].alias("a"), (-s["end"]).alias("b"), i.alias("i"), s.alias("s")))
    df = settled(df.withColumn("_keyed", F.array_sort(keyed)), ["_keyed"])
    df = df.withColumns({
        "_members": F.transform("_keyed", lambda k: k["s"]),
        "_ends": F.array_sort(F.transform("_raw", lambda s: s["end"])),
    })
    df = settled(df, ["_members", "_ends"])
    members, ends = F.col("_members"), F.col("_ends")
    heads = F.filter(
        F.sequence(F.lit(0), F.size(members) - 1),
        lambda k: (k == 0) | (F.get(ends, k - 1) <= F.get(members, k)["start"]),
    )
    df = settled(df.withColumn("_heads", F.when(F.size(members) > 0, heads)), ["_heads"])

    def island(k: Column, j: Column) -> Column:
        last = F.coalesce(F.get("_heads", j + 1), F.size(members)) - 1
        inside = F.slice(members, k + 1, last - k + 1)
        return F.struct(
            F.get(members, k)["start"].alias("start"), F.get(ends, last).alias("end"),
            F.when(F.exists(inside, lambda m: m["kind"] == "USER_LOCKED"), F.lit("USER_LOCKED"))
            .otherwise(F.get(members, last)["kind"]).alias("kind"),
            F.exists(inside, lambda m: m["locked"]).alias("locked"),
        )

    spans = F.coalesce(F.transform("_heads", island).cast(SPAN), F.array().cast(SPAN))
    # Arguments of Arrow functions draw in what they are made of, so the spans are settled before any meets them.
    return settled(df.withColumn("spans", spans).drop("_raw", "_keyed", "_members", "_ends", "_heads"), ["spans"])


def protected_spans(sources: DataFrame) -> DataFrame:
    """Unmerged protected spans."""
    sources = with_source_defaults(sources)
    return _explode_records(
        sources, protected_array(F.col("text"), F.col("source_kind"), F.col("explicit_spans"))
    )


def merge_spans(sources: DataFrame) -> DataFrame:
    """Protected spans after the interval union."""
    return _explode_records(with_spans(sources), F.col("spans"))


def with_segments(df: DataFrame, **placed: Column) -> DataFrame:
    """N01 in one row: adds ``segments``, ordered protected and free pieces (start, end, value, protected, kind).

    ``placed`` names columns that Arrow functions make of the spans (:func:`ends_in_spans`), which go in the same step.
    """
    none = F.lit(None).cast("string")
    made = lambda start, end, value, protected, kind: F.struct(
        start.alias("start"), end.alias("end"), value.alias("value"), F.lit(protected).alias("protected"), kind.alias("kind"))

    def around(s: Column, k: Column) -> Column:
        cursor = F.coalesce(F.get("spans", k - 1)["end"], F.lit(0))
        return F.array(
            made(cursor, s["start"], F.get("_cut", 2 * k), False, none),
            made(s["start"], s["end"], F.get("_cut", 2 * k + 1), True, s["kind"]),
        )

    n = F.length("text")
    last = F.get("spans", F.size("spans") - 1)["end"]
    tail = F.array(made(last, n, F.get("_cut", 2 * F.size("spans")), False, none))
    bounds = F.flatten(F.transform("spans", lambda s: F.array(s["start"], s["end"])))
    # Bytes that are no text stay in the JVM.
    valid, found = F.is_valid_utf8("text"), F.size("spans") > 0
    df = df.withColumns({"_cut": tx.cut_at(F.when(found & valid, F.col("text")), F.when(found & valid, bounds)), **placed})
    edges = F.concat(F.array(F.lit(0)), bounds, F.array(n))
    slow = tx.let(F.struct(tx.chars(F.col("text")).alias("cs"), edges.alias("at")), lambda r: F.transform(
        F.sequence(F.lit(1), F.size(r["at"]) - 1),
        lambda k: F.array_join(F.slice(r["cs"], F.get(r["at"], k - 1) + 1, F.get(r["at"], k) - F.get(r["at"], k - 1)), "")))
    df = settled(df.withColumn("_cut", F.when(found & ~valid, slow).otherwise(F.col("_cut"))), ["_cut", *placed])
    cut = F.filter(F.concat(F.flatten(F.transform("spans", around)), tail), lambda g: g["end"] > g["start"])
    whole = F.array(made(F.lit(0), n, F.col("text"), False, none))
    return settled(df.withColumn("segments", F.when(found, cut).otherwise(whole)).drop("_cut"), ["segments"])


# ---------------------------------------------------------------------------------------------- T08, T09
def ends_in_spans(points: Column, kind: str | None = None) -> Column:
    """For each point the end of the merged span (of one kind) that holds it, or 0."""
    held = F.filter("spans", lambda s: (s["end"] > s["start"]) & (F.lit(True) if kind is None else F.coalesce(s["kind"] == kind, F.lit(False))))
    return tx.span_ends(points, F.transform(held, lambda s: s["start"]), F.transform(held, lambda s: s["end"]))


def word_array(text: Column, when: Column | None = None) -> Column:
    """The words that :func:`with_tokens` makes tokens of."""
    return tx.hits(text if when is None else F.when(when, text), cc.WORD)


def starts_of(hits: str) -> Column:
    return F.transform(hits, lambda h: h["start"])


def with_tokens(df: DataFrame, name: str) -> DataFrame:
    """Makes the word tokens of each source, as column ``name``, of ``_hits`` and ``_ends``: the words and the spans that hold them."""
    kind = "array<struct<start:int,end:int,token:string,scripts:array<string>,skeleton:string,mixed:boolean,protected:boolean>>"
    df = df.withColumn("_scripts", F.transform("_hits", lambda h: tx.scripts_of(h["value"])))
    token = lambda h, scripts: F.struct(
        h["h"]["start"].alias("start"), h["h"]["end"].alias("end"), h["h"]["value"].alias("token"), scripts.alias("scripts"),
        tx.skeleton(h["h"]["value"]).alias("skeleton"), (F.size(scripts) > 1).alias("mixed"),
        (h["e"] >= h["h"]["end"]).alias("protected"),
    )
    placed = F.zip_with("_hits", "_ends", lambda h, e: F.struct(h.alias("h"), e.alias("e")))
    tokens = F.zip_with(placed, "_scripts", token).cast(kind)
    return df.withColumn(name, F.coalesce(tokens, F.array().cast(kind))).drop("_ends", "_hits", "_scripts")


def token_security(sources: DataFrame) -> DataFrame:
    """Word tokens with scripts, look-alike skeleton, mixed-script and protected flags."""
    staged = with_spans(with_text_facts(sources, _hits=word_array(F.col("text"))))
    staged = settled(staged.withColumn("_ends", ends_in_spans(starts_of("_hits"))), ["_ends"])
    return _explode_records(with_tokens(staged, "_tokens"), F.col("_tokens"))


def word_holders(sources: DataFrame) -> DataFrame:
    """(token, sources): the words of T08, each once, and how many sources hold it.

    Only the words are needed, so no span or script is looked for; the distinct words of a source stay one row until they are counted.
    """
    words = F.array_distinct(F.regexp_extract_all("text", F.lit(cc.WORD), F.lit(0)))
    of_source = sources.select("source_id", words.alias("_words")).groupBy("source_id").agg(F.array_distinct(F.flatten(F.collect_list("_words"))).alias("_words"))
    return to_rows(of_source, [], F.col("_words"), struct=False, name="token").groupBy("token").agg(F.count("*").alias("sources"))


def language_resolution(
    sources: DataFrame, allowed_scripts: tuple[str, ...] = (), allowed_languages: tuple[str, ...] = ()
) -> DataFrame:
    """A caller's policy wins; otherwise the scripts present, review for Latin with Greek or Cyrillic."""
    if allowed_scripts or allowed_languages:
        return sources.select(
            "source_id",
            F.array(*[F.lit(s) for s in allowed_scripts]).cast("array<string>").alias("allowed_scripts"),
            F.lit(len(allowed_scripts) > 1).alias("multilingual"),
            F.lit("CERTAIN_BY_PARSER").alias("confidence"),
            F.lit(False).alias("requires_review"),
        )
    rows = sources.select("source_id", tx.scripts_of(F.col("text")).alias("allowed_scripts"))
    review = script_review(F.col("allowed_scripts"))
    return rows.select(
        "source_id", "allowed_scripts", (F.size("allowed_scripts") > 1).alias("multilingual"),
        F.when(review, F.lit("WEAK_HEURISTIC")).otherwise(F.lit("STRONG_HEURISTIC")).alias("confidence"),
        review.alias("requires_review"),
    )


def script_review(scripts: Column) -> Column:
    return F.array_contains(scripts, "LATIN") & F.arrays_overlap(scripts, F.array(F.lit("GREEK"), F.lit("CYRILLIC")))


# --------------------------------------------------------------------------------------------------- T13
def control_array(text: Column) -> Column:
    pattern = f"[[^ -~]&&{cc.char_class(cc.UNSUPPORTED_CONTROL_RANGES)}]"
    return _char_records(text, pattern, lambda i, c, p, n: F.struct(i.cast("int").alias("scalar_idx")))


def text_failures(sources: DataFrame, raw: str | None = None) -> DataFrame:
    """Invalid encoding (checked on the raw bytes column if named) and unsupported controls."""
    controls = to_rows(
        sources, ["source_id", F.lit("UNSUPPORTED_SCALAR").alias("code"), F.lit("TXT-001").alias("block_id")],
        control_array(F.col("text")),
    )
    broken = sources.where(~F.is_valid_utf8(F.col(raw or "text"))).select(
        "source_id", F.lit("MALFORMED_UTF").alias("code"), F.lit("TXT-001").alias("block_id"),
        F.lit(None).cast("int").alias("scalar_idx"),
    )
    return controls.unionByName(broken)
