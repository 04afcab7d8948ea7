"""Text sources, guards, seals and variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normlake.functions.text import chars, let, normalize
from normlake.operators.text_inventory import with_source_defaults


def text_sources(df: DataFrame, id_column: str, text_column: str, kind: str | Column = "PLAIN_TEXT") -> DataFrame:
    """Rows of any table as text sources; ``valid`` tells whether spans and wraps obey their rules.

    Spans must lie in the text, sorted and disjoint; wrap offsets must point at a line feed.
    """
    kind = kind if isinstance(kind, Column) else F.lit(kind)
    src = df.withColumns({"source_id": F.col(id_column), "text": F.col(text_column), "source_kind": kind})
    src = with_source_defaults(src)
    n = F.length("text")
    spans = F.array_sort("explicit_spans")
    inside = F.forall("explicit_spans", lambda s: (s["start"] >= 0) & (s["start"] < s["end"]) & (s["end"] <= n))
    disjoint = let(
        spans,
        lambda sorted_spans: F.forall(
            F.transform(sorted_spans, lambda s, i: F.coalesce(F.get(sorted_spans, i - 1)["end"] <= s["start"], F.lit(True))), lambda ok: ok
        ),
    )
    feeds = let(chars(F.col("text")), lambda cs: F.forall("wrap_offsets", lambda w: F.coalesce(F.get(cs, w) == "\n", F.lit(False))))
    wraps = F.when(F.size("wrap_offsets") > 0, feeds).otherwise(F.lit(True))
    error = (
        F.when(~inside, F.lit("INVALID_PROTECTED_SPAN")).when(~disjoint, F.lit("OVERLAPPING_PROTECTED_SPAN")).when(~wraps, F.lit("INVALID_VISUAL_WRAP"))
    )
    return src.withColumn("explicit_spans", spans).withColumn("source_error", error).select(
        "source_id", "text", "source_kind", "explicit_spans", "rich", "hidden_alt", "wrap_offsets", "source_error")


def resource_guard(sources: DataFrame, max_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejects); rejects carry the id and a reason, never the text."""
    size = F.octet_length("text")
    reason = F.when(F.col("text").isNull() | (size == 0), F.lit("EMPTY_SOURCE")).when(size > max_bytes, F.lit("BYTE_BUDGET_EXCEEDED"))
    accepted = sources.where(F.coalesce(size.between(1, max_bytes), F.lit(False)))
    rejects = sources.select("source_id", reason.alias("reason")).where("reason IS NOT NULL")
    return accepted, rejects


def seal_sources(sources: DataFrame) -> DataFrame:
    """Digest and size at import."""
    raw = F.encode("text", "UTF-8")
    return sources.select("source_id", F.sha2(raw, 256).alias("digest"), F.octet_length(raw).alias("byte_count"))


def verify_seal(sources: DataFrame, seals: DataFrame) -> DataFrame:
    """Outcome of every seal against the text found later, first difference wins."""
    now = seal_sources(sources).select("source_id", F.col("digest").alias("_d"), F.col("byte_count").alias("_n"))
    outcome = (
        F.when(F.col("_d").isNull(), F.lit("MISSING"))
        .when(F.col("_n") != F.col("byte_count"), F.lit("LENGTH_MISMATCH"))
        .when(F.col("_d") != F.col("digest"), F.lit("DIGEST_MISMATCH"))
        .otherwise(F.lit("VALID"))
    )
    return seals.join(now, "source_id", "left").select("source_id", outcome.alias("outcome"))


# --- fixed values: generator outputs that do not depend on the input ---
PUNCTUATION_VARIANTS = (
    ("ascii", "\"Don't - wait...\""),
    ("typographic", "“Don’t — wait…”"),
    ("mixed", "“Don't – wait...\""),
)
ZERO_WIDTH = (("zero-width-space", "​"), ("word-joiner", "⁠"), ("zero-width-no-break-space", "﻿"))
SPACES = (("ascii-space", " "), ("no-break-space", " "), ("thin-space", " "), ("narrow-no-break-space", " "), ("em-space", " "))
NEWLINES = (("lf", "\n"), ("crlf", "\r\n"), ("cr", "\r"))
METADATA = (
    ("filename-a", {"sourceFilename": "sender-A-7F2.png", "metadataId": "meta-A-7F2"}),
    ("filename-b", {"sourceFilename": "sender-B-9C4.png", "metadataId": "meta-B-9C4"}),
    ("provider-uri", {"sourceUri": "content://fixture/provider/item-3D8"}),
)


def generate_variants(df: DataFrame, generator: str, **options) -> DataFrame:
    """Variants (id, variant_id, value, attributes) of each row's text; one narrow explode.

    Generators: zero_width(index), unicode_spaces(right column), newlines, normal_forms, punctuation,
    tracking, percent_encoding(identifier column), metadata.
    """
    text = F.col("text")
    if generator == "zero_width":
        at = F.lit(options.get("index", 0))
        made = [(name, F.concat(F.substring(text, F.lit(1), at), F.lit(mark), F.substring(text, at + 1, F.length(text)))) for name, mark in ZERO_WIDTH]
    elif generator == "unicode_spaces":
        made = [(name, F.concat(text, F.lit(mark), F.col(options["right"]))) for name, mark in SPACES]
    elif generator == "newlines":
        made = [(name, F.replace(text, F.lit("\n"), F.lit(mark))) for name, mark in NEWLINES]
    elif generator == "normal_forms":
        made = [("nfc", normalize(text, "NFC")), ("nfd", normalize(text, "NFD"))]
    elif generator == "punctuation":
        made = [(name, F.lit(value)) for name, value in PUNCTUATION_VARIANTS]
    elif generator == "tracking":
        sep = F.when(text.rlike(r"^[^#]*\?"), F.lit("&")).otherwise(F.lit("?"))
        tails = (("utm-source", "utm_source=mail"), ("utm-campaign", "utm_campaign=summer"), ("combined", "utm_source=mail&utm_campaign=summer"))
        made = [(name, F.concat(text, sep, F.lit(tail))) for name, tail in tails]
    elif generator == "percent_encoding":
        ident = F.col(options["identifier"])
        coded = F.regexp_replace(F.hex(F.encode(ident, "UTF-8")), "(..)", "%$1")
        made = [
            ("plain-path-identifier", F.concat(text, F.lit("/"), ident)),
            ("percent-encoded-path-identifier", F.concat(text, F.lit("/"), coded)),
            ("percent-encoded-query-identifier", F.concat(text, F.lit("/?id="), coded)),
        ]
    elif generator == "metadata":
        rows = [
            F.struct(F.lit(name).alias("variant_id"), text.alias("value"), F.create_map(*[F.lit(x) for kv in attrs.items() for x in kv]).alias("attributes"))
            for name, attrs in METADATA
        ]
        return df.select("id", F.inline(F.array(*rows)))
    else:
        raise ValueError(f"unknown generator: {generator}")
    none = F.create_map().cast("map<string,string>")
    rows = [F.struct(F.lit(name).alias("variant_id"), value.alias("value"), none.alias("attributes")) for name, value in made]
    out = df.select("id", F.inline(F.array(*rows)))
    if generator == "normal_forms":
        # The second form counts only where it differs from the first.
        out = df.withColumn("_c", made[0][1]).withColumn("_d", made[1][1]).select(
            "id", F.inline(F.array_compact(F.array(
                F.struct(F.lit("nfc").alias("variant_id"), F.col("_c").alias("value"), none.alias("attributes")),
                F.when(F.col("_c") != F.col("_d"), F.struct(F.lit("nfd").alias("variant_id"), F.col("_d").alias("value"), none.alias("attributes"))),
            ))))
    return out
