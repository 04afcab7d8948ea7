"""Review, decisions and lineage.

Links between findings, gates and decisions stay in long form (one row per link): a gate that collects a
third of all findings is then just many rows, and every check is an equi-join or a set comparison.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normlake.operators.common import apart, code_map, coded, codes_of, ranges, union_all, unmatched
from normlake.operators.text_findings import RETAIN_MEANING


def review_gates(findings: DataFrame) -> DataFrame:
    """One blocking PENDING gate per source and review code, with the number of findings behind it."""
    return findings.where("review_code IS NOT NULL").groupBy("source_id", "review_code").agg(
        F.count("*").alias("n_findings")
    ).select("source_id", "review_code", "n_findings", F.lit(True).alias("blocking"), F.lit("PENDING").alias("status"))


def gate_members(findings: DataFrame) -> DataFrame:
    """The finding ids of every gate, one row per link."""
    return findings.where("review_code IS NOT NULL").select("source_id", "review_code", "finding_id")


_NEVER = ("MALFORMED_UNICODE_REVIEW", "UNSUPPORTED_CONTROL_REVIEW")


def gate_status(gates: DataFrame, approvals: DataFrame, mixed_tokens: DataFrame | None = None,
                replacements: DataFrame | None = None, wraps: DataFrame | None = None, approved_wraps: DataFrame | None = None) -> DataFrame:
    """APPROVED needs the approved code and the rule of that code.

    approvals(source_id, review_code); mixed_tokens(source_id, token) are unprotected tokens and
    replacements(source_id, token) the reviewer's keys; wraps / approved_wraps(source_id, wrap_offset).
    """
    codes = approvals.select("source_id", "review_code").distinct()
    df = gates.join(codes.withColumn("_code", F.lit(True)), ["source_id", "review_code"], "left")

    def companion(code: str, name: str, rows: DataFrame) -> DataFrame:
        return rows.where(F.col("review_code") == code).select("source_id", F.lit(True).alias(name)).distinct()

    df = df.join(companion("COMPATIBILITY_NORMALIZATION_REVIEW", "_compat_gate", gates), "source_id", "left")
    df = df.join(companion("COMPATIBILITY_NORMALIZATION_REVIEW", "_compat_ok", codes), "source_id", "left")
    df = df.join(companion("LANGUAGE_SENSITIVE_CONTROL_REVIEW", "_lang_gate", gates), "source_id", "left")
    df = df.join(companion("LANGUAGE_SENSITIVE_CONTROL_REVIEW", "_lang_ok", codes), "source_id", "left")
    if mixed_tokens is not None:
        open_tokens = mixed_tokens.join(replacements.select("source_id", "token"), ["source_id", "token"], "left_anti")
        df = df.join(open_tokens.select("source_id", F.lit(True).alias("_open_token")).distinct(), "source_id", "left")
    else:
        df = df.withColumn("_open_token", F.lit(False))
    if wraps is not None:
        open_wraps = wraps.join(approved_wraps.select("source_id", "wrap_offset"), ["source_id", "wrap_offset"], "left_anti")
        df = df.join(open_wraps.select("source_id", F.lit(True).alias("_open_wrap")).distinct(), "source_id", "left")
    else:
        df = df.withColumn("_open_wrap", F.lit(False))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    code = F.col("review_code")
    extra = (
        F.when(code.isin(*_NEVER), F.lit(False))
        .when(code == "MIXED_SCRIPT_CONFUSABLE_REVIEW", ~flag("_open_token"))
        .when(code == "VIEWPORT_WRAP_REVIEW", ~flag("_open_wrap"))
        .when(code == "NORMALIZATION_COLLISION_REVIEW", ~flag("_compat_gate") | flag("_compat_ok"))
        .when(code == "BIDI_DISPLAY_REVIEW", ~flag("_lang_gate") | flag("_lang_ok"))
        .otherwise(F.lit(True))
    )
    return df.select(
        "source_id", "review_code", "blocking",
        F.when(flag("_code") & extra, F.lit("APPROVED")).otherwise(F.lit("PENDING")).alias("status"),
    )


def decisions(gates: DataFrame, revision: int = 1, prefix: str = "text") -> DataFrame:
    """One decision per gate; a revision only when approved."""
    retain = F.col("review_code").isin(*RETAIN_MEANING)
    return gates.select(
        "source_id", "review_code",
        F.concat(F.lit(f"{prefix}-d-"), F.lower("review_code")).alias("decision_id"),
        F.when(retain, F.lit("RETAIN_SOURCE_MEANING")).otherwise(F.lit("ACCEPT_PROPOSED_CHANGE")).alias("action"),
        "status",
        F.when(retain, F.lit("NONE")).otherwise(F.lit("POSSIBLE")).alias("impact"),
        F.when(F.col("status") == "APPROVED", F.lit(revision)).alias("canonical_revision"),
    )


_LEDGER = ("source_id", "change_id", "block_id", "block_version", "category", "before", "after", "semantic_impact", "review_code")


def change_ledger(parts: list[DataFrame]) -> DataFrame:
    """Union of change tables in the ledger shape."""
    return union_all([p.select(*_LEDGER) for p in parts])


def ledger_violations(ledger: DataFrame, revision_column: str | None = None, document_revision: int | None = None) -> DataFrame:
    """Repeated ids, impact without a review link, entries from a later revision."""
    repeated = ledger.groupBy("source_id", "change_id").count().where("count > 1").select("source_id", "change_id", F.lit("DUPLICATE_CHANGE_ID").alias("code"))
    unlinked = ledger.where((F.col("semantic_impact") != "NONE") & F.col("review_code").isNull()).select("source_id", "change_id", F.lit("IMPACT_WITHOUT_REVIEW_LINK").alias("code"))
    parts = [repeated, unlinked]
    if revision_column:
        parts.append(ledger.where(F.col(revision_column) > document_revision).select("source_id", "change_id", F.lit("FUTURE_REVISION").alias("code")))
    return union_all(parts)


def finding_status(findings: DataFrame, ledger_links: DataFrame, approved_links: DataFrame) -> DataFrame:
    """CHANGED if a ledger entry links the finding, else ACCEPTED if an approved gate does."""
    on = ["source_id", "finding_id"]
    changed = ledger_links.select(*on).distinct().withColumn("_changed", F.lit(True))
    accepted = approved_links.select(*on).distinct().withColumn("_accepted", F.lit(True))
    df = findings.join(changed, on, "left").join(accepted, on, "left")
    status = F.when(F.col("_changed"), F.lit("CHANGED")).when(F.col("_accepted"), F.lit("ACCEPTED")).otherwise(F.col("status"))
    return df.withColumn("status", status).drop("_changed", "_accepted")


def review_queue(findings: DataFrame, sources: DataFrame) -> DataFrame:
    """Findings a person must see, grouped, with the excerpt of their span; of repeated ids the first by position.

    The spans of a source come to its text as one list and are cut there, so a text moves once however many findings
    it has.
    """
    wanted = findings.where(F.col("requires_decision") | (F.col("semantic_risk") != "NONE"))
    spans = wanted.groupBy("source_id", "finding_id").agg(F.min(F.struct("scalar_start", "scalar_end", "category")).alias("s"))
    lists = spans.groupBy("source_id").agg(F.collect_list(F.struct("finding_id", "s.*")).alias("_spans"))
    df = lists.join(sources.select("source_id", "text"), "source_id", "left")
    n = F.length("text")

    def cut(s: Column) -> Column:
        start, end = F.least(s["scalar_start"], n), F.least(s["scalar_end"], n)
        excerpt = F.when(s["scalar_start"].isNotNull() & s["scalar_end"].isNotNull(), F.substring(F.col("text"), start + 1, end - start))
        return F.struct(s["finding_id"].alias("finding_id"), s["category"].alias("category"), excerpt.alias("excerpt"))

    df = df.select("source_id", F.explode(F.transform("_spans", cut)).alias("_f")).select("source_id", "_f.*")
    group = F.coalesce(code_map({"URL": "LINK", "CONFUSABLE": "MEANING", "UNKNOWN": "UNKNOWN_DATA"})[F.col("category")], F.lit("HIDDEN_FORMATTING"))
    first = F.ascii("excerpt")
    return df.select(
        "source_id", "finding_id", group.alias("review_group"), "excerpt",
        F.when(F.col("excerpt") != "", F.concat(F.lit("U+"), F.when(first < 65536, F.lpad(F.hex(first), 4, "0")).otherwise(F.hex(first)))).alias("code_point"),
    )


def review_audit(runs: DataFrame, findings: DataFrame, approved_links: DataFrame, url_tokens: DataFrame) -> DataFrame:
    """Eight review audits per run, long form (run_id, audit_type, status, summary_code, affected).

    runs carries the run-level evidence: output_mode, reading_order_approved, n_regions, regions_approved,
    semantic_approved, assurance_acknowledged. findings(run_id, finding_id, block_id, category, title,
    confidence, semantic_risk, requires_decision); approved_links(run_id, finding_id) are approved at the
    document's revision; url_tokens(run_id, changed, user_approved).
    """
    links = approved_links.select("run_id", "finding_id").distinct().withColumn("_ok", F.lit(True))
    f = findings.join(links, ["run_id", "finding_id"], "left").withColumn("_ok", F.coalesce("_ok", F.lit(False)))
    live = F.col("requires_decision") | (F.col("semantic_risk") != "NONE")
    hidden = (F.col("block_id") == "TXT-003") | ((F.col("category") == "UNICODE") & F.col("title").rlike("INVISIBLE|IGNORABLE|BIDI"))
    groups = {
        "inv": live & hidden,
        "conf": live & ((F.col("block_id") == "TXT-005") | (F.col("category") == "CONFUSABLE")),
        "ocr": live & (F.col("confidence") == "OCR_DISAGREEMENT"),
        "url": live & (F.col("category") == "URL"),
        "lay": live & (F.col("category") == "LAYOUT"),
    }
    aggs = [F.count_if(cond).alias(f"n_{g}") for g, cond in groups.items()]
    aggs += [F.count_if(cond & ~F.col("_ok")).alias(f"open_{g}") for g, cond in groups.items()]
    aggs += [F.count_if(F.col("category") == "SEMANTIC").alias("n_sem"), F.count_if("requires_decision").alias("n_dec")]
    per_run = f.groupBy("run_id").agg(*aggs)
    tokens = url_tokens.groupBy("run_id").agg(F.count("*").alias("n_tok"), F.count_if(F.col("changed") & ~F.col("user_approved")).alias("open_tok"))
    df = runs.join(per_run, "run_id", "left").join(tokens, "run_id", "left").na.fill(0)
    n = F.col

    def audit(kind, applicable, complete, none_code, pass_code, open_code, affected) -> Column:
        status = F.when(~applicable, F.lit("NOT_APPLICABLE")).when(complete, F.lit("PASS")).otherwise(F.lit("REVIEW_REQUIRED"))
        code = F.when(~applicable, F.lit(none_code)).when(complete, F.lit(pass_code)).otherwise(F.lit(open_code))
        return F.struct(F.lit(kind).alias("audit_type"), status.alias("status"), code.alias("summary_code"), F.when(applicable, affected).otherwise(F.lit(0)).cast("long").alias("affected"))

    rebuilt = n("output_mode").isin("REBUILT_IMAGE", "BOTH") & (n("n_regions") > 0)
    always = F.lit(True)
    audits = F.array(
        audit("INVISIBLE_CHARACTER", n("n_inv") > 0, n("open_inv") == 0, "NO_REVIEW_FINDINGS", "INVISIBLE_REVIEW_APPROVED", "INVISIBLE_REVIEW_PENDING", n("n_inv")),
        audit("CONFUSABLE_CHARACTER", n("n_conf") > 0, n("open_conf") == 0, "NO_REVIEW_FINDINGS", "CONFUSABLE_REVIEW_APPROVED", "CONFUSABLE_REVIEW_PENDING", n("n_conf")),
        audit("OCR_AMBIGUITY", n("n_ocr") > 0, n("open_ocr") == 0, "NO_REVIEW_FINDINGS", "OCR_AMBIGUITY_APPROVED", "OCR_AMBIGUITY_PENDING", n("n_ocr")),
        audit("URL_POLICY", (n("n_tok") > 0) | (n("n_url") > 0), (n("open_url") == 0) & (n("open_tok") == 0), "NO_URL_REVIEW_REQUIRED", "URL_POLICY_APPROVED", "URL_POLICY_REVIEW_PENDING", n("n_url")),
        audit("READING_ORDER", n("n_lay") > 0, n("reading_order_approved") & (n("open_lay") == 0), "READING_ORDER_CONFIDENT", "READING_ORDER_APPROVED", "READING_ORDER_REVIEW_PENDING", n("n_lay")),
        audit("IMAGE_REGION_POLICY", rebuilt, n("regions_approved"), "NO_IMAGE_REGION_REVIEW_REQUIRED", "IMAGE_REGION_POLICY_APPROVED", "IMAGE_REGION_REVIEW_PENDING", n("n_regions")),
        audit("SEMANTIC_DIFF", always, n("semantic_approved"), "", "SEMANTIC_DIFF_APPROVED", "SEMANTIC_DIFF_INCOMPLETE", n("n_sem")),
        audit("ASSURANCE_CONSEQUENCE", always, n("assurance_acknowledged"), "", "ASSURANCE_CONSEQUENCE_APPROVED", "ASSURANCE_CONSEQUENCE_NOT_APPROVED", n("n_dec")),
    )
    return df.select("run_id", F.inline(audits))


def lineage_integrity(runs: DataFrame, ledger: DataFrame, transformations: DataFrame, manifest: DataFrame) -> DataFrame:
    """Structural failures between ledger, applied transformations and manifest.

    runs(run_id, document_revision, ledger_revision, ledger_id, document_ledger_id);
    ledger(run_id, change_id, block_id, block_version); transformations is long:
    (run_id, block_id, block_version, canonical_revision, change_id).
    """
    run_codes = codes_of(runs, [
        ("CHANGE_LEDGER_REVISION_MISMATCH", F.col("ledger_revision") != F.col("document_revision")),
        ("CHANGE_LEDGER_REFERENCE_MISMATCH", ~F.col("ledger_id").eqNullSafe(F.col("document_ledger_id"))),
    ])
    met = ranges([(runs, {"_doc": "document_revision"}), (transformations, {"_applied": "canonical_revision"})])
    late = coded(met, "TRANSFORMATION_REVISION_MISMATCH", apart("_applied", "_doc"))
    key = ["run_id", "block_id", "block_version"]
    blocks = union_all([df.select(*key, F.lit(side).alias("_side")) for side, df in ((1, transformations), (2, manifest))]).groupBy(*key).agg(F.bit_or("_side").alias("_side"))
    nameless = F.col("run_id").isNull() | F.col("block_id").isNull() | F.col("block_version").isNull()
    unlinked = coded(blocks, "TRANSFORMATION_MANIFEST_LINK_MISMATCH", (F.col("_side") == 1) | ((F.col("_side") == 3) & nameless))
    # Both sides of a change meet block by block, then all its blocks: aggregations only, no join.
    change, of = ["run_id", "change_id"], F.col("_side")
    both = union_all([df.select(*change, "block_id", "block_version", F.lit(side).alias("_side")) for side, df in ((1, transformations.where("change_id IS NOT NULL")), (2, ledger))])
    versions = [f(F.when(of == side, F.col("block_version"))).alias(f"_{name}_{end}") for side, name in ((1, "done"), (2, "entered")) for f, end in ((F.min, "low"), (F.max, "high"))]
    by_block = both.groupBy(*change, "block_id").agg(F.bit_or("_side").alias("_side"), *versions)
    named = F.col("block_id").isNotNull()
    changes = by_block.groupBy(*change).agg(
        F.bit_or("_side").alias("_side"), F.count_if((of != 1) & ~named).alias("_blank"), F.count_if(named).alias("_blocks"),
        F.count_if(named & (of != 2)).alias("_done"), F.count_if(named & (of != 1)).alias("_entered"),
        *[f(f"_{name}_{end}").alias(f"_{name}_{end}") for name in ("done", "entered") for f, end in ((F.min, "low"), (F.max, "high"))])
    keyed = F.col("run_id").isNotNull()
    other_block = (F.col("_done") > 0) & (F.col("_entered") > 0) & (F.col("_blocks") > 1)
    linked = codes_of(changes, [
        ("CHANGE_LEDGER_ENTRY_MISSING", (of == 1) | ((of == 3) & (~keyed | (F.col("_blank") > 0)))),
        ("CHANGE_LEDGER_BLOCK_LINK_MISMATCH", keyed & (of == 3) & (other_block | F.coalesce(apart("_done", "_entered"), F.lit(False)))),
        ("CHANGE_LEDGER_SCOPE_MISMATCH", of != 3),
    ])
    return union_all([run_codes, late, unlinked, linked]).distinct().withColumnRenamed("code", "failure_code")


def applied_transformations(ledger: DataFrame) -> DataFrame:
    """The changes of each block, long form (one row per run, block and change)."""
    return ledger.select("run_id", "block_id", "block_version", "change_id").distinct()


def transformation_summary(ledger: DataFrame) -> DataFrame:
    """Number of distinct changes per run and block."""
    return applied_transformations(ledger).groupBy("run_id", "block_id", "block_version").agg(F.count("*").alias("n_changes"))


# --- fixed values: declaration kinds -> (rank, dependency type, origin) ---
DECLARATIONS = {
    "RETAINED_PIXELS": (0, "RETAINED_SOURCE_PIXELS", "SOURCE"),
    "OCR_TEXT": (1, "OCR_DERIVED_TEXT", "SOURCE"),
    "SOURCE_LAYOUT": (2, "SOURCE_DERIVED_LAYOUT", "SOURCE"),
    "RETAINED_METADATA": (3, "RETAINED_SOURCE_METADATA", "SOURCE"),
    "BUNDLED_ASSET": (4, "BUNDLED_ASSET", "BUNDLED"),
    "RENDERER_PRIMITIVE": (5, "RENDERER_GENERATED_PRIMITIVE", "GENERATED"),
    "USER_DECISION": (6, "USER_DECISION", "USER_DECISION"),
}


def dependency_map(declarations: DataFrame, revisions: DataFrame) -> DataFrame:
    """Typed lineage rows of every document plus one row for its revision.

    declarations(doc_id, declaration, ordinal, block_id, region_id, decision_id); ids carry the
    declaration's rank and ordinal, so they need no numbering window over a document.
    """
    rank = code_map({k: str(v[0]) for k, v in DECLARATIONS.items()})[F.col("declaration")].cast("int")
    once = declarations.where("declaration <> 'USER_DECISION'").unionByName(
        declarations.where("declaration = 'USER_DECISION'").groupBy("doc_id", "declaration", "decision_id").agg(
            F.min("ordinal").alias("ordinal"), F.first("block_id").alias("block_id"), F.first("region_id").alias("region_id")
        ).select(*declarations.columns)
    )
    rows = once.join(revisions.select("doc_id", "revision"), "doc_id").select(
        "doc_id", "revision", rank.alias("rank"), "ordinal", "block_id", "region_id", "decision_id",
        code_map({k: v[1] for k, v in DECLARATIONS.items()})[F.col("declaration")].alias("type"),
        code_map({k: v[2] for k, v in DECLARATIONS.items()})[F.col("declaration")].alias("origin"),
    )
    none = F.lit(None).cast("string")
    last = revisions.select(
        "doc_id", "revision", F.lit(7).alias("rank"), F.lit(0).cast("long").alias("ordinal"), none.alias("block_id"), none.alias("region_id"),
        none.alias("decision_id"), F.lit("CANONICAL_DOCUMENT_REVISION").alias("type"), F.lit("CANONICAL_DOCUMENT").alias("origin"),
    )
    every = rows.withColumn("ordinal", F.col("ordinal").cast("long")).unionByName(last)
    return every.select(
        "doc_id", F.concat_ws("-", F.lit("imgdep"), "revision", "rank", "ordinal").alias("dependency_id"), "type", "origin", "revision",
        "block_id", "region_id", "decision_id", (F.col("type") == "RETAINED_SOURCE_PIXELS").alias("pixels_retained"),
    )


def region_policy(requests: DataFrame) -> DataFrame:
    """Disposition of every region; a request that breaks a rule carries its error and no policy.

    requests(region_id, detected_class, requested_policy, decision_id, replacement_asset).
    """
    cls, wanted = F.col("detected_class"), F.col("requested_policy")
    chosen = F.coalesce(wanted, F.when(cls == "TEXT", F.lit("REBUILD_FROM_STRUCTURED_DATA")).when(cls == "UNKNOWN", F.lit("SOLID_REDACT")))
    df = requests.withColumn("_p", chosen)
    p = F.col("_p")
    retains = p == "RETAIN_SOURCE_PIXELS"
    rebuilds = p == "REBUILD_FROM_STRUCTURED_DATA"
    error = (
        F.when(p.isNull(), F.lit("EXPLICIT_DISPOSITION_REQUIRED"))
        .when((cls == "TEXT") & ~p.isin("REBUILD_FROM_STRUCTURED_DATA", "SOLID_REDACT", "REMOVE"), F.lit("TEXT_PIXELS_NOT_RETAINABLE"))
        .when((cls == "UNKNOWN") & retains, F.lit("UNKNOWN_REGION_NOT_RETAINABLE"))
        .when(retains & F.col("decision_id").isNull(), F.lit("RETENTION_REQUIRES_DECISION"))
        .when((p == "REPLACE_WITH_PLACEHOLDER") & F.col("replacement_asset").isNull(), F.lit("PLACEHOLDER_REQUIRES_ASSET"))
    )
    review = (cls == "UNKNOWN") | retains | (rebuilds & F.col("decision_id").isNull()) | ((cls == "TEXT") & ~rebuilds)
    good = F.col("error").isNull()
    return df.withColumn("error", error).select(
        "region_id", F.when(good, p).alias("policy"), F.when(good, retains).alias("pixels_retained"),
        F.when(good, review).alias("review_required"),
        F.when(good, retains | (rebuilds & F.col("decision_id").isNotNull())).alias("user_approved"), "error",
    )


def unresolved_findings(findings: DataFrame, decision_links: DataFrame, runs: DataFrame) -> DataFrame:
    """Decision-needing findings without an approved decision at the run's revision.

    decision_links(run_id, finding_id, status, canonical_revision); runs(run_id, bundle_revision).
    """
    approved = decision_links.where("status = 'APPROVED'").join(runs.select("run_id", "bundle_revision"), "run_id")
    approved = approved.where("canonical_revision = bundle_revision").select("run_id", "finding_id")
    return findings.where("requires_decision").select("run_id", "finding_id").distinct().join(approved, ["run_id", "finding_id"], "left_anti")


def document_integrity(blocks: DataFrame, reading_order: DataFrame, url_tokens: DataFrame, regions: DataFrame, decisions: DataFrame) -> DataFrame:
    """Repeated ids, reading order against the block set, dangling URL, region and decision references.

    blocks(doc_id, block_id, url_token_id, region_id); reading_order(doc_id, ordinal, block_id);
    url_tokens(doc_id, token_id); regions(doc_id, region_id, decision_id); decisions(doc_id, decision_id).
    """
    key = "doc_id"

    def compared(left: DataFrame, left_id: str, right: DataFrame, right_id: str) -> DataFrame:
        """(doc_id, _id, left, right): how often each id stands on either side, from one aggregation."""
        one, none = F.lit(1), F.lit(0)
        sides = left.select(key, F.col(left_id).alias("_id"), one.alias("left"), none.alias("right")).unionByName(
            right.select(key, F.col(right_id).alias("_id"), none.alias("left"), one.alias("right")))
        return sides.groupBy(key, "_id").agg(F.sum("left").alias("left"), F.sum("right").alias("right"))

    def referred(df: DataFrame, column: str, target: DataFrame, target_column: str, missing: str, twice: str | None = None) -> DataFrame:
        rules = [(missing, F.col("_id").isNotNull() & (F.col("left") > 0) & ((F.col("right") == 0) | F.col(key).isNull()))]
        if twice:
            rules.append((twice, F.col("right") > 1))
        return codes_of(compared(df, column, target, target_column), rules, key=key)

    parts = [
        codes_of(compared(blocks, "block_id", reading_order, "block_id"), [
            ("DUPLICATE_BLOCK_ID", F.col("left") > 1),
            ("DUPLICATE_READING_ORDER_ENTRY", F.col("right") > 1),
            ("READING_ORDER_BLOCK_SET_MISMATCH", (F.col("left") > 0) != (F.col("right") > 0)),
        ], key=key),
        referred(blocks, "url_token_id", url_tokens, "token_id", "URL_TOKEN_REFERENCE_MISSING", "DUPLICATE_URL_TOKEN"),
        referred(blocks, "region_id", regions, "region_id", "REGION_REFERENCE_MISSING", "DUPLICATE_REGION_ID"),
        referred(regions, "decision_id", decisions, "decision_id", "DECISION_REFERENCE_MISSING"),
    ]
    return union_all(parts).distinct().withColumnRenamed("code", "failure_code")


def rebuild_suggestion(evidence: DataFrame) -> DataFrame:
    """The proposed kind with structural evidence, otherwise a plain flow that needs review."""
    have = F.col("evidence_available")
    return evidence.select(
        "region_id", F.when(have, F.col("proposed_kind")).otherwise(F.lit("PLAIN_TEXT_FLOW")).alias("kind"),
        "confidence", (~have).alias("review_required"),
    )
