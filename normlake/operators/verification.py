"""Verification of outputs (V01-V19): one row per run with status, summary code and failure codes.

``runs`` always has one row per run. Evidence arrives as long tables; a missing evidence row is NOT_RUN,
never PASS.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from normlake.dims import catalog as cat
from normlake.operators import needles
from normlake.operators import text_findings as fnd
from normlake.operators import text_transform as tt
from normlake.operators import urls
from normlake.session import ensure_checkpoint_dir
from normlake.operators.common import apart, code_map, coded, codes_of, judged, linked_codes, ranges, union_all, unmatched, verdict

_SATISFIED = ("PASS", "PASS_WITH_DECLARED_RESIDUAL", "NOT_APPLICABLE")
_IMAGE_MODES = ("REBUILT_IMAGE", "BOTH", "DERIVATIVE_IMAGE")


def _mode(*modes: str) -> Column:
    return F.col("output_mode").isin(*modes)


def _flag(df: DataFrame, name: str) -> DataFrame:
    return df.select("run_id").distinct().withColumn(name, F.lit(True))


# ------------------------------------------------------------------------------------------------ V01
_STRETCH = 1024  # positions of a run that are sorted together


def _manifest_shape(manifest: DataFrame) -> DataFrame:
    """(run_id, n, low, high, top, twice, falling) of each manifest, from one shuffle and one sort.

    ``twice``: a position is taken more than once; ``falling``: some block's revision is not below one of the next position.
    The first position of a stretch is also the last of the stretch before, there only as a neighbour.
    """
    at = F.floor(F.col("seq") / _STRETCH)
    places = F.when(F.col("seq") % _STRETCH == 0, F.array(at, at - 1)).otherwise(F.array(at))
    rows = manifest.select("run_id", "seq", F.col("execution_revision").alias("rev"), F.posexplode(places).alias("_copy", "_at"))
    order = Window.partitionBy("run_id", "_at").orderBy("seq")
    seen = rows.select(
        "run_id", "seq", "rev", "_copy", F.count("*").over(order.rangeBetween(0, 0)).alias("_same"),
        F.when(F.col("seq").isNotNull(), F.min("rev").over(order.rangeBetween(1, 1))).alias("_next"),
    ).where("_copy = 0")
    return seen.groupBy("run_id").agg(
        F.count("*").alias("n"), F.min("seq").alias("low"), F.max("seq").alias("high"), F.max("rev").alias("top"),
        F.max(F.col("_same") > 1).alias("twice"), F.max(F.col("rev") >= F.col("_next")).alias("falling"),
    )


def manifest_audit(manifest: DataFrame, runs: DataFrame, presets: DataFrame, preset_blocks: DataFrame, catalog: DataFrame) -> DataFrame:
    """Executed blocks against the preset's prefix before the persist block.

    manifest(run_id, seq, block_id, block_version, execution_revision); runs(run_id, preset_id,
    workflow_version, input_kind, output_mode, execution_revision). Neighbours in a manifest are found in one sort of
    stretches of (run, position), so one long run spreads over tasks.
    """
    p = presets.select("preset_id", F.col("preset_version").alias("_pv"), F.col("input_kind").alias("_pk"), F.col("output_mode").alias("_pm"))
    heads = codes_of(runs.join(F.broadcast(p), "preset_id"), [
        ("WORKFLOW_VERSION_MISMATCH", F.col("workflow_version") != F.col("_pv")),
        ("PRESET_INPUT_KIND_MISMATCH", F.col("input_kind") != F.col("_pk")),
        ("PRESET_OUTPUT_MODE_MISMATCH", F.col("output_mode") != F.col("_pm")),
    ])
    cut = preset_blocks.where("block_id = 'PST-002'").groupBy("preset_id").agg(F.min("seq").alias("_cut"))
    prefix = preset_blocks.join(cut, "preset_id", "left").where("_cut IS NULL OR seq < _cut")
    lengths = prefix.groupBy("preset_id").agg(F.count("*").alias("_want"))
    shape = _manifest_shape(manifest)
    sized = runs.join(shape, "run_id", "left").join(F.broadcast(lengths), "preset_id", "left")
    sized = sized.withColumn("n", F.coalesce("n", F.lit(0)))
    counts = codes_of(sized, [
        ("MANIFEST_ORDER_NOT_CONTIGUOUS", (F.col("n") > 0) & ((F.col("low") != 0) | (F.col("high") != F.col("n") - 1) | F.col("twice"))),
        ("MANIFEST_FUTURE_EXECUTION_REVISION", F.col("top") > F.col("execution_revision")),
        ("MANIFEST_BLOCK_COUNT_MISMATCH", F.col("n") != F.coalesce("_want", F.lit(0))),
        ("MANIFEST_EXECUTION_REVISION_ORDER_INVALID", F.col("falling")),
    ])
    expected = F.broadcast(prefix.select("preset_id", "seq", F.col("block_id").alias("_b"), F.col("block_version").alias("_v")))
    paired = manifest.join(runs.select("run_id", "preset_id"), "run_id").join(expected, ["preset_id", "seq"])
    pairs = codes_of(paired, [
        ("MANIFEST_BLOCK_ORDER_MISMATCH", F.col("block_id") != F.col("_b")),
        ("MANIFEST_BLOCK_VERSION_MISMATCH", F.col("block_version") != F.col("_v")),
    ])
    known = manifest.join(F.broadcast(catalog.select("block_id", F.col("block_version").alias("_known"))), "block_id", "left")
    unknown = codes_of(known, [
        ("MANIFEST_UNKNOWN_BLOCK", F.col("_known").isNull()),
        ("MANIFEST_UNKNOWN_BLOCK_VERSION", F.col("_known") != F.col("block_version")),
    ])
    return verdict(runs, union_all([heads, counts, pairs, unknown]), "EXECUTED_BLOCK_MANIFEST", "EXECUTED_MANIFEST_VALID", "EXECUTED_MANIFEST_INVALID")


# ------------------------------------------------------------------------------------------------ V02
def revision_audit(
    runs: DataFrame, document_decisions: DataFrame, decisions: DataFrame, context_changes: DataFrame, ledger: DataFrame,
    context_artifacts: DataFrame, artifacts: DataFrame, reopened: DataFrame, manifest: DataFrame, catalog: DataFrame,
    structural_failures: DataFrame, review_audits: DataFrame,
) -> DataFrame:
    """All revisions and links meet at the document's revision; pending reviews come after.

    runs(run_id, document_revision, bundle_revision, ledger_revision, ledger_id, document_ledger_id,
    artifact_revision, dependency_maps_equal). Other tables are (run_id, id, ...) lists.
    """
    heads = codes_of(runs, [
        ("BUNDLE_CANONICAL_REVISION_MISMATCH", F.col("bundle_revision") != F.col("document_revision")),
        ("CHANGE_LEDGER_REVISION_MISMATCH", F.col("ledger_revision") != F.col("document_revision")),
        ("CHANGE_LEDGER_REFERENCE_MISMATCH", ~F.col("ledger_id").eqNullSafe(F.col("document_ledger_id"))),
        ("CONTEXT_DEPENDENCY_MAP_MISMATCH", ~F.col("dependency_maps_equal")),
    ])
    approved = decisions.where("status = 'APPROVED'")
    links = linked_codes([
        ("CANONICAL_DECISION_LINK_MISMATCH", "decision_id", approved, document_decisions, False),
        ("CONTEXT_CHANGE_LEDGER_MISMATCH", "change_id", context_changes, ledger, True),
        ("CONTEXT_OUTPUT_BUNDLE_MISMATCH", "artifact_id", context_artifacts, artifacts, True),
    ])
    # What is compared with a number of the run is its smallest and largest in the run; all of them meet in one aggregation.
    transforming = manifest.join(F.broadcast(catalog.where("transforming").select("block_id").distinct()), "block_id", "left_semi")
    met = ranges([
        (runs, {"_doc": "document_revision", "_own": "artifact_revision"}),
        (artifacts, {"_art": "canonical_revision"}),
        (reopened, {"_again": "canonical_revision", "_reopened": "artifact_revision"}),
        (manifest.where(F.col("block_id").startswith("VER-")), {"_verified": "seq"}),
        (transforming, {"_moved": "seq"}),
    ])
    meeting = codes_of(met, [
        ("ARTIFACT_CANONICAL_REVISION_MISMATCH", apart("_art", "_doc")),
        ("REOPENED_CANONICAL_REVISION_MISMATCH", apart("_again", "_doc")),
        ("REOPENED_ARTIFACT_REVISION_MISMATCH", apart("_reopened", "_own")),
        ("POST_VERIFICATION_TRANSFORMATION", F.col("_moved_high") > F.col("_verified_low")),
    ])
    structural = structural_failures.select("run_id", F.col("failure_code").alias("code"))
    out = verdict(runs, union_all([heads, links, meeting, structural]),
                  "CANONICAL_REVISION_LINK", "CANONICAL_REVISION_LINK_VALID", "REVISION_LINK_AUDIT_FAILED")
    pending = _flag(review_audits.where("status = 'REVIEW_REQUIRED'"), "_pending")
    out = out.join(pending, "run_id", "left")
    waiting = (F.col("status") == "PASS") & F.coalesce("_pending", F.lit(False))
    return out.withColumn("summary_code", F.when(waiting, F.lit("REQUIRED_REVIEW_INCOMPLETE")).otherwise(F.col("summary_code"))).withColumn(
        "status", F.when(waiting, F.lit("REVIEW_REQUIRED")).otherwise(F.col("status"))
    ).drop("_pending")


# ------------------------------------------------------------------------------------------ V03 - V05
def _provider(runs: DataFrame, evidence: DataFrame) -> tuple[DataFrame, list[tuple[Column, str, str]]]:
    """Runs with the terminal state of an evidence table (run_id, outcome): none, error or not run."""
    seen = evidence.groupBy("run_id").agg(
        F.count("*").alias("_seen"), F.count_if(F.col("outcome") == "ERROR").alias("_err"), F.count_if(F.col("outcome") == "NOT_RUN").alias("_not")
    )
    df = runs.join(seen, "run_id", "left")
    return df, [
        (F.col("_seen").isNull(), "NOT_RUN", "APPLICABLE_PROVIDER_EVIDENCE_MISSING"),
        (F.col("_err") > 0, "ERROR", "PROVIDER_EXECUTION_ERROR"),
        (F.col("_not") > 0, "NOT_RUN", "PROVIDER_NOT_CONFIGURED"),
    ]


def reopen_digest_audit(runs: DataFrame, artifacts: DataFrame, reopened: DataFrame) -> DataFrame:
    """Recomputed digest, size, MIME, revisions, location and exact text of every artifact.

    artifacts(run_id, artifact_id, content_digest, byte_count, mime_type, artifact_revision,
    canonical_revision, canonical_text); reopened(run_id, artifact_id, payload, digest, mime_type,
    artifact_revision, canonical_revision, private_location, outcome).
    """
    r = reopened.select("run_id", "artifact_id", *[F.col(c).alias(f"_{c}") for c in ("payload", "digest", "mime_type", "artifact_revision", "canonical_revision", "private_location", "outcome")])
    df = artifacts.join(r, ["run_id", "artifact_id"], "left")
    done = F.col("_outcome") == "COMPLETED"
    actual = F.sha2("_payload", 256)
    failures = codes_of(df.where(done), [
        ("REOPEN_DIGEST_MISMATCH", (actual != F.col("content_digest")) | (actual != F.col("_digest"))),
        ("REOPEN_BYTE_COUNT_MISMATCH", F.octet_length("_payload") != F.col("byte_count")),
        ("REOPEN_MIME_MISMATCH", F.col("_mime_type") != F.col("mime_type")),
        ("REOPEN_ARTIFACT_REVISION_MISMATCH", F.col("_artifact_revision") != F.col("artifact_revision")),
        ("REOPEN_CANONICAL_REVISION_MISMATCH", F.col("_canonical_revision") != F.col("canonical_revision")),
        ("ARTIFACT_LOCATION_NOT_PRIVATE", ~F.col("_private_location")),
        ("TEXT_EXACT_REPRESENTATION_MISMATCH", F.col("canonical_text").isNotNull() & (F.encode("canonical_text", "UTF-8") != F.col("_payload"))),
    ])
    evidence = df.select("run_id", F.coalesce("_outcome", F.lit("NOT_RUN")).alias("outcome"))
    staged, skip = _provider(runs, evidence)
    return verdict(staged, failures, "PERSISTENT_REOPEN_AND_DIGEST", "EXACT_REOPEN_AND_DIGEST_PASSED", "EXACT_REOPEN_AND_DIGEST_FAILED", skip=skip)


def container_policy_audit(runs: DataFrame, inspections: DataFrame, codes: DataFrame, allowed: DataFrame, max_thumbnails: int = 0) -> DataFrame:
    """Container facts against allow-lists.

    inspections(run_id, outcome, artifact_revision, mime_type, decodes, thumbnails, channel_model,
    alpha_model, colour_profile); codes(run_id, kind, code) are metadata fields and chunks;
    allowed(kind, code) lists MIME, METADATA, CHUNK, CHANNEL, ALPHA and PROFILE values (a small policy table).
    """
    df = inspections.join(runs.select("run_id", F.col("artifact_revision").alias("_ar")), "run_id").where("outcome = 'COMPLETED'")
    simple = codes_of(df, [
        ("IMAGE_INSPECTION_REVISION_MISMATCH", F.col("artifact_revision") != F.col("_ar")),
        ("INDEPENDENT_IMAGE_DECODE_FAILED", ~F.col("decodes")),
        ("EMBEDDED_THUMBNAIL_NOT_ALLOWED", F.col("thumbnails") > max_thumbnails),
    ])
    listed = df.select("run_id", F.explode(F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.col(column).alias("value")) for kind, column in
        (("MIME", "mime_type"), ("CHANNEL", "channel_model"), ("ALPHA", "alpha_model"), ("PROFILE", "colour_profile"))
    ])).alias("v")).select("run_id", "v.kind", F.col("v.value").alias("code"))
    outside = listed.unionByName(codes.select("run_id", "kind", "code")).join(allowed, ["kind", "code"], "left_anti")
    names = code_map({"MIME": "IMAGE_MIME_NOT_ALLOWED", "METADATA": "UNEXPECTED_IMAGE_METADATA", "CHUNK": "UNEXPECTED_CONTAINER_CHUNK",
                      "CHANNEL": "CHANNEL_MODEL_NOT_ALLOWED", "ALPHA": "ALPHA_MODEL_NOT_ALLOWED", "PROFILE": "COLOUR_PROFILE_NOT_ALLOWED"})
    failures = simple.unionByName(coded(outside, names[F.col("kind")]))
    staged, skip = _provider(runs, inspections)
    skip = [(_mode("TEXT"), "NOT_APPLICABLE", "IMAGE_METADATA_NOT_APPLICABLE")] + skip
    return verdict(staged, failures, "FINAL_METADATA", "FINAL_CONTAINER_POLICY_PASSED", "FINAL_CONTAINER_POLICY_FAILED", ~_mode("TEXT"), skip)


def ocr_round_trip_audit(runs: DataFrame, recognised: DataFrame, recognised_order: DataFrame, reading_order: DataFrame, differences: DataFrame) -> DataFrame:
    """Recognised text and order equal the approved ones.

    runs(run_id, output_mode, approved_text, artifact_revision); recognised(run_id, text, artifact_revision,
    outcome); orders are (run_id, ordinal, block_id); differences(run_id, code).
    """
    at = runs.select("run_id", "approved_text", F.col("artifact_revision").alias("_ar"))
    failures = union_all([
        codes_of(recognised.where("outcome = 'COMPLETED'").join(at, "run_id"), [
            ("OCR_REVISION_MISMATCH", F.col("artifact_revision") != F.col("_ar")),
            ("OCR_TEXT_DIVERGENCE", F.col("text") != F.col("approved_text")),
        ]),
        coded(unmatched(recognised_order, reading_order, ["run_id", "ordinal", "block_id"]), "OCR_READING_ORDER_DIVERGENCE"),
        coded(differences, "OCR_CLASSIFIED_DIFFERENCE_PRESENT"),
    ])
    rebuilt = _mode("REBUILT_IMAGE", "BOTH")
    staged, skip = _provider(runs, recognised)
    skip = [(~rebuilt, "NOT_APPLICABLE", "OCR_ROUND_TRIP_NOT_APPLICABLE"), (F.col("approved_text").isNull(), "NOT_RUN", "APPROVED_TEXT_NOT_AVAILABLE")] + skip
    return verdict(staged, failures, "OCR_ROUND_TRIP", "OCR_ROUND_TRIP_PASSED", "OCR_ROUND_TRIP_FAILED", rebuilt, skip)


# ------------------------------------------------------------------------------------------ V06 - V08
def final_unicode_audit(runs: DataFrame, final_texts: DataFrame, approved_codes: list[str], allowed_scripts: tuple[str, ...] = ()) -> DataFrame:
    """The inspection again on the final text; every finding title must be on the approved list.

    runs(run_id, output_mode, approved_text); final_texts(run_id, text).
    """
    texts = final_texts.join(runs.select("run_id", "approved_text"), "run_id").withColumnRenamed("run_id", "source_id")
    seen = fnd.inspect(texts, allowed_scripts).withColumnRenamed("source_id", "run_id")
    titles = F.transform("findings", lambda f: f["title"])
    failures = codes_of(seen, [
        ("FINAL_TEXT_NOT_APPROVED_TEXT", F.col("text") != F.col("approved_text")),
        ("FINAL_UNICODE_SCALAR_FAILURE", (F.size("controls") > 0) | ~F.is_valid_utf8("text")),
        ("FINAL_UNICODE_SCALAR_REPARSE_MISMATCH", F.array_join(F.split("text", ""), "") != F.col("text")),
        ("UNAPPROVED_FINAL_UNICODE_FINDING", F.exists(titles, lambda t: ~t.isin(*approved_codes)) if approved_codes else F.size(titles) > 0),
    ])
    have = _flag(final_texts, "_have")
    skip = [
        (_mode("DERIVATIVE_IMAGE"), "NOT_APPLICABLE", "FINAL_UNICODE_NOT_APPLICABLE"),
        (F.col("approved_text").isNull(), "NOT_RUN", "APPROVED_TEXT_NOT_AVAILABLE"),
        (F.col("_have").isNull(), "NOT_RUN", "FINAL_TEXT_REPRESENTATION_NOT_AVAILABLE"),
    ]
    return verdict(runs.join(have, "run_id", "left"), failures, "FINAL_UNICODE", "FINAL_UNICODE_RESCAN_PASSED", "FINAL_UNICODE_RESCAN_FAILED", ~_mode("DERIVATIVE_IMAGE"), skip)


def final_url_audit(runs: DataFrame, final_texts: DataFrame, tokens: DataFrame) -> DataFrame:
    """URLs of the final text against the expected tokens, position by position.

    tokens(run_id, ordinal, final_text, scheme, userinfo, host, port, path_segments, query, fragment).
    """
    parts = list(urls._PARTS)
    found = urls.parse_url_components(urls.url_candidates(final_texts.withColumnRenamed("run_id", "source_id")))
    found = found.select(
        F.col("source_id").alias("run_id"), F.regexp_extract("token_id", r"-([0-9]+)$", 1).cast("long").alias("ordinal"),
        F.col("target").alias("_target"), F.col("failure").alias("_failure"), F.struct(*parts).alias("_have"), F.lit(True).alias("_found"),
    )
    want = tokens.where(~F.col("final_text").rlike(r"^\s*$")).select(
        "run_id", F.col("ordinal").cast("long").alias("ordinal"), "final_text", F.struct(*parts).alias("_want"), F.lit(True).alias("_expected"))
    both = found.join(want, ["run_id", "ordinal"], "full")
    pair = F.col("_found").isNotNull() & F.col("_expected").isNotNull()
    parsed = pair & F.col("_failure").isNull()
    steady = urls.serialize(*[F.col(f"_want.{p}") for p in parts])
    failures = codes_of(both, [
        ("FINAL_URL_COUNT_MISMATCH", ~pair),
        ("FINAL_URL_PARSE_FAILED", pair & F.col("_failure").isNotNull()),
        ("FINAL_URL_COMPONENT_MISMATCH", parsed & ~F.col("_have").eqNullSafe(F.col("_want"))),
        ("FINAL_URL_SERIALIZATION_MISMATCH", parsed & (F.col("_target") != F.col("final_text"))),
        ("FINAL_URL_REPARSE_UNSTABLE", parsed & (steady != F.col("final_text"))),
        ("UNAPPROVED_FINAL_URL", F.col("_expected").isNull() & F.col("_failure").isNull()),
    ])
    skip = [
        (_mode("DERIVATIVE_IMAGE"), "NOT_APPLICABLE", "FINAL_URL_NOT_APPLICABLE"),
        (F.col("_have").isNull(), "NOT_RUN", "FINAL_TEXT_REPRESENTATION_NOT_AVAILABLE"),
    ]
    staged = runs.join(_flag(final_texts, "_have"), "run_id", "left")
    return verdict(staged, failures, "FINAL_URL", "FINAL_URL_RESCAN_PASSED", "FINAL_URL_RESCAN_FAILED", ~_mode("DERIVATIVE_IMAGE"), skip)


def canary_search(surfaces: DataFrame, canaries: DataFrame) -> DataFrame:
    """(surface_id, canary_id) for every canary that occurs in a surface, at any position; see :mod:`needles`."""
    found = needles.find(surfaces, canaries.select(F.col("canary_id").alias("needle"), "secret"))
    return found.select("surface_id", F.col("needle").alias("canary_id"))


def source_reference_audit(runs: DataFrame, surfaces: DataFrame, canaries: DataFrame, facts: DataFrame) -> DataFrame:
    """V08 as a verdict: canaries in any surface of a run, and five facts about what leaves the run.

    surfaces(run_id, surface_id, payload); facts(run_id, outcome, private_root, mime_matches, digest_matches,
    uri_scoped, least_privilege).
    """
    leaked = canary_search(surfaces, canaries).select("surface_id").distinct()
    failures = union_all([
        coded(surfaces.join(leaked, "surface_id", "left_semi"), "REFERENCE_CANARY_DETECTED"),
        codes_of(facts.where("outcome = 'COMPLETED'"), [
            ("ARTIFACT_ROOT_NOT_PRIVATE", ~F.col("private_root")),
            ("OUTGOING_MIME_MISMATCH", ~F.col("mime_matches")),
            ("OUTGOING_DIGEST_MISMATCH", ~F.col("digest_matches")),
            ("OUTGOING_URI_SCOPE_INVALID", ~F.col("uri_scoped")),
            ("TEMPORARY_PERMISSION_SCOPE_INVALID", ~F.col("least_privilege")),
        ]),
    ])
    staged, skip = _provider(runs, facts)
    return verdict(staged, failures, "SOURCE_REFERENCE", "SOURCE_REFERENCE_AUDIT_PASSED", "SOURCE_REFERENCE_AUDIT_FAILED", skip=skip)


# ------------------------------------------------------------------------------------------ V09 - V11
def dependency_audit(
    runs: DataFrame, actual: DataFrame, expected: DataFrame, exercised: DataFrame, regions: DataFrame,
    operations: DataFrame, limitations: DataFrame, artifact_maps: DataFrame | None = None, inspections: DataFrame | None = None,
) -> DataFrame:
    """Lineage equals what was declared.

    actual / expected(run_id, type, block_id, region_id, decision_id); exercised(run_id, type);
    regions(run_id, region_id, pixels_retained); operations(run_id, region_id) touched source pixels;
    limitations(run_id, code); artifact_maps like actual, one set per artifact.
    """
    flat = lambda df: df.select("run_id", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("type", "block_id", "region_id", "decision_id")])
    keys = ["run_id", "type", "block_id", "region_id", "decision_id"]
    mapped = actual.where("type = 'RETAINED_SOURCE_PIXELS' AND region_id IS NOT NULL").select("run_id", "region_id")
    kept = regions.where("pixels_retained").select("run_id", "region_id")
    declared = _flag(limitations, "_limited")
    parts = [
        coded(unmatched(flat(actual), flat(expected), keys), "DEPENDENCY_EXPECTATION_MISMATCH"),
        coded(exercised.join(actual.select("run_id", "type"), ["run_id", "type"], "left_anti"), "EXERCISED_DEPENDENCY_TYPE_MISSING"),
        coded(runs.join(declared, "run_id", "left_anti"), "PLATFORM_DEPENDENCY_LIMITATION_UNDECLARED"),
        coded(unmatched(mapped, kept, ["run_id", "region_id"]), "RETAINED_REGION_POLICY_MAP_MISMATCH"),
        coded(unmatched(operations, mapped, ["run_id", "region_id"]), "SOURCE_PIXEL_OPERATION_UNDECLARED"),
    ]
    if artifact_maps is not None:
        parts.append(coded(unmatched(flat(artifact_maps), flat(actual), keys), "ARTIFACT_DEPENDENCY_MAP_MISMATCH"))
    staged, skip = (_provider(runs, inspections) if inspections is not None else (runs, []))
    skip = [(_mode("TEXT"), "NOT_APPLICABLE", "PIXEL_DEPENDENCY_NOT_APPLICABLE")] + skip
    out = verdict(staged, union_all(parts), "SOURCE_PIXEL_DEPENDENCY", "SOURCE_DEPENDENCY_SCOPE_PASSED", "SOURCE_DEPENDENCY_AUDIT_FAILED", ~_mode("TEXT"), skip)
    out = out.join(declared, "run_id", "left")
    residual = (F.col("status") == "PASS") & F.col("_limited")
    return out.withColumn("status", F.when(residual, F.lit("PASS_WITH_DECLARED_RESIDUAL")).otherwise(F.col("status"))).drop("_limited")


def machine_code_audit(runs: DataFrame, decoded: DataFrame, approved: DataFrame, inspections: DataFrame) -> DataFrame:
    """Decoded codes (run_id, value) equal the approved set; inspections(run_id, artifact_revision, outcome)."""
    at = runs.select("run_id", F.col("artifact_revision").alias("_ar"))
    failures = union_all([
        coded(unmatched(decoded, approved, ["run_id", "value"]), "MACHINE_READABLE_CODE_MISMATCH"),
        coded(inspections.join(at, "run_id"), "BARCODE_REVISION_MISMATCH", F.col("artifact_revision") != F.col("_ar")),
    ])
    applies = _mode(*_IMAGE_MODES) & F.col("strict_profile")
    staged, skip = _provider(runs, inspections)
    skip = [(~applies, "NOT_APPLICABLE", "BARCODE_RESCAN_NOT_APPLICABLE")] + skip
    return verdict(staged, failures, "MACHINE_READABLE_CODE", "MACHINE_READABLE_CODE_RESCAN_PASSED", "MACHINE_READABLE_CODE_RESCAN_FAILED", applies, skip)


def region_coverage_audit(runs: DataFrame, terminal: DataFrame, declared: DataFrame, inspections: DataFrame) -> DataFrame:
    """Terminal policy of every region (run_id, region_id, policy) equals the declared one."""
    at = runs.select("run_id", F.col("artifact_revision").alias("_ar"))
    failures = union_all([
        coded(unmatched(terminal, declared, ["run_id", "region_id", "policy"]), "REGION_TERMINAL_POLICY_MISMATCH"),
        coded(inspections.join(at, "run_id"), "REGION_COVERAGE_REVISION_MISMATCH", F.col("artifact_revision") != F.col("_ar")),
    ])
    staged, skip = _provider(runs, inspections)
    skip = [(_mode("TEXT"), "NOT_APPLICABLE", "REGION_COVERAGE_NOT_APPLICABLE")] + skip
    return verdict(staged, failures, "VISUAL_REGION_COVERAGE", "VISUAL_REGION_COVERAGE_PASSED", "VISUAL_REGION_COVERAGE_FAILED", ~_mode("TEXT"), skip)


# ------------------------------------------------------------------------------------------------ V12
def idempotence_audit(sources: DataFrame, **policy) -> DataFrame:
    """A second pass over the canonical text, all gates approved, changes nothing.

    The first pass gives the approved text, written once so that the second pass starts from stored rows. Output per source: second text equal
    and number of second-pass changes.
    """
    everything = F.array(*[F.lit(c) for c in fnd.REVIEW_BLOCK])
    first = tt.canonical_stages(_approving(sources, everything), None, **policy)
    ensure_checkpoint_dir(sources.sparkSession)
    second_in = first.select("source_id", F.col("canonical").alias("text"), "source_kind").checkpoint()
    second = tt.canonical_stages(_approving(second_in, everything), None, **policy)
    changed = F.lit(0)
    for k in range(1, 7):
        changed = changed + F.size(F.filter(F.zip_with(f"v{k - 1}", f"v{k}", lambda a, b: a != b), lambda d: d))
    return second.select(
        "source_id", (F.col("canonical") == F.col("text")).alias("text_same"), changed.alias("change_count"),
        F.when((F.col("canonical") == F.col("text")) & (changed == 0), F.lit("PASS")).otherwise(F.lit("FAIL")).alias("status"),
    )


def _approving(sources: DataFrame, codes: Column) -> DataFrame:
    return sources.withColumn("approved_codes", codes)


# ------------------------------------------------------------------------------------------ V13 - V17
def runtime_facts_audit(runs: DataFrame, facts: DataFrame) -> DataFrame:
    """Eight facts about egress, permissions and cleanup."""
    failures = codes_of(facts.where("outcome = 'COMPLETED'"), [
        ("NETWORK_EVIDENCE_NOT_CAPTURED", ~F.col("network_evidence_captured")),
        ("NETWORK_ATTEMPT_DETECTED", F.col("network_attempt_count") != 0),
        ("MODEL_DOWNLOAD_ATTEMPT_DETECTED", F.col("model_download_count") != 0),
        ("INTERNET_PERMISSION_PRESENT", F.col("internet_permission")),
        ("BROAD_STORAGE_PERMISSION_PRESENT", F.col("broad_storage_permission")),
        ("APP_PRIVATE_STORAGE_NOT_CONFIRMED", ~F.col("private_root")),
        ("SESSION_CLEANUP_NOT_CONFIRMED", ~F.col("cleanup_completed")),
        ("TEMPORARY_PERMISSION_SCOPE_INVALID", ~F.col("least_privilege")),
    ])
    staged, skip = _provider(runs, facts)
    skip = [(~F.col("release_controls"), "NOT_APPLICABLE", "RELEASE_RUNTIME_CHECK_NOT_REQUIRED")] + skip
    return verdict(staged, failures, "NO_NETWORK_RUNTIME", "OFFLINE_RUNTIME_POLICY_PASSED", "OFFLINE_RUNTIME_POLICY_FAILED", F.col("release_controls"), skip)


def logging_facts_audit(runs: DataFrame, facts: DataFrame) -> DataFrame:
    """Four facts about log scans; the match count comes from canary_search over log lines."""
    failures = codes_of(facts.where("outcome = 'COMPLETED'"), [
        ("LOGGING_STATIC_SCAN_NOT_COMPLETED", ~F.col("static_scan_completed")),
        ("LOGGING_CANARY_SESSION_NOT_COMPLETED", ~F.col("canary_session_completed")),
        ("SENSITIVE_LOG_PAYLOAD_DETECTED", F.col("payload_match_count") != 0),
        ("PERSISTENT_PRODUCTION_TRACE_ENABLED", F.col("persistent_tracing")),
    ])
    staged, skip = _provider(runs, facts)
    skip = [(~F.col("release_controls"), "NOT_APPLICABLE", "LOGGING_RELEASE_AUDIT_NOT_REQUIRED")] + skip
    return verdict(staged, failures, "SENSITIVE_LOGGING", "SENSITIVE_LOGGING_AUDIT_PASSED", "SENSITIVE_LOGGING_AUDIT_FAILED", F.col("release_controls"), skip)


def assurance_classify(evidence: DataFrame) -> DataFrame:
    """Level by decision order: contradictions, preconditions, mode rules, then the ceiling.

    evidence(run_id, output_mode, ceiling, all_required_passed, failure_present, externally_edited,
    dependency_complete, retained_pixels, retained_declared, approved_document, unicode_passed, url_passed,
    ambiguities_approved, fresh_render, bundled_assets, metadata_passed, ocr_passed).
    """
    c = F.col
    contradictions = F.array_compact(F.array(
        F.when(c("retained_pixels") != c("retained_declared"), F.lit("SOURCE_PIXEL_DECLARATION_CONTRADICTION")),
        F.when(_mode("DERIVATIVE_IMAGE") & (c("ceiling") > 1), F.lit("DERIVATIVE_CEILING_CONTRADICTION")),
        F.when(_mode("TEXT") & c("retained_pixels"), F.lit("TEXT_OUTPUT_SOURCE_PIXEL_CONTRADICTION")),
        F.when(c("failure_present") & c("all_required_passed"), F.lit("VERIFICATION_STATUS_CONTRADICTION")),
    ))
    df = evidence.withColumn("contradictions", contradictions)
    blocked = ~c("all_required_passed") | c("failure_present") | c("externally_edited") | ~c("dependency_complete")
    level = (
        F.when(_mode("DERIVATIVE_IMAGE"), F.when(c("metadata_passed"), 1).otherwise(0))
        .when(_mode("TEXT"), F.when(c("approved_document") & c("unicode_passed") & c("url_passed") & c("ambiguities_approved"), 2).otherwise(0))
        .when(c("retained_pixels") & c("retained_declared") & c("metadata_passed") & c("ocr_passed"), 3)
        .when(
            ~c("retained_pixels") & c("fresh_render") & c("bundled_assets") & c("metadata_passed") & c("ocr_passed")
            & c("approved_document") & c("ambiguities_approved"), 4,
        )
        .otherwise(0)
    )
    clash = F.size("contradictions") > 0
    df = df.withColumn("_level", F.when(clash | blocked, 0).otherwise(level)).withColumn("level", F.least("_level", "ceiling"))
    reasons = (
        F.when(clash, F.array(F.lit("CONTRADICTORY_ASSURANCE_EVIDENCE")))
        .when(blocked, F.array(F.lit("REQUIRED_ASSURANCE_PRECONDITION_FAILED")))
        .otherwise(F.array_compact(F.array(
            F.lit("DETERMINISTIC_ASSURANCE_CLASSIFICATION"),
            F.when(c("level") != c("_level"), F.lit("ASSURANCE_CEILING_APPLIED")),
            F.when(c("retained_pixels"), F.lit("DECLARED_SOURCE_PIXELS_RETAINED")),
        )))
    )
    names = F.array(*[F.lit(a) for a in cat.ASSURANCE])
    return df.select("run_id", F.get(names, c("level")).alias("assurance_class"), "level", reasons.alias("reasons"), "contradictions")


def assurance_audit(runs: DataFrame, evidence: DataFrame) -> DataFrame:
    """V15 verdict: the class presented for a run must be the one its evidence gives. runs(run_id, presented)."""
    decided = assurance_classify(evidence).join(evidence.select("run_id", "ceiling", "output_mode", "all_required_passed"), "run_id")
    decided = decided.join(runs.select("run_id", "presented"), "run_id")
    failures = codes_of(decided, [
        ("ASSURANCE_EVIDENCE_CONTRADICTION", F.size("contradictions") > 0),
        ("PRESENTED_ASSURANCE_MISMATCH", F.col("presented").isNotNull() & (F.col("presented") != F.col("assurance_class"))),
        ("ASSURANCE_PRECONDITION_NOT_ESTABLISHED", F.col("all_required_passed") & (F.col("level") == 0)),
        ("ASSURANCE_CEILING_EXCEEDED", F.col("level") > F.col("ceiling")),
        ("DERIVATIVE_ASSURANCE_EXCEEDED", _mode("DERIVATIVE_IMAGE") & (F.col("level") > 1)),
    ])
    return verdict(runs, failures, "ASSURANCE_CLASSIFIER", "ASSURANCE_CLASSIFIER_CROSSCHECK_PASSED", "ASSURANCE_CLASSIFIER_CROSSCHECK_FAILED")


# --- fixed values: report labels of statuses ---
STATUS_LABELS = {
    "PASS": "passed", "PASS_WITH_DECLARED_RESIDUAL": "passed with declared limits", "FAIL": "failed", "ERROR": "error",
    "NOT_RUN": "not run", "NOT_APPLICABLE": "not applicable", "REVIEW_REQUIRED": "review required",
}


def _line(kind: Column, status: Column) -> Column:
    label = F.concat(F.upper(F.substring(kind, 1, 1)), F.lower(F.replace(F.substring(kind, 2, 100), F.lit("_"), F.lit(" "))))
    return F.concat(label, F.lit(": "), code_map(STATUS_LABELS)[status])


# Statuses and types are closed lists, so what a run has of them is numbers that hash aggregation sums in place; a maximum
# of strings would sort all rows. A mark is the bit of (type, rank), four types of fifteen ranks in each long.
_STATUSES = sorted(STATUS_LABELS)
_MARKS, _IN_ONE, _RANKS = [f"_marks{i}" for i in range(4)], 4, 2 * len(_STATUSES) + 1


def _rank(status: Column) -> Column:
    """Order of a status by its name: odd if it is a known one, even between them."""
    below = [F.when(status > s, 2).otherwise(0) for s in _STATUSES]
    return sum(below, F.when(status.isin(*_STATUSES), 1).otherwise(0))


def _marks(place: Column, rank: Column) -> list[Column]:
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (place % _IN_ONE * _RANKS + rank).cast("int"))
    return [F.when(F.floor(place / _IN_ONE) == i, bit).alias(name) for i, name in enumerate(_MARKS)]


def _status_marks(results: DataFrame) -> list[Column]:
    place = code_map({t: F.lit(i) for i, t in enumerate(cat.CHECK_TYPES)})[results["type"]]
    return _marks(place, F.when(results["status"].isNotNull(), _rank(results["status"])))


def _field(marks: str, place: int) -> Column:
    return F.shiftright(F.coalesce(marks, F.lit(0).cast("long")), place % _IN_ONE * _RANKS).bitwiseAND((1 << _RANKS) - 1)


def _highest(place: int) -> Column:
    """Rank of the last status by name that a run has of a type; null without any."""
    field = _field(_MARKS[place // _IN_ONE], place)
    return F.when(field > 0, F.length(F.bin(field)) - 1)


def _known(rank: Column) -> Column:
    return F.when(rank % 2 == 1, F.get(F.array(*[F.lit(s) for s in _STATUSES]), F.floor(rank / 2).cast("int")))


def verification_report(results: DataFrame, requested: DataFrame) -> DataFrame:
    """One row per run: a status column per type, the class after blocking checks, and report lines.

    The status of a type is the last by name; one outside the known statuses stays as it is and has no line.
    requested(run_id, level).
    """
    blocking = F.col("required") & ~F.col("status").isin(*_SATISFIED)
    wide = results.select("run_id", *_status_marks(results), blocking.alias("_blocking"), F.size("failures").alias("_failures")).groupBy("run_id").agg(
        *[F.bit_or(m).alias(m) for m in _MARKS], F.count_if("_blocking").alias("n_blocking"), F.sum("_failures").alias("n_failures"),
    )
    other = results.where(~F.col("status").isin(*_STATUSES)).groupBy("run_id").agg(
        *[F.max(F.when(F.col("type") == t, F.col("status"))).alias(f"_{t}") for t in cat.CHECK_TYPES])
    df = wide.join(requested.select("run_id", "level"), "run_id", "left").join(other, "run_id", "left")
    status = {t: F.when(_highest(i) % 2 == 0, F.col(f"_{t}")).otherwise(_known(_highest(i))) for i, t in enumerate(cat.CHECK_TYPES)}
    lines = F.array(*[_line(F.lit(t), F.when(_highest(i).isNull(), F.lit("NOT_RUN")).otherwise(_known(_highest(i)))) for i, t in enumerate(cat.CHECK_TYPES)])
    failed = F.coalesce(status["ASSURANCE_CLASSIFIER"], F.lit("NOT_RUN")).isin("FAIL", "ERROR", "NOT_RUN")
    level = F.when((F.col("n_blocking") > 0) | failed, 0).otherwise(F.coalesce("level", F.lit(0)))
    names = F.array(*[F.lit(a) for a in cat.ASSURANCE])
    return df.select(
        "run_id", *[c.alias(t.lower()) for t, c in status.items()], "n_blocking", "n_failures", F.get(names, level).alias("assurance_class"),
        F.array_join(lines, "\n").alias("lines"),
    )


def release_gate(results: DataFrame, reports: DataFrame, review_audits: DataFrame) -> DataFrame:
    """May the result be stored and shared, and which checks block it (a set of at most 16 types)."""
    blocking = F.when(F.col("required") & ~F.col("status").isin(*_SATISFIED), F.col("type"))
    per = results.groupBy("run_id").agg(
        F.array_sort(F.collect_set(blocking)).alias("blocking_types"),
        F.max((F.col("type") == "PERSISTENT_REOPEN_AND_DIGEST") & F.col("status").isin(*_SATISFIED)).alias("reopened"),
    )
    pending = _flag(review_audits.where("status = 'REVIEW_REQUIRED'"), "_pending")
    df = per.join(reports.select("run_id", "assurance_class"), "run_id", "left").join(pending, "run_id", "left")
    ok = (F.col("assurance_class") != "AS_0_UNVERIFIED") & (F.size("blocking_types") == 0) & F.col("_pending").isNull() & F.col("reopened")
    ok = F.coalesce(ok, F.lit(False))
    return df.select("run_id", ok.alias("can_persist"), ok.alias("can_share"), "blocking_types")


_FEW = 64


def convergence_check(variants: DataFrame, residue: DataFrame | None = None, approvals: DataFrame | None = None, **policy) -> DataFrame:
    """The variants of a family reach one canonical text, and no declared residue is left in it.

    variants(family_id, variant_id, text); residue(family_id, value). Texts are compared by digest, so a
    family's group holds digests and counts, not texts. Residue of up to ``_FEW`` distinct values is looked for in each
    text where it lies; with more of them the texts are shuffled to the values of their family.
    """
    sid = F.concat_ws("|", "family_id", "variant_id")
    src = variants.select(sid.alias("source_id"), "family_id", "text", *[c for c in ("source_kind", "approved_codes") if c in variants.columns])
    out = tt.canonical_stages(src, approvals, **policy).select("family_id", "canonical")
    entry = lambda kind, key, n, hits: F.struct(F.lit(kind).alias("_kind"), key.cast("string").alias("_key"), n.cast("long").alias("n"), hits.cast("long").alias("h"))
    one, no = F.lit(1), F.lit(0)
    digest = F.sha2("canonical", 256)
    values = [] if residue is None else [r.value for r in residue.where("value IS NOT NULL").select("value").distinct().limit(_FEW + 1).collect()]
    if len(values) > _FEW:
        # Too many to be tried on every text: texts meet the values of their family.
        words = residue.groupBy("family_id").agg(F.collect_set("value").alias("_residue"))
        out = out.join(words, "family_id", "left")
        hits = F.size(F.filter(F.coalesce("_residue", F.array().cast("array<string>")), lambda v: F.col("canonical").contains(v)))
        rows = out.select("family_id", entry("text", digest, one, hits).alias("_e")).select("family_id", "_e.*", F.lit(False).alias("_wanted"))
    else:
        found = F.array_compact(F.array(*[F.when(F.col("canonical").contains(v), entry("value", F.lit(v), no, one)) for v in values]))
        # Texts stay where they are: their digest and the values in them meet the values of the family.
        made = F.concat(F.array(entry("text", digest, one, no)), found) if values else F.array(entry("text", digest, one, no))
        rows = out.select("family_id", F.explode(made).alias("_e")).select("family_id", "_e.*", F.lit(False).alias("_wanted"))
        if values:
            kind = variants.schema["family_id"].dataType
            asked = residue.where("value IS NOT NULL AND family_id IS NOT NULL").select(F.col("family_id").cast(kind).alias("family_id"), entry("value", F.col("value"), no, no).alias("_e"))
            rows = rows.unionByName(asked.select("family_id", "_e.*", F.lit(True).alias("_wanted")))
    # Two-step distinct: equal texts and values of a family combine on the map side before the family is counted.
    pairs = rows.groupBy("family_id", "_kind", "_key").agg(F.sum("n").alias("n"), F.sum("h").alias("h"), F.max("_wanted").alias("_wanted"))
    text = F.col("_kind") == "text"
    counted = pairs.groupBy("family_id").agg(
        F.count_if(text).alias("distinct_texts"), F.sum("n").alias("variants"), F.sum(F.when(text | F.col("_wanted"), F.col("h")).otherwise(0)).alias("residue_hits"))
    return counted.where("variants > 0").select("family_id", (F.col("distinct_texts") == 1).alias("converged"), "distinct_texts", "variants", "residue_hits")


def report_consistency_audit(reports: DataFrame, results: DataFrame, canaries: DataFrame) -> DataFrame:
    """Every machine status has its line in the report text, and the report holds no canary.

    Lines become marks before they are shuffled, and all that is known of a run meets in one aggregation.
    """
    said = [f"_said{i}" for i in range(len(_MARKS))]
    none = F.lit(None).cast("long")
    split = F.when(F.col("lines").isNull(), F.array(F.lit(""))).otherwise(F.split("lines", "\n"))
    line = reports.select("run_id", F.posexplode(split).alias("_at", "_line"))
    label = F.substring_index("_line", ": ", 1)
    labels = {kind.capitalize().replace("_", " "): F.lit(i) for i, kind in enumerate(cat.CHECK_TYPES)}
    ranks = {text: F.lit(2 * _STATUSES.index(s) + 1) for s, text in STATUS_LABELS.items()}
    place, rank = code_map(labels)[label], code_map(ranks)[F.expr("substring(_line, length(substring_index(_line, ': ', 1)) + 3)")]
    in_text = line.select("run_id", (F.col("_at") == 0).cast("long").alias("_copies"), *[m.alias(s) for m, s in zip(_marks(place, rank), said)],
                          *[none.alias(m) for m in _MARKS], F.lit(False).alias("_leaks"))
    machine = results.select("run_id", F.lit(0).cast("long").alias("_copies"), *[none.alias(s) for s in said], *_status_marks(results), F.lit(False).alias("_leaks"))
    # Which canary it is does not matter here, so equal secrets are one.
    secrets = canaries.select(F.col("secret").alias("canary_id"), "secret").distinct()
    leaked = canary_search(reports.select(F.col("run_id").alias("surface_id"), F.col("lines").alias("payload")), secrets)
    leaks = leaked.select(F.col("surface_id").alias("run_id"), F.lit(0).cast("long").alias("_copies"), *[none.alias(c) for c in (*said, *_MARKS)], F.lit(True).alias("_leaks"))
    runs = union_all([in_text, machine, leaks]).groupBy("run_id").agg(
        F.sum("_copies").alias("_copies"), *[F.bit_or(c).alias(c) for c in (*said, *_MARKS)], F.max("_leaks").alias("_leaks"))
    not_run = 2 * _STATUSES.index("NOT_RUN") + 1
    there = F.lit(True)
    for i in range(len(cat.CHECK_TYPES)):
        wanted = F.coalesce(_highest(i), F.lit(not_run))
        # A status that is none of the known ones has no line.
        there &= (wanted % 2 == 1) & (F.call_function("shiftright", _field(said[i // _IN_ONE], i), wanted.cast("int")) % 2 == 1)
    keyed = F.col("run_id").isNotNull()
    failures = F.array_compact(F.array(F.when(keyed & F.col("_leaks"), F.lit("REPORT_CANARY_DETECTED")), F.when(keyed & ~there, F.lit("REPORT_MACHINE_STATUS_MISMATCH"))))
    rows = runs.where("_copies > 0").select("run_id", failures.alias("failures"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    return judged(rows, "HUMAN_READABLE_REPORT", "HUMAN_REPORT_CONSISTENT", "HUMAN_REPORT_INCONSISTENT")
