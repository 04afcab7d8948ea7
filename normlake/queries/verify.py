"""Queries over verification audits. Evidence derives from orders, customers, documents and benchmark items."""

from __future__ import annotations

from pyspark.sql import functions as F

from normlake.dims import catalog as cat
from normlake.operators import verification as v
from normlake.queries.base import dealt, fixture, query, values_sql
from normlake.queries.review import CATALOG_SQL, LINEAGE, S, audits, case
from normlake.queries.text import CANONICAL_NFKC, STEPS, sources
from normlake.operators import review as r


def shown(df):
    return df.withColumn("failures", F.array_join("failures", ","))


def verdict_sql(kind, passed, failed, fails, runs="runs", required="TRUE", skip=()):
    """Verdict of one audit from a ``(run_id, code)`` SELECT."""
    st = " ".join(f"WHEN {c} THEN '{s}'" for c, s, _ in skip)
    su = " ".join(f"WHEN {c} THEN '{x}'" for c, _, x in skip)
    fl = " ".join(f"WHEN {c} THEN ''" for c, _, _ in skip)
    return f"""fx AS (SELECT DISTINCT run_id, code FROM ({fails})), fa AS (SELECT run_id, string_agg(code, ',' ORDER BY code) AS fs FROM fx GROUP BY 1)
SELECT r.run_id, '{kind}' AS type, CASE {st} WHEN fs IS NOT NULL THEN 'FAIL' ELSE 'PASS' END AS status, {required} AS required, CASE {su} WHEN fs IS NOT NULL THEN '{failed}' ELSE '{passed}' END AS summary_code,
 {f"CASE {fl} ELSE coalesce(fs, '') END" if skip else "coalesce(fs, '')"} AS failures FROM {runs} r LEFT JOIN fa ON fa.run_id = r.run_id"""


_PX = "px AS (SELECT * FROM preset_rows p WHERE seq < (SELECT min(seq) FROM preset_rows c WHERE c.preset_id = p.preset_id AND c.block_id = 'PST-002'))"
V01 = f"""WITH {_PX}, ct AS ({CATALOG_SQL}), sh AS (SELECT run_id, count(*) AS n, min(seq) AS lo, max(seq) AS hi, max(execution_revision) AS top, count(DISTINCT seq) AS ds FROM manifest GROUP BY 1),
""" + verdict_sql("EXECUTED_BLOCK_MANIFEST", "EXECUTED_MANIFEST_VALID", "EXECUTED_MANIFEST_INVALID", """
SELECT run_id, 'WORKFLOW_VERSION_MISMATCH' AS code FROM log_runs WHERE workflow_version <> 1
UNION ALL SELECT run_id, 'PRESET_OUTPUT_MODE_MISMATCH' FROM log_runs l JOIN preset_heads h USING (preset_id) WHERE l.output_mode <> h.output_mode
UNION ALL SELECT run_id, 'MANIFEST_ORDER_NOT_CONTIGUOUS' FROM sh WHERE lo <> 0 OR hi <> n - 1 OR ds <> n
UNION ALL SELECT run_id, 'MANIFEST_FUTURE_EXECUTION_REVISION' FROM sh JOIN log_runs USING (run_id) WHERE top > execution_revision
UNION ALL SELECT l.run_id, 'MANIFEST_BLOCK_COUNT_MISMATCH' FROM log_runs l LEFT JOIN sh USING (run_id) WHERE coalesce(n, 0) <> (SELECT count(*) FROM px WHERE px.preset_id = l.preset_id)
UNION ALL SELECT a.run_id, 'MANIFEST_EXECUTION_REVISION_ORDER_INVALID' FROM manifest a JOIN manifest b ON a.run_id = b.run_id AND b.seq = a.seq + 1 WHERE a.execution_revision >= b.execution_revision
UNION ALL SELECT m.run_id, 'MANIFEST_BLOCK_ORDER_MISMATCH' FROM manifest m JOIN log_runs l USING (run_id) JOIN px ON px.preset_id = l.preset_id AND px.seq = m.seq WHERE px.block_id <> m.block_id
UNION ALL SELECT m.run_id, 'MANIFEST_BLOCK_VERSION_MISMATCH' FROM manifest m JOIN log_runs l USING (run_id) JOIN px ON px.preset_id = l.preset_id AND px.seq = m.seq WHERE px.block_version <> m.block_version
UNION ALL SELECT run_id, 'MANIFEST_UNKNOWN_BLOCK' FROM manifest WHERE block_id NOT IN (SELECT block_id FROM ct)
UNION ALL SELECT run_id, 'MANIFEST_UNKNOWN_BLOCK_VERSION' FROM manifest WHERE block_id IN (SELECT block_id FROM ct) AND block_version <> 1""", runs="log_runs")


@query("v01_manifest_audit", V01)
def _(q):
    s = q.spark
    return shown(v.manifest_audit(q.manifest, q.log_runs, cat.presets(s), cat.preset_blocks(s), cat.block_catalog(s)))


fixture("artifacts", f"""
SELECT o_orderkey AS run_id, 'a' || CAST(o_orderkey AS {S}) AS artifact_id, CAST(1 + o_custkey % 3 + CASE WHEN o_orderkey % 37 = 0 THEN 1 ELSE 0 END AS INT) AS canonical_revision, CAST(1 + o_orderkey % 5 AS INT) AS artifact_revision,
 'text/plain' AS mime_type, 'text ' || o_orderpriority AS canonical_text, CASE WHEN o_orderkey % 41 = 0 THEN 'other' ELSE 'text ' || o_orderpriority END AS stored_text,
 CASE WHEN o_orderkey % 43 = 0 THEN 'image/png' ELSE 'text/plain' END AS stored_mime, o_orderkey % 47 <> 0 AS private_location, CASE WHEN o_orderkey % 53 = 0 THEN 'NOT_RUN' WHEN o_orderkey % 59 = 0 THEN 'ERROR' ELSE 'COMPLETED' END AS outcome FROM {{orders}}""")
fixture("decided", f"SELECT o_orderkey AS run_id, 'd' || CAST(o_custkey AS {S}) AS decision_id, CASE WHEN o_orderkey % 2 = 0 THEN 'APPROVED' ELSE 'PENDING' END AS status FROM {{orders}}")
fixture("steps", f"SELECT o_orderkey AS run_id, CAST(n AS INT) AS seq, {case('(o_orderkey + n) % 9', ('TXT-010', 'VER-001', 'URL-014', 'CAN-002', 'VER-015', 'PST-002', 'OUT-BND-001', 'REV-001', 'EXP-001'))} AS block_id FROM {{orders}} JOIN (SELECT 0 AS n UNION ALL SELECT 1 UNION ALL SELECT 2) t ON TRUE")
_V02 = verdict_sql("CANONICAL_REVISION_LINK", "CANONICAL_REVISION_LINK_VALID", "REVISION_LINK_AUDIT_FAILED", """
SELECT run_id, 'BUNDLE_CANONICAL_REVISION_MISMATCH' AS code FROM runs WHERE bundle_revision <> document_revision
UNION ALL SELECT run_id, 'CONTEXT_DEPENDENCY_MAP_MISMATCH' FROM runs WHERE NOT dependency_maps_equal
UNION ALL SELECT run_id, 'CANONICAL_DECISION_LINK_MISMATCH' FROM decided WHERE status = 'APPROVED' AND run_id % 61 = 0
UNION ALL SELECT run_id, 'CONTEXT_CHANGE_LEDGER_MISMATCH' FROM ledger WHERE run_id % 67 = 0
UNION ALL SELECT run_id, 'CONTEXT_OUTPUT_BUNDLE_MISMATCH' FROM artifacts WHERE run_id % 71 = 0
UNION ALL SELECT a.run_id, 'ARTIFACT_CANONICAL_REVISION_MISMATCH' FROM artifacts a JOIN runs USING (run_id) WHERE canonical_revision <> document_revision
UNION ALL SELECT a.run_id, 'REOPENED_CANONICAL_REVISION_MISMATCH' FROM artifacts a JOIN runs USING (run_id) WHERE canonical_revision <> document_revision AND outcome = 'COMPLETED'
UNION ALL SELECT s.run_id, 'POST_VERIFICATION_TRANSFORMATION' FROM steps s JOIN ct ON ct.block_id = s.block_id AND transforming WHERE s.seq > (SELECT min(seq) FROM steps z WHERE z.run_id = s.run_id AND z.block_id LIKE 'VER-%')
UNION ALL SELECT run_id, failure_code FROM lin""")


@query("v02_revision_audit", f"WITH {LINEAGE}, ct AS ({CATALOG_SQL}), base AS (WITH {_V02}), " + "pend AS (SELECT run_id FROM runs WHERE NOT semantic_approved OR NOT assurance_acknowledged) " + """
SELECT run_id, type, CASE WHEN status = 'PASS' AND run_id IN (SELECT run_id FROM pend) THEN 'REVIEW_REQUIRED' ELSE status END AS status, required,
 CASE WHEN status = 'PASS' AND run_id IN (SELECT run_id FROM pend) THEN 'REQUIRED_REVIEW_INCOMPLETE' ELSE summary_code END AS summary_code, failures FROM base""")
def _(q):
    q.hold("ledger")
    arts = q.artifacts
    lin = r.lineage_integrity(q.runs, q.ledger, q.transformations, q.executed)
    pend = q.runs.where("NOT semantic_approved OR NOT assurance_acknowledged").select("run_id", F.lit("REVIEW_REQUIRED").alias("status"))
    return shown(v.revision_audit(
        q.runs, q.decided.where("run_id % 61 <> 0").select("run_id", "decision_id"), q.decided, q.ledger.where("run_id % 67 <> 0").select("run_id", "change_id"), q.ledger,
        arts.where("run_id % 71 <> 0").select("run_id", "artifact_id"), arts, arts.where("outcome = 'COMPLETED'"), q.steps, cat.block_catalog(q.spark), lin, pend))


_PROV = lambda t: [(f"r.run_id NOT IN (SELECT run_id FROM {t})", "NOT_RUN", "APPLICABLE_PROVIDER_EVIDENCE_MISSING"), (f"r.run_id IN (SELECT run_id FROM {t} WHERE outcome = 'ERROR')", "ERROR", "PROVIDER_EXECUTION_ERROR"),
                   (f"r.run_id IN (SELECT run_id FROM {t} WHERE outcome = 'NOT_RUN')", "NOT_RUN", "PROVIDER_NOT_CONFIGURED")]


@query("v03_reopen_digest_audit", "WITH " + verdict_sql("PERSISTENT_REOPEN_AND_DIGEST", "EXACT_REOPEN_AND_DIGEST_PASSED", "EXACT_REOPEN_AND_DIGEST_FAILED", """
SELECT run_id, unnest(['REOPEN_DIGEST_MISMATCH', 'REOPEN_BYTE_COUNT_MISMATCH', 'TEXT_EXACT_REPRESENTATION_MISMATCH']) AS code FROM artifacts WHERE stored_text <> canonical_text AND outcome = 'COMPLETED'
UNION ALL SELECT run_id, 'REOPEN_MIME_MISMATCH' FROM artifacts WHERE stored_mime <> mime_type AND outcome = 'COMPLETED'
UNION ALL SELECT run_id, 'ARTIFACT_LOCATION_NOT_PRIVATE' FROM artifacts WHERE NOT private_location AND outcome = 'COMPLETED'""", skip=_PROV("artifacts")))
def _(q):
    raw = F.encode("canonical_text", "UTF-8")
    a = q.artifacts.withColumn("content_digest", F.sha2(raw, 256)).withColumn("byte_count", F.octet_length(raw))
    again = a.select("run_id", "artifact_id", F.encode("stored_text", "UTF-8").alias("payload"), F.sha2(F.encode("stored_text", "UTF-8"), 256).alias("digest"), F.col("stored_mime").alias("mime_type"), "artifact_revision", "canonical_revision", "private_location", "outcome")
    return shown(v.reopen_digest_audit(q.runs, a, again))


fixture("inspections", f"""
SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 53 = 0 THEN 'NOT_RUN' ELSE 'COMPLETED' END AS outcome, CAST(1 + o_orderkey % 5 + CASE WHEN o_orderkey % 61 = 0 THEN 1 ELSE 0 END AS INT) AS artifact_revision, {case('o_custkey % 5', ('image/png', 'image/png', 'image/png', 'image/png', 'image/gif'))} AS mime_type,
 o_custkey % 11 <> 0 AS decodes, CAST(CASE WHEN o_custkey % 13 = 0 THEN 1 ELSE 0 END AS INT) AS thumbnails, CASE WHEN o_custkey % 17 = 0 THEN 'CMYK' ELSE 'RGB' END AS channel_model, CASE WHEN o_custkey % 19 = 0 THEN 'STRAIGHT' ELSE 'OPAQUE' END AS alpha_model,
 CASE WHEN o_custkey % 23 = 0 THEN 'ADOBE' ELSE 'SRGB' END AS colour_profile, CASE WHEN o_custkey % 7 = 0 THEN 'METADATA' ELSE 'CHUNK' END AS kind, {case('o_custkey % 3', ('IHDR', 'IDAT', 'GPS'))} AS code FROM {{orders}} WHERE o_orderkey % 9 <> 0""")
fixture("allowed_values", values_sql(["kind", "code"], [("MIME", "image/png"), ("CHUNK", "IHDR"), ("CHUNK", "IDAT"), ("METADATA", "IHDR"), ("CHANNEL", "RGB"), ("ALPHA", "OPAQUE"), ("PROFILE", "SRGB")]))


@query("v04_container_policy_audit", "WITH " + verdict_sql("FINAL_METADATA", "FINAL_CONTAINER_POLICY_PASSED", "FINAL_CONTAINER_POLICY_FAILED", """
SELECT i.run_id, 'IMAGE_INSPECTION_REVISION_MISMATCH' AS code FROM inspections i JOIN runs u USING (run_id) WHERE i.artifact_revision <> u.artifact_revision AND outcome = 'COMPLETED'
UNION ALL SELECT run_id, 'INDEPENDENT_IMAGE_DECODE_FAILED' FROM inspections WHERE NOT decodes AND outcome = 'COMPLETED' UNION ALL SELECT run_id, 'EMBEDDED_THUMBNAIL_NOT_ALLOWED' FROM inspections WHERE thumbnails > 0 AND outcome = 'COMPLETED'
UNION ALL SELECT run_id, 'IMAGE_MIME_NOT_ALLOWED' FROM inspections WHERE mime_type <> 'image/png' AND outcome = 'COMPLETED' UNION ALL SELECT run_id, 'CHANNEL_MODEL_NOT_ALLOWED' FROM inspections WHERE channel_model <> 'RGB' AND outcome = 'COMPLETED'
UNION ALL SELECT run_id, 'ALPHA_MODEL_NOT_ALLOWED' FROM inspections WHERE alpha_model <> 'OPAQUE' AND outcome = 'COMPLETED' UNION ALL SELECT run_id, 'COLOUR_PROFILE_NOT_ALLOWED' FROM inspections WHERE colour_profile <> 'SRGB' AND outcome = 'COMPLETED'
UNION ALL SELECT run_id, CASE kind WHEN 'METADATA' THEN 'UNEXPECTED_IMAGE_METADATA' ELSE 'UNEXPECTED_CONTAINER_CHUNK' END FROM inspections i WHERE NOT EXISTS (SELECT 1 FROM allowed_values a WHERE a.kind = i.kind AND a.code = i.code)""",
    required="output_mode <> 'TEXT'", skip=[("output_mode = 'TEXT'", "NOT_APPLICABLE", "IMAGE_METADATA_NOT_APPLICABLE")] + _PROV("inspections")))
def _(q):
    i = q.inspections
    return shown(v.container_policy_audit(q.runs, i.drop("kind", "code"), i.select("run_id", "kind", "code"), q.allowed_values))


fixture("recognised", f"SELECT o_orderkey AS run_id, 'text ' || CASE WHEN o_orderkey % 37 = 0 THEN 'lost' ELSE o_orderpriority END AS text, CAST(1 + o_orderkey % 5 + CASE WHEN o_orderkey % 73 = 0 THEN 1 ELSE 0 END AS INT) AS artifact_revision, CASE WHEN o_orderkey % 53 = 0 THEN 'ERROR' ELSE 'COMPLETED' END AS outcome FROM {{orders}}")
fixture("orders_seen", f"SELECT DISTINCT l_orderkey AS run_id, CAST(l_linenumber AS INT) AS ordinal, 'b' || CAST(l_linenumber + CASE WHEN l_orderkey % 31 = 0 THEN 1 ELSE 0 END AS {S}) AS block_id FROM {{lineitem}}")
fixture("orders_want", f"SELECT DISTINCT l_orderkey AS run_id, CAST(l_linenumber AS INT) AS ordinal, 'b' || CAST(l_linenumber AS {S}) AS block_id FROM {{lineitem}}")


@query("v05_ocr_round_trip_audit", "WITH " + verdict_sql("OCR_ROUND_TRIP", "OCR_ROUND_TRIP_PASSED", "OCR_ROUND_TRIP_FAILED", """
SELECT c.run_id, 'OCR_REVISION_MISMATCH' AS code FROM recognised c JOIN runs u USING (run_id) WHERE c.artifact_revision <> u.artifact_revision AND outcome = 'COMPLETED' UNION ALL SELECT c.run_id, 'OCR_TEXT_DIVERGENCE' FROM recognised c JOIN runs u USING (run_id) WHERE c.text <> u.approved_text AND outcome = 'COMPLETED'
UNION ALL SELECT run_id, 'OCR_READING_ORDER_DIVERGENCE' FROM orders_seen WHERE run_id % 31 = 0 UNION ALL SELECT run_id, 'OCR_CLASSIFIED_DIFFERENCE_PRESENT' FROM recognised WHERE run_id % 79 = 0""",
    required="output_mode IN ('REBUILT_IMAGE', 'BOTH')", skip=[("output_mode NOT IN ('REBUILT_IMAGE', 'BOTH')", "NOT_APPLICABLE", "OCR_ROUND_TRIP_NOT_APPLICABLE"), ("approved_text IS NULL", "NOT_RUN", "APPROVED_TEXT_NOT_AVAILABLE")] + _PROV("recognised")))
def _(q):
    return shown(v.ocr_round_trip_audit(q.runs, q.recognised, q.orders_seen, q.orders_want, q.recognised.where("run_id % 79 = 0").select("run_id")))


@query("v06_final_unicode_audit", """
WITH t AS (SELECT doc_id AS run_id, CASE WHEN doc_id % 6 = 0 THEN text || '​' WHEN doc_id % 6 = 1 THEN text || '\u0001' ELSE text END AS text, text AS approved FROM documents),
f AS (SELECT run_id, CASE WHEN run_id % 6 = 1 THEN 'FINAL_TEXT_NOT_APPROVED_TEXT,FINAL_UNICODE_SCALAR_FAILURE,UNAPPROVED_FINAL_UNICODE_FINDING' WHEN run_id % 6 = 0 THEN 'FINAL_TEXT_NOT_APPROVED_TEXT,UNAPPROVED_FINAL_UNICODE_FINDING' ELSE '' END AS failures FROM t)
SELECT run_id, 'FINAL_UNICODE' AS type, CASE failures WHEN '' THEN 'PASS' ELSE 'FAIL' END AS status, TRUE AS required, CASE failures WHEN '' THEN 'FINAL_UNICODE_RESCAN_PASSED' ELSE 'FINAL_UNICODE_RESCAN_FAILED' END AS summary_code, failures FROM f""")
def _(q):
    d = dealt(q.documents.select(F.col("doc_id").alias("run_id"), F.lit("TEXT").alias("output_mode"), F.col("text").alias("approved_text")), "run_id")
    k = F.col("run_id") % 6
    t = d.select("run_id", F.when(k == 0, F.concat("approved_text", F.lit("​"))).when(k == 1, F.concat("approved_text", F.lit("\u0001"))).otherwise(F.col("approved_text")).alias("text"))
    return shown(v.final_unicode_audit(d, t, ["CANONICAL_NORMALIZATION_DELTA", "COMPATIBILITY_NORMALIZATION_DELTA", "NON_CANONICAL_WHITESPACE"]))


fixture("final_texts", "SELECT page_id AS run_id, 'See ' || url || ' now' || CASE WHEN page_id % 5 = 0 THEN ' and https://example.com/extra' ELSE '' END AS text FROM {pages}")


@query("v07_final_url_audit", """
WITH f AS (SELECT run_id, CASE WHEN run_id % 5 = 0 THEN 'FINAL_URL_COUNT_MISMATCH,UNAPPROVED_FINAL_URL' WHEN run_id % 7 = 0 THEN 'FINAL_URL_COMPONENT_MISMATCH,FINAL_URL_REPARSE_UNSTABLE' ELSE '' END AS failures FROM final_texts)
SELECT run_id, 'FINAL_URL' AS type, CASE failures WHEN '' THEN 'PASS' ELSE 'FAIL' END AS status, TRUE AS required, CASE failures WHEN '' THEN 'FINAL_URL_RESCAN_PASSED' ELSE 'FINAL_URL_RESCAN_FAILED' END AS summary_code, failures FROM f""")
def _(q):
    from normlake.operators import urls

    src = q.pages.select(F.col("page_id").alias("source_id"), F.col("url").alias("text"), F.lit("PLAIN_TEXT_URL").alias("source_kind"))
    tok = urls.parse_url_components(urls.url_candidates(src)).select(F.col("source_id").alias("run_id"), F.lit(0).alias("ordinal"), F.col("target").alias("final_text"), *urls._PARTS)
    tok = tok.withColumn("host", F.when((F.col("run_id") % 7 == 0) & (F.col("run_id") % 5 != 0), F.concat(F.lit("x"), "host")).otherwise(F.col("host")))
    return shown(v.final_url_audit(q.pages.select(F.col("page_id").alias("run_id"), F.lit("TEXT").alias("output_mode")), q.final_texts, tok))


@query("v08_canary_search", "SELECT d.doc_id AS surface_id, item_id AS canary_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def _(q):
    return v.canary_search(dealt(q.documents.select(F.col("doc_id").alias("surface_id"), F.col("text").alias("payload")), "surface_id"), q.benchmark.select(F.col("item_id").alias("canary_id"), F.col("text").alias("secret")))


# Benchmark passages as canaries in whole documents, a document a run; some runs without evidence or with bad facts.
fixture("reference_runs", "SELECT doc_id AS run_id FROM {documents}")
fixture("reference_facts", f"""
SELECT doc_id AS run_id, CASE doc_id % 13 WHEN 0 THEN 'ERROR' WHEN 1 THEN 'NOT_RUN' ELSE 'COMPLETED' END AS outcome, doc_id % 5 <> 0 AS private_root, doc_id % 3 <> 0 AS mime_matches,
  length(text) % 2 = 0 AS digest_matches, lang <> 'de' AS uri_scoped, doc_id % 11 <> 4 AS least_privilege FROM {{documents}} WHERE doc_id % 7 <> 0""")


@query("v08_source_reference_audit", "WITH " + verdict_sql("SOURCE_REFERENCE", "SOURCE_REFERENCE_AUDIT_PASSED", "SOURCE_REFERENCE_AUDIT_FAILED", """
SELECT d.doc_id AS run_id, 'REFERENCE_CANARY_DETECTED' AS code FROM documents d WHERE EXISTS (SELECT 1 FROM benchmark b WHERE contains(d.text, b.text))
UNION ALL SELECT run_id, 'ARTIFACT_ROOT_NOT_PRIVATE' FROM reference_facts WHERE outcome = 'COMPLETED' AND NOT private_root
UNION ALL SELECT run_id, 'OUTGOING_MIME_MISMATCH' FROM reference_facts WHERE outcome = 'COMPLETED' AND NOT mime_matches
UNION ALL SELECT run_id, 'OUTGOING_DIGEST_MISMATCH' FROM reference_facts WHERE outcome = 'COMPLETED' AND NOT digest_matches
UNION ALL SELECT run_id, 'OUTGOING_URI_SCOPE_INVALID' FROM reference_facts WHERE outcome = 'COMPLETED' AND NOT uri_scoped
UNION ALL SELECT run_id, 'TEMPORARY_PERMISSION_SCOPE_INVALID' FROM reference_facts WHERE outcome = 'COMPLETED' AND NOT least_privilege""",
    runs="(SELECT r0.run_id, f0.outcome FROM reference_runs r0 LEFT JOIN reference_facts f0 ON f0.run_id = r0.run_id)",
    skip=[("outcome IS NULL", "NOT_RUN", "APPLICABLE_PROVIDER_EVIDENCE_MISSING"), ("outcome = 'ERROR'", "ERROR", "PROVIDER_EXECUTION_ERROR"), ("outcome = 'NOT_RUN'", "NOT_RUN", "PROVIDER_NOT_CONFIGURED")]))
def _(q):
    surfaces = dealt(q.documents.select(F.col("doc_id").alias("run_id"), F.col("doc_id").alias("surface_id"), F.col("text").alias("payload")), "surface_id")
    canaries = q.benchmark.select(F.col("item_id").alias("canary_id"), F.col("text").alias("secret"))
    return shown(v.source_reference_audit(q.reference_runs, surfaces, canaries, q.reference_facts))


fixture("lineage_have", f"SELECT DISTINCT l_orderkey AS run_id, {case('l_linenumber % 3', ('RETAINED_SOURCE_PIXELS', 'OCR_DERIVED_TEXT', 'BUNDLED_ASSET'))} AS type, 'b' || CAST(l_linenumber AS {S}) AS block_id, 'g' || CAST(l_linenumber AS {S}) AS region_id, CAST(NULL AS {S}) AS decision_id FROM {{lineitem}}")


@query("v09_dependency_audit", "WITH " + verdict_sql("SOURCE_PIXEL_DEPENDENCY", "SOURCE_DEPENDENCY_SCOPE_PASSED", "SOURCE_DEPENDENCY_AUDIT_FAILED", """
SELECT run_id, 'DEPENDENCY_EXPECTATION_MISMATCH' AS code FROM lineage_have WHERE run_id % 11 = 0 UNION ALL SELECT run_id, 'EXERCISED_DEPENDENCY_TYPE_MISSING' FROM runs u WHERE run_id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM lineage_have h WHERE h.run_id = u.run_id AND type = 'OCR_DERIVED_TEXT')
UNION ALL SELECT run_id, 'PLATFORM_DEPENDENCY_LIMITATION_UNDECLARED' FROM runs WHERE run_id % 5 = 0 UNION ALL SELECT run_id, 'RETAINED_REGION_POLICY_MAP_MISMATCH' FROM lineage_have WHERE type = 'RETAINED_SOURCE_PIXELS' AND run_id % 13 = 0
UNION ALL SELECT run_id, 'SOURCE_PIXEL_OPERATION_UNDECLARED' FROM lineage_have WHERE type = 'RETAINED_SOURCE_PIXELS' AND run_id % 17 = 0""", required="output_mode <> 'TEXT'", skip=[("output_mode = 'TEXT'", "NOT_APPLICABLE", "PIXEL_DEPENDENCY_NOT_APPLICABLE")]).replace("ELSE 'PASS' END AS status", "ELSE 'PASS_WITH_DECLARED_RESIDUAL' END AS status"))
def _(q):
    h = q.lineage_have
    kept = h.where("type = 'RETAINED_SOURCE_PIXELS'").select("run_id", "region_id")
    regions = kept.where("run_id % 13 <> 0").withColumn("pixels_retained", F.lit(True))
    exercised = q.runs.where("run_id % 2 = 0").select("run_id", F.lit("OCR_DERIVED_TEXT").alias("type"))
    limits = q.runs.where("run_id % 5 <> 0").select("run_id", F.lit("PLATFORM").alias("code"))
    return shown(v.dependency_audit(q.runs, h, h.where("run_id % 11 <> 0"), exercised, regions, kept.where("run_id % 17 <> 0"), limits))


@query("v10_machine_code_audit", "WITH " + verdict_sql("MACHINE_READABLE_CODE", "MACHINE_READABLE_CODE_RESCAN_PASSED", "MACHINE_READABLE_CODE_RESCAN_FAILED", """
SELECT run_id, 'MACHINE_READABLE_CODE_MISMATCH' AS code FROM orders_seen WHERE run_id % 31 = 0 UNION ALL SELECT i.run_id, 'BARCODE_REVISION_MISMATCH' FROM inspections i JOIN runs u USING (run_id) WHERE i.artifact_revision <> u.artifact_revision""",
    required="output_mode <> 'TEXT' AND strict_profile", skip=[("output_mode = 'TEXT' OR NOT strict_profile", "NOT_APPLICABLE", "BARCODE_RESCAN_NOT_APPLICABLE")] + _PROV("inspections")))
def _(q):
    val = lambda d: d.select("run_id", F.col("block_id").alias("value"))
    return shown(v.machine_code_audit(q.runs, val(q.orders_seen), val(q.orders_want), q.inspections))


@query("v11_region_coverage_audit", "WITH " + verdict_sql("VISUAL_REGION_COVERAGE", "VISUAL_REGION_COVERAGE_PASSED", "VISUAL_REGION_COVERAGE_FAILED", """
SELECT run_id, 'REGION_TERMINAL_POLICY_MISMATCH' AS code FROM orders_seen WHERE run_id % 31 = 0 UNION ALL SELECT i.run_id, 'REGION_COVERAGE_REVISION_MISMATCH' FROM inspections i JOIN runs u USING (run_id) WHERE i.artifact_revision <> u.artifact_revision""",
    required="output_mode <> 'TEXT'", skip=[("output_mode = 'TEXT'", "NOT_APPLICABLE", "REGION_COVERAGE_NOT_APPLICABLE")] + _PROV("inspections")))
def _(q):
    reg = lambda d: d.select("run_id", F.col("ordinal").cast("string").alias("region_id"), F.col("block_id").alias("policy"))
    return shown(v.region_coverage_audit(q.runs, reg(q.orders_seen), reg(q.orders_want), q.inspections))


AGAIN = CANONICAL_NFKC.replace("perturbed", "once")


@query("v12_idempotence_audit", f"""
WITH once AS (WITH {CANONICAL_NFKC} SELECT source_id, text, source_kind FROM canonical), {AGAIN}, {STEPS},
moved AS (SELECT source_id, count(*) AS n FROM step_texts WHERE before <> after AND source_id NOT IN (SELECT source_id FROM bad) GROUP BY 1)
SELECT o.source_id, c.text = o.text AS text_same, CAST(coalesce(n, 0) AS INT) AS change_count, CASE WHEN c.text = o.text AND n IS NULL THEN 'PASS' ELSE 'FAIL' END AS status
FROM once o JOIN canonical c USING (source_id) LEFT JOIN moved USING (source_id)""")
def _(q):
    return v.idempotence_audit(sources(q))


fixture("facts", f"""
SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 53 = 0 THEN 'ERROR' ELSE 'COMPLETED' END AS outcome, o_custkey % 3 <> 0 AS network_evidence_captured, CAST(o_custkey % 5 AS INT) AS network_attempt_count, CAST(CASE WHEN o_custkey % 7 = 0 THEN 1 ELSE 0 END AS INT) AS model_download_count,
 o_custkey % 11 = 0 AS internet_permission, o_custkey % 13 = 0 AS broad_storage_permission, o_custkey % 17 <> 0 AS private_root, o_custkey % 19 <> 0 AS cleanup_completed, o_custkey % 23 <> 0 AS least_privilege,
 o_custkey % 4 <> 0 AS static_scan_completed, o_custkey % 6 <> 0 AS canary_session_completed, CAST(CASE WHEN o_custkey % 9 = 0 THEN 2 ELSE 0 END AS INT) AS payload_match_count, o_custkey % 29 = 0 AS persistent_tracing FROM {{orders}} WHERE o_orderkey % 10 <> 0""")
_f = lambda code, cond: f"SELECT run_id, '{code}' AS code FROM facts WHERE outcome = 'COMPLETED' AND ({cond})"


@query("v13_runtime_facts_audit", "WITH " + verdict_sql("NO_NETWORK_RUNTIME", "OFFLINE_RUNTIME_POLICY_PASSED", "OFFLINE_RUNTIME_POLICY_FAILED", " UNION ALL ".join([
    _f("NETWORK_EVIDENCE_NOT_CAPTURED", "NOT network_evidence_captured"), _f("NETWORK_ATTEMPT_DETECTED", "network_attempt_count <> 0"), _f("MODEL_DOWNLOAD_ATTEMPT_DETECTED", "model_download_count <> 0"), _f("INTERNET_PERMISSION_PRESENT", "internet_permission"),
    _f("BROAD_STORAGE_PERMISSION_PRESENT", "broad_storage_permission"), _f("APP_PRIVATE_STORAGE_NOT_CONFIRMED", "NOT private_root"), _f("SESSION_CLEANUP_NOT_CONFIRMED", "NOT cleanup_completed"), _f("TEMPORARY_PERMISSION_SCOPE_INVALID", "NOT least_privilege")]),
    required="release_controls", skip=[("NOT release_controls", "NOT_APPLICABLE", "RELEASE_RUNTIME_CHECK_NOT_REQUIRED")] + _PROV("facts")))
def _(q):
    return shown(v.runtime_facts_audit(q.runs, q.facts))


@query("v14_logging_facts_audit", "WITH " + verdict_sql("SENSITIVE_LOGGING", "SENSITIVE_LOGGING_AUDIT_PASSED", "SENSITIVE_LOGGING_AUDIT_FAILED", " UNION ALL ".join([
    _f("LOGGING_STATIC_SCAN_NOT_COMPLETED", "NOT static_scan_completed"), _f("LOGGING_CANARY_SESSION_NOT_COMPLETED", "NOT canary_session_completed"), _f("SENSITIVE_LOG_PAYLOAD_DETECTED", "payload_match_count <> 0"), _f("PERSISTENT_PRODUCTION_TRACE_ENABLED", "persistent_tracing")]),
    required="release_controls", skip=[("NOT release_controls", "NOT_APPLICABLE", "LOGGING_RELEASE_AUDIT_NOT_REQUIRED")] + _PROV("facts")))
def _(q):
    return shown(v.logging_facts_audit(q.runs, q.facts))


_bit = lambda col, n, rest=0: f"l_partkey % {n} <> {rest} AS {col}"
fixture("assurance_evidence", f"""
SELECT l_orderkey * 10 + l_linenumber AS run_id, {case('l_suppkey % 4', cat.MODES)} AS output_mode, CAST(l_partkey % 5 AS INT) AS ceiling, {_bit('all_required_passed', 6)}, l_partkey % 41 = 1 AS failure_present, l_partkey % 43 = 1 AS externally_edited, {_bit('dependency_complete', 47)},
 l_partkey % 3 = 0 AS retained_pixels, l_partkey % 3 = 0 AND l_partkey % 53 <> 0 AS retained_declared, {_bit('approved_document', 11)}, {_bit('unicode_passed', 13)}, {_bit('url_passed', 17)}, {_bit('ambiguities_approved', 19)}, {_bit('fresh_render', 23)}, {_bit('bundled_assets', 29)}, {_bit('metadata_passed', 7)}, {_bit('ocr_passed', 8)} FROM {{lineitem}}""")
_names = "CASE level " + " ".join(f"WHEN {i} THEN '{a}'" for i, a in enumerate(cat.ASSURANCE)) + " END"


@query("v15_assurance_classify", f"""
WITH c AS (SELECT *, concat_ws(',', CASE WHEN retained_pixels <> retained_declared THEN 'SOURCE_PIXEL_DECLARATION_CONTRADICTION' END, CASE WHEN output_mode = 'DERIVATIVE_IMAGE' AND ceiling > 1 THEN 'DERIVATIVE_CEILING_CONTRADICTION' END,
  CASE WHEN output_mode = 'TEXT' AND retained_pixels THEN 'TEXT_OUTPUT_SOURCE_PIXEL_CONTRADICTION' END, CASE WHEN failure_present AND all_required_passed THEN 'VERIFICATION_STATUS_CONTRADICTION' END) AS contradictions FROM assurance_evidence),
k AS (SELECT *, CASE WHEN contradictions <> '' OR NOT all_required_passed OR failure_present OR externally_edited OR NOT dependency_complete THEN 0 WHEN output_mode = 'DERIVATIVE_IMAGE' THEN CASE WHEN metadata_passed THEN 1 ELSE 0 END
  WHEN output_mode = 'TEXT' THEN CASE WHEN approved_document AND unicode_passed AND url_passed AND ambiguities_approved THEN 2 ELSE 0 END WHEN retained_pixels THEN CASE WHEN metadata_passed AND ocr_passed THEN 3 ELSE 0 END
  WHEN fresh_render AND bundled_assets AND metadata_passed AND ocr_passed AND approved_document AND ambiguities_approved THEN 4 ELSE 0 END AS cand FROM c), l AS (SELECT *, least(cand, ceiling) AS level FROM k)
SELECT run_id, {_names} AS assurance_class, level, contradictions, count(*) AS n FROM l GROUP BY ALL""")
def _(q):
    return v.assurance_classify(q.assurance_evidence).groupBy("run_id", "assurance_class", "level", F.array_join("contradictions", ",").alias("contradictions")).agg(F.count("*").alias("n"))


fixture("results", f"""
SELECT DISTINCT l_orderkey AS run_id, {case('(l_orderkey + l_linenumber * 3) % 16', cat.CHECK_TYPES)} AS type, {case('l_orderkey % 5 * CASE WHEN l_orderkey % 2 = 0 THEN 1 ELSE 0 END', ('PASS', 'PASS_WITH_DECLARED_RESIDUAL', 'NOT_APPLICABLE', 'FAIL', 'NOT_RUN'))} AS status, l_orderkey % 3 <> 0 AS required FROM {{lineitem}}""")
_rank = "CASE type " + " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(cat.CHECK_TYPES)) + " END"
_pivot = ", ".join(f"coalesce(max(CASE WHEN type = '{t}' THEN status END), '-') AS {t.lower()}" for t in cat.CHECK_TYPES)
REPORT = f"""rep AS (SELECT run_id, {_pivot}, count(*) FILTER (WHERE required AND status NOT IN ('PASS', 'PASS_WITH_DECLARED_RESIDUAL', 'NOT_APPLICABLE')) AS n_blocking FROM results GROUP BY run_id),
lev AS (SELECT *, CASE WHEN n_blocking > 0 OR assurance_classifier IN ('-', 'FAIL', 'ERROR', 'NOT_RUN') THEN 0 ELSE 2 END AS level FROM rep)"""


def reports(q):
    res = q.results.withColumn("failures", F.array().cast("array<string>"))
    return v.verification_report(res, res.select("run_id").distinct().withColumn("level", F.lit(2)))


@query("v16_verification_report", f"WITH {REPORT} SELECT {', '.join(t.lower() for t in cat.CHECK_TYPES)}, run_id, n_blocking, {_names} AS assurance_class FROM lev")
def _(q):
    out = reports(q)
    return out.select("run_id", "n_blocking", "assurance_class", *[F.coalesce(t.lower(), F.lit("-")).alias(t.lower()) for t in cat.CHECK_TYPES])


@query("v17_release_gate", f"""WITH {REPORT}, b AS (SELECT run_id, string_agg(DISTINCT type, ',' ORDER BY type) AS types FROM results WHERE required AND status NOT IN ('PASS', 'PASS_WITH_DECLARED_RESIDUAL', 'NOT_APPLICABLE') GROUP BY 1)
SELECT l.run_id, level > 0 AND types IS NULL AND l.run_id % 7 <> 0 AND persistent_reopen_and_digest IN ('PASS', 'PASS_WITH_DECLARED_RESIDUAL', 'NOT_APPLICABLE') AS can_persist, coalesce(types, '') AS blocking_types FROM lev l LEFT JOIN b USING (run_id)""")
def _(q):
    pend = q.results.where("run_id % 7 = 0").select("run_id", F.lit("REVIEW_REQUIRED").alias("status"))
    out = v.release_gate(q.results, reports(q), pend)
    return out.select("run_id", "can_persist", F.array_join("blocking_types", ",").alias("blocking_types"))


@query("v18_convergence_check", """
SELECT doc_id AS family_id, TRUE AS converged, 1 AS distinct_texts, 3 AS variants, 0 AS residue_hits FROM documents""")
def _(q):
    from normlake.sources import texts

    docs = q.documents.select(F.col("doc_id").alias("id"), "text")
    docs = dealt(docs, "id")
    var = texts.generate_variants(docs, "newlines").select(F.col("id").alias("family_id"), "variant_id", F.col("value").alias("text"))
    residue = docs.select(F.col("id").alias("family_id"), F.lit("\r").alias("value"))
    out = v.convergence_check(var, residue, form="NFC")
    return out.select("family_id", "converged", F.col("distinct_texts").cast("int").alias("distinct_texts"), F.col("variants").cast("int").alias("variants"), F.col("residue_hits").cast("int").alias("residue_hits"))


@query("v19_report_consistency_audit", """
WITH x AS (SELECT DISTINCT run_id, run_id % 12 = 6 AS cut, run_id % 12 = 0 AND EXISTS (SELECT 1 FROM supplier WHERE s_name = 'Supplier#' || lpad(CAST(run_id % 2048 AS VARCHAR), 9, '0')) AS leaks FROM results)
SELECT run_id, 'HUMAN_READABLE_REPORT' AS type, CASE WHEN cut OR leaks THEN 'FAIL' ELSE 'PASS' END AS status, TRUE AS required, CASE WHEN cut OR leaks THEN 'HUMAN_REPORT_INCONSISTENT' ELSE 'HUMAN_REPORT_CONSISTENT' END AS summary_code,
 concat_ws(',', CASE WHEN leaks THEN 'REPORT_CANARY_DETECTED' END, CASE WHEN cut THEN 'REPORT_MACHINE_STATUS_MISMATCH' END) AS failures FROM x""")
def _(q):
    k = F.col("run_id") % 12
    rep = reports(q).select("run_id", F.when(k == 6, F.regexp_replace("lines", "^[^\n]*\n", "")).when(k == 0, F.concat("lines", F.lit("\nsent to "), F.format_string("Supplier#%09d", F.col("run_id") % 2048))).otherwise(F.col("lines")).alias("lines"))
    return shown(v.report_consistency_audit(rep, q.results, q.supplier.select(F.col("s_suppkey").alias("canary_id"), F.col("s_name").alias("secret"))))
