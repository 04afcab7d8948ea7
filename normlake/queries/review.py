"""Queries over review, lineage and run logs. Findings, ledgers and manifests derive from the order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from normlake.dims import catalog as cat
from normlake.operators import review as r
from normlake.operators import runlog as rl
from normlake.operators.text_findings import REVIEW_BLOCK
from normlake.queries.base import fixture, query, values_sql

S = "VARCHAR(100)"
CODES = list(REVIEW_BLOCK)
case = lambda expr, items, other="CAST(NULL AS VARCHAR(100))": f"CASE CAST({expr} AS INT) " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(items)) + f" ELSE {other} END"
cats = ("UNICODE", "CONFUSABLE", "URL", "LAYOUT", "SEMANTIC", "PUNCTUATION", "UNKNOWN")

fixture("findings", f"""
SELECT l_orderkey AS source_id, l_orderkey AS run_id, CAST(l_orderkey AS {S}) || '-' || CAST(l_linenumber AS {S}) || '-' || CAST(l_partkey AS {S}) || '-' || CAST(l_suppkey AS {S}) || '-' || CAST(CAST(l_quantity AS INT) AS {S}) AS finding_id,
  {case('l_partkey % 16', CODES)} AS review_code, {case('l_partkey % 7', cats)} AS category, {case('l_suppkey % 5', ('TXT-003', 'TXT-005', 'URL-005', 'TXT-004', 'TXT-008'))} AS block_id,
  {case('l_partkey % 3', ('DEFAULT_IGNORABLE_OR_CONTROL', 'MIXED_SCRIPT_TOKEN', 'BIDI_MARK'))} AS title, {case('l_suppkey % 4', ('OCR_DISAGREEMENT', 'CERTAIN_BY_PARSER', 'UNKNOWN', 'WEAK_HEURISTIC'))} AS confidence,
  CASE WHEN l_linenumber % 2 = 0 THEN 'NONE' ELSE 'POSSIBLE_MEANING_CHANGE' END AS semantic_risk, l_partkey % 16 < 14 AS requires_decision, 'DETECTED' AS status,
  CAST(l_suppkey % 50 AS INT) AS scalar_start, CAST(l_suppkey % 50 + l_linenumber AS INT) AS scalar_end FROM {{lineitem}}""")
fixture("approvals", "SELECT DISTINCT source_id, review_code FROM findings WHERE review_code IS NOT NULL AND (source_id + length(review_code)) % 3 <> 0")
fixture("ledger", f"""
SELECT DISTINCT l_orderkey AS run_id, l_orderkey AS source_id, CAST(l_partkey AS {S}) || '-' || CAST(l_linenumber AS {S}) AS change_id, {case('l_linenumber % 6', cat.TRANSFORMING[:6])} AS block_id,
  CAST(1 AS INT) AS block_version, 'UNICODE' AS category, CAST(NULL AS {S}) AS before, CAST(NULL AS {S}) AS after, CASE WHEN l_linenumber % 3 = 0 THEN 'POSSIBLE' ELSE 'NONE' END AS semantic_impact,
  CASE WHEN l_linenumber % 3 = 0 AND l_suppkey % 4 > 0 THEN 'PUNCTUATION_SEMANTICS_REVIEW' ELSE CAST(NULL AS {S}) END AS review_code FROM {{lineitem}}""")
fixture("runs", f"""
SELECT o_orderkey AS run_id, CAST(1 + o_custkey % 3 AS INT) AS document_revision, CAST(1 + o_custkey % 3 + CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS INT) AS ledger_revision, 'ledger-' || CAST(o_orderkey AS {S}) AS ledger_id,
  'ledger-' || CAST(o_orderkey - CASE WHEN o_orderkey % 13 = 0 THEN 1 ELSE 0 END AS {S}) AS document_ledger_id, CAST(1 + o_custkey % 3 AS INT) AS bundle_revision, {case('o_orderkey % 4', cat.MODES)} AS output_mode,
  o_orderkey % 5 <> 0 AS reading_order_approved, CAST(o_orderkey % 3 AS INT) AS n_regions, o_orderkey % 7 <> 0 AS regions_approved, o_orderkey % 3 <> 0 AS semantic_approved, o_orderkey % 2 = 0 AS assurance_acknowledged,
  CAST(1 + o_orderkey % 5 AS INT) AS artifact_revision, o_orderkey % 17 <> 0 AS dependency_maps_equal, o_orderkey % 3 <> 1 AS release_controls, o_orderkey % 2 = 1 AS strict_profile,
  CASE WHEN o_orderkey % 19 = 0 THEN CAST(NULL AS {S}) ELSE 'text ' || o_orderpriority END AS approved_text FROM {{orders}}""")
fixture("transformations", f"""
SELECT run_id, block_id, block_version, CAST(1 + run_id % 3 AS INT) AS canonical_revision, CASE WHEN run_id % 29 = 0 THEN change_id || 'x' ELSE change_id END AS change_id FROM ledger WHERE run_id % 23 <> 0""")
fixture("executed", f"SELECT DISTINCT run_id, block_id, block_version FROM ledger WHERE run_id % 31 <> 0")


@query("r01_review_gates", "SELECT source_id, review_code, count(*) AS n_findings, TRUE AS blocking, 'PENDING' AS status FROM findings WHERE review_code IS NOT NULL GROUP BY source_id, review_code")
def _(q):
    return r.review_gates(q.findings)


@query("r01_gate_members", "SELECT source_id, review_code, finding_id FROM findings WHERE review_code IS NOT NULL")
def _(q):
    return r.gate_members(q.findings)


@query("r02_gate_status", """
WITH g AS (SELECT DISTINCT source_id, review_code FROM findings WHERE review_code IS NOT NULL),
h AS (SELECT source_id, bool_or(review_code = 'COMPATIBILITY_NORMALIZATION_REVIEW') AS cg, bool_or(review_code = 'LANGUAGE_SENSITIVE_CONTROL_REVIEW') AS lg FROM g GROUP BY 1),
a AS (SELECT source_id, bool_or(review_code = 'COMPATIBILITY_NORMALIZATION_REVIEW') AS ca, bool_or(review_code = 'LANGUAGE_SENSITIVE_CONTROL_REVIEW') AS la FROM approvals GROUP BY 1)
SELECT g.source_id, g.review_code, TRUE AS blocking, CASE WHEN p.review_code IS NULL OR g.review_code IN ('MALFORMED_UNICODE_REVIEW', 'UNSUPPORTED_CONTROL_REVIEW') THEN 'PENDING'
  WHEN g.review_code = 'NORMALIZATION_COLLISION_REVIEW' AND cg AND NOT coalesce(ca, FALSE) THEN 'PENDING' WHEN g.review_code = 'BIDI_DISPLAY_REVIEW' AND lg AND NOT coalesce(la, FALSE) THEN 'PENDING' ELSE 'APPROVED' END AS status
FROM g JOIN h USING (source_id) LEFT JOIN a USING (source_id) LEFT JOIN approvals p ON p.source_id = g.source_id AND p.review_code = g.review_code""")
def _(q):
    return r.gate_status(r.review_gates(q.findings), q.approvals)


@query("r03_decisions", """
WITH g AS (SELECT DISTINCT source_id, review_code FROM findings WHERE review_code IS NOT NULL)
SELECT source_id, review_code, 'text-d-' || lower(review_code) AS decision_id, CASE WHEN review_code IN ('CODE_REGION_REVIEW', 'MATH_AND_RANGE_PUNCTUATION_REVIEW', 'IDENTIFIER_CONFUSABLE_REVIEW') THEN 'RETAIN_SOURCE_MEANING' ELSE 'ACCEPT_PROPOSED_CHANGE' END AS action,
  'PENDING' AS status, CASE WHEN review_code IN ('CODE_REGION_REVIEW', 'MATH_AND_RANGE_PUNCTUATION_REVIEW', 'IDENTIFIER_CONFUSABLE_REVIEW') THEN 'NONE' ELSE 'POSSIBLE' END AS impact, -1 AS canonical_revision FROM g""")
def _(q):
    return r.decisions(r.review_gates(q.findings)).withColumn("canonical_revision", F.coalesce("canonical_revision", F.lit(-1)))


@query("r04_ledger_violations", """
WITH u AS (SELECT * FROM ledger UNION ALL SELECT * FROM ledger WHERE source_id % 10 = 0)
SELECT source_id, change_id, 'DUPLICATE_CHANGE_ID' AS code FROM u GROUP BY source_id, change_id HAVING count(*) > 1
UNION ALL SELECT source_id, change_id, 'IMPACT_WITHOUT_REVIEW_LINK' FROM u WHERE semantic_impact <> 'NONE' AND review_code IS NULL""")
def _(q):
    led = q.ledger
    return r.ledger_violations(r.change_ledger([led, led.where("source_id % 10 = 0")]))


@query("r05_finding_status", """
SELECT f.source_id, f.finding_id, CASE WHEN f.source_id % 4 = 0 AND f.review_code IS NOT NULL THEN 'CHANGED' WHEN a.review_code IS NOT NULL THEN 'ACCEPTED' ELSE 'DETECTED' END AS status
FROM findings f LEFT JOIN approvals a ON a.source_id = f.source_id AND a.review_code = f.review_code""")
def _(q):
    members = r.gate_members(q.findings)
    return r.finding_status(q.findings, members.where("source_id % 4 = 0"), members.join(q.approvals, ["source_id", "review_code"])).select("source_id", "finding_id", "status")


@query("r06_review_queue", """
WITH w AS (SELECT DISTINCT source_id, finding_id, category, scalar_start, scalar_end FROM findings WHERE requires_decision OR semantic_risk <> 'NONE'),
d AS (SELECT w.*, substr(text, scalar_start + 1, least(scalar_end, length(text)) - least(scalar_start, length(text))) AS ex FROM w LEFT JOIN documents ON doc_id = source_id)
SELECT source_id, finding_id, CASE category WHEN 'URL' THEN 'LINK' WHEN 'CONFUSABLE' THEN 'MEANING' WHEN 'UNKNOWN' THEN 'UNKNOWN_DATA' ELSE 'HIDDEN_FORMATTING' END AS review_group, coalesce(ex, '<none>') AS excerpt,
  CASE WHEN ex IS NULL OR ex = '' THEN '<none>' ELSE 'U+' || printf('%04X', unicode(ex)) END AS code_point FROM d""")
def _(q):
    src = q.documents.select(F.col("doc_id").alias("source_id"), "text")
    out = r.review_queue(q.findings, src)
    return out.withColumn("excerpt", F.coalesce("excerpt", F.lit("<none>"))).withColumn("code_point", F.coalesce("code_point", F.lit("<none>")))


AUDITED = """
l AS (SELECT DISTINCT source_id AS run_id, finding_id FROM findings f WHERE EXISTS (SELECT 1 FROM approvals a WHERE a.source_id = f.source_id AND a.review_code = f.review_code)),
f2 AS (SELECT f.*, l.finding_id IS NOT NULL AS ok, requires_decision OR semantic_risk <> 'NONE' AS live FROM findings f LEFT JOIN l ON l.run_id = f.run_id AND l.finding_id = f.finding_id),
fl AS (SELECT *, live AND (block_id = 'TXT-003' OR (category = 'UNICODE' AND regexp_matches(title, 'INVISIBLE|IGNORABLE|BIDI'))) AS inv, live AND (block_id = 'TXT-005' OR category = 'CONFUSABLE') AS conf,
  live AND confidence = 'OCR_DISAGREEMENT' AS ocr, live AND category = 'URL' AS url, live AND category = 'LAYOUT' AS lay FROM f2),
p AS (SELECT run_id, count(*) FILTER (WHERE inv) AS n_inv, count(*) FILTER (WHERE inv AND NOT ok) AS o_inv, count(*) FILTER (WHERE conf) AS n_conf, count(*) FILTER (WHERE conf AND NOT ok) AS o_conf,
  count(*) FILTER (WHERE ocr) AS n_ocr, count(*) FILTER (WHERE ocr AND NOT ok) AS o_ocr, count(*) FILTER (WHERE url) AS n_url, count(*) FILTER (WHERE url AND NOT ok) AS o_url,
  count(*) FILTER (WHERE lay) AS n_lay, count(*) FILTER (WHERE lay AND NOT ok) AS o_lay, count(*) FILTER (WHERE category = 'SEMANTIC') AS n_sem, count(*) FILTER (WHERE requires_decision) AS n_dec FROM fl GROUP BY run_id),
t AS (SELECT run_id, count(*) AS n_tok, count(*) FILTER (WHERE semantic_impact <> 'NONE' AND review_code IS NULL) AS o_tok FROM ledger WHERE run_id % 2 = 0 GROUP BY 1),
j AS (SELECT r.*, coalesce(n_inv, 0) AS n_inv, coalesce(o_inv, 0) AS o_inv, coalesce(n_conf, 0) AS n_conf, coalesce(o_conf, 0) AS o_conf, coalesce(n_ocr, 0) AS n_ocr, coalesce(o_ocr, 0) AS o_ocr, coalesce(n_url, 0) AS n_url, coalesce(o_url, 0) AS o_url,
  coalesce(n_lay, 0) AS n_lay, coalesce(o_lay, 0) AS o_lay, coalesce(n_sem, 0) AS n_sem, coalesce(n_dec, 0) AS n_dec, coalesce(n_tok, 0) AS n_tok, coalesce(o_tok, 0) AS o_tok FROM runs r LEFT JOIN p USING (run_id) LEFT JOIN t USING (run_id))"""
_one = lambda kind, app, ok, none, yes, no, n: (
    f"SELECT run_id, '{kind}' AS audit_type, CASE WHEN NOT ({app}) THEN 'NOT_APPLICABLE' WHEN {ok} THEN 'PASS' ELSE 'REVIEW_REQUIRED' END AS status, CASE WHEN NOT ({app}) THEN '{none}' WHEN {ok} THEN '{yes}' ELSE '{no}' END AS summary_code, "
    f"CASE WHEN {app} THEN CAST({n} AS BIGINT) ELSE 0 END AS affected FROM j")


@query("r07_review_audit", f"WITH {AUDITED} " + " UNION ALL ".join([
    _one("INVISIBLE_CHARACTER", "n_inv > 0", "o_inv = 0", "NO_REVIEW_FINDINGS", "INVISIBLE_REVIEW_APPROVED", "INVISIBLE_REVIEW_PENDING", "n_inv"),
    _one("CONFUSABLE_CHARACTER", "n_conf > 0", "o_conf = 0", "NO_REVIEW_FINDINGS", "CONFUSABLE_REVIEW_APPROVED", "CONFUSABLE_REVIEW_PENDING", "n_conf"),
    _one("OCR_AMBIGUITY", "n_ocr > 0", "o_ocr = 0", "NO_REVIEW_FINDINGS", "OCR_AMBIGUITY_APPROVED", "OCR_AMBIGUITY_PENDING", "n_ocr"),
    _one("URL_POLICY", "n_url > 0 OR n_tok > 0", "o_url = 0 AND o_tok = 0", "NO_URL_REVIEW_REQUIRED", "URL_POLICY_APPROVED", "URL_POLICY_REVIEW_PENDING", "n_url"),
    _one("READING_ORDER", "n_lay > 0", "reading_order_approved AND o_lay = 0", "READING_ORDER_CONFIDENT", "READING_ORDER_APPROVED", "READING_ORDER_REVIEW_PENDING", "n_lay"),
    _one("IMAGE_REGION_POLICY", "output_mode IN ('REBUILT_IMAGE', 'BOTH') AND n_regions > 0", "regions_approved", "NO_IMAGE_REGION_REVIEW_REQUIRED", "IMAGE_REGION_POLICY_APPROVED", "IMAGE_REGION_REVIEW_PENDING", "n_regions"),
    _one("SEMANTIC_DIFF", "TRUE", "semantic_approved", "", "SEMANTIC_DIFF_APPROVED", "SEMANTIC_DIFF_INCOMPLETE", "n_sem"),
    _one("ASSURANCE_CONSEQUENCE", "TRUE", "assurance_acknowledged", "", "ASSURANCE_CONSEQUENCE_APPROVED", "ASSURANCE_CONSEQUENCE_NOT_APPROVED", "n_dec")]))
def _(q):
    return audits(q)


def audits(q):
    links = r.gate_members(q.findings).join(q.approvals, ["source_id", "review_code"]).select(F.col("source_id").alias("run_id"), "finding_id")
    tokens = q.ledger.where("run_id % 2 = 0").select("run_id", (F.col("semantic_impact") != "NONE").alias("changed"), F.col("review_code").isNotNull().alias("user_approved"))
    return r.review_audit(q.runs, q.findings, links, tokens)


LINEAGE = """lin AS (SELECT run_id, 'CHANGE_LEDGER_REVISION_MISMATCH' AS failure_code FROM runs WHERE ledger_revision <> document_revision
UNION SELECT run_id, 'CHANGE_LEDGER_REFERENCE_MISMATCH' FROM runs WHERE ledger_id <> document_ledger_id
UNION SELECT t.run_id, 'TRANSFORMATION_REVISION_MISMATCH' FROM transformations t JOIN runs USING (run_id) WHERE canonical_revision <> document_revision
UNION SELECT run_id, 'TRANSFORMATION_MANIFEST_LINK_MISMATCH' FROM transformations t WHERE NOT EXISTS (SELECT 1 FROM executed e WHERE e.run_id = t.run_id AND e.block_id = t.block_id AND e.block_version = t.block_version)
UNION SELECT t.run_id, 'CHANGE_LEDGER_ENTRY_MISSING' FROM transformations t WHERE NOT EXISTS (SELECT 1 FROM ledger l WHERE l.run_id = t.run_id AND l.change_id = t.change_id)
UNION SELECT t.run_id, 'CHANGE_LEDGER_BLOCK_LINK_MISMATCH' FROM transformations t JOIN ledger l ON l.run_id = t.run_id AND l.change_id = t.change_id WHERE l.block_id <> t.block_id OR l.block_version <> t.block_version
UNION SELECT run_id, 'CHANGE_LEDGER_SCOPE_MISMATCH' FROM (SELECT DISTINCT l.run_id FROM ledger l WHERE NOT EXISTS (SELECT 1 FROM transformations t WHERE l.run_id = t.run_id AND l.change_id = t.change_id)
   UNION SELECT DISTINCT t.run_id FROM transformations t WHERE NOT EXISTS (SELECT 1 FROM ledger l WHERE l.run_id = t.run_id AND l.change_id = t.change_id)))"""


@query("r08_lineage_integrity", f"WITH {LINEAGE} SELECT * FROM lin")
def _(q):
    q.hold("ledger")
    return r.lineage_integrity(q.runs, q.ledger, q.transformations, q.executed)


@query("r09_applied_transformations", "SELECT run_id, block_id, block_version, count(DISTINCT change_id) AS n_changes FROM ledger GROUP BY ALL")
def _(q):
    return r.transformation_summary(q.ledger)


fixture("declarations", f"""
SELECT l_orderkey AS doc_id, {case('l_linenumber % 7', list(r.DECLARATIONS))} AS declaration, l_partkey * 100000 + l_suppkey * 100 + CAST(l_quantity AS BIGINT) AS ordinal,
 'block-' || CAST(l_partkey AS {S}) AS block_id, 'region-' || CAST(l_linenumber AS {S}) AS region_id, 'decision-' || CAST(l_suppkey % 5 AS {S}) AS decision_id FROM {{lineitem}}""")
_rank = "CASE declaration " + " ".join(f"WHEN '{k}' THEN {v[0]}" for k, v in r.DECLARATIONS.items()) + " END"
_type = "CASE declaration " + " ".join(f"WHEN '{k}' THEN '{v[1]}'" for k, v in r.DECLARATIONS.items()) + " END"
_origin = "CASE declaration " + " ".join(f"WHEN '{k}' THEN '{v[2]}'" for k, v in r.DECLARATIONS.items()) + " END"


@query("r10_dependency_map", f"""
WITH o AS (SELECT doc_id, declaration, ordinal FROM declarations WHERE declaration <> 'USER_DECISION' UNION ALL SELECT doc_id, declaration, min(ordinal) FROM declarations WHERE declaration = 'USER_DECISION' GROUP BY doc_id, declaration, decision_id)
SELECT doc_id, 'imgdep-' || document_revision || '-' || {_rank} || '-' || ordinal AS dependency_id, {_type} AS type, {_origin} AS origin, {_type} = 'RETAINED_SOURCE_PIXELS' AS pixels_retained FROM o JOIN runs ON doc_id = run_id
UNION ALL SELECT run_id, 'imgdep-' || document_revision || '-7-0', 'CANONICAL_DOCUMENT_REVISION', 'CANONICAL_DOCUMENT', FALSE FROM runs""")
def _(q):
    revs = q.runs.select(F.col("run_id").alias("doc_id"), F.col("document_revision").alias("revision"))
    return r.dependency_map(q.declarations, revs).select("doc_id", "dependency_id", "type", "origin", "pixels_retained")


POLICIES = ("REBUILD_FROM_STRUCTURED_DATA", "SOLID_REDACT", "REMOVE", "RETAIN_SOURCE_PIXELS", "REPLACE_WITH_PLACEHOLDER")
fixture("region_requests", f"""
SELECT 'r' || CAST(o_orderkey AS {S}) AS region_id, {case('o_orderkey % 3', ('TEXT', 'UNKNOWN', 'NON_TEXT'))} AS detected_class, {case('o_custkey % 7', POLICIES)} AS requested_policy,
  CASE WHEN o_orderkey % 4 = 0 THEN 'd' ELSE CAST(NULL AS {S}) END AS decision_id, CASE WHEN o_orderkey % 5 = 0 THEN 'a' ELSE CAST(NULL AS {S}) END AS replacement_asset, o_orderkey % 2 = 0 AS evidence_available,
  CAST(o_custkey % 100 AS DOUBLE) / 100 AS confidence, {case('o_custkey % 3', ('CHAT_TRANSCRIPT', 'FORM', 'ARTICLE'))} AS proposed_kind FROM {{orders}}""")


@query("r11_region_policy", """
WITH p AS (SELECT *, coalesce(requested_policy, CASE detected_class WHEN 'TEXT' THEN 'REBUILD_FROM_STRUCTURED_DATA' WHEN 'UNKNOWN' THEN 'SOLID_REDACT' END) AS p FROM region_requests),
e AS (SELECT *, CASE WHEN p IS NULL THEN 'EXPLICIT_DISPOSITION_REQUIRED' WHEN detected_class = 'TEXT' AND p IN ('RETAIN_SOURCE_PIXELS', 'REPLACE_WITH_PLACEHOLDER') THEN 'TEXT_PIXELS_NOT_RETAINABLE' WHEN detected_class = 'UNKNOWN' AND p = 'RETAIN_SOURCE_PIXELS' THEN 'UNKNOWN_REGION_NOT_RETAINABLE'
  WHEN p = 'RETAIN_SOURCE_PIXELS' AND decision_id IS NULL THEN 'RETENTION_REQUIRES_DECISION' WHEN p = 'REPLACE_WITH_PLACEHOLDER' AND replacement_asset IS NULL THEN 'PLACEHOLDER_REQUIRES_ASSET' ELSE 'none' END AS error FROM p)
SELECT region_id, CASE WHEN error = 'none' THEN p ELSE '-' END AS policy, error = 'none' AND p = 'RETAIN_SOURCE_PIXELS' AS pixels_retained,
  error = 'none' AND (detected_class = 'UNKNOWN' OR p = 'RETAIN_SOURCE_PIXELS' OR (p = 'REBUILD_FROM_STRUCTURED_DATA' AND decision_id IS NULL) OR (detected_class = 'TEXT' AND p <> 'REBUILD_FROM_STRUCTURED_DATA')) AS review_required,
  error = 'none' AND (p = 'RETAIN_SOURCE_PIXELS' OR (p = 'REBUILD_FROM_STRUCTURED_DATA' AND decision_id IS NOT NULL)) AS user_approved, error FROM e""")
def _(q):
    out = r.region_policy(q.region_requests)
    no = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return out.select("region_id", F.coalesce("policy", F.lit("-")).alias("policy"), no("pixels_retained"), no("review_required"), no("user_approved"), F.coalesce("error", F.lit("none")).alias("error"))


@query("r12_unresolved_findings", """
SELECT DISTINCT f.run_id, f.finding_id FROM findings f WHERE requires_decision AND NOT EXISTS (SELECT 1 FROM approvals a JOIN runs r ON r.run_id = a.source_id WHERE a.source_id = f.source_id AND a.review_code = f.review_code AND 1 + a.source_id % 3 = r.bundle_revision)""")
def _(q):
    links = r.gate_members(q.findings).join(q.approvals, ["source_id", "review_code"]).select(
        F.col("source_id").alias("run_id"), "finding_id", F.lit("APPROVED").alias("status"), (F.lit(1) + F.col("source_id") % 3).alias("canonical_revision"))
    return r.unresolved_findings(q.findings, links, q.runs)


fixture("doc_blocks", f"""
SELECT l_orderkey AS doc_id, 'b' || CAST(l_linenumber AS {S}) AS block_id, CAST(l_linenumber AS INT) AS ordinal, CASE WHEN l_partkey % 3 = 0 THEN 'u' || CAST(l_suppkey % 10 AS {S}) ELSE CAST(NULL AS {S}) END AS url_token_id,
  CASE WHEN l_partkey % 5 = 0 THEN 'g' || CAST(l_suppkey % 4 AS {S}) ELSE CAST(NULL AS {S}) END AS region_id FROM {{lineitem}}""")
fixture("doc_order", "SELECT DISTINCT doc_id, ordinal, block_id FROM doc_blocks WHERE (doc_id + ordinal) % 19 <> 0")
fixture("doc_tokens", "SELECT DISTINCT doc_id, url_token_id AS token_id FROM doc_blocks WHERE url_token_id IS NOT NULL AND doc_id % 7 <> 0")
fixture("doc_regions", f"SELECT DISTINCT doc_id, region_id, CASE WHEN doc_id % 3 = 0 THEN 'd1' ELSE CAST(NULL AS {S}) END AS decision_id FROM doc_blocks WHERE region_id IS NOT NULL AND doc_id % 5 <> 0")
fixture("doc_decisions", "SELECT DISTINCT doc_id, 'd1' AS decision_id FROM doc_blocks WHERE doc_id % 6 <> 0")


@query("r13_document_integrity", """
SELECT DISTINCT doc_id, 'DUPLICATE_BLOCK_ID' AS failure_code FROM (SELECT doc_id, block_id FROM doc_blocks GROUP BY 1, 2 HAVING count(*) > 1)
UNION SELECT DISTINCT doc_id, 'READING_ORDER_BLOCK_SET_MISMATCH' FROM doc_blocks b WHERE NOT EXISTS (SELECT 1 FROM doc_order o WHERE o.doc_id = b.doc_id AND o.block_id = b.block_id)
UNION SELECT DISTINCT doc_id, 'URL_TOKEN_REFERENCE_MISSING' FROM doc_blocks WHERE url_token_id IS NOT NULL AND doc_id % 7 = 0
UNION SELECT DISTINCT doc_id, 'REGION_REFERENCE_MISSING' FROM doc_blocks WHERE region_id IS NOT NULL AND doc_id % 5 = 0
UNION SELECT DISTINCT doc_id, 'DECISION_REFERENCE_MISSING' FROM doc_regions WHERE decision_id IS NOT NULL AND doc_id % 6 = 0""")
def _(q):
    return r.document_integrity(q.doc_blocks, q.doc_order, q.doc_tokens, q.doc_regions, q.doc_decisions)


@query("r14_rebuild_suggestion", "SELECT region_id, CASE WHEN evidence_available THEN proposed_kind ELSE 'PLAIN_TEXT_FLOW' END AS kind, confidence, NOT evidence_available AS review_required FROM region_requests")
def _(q):
    return r.rebuild_suggestion(q.region_requests)


# ------------------------------------------------------------------------------------------------ run logs
PRESET_SQL = values_sql(["preset_id", "seq", "block_id", "block_version"], [(p[0], i, b, 1) for p in cat.PRESETS for i, b in enumerate(p[5])])
CATALOG_SQL = values_sql(["block_id", "transforming", "check_type"], [(b[0], b[7], b[13]) for b in cat.block_rows()])
KEYS_SQL = values_sql(["block_id", "k", "is_check"], [(b[0], k, b[9]) for b in cat.block_rows() for k in b[12]])
SIGNALS_SQL = values_sql(["signal", "k"], [(s, k) for s, v in cat.SIGNALS.items() for k in (v[0] or ("-",))])
fixture("preset_rows", PRESET_SQL)
fixture("preset_heads", values_sql(["preset_id", "input_kind", "output_mode", "ceiling", "high_assurance"], [p[:5] for p in cat.PRESETS]))
fixture("log_runs", f"""
SELECT c_custkey AS run_id, h.preset_id, CAST(CASE WHEN c_custkey % 41 = 0 THEN 2 ELSE 1 END AS INT) AS workflow_version, h.input_kind, CASE WHEN c_custkey % 43 = 0 THEN 'TEXT' ELSE h.output_mode END AS output_mode,
  CAST(CASE WHEN c_custkey % 47 = 0 THEN 50 ELSE 2000 END AS BIGINT) AS execution_revision, CAST(h.ceiling AS INT) AS ceiling, h.high_assurance FROM {{customer}}
  JOIN preset_heads h ON h.preset_id = {case('c_custkey % 8', [p[0] for p in cat.PRESETS])}""")
# Manifests follow their preset, with dropped, swapped, repeated, unknown and out-of-order entries in some runs.
fixture("manifest", """
SELECT r.run_id, CAST(CASE WHEN r.run_id % 17 = 3 AND p.seq = 5 THEN 6 WHEN r.run_id % 17 = 3 AND p.seq = 6 THEN 5 WHEN r.run_id % 19 = 4 AND p.seq > 10 THEN p.seq + 1 ELSE p.seq END AS INT) AS seq,
  CASE WHEN r.run_id % 23 = 5 AND p.seq = 12 THEN 'XXX-001' WHEN r.run_id % 31 = 6 AND p.seq = 9 THEN 'TXT-003' ELSE p.block_id END AS block_id, CAST(CASE WHEN r.run_id % 29 = 7 AND p.seq = 3 THEN 2 ELSE 1 END AS INT) AS block_version,
  CAST(CASE WHEN r.run_id % 37 = 8 AND p.seq = 20 THEN 1 ELSE (p.seq + 1) * 10 END AS BIGINT) AS execution_revision
FROM log_runs r JOIN preset_rows p ON p.preset_id = r.preset_id WHERE NOT (r.run_id % 13 = 2 AND p.seq = 8)""")


GIVES_SQL = values_sql(["block_id", "cap"], [(b, c) for b in cat.BLOCKS for c in cat.attribute(cat.GIVES, b)])
NEEDS_SQL = values_sql(["block_id", "cap"], [(b, c) for b in cat.BLOCKS for c in cat.attribute(cat.NEEDS, b)])
TYPES_SQL = values_sql(["block_id", "input_kind", "output_mode"], [(b[0], k, m) for b in cat.block_rows() for k in b[2] for m in b[3]])
TRAITS_SQL = values_sql(["block_id", "block_version", "transforming", "serializes", "verifies", "is_source", "exports"], [(b[0], b[1], *b[7:12]) for b in cat.block_rows()])
RULES_SQL = values_sql(["violation_code", "later", "earlier", "reason_code", "input_kind"], [rule[:4] + (rule[4] or "ANY",) for rule in rl.ORDER_RULES])


@query("p03_sequence_audit", f"""
WITH traits AS ({TRAITS_SQL}), gives AS ({GIVES_SQL}), needs AS ({NEEDS_SQL}), types AS ({TYPES_SQL}), rules AS ({RULES_SQL}),
k AS (SELECT m.run_id, m.seq, t.* FROM manifest m JOIN traits t ON t.block_id = m.block_id AND t.block_version = m.block_version),
f AS (SELECT run_id, block_id, min(seq) AS first FROM k GROUP BY 1, 2),
held AS (SELECT DISTINCT f.run_id, f.block_id, g.cap FROM f JOIN f p ON p.run_id = f.run_id AND p.first < f.first JOIN gives g ON g.block_id = p.block_id),
got AS (SELECT f.run_id, f.block_id, coalesce(list(h.cap) FILTER (WHERE h.cap IS NOT NULL), []) AS caps FROM f LEFT JOIN held h ON h.run_id = f.run_id AND h.block_id = f.block_id GROUP BY 1, 2),
x AS (SELECT r.*, e.* EXCLUDE (rid), d.blocks FROM log_runs r
  LEFT JOIN (SELECT run_id AS rid, count(*) FILTER (WHERE is_source) AS sources, count(*) FILTER (WHERE exports) AS exporters, min(seq) FILTER (WHERE is_source) AS src, min(seq) FILTER (WHERE verifies) AS ver,
    max(seq) FILTER (WHERE serializes) AS ser, min(seq) FILTER (WHERE block_id LIKE 'REN-%') AS ren, max(seq) FILTER (WHERE transforming) AS changed,
    bool_or(block_id LIKE 'DER-%') AS derives FROM k GROUP BY 1) e ON e.rid = r.run_id
  LEFT JOIN (SELECT run_id AS rid, map_from_entries(list((block_id, first))) AS blocks FROM f GROUP BY 1) d ON d.rid = r.run_id),
y AS (SELECT *, blocks['IN-005'] AS typed, blocks['URL-014'] AS url_ser, greatest({', '.join(f"blocks['{b}']" for b in rl.URL_POLICY_BLOCKS)}) AS url_policy, blocks['REV-008'] AS approved, blocks['TXT-017'] AS locked,
  blocks['REN-007'] AS pixels FROM x)
SELECT m.run_id, 'PV-018' AS violation_code, m.block_id, 'UNKNOWN_BLOCK_ID' AS reason_code FROM manifest m WHERE m.block_id NOT IN (SELECT block_id FROM traits)
UNION SELECT m.run_id, 'PV-018', m.block_id, 'UNKNOWN_BLOCK_VERSION' FROM manifest m JOIN traits t ON t.block_id = m.block_id AND t.block_version <> m.block_version
UNION SELECT run_id, 'PV-001', '-', 'SOURCE_BLOCK_COUNT_INVALID' FROM y WHERE sources IS DISTINCT FROM 1
UNION SELECT run_id, 'PV-002', '-', 'EXPORT_PREPARATION_COUNT_INVALID' FROM y WHERE exporters IS DISTINCT FROM 1
UNION SELECT run_id, 'PV-003', block_id, 'DUPLICATE_BLOCK_LOOP_REPRESENTATION' FROM manifest GROUP BY run_id, block_id HAVING count(*) > 1
UNION SELECT r.run_id, 'PV-005', p.block_id, 'MANDATORY_BLOCK_MISSING' FROM log_runs r JOIN preset_rows p ON p.preset_id = r.preset_id WHERE NOT EXISTS (SELECT 1 FROM manifest m WHERE m.run_id = r.run_id AND m.block_id = p.block_id)
UNION SELECT f.run_id, 'PV-017', f.block_id, 'BLOCK_TYPE_INCOMPATIBLE' FROM f JOIN log_runs r ON r.run_id = f.run_id WHERE NOT EXISTS (SELECT 1 FROM types t WHERE t.block_id = f.block_id AND t.input_kind = r.input_kind AND t.output_mode = r.output_mode)
UNION SELECT g.run_id, 'PV-004', g.block_id, 'INPUT_PREDICATE_UNSATISFIED' FROM got g JOIN needs n ON n.block_id = g.block_id WHERE NOT list_contains(caps, n.cap)
  AND NOT (g.block_id = 'OUT-IMG-001' AND n.cap = 'IMAGE_ARTIFACT' AND list_contains(caps, 'DERIVATIVE_ARTIFACT')) AND NOT (g.block_id = 'CAN-001' AND n.cap = 'TEXT_INSPECTED' AND list_contains(caps, 'IMAGE_INSPECTED'))
UNION SELECT g.run_id, 'PV-004', g.block_id, 'INPUT_PREDICATE_UNSATISFIED' FROM got g JOIN log_runs r ON r.run_id = g.run_id WHERE g.block_id = 'OUT-BND-001' AND NOT CASE r.output_mode WHEN 'TEXT' THEN list_contains(caps, 'TEXT_ARTIFACT')
  WHEN 'REBUILT_IMAGE' THEN list_contains(caps, 'IMAGE_ARTIFACT') WHEN 'BOTH' THEN list_has_all(caps, ['TEXT_ARTIFACT', 'IMAGE_ARTIFACT']) ELSE list_has_any(caps, ['DERIVATIVE_ARTIFACT', 'IMAGE_ARTIFACT']) END
UNION SELECT a.run_id, u.violation_code, u.later, u.reason_code FROM f a JOIN rules u ON u.later = a.block_id JOIN log_runs r ON r.run_id = a.run_id AND u.input_kind IN ('ANY', r.input_kind)
  WHERE NOT EXISTS (SELECT 1 FROM f b WHERE b.run_id = a.run_id AND b.block_id = u.earlier AND b.first < a.first)
UNION SELECT run_id, 'PV-004', 'IN-005', 'SOURCE_TYPE_BEFORE_SOURCE' FROM y WHERE typed <= coalesce(src, typed)
UNION SELECT run_id, 'PV-010', 'URL-014', 'URL_SERIALIZER_BEFORE_POLICY' FROM y WHERE url_ser <= coalesce(url_policy, url_ser)
UNION SELECT run_id, 'PV-012', '-', 'RENDER_BEFORE_CANONICAL_APPROVAL' FROM y WHERE ren IS NOT NULL AND (ren <= coalesce(approved, ren) OR locked IS NULL)
UNION SELECT run_id, 'PV-006', '-', 'VERIFICATION_BEFORE_FINAL_SERIALIZATION' FROM y WHERE ver <= coalesce(ser, ver)
UNION SELECT run_id, 'PV-007', '-', 'CONTENT_TRANSFORM_AFTER_VERIFICATION' FROM y WHERE changed > ver
UNION SELECT run_id, 'PV-015', '-', 'DECLARED_ASSURANCE_EXCEEDS_CEILING' FROM y WHERE ceiling > CASE WHEN output_mode = 'DERIVATIVE_IMAGE' OR coalesce(derives, FALSE) THEN 1 WHEN output_mode = 'TEXT' THEN 2 WHEN pixels IS NOT NULL THEN 3 ELSE 4 END
UNION SELECT run_id, 'PV-008', '-', 'DERIVATIVE_CEILING_VIOLATION' FROM y WHERE derives AND (output_mode <> 'DERIVATIVE_IMAGE' OR ceiling > 1)
UNION SELECT run_id, 'PV-009', 'REN-007', 'SOURCE_PIXEL_CEILING_VIOLATION' FROM y WHERE pixels IS NOT NULL AND ceiling > 3""")
def _(q):
    s = q.spark
    out = rl.sequence_audit(q.manifest, q.log_runs, cat.block_catalog(s), cat.preset_blocks(s))
    return out.withColumn("block_id", F.coalesce("block_id", F.lit("-")))


fixture("signals", f"SELECT o_orderkey AS signal_id, {case('o_orderkey % 8', list(cat.SIGNALS))} AS signal, {case('o_custkey % 4', cat.MODES)} AS output_mode FROM {{orders}}")
_sig = lambda i: "CASE s.signal " + " ".join(f"WHEN '{s}' THEN {'output_mode = ' + chr(39) + 'DERIVATIVE_IMAGE' + chr(39) if v[i] is None else str(v[i]).upper()}" for s, v in cat.SIGNALS.items()) + " END"


@query("p04_invalidation_plan", f"""
WITH sk AS ({SIGNALS_SQL}), bk AS ({KEYS_SQL}), bl AS ({CATALOG_SQL}),
x AS (SELECT DISTINCT sk.signal, bk.block_id FROM sk JOIN bk USING (k)),
a AS (SELECT signal, string_agg(block_id, ',' ORDER BY block_id) AS blocks, string_agg(check_type, ',' ORDER BY check_type) FILTER (WHERE check_type IS NOT NULL) AS checks FROM x JOIN bl USING (block_id) GROUP BY 1)
SELECT s.signal_id, s.signal, coalesce(blocks, '') AS block_ids, CASE s.signal WHEN 'SAVE_FILENAME_CHANGED' THEN 'SOURCE_REFERENCE' WHEN 'STORAGE_MIGRATED' THEN 'PERSISTENT_REOPEN_AND_DIGEST' ELSE coalesce(checks, '') END AS verifier_types,
  {_sig(1)} AS canonical, {_sig(2)} AS text, {_sig(3)} AS image, {_sig(4)} AS derivative, {_sig(5)} AS signature, {_sig(6)} AS revalidate,
  CASE s.signal WHEN 'DISPLAY_METADATA_CHANGED' THEN '-' ELSE 'AS_0_UNVERIFIED' END AS resulting_assurance FROM signals s LEFT JOIN a ON a.signal = s.signal""")
def _(q):
    out = rl.invalidation_plan(q.signals, cat.block_catalog(q.spark))
    flat = lambda c: F.array_join(F.coalesce(c, F.array().cast("array<string>")), ",").alias(c)
    return out.select("signal_id", "signal", flat("block_ids"), flat("verifier_types"), "canonical", "text", "image", "derivative", "signature", "revalidate", F.coalesce("resulting_assurance", F.lit("-")).alias("resulting_assurance"))


fixture("trace_events", f"""
SELECT event_id, user_id AS run_id, user_id AS session_id, ts, {case('event_id % 11', cat.BLOCKS[9:20])} AS block_id, CASE WHEN event_id % 9 = 0 THEN CAST(NULL AS {S}) ELSE {case('event_id % 8', rl.PHASES)} END AS phase,
  CASE WHEN event_id % 18 = 0 THEN 'TEXT_NORMALIZATION' ELSE CAST(NULL AS {S}) END AS transformation_category, CASE WHEN event_id % 50 = 0 THEN 'user said hi' ELSE 'BLOCK_PHASE_COMPLETE' END AS reason_code,
  {case('event_id % 3', ('SUCCESS', 'REVIEW_REQUIRED', 'RECOVERABLE_FAILURE'))} AS outcome, {case('event_id % 4', ('PASS', 'REVIEW_REQUIRED', 'FAIL', 'NOT_APPLICABLE'))} AS status FROM {{events}}""")


@query("p06_trace_coverage", f"""
WITH b AS (SELECT DISTINCT run_id, block_id FROM trace_events), ph AS ({values_sql(['phase'], [(p,) for p in rl.PHASES])}), t AS (SELECT DISTINCT run_id, block_id FROM trace_events WHERE event_id % 5 = 0)
SELECT b.run_id, b.block_id, ph.phase FROM b CROSS JOIN ph WHERE NOT EXISTS (SELECT 1 FROM trace_events e WHERE e.run_id = b.run_id AND e.block_id = b.block_id AND e.phase = ph.phase)
UNION ALL SELECT t.run_id, t.block_id, 'TRANSFORMATION' FROM t WHERE NOT EXISTS (SELECT 1 FROM trace_events e WHERE e.run_id = t.run_id AND e.block_id = t.block_id AND e.transformation_category IS NOT NULL)""")
def _(q):
    ev = q.trace_events
    return rl.trace_coverage(ev.select("run_id", "block_id"), ev.where("event_id % 5 = 0").select("run_id", "block_id"), ev)


@query("p06_trace_outcomes", """
SELECT run_id, block_id, CASE max(CASE WHEN status IN ('PASS', 'NOT_APPLICABLE') THEN 0 WHEN status = 'REVIEW_REQUIRED' THEN 1 ELSE 2 END) WHEN 0 THEN 'SUCCESS' WHEN 1 THEN 'REVIEW_REQUIRED' ELSE 'RECOVERABLE_FAILURE' END AS outcome FROM trace_events GROUP BY 1, 2""")
def _(q):
    return rl.trace_outcomes(q.trace_events)


@query("p07_trace_privacy_audit", """
SELECT event_id, CASE WHEN NOT regexp_full_match(reason_code, '[A-Z][A-Z0-9_]{1,63}') THEN 'REASON_CODE_NOT_CONTENT_FREE' ELSE 'PHASE_AND_CATEGORY_MISSING' END AS violation FROM trace_events
WHERE NOT regexp_full_match(reason_code, '[A-Z][A-Z0-9_]{1,63}') OR (phase IS NULL AND transformation_category IS NULL)""")
def _(q):
    return rl.trace_privacy_audit(q.trace_events)
