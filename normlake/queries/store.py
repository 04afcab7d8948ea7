"""Queries over stored results, images, observations, time and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from normlake.dims import catalog as cat
from normlake.operators import ocr, pixels as px, results as m, timing as tm
from normlake.queries.text import UNAPPROVED
from normlake.queries.base import fixture, query
from normlake.queries.review import S, case
from normlake.session import ensure_checkpoint_dir
from normlake.sources import images, stores
from normlake.streaming import streams

fixture("stored", f"""
SELECT 'result-' || CAST(o_orderkey AS {S}) AS saved_result_id, 'Label ' || o_orderpriority || ' ' || CAST(o_custkey AS {S}) AS display_label, {case('o_orderkey % 5', cat.MODES, "'BROKEN'")} AS output_mode, CAST(1 AS BIGINT) AS canonical_revision,
 {case('o_custkey % 5', cat.ASSURANCE)} AS assurance_class, {case('o_custkey % 5', cat.ASSURANCE)} AS original_verified_assurance, CASE WHEN o_custkey % 7 = 0 THEN 'FAILED' ELSE 'VERIFIED' END AS verification_state, 'IDEMPOTENCE=PASS;FINAL_URL=FAIL; ;broken' AS verification_statuses,
 CAST(o_custkey * 10 AS BIGINT) AS storage_byte_count, o_custkey % 3 = 0 AS favourite, CASE WHEN o_orderkey % 13 = 0 THEN 'REVALIDATION_REQUIRED' ELSE 'CURRENT' END AS migration_state,
 {case('o_orderkey % 11', ('AVAILABLE', 'AVAILABLE', 'AVAILABLE', 'AVAILABLE', 'AVAILABLE', 'AVAILABLE', 'AVAILABLE', 'COMMITTING', 'DELETION_PENDING', 'QUARANTINED', 'DELETED'))} AS lifecycle_state, CASE WHEN o_custkey % 17 = 0 THEN 'INVALID' ELSE 'VALID' END AS integrity_state,
 o_custkey % 19 <> 0 AS visibility_confirmed, CAST(NULL AS {S}) AS revalidation_reason_code, o_orderkey * 1000 AS persisted_at, FALSE AS external_export_known, CASE WHEN o_orderkey % 29 = 0 THEN '' ELSE 'k' END AS key_alias,
 CAST(1 + CASE WHEN o_orderkey % 31 = 0 THEN 1 ELSE 0 END AS BIGINT) AS verification_artifact_revision, CASE WHEN o_orderkey % 37 = 0 THEN CAST(NULL AS {S}) ELSE 'v' END AS verification_summary_reference, CAST(1 AS INT) AS verification_report_version, o_orderkey % 2 = 0 AS verified, o_orderkey AS k FROM {{orders}}""")
fixture("stored_artifacts", f"""
SELECT 'result-' || CAST(o_orderkey AS {S}) AS saved_result_id, t.kind AS artifact_kind, 'digest' || CAST(o_custkey AS {S}) AS content_digest, CAST(1 AS BIGINT) AS artifact_revision, CAST(o_custkey * 5 AS BIGINT) AS byte_count, CAST(1 AS BIGINT) AS canonical_revision,
 CASE WHEN t.kind = 'CANONICAL_TEXT' THEN 'text/plain' ELSE 'image/png' END AS mime_type, 'text é ' || o_orderpriority || ' ' || CAST(o_custkey AS {S}) AS body, 'p/' || CAST(o_orderkey AS {S}) || '/' || t.kind AS relative_path
FROM {{orders}} JOIN (SELECT 'CANONICAL_TEXT' AS kind, 'TEXT' AS md UNION ALL SELECT 'REBUILT_IMAGE', 'REBUILT_IMAGE' UNION ALL SELECT 'CANONICAL_TEXT', 'BOTH' UNION ALL SELECT 'REBUILT_IMAGE', 'BOTH' UNION ALL SELECT 'DERIVATIVE_IMAGE', 'DERIVATIVE_IMAGE') t
 ON t.md = {case('o_orderkey % 5', cat.MODES, "'BROKEN'")} AND NOT (o_orderkey % 23 = 0 AND t.kind = 'REBUILT_IMAGE')""")
SHARE = "visibility_confirmed AND lifecycle_state = 'AVAILABLE' AND verification_state = 'VERIFIED' AND integrity_state = 'VALID' AND migration_state = 'CURRENT'"
DIGEST = "dg AS (SELECT saved_result_id, sha256(string_agg(artifact_kind || ':' || content_digest || ':' || byte_count, '|' ORDER BY artifact_kind)) AS aggregate_digest FROM stored_artifacts GROUP BY 1)"


def with_digest(q):
    """Stored rows whose recorded digest is right, except on every 41st result."""
    d = m.aggregate_digest(q.stored_artifacts).select("saved_result_id", "aggregate_digest")
    return q.stored.join(d, "saved_result_id", "left").withColumn("content_digest", F.when(F.col("k") % 41 == 0, F.lit("bad")).otherwise(F.col("aggregate_digest"))).drop("aggregate_digest")


def payload_checks(q):
    k = F.regexp_extract("saved_result_id", "([0-9]+)$", 1).cast("bigint")
    return q.stored_artifacts.where(k % 47 != 0).select("saved_result_id", "artifact_kind", (k % 43 != 0).alias("accepted"), F.when(k % 2 == 0, F.lit(2)).alias("ceiling"))


@query("s08_migrate_v1_v2", f"SELECT saved_result_id, display_label, 'QUARANTINED' AS lifecycle_state, 'REVALIDATION_REQUIRED' AS verification_state, 'AS_0_UNVERIFIED' AS assurance_class, 'STALE' AS integrity_state, 'REVALIDATION_REQUIRED' AS migration_state, '' AS key_alias, FALSE AS visibility_confirmed FROM stored")
def _(q):
    v1 = q.stored.select("saved_result_id", "display_label", "lifecycle_state", "verification_state", "assurance_class")
    return stores.migrate_v1_v2(v1).select("saved_result_id", "display_label", "lifecycle_state", "verification_state", "assurance_class", "integrity_state", "migration_state", "key_alias", "visibility_confirmed")


@query("s07_write_results", f"SELECT saved_result_id, 'AVAILABLE' AS lifecycle_state, visibility_confirmed AND TRUE OR TRUE AS visibility_confirmed FROM stored WHERE saved_result_id IN (SELECT saved_result_id FROM stored_artifacts) AND k % 9 <> 0")
def _(q):
    raw = F.encode("body", "UTF-8")
    bad = F.regexp_extract("saved_result_id", "([0-9]+)$", 1).cast("bigint") % 9 == 0
    arts = q.stored_artifacts.select("saved_result_id", "artifact_kind", raw.alias("payload"), F.when(bad, F.lit("x")).otherwise(F.sha2(raw, 256)).alias("content_digest"), F.octet_length(raw).alias("byte_count"))
    path = f"{ensure_checkpoint_dir(q.spark)}/results-{uuid.uuid4().hex}"
    return stores.write_results(q.stored, arts, path, "0").select("saved_result_id", "lifecycle_state", "visibility_confirmed")


@query("m01_build_saved_results", f"""WITH {DIGEST} SELECT s.saved_result_id, coalesce(sum(byte_count), 0) AS storage_byte_count, 'FINAL_URL=FAIL;IDEMPOTENCE=PASS' AS verification_statuses, 'COMMITTING' AS lifecycle_state, coalesce(any_value(d.aggregate_digest), '-') AS content_digest
FROM stored s LEFT JOIN stored_artifacts a USING (saved_result_id) LEFT JOIN dg d ON d.saved_result_id = s.saved_result_id WHERE verified AND assurance_class <> 'AS_0_UNVERIFIED' GROUP BY s.saved_result_id""")
def _(q):
    st = q.stored.select("saved_result_id", F.explode(F.array(*[F.struct(F.lit(t).alias("type"), F.lit(s).alias("status")) for t, s in (("IDEMPOTENCE", "PASS"), ("FINAL_URL", "FAIL"))])).alias("x")).select("saved_result_id", "x.*")
    out = m.build_saved_results(q.stored, q.stored_artifacts, st)
    return out.select("saved_result_id", F.coalesce("storage_byte_count", F.lit(0)).alias("storage_byte_count"), "verification_statuses", "lifecycle_state", F.coalesce("content_digest", F.lit("-")).alias("content_digest"))


@query("m02_unpack_statuses", "SELECT saved_result_id, unnest(['IDEMPOTENCE', 'FINAL_URL', '-']) AS type, unnest(['PASS', 'FAIL', '-']) AS status, unnest([TRUE, TRUE, FALSE]) AS valid FROM stored")
def _(q):
    return m.unpack_statuses(q.stored).select("saved_result_id", F.coalesce("type", F.lit("-")).alias("type"), F.coalesce("status", F.lit("-")).alias("status"), "valid")


@query("m03_list_visible", f"SELECT saved_result_id, favourite, persisted_at, coalesce((SELECT string_agg(artifact_kind, ',' ORDER BY artifact_kind) FROM stored_artifacts a WHERE a.saved_result_id = s.saved_result_id), '') AS artifact_kinds FROM stored s WHERE {SHARE}")
def _(q):
    return m.list_visible(q.stored, q.stored_artifacts).select("saved_result_id", "favourite", "persisted_at", F.coalesce("artifact_kinds", F.lit("")).alias("artifact_kinds"))


@query("m04_search_results", f"SELECT saved_result_id, display_label, storage_byte_count FROM stored WHERE contains(lower(display_label), 'high') AND NOT ({SHARE})")
def _(q):
    return m.search_results(q.stored, "HIGH", "REVALIDATION_REQUIRED", "SIZE").select("saved_result_id", "display_label", "storage_byte_count")


@query("m05_shareable", f"""
WITH rq AS (SELECT k AS request_id, saved_result_id, CASE WHEN k % 3 = 0 THEN 'CANONICAL_TEXT' END AS sel FROM stored), n AS (SELECT saved_result_id, count(*) AS n FROM stored_artifacts GROUP BY 1)
SELECT request_id, CASE WHEN NOT ({SHARE}) THEN 'RECORD_NOT_SHAREABLE' WHEN sel IS NULL AND coalesce(n, 0) = 1 OR sel IS NOT NULL AND EXISTS (SELECT 1 FROM stored_artifacts a WHERE a.saved_result_id = rq.saved_result_id AND a.artifact_kind = sel) THEN 'SHAREABLE' ELSE 'RECORD_NOT_FOUND' END AS outcome
FROM rq JOIN stored s USING (saved_result_id) LEFT JOIN n USING (saved_result_id)""")
def _(q):
    rq = q.stored.select(F.col("k").alias("request_id"), "saved_result_id", F.when(F.col("k") % 3 == 0, F.lit("CANONICAL_TEXT")).alias("selected_kind"))
    return m.shareable(rq, q.stored, q.stored_artifacts).select("request_id", "outcome")


@query("m06_apply_management", f"SELECT saved_result_id, CASE WHEN {SHARE} AND k % 2 = 0 THEN 'New' ELSE display_label END AS display_label, CASE WHEN {SHARE} AND k % 2 = 0 THEN TRUE ELSE favourite END AS favourite, ({SHARE}) AND k % 4 = 0 AS external_export_known FROM stored")
def _(q):
    up = q.stored.where("k % 2 = 0").select("saved_result_id", F.lit("New").alias("new_label"), F.lit(True).alias("new_favourite"), (F.col("k") % 4 == 0).alias("exported"))
    return m.apply_management(q.stored, up).select("saved_result_id", "display_label", "favourite", "external_export_known")


_hit = "k % 3 = 0 AND lifecycle_state NOT IN ('DELETION_PENDING', 'DELETED')"


@query("m07_quarantine", f"SELECT saved_result_id, CASE WHEN {_hit} THEN 'QUARANTINED' ELSE lifecycle_state END AS lifecycle_state, CASE WHEN {_hit} THEN 'FAILED' ELSE verification_state END AS verification_state, CASE WHEN {_hit} THEN CASE WHEN k % 2 = 0 THEN 'FAILED' ELSE 'CURRENT' END ELSE migration_state END AS migration_state, CASE WHEN {_hit} THEN FALSE ELSE visibility_confirmed END AS visibility_confirmed FROM stored")
def _(q):
    bad = q.stored.where("k % 3 = 0").select("saved_result_id", F.when(F.col("k") % 2 == 0, F.lit("MIGRATION_REVALIDATION_REQUIRED")).otherwise(F.lit("PAYLOAD_DIGEST_MISMATCH")).alias("reason"))
    return m.quarantine(q.stored, bad).select("saved_result_id", "lifecycle_state", "verification_state", "migration_state", "visibility_confirmed")


@query("m08_aggregate_digest", f"WITH {DIGEST} SELECT * FROM dg")
def _(q):
    return m.aggregate_digest(q.stored_artifacts).drop("repeated")


_lvl = "CASE original_verified_assurance " + " ".join(f"WHEN '{a}' THEN {i}" for i, a in enumerate(cat.ASSURANCE)) + " END"
REVALIDATED = f"""ka AS (SELECT saved_result_id, string_agg(artifact_kind, ',' ORDER BY artifact_kind) AS kinds FROM stored_artifacts GROUP BY 1),
rv0 AS (SELECT s.*, kinds, {_lvl} AS lvl, CASE output_mode WHEN 'TEXT' THEN 'CANONICAL_TEXT' WHEN 'REBUILT_IMAGE' THEN 'REBUILT_IMAGE' WHEN 'BOTH' THEN 'CANONICAL_TEXT,REBUILT_IMAGE' WHEN 'DERIVATIVE_IMAGE' THEN 'DERIVATIVE_IMAGE' END AS want FROM stored s LEFT JOIN ka USING (saved_result_id)),
rv AS (SELECT *, CASE WHEN lifecycle_state IN ('DELETION_PENDING', 'DELETED', 'COMMITTING') THEN 'RECORD_NOT_SHAREABLE' WHEN key_alias = '' THEN 'KEY_UNAVAILABLE' WHEN lvl = 0 THEN 'MIGRATION_REVALIDATION_REQUIRED' WHEN want IS NULL THEN 'INVALID_VERIFIED_INPUT'
 WHEN kinds IS DISTINCT FROM want THEN 'RECORD_NOT_FOUND' WHEN verification_artifact_revision <> 1 THEN 'ARTIFACT_REVISION_MISMATCH' WHEN verification_summary_reference IS NULL THEN 'CANONICAL_REVISION_MISMATCH' WHEN k % 41 = 0 THEN 'PAYLOAD_DIGEST_MISMATCH'
 WHEN k % 47 = 0 OR k % 43 = 0 THEN 'VALIDATOR_REJECTED_ARTIFACT' ELSE 'REVALIDATION_PASSED' END AS reason_code, CASE WHEN k % 2 = 0 THEN least(lvl, 2) ELSE lvl END AS cap FROM rv0)"""


@query("m09_revalidate", f"WITH {REVALIDATED} SELECT saved_result_id, reason_code = 'REVALIDATION_PASSED' AS valid, reason_code, CASE WHEN reason_code <> 'REVALIDATION_PASSED' THEN 'AS_0_UNVERIFIED' ELSE CASE cap " + " ".join(f"WHEN {i} THEN '{a}'" for i, a in enumerate(cat.ASSURANCE)) + " END END AS assurance_class FROM rv")
def _(q):
    return m.revalidate(with_digest(q), q.stored_artifacts, payload_checks(q))


fixture("stored_previews", f"""SELECT saved_result_id, 'preview-' || CAST(k AS {S}) AS preview_reference, 'p/' || CAST(k AS {S}) || '/preview' AS relative_path, 'CANONICAL_TEXT' AS source_artifact_kind, 'digest' || CAST(CAST(storage_byte_count / 10 AS BIGINT) + CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS {S}) AS source_artifact_digest,
 CAST(10 AS BIGINT) AS byte_count, CAST(10 + CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END AS BIGINT) AS actual_bytes FROM stored WHERE k % 2 = 0""")
PREVIEWS = "pv AS (SELECT p.*, EXISTS (SELECT 1 FROM stored_artifacts a WHERE a.saved_result_id = p.saved_result_id AND a.artifact_kind = p.source_artifact_kind AND a.content_digest = p.source_artifact_digest) AND actual_bytes = byte_count AS valid FROM stored_previews p)"
fixture("stored_files", f"""SELECT relative_path AS path, 'RESULTS' AS area, saved_result_id AS group_id FROM stored_artifacts UNION ALL SELECT relative_path || '.tmp', 'RESULTS', saved_result_id FROM stored_artifacts WHERE byte_count % 7 = 0
 UNION ALL SELECT 'x/' || CAST(c_custkey AS {S}), CASE WHEN c_custkey % 2 = 0 THEN 'RESULTS' ELSE 'STAGING' END, 'lost-' || CAST(c_custkey % 100 AS {S}) FROM {{customer}}""")


def sweep(q):
    left = q.stored.where("k % 3 = 0").select("saved_result_id", F.lit("METADATA").alias("category"))
    ready = q.stored.where("k % 2 = 0").select("saved_result_id")
    return m.integrity_sweep(with_digest(q), q.stored_artifacts, q.stored_previews, payload_checks(q), q.stored_files, left, ready)


SWEEP_ACTIONS = f"""{REVALIDATED}, {PREVIEWS}, a AS (
SELECT CASE WHEN k % 3 = 0 THEN 'UNRESOLVED' ELSE 'DELETED' END AS action, CASE WHEN k % 3 = 0 THEN 'DELETION_RETRY_INCOMPLETE' ELSE 'DELETION_COMPLETED' END AS reason FROM stored WHERE lifecycle_state = 'DELETION_PENDING'
UNION ALL SELECT 'QUARANTINED', 'INCOMPLETE_TRANSACTION_QUARANTINED' FROM stored WHERE lifecycle_state = 'COMMITTING'
UNION ALL SELECT CASE WHEN migration_state <> 'CURRENT' AND k % 2 = 1 OR reason_code <> 'REVALIDATION_PASSED' THEN 'QUARANTINED' ELSE 'REVALIDATED' END, CASE WHEN migration_state <> 'CURRENT' AND k % 2 = 1 THEN 'MIGRATION_REVALIDATION_REQUIRED' ELSE reason_code END FROM rv WHERE lifecycle_state NOT IN ('DELETION_PENDING', 'COMMITTING')
UNION ALL SELECT 'PREVIEW_REMOVED', 'INVALID_PREVIEW_REMOVED' FROM pv JOIN rv USING (saved_result_id) WHERE NOT valid AND reason_code = 'REVALIDATION_PASSED' AND NOT (migration_state <> 'CURRENT' AND k % 2 = 1)
UNION ALL SELECT 'ORPHAN_REMOVED', 'ORPHAN_ARTIFACT_GROUP_REMOVED' FROM (SELECT DISTINCT group_id FROM stored_files WHERE area = 'RESULTS' AND group_id LIKE 'lost-%')
UNION ALL SELECT 'ORPHAN_REMOVED', 'ORPHAN_STAGING_GROUP_REMOVED' FROM (SELECT DISTINCT group_id FROM stored_files WHERE area = 'STAGING')
UNION ALL SELECT 'ORPHAN_REMOVED', 'UNREFERENCED_FILE_REMOVED' FROM stored_files WHERE path LIKE '%.tmp')"""


@query("m10_integrity_sweep", f"WITH {SWEEP_ACTIONS} SELECT action, reason, count(*) AS n FROM a GROUP BY ALL")
def _(q):
    return sweep(q).groupBy("action", "reason").agg(F.count("*").alias("n"))


@query("m10_sweep_report", f"""WITH {SWEEP_ACTIONS} SELECT (SELECT count(*) FROM stored) AS inspected, count(*) FILTER (WHERE action = 'REVALIDATED') AS revalidated,
 count(*) FILTER (WHERE action = 'QUARANTINED') AS quarantined, count(*) FILTER (WHERE action = 'DELETED') AS deleted, count(*) FILTER (WHERE action = 'PREVIEW_REMOVED') AS invalid_previews,
 count(*) FILTER (WHERE action = 'ORPHAN_REMOVED') AS orphan_groups, count(*) FILTER (WHERE reason IN ('INCOMPLETE_TRANSACTION_QUARANTINED', 'ORPHAN_STAGING_GROUP_REMOVED')) AS incomplete,
 count(*) FILTER (WHERE action = 'UNRESOLVED') AS unresolved FROM a""")
def _(q):
    return m.sweep_report(q.stored, sweep(q))


@query("m11_mark_deletion", "SELECT saved_result_id, CASE WHEN k % 4 = 0 THEN 'DELETION_PENDING' ELSE lifecycle_state END AS lifecycle_state, CASE WHEN k % 4 = 0 THEN 'INVALID' ELSE integrity_state END AS integrity_state, CASE WHEN k % 4 = 0 THEN 'AS_0_UNVERIFIED' ELSE assurance_class END AS assurance_class FROM stored")
def _(q):
    return m.mark_deletion(q.stored, q.stored.where("k % 4 = 0")).select("saved_result_id", "lifecycle_state", "integrity_state", "assurance_class")


@query("m11_deletion_report", "SELECT saved_result_id, k % 3 <> 0 AS completed, CASE WHEN k % 3 = 0 THEN 'SHARE_CACHE,METADATA' ELSE '' END AS remaining FROM stored WHERE k % 4 = 0")
def _(q):
    left = q.stored.where("k % 3 = 0").select("saved_result_id", F.explode(F.array(F.lit("METADATA"), F.lit("SHARE_CACHE"))).alias("category"))
    out = m.deletion_report(q.stored.where("k % 4 = 0"), left)
    return out.select("saved_result_id", "completed", F.array_join("remaining_categories", ",").alias("remaining"))


@query("m12_text_previews", """SELECT saved_result_id, artifact_kind, CASE WHEN artifact_kind <> 'CANONICAL_TEXT' THEN '-' WHEN octet_length(encode(substr(body, 1, 12))) > 12 THEN repeat('00', 12) ELSE hex(encode(substr(body, 1, 12))) END AS preview FROM (SELECT *, 'x' AS y FROM stored_artifacts)""")
def _(q):
    a = q.stored_artifacts.withColumn("payload", F.encode("body", "UTF-8"))
    out = m.text_previews(a.withColumn("saved_result_id", F.concat_ws("|", "saved_result_id", "artifact_kind")), 12)
    return out.select(F.split("saved_result_id", r"\|")[0].alias("saved_result_id"), F.split("saved_result_id", r"\|")[1].alias("artifact_kind"), F.coalesce(F.hex("preview"), F.lit("-")).alias("preview"))


@query("m13_preview_audit", f"WITH {PREVIEWS} SELECT saved_result_id, preview_reference, valid FROM pv")
def _(q):
    return m.preview_audit(q.stored_previews, q.stored_artifacts)


@query("m14_storage_usage", "SELECT coalesce(output_mode, 'ALL') AS output_mode, coalesce(assurance_class, 'ALL') AS assurance_class, CAST(sum(storage_byte_count) AS BIGINT) AS bytes, count(*) AS results FROM stored GROUP BY ROLLUP (output_mode, assurance_class)")
def _(q):
    return m.storage_usage(q.stored)


@query("m15_seal_open_payloads", "SELECT CASE WHEN byte_count % 3 = 0 THEN 'AUTHENTICATION_FAILED' ELSE 'OPENED' END AS outcome, count(*) AS n FROM stored_artifacts GROUP BY 1")
def _(q):
    raw = F.encode("body", "UTF-8")
    a = q.stored_artifacts.withColumn("payload", raw).withColumn("content_digest", F.sha2(raw, 256))
    key = F.lit("0123456789abcdef0123456789abcdef")
    sealed = m.seal_payloads(a, key).withColumn("mime_type", F.when(F.col("byte_count") % 3 == 0, F.lit("changed")).otherwise(F.col("mime_type")))
    return m.open_payloads(sealed, key).groupBy("outcome").agg(F.count("*").alias("n"))


fixture("summaries", f"SELECT o_orderkey AS id, {case('o_orderkey % 6', ('FINE', 'see content://x', 'at /data/x', 'Before value 3', 'https://a.b', 'destination app x'))} AS summary FROM {{orders}}")


@query("m16_safe_summary_audit", "SELECT id, summary FROM summaries WHERE id % 6 <> 0")
def _(q):
    return m.safe_summary_audit(q.summaries)


@query("m17_share_expiry", "SELECT k AS token FROM stored WHERE 5000000 < CASE WHEN k % 10 = 0 THEN 9223372036854775807 ELSE persisted_at + 600000 END AND k % 7 <> 0")
def _(q):
    e = q.stored.select(F.col("k").alias("token"), F.when(F.col("k") % 10 == 0, F.lit(9223372036854775000)).otherwise(F.col("persisted_at")).alias("prepared_at"), F.lit("d").alias("digest"), F.when(F.col("k") % 7 == 0, F.lit("e")).otherwise(F.lit("d")).alias("file_digest"), F.lit(1).alias("byte_count"), F.lit(1).alias("file_bytes"))
    return m.share_expiry(e, 5000000, 600000).select("token")


# ------------------------------------------------------------------------------------------------ images
fixture("headers", """SELECT l_orderkey * 10 + l_linenumber AS image_id, CAST(l_partkey * 7 AS INT) AS width, CAST(l_suppkey * 150 AS INT) AS height, CAST(CASE WHEN l_partkey % 5 = 0 THEN 16 ELSE 8 END AS INT) AS bit_depth, CAST(1 + l_suppkey % 4 AS INT) AS channels, l_partkey % 11 = 0 AS animated,
 CASE WHEN l_partkey % 22 = 0 THEN CAST(NULL AS INT) ELSE CAST(l_partkey % 3 AS INT) END AS frame_count FROM {lineitem}""")
_fit = lambda s: f"(ceil(width / {s}.0) * ceil(height / {s}.0) <= 1000000 AND ceil(width / {s}.0) * ceil(height / {s}.0) * bpp <= 3000000)"
_smp = "CASE " + " ".join(f"WHEN {_fit(2 ** i)} THEN {2 ** i}" for i in range(1, 8)) + " END"


@query("i01_image_resource_plan", f"""
WITH b AS (SELECT *, CASE WHEN bit_depth > 8 THEN 8 WHEN channels >= 3 THEN 4 ELSE 2 END AS bpp, CAST(width AS BIGINT) * height AS pxs FROM headers), s AS (SELECT *, {_smp} AS smp FROM b),
r AS (SELECT *, CASE WHEN width > 12000 OR height > 14000 THEN 'DIMENSION_LIMIT_EXCEEDED' WHEN animated AND frame_count IS NULL THEN 'FRAME_COUNT_UNKNOWN' WHEN animated AND frame_count > 1 THEN 'ANIMATION_REJECTED' WHEN pxs <= 1000000 AND pxs * bpp <= 3000000 THEN 'WITHIN_VALIDATED_BUDGET'
 WHEN smp IS NOT NULL THEN 'SAMPLING_REQUIRED' ELSE 'TILING_REQUIRED' END AS reason FROM s)
SELECT image_id, width, height, CASE WHEN reason = 'WITHIN_VALIDATED_BUDGET' THEN 'FULL' WHEN reason = 'SAMPLING_REQUIRED' THEN 'SAMPLED' WHEN reason = 'TILING_REQUIRED' THEN 'TILED' ELSE 'REJECT' END AS strategy, CAST(CASE WHEN reason = 'SAMPLING_REQUIRED' THEN smp ELSE 1 END AS INT) AS sample_size,
 CAST(CASE WHEN reason = 'WITHIN_VALIDATED_BUDGET' THEN pxs * bpp WHEN reason = 'SAMPLING_REQUIRED' THEN ceil(width / (smp * 1.0)) * ceil(height / (smp * 1.0)) * bpp ELSE -1 END AS BIGINT) AS estimated_bytes, reason FROM r""")
def _(q):
    h = q.headers.withColumn("image_id", F.struct("image_id", "width", "height"))
    out = px.image_resource_plan(h, 12000, 14000, 1000000, 3000000)
    return out.select("image_id.*", "strategy", "sample_size", F.coalesce("estimated_bytes", F.lit(-1)).alias("estimated_bytes"), "reason")


fixture("tags", f"""SELECT o_custkey AS image_id, CAST(o_orderkey % 6 AS INT) AS directory_idx, {case('o_orderkey % 6', ('Exif IFD0', 'Exif Thumbnail', 'XMP', 'JpegComment', 'Huffman', 'odd--name'))} AS directory_name,
 {case('o_orderkey % 6', ('com.drew.metadata.exif.ExifIFD0Directory', 'com.drew.metadata.exif.ExifThumbnailDirectory', 'com.drew.metadata.xmp.XmpDirectory', 'com.drew.metadata.jpeg.JpegCommentDirectory', 'com.drew.metadata.jpeg.HuffmanTablesDirectory', 'other'))} AS directory_class,
 o_orderkey AS tag_idx, CAST(0 AS INT) AS directory_errors FROM {{orders}}""")


@query("i02_metadata_inventory", """
SELECT image_id, directory_idx, CASE directory_idx WHEN 0 THEN 'EXIF_IFD0' WHEN 1 THEN 'EXIF_THUMBNAIL' WHEN 2 THEN 'XMP' WHEN 3 THEN 'JPEGCOMMENT' WHEN 4 THEN 'HUFFMAN' ELSE 'ODD_NAME' END AS directory,
 CASE directory_idx WHEN 0 THEN 'EXIF' WHEN 1 THEN 'EMBEDDED_THUMBNAIL' WHEN 2 THEN 'XMP' WHEN 3 THEN 'TEXT' WHEN 4 THEN 'ENCODER_STRUCTURE' ELSE 'UNKNOWN' END AS family, count(*) AS tags, TRUE AS complete FROM tags GROUP BY image_id, directory_idx""")
def _(q):
    return px.metadata_inventory(q.tags).select("image_id", "directory_idx", "directory", "family", F.col("tags").cast("long").alias("tags"), "complete")


# Every order is one pixel of a 5-wide image; its colour follows from its columns.
fixture("sizes", "SELECT o_custkey AS image_id, CAST(5 AS INT) AS width, CAST(floor((count(*) + 4) / 5) AS INT) AS height, CAST(1 + o_custkey % 8 AS INT) AS orientation FROM {orders} GROUP BY o_custkey")
fixture("pixels", """SELECT o_custkey AS image_id, CAST((n % 5) AS INT) AS x, CAST(floor(n / 5) AS INT) AS y, CAST(o_orderkey * 7919 % 16777216 - CASE WHEN o_orderkey % 10 = 0 THEN 0 ELSE 16777216 END AS INT) AS argb
 FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS n FROM {orders}) t""")
_ch = lambda s: f"((argb >> {s}) & 255)"
LUMA = f"(({_ch(16)} * 77 + {_ch(8)} * 150 + {_ch(0)} * 29) >> 8)"
SAMPLES = "smp AS (SELECT p.*, y * width + x AS flat, greatest(1, CAST(floor((width * height + 5) / 6) AS BIGINT)) AS st FROM pixels p JOIN sizes USING (image_id)), sa AS (SELECT image_id, x, y, argb, CAST(flat / st AS BIGINT) AS sample_idx FROM smp WHERE flat % st = 0)"


ALL_PIXELS = "sa AS (SELECT image_id, x, y, argb, CAST(y * width + x AS BIGINT) AS sample_idx FROM pixels JOIN sizes USING (image_id))"
fixture("detector_policies", "SELECT CASE r_regionkey WHEN 0 THEN 'lsb' WHEN 1 THEN 'spatial' ELSE 'none' END AS detector, r_name AS calibration_id, CAST(0.5 + 54 * r_regionkey AS DOUBLE) AS threshold FROM {region}")


def sampled(q):
    return px.sample_pixels(q.pixels, q.sizes, 6)


def every_pixel(q):
    """Samples with stride 1."""
    return px.sample_pixels(q.pixels, q.sizes, 1 << 40)


@query("i03_channel_inventory", f"SELECT image_id, {', '.join(f'min({_ch(s)}) AS min_{n}, max({_ch(s)}) AS max_{n}' for n, s in (('alpha', 24), ('red', 16), ('green', 8), ('blue', 0)))}, min({_ch(24)}) < 255 AS observed_transparency FROM pixels GROUP BY image_id")
def _(q):
    return px.channel_inventory(q.pixels)


@query("i04_orient_pixels", """SELECT image_id, CASE orientation WHEN 2 THEN width - 1 - x WHEN 3 THEN width - 1 - x WHEN 5 THEN y WHEN 6 THEN height - 1 - y WHEN 7 THEN height - 1 - y WHEN 8 THEN y ELSE x END AS x,
 CASE orientation WHEN 3 THEN height - 1 - y WHEN 4 THEN height - 1 - y WHEN 5 THEN x WHEN 6 THEN x WHEN 7 THEN width - 1 - x WHEN 8 THEN width - 1 - x ELSE y END AS y, argb FROM pixels JOIN sizes USING (image_id)""")
def _(q):
    return px.orient_pixels(q.pixels, q.sizes)


@query("i05_sample_pixels", f"WITH {SAMPLES} SELECT * FROM sa")
def _(q):
    return sampled(q)


def _rounded(df):
    return df.withColumn("value", F.round("value", 6))


@query("i06_lsb_evidence", f"""WITH {ALL_PIXELS}, b AS (SELECT image_id, sample_idx * 3 + j AS o, (argb >> (j * 8)) & 1 AS bit FROM sa, (SELECT unnest([0, 1, 2]) AS j)), t AS (SELECT *, lag(bit) OVER (PARTITION BY image_id ORDER BY o) AS p FROM b),
g AS (SELECT image_id, count(*) / 3.0 AS n, sum(bit) / count(*) AS r, count(*) FILTER (WHERE p IS NOT NULL AND p <> bit) / greatest(1, count(*) - 1) AS t FROM t GROUP BY 1)
SELECT image_id, unnest(['sample_count', 'one_ratio', 'transition_ratio']) AS metric, round(unnest([CAST(n AS DOUBLE), CAST(r AS DOUBLE), CAST(t AS DOUBLE)]), 6) AS value FROM g""")
def _(q):
    return _rounded(px.lsb_evidence(every_pixel(q)))


@query("i07_spatial_evidence", f"""WITH {ALL_PIXELS}, d AS (SELECT image_id, abs({LUMA} - lag({LUMA}) OVER (PARTITION BY image_id ORDER BY sample_idx)) AS d FROM sa), g AS (SELECT image_id, coalesce(avg(d), 0) AS m, coalesce(avg(d * d), 0) AS q FROM d GROUP BY 1)
SELECT image_id, unnest(['mean_adjacent_delta', 'delta_variance']) AS metric, round(unnest([m, greatest(0, q - m * m)]), 6) AS value FROM g""")
def _(q):
    return _rounded(px.spatial_evidence(every_pixel(q)))


@query("i08_frequency_evidence", f"""WITH l AS (SELECT p.image_id, x, y, width, height, {LUMA} AS v FROM pixels p JOIN sizes USING (image_id)),
lp AS (SELECT a.image_id, 4 * a.v - coalesce(w.v, 0) - coalesce(e.v, 0) - coalesce(n.v, 0) - coalesce(s.v, 0) AS lap FROM l a LEFT JOIN l w ON w.image_id = a.image_id AND w.x = a.x - 1 AND w.y = a.y LEFT JOIN l e ON e.image_id = a.image_id AND e.x = a.x + 1 AND e.y = a.y
 LEFT JOIN l n ON n.image_id = a.image_id AND n.x = a.x AND n.y = a.y - 1 LEFT JOIN l s ON s.image_id = a.image_id AND s.x = a.x AND s.y = a.y + 1 WHERE a.x > 0 AND a.x + 1 < a.width AND a.y > 0 AND a.y + 1 < a.height),
en AS (SELECT image_id, avg(lap * lap) AS e FROM lp GROUP BY 1), bl AS (SELECT image_id, y // 8 AS by, (sum(v) // count(*)) // 8 AS f1, (sum(v * v) // count(*)) // 64 AS f2 FROM l GROUP BY 1, 2), fp AS (SELECT image_id, f1, f2, count(*) AS n FROM bl GROUP BY ALL),
g AS (SELECT image_id, sum(n - 1) / sum(n) AS rep, sum(n) AS nb FROM fp GROUP BY 1)
SELECT g.image_id, unnest(['laplacian_energy', 'repeated_block_ratio', 'block_count']) AS metric, round(unnest([coalesce(e, 0), CAST(rep AS DOUBLE), CAST(nb AS DOUBLE)]), 6) AS value FROM g LEFT JOIN en USING (image_id)""")
def _(q):
    return _rounded(px.frequency_evidence(q.pixels, q.sizes))


@query("i09_detector_verdict", f"""WITH {ALL_PIXELS}, b AS (SELECT image_id, 'lsb' AS detector, sum((argb & 1) + ((argb >> 8) & 1) + ((argb >> 16) & 1)) / (count(*) * 3) AS v FROM sa GROUP BY 1),
d AS (SELECT image_id, abs({LUMA} - lag({LUMA}) OVER (PARTITION BY image_id ORDER BY sample_idx)) AS d FROM sa), m AS (SELECT * FROM b UNION ALL SELECT image_id, 'spatial', coalesce(avg(d), 0) FROM d GROUP BY 1)
SELECT image_id, detector, CASE WHEN v >= threshold THEN 'CALIBRATED_THRESHOLD_EXCEEDED' ELSE 'EVIDENCE_RECORDED' END AS disposition, FALSE AS can_certify_absence FROM m JOIN detector_policies USING (detector)""")
def _(q):
    metrics = px.lsb_evidence(every_pixel(q)).withColumn("detector", F.lit("lsb")).unionByName(px.spatial_evidence(every_pixel(q)).withColumn("detector", F.lit("spatial")))
    return px.detector_verdict(metrics, q.detector_policies)


_mono = lambda v: f"CAST(((argb >> 24) << 24) | ({v} << 16) | ({v} << 8) | {v} AS INT)"


@query("i10_pixel_views", f"""SELECT image_id, 'ORIGINAL' AS recipe, x, y, argb FROM pixels UNION ALL SELECT image_id, 'GRAYSCALE', x, y, argb & -16777216 | ({LUMA} * 65793) FROM pixels
UNION ALL SELECT image_id, 'INVERTED_GRAYSCALE', x, y, argb & -16777216 | ((255 - {LUMA}) * 65793) FROM pixels UNION ALL SELECT image_id, 'ROTATE_CLOCKWISE', height - 1 - y, x, argb FROM pixels JOIN sizes USING (image_id)""")
def _(q):
    return px.pixel_views(q.pixels, q.sizes).drop("view_id")


@query("i11_derivative_pixels", f"SELECT image_id, x, y, CAST(-16777216 | (({_ch(16)} & 240) << 16) | (({_ch(8)} & 240) << 8) | ({_ch(0)} & 240) AS INT) AS argb FROM pixels WHERE image_id % 5 <> 0 AND image_id % 7 <> 0")
def _(q):
    rq = q.sizes.select("image_id", (F.col("image_id") % 5 != 0).alias("acknowledged"), F.lit(True).alias("warning_matches"), F.lit(True).alias("retains_pixels"), F.lit(4).alias("bits"), (F.col("image_id") % 7 != 0).alias("readability_accepted"), F.lit(True).alias("comparison_reviewed"))
    return px.derivative_pixels(q.pixels, rq)


# Files of three formats with the sides of a line item; some PNG depths do not go with their colour, some BMP heads are of the old kind.
IMAGE_FILES = f"""
SELECT l_orderkey * 10 + l_linenumber AS path, {case('l_orderkey % 3', ('GIF', 'PNG', 'BMP'))} AS format, CAST(l_partkey AS BIGINT) AS w, CAST(l_suppkey AS BIGINT) AS h,
  CAST(CASE l_partkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 8 WHEN 2 THEN 16 ELSE 32 END AS INT) AS depth, CAST(CASE l_suppkey % 6 WHEN 5 THEN 7 WHEN 1 THEN 3 WHEN 3 THEN 6 ELSE l_suppkey % 6 END AS INT) AS colour,
  l_partkey % 2 = 0 AND l_partkey < 65536 AND l_suppkey < 65536 AS core, l_linenumber % 2 = 1 AS mistaken FROM {{lineitem}}"""
fixture("image_files", IMAGE_FILES)


@query("s06_image_files", """
WITH x AS (SELECT *, CASE format WHEN 'GIF' THEN 8 ELSE depth END AS bit_depth,
  CASE format WHEN 'GIF' THEN 3 WHEN 'BMP' THEN CASE WHEN depth = 32 THEN 4 ELSE 3 END ELSE CASE colour WHEN 0 THEN 1 WHEN 3 THEN 1 WHEN 4 THEN 2 WHEN 2 THEN 3 WHEN 6 THEN 4 END END AS channels FROM image_files)
SELECT path, format, CASE WHEN format = 'GIF' THEN w % 65536 ELSE w END AS width, CASE WHEN format = 'GIF' THEN h % 65536 ELSE h END AS height, bit_depth, coalesce(channels, 0) AS channels,
  CASE WHEN format = 'PNG' AND NOT CASE colour WHEN 0 THEN depth IN (1, 2, 4, 8, 16) WHEN 3 THEN depth IN (1, 2, 4, 8) WHEN 2 THEN depth IN (8, 16) WHEN 4 THEN depth IN (8, 16) WHEN 6 THEN depth IN (8, 16) ELSE FALSE END THEN 'INCONSISTENT_HEADER'
    WHEN w = 0 OR h = 0 OR (format = 'GIF' AND (w % 65536 = 0 OR h % 65536 = 0)) THEN 'INCONSISTENT_HEADER' WHEN mistaken THEN 'MIME_SIGNATURE_CONFLICT' ELSE 'none' END AS rejection FROM x""")
def _(q):
    def number(column, size, little=False):
        digits = F.lpad(F.hex(F.col(column) % (256 ** size)), 2 * size, "0")
        return F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))]) if little else digits

    pad = lambda n: F.lit("00" * n)
    gif = F.concat(F.lit("474946383961"), number("w", 2, True), number("h", 2, True), pad(2))
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), number("w", 4), number("h", 4), number("depth", 1), number("colour", 1), pad(3))
    old = F.concat(F.lit("424D"), pad(12), F.lit("0C000000"), number("w", 2, True), number("h", 2, True), F.lit("0100"), number("depth", 2, True))
    # A negative height says that the rows run from the top.
    new = F.concat(F.lit("424D"), pad(12), F.lit("28000000"), number("w", 4, True), number("down", 4, True), F.lit("0100"), number("depth", 2, True), pad(4))
    files = q.image_files.withColumn("down", F.when(F.col("mistaken"), F.lit(4294967296) - F.col("h")).otherwise(F.col("h")))
    made = F.when(F.col("format") == "GIF", gif).when(F.col("format") == "PNG", png).when(F.col("core"), old).otherwise(new)
    mime = F.concat(F.lit("image/"), F.lower("format"))
    img = files.select("path", F.unhex(made).alias("content"), F.when(F.col("mistaken"), F.lit("image/webp")).otherwise(mime).alias("claimed_mime"))
    out = images.image_headers(img)
    return out.select("path", "format", "width", "height", F.col("bit_depth").cast("int").alias("bit_depth"), F.coalesce("channels", F.lit(0)).alias("channels"), F.coalesce("rejection", F.lit("none")).alias("rejection"))


# ------------------------------------------------------------------------------------------------ observations
fixture("observations", f"""SELECT o_custkey AS image_id, o_orderkey AS seq, 'engine' || CAST(o_orderkey % 3 AS {S}) AS engine_id, 'view' || CAST(o_orderkey % 2 AS {S}) AS view_id, CASE WHEN o_orderkey % 13 = 0 THEN 'CYRILLIC' ELSE 'LATIN' END AS script,
 CASE WHEN o_orderkey % 4 = 0 THEN ' line  ' || CAST(o_orderkey % 5 AS {S}) ELSE 'line ' || CAST(o_orderkey % 5 AS {S}) END AS text, CAST(o_orderkey % 5 AS DOUBLE) / 8 + CAST(o_orderkey % 3 AS DOUBLE) / 64 AS x0, CAST(o_orderkey % 5 AS DOUBLE) / 8 AS y0,
 CAST(o_orderkey % 100 AS DOUBLE) / 100 AS confidence, CASE WHEN o_orderkey % 9 = 0 THEN CAST(NULL AS {S}) ELSE 'code ' || CAST(o_orderkey % 5 AS {S}) END AS decoded_value, CAST(CASE WHEN o_orderkey % 2 = 0 THEN 256 ELSE 1 END AS INT) AS format_code FROM {{orders}}""")
# Boxes of one line overlap by 3/4 or more and other lines are apart, so first-fit clusters are the lines.
CLUSTERS = "cl AS (SELECT *, min(seq) OVER (PARTITION BY image_id, seq % 5) AS cluster_id FROM observations)"


def observed(q):
    return q.observations.withColumns({"left": F.col("x0"), "top": F.col("y0"), "right": F.col("y0") + 0.125, "bottom": F.col("y0") + 0.125})


def clustered(q):
    return ocr.ocr_clusters(observed(q), 0.5)


@query("o01_ocr_clusters", f"WITH {CLUSTERS} SELECT image_id, seq, cluster_id FROM cl")
def _(q):
    return clustered(q).select("image_id", "seq", "cluster_id")


CONSENSUS = f"""{CLUSTERS}, so AS (SELECT image_id, cluster_id, count(DISTINCT engine_id || view_id) AS n, min(text) AS t0, arg_min(text, seq) AS tx, count(DISTINCT script) AS ns, max(x0) - min(x0) AS sp, max(abs(x0 - x1)) AS dl FROM (SELECT *, first_value(x0) OVER (PARTITION BY image_id, cluster_id ORDER BY seq) AS x1 FROM cl) GROUP BY 1, 2),
cs AS (SELECT *, concat_ws(',', CASE WHEN n < 2 THEN 'ENGINE_DISAGREEMENT' END, CASE WHEN dl > 0.02 THEN 'GEOMETRY_CONFLICT' END, CASE WHEN n < 2 THEN 'MISSING_ENGINE_OBSERVATION' END, CASE WHEN ns > 1 THEN 'SCRIPT_CONFLICT' END) AS reasons FROM so)"""


def consensus(q):
    return ocr.ocr_consensus(clustered(q), 2, 2, 0.02)


@query("o02_ocr_consensus", f"WITH {CONSENSUS} SELECT image_id, cluster_id, CASE WHEN reasons = '' THEN tx ELSE '-' END AS text, reasons FROM cs")
def _(q):
    return consensus(q).select("image_id", "cluster_id", F.coalesce("text", F.lit("-")).alias("text"), F.array_join("review_reasons", ",").alias("reasons"))


def lines(q):
    """One region per order; neighbours in an image share area when their order keys are close."""
    top = F.col("seq") % 8 / 10.0
    return q.observations.select("image_id", F.col("seq").alias("cluster_id"), "text", F.array().cast("array<string>").alias("review_reasons"), F.lit(0.1).alias("left"), top.alias("top"), F.lit(0.5).alias("right"), (top + 0.05).alias("bottom"))


@query("o03_ocr_overlaps", "SELECT a.image_id, a.seq AS cluster_id, EXISTS (SELECT 1 FROM observations b WHERE b.image_id = a.image_id AND b.seq <> a.seq AND b.seq % 8 = a.seq % 8) AS overlapping FROM observations a")
def _(q):
    return ocr.ocr_overlaps(lines(q)).select("image_id", "cluster_id", F.array_contains("review_reasons", "OVERLAPPING_READING_ORDER").alias("overlapping"))


@query("o04_reading_order", "SELECT image_id, seq AS cluster_id, row_number() OVER (PARTITION BY image_id ORDER BY seq % 8, seq) - 1 AS reading_order_index FROM observations")
def _(q):
    return ocr.reading_order(lines(q), "LEFT_TO_RIGHT", 0.1 / 1.0001).select("image_id", "cluster_id", "reading_order_index")


BARCODES = f"""{CLUSTERS}, bc AS (SELECT image_id, cluster_id, CASE WHEN arg_min(format_code, seq) = 256 THEN 'QR_CODE' ELSE 'BARCODE' END AS region_type, min(decoded_value) AS lo, count(DISTINCT view_id) FILTER (WHERE decoded_value IS NOT NULL) >= 2 AND count(*) = count(decoded_value) AS decoded FROM cl GROUP BY 1, 2)"""


@query("o05_barcode_consensus", f"WITH {BARCODES} SELECT image_id, cluster_id, region_type, decoded, CASE WHEN decoded THEN lo ELSE '-' END AS value, CASE WHEN decoded THEN 'REBUILD_FROM_STRUCTURED_DATA' ELSE 'SOLID_REDACT' END AS policy FROM bc")
def _(q):
    out = ocr.barcode_consensus(clustered(q), 2)
    return out.select("image_id", "cluster_id", "region_type", "decoded", F.coalesce("value", F.lit("-")).alias("value"), "policy")


# Payloads of a third of the images are plain codes, of a third links, and of a third links with a tracking parameter.
PAYLOAD = "CASE CAST(image_id % 3 AS INT) WHEN 0 THEN {0} WHEN 1 THEN 'https://example.com/p/' || right({0}, 1) ELSE 'https://example.com/p?utm_source=mail&id=' || right({0}, 1) END"


@query("o06_barcode_route", f"""
WITH {BARCODES}, paid AS (SELECT *, {PAYLOAD.format('lo')} AS payload FROM bc WHERE decoded)
SELECT image_id || '|' || cluster_id AS source_id, payload AS value, TRUE AS locked, 'QR_PAYLOAD' AS kind, CASE WHEN starts_with(payload, 'https://') THEN '-' ELSE 'PARSE_FAILED' END AS failure,
  CASE WHEN NOT starts_with(payload, 'https://') THEN '-' WHEN contains(payload, '?') THEN 'REMOVE_QUERY_AND_FRAGMENT' ELSE 'KEEP_FULL' END AS policy, CASE WHEN starts_with(payload, 'https://') THEN split_part(payload, '?', 1) ELSE '-' END AS proposed_text,
  CASE WHEN starts_with(payload, 'https://') THEN 'QR_PAYLOAD_REVIEW' ELSE 'PARSE_FAILURE_REVIEW,QR_PAYLOAD_REVIEW,SCHEMELESS_URL_REVIEW' END AS required_reviews FROM paid""")
def _(q):
    seen = observed(q).withColumn("decoded_value", F.expr(PAYLOAD.format("decoded_value")))
    out = ocr.barcode_route(ocr.barcode_consensus(ocr.ocr_clusters(seen, 0.5), 2))
    return out.select("source_id", "value", "locked", "kind", F.coalesce("failure", F.lit("-")).alias("failure"), F.coalesce("policy", F.lit("-")).alias("policy"), F.coalesce("proposed_text", F.lit("-")).alias("proposed_text"), F.coalesce("required_reviews", F.lit("-")).alias("required_reviews"))


@query("x07_session_windows", """WITH g AS (SELECT run_id, block_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM trace_events WINDOW w AS (PARTITION BY run_id, block_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY run_id, block_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS window_start, strftime(max(ts) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S') AS window_end, run_id, block_id, count(*) AS events FROM s GROUP BY run_id, block_id, k""")
def _(q):
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return tm.session_windows(q.trace_events).withColumns({"window_start": stamp("window_start"), "window_end": stamp("window_end")})


def _arriving(q, name):
    """A driver table as a stream of its files, and a new folder for what the stream writes."""
    table = q.table(name)
    return q.spark.readStream.schema(table.schema).parquet(f"{q.folder}/{name}.parque[t]"), f"{ensure_checkpoint_dir(q.spark)}/stream-{uuid.uuid4().hex}"


@query("x06_stream_canonicalize", f"""
WITH {UNAPPROVED} SELECT s.source_id, CASE WHEN strlen(s.text) > 8000 THEN 'REJECTED' ELSE 'ACCEPTED' END AS state, CASE WHEN strlen(s.text) > 8000 THEN '-' ELSE sha256(c.text) END AS digest
FROM as_stored s JOIN canonical c USING (source_id)""")
def _(q):
    docs, folder = _arriving(q, "documents")
    texts = docs.select(F.col("doc_id").alias("source_id"), "text", F.lit("PLAIN_TEXT").alias("source_kind"))
    streams.stream_canonicalize(texts, 8000, f"{folder}/out", f"{folder}/rejects", f"{folder}/progress", form="NFC").trigger(availableNow=True).start().awaitTermination()
    state = lambda path, name, digest: q.spark.read.parquet(path).select("source_id", F.lit(name).alias("state"), digest.alias("digest"))
    return state(f"{folder}/out/texts", "ACCEPTED", F.sha2("text", 256)).unionByName(state(f"{folder}/rejects", "REJECTED", F.lit("-")))


@query("x08_stream_seal_dedup", "SELECT DISTINCT user_id AS session_id FROM events")
def _(q):
    events, folder = _arriving(q, "events")
    once = streams.stream_seal_dedup(events.select(F.col("user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"))).select("session_id")
    once.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    return q.spark.read.schema(once.schema).parquet(f"{folder}/out")


# Rows arrive in four batches of about a week; every tenth comes one batch late.
fixture("arrivals", """
SELECT event_id, session_id, run_id, block_id, ts, CAST(CASE WHEN week + late > 3 THEN 3 ELSE week + late END AS INT) AS batch
FROM (SELECT *, FLOOR((day(ts) - 1) / 8) AS week, CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END AS late FROM trace_events) t""")
LATENESS_DAYS = 2
# The watermark that a batch meets, and the one that the stream ends with.
WATERMARKS = f"""marks AS (SELECT b.batch, (SELECT max(ts) FROM arrivals a WHERE a.batch < b.batch) - INTERVAL {LATENESS_DAYS} DAY AS mark FROM (SELECT DISTINCT batch FROM arrivals) b),
met AS (SELECT a.*, m.mark FROM arrivals a JOIN marks m USING (batch)),
last AS (SELECT max(ts) - INTERVAL {LATENESS_DAYS} DAY AS final_mark FROM arrivals)"""


def _in_batches(q, build, mode):
    """The arrivals, batch by batch, through a stream that is stopped and taken up again after each of them."""
    spark, folder = q.spark, f"{ensure_checkpoint_dir(q.spark)}/stream-{uuid.uuid4().hex}"
    rows = q.arrivals.withColumn("ts", F.col("ts").cast("timestamp"))
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for batch in range(4):
            rows.where(F.col("batch") == batch).write.mode("append").parquet(f"{folder}/in")
            out = build(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"))
            # A replayed batch overwrites itself.
            out.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/progress").foreachBatch(
                lambda part, k: part.write.mode("overwrite").parquet(f"{folder}/out/batch={k}")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(setting, before)
    return spark.read.schema(out.schema).parquet(f"{folder}/out/*")


@query("x05_stream_share_expiry", f"""WITH {WATERMARKS},
taken AS (SELECT event_id, ts FROM met WHERE mark IS NULL OR ts >= mark)
SELECT 'share-' || event_id AS token, 'PREPARED' AS event FROM taken
UNION ALL SELECT 'share-' || event_id, 'EXPIRED' FROM taken, last WHERE ts + INTERVAL 36 HOUR < final_mark""")
def _(q):
    def shares(arriving):
        entries = arriving.select(F.concat(F.lit("share-"), F.col("event_id").cast("string")).alias("token"), F.col("run_id").cast("string").alias("result_id"), "ts")
        return streams.stream_share_expiry(entries, 36 * 3600 * 1000, f"{LATENESS_DAYS} days")

    return _in_batches(q, shares, "update")


@query("x07_stream_sessions", f"""WITH {WATERMARKS},
taken AS (SELECT * FROM met WHERE mark IS NULL OR ts + INTERVAL 6 HOUR > mark),
sided AS (SELECT *, lag(ts) OVER w AS prev_ts, lag(batch) OVER w AS prev_batch FROM taken WINDOW w AS (PARTITION BY run_id, block_id ORDER BY ts)),
-- A late row opens a burst of its own if the one before it has been emitted.
g AS (SELECT run_id, block_id, ts, CASE WHEN ts - prev_ts > INTERVAL 6 HOUR OR prev_ts IS NULL THEN 1
  WHEN prev_batch < batch AND prev_ts + INTERVAL 6 HOUR <= mark AND NOT EXISTS (
    SELECT 1 FROM taken z WHERE z.run_id = sided.run_id AND z.block_id = sided.block_id AND z.batch < sided.batch AND z.ts > sided.ts AND z.ts <= sided.prev_ts + INTERVAL 6 HOUR) THEN 1
  ELSE 0 END AS new FROM sided),
s AS (SELECT *, sum(new) OVER (PARTITION BY run_id, block_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS window_start, strftime(max(ts) + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S') AS window_end, run_id, block_id, count(*) AS events
FROM s, last GROUP BY run_id, block_id, k, final_mark HAVING max(ts) + INTERVAL 6 HOUR <= final_mark""")
def _(q):
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    done = _in_batches(q, lambda arriving: streams.stream_sessions(arriving, "6 hours", f"{LATENESS_DAYS} days"), "append")
    return done.withColumns({"window_start": stamp("window_start"), "window_end": stamp("window_end")})


@query("x08_stream_seal_batches", "SELECT DISTINCT session_id FROM arrivals")
def _(q):
    # Seals outlive the stream, so a session is taken once over all batches.
    return _in_batches(q, lambda arriving: streams.stream_seal_dedup(arriving.select("session_id", "ts"), "3650 days").select("session_id"), "append")
