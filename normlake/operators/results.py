"""Stored results (M01-M17): state changes as projections and update joins over results and artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normlake.dims import catalog as cat
from normlake.operators.common import code_map, coded, union_all, unmatched

KINDS = ("CANONICAL_TEXT", "DERIVATIVE_IMAGE", "REBUILT_IMAGE")
# --- fixed values: artifact kinds of each output mode ---
MODE_KINDS = {
    "TEXT": ("CANONICAL_TEXT",), "REBUILT_IMAGE": ("REBUILT_IMAGE",), "BOTH": ("CANONICAL_TEXT", "REBUILT_IMAGE"),
    "DERIVATIVE_IMAGE": ("DERIVATIVE_IMAGE",),
}
_LEVELS = {name: str(i) for i, name in enumerate(cat.ASSURANCE)}


def shareable_condition() -> Column:
    return (
        F.col("visibility_confirmed") & (F.col("lifecycle_state") == "AVAILABLE") & (F.col("verification_state") == "VERIFIED")
        & (F.col("integrity_state") == "VALID") & (F.col("migration_state") == "CURRENT")
    )


def aggregate_digest(artifacts: DataFrame) -> DataFrame:
    """Digest of ``KIND:digest:bytes`` sorted by kind and joined by ``|``.

    There are three kinds, so the ordered list is three conditional maxima (map-side combined), not a
    collected group. A kind stored twice is counted in ``repeated``.
    """
    piece = F.concat_ws(":", "artifact_kind", "content_digest", F.col("byte_count").cast("string"))
    df = artifacts.groupBy("saved_result_id").agg(
        *[F.max(F.when(F.col("artifact_kind") == k, piece)).alias(k) for k in KINDS],
        (F.count("*") - F.count_distinct("artifact_kind")).alias("repeated"),
    )
    return df.select("saved_result_id", F.sha2(F.array_join(F.array(*KINDS), "|"), 256).alias("aggregate_digest"), "repeated")


def build_saved_results(bundles: DataFrame, artifacts: DataFrame, statuses: DataFrame) -> DataFrame:
    """COMMITTING rows for verified bundles: summed bytes, packed statuses, aggregate digest.

    bundles(saved_result_id, display_label, output_mode, canonical_revision, assurance_class, verified, ...);
    statuses(saved_result_id, type, status) packs in report order.
    """
    ok = bundles.where(F.col("verified") & (F.col("assurance_class") != "AS_0_UNVERIFIED")).select(
        "saved_result_id", "display_label", "output_mode", "canonical_revision", "assurance_class")
    sums = artifacts.groupBy("saved_result_id").agg(F.sum("byte_count").alias("storage_byte_count"))
    pack = [
        F.max(F.when(F.col("type") == t, F.concat(F.col("type"), F.lit("="), F.col("status")))).alias(t) for t in cat.CHECK_TYPES
    ]
    packed = statuses.groupBy("saved_result_id").agg(*pack).select(
        "saved_result_id", F.array_join(F.array(*cat.CHECK_TYPES), ";").alias("verification_statuses")
    )
    df = ok.join(sums, "saved_result_id", "left").join(packed, "saved_result_id", "left").join(
        aggregate_digest(artifacts).select("saved_result_id", F.col("aggregate_digest").alias("content_digest")), "saved_result_id", "left"
    )
    return df.select(
        "saved_result_id", "display_label", "output_mode", "canonical_revision", "assurance_class",
        F.col("assurance_class").alias("original_verified_assurance"), F.lit("PENDING").alias("verification_state"),
        "verification_statuses", "storage_byte_count", "content_digest", F.lit(False).alias("favourite"),
        F.lit("CURRENT").alias("migration_state"), F.lit("COMMITTING").alias("lifecycle_state"), F.lit("PENDING").alias("integrity_state"),
        F.lit(False).alias("visibility_confirmed"),
    )


def unpack_statuses(results: DataFrame) -> DataFrame:
    """One row per packed status; a token without ``=`` is reported as invalid."""
    tokens = F.filter(F.split("verification_statuses", ";"), lambda t: ~t.rlike(r"^\s*$"))
    rows = results.select("saved_result_id", F.explode(tokens).alias("t"))
    parts = F.split("t", "=", 2)
    valid = F.size(parts) == 2
    return rows.select(
        "saved_result_id", F.when(valid, parts[0]).alias("type"), F.when(valid, F.get(parts, F.lit(1))).alias("status"), valid.alias("valid")
    )


def list_visible(results: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Shareable results, favourites first, newest first; kinds attached from three conditional maxima."""
    kinds = artifacts.groupBy("saved_result_id").agg(
        *[F.max(F.when(F.col("artifact_kind") == k, F.col("artifact_kind"))).alias(k) for k in KINDS],
        F.sum("byte_count").alias("artifact_bytes"),
    )
    df = results.where(shareable_condition()).join(kinds, "saved_result_id", "left")
    df = df.withColumn("artifact_kinds", F.array_join(F.array(*KINDS), ",")).drop(*KINDS)
    return df.orderBy(F.desc("favourite"), F.desc("persisted_at"), F.asc("saved_result_id"))


_FILTERS = {
    "ALL": lambda: F.lit(True),
    "TEXT": lambda: F.col("output_mode") == "TEXT",
    "IMAGE": lambda: F.col("output_mode").isin("REBUILT_IMAGE", "BOTH"),
    "DERIVATIVE": lambda: F.col("output_mode") == "DERIVATIVE_IMAGE",
    "REVALIDATION_REQUIRED": lambda: ~shareable_condition(),
}
_SORTS = {
    "NEWEST": lambda: F.desc("persisted_at"),
    "OLDEST": lambda: F.asc("persisted_at"),
    "NAME": lambda: F.asc(F.lower("display_label")),
    "SIZE": lambda: F.desc("storage_byte_count"),
}


def search_results(results: DataFrame, query: str = "", kind: str = "ALL", sort: str = "NEWEST") -> DataFrame:
    """Label contains the query (any case), one of five filters, one of four orders."""
    df = results.where(_FILTERS[kind]())
    if query.strip():
        df = df.where(F.lower("display_label").contains(query.lower()))
    return df.orderBy(_SORTS[sort](), F.asc("saved_result_id"))


def shareable(requests: DataFrame, results: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Outcome of share requests (request_id, saved_result_id, selected_kind)."""
    ok = results.where(shareable_condition()).select("saved_result_id", F.lit(True).alias("_ok"))
    counts = artifacts.groupBy("saved_result_id").agg(F.count("*").alias("_n"), F.min("artifact_kind").alias("_only"))
    df = requests.join(ok, "saved_result_id", "left").join(counts, "saved_result_id", "left")
    wanted = artifacts.select("saved_result_id", F.col("artifact_kind").alias("selected_kind")).distinct().withColumn("_kind", F.lit(True))
    df = df.join(wanted, ["saved_result_id", "selected_kind"], "left")
    by_kind = F.col("selected_kind").isNotNull()
    found = F.when(by_kind, F.coalesce("_kind", F.lit(False))).otherwise(F.coalesce(F.col("_n") == 1, F.lit(False)))
    outcome = F.when(F.col("_ok").isNull(), F.lit("RECORD_NOT_SHAREABLE")).when(~found, F.lit("RECORD_NOT_FOUND")).otherwise(F.lit("SHAREABLE"))
    return df.select(
        "request_id", "saved_result_id", outcome.alias("outcome"),
        F.when(outcome == "SHAREABLE", F.coalesce("selected_kind", "_only")).alias("artifact_kind"),
    )


def apply_management(results: DataFrame, updates: DataFrame) -> DataFrame:
    """Rename, favourite and export marks, on shareable rows only.

    updates(saved_result_id, new_label, new_favourite, exported), one row per result.
    """
    df = results.join(updates, "saved_result_id", "left")
    ok = shareable_condition()
    keep = [c for c in results.columns if c not in ("display_label", "favourite", "external_export_known")]
    return df.select(
        *keep,
        F.when(ok, F.coalesce("new_label", "display_label")).otherwise(F.col("display_label")).alias("display_label"),
        F.when(ok, F.coalesce("new_favourite", "favourite")).otherwise(F.col("favourite")).alias("favourite"),
        (F.col("external_export_known") | (ok & F.coalesce("exported", F.lit(False)))).alias("external_export_known"),
    )


# --- fixed value: the quarantine reason that also marks a failed migration ---
_MIGRATION_REASON = "MIGRATION_REVALIDATION_REQUIRED"


def quarantine(results: DataFrame, failures: DataFrame) -> DataFrame:
    """Forced state for the named results (saved_result_id, reason), except ones being deleted."""
    why = failures.groupBy("saved_result_id").agg(F.min("reason").alias("_reason"))
    df = results.join(why, "saved_result_id", "left")
    hit = F.col("_reason").isNotNull() & ~F.col("lifecycle_state").isin("DELETION_PENDING", "DELETED")
    migration = F.col("_reason") == _MIGRATION_REASON
    new = {
        "visibility_confirmed": F.lit(False), "lifecycle_state": F.lit("QUARANTINED"), "assurance_class": F.lit("AS_0_UNVERIFIED"),
        "verification_state": F.lit("FAILED"), "integrity_state": F.lit("INVALID"),
        "migration_state": F.when(migration, F.lit("FAILED")).otherwise(F.lit("CURRENT")),
        "revalidation_reason_code": F.col("_reason"),
    }
    return df.select(*[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in results.columns])


def revalidate(results: DataFrame, artifacts: DataFrame, payload_checks: DataFrame) -> DataFrame:
    """First failing reason of every result, or the class it keeps (never above the original).

    payload_checks(saved_result_id, artifact_kind, accepted, ceiling): one row per opened artifact;
    an artifact without a row was not readable.
    """
    kinds = artifacts.groupBy("saved_result_id").agg(
        F.count("*").alias("_n"), F.array_sort(F.collect_set("artifact_kind")).alias("_kinds"),
        F.min("artifact_revision").alias("_low"), F.max("artifact_revision").alias("_high"),
    )
    digests = aggregate_digest(artifacts).select("saved_result_id", "aggregate_digest")
    opened = artifacts.select("saved_result_id", "artifact_kind").join(payload_checks, ["saved_result_id", "artifact_kind"], "left").groupBy("saved_result_id").agg(
        F.min(F.coalesce("accepted", F.lit(False))).alias("_accepted"), F.min("ceiling").alias("_cap")
    )
    df = results.join(kinds, "saved_result_id", "left").join(digests, "saved_result_id", "left").join(opened, "saved_result_id", "left")
    level = code_map(_LEVELS)[F.col("original_verified_assurance")].cast("int")
    want = F.create_map(*[x for m, ks in MODE_KINDS.items() for x in (F.lit(m), F.array(*[F.lit(k) for k in ks]))])[F.col("output_mode")]
    cap = F.least(level, F.coalesce("_cap", level))
    bad = lambda c: F.coalesce(c, F.lit(True))
    reason = (
        F.when(F.col("lifecycle_state").isin("DELETION_PENDING", "DELETED", "COMMITTING"), F.lit("RECORD_NOT_SHAREABLE"))
        .when(F.trim("key_alias") == "", F.lit("KEY_UNAVAILABLE"))
        .when(F.col("original_verified_assurance") == "AS_0_UNVERIFIED", F.lit(_MIGRATION_REASON))
        .when(want.isNull(), F.lit("INVALID_VERIFIED_INPUT"))
        .when(bad(F.col("_kinds") != F.array_sort(want)) | bad(F.col("_n") != F.size(want)), F.lit("RECORD_NOT_FOUND"))
        .when((F.col("_low") != F.col("_high")) | bad(F.col("_low") != F.col("verification_artifact_revision")), F.lit("ARTIFACT_REVISION_MISMATCH"))
        .when(F.col("verification_summary_reference").isNull() | F.col("verification_report_version").isNull(), F.lit("CANONICAL_REVISION_MISMATCH"))
        .when(bad(F.col("aggregate_digest") != F.col("content_digest")), F.lit("PAYLOAD_DIGEST_MISMATCH"))
        .when(~F.coalesce("_accepted", F.lit(False)) | (cap == 0), F.lit("VALIDATOR_REJECTED_ARTIFACT"))
    )
    valid = F.col("reason").isNull()
    names = F.array(*[F.lit(a) for a in cat.ASSURANCE])
    return df.withColumn("reason", reason).withColumn("_level", cap).select(
        "saved_result_id", valid.alias("valid"), F.coalesce("reason", F.lit("REVALIDATION_PASSED")).alias("reason_code"),
        F.when(valid, F.get(names, F.col("_level"))).otherwise(F.lit("AS_0_UNVERIFIED")).alias("assurance_class"),
    )


def integrity_sweep(
    results: DataFrame, artifacts: DataFrame, previews: DataFrame, payload_checks: DataFrame, files: DataFrame,
    remaining: DataFrame, ready_migrations: DataFrame,
) -> DataFrame:
    """Actions of one sweep (target, action, reason).

    files(path, area, group_id) lists stored and staged files; remaining(saved_result_id, category) are
    references a retried deletion could not remove; ready_migrations(saved_result_id) may be revalidated.
    """
    state = F.col("lifecycle_state")
    act = lambda df, target, action, reason: df.select(
        F.col(target).alias("target"), (F.lit(action) if isinstance(action, str) else action).alias("action"),
        (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"))
    left = remaining.select("saved_result_id", F.lit(True).alias("_left")).distinct()
    pending = results.where(state == "DELETION_PENDING").join(left, "saved_result_id", "left")
    deletions = act(pending, "saved_result_id", F.when(F.col("_left"), F.lit("UNRESOLVED")).otherwise(F.lit("DELETED")),
                    F.when(F.col("_left"), F.lit("DELETION_RETRY_INCOMPLETE")).otherwise(F.lit("DELETION_COMPLETED")))
    incomplete = act(results.where(state == "COMMITTING"), "saved_result_id", "QUARANTINED", "INCOMPLETE_TRANSACTION_QUARANTINED")
    rest = results.where(~state.isin("DELETION_PENDING", "COMMITTING"))
    stale = rest.where("migration_state <> 'CURRENT'").join(ready_migrations.select("saved_result_id"), "saved_result_id", "left_anti")
    blocked = act(stale, "saved_result_id", "QUARANTINED", "MIGRATION_REVALIDATION_REQUIRED")
    checked = revalidate(rest.join(stale.select("saved_result_id"), "saved_result_id", "left_anti"), artifacts, payload_checks)
    judged = act(checked, "saved_result_id", F.when(F.col("valid"), F.lit("REVALIDATED")).otherwise(F.lit("QUARANTINED")), F.col("reason_code"))
    bad_previews = preview_audit(previews, artifacts).where("NOT valid").join(checked.where("valid").select("saved_result_id"), "saved_result_id", "left_semi")
    dropped = act(bad_previews, "saved_result_id", "PREVIEW_REMOVED", "INVALID_PREVIEW_REMOVED")
    ids = results.select(F.col("saved_result_id").alias("group_id"))
    stored, staged = files.where("area = 'RESULTS'"), files.where("area = 'STAGING'")
    orphan = act(stored.join(ids, "group_id", "left_anti").select("group_id").distinct(), "group_id", "ORPHAN_REMOVED", "ORPHAN_ARTIFACT_GROUP_REMOVED")
    staging = act(staged.select("group_id").distinct(), "group_id", "ORPHAN_REMOVED", "ORPHAN_STAGING_GROUP_REMOVED")
    known = artifacts.select(F.col("relative_path").alias("path")).unionByName(previews.select(F.col("relative_path").alias("path")))
    loose = act(stored.join(ids, "group_id", "left_semi").join(known, "path", "left_anti"), "path", "ORPHAN_REMOVED", "UNREFERENCED_FILE_REMOVED")
    return union_all([deletions, incomplete, blocked, judged, dropped, orphan, staging, loose])


def sweep_report(results: DataFrame, actions: DataFrame) -> DataFrame:
    """The eight counters of a sweep."""
    a, r = F.col("action"), F.col("reason")
    counts = actions.agg(
        F.count_if(a == "REVALIDATED").alias("revalidated"), F.count_if(a == "QUARANTINED").alias("quarantined"),
        F.count_if(a == "DELETED").alias("deleted"), F.count_if(a == "PREVIEW_REMOVED").alias("invalid_previews"),
        F.count_if(a == "ORPHAN_REMOVED").alias("orphan_groups"),
        F.count_if(r.isin("INCOMPLETE_TRANSACTION_QUARANTINED", "ORPHAN_STAGING_GROUP_REMOVED")).alias("incomplete"),
        F.count_if(a == "UNRESOLVED").alias("unresolved"),
    )
    return results.agg(F.count("*").alias("inspected")).crossJoin(counts)


def mark_deletion(results: DataFrame, ids: DataFrame) -> DataFrame:
    """State flip for a set of ids; marking twice changes nothing."""
    df = results.join(ids.select("saved_result_id").distinct().withColumn("_mark", F.lit(True)), "saved_result_id", "left")
    new = {
        "visibility_confirmed": F.lit(False), "lifecycle_state": F.lit("DELETION_PENDING"), "verification_state": F.lit("INVALIDATED"),
        "integrity_state": F.lit("INVALID"), "assurance_class": F.lit("AS_0_UNVERIFIED"), "revalidation_reason_code": F.lit("DELETION_PENDING"),
    }
    return df.select(*[F.when(F.col("_mark"), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in results.columns])


# --- fixed values: reference categories a deletion must clear ---
CATEGORIES = ("ENCRYPTION_KEY", "SHARE_CACHE", "STAGING_ARTIFACTS", "PERSISTENT_ARTIFACTS", "PREVIEW", "METADATA")


def deletion_report(ids: DataFrame, remaining: DataFrame) -> DataFrame:
    """Remaining reference categories per id (a closed list); complete when none is left."""
    left = remaining.groupBy("saved_result_id").agg(*[F.max(F.when(F.col("category") == c, F.lit(c))).alias(c) for c in CATEGORIES])
    df = ids.select("saved_result_id").distinct().join(left, "saved_result_id", "left")
    found = F.array_compact(F.array(*CATEGORIES))
    return df.select("saved_result_id", (F.size(found) == 0).alias("completed"), found.alias("remaining_categories"))


def text_previews(artifacts: DataFrame, max_bytes: int) -> DataFrame:
    """Prefix of max_bytes UTF-16 units of text artifacts; an encoded form that is still too long is
    returned as that many zero bytes, as the stored format prescribes; other artifacts get an icon.

    artifacts(saved_result_id, artifact_kind, mime_type, payload).
    """
    text = F.decode("payload", "UTF-8")
    textual = (F.col("artifact_kind") == "CANONICAL_TEXT") & F.col("mime_type").startswith("text/")
    df = artifacts.withColumn("_cut", F.encode(_utf16_prefix(text, max_bytes), "UTF-8"))
    zero = F.unhex(F.repeat(F.lit("00"), max_bytes))
    preview = F.when(F.octet_length("_cut") <= max_bytes, F.col("_cut")).otherwise(zero)
    ok = F.coalesce(textual & (F.octet_length("_cut") > 0), F.lit(False))
    return df.select(
        "saved_result_id", F.when(ok, preview).alias("preview"), F.when(~ok, F.lit("PREVIEW_GENERATION_FAILED")).alias("reason"),
    )


def _utf16_prefix(text: Column, units: int) -> Column:
    """First ``units`` UTF-16 code units; only texts with characters beyond the basic plane need the slow path."""
    from normlake.functions.text import indexed_chars

    head = F.substring(text, 1, units)
    kept = F.filter(indexed_chars(head), lambda u: u["u16"] + F.when(F.ascii(u["c"]) > 65535, 2).otherwise(1) <= units)
    exact = F.array_join(F.transform(kept, lambda u: u["c"]), "")
    return F.when(head.rlike(r"[\x{10000}-\x{10FFFF}]"), exact).otherwise(head)


def preview_audit(previews: DataFrame, artifacts: DataFrame) -> DataFrame:
    """A preview needs exactly one artifact of its kind and digest, and its recorded length."""
    match = artifacts.groupBy("saved_result_id", "artifact_kind", "content_digest").agg(F.count("*").alias("_n"))
    df = previews.join(
        match.select("saved_result_id", F.col("artifact_kind").alias("source_artifact_kind"), F.col("content_digest").alias("source_artifact_digest"), "_n"),
        ["saved_result_id", "source_artifact_kind", "source_artifact_digest"], "left",
    )
    good = F.coalesce(F.col("_n") == 1, F.lit(False)) & F.coalesce(F.col("actual_bytes") == F.col("byte_count"), F.lit(False))
    return df.select("saved_result_id", "preview_reference", good.alias("valid"))


def storage_usage(results: DataFrame) -> DataFrame:
    """Bytes and rows by output mode and assurance class, with subtotals and the total."""
    return results.rollup("output_mode", "assurance_class").agg(F.sum("storage_byte_count").alias("bytes"), F.count("*").alias("results")).select(
        F.coalesce("output_mode", F.lit("ALL")).alias("output_mode"), F.coalesce("assurance_class", F.lit("ALL")).alias("assurance_class"), "bytes", "results"
    )


def _binding() -> Column:
    return F.concat_ws("|", "saved_result_id", "artifact_kind", F.col("artifact_revision").cast("string"), F.col("canonical_revision").cast("string"),
                       "mime_type", "content_digest", F.col("byte_count").cast("string"))


def seal_payloads(artifacts: DataFrame, key: Column) -> DataFrame:
    """AES-256-GCM with a random nonce; the artifact's identity is bound as associated data."""
    sealed = F.aes_encrypt(F.col("payload"), key, F.lit("GCM"), F.lit("DEFAULT"), F.lit("").cast("binary"), _binding())
    return artifacts.withColumn("sealed", sealed).drop("payload")


def open_payloads(sealed: DataFrame, key: Column) -> DataFrame:
    """Plaintext, or AUTHENTICATION_FAILED when bytes or identity were changed."""
    opened = F.try_aes_decrypt(F.col("sealed"), key, F.lit("GCM"), F.lit("DEFAULT"), _binding())
    df = sealed.withColumn("payload", opened)
    intact = F.sha2("payload", 256) == F.col("content_digest")
    outcome = F.when(F.col("payload").isNull(), F.lit("AUTHENTICATION_FAILED")).when(~intact, F.lit("PAYLOAD_DIGEST_MISMATCH")).otherwise(F.lit("OPENED"))
    return df.withColumn("outcome", outcome)


# --- fixed values: content a stored summary must not hold ---
FORBIDDEN = (
    r"(?i)(?:content|file)://", r"(?i)https?://", r"(?:^|[\s])/(?:data|storage|sdcard|mnt|home|tmp)/",
    r"(?i)before[_ -]?value", r"(?i)destination[_ -]?(?:app|package|identity)",
)


def safe_summary_audit(summaries: DataFrame) -> DataFrame:
    """Summaries (id, summary) that are too long or hold references, paths, values or destinations."""
    bad = F.length("summary") > 1024
    for pattern in FORBIDDEN:
        bad = bad | F.col("summary").rlike(pattern)
    return summaries.where(bad).select("id", "summary")


_MAX = 9223372036854775807


def share_expiry(entries: DataFrame, now: int | Column, lifetime: int) -> DataFrame:
    """Entries (token, prepared_at, digest, byte_count, file_digest, file_bytes) still usable at ``now``."""
    clock = now if isinstance(now, Column) else F.lit(now).cast("bigint")
    expires = F.coalesce(F.try_add(F.col("prepared_at"), F.lit(lifetime).cast("bigint")), F.lit(_MAX))
    df = entries.withColumn("expires_at", expires)
    match = (F.col("digest") == F.col("file_digest")) & (F.col("byte_count") == F.col("file_bytes"))
    return df.where((clock < F.col("expires_at")) & match)
