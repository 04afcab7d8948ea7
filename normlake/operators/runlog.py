"""Audits over run logs (P03, P04, P06, P07). Manifests are long tables: one row per run and position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normlake.dims import catalog as cat
from normlake.functions.rows import settled
from normlake.operators.common import union_all

# --- fixed values: ordering rules (code, later block, earlier block, reason, input kind or None) -------
ORDER_RULES = (
    ("PV-004", "IN-006", "IN-005", "RESOURCE_GUARD_BEFORE_TYPE", None),
    ("PV-004", "IN-007", "IN-006", "IMAGE_SEAL_BEFORE_RESOURCE_GUARD", "IMAGE"),
    ("PV-004", "PST-001", "IN-007", "IMPORT_ANCHOR_BEFORE_IMAGE_SEAL", "IMAGE"),
    ("PV-004", "PST-001", "IN-006", "IMPORT_ANCHOR_BEFORE_TEXT_ACCEPTANCE", "TEXT"),
    ("PV-011", "OUT-TXT-001", "TXT-017", "TEXT_SERIALIZER_BEFORE_LOCK", None),
    ("PV-011", "OUT-TXT-001", "REV-007", "TEXT_SERIALIZER_BEFORE_FINAL_REVIEW", None),
    ("PV-013", "VER-003", "OUT-BND-001", "METADATA_RESCAN_BEFORE_FINAL_BYTES", None),
    ("PV-014", "VER-006", "OUT-IMG-001", "OCR_ROUND_TRIP_BEFORE_FINAL_IMAGE", None),
    ("PV-014", "VER-006", "OUT-BND-001", "OCR_ROUND_TRIP_BEFORE_FINAL_BUNDLE", None),
    ("PV-004", "PST-002", "VER-014", "PERSIST_BEFORE_ASSURANCE", None),
    ("PV-004", "PST-002", "VER-015", "PERSIST_BEFORE_VERIFICATION_REPORT", None),
    ("PV-004", "PST-005", "PST-002", "MANAGED_SHARE_BEFORE_COMMIT", None),
    ("PV-004", "EXP-002", "PST-005", "SHARESHEET_BEFORE_MANAGED_SHARE_PREPARATION", None),
)
URL_POLICY_BLOCKS = ("URL-010", "URL-011", "URL-012", "URL-013")


def sequence_audit(
    manifest: DataFrame, runs: DataFrame, catalog: DataFrame, preset_blocks: DataFrame,
) -> DataFrame:
    """Ordering and capability violations of every run's block sequence.

    manifest(run_id, seq, block_id, block_version); runs(run_id, preset_id, input_kind, output_mode, ceiling,
    high_assurance). A run is first reduced to one row per distinct block with its first and last position, then its
    catalog blocks to one array; all rules are read off that row, so the manifest is shuffled once. Ids that the catalog
    does not hold, of which a run may have any number, stay rows of their own.
    """
    versions = catalog.select("block_id", F.col("block_version").alias("_known_version"))
    entries = manifest.join(F.broadcast(versions), "block_id", "left")
    strange = entries.where("_known_version IS NULL").groupBy("run_id", "block_id").agg(F.count("*").alias("n"))
    strange = strange.join(runs.select("run_id"), "run_id", "left_semi")
    listed = entries.where("_known_version IS NOT NULL").withColumn("known", F.coalesce(F.col("_known_version") == F.col("block_version"), F.lit(False)))
    blocks = listed.groupBy("run_id", "block_id").agg(
        F.min(F.when(F.col("known"), F.col("seq"))).alias("first"), F.max(F.when(F.col("known"), F.col("seq"))).alias("last"),
        F.count("*").alias("n"), F.count_if("known").alias("n_known"),
    )
    info = catalog.drop("block_version")

    def found(rows: DataFrame, code: str, block: Column, reason: Column | str) -> DataFrame:
        why = F.lit(reason) if isinstance(reason, str) else reason
        return rows.select("run_id", F.lit(code).alias("violation_code"), block.cast("string").alias("block_id"), why.alias("reason_code"))

    def single(when: Column, code: str, block: Column, reason: str) -> Column:
        return F.when(
            F.coalesce(when, F.lit(False)),
            F.struct(F.lit(code).alias("violation_code"), block.cast("string").alias("block_id"), F.lit(reason).alias("reason_code")))

    traits = info.select("block_id", "source", "export_preparation", "verification", "final_serialization", "transforming", "gives")
    one = blocks.join(F.broadcast(traits), "block_id")
    held = lambda when, value: F.when(F.col("n_known") > 0, F.when(when, value))
    per_run = one.groupBy("run_id").agg(
        F.sum(held(F.col("source"), F.col("n_known"))).alias("n_source"),
        F.sum(held(F.col("export_preparation"), F.col("n_known"))).alias("n_export"),
        F.min(held(F.col("verification"), F.col("first"))).alias("first_ver"),
        F.max(held(F.col("final_serialization"), F.col("last"))).alias("last_ser"),
        F.max(held(F.col("transforming"), F.col("last"))).alias("last_change"),
        F.min(held(F.col("block_id").startswith("REN-"), F.col("first"))).alias("first_ren"),
        F.min(held(F.col("source"), F.struct("first", "block_id"))).alias("first_src"),
        F.max(F.col("block_id").startswith("DER-") & (F.col("n_known") > 0)).alias("has_der"),
        F.collect_list(F.struct("block_id", "first", "last", "n", "n_known")).alias("blocks"),
        *[F.min(held(F.array_contains("gives", c), F.col("first"))).alias(f"cap_{c}") for c in _capabilities()],
    )
    wanted = preset_blocks.select("preset_id", "block_id").distinct()
    outside = runs.select("run_id", "preset_id").join(F.broadcast(wanted.join(versions, "block_id", "left_anti")), "preset_id")
    outside = outside.select("run_id", "block_id").join(strange, ["run_id", "block_id"], "left_anti")
    required = wanted.join(versions, "block_id", "left_semi").groupBy("preset_id").agg(F.collect_set("block_id").alias("required"))
    r = runs.join(per_run, "run_id", "left").join(F.broadcast(required), "preset_id", "left")
    firsts = F.map_from_entries(F.transform(F.filter("blocks", lambda b: b["n_known"] > 0), lambda b: F.struct(b["block_id"], b["first"])))
    r = settled(r.withColumn("at", firsts), ["at"])
    at = lambda block: F.element_at("at", F.lit(block))
    none = F.lit(None)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    parts = [
        found(strange, "PV-018", F.col("block_id"), "UNKNOWN_BLOCK_ID"),
        found(outside, "PV-005", F.col("block_id"), "MANDATORY_BLOCK_MISSING"),
        found(strange.where("n > 1"), "PV-003", F.col("block_id"), "DUPLICATE_BLOCK_LOOP_REPRESENTATION"),
    ]
    present = F.coalesce(F.transform("blocks", lambda b: b["block_id"]), F.array().cast("array<string>"))
    missing = F.transform(F.array_except("required", present), lambda b: F.struct(
        F.lit("PV-005").alias("violation_code"), b.alias("block_id"), F.lit("MANDATORY_BLOCK_MISSING").alias("reason_code")))

    # Capabilities: compare each needing block's first position with the first position of any provider.
    caps = F.create_map(*[x for c in _capabilities() for x in (F.lit(c), F.col(f"cap_{c}"))])
    cap = lambda c: F.coalesce(F.element_at("caps", c if isinstance(c, Column) else F.lit(c)) < F.col("first"), F.lit(False))
    excused = lambda c: (
        ((F.col("block_id") == "OUT-IMG-001") & (c == "IMAGE_ARTIFACT") & cap("DERIVATIVE_ARTIFACT"))
        | ((F.col("block_id") == "CAN-001") & (c == "TEXT_INSPECTED") & cap("IMAGE_INSPECTED"))
    )
    # A known block that needs each listed capability fails if no provider stands before it.
    lacking = F.exists("needs", lambda c: ~cap(c) & ~excused(c))
    mode = F.col("output_mode")
    ready = (
        F.when(mode == "TEXT", cap("TEXT_ARTIFACT")).when(mode == "REBUILT_IMAGE", cap("IMAGE_ARTIFACT"))
        .when(mode == "BOTH", cap("TEXT_ARTIFACT") & cap("IMAGE_ARTIFACT")).otherwise(cap("DERIVATIVE_ARTIFACT") | cap("IMAGE_ARTIFACT"))
    )
    known, block = F.col("n_known") > 0, F.col("block_id")
    fits = F.array_contains("input_kinds", F.col("input_kind")) & F.array_contains("output_modes", F.col("output_mode"))
    by_block = F.array(
        single(F.col("n") > F.col("n_known"), "PV-018", block, "UNKNOWN_BLOCK_VERSION"),
        single(F.col("n") > 1, "PV-003", block, "DUPLICATE_BLOCK_LOOP_REPRESENTATION"),
        single(known & ~fits, "PV-017", block, "BLOCK_TYPE_INCOMPATIBLE"),
        single(known & ~F.col("built_in") & F.col("high_assurance"), "PV-019", block, "EXTERNAL_BLOCK_IN_HIGH_ASSURANCE_PROFILE"),
        single(known & F.col("logs"), "PV-020", block, "PERSISTENT_BLOCK_LOGGING_FORBIDDEN"),
        single(known & (lacking | ((block == "OUT-BND-001") & ~ready)), "PV-004", block, "INPUT_PREDICATE_UNSATISFIED"),
    )

    # Ordering pairs over the run's first positions (a map of at most one entry per catalog block).
    kind = F.col("input_kind")
    rule = lambda code, later, earlier, reason, when: F.when(
        when & at(later).isNotNull() & (at(earlier).isNull() | (at(later) <= at(earlier))),
        F.struct(F.lit(code).alias("violation_code"), F.lit(later).alias("block_id"), F.lit(reason).alias("reason_code")),
    )
    ordered = [rule(c, late, early, why, F.lit(True) if only is None else kind == only) for c, late, early, why, only in ORDER_RULES]
    policies = F.greatest(*[at(b) for b in URL_POLICY_BLOCKS])
    ceiling = F.col("ceiling")
    has_der = F.coalesce("has_der", F.lit(False))
    computed = (
        F.when((mode == "DERIVATIVE_IMAGE") | has_der, F.lit(1)).when(mode == "TEXT", F.lit(2)).when(at("REN-007").isNotNull(), F.lit(3)).otherwise(F.lit(4))
    )
    first_ren, first_ver = F.col("first_ren"), F.col("first_ver")
    type_after = at("IN-005").isNotNull() & (F.col("first_src").isNull() | (at("IN-005") <= F.col("first_src.first")))
    ordered += [
        single(type_after, "PV-004", F.lit("IN-005"), "SOURCE_TYPE_BEFORE_SOURCE"),
        single(at("URL-014").isNotNull() & (policies.isNull() | (at("URL-014") <= policies)), "PV-010", F.lit("URL-014"), "URL_SERIALIZER_BEFORE_POLICY"),
        single(first_ren.isNotNull() & (at("REV-008").isNull() | (first_ren <= at("REV-008")) | at("TXT-017").isNull()), "PV-012", none, "RENDER_BEFORE_CANONICAL_APPROVAL"),
        single(first_ver.isNotNull() & (F.col("last_ser").isNull() | (first_ver <= F.col("last_ser"))), "PV-006", none, "VERIFICATION_BEFORE_FINAL_SERIALIZATION"),
        single(ceiling > computed, "PV-015", none, "DECLARED_ASSURANCE_EXCEEDS_CEILING"),
        single(has_der & ((mode != "DERIVATIVE_IMAGE") | (ceiling > 1)), "PV-008", none, "DERIVATIVE_CEILING_VIOLATION"),
        single(at("REN-007").isNotNull() & (ceiling > 3), "PV-009", F.lit("REN-007"), "SOURCE_PIXEL_CEILING_VIOLATION"),
    ]
    ordered += [
        single(zero("n_source") != 1, "PV-001", none, "SOURCE_BLOCK_COUNT_INVALID"),
        single(zero("n_export") != 1, "PV-002", none, "EXPORT_PREPARATION_COUNT_INVALID"),
        single(F.col("last_change") > first_ver, "PV-007", none, "CONTENT_TRANSFORM_AFTER_VERIFICATION"),
    ]
    kind_of = "array<struct<violation_code:string,block_id:string,reason_code:string>>"
    of_run = F.concat(F.array_compact(F.array(*ordered)).cast(kind_of), F.coalesce(missing.cast(kind_of), F.array().cast(kind_of)))
    # One pass: a run's own violations leave with its first block, or alone if it has none.
    needed = ["run_id", "input_kind", "output_mode", "high_assurance"]
    rows = r.select(*needed, of_run.alias("_run"), caps.alias("caps"), F.posexplode_outer("blocks").alias("_at", "_block"))
    rows = rows.select(*needed, "caps", "_block.*", F.when(F.coalesce("_at", F.lit(0)) == 0, F.col("_run")).alias("_run"))
    rows = rows.join(F.broadcast(info.select("block_id", "input_kinds", "output_modes", "built_in", "logs", "needs")), "block_id", "left")
    every = F.concat(F.coalesce("_run", F.array().cast(kind_of)), F.array_compact(by_block).cast(kind_of))
    parts.append(rows.select("run_id", F.explode(every).alias("_v")).select("run_id", "_v.*"))
    return union_all(parts).distinct()


def _capabilities() -> list[str]:
    given = {c for values in cat.GIVES.values() for c in values}
    wanted = {c for values in cat.NEEDS.values() for c in values}
    return sorted(given | wanted)


def invalidation_plan(signals: DataFrame, catalog: DataFrame) -> DataFrame:
    """Blocks, checks and artifacts a change makes stale. signals(signal_id, signal, output_mode)."""
    spec = cat.SIGNALS
    keys = F.create_map(*[x for s, v in spec.items() for x in (F.lit(s), F.array(*[F.lit(k) for k in v[0]]).cast("array<string>"))])
    pairs = signals.select("signal").distinct().withColumn("_keys", keys[F.col("signal")]).join(
        F.broadcast(catalog.select("block_id", "keys", "check_type")), F.arrays_overlap("_keys", "keys"), "left"
    )
    # The vocabulary is fixed: eight signals by 118 blocks at most, whatever the number of change rows.
    per_signal = pairs.groupBy("signal").agg(
        F.array_sort(F.collect_set("block_id")).alias("block_ids"), F.array_sort(F.collect_set("check_type")).alias("_checks")
    )
    fixed = F.create_map(*[F.lit(x) for kv in cat.FIXED_SIGNAL_CHECKS.items() for x in kv])[F.col("signal")]
    flag = lambda i: F.create_map(*[x for s, v in spec.items() for x in (F.lit(s), F.lit(v[i]).cast("boolean"))])[F.col("signal")]
    reason = F.create_map(*[F.lit(x) for s, v in spec.items() for x in (s, v[7])])[F.col("signal")]
    return signals.join(F.broadcast(per_signal), "signal", "left").select(
        "signal_id", "signal", "block_ids",
        F.when(fixed.isNotNull(), F.array(fixed)).otherwise(F.col("_checks")).alias("verifier_types"),
        flag(1).alias("canonical"), flag(2).alias("text"), flag(3).alias("image"),
        F.coalesce(flag(4), F.col("output_mode") == "DERIVATIVE_IMAGE").alias("derivative"), flag(5).alias("signature"),
        flag(6).alias("revalidate"),
        F.when(F.col("signal") != "DISPLAY_METADATA_CHANGED", F.lit("AS_0_UNVERIFIED")).alias("resulting_assurance"), reason.alias("reason_code"),
    )


# --- fixed values: phases of a block, outcome of a verification status ---
PHASES = ("VALIDATE", "INSPECT", "PLAN", "REVIEW", "APPLY", "SELF_CHECK", "COMMIT", "CLEANUP")
OUTCOME_RANK = {"SUCCESS": 0, "REVIEW_REQUIRED": 1, "RECOVERABLE_FAILURE": 2}


def trace_coverage(manifest: DataFrame, transformations: DataFrame, events: DataFrame, phases: tuple[str, ...] = PHASES) -> DataFrame:
    """Block phases and transformations without a trace event.

    manifest(run_id, block_id); transformations(run_id, block_id); events(run_id, block_id, phase,
    transformation_category). The phase list is a literal, so the cross product stays inside a row.
    """
    wanted = manifest.select("run_id", "block_id").distinct().withColumn("phase", F.explode(F.array(*[F.lit(p) for p in phases])))
    seen = events.where("phase IS NOT NULL").select("run_id", "block_id", "phase")
    no_phase = wanted.join(seen, ["run_id", "block_id", "phase"], "left_anti")
    applied = transformations.select("run_id", "block_id").distinct()
    traced = events.where("transformation_category IS NOT NULL").select("run_id", "block_id")
    no_change = applied.join(traced, ["run_id", "block_id"], "left_anti").withColumn("phase", F.lit("TRANSFORMATION"))
    return no_phase.unionByName(no_change)


def trace_outcomes(results: DataFrame) -> DataFrame:
    """The worst outcome per run and block of verification results (run_id, block_id, status)."""
    outcome = F.when(F.col("status").isin("PASS", "PASS_WITH_DECLARED_RESIDUAL", "NOT_APPLICABLE"), F.lit("SUCCESS")).when(
        F.col("status") == "REVIEW_REQUIRED", F.lit("REVIEW_REQUIRED")
    ).otherwise(F.lit("RECOVERABLE_FAILURE"))
    rank = F.create_map(*[F.lit(x) for kv in OUTCOME_RANK.items() for x in kv])
    df = results.withColumn("outcome", outcome)
    return df.groupBy("run_id", "block_id").agg(F.max_by("outcome", rank[F.col("outcome")]).alias("outcome"))


def trace_privacy_audit(events: DataFrame) -> DataFrame:
    """Events whose reason is not a content-free code, or which name neither phase nor category."""
    bad_code = ~F.coalesce(F.col("reason_code"), F.lit("")).rlike(r"^[A-Z][A-Z0-9_]{1,63}$")
    empty = F.col("phase").isNull() & F.col("transformation_category").isNull()
    return events.where(bad_code | empty).select(
        "event_id", F.when(bad_code, F.lit("REASON_CODE_NOT_CONTENT_FREE")).otherwise(F.lit("PHASE_AND_CATEGORY_MISSING")).alias("violation")
    )
