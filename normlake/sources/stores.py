"""Writing results in two phases and migrating older rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_results(results: DataFrame, artifacts: DataFrame, path: str, batch: str) -> DataFrame:
    """Payloads are staged, read back and digested; metadata is appended only for intact results.

    artifacts(saved_result_id, artifact_kind, payload, content_digest, byte_count). Folders are named by
    ``batch``, so a repeated run replaces its own output. Readers see a result through its metadata row,
    which comes last. Returns the metadata as read back.
    """
    spark = results.sparkSession
    payloads, metadata = f"{path}/payloads/batch={batch}", f"{path}/results/batch={batch}"
    artifacts.write.mode("overwrite").parquet(payloads)
    stored = spark.read.parquet(payloads)
    broken = stored.where(
        (F.sha2("payload", 256) != F.col("content_digest")) | (F.octet_length("payload") != F.col("byte_count"))
    ).select("saved_result_id").distinct()
    have = stored.select("saved_result_id").distinct()
    good = results.join(have, "saved_result_id", "left_semi").join(broken, "saved_result_id", "left_anti")
    visible = good.withColumns({
        "lifecycle_state": F.lit("AVAILABLE"), "verification_state": F.lit("VERIFIED"), "integrity_state": F.lit("VALID"),
        "visibility_confirmed": F.lit(True),
    })
    visible.write.mode("overwrite").parquet(metadata)
    return read_results(spark, path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(f"{path}/results").where("visibility_confirmed")


# --- fixed values: columns added by version 2, with their defaults ---
def version_2_defaults() -> dict[str, Column]:
    return {
        "original_verified_assurance": F.lit("AS_0_UNVERIFIED"),
        "last_integrity_check_at_millis": F.lit(None).cast("bigint"),
        "migration_state": F.lit("REVALIDATION_REQUIRED"),
        "integrity_state": F.lit("STALE"),
        "external_export_known": F.lit(False),
        "key_alias": F.lit(""),
        "visibility_confirmed": F.lit(False),
        "revalidation_reason_code": F.lit("SCHEMA_MIGRATION_REVALIDATION_REQUIRED"),
    }


def migrate_v1_v2(results: DataFrame) -> DataFrame:
    """Version 2 columns with defaults; every older row is quarantined until it is validated again."""
    forced = {
        "lifecycle_state": F.lit("QUARANTINED"), "verification_state": F.lit("REVALIDATION_REQUIRED"), "assurance_class": F.lit("AS_0_UNVERIFIED"),
    }
    return results.withColumns({**version_2_defaults(), **forced})
