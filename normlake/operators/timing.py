"""Elapsed time, sessions and trace retention on tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normlake.operators.ordering import newest, running_max

_MAX = 9223372036854775807


def _since(later: Column, earlier: Column) -> Column:
    """Non-negative difference, held at the largest value on overflow."""
    return F.when(later < earlier, F.lit(0).cast("bigint")).otherwise(F.coalesce(F.try_subtract(later, earlier), F.lit(_MAX)))


def elapsed_since_import(anchors: DataFrame, samples: DataFrame, tolerance_ms: int = 2000) -> DataFrame:
    """Elapsed time of every sample with its confidence and anomaly; a result's value never goes back.

    anchors(result_id, wall_ms, mono_ns, boot_id, clock_confidence); samples(result_id, seq, wall_ms, mono_ns, boot_id).
    """
    a = anchors.select("result_id", *[F.col(c).alias(f"a_{c}") for c in ("wall_ms", "mono_ns", "boot_id", "clock_confidence")])
    df = samples.join(a, "result_id")
    wall, mono = F.col("wall_ms"), F.col("mono_ns")
    rolled = wall < F.col("a_wall_ms")
    wall_elapsed = _since(wall, F.col("a_wall_ms"))
    same_boot = F.coalesce(F.col("boot_id") == F.col("a_boot_id"), F.lit(False))
    both = mono.isNotNull() & F.col("a_mono_ns").isNotNull()
    back = same_boot & both & F.coalesce(mono < F.col("a_mono_ns"), F.lit(False))
    usable = same_boot & both & ~back
    mono_elapsed = F.floor(_since(mono, F.col("a_mono_ns")) / 1000000).cast("bigint")
    gap = F.abs(mono_elapsed - wall_elapsed)
    legacy = F.col("a_clock_confidence") == "UNKNOWN_LEGACY_IMPORT_TIME"
    rebooted = F.coalesce(F.col("boot_id") != F.col("a_boot_id"), F.lit(False))
    diverged = rolled | (gap > tolerance_ms)
    df = df.withColumns({
        "_raw": F.when(usable, mono_elapsed).otherwise(wall_elapsed),
        "_anomaly": F.when(
            usable, F.when(rolled, F.lit("WALL_CLOCK_ROLLBACK")).when(diverged, F.lit("CLOCK_DIVERGENCE")).otherwise(F.lit("NONE"))
        ).otherwise(
            F.when(rolled, F.lit("WALL_CLOCK_ROLLBACK")).when(back, F.lit("MONOTONIC_ROLLBACK")).when(legacy, F.lit("UNKNOWN_LEGACY_TIME"))
            .when(rebooted, F.lit("BOOT_CHANGED")).otherwise(F.lit("MONOTONIC_UNAVAILABLE"))
        ),
        "_confidence": F.when(
            usable, F.when(diverged, F.lit("CLOCK_CHANGE_DETECTED")).otherwise(F.lit("MONOTONIC_ACTIVE"))
        ).otherwise(
            F.when(rolled | back, F.lit("CLOCK_CHANGE_DETECTED")).when(legacy, F.lit("UNKNOWN_LEGACY_IMPORT_TIME")).otherwise(F.lit("WALL_CLOCK_RESTORED"))
        ),
    })
    df = running_max(df, "result_id", "seq", "_raw", "elapsed_ms")
    held = F.col("_raw") < F.col("elapsed_ms")
    return df.select(
        "result_id", "seq", "elapsed_ms",
        F.when(held, F.lit("CLOCK_CHANGE_DETECTED")).otherwise(F.col("_confidence")).alias("confidence"),
        F.when(held, F.lit("WALL_CLOCK_ROLLBACK")).otherwise(F.col("_anomaly")).alias("anomaly"),
    )


def format_elapsed(elapsed_ms: Column) -> Column:
    """HH:MM:SS with as many hours as needed."""
    seconds = F.floor(elapsed_ms / 1000).cast("bigint")
    two = lambda v: F.lpad(v.cast("string"), 2, "0")
    hours = F.floor(seconds / 3600).cast("bigint")
    wide = F.when(hours < 100, two(hours)).otherwise(hours.cast("string"))
    return F.concat_ws(":", wide, two(F.floor(seconds / 60).cast("bigint") % 60), two(seconds % 60))


def stale_sessions(sessions: DataFrame, now: int | Column, max_age_ms: int, prefix: str = "session-") -> DataFrame:
    """Session folders (name, modified_ms) old enough to purge; never ones dated in the future."""
    clock = now if isinstance(now, Column) else F.lit(now).cast("bigint")
    m = F.col("modified_ms")
    return sessions.where(F.col("name").startswith(prefix) & (m > 0) & (clock >= m) & (clock - m >= max_age_ms))


def trace_ring(events: DataFrame, capacity: int = 2048) -> DataFrame:
    """Newest events of every session (session_id, event_id, ts), ties by event id."""
    return newest(events, "session_id", [F.col("ts").desc(), F.col("event_id").desc()], capacity, F.col("event_id"))


def outcome_windows(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """X07 on a table: outcome counts per block over tumbling event-time windows."""
    return events.groupBy(F.window("ts", width).alias("w"), "block_id", "outcome").agg(F.count("*").alias("events")).select(
        F.col("w.start").alias("window_start"), "block_id", "outcome", "events")


def session_windows(events: DataFrame, gap: str = "30 minutes", keys: tuple[str, ...] = ("run_id", "block_id")) -> DataFrame:
    """X07 on a table: bursts of events per run and block separated by a gap. Blocks alone are few, runs grow with the trace."""
    return events.groupBy(F.session_window("ts", gap).alias("w"), *keys).agg(F.count("*").alias("events")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "events")
