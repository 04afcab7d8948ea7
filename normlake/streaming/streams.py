"""The time and state rules on Structured Streaming sources.

State stores are keyed by session or token; retention follows event time or processing time as noted.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState

from normlake.operators import text_transform as tt
from normlake.operators import urls
from normlake.operators.timing import session_windows
from normlake.sources.texts import resource_guard

RING_SCHEMA = "session_id string, event_id long, ts timestamp"


class RingProcessor(StatefulProcessor):
    """Newest ``capacity`` events per session; state never holds more than that per session.

    Keys inside the state order events by (time, id), so old rows are dropped as new ones arrive.
    """

    def __init__(self, capacity: int):
        self.capacity = capacity

    def init(self, handle) -> None:
        self.ring = handle.getListState("ring", "event_id long, ts timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = [(r[0], r[1]) for r in self.ring.get()] if self.ring.exists() else []
        for batch in rows:
            kept += list(zip(batch["event_id"].tolist(), batch["ts"].tolist()))
            kept = sorted(kept, key=lambda e: (e[1], e[0]), reverse=True)[: self.capacity]
        self.ring.put([(int(i), pd.Timestamp(t).to_pydatetime()) for i, t in kept])
        yield pd.DataFrame({"session_id": key[0], "event_id": [i for i, _ in kept], "ts": [pd.Timestamp(t) for _, t in kept]})

    def close(self) -> None:
        pass


def stream_trace_ring(events: DataFrame, capacity: int = 2048) -> DataFrame:
    """X04 on a stream: each batch emits the current ring of the sessions it touched."""
    return events.select("session_id", "event_id", "ts").groupBy("session_id").transformWithStateInPandas(
        RingProcessor(capacity), RING_SCHEMA, outputMode="Update", timeMode="None")


def _expiring(lifetime_ms: int, column: str | None):
    """Live tokens of one bucket with the time each is due; what is due leaves as expired. ``column`` names the time of an entry, or none for processing time.

    A call handles all of a bucket's tokens in a batch as columns: a call for each token costs milliseconds.
    """

    def step(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs() if column else state.getCurrentProcessingTimeMs()
        live = pd.Series([], index=pd.Index([], dtype=object), dtype="int64")
        if state.exists:
            held = pa.ipc.open_stream(bytes(state.get[0])).read_pandas()
            live = pd.Series(held["due"].to_numpy(), index=pd.Index(held["token"], dtype=object))
        seen = pd.Index([], dtype=object)
        if not state.hasTimedOut:
            rows = pd.concat(list(parts))
            first = rows.groupby("token", sort=False, dropna=False)[column].min() if column else pd.Series(now, index=rows["token"].unique())
            seen = pd.Index(first.index.astype(object).where(first.index.notna(), None), dtype=object)
            first.index = seen
            live = pd.concat([live, first[~seen.isin(live.index)].astype("int64") + lifetime_ms])
        over = live.to_numpy() < now
        gone, live = live.index[over], live[~over]
        if len(live):
            table, sink = pa.table({"token": pa.array(live.index, pa.string()), "due": live.to_numpy()}), pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as writer:
                writer.write_table(table)
            state.update((sink.getvalue().to_pybytes(),))
            if column:
                state.setTimeoutTimestamp(max(int(live.min()), now + 1))
            else:
                state.setTimeoutDuration(max(1, int(live.min()) - now))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"token": [*seen, *gone], "event": ["PREPARED"] * len(seen) + ["EXPIRED"] * len(gone)}, dtype=object)

    return step


def stream_share_expiry(entries: DataFrame, lifetime_ms: int, lateness: str | None = None, buckets: int = 1024) -> DataFrame:
    """Shares (token, result_id) expire ``lifetime_ms`` after they are first seen.

    The rule speaks of a monotonic clock; a stream has processing time, which is what the timers use. With ``lateness``
    the clock is the watermark over the entries' own ``ts``: it never runs back, and a replay gives the same events.
    Entries later than the watermark are dropped. State is keyed by one of ``buckets`` hashes of the token and holds its live tokens.
    """
    shape, mode = "token string, event string", "Update"
    held, bucket = "live binary", F.pmod(F.xxhash64("token"), F.lit(buckets)).alias("bucket")
    if lateness is None:
        return entries.select("token", bucket).groupBy("bucket").applyInPandasWithState(
            _expiring(lifetime_ms, None), shape, held, mode, "ProcessingTimeTimeout")
    timed = entries.withWatermark("ts", lateness).select("token", bucket, "ts", F.unix_millis("ts").alias("at_ms"))
    return timed.groupBy("bucket").applyInPandasWithState(_expiring(lifetime_ms, "at_ms"), shape, held, mode, "EventTimeTimeout")


def stream_canonicalize(sources: DataFrame, max_bytes: int, out_path: str, reject_path: str, checkpoint: str, **policy):
    """Arriving texts become canonical texts and URL tokens; texts over the budget go to a reject sink.

    Each micro-batch writes three append-only folders named by batch id, so a replayed batch overwrites
    itself instead of adding rows twice.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        accepted, rejected = resource_guard(batch, max_bytes)
        texts = f"{out_path}/texts/batch={batch_id}"
        done = tt.canonicalize_text(accepted, **policy).canonical()
        done.write.mode("overwrite").parquet(texts)
        # The texts just written, not computed once more.
        plain = batch.sparkSession.read.schema(done.schema).parquet(texts).withColumn("source_kind", F.lit("PLAIN_TEXT"))
        tokens = urls.canonicalize_urls(urls.analyze_urls(urls.url_candidates(plain))).tokens()
        tokens.write.mode("overwrite").parquet(f"{out_path}/tokens/batch={batch_id}")
        rejected.write.mode("overwrite").parquet(f"{reject_path}/batch={batch_id}")

    return sources.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def stream_outcomes(events: DataFrame, width: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Outcome counts per block over event-time windows; rows later than the watermark are dropped."""
    return events.withWatermark("ts", lateness).groupBy(F.window("ts", width).alias("w"), "block_id", "outcome").agg(
        F.count("*").alias("events")
    ).select(F.col("w.start").alias("window_start"), "block_id", "outcome", "events")


def stream_sessions(events: DataFrame, gap: str = "30 minutes", lateness: str = "10 minutes", keys: tuple[str, ...] = ("run_id", "block_id")) -> DataFrame:
    """Bursts of events per run and block, merged across batches and emitted once the watermark has passed their end.

    Rows whose burst would have ended before the watermark are dropped, so state holds open bursts only.
    """
    return session_windows(events.withWatermark("ts", lateness), gap, keys)


def stream_seal_dedup(sources: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """One accepted source per session (session_id, ts); repeats within the watermark are dropped."""
    return sources.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["session_id"])
