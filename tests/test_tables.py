"""Audits, orders, clusters and streams on small fixtures, by brute force where a rule is order dependent."""

import itertools
import random

from pyspark.sql import functions as F

from normlake.dims import catalog as cat
from normlake.operators import ocr, runlog, timing
from normlake.operators import verification as v


def iou(a, b):
    w = max(0.0, min(a[2], b[2]) - max(a[0], b[0]))
    h = max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return w * h / union if union > 0 else 0.0


def test_catalog_size_and_presets():
    assert len(cat.BLOCKS) == 118 and len(set(cat.BLOCKS)) == 118
    assert all(block in cat.BLOCKS for p in cat.PRESETS for block in p[5])


def test_presets_have_no_sequence_violation(spark):
    presets = [(i, p[0], p[1], p[2], p[3], p[4]) for i, p in enumerate(cat.PRESETS)]
    runs = spark.createDataFrame(presets, "run_id int, preset_id string, input_kind string, output_mode string, ceiling int, high_assurance boolean")
    manifest = spark.createDataFrame([(i, s, b, 1) for i, p in enumerate(cat.PRESETS) for s, b in enumerate(p[5])], "run_id int, seq int, block_id string, block_version int")
    assert runlog.sequence_audit(manifest, runs, cat.block_catalog(spark), cat.preset_blocks(spark)).collect() == []


def test_mutated_sequence_is_reported(spark):
    p = cat.PRESETS[0]
    blocks = [b for b in p[5] if b != "TXT-017"] + ["TXT-003"]
    runs = spark.createDataFrame([(1, p[0], p[1], p[2], p[3], p[4])], "run_id int, preset_id string, input_kind string, output_mode string, ceiling int, high_assurance boolean")
    manifest = spark.createDataFrame([(1, s, b, 1) for s, b in enumerate(blocks)], "run_id int, seq int, block_id string, block_version int")
    codes = {r.violation_code for r in runlog.sequence_audit(manifest, runs, cat.block_catalog(spark), cat.preset_blocks(spark)).collect()}
    assert {"PV-003", "PV-005", "PV-011", "PV-004"} <= codes


def test_sequence_rules_pass_over_the_manifest_once(spark):
    p = cat.PRESETS[0]
    shape = "run_id int, preset_id string, input_kind string, output_mode string, ceiling int, high_assurance boolean"
    runs = spark.createDataFrame([(run, p[0], p[1], p[2], p[3], p[4]) for run in (1, 2)], shape)
    rows = [(1, s, b, 1) for s, b in enumerate(p[5])] + [(1, 900, "XXX-1", 1), (1, 901, "XXX-1", 1), (1, 902, p[5][0], 7), (3, 0, "XXX-2", 1)]
    manifest = spark.createDataFrame(rows, "run_id int, seq int, block_id string, block_version int")
    wanted = cat.preset_blocks(spark).select("preset_id", "block_id", "seq").unionByName(
        spark.createDataFrame([(p[0], "XXX-1", 99), (p[0], "XXX-3", 100)], "preset_id string, block_id string, seq int"))
    out = runlog.sequence_audit(manifest, runs, cat.block_catalog(spark), wanted)
    got = {tuple(r) for r in out.collect()}
    assert {r for r in got if r[0] != 2} == {
        (1, "PV-018", "XXX-1", "UNKNOWN_BLOCK_ID"), (1, "PV-003", "XXX-1", "DUPLICATE_BLOCK_LOOP_REPRESENTATION"),
        (1, "PV-018", p[5][0], "UNKNOWN_BLOCK_VERSION"), (1, "PV-003", p[5][0], "DUPLICATE_BLOCK_LOOP_REPRESENTATION"),
        (1, "PV-005", "XXX-3", "MANDATORY_BLOCK_MISSING")}
    assert {(2, "PV-005", b, "MANDATORY_BLOCK_MISSING") for b in (*p[5], "XXX-1", "XXX-3")} <= got
    # One pass over all entries and three over those with ids outside the catalog, however many rules there are.
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert sum("LogicalRDD [run_id#" in line and "seq#" in line for line in plan.splitlines()) == 4


def test_greedy_clusters_match_sequential_first_fit(spark):
    rng = random.Random(7)
    data = []
    for image in range(3):
        for seq in range(40):
            x, y = rng.randrange(8) / 16, rng.randrange(4) / 16
            data.append((image, seq, x, y, x + 0.2, y + 0.2))
    want = {}
    for image, group in itertools.groupby(data, key=lambda r: r[0]):
        clusters = []
        for _, seq, *box in group:
            home = next((c for c in clusters if any(iou(box, other) >= 0.4 for _, other in c)), None)
            if home is None:
                home = []
                clusters.append(home)
            home.append((seq, box))
        for c in clusters:
            for seq, _ in c:
                want[(image, seq)] = c[0][0]
    obs = spark.createDataFrame(data, "image_id int, seq int, left double, top double, right double, bottom double")
    got = {(r.image_id, r.seq): r.cluster_id for r in ocr.ocr_clusters(obs, 0.4).collect()}
    assert got == want


def test_canaries_of_any_length(spark):
    surfaces = spark.createDataFrame([(1, "abc secret-token-xyz end"), (2, "ab"), (3, "zz secret-toke")], "surface_id int, payload string")
    canaries = spark.createDataFrame([(1, "secret-token"), (2, "ab"), (3, "nope-nope-nope")], "canary_id int, secret string")
    got = {(r.surface_id, r.canary_id) for r in v.canary_search(surfaces, canaries).collect()}
    assert got == {(1, 1), (1, 2), (2, 2)}


def test_assurance_grid(spark):
    flags = ("all_required_passed", "failure_present", "retained_pixels", "metadata_passed", "ocr_passed")
    rows = []
    for i, (mode, *bits) in enumerate(itertools.product(cat.MODES, *[(True, False)] * len(flags))):
        rows.append((i, mode, 4 if mode != "DERIVATIVE_IMAGE" else 1, *bits))
    df = spark.createDataFrame(rows, "run_id int, output_mode string, ceiling int, " + ", ".join(f"{f} boolean" for f in flags))
    df = df.withColumn("retained_declared", F.col("retained_pixels"))
    for name in ("dependency_complete", "approved_document", "unicode_passed", "url_passed", "ambiguities_approved", "fresh_render", "bundled_assets"):
        df = df.withColumn(name, F.lit(True))
    got = {r.run_id: r.level for r in v.assurance_classify(df.withColumn("externally_edited", F.lit(False))).collect()}
    for i, mode, _, passed, failed, kept, meta, read in rows:
        if (mode == "TEXT" and kept) or failed or not passed:
            want = 0
        elif mode == "DERIVATIVE_IMAGE":
            want = 1 if meta else 0
        elif mode == "TEXT":
            want = 2
        else:
            want = (3 if kept else 4) if meta and read else 0
        assert got[i] == want


def test_elapsed_never_moves_back(spark):
    anchors = spark.createDataFrame([(1, 1000, None, None, "WALL")], "result_id int, wall_ms long, mono_ns long, boot_id string, clock_confidence string")
    samples = spark.createDataFrame([(1, i, w, None, None) for i, w in enumerate((1000, 5000, 3000, 9000))], "result_id int, seq long, wall_ms long, mono_ns long, boot_id string")
    got = [r.elapsed_ms for r in timing.elapsed_since_import(anchors, samples).orderBy("seq").collect()]
    assert got == [0, 4000, 4000, 8000]


def test_stream_windows_and_dedup(spark, tmp_path):
    from normlake.streaming import streams

    src = spark.sql("SELECT 's' || (id % 3) AS session_id, id AS event_id, timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, CAST(id AS INT)) AS ts, 'TXT-001' AS block_id, 'SUCCESS' AS outcome FROM range(200)")
    src.write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = streams.stream_outcomes(stream(), "1 hour").writeStream.outputMode("complete").format("memory").queryName("o").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.sql("SELECT sum(events) AS n FROM o").collect()[0].n == 200
    q = streams.stream_seal_dedup(stream().select("session_id", "ts")).writeStream.format("memory").queryName("d").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.sql("SELECT count(*) AS n FROM d").collect()[0].n == 3


def test_stream_ring_and_texts(spark, tmp_path):
    from normlake.streaming import streams

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    src = spark.sql("SELECT 's' || (id % 2) AS session_id, id AS event_id, timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, CAST(id AS INT)) AS ts, 's' || id AS source_id, repeat('a  b ', CAST(id AS INT)) AS text FROM range(20)")
    src.write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = streams.stream_trace_ring(stream(), 3).writeStream.outputMode("update").format("memory").queryName("ring").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {r.event_id for r in spark.table("ring").collect()} == {19, 17, 15, 18, 16, 14}
    out, rejects = str(tmp_path / "out"), str(tmp_path / "rejects")
    q = streams.stream_canonicalize(stream().select("source_id", "text"), 50, out, rejects, str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert spark.read.parquet(out + "/texts").count() == 10
    assert spark.read.parquet(rejects).count() == 10


def test_stream_share_expiry(spark, tmp_path):
    import time

    from normlake.streaming import streams

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    arriving, progress, out = (str(tmp_path / n) for n in ("in", "progress", "out"))

    def arrive(*tokens):
        spark.createDataFrame([(t, f"r-{t}") for t in tokens], "token string, result_id string").coalesce(1).write.mode("append").parquet(arriving)

    def until(*events):
        end = time.time() + 60
        while time.time() < end:
            seen = {(r.token, r.event) for r in spark.read.schema("token string, event string").parquet(out).collect()}
            if set(events) <= seen:
                return seen
            assert query.isActive, query.exception()
            time.sleep(0.5)
        raise AssertionError(f"{events} not all in {seen}")

    arrive("a", "b")
    spark.createDataFrame([], "token string, event string").write.parquet(out)
    stream = spark.readStream.schema("token string, result_id string").parquet(arriving)
    # Timers on processing time always ask for another batch, so the query runs until it is stopped.
    query = streams.stream_share_expiry(stream, 1).writeStream.outputMode("update").option("checkpointLocation", progress).foreachBatch(
        lambda df, i: df.write.mode("append").parquet(out)).start()
    try:
        first = until(("a", "PREPARED"), ("b", "PREPARED"), ("a", "EXPIRED"), ("b", "EXPIRED"))
        assert not any(t == "c" for t, _ in first)
        arrive("c")
        until(("c", "PREPARED"), ("c", "EXPIRED"))
    finally:
        query.stop()


def test_share_expiry_holds_many_tokens_in_a_call(spark, tmp_path):
    from datetime import datetime, timedelta, timezone

    from normlake.streaming import streams

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    arriving, progress, out = (str(tmp_path / n) for n in ("in", "progress", "out"))
    shape, start = "token string, result_id string, ts timestamp", datetime(2024, 1, 1, tzinfo=timezone.utc)
    many = [f"t{i}" for i in range(3000)] + [None]
    # The second batch touches one live token and brings the watermark past all of the first; the third starts one of them again.
    for batch in ([(t, "r", 0) for t in many], [("t7", "r", 2), ("late", "r", 500)], [("t7", "r", 501)]):
        rows = [(t, r, start + timedelta(minutes=m)) for t, r, m in batch]
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(arriving)
        stream = streams.stream_share_expiry(spark.readStream.schema(shape).parquet(arriving), 60_000, "10 minutes", buckets=2)
        stream.writeStream.outputMode("update").option("checkpointLocation", progress).foreachBatch(
            lambda df, i: df.write.mode("append").parquet(out)).trigger(availableNow=True).start().awaitTermination()
    got = {(r.token, r.event): r["count"] for r in spark.read.parquet(out).groupBy("token", "event").count().collect()}
    want = {(t, e): 1 for t in many for e in ("PREPARED", "EXPIRED")}
    assert got == want | {("t7", "PREPARED"): 3, ("late", "PREPARED"): 1}


def test_budgets_name_what_they_leave_out(spark):
    from normlake.operators import pixels as px

    sizes = spark.createDataFrame([(1, 2, 2), (2, 40, 40)], "image_id int, width int, height int")
    pixels = spark.createDataFrame([(1, 0, 0, 5), (2, 0, 0, 5)], "image_id int, x int, y int, argb int")
    assert {r.image_id for r in px.pixel_views(pixels, sizes).collect()} == {1, 2}
    assert {r.image_id for r in px.pixel_views(pixels, sizes, max_pixels_per_view=100).collect()} == {1}
    assert [tuple(r) for r in px.pixel_view_rejects(sizes, max_pixels_per_view=100).collect()] == [(2, "VIEW_PIXEL_BUDGET")]
    assert [tuple(r) for r in px.pixel_view_rejects(sizes, max_aggregate_pixels=100).collect()] == [(2, "AGGREGATE_PIXEL_BUDGET")]
    tags = spark.createDataFrame([(1, d, f"Name {d} " + "x" * 100, "c", d * 10 + t, "n", 1, 0) for d in range(3) for t in range(2)],
                                 "image_id int, directory_idx int, directory_name string, directory_class string, tag_idx int, tag_name string, tag_type int, directory_errors int")
    whole = px.metadata_inventory(tags).collect()
    assert len(whole) == 3 and all(r.complete and len(r.directory) > 80 and len(r.directory_short) == 80 for r in whole)
    assert [(r.directory_idx, r.tags, r.complete) for r in px.metadata_inventory(tags, max_tags=3).orderBy("directory_idx").collect()] == [(0, 2, False), (1, 1, False)]
    assert [(r.directory_idx, r.complete) for r in px.metadata_inventory(tags, max_directories=2).orderBy("directory_idx").collect()] == [(0, False), (1, False)]
