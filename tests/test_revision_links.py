import random

from pyspark.sql import functions as F

from normlake.dims import catalog as cat
from normlake.operators import review as r
from normlake.operators import verification as v

SIDE = "run_id long, change_id string, block_id string, block_version int, canonical_revision int"


def made(spark, seed=5):
    rng = random.Random(seed)
    pick = lambda *of: rng.choice(of)
    runs = [(i, pick(1, 2, None), pick(1, 2), f"l{i}", pick(f"l{i}", None), 1, 1, pick(True, False)) for i in range(40)]
    row = lambda: (pick(None, *range(42)), pick("a", "b", None), pick("B", "C", None), pick(1, 1, 2, None), pick(1, 2, None))
    sides = [[row() for _ in range(n)] for n in (60, 60, 40)]
    frames = [spark.createDataFrame(rows, SIDE) for rows in sides]
    schema = "run_id long, document_revision int, ledger_revision int, ledger_id string, document_ledger_id string, bundle_revision int, artifact_revision int, dependency_maps_equal boolean"
    return runs, sides, spark.createDataFrame(runs, schema), *frames


def lineage(runs, ledger, applied, manifest):
    """The rules row by row; equality with a null does not hold."""
    same, differ = (lambda a, b: a is not None and a == b), (lambda a, b: a is not None and b is not None and a != b)
    out = {(u[0], "CHANGE_LEDGER_REVISION_MISMATCH") for u in runs if differ(u[2], u[1])} | {(u[0], "CHANGE_LEDGER_REFERENCE_MISMATCH") for u in runs if u[3] != u[4]}
    out |= {(t[0], "TRANSFORMATION_REVISION_MISMATCH") for t in applied for u in runs if same(t[0], u[0]) and differ(t[4], u[1])}
    out |= {(t[0], "TRANSFORMATION_MANIFEST_LINK_MISMATCH") for t in applied if not any(same(t[0], m[0]) and same(t[2], m[2]) and same(t[3], m[3]) for m in manifest)}
    linking = [t for t in applied if t[1] is not None]
    for t in linking:
        entries = [e for e in ledger if same(t[0], e[0]) and same(t[1], e[1])]
        if not entries or any(e[2] is None for e in entries):
            out.add((t[0], "CHANGE_LEDGER_ENTRY_MISSING"))
        if any(differ(e[2], t[2]) or differ(e[3], t[3]) for e in entries):
            out.add((t[0], "CHANGE_LEDGER_BLOCK_LINK_MISMATCH"))
    return out | {(k[0], "CHANGE_LEDGER_SCOPE_MISMATCH") for k in {t[:2] for t in linking} ^ {e[:2] for e in ledger}}


def test_lineage_matches_its_rules_without_a_join(spark):
    for seed in (5, 6):
        runs, sides, frame, ledger, applied, manifest = made(spark, seed)
        out = r.lineage_integrity(frame, ledger, applied, manifest)
        assert {tuple(x) for x in out.collect()} == lineage(runs, *sides) and out.count() == len(lineage(runs, *sides))
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()


def audited(spark, seed):
    _, _, frame, a, b, c = made(spark, seed)
    steps = a.select("run_id", F.col("block_version").alias("seq"), F.when(F.col("block_id") == "B", "VER-001").otherwise(F.lit("TXT-010")).alias("block_id"))
    ids = lambda df: df.select("run_id", F.col("change_id").alias("artifact_id"), "canonical_revision", F.col("block_version").alias("artifact_revision"))
    decisions = lambda df: df.select("run_id", F.col("change_id").alias("decision_id"), F.lit("APPROVED").alias("status"))
    none = spark.createDataFrame([], "run_id long, failure_code string")
    pend = frame.where("run_id % 3 = 0").select("run_id", F.lit("REVIEW_REQUIRED").alias("status"))
    out = v.revision_audit(frame, decisions(a), decisions(b), a, b, ids(b), ids(c), ids(a), steps, cat.block_catalog(spark), none, pend)
    return sorted((x.run_id, x.status, x.summary_code, tuple(x.failures)) for x in out.collect())


def test_revision_audit_finds_each_kind_of_link(spark):
    got = audited(spark, 5)
    codes = {c for x in got for c in x[3]}
    assert len(got) == 40 and {"ARTIFACT_CANONICAL_REVISION_MISMATCH", "REOPENED_CANONICAL_REVISION_MISMATCH", "REOPENED_ARTIFACT_REVISION_MISMATCH",
                               "CANONICAL_DECISION_LINK_MISMATCH", "CONTEXT_CHANGE_LEDGER_MISMATCH", "CONTEXT_OUTPUT_BUNDLE_MISMATCH"} <= codes
