from pyspark.sql import functions as F

from normlake.dims import catalog as cat
from normlake.operators import verification as v

RESULTS = "run_id long, type string, status string, required boolean, failures array<string>"
T0, T1 = cat.CHECK_TYPES[0], cat.CHECK_TYPES[1]


def made(spark):
    results = spark.createDataFrame([
        (1, T0, "PASS", True, []), (1, T0, "FAIL", True, ["x"]), (1, T1, None, False, []), (2, T0, "PAZ", True, []), (2, T0, "PASS", True, []),
        (3, T0, "NEVER HEARD OF", False, []), (3, T0, "PASS", False, []), (4, T1, "ERROR", False, []), (4, "NO SUCH TYPE", "PASS", False, []), (5, T0, "PASS", True, []),
    ], RESULTS)
    return results, v.verification_report(results, results.select("run_id").distinct().withColumn("level", F.lit(2)))


def test_report_keeps_the_last_status_by_name_and_unknown_ones(spark):
    got = {r.run_id: r for r in made(spark)[1].collect()}
    assert [got[i][T0.lower()] for i in (1, 2, 3, 4, 5)] == ["PASS", "PAZ", "PASS", None, "PASS"]
    assert [got[i][T1.lower()] for i in (1, 4)] == [None, "ERROR"]
    assert got[1].n_blocking == 1 and got[1].n_failures == 1
    assert len(got[1].lines.split("\n")) == 16 and len(got[2].lines.split("\n")) == 15  # an unknown status has no line


def test_report_audit_marks_lines_before_it_shuffles_them(spark):
    results, reports = made(spark)
    reports = reports.select("run_id", F.when(F.col("run_id") == 5, F.concat("lines", F.lit("\nto Key-12345678"))).otherwise(F.col("lines")).alias("lines"))
    twice = reports.where("run_id = 1").select("run_id", F.lit("nothing: at all").alias("lines"))
    reports = reports.unionByName(twice).unionByName(spark.createDataFrame([(6, None)], "run_id long, lines string"))
    canaries = spark.createDataFrame([(i, "Key-12345678") for i in range(5)], "canary_id long, secret string")
    out = v.report_consistency_audit(reports, results, canaries)
    got = sorted((r.run_id, r.status, tuple(r.failures)) for r in out.collect())
    cut, leak = "REPORT_MACHINE_STATUS_MISMATCH", "REPORT_CANARY_DETECTED"
    assert got == [(1, "PASS", ()), (1, "PASS", ()), (2, "FAIL", (cut,)), (3, "PASS", ()), (4, "PASS", ()), (5, "FAIL", (leak,)), (6, "FAIL", (cut,))]
    lines_and_up = out._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" not in lines_and_up and "collect_set" not in lines_and_up
