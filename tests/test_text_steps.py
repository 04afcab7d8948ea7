"""What a text query holds at once: Arrow steps of a stage (a worker process each) and rows of a task."""

import re

import pytest

from normlake.queries import QUERIES
from normlake.queries import base


def arrow_steps(df):
    return len(re.findall("ArrowEvalPython|BatchEvalPython", df._jdf.queryExecution().executedPlan().toString()))


@pytest.mark.parametrize("name, most", [("n10_canonicalize_text", 3), ("n10_canonical_ledger", 3), ("n10_canonical_gates", 3), ("t12_text_findings", 2)])
def test_a_stage_has_few_arrow_steps(spark, name, most):
    assert arrow_steps(QUERIES[name](spark, "/root/testdata/sf0.001")) <= most


def test_the_idempotence_audit_has_few_arrow_steps(spark, tmp_path):
    # Its second pass; the first is the same chain.
    assert arrow_steps(QUERIES["v12_idempotence_audit"](spark, "/root/testdata/sf0.001")) <= 3


def test_larger_tables_are_dealt_to_more_tasks(spark, tmp_path, monkeypatch):
    spark.range(200).selectExpr("id AS doc_id", "repeat(uuid(), 40) AS text").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").selectExpr("doc_id AS source_id", "text || '.' AS text")
    least = 2 * spark.sparkContext.defaultParallelism
    assert base.dealt(docs, "source_id").rdd.getNumPartitions() == least
    monkeypatch.setattr(base, "DEALT", 1000, raising=False)
    dealt = base.dealt(docs, "source_id")
    assert dealt.rdd.getNumPartitions() > 3 * least and dealt.count() == 200
    assert base.dealt(spark.createDataFrame([(1, "a")], "source_id long, text string"), "source_id").count() == 1
