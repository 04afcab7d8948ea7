"""V18 against plain Python: few values of residue are looked for where the texts lie, many by the family's values."""

import re

import pytest

from normlake.operators import verification as v

VARIANTS = [
    (1, "a", "one two"), (1, "b", "one\r\ntwo"), (1, "c", "one\ntwo"), (2, "a", "same"), (2, "a", "same"), (2, "b", "same"),
    (3, "a", "x\u0001y"), (3, "b", None), (4, "a", ""), (None, "a", "none two"), (None, "b", "none two"), (5, "a", "sent by two"),
]
RESIDUE = [(1, "two"), (1, "two"), (1, "o"), (1, None), (2, "am"), (2, "zz"), (3, "x"), (4, ""), (None, "two"), (6, "two")]


def checked(spark):
    variants = spark.createDataFrame(VARIANTS, "family_id int, variant_id string, text string")
    residue = spark.createDataFrame(RESIDUE, "family_id int, value string")
    return v.convergence_check(variants, residue, form="NFC")


@pytest.mark.parametrize("few", [64, 2])
def test_families_converge_and_residue_is_counted(spark, monkeypatch, few):
    monkeypatch.setattr(v, "_FEW", few, raising=False)
    rows = {r.family_id: (r.converged, r.distinct_texts, r.variants, r.residue_hits) for r in checked(spark).collect()}
    assert rows == {
        1: (False, 2, 3, 6), 2: (True, 1, 3, 3), 3: (False, 2, 2, 1), 4: (True, 1, 1, 1), 5: (True, 1, 1, 0), None: (True, 1, 2, 0)}


def test_texts_are_not_shuffled_for_a_few_values(spark):
    plan = checked(spark)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("SortMergeJoin|ShuffledHashJoin|BroadcastHashJoin", plan)
