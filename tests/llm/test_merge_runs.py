"""The tree-merge of sorted runs: its plan, its rounds, and which identifiers stay."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import exact_dedup as E

ENTRY = "text_sha256 string, _len int, _check long, _id long, _run int"


def entries(spark, runs):
    pick = random.Random(runs)
    hashes = ["".join(pick.choice("0123456789abcdef") for _ in range(64)) for _ in range(40)]
    rows = [(h := pick.choice(hashes), 5, hash(h) & 0xFFFF, None if pick.random() < 0.2 else pick.randrange(1000), r) for r in range(runs) for _ in range(pick.randrange(30))]
    return spark.createDataFrame([*rows, ("f" * 64, 1, 1, None, runs - 1), ("f" * 64, 2, 1, 3, 0), ("f" * 64, 1, 2, 4, 0)], ENTRY)


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize(("runs", "fan_in"), [(1, 2), (2, 2), (7, 2), (17, 4), (70, 8)])
def test_one_entry_a_text(spark, runs, fan_in, keep):
    e = entries(spark, runs)
    best = F.min("_id") if keep == "smallest" else F.max("_id")
    want = {tuple(r) for r in e.groupBy(*E.DIGESTS).agg(best, F.count("*")).collect()}
    assert {tuple(r) for r in E.merge_runs(e, runs, fan_in, keep).collect()} == want


def test_each_level_merges_in_order(spark):
    """Every aggregation of the plan reads sorted input: a level has a sort and a sort aggregation, and none is by hash."""
    e = entries(spark, 16)
    plan = E.merge_runs(e, 16, 2)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan
    rounds = re.findall(r"hashpartitioning\(_run#\d+L?, _slice#\d+L?, \d+\)", plan)
    assert len(rounds) == 3 and len(re.findall(r"\bSort \[", plan)) >= 4 and len(re.findall(r"SortAggregate\(", plan)) == 8


def test_other_widths_are_refused(spark):
    with pytest.raises(ValueError, match="power of two"):
        E.merge_runs(entries(spark, 2), 2, 3)
