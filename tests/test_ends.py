"""First and last rows of groups against a loop over the rows."""

from __future__ import annotations

import random

from ledgerlens.operators.sampling import first_and_last, first_or_last


def test_ends_of_groups(spark):
    pick = random.Random(5)
    rows = [(pick.choice(["a", "b", None]), k, pick.choice(["x", None]), f"v{k}") for k in pick.sample(range(1000), 60)]
    rows += [("null first", None, "n", "nothing"), ("null first", 3, "n", "three")]
    table = spark.createDataFrame(rows, "g string, t int, other string, v string")
    order = lambda r: (r[1] is not None, r[1] or 0)
    first, last = {}, {}
    for r in sorted(rows, key=order):
        first.setdefault(r[0], r)
        last[r[0]] = r
    assert {tuple(r) for r in first_or_last(table, ["g"], ["t"]).collect()} == set(first.values())
    assert {tuple(r) for r in first_or_last(table, ["g"], ["t"], last=True).collect()} == set(last.values())
    assert first_or_last(table, ["g"], ["t"]).columns == table.columns
    both = {r["g"]: (r["first"]["v"], r["last"]["v"]) for r in first_and_last(table, ["g"], ["t"]).collect()}
    assert both == {g: (first[g][3], last[g][3]) for g in first}
    assert first_or_last(table.limit(0), ["g"], ["t"]).count() == 0


def test_rows_are_brought_down_before_they_are_sent(spark):
    plan = first_or_last(spark.range(10).selectExpr("id % 2 AS g", "id AS t"), ["g"], ["t"])._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan and "Window" not in plan
