"""Guards name what is wrong; selection finds exact places."""

from __future__ import annotations

import random
import statistics

import pytest

from ledgerlens.operators import alignment as A
from ledgerlens.operators.distributions import exact_ranks


def raises(df, *words):
    with pytest.raises(Exception) as e:  # noqa: PT011
        df.collect()
    assert all(w in str(e.value) for w in words)


def test_runs_with_another_truth(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "doc_id long, run int, truth string")
    good = [(1, 0, "a"), (1, 1, "a"), (2, 0, None), (2, 1, None)]
    assert A.same_truth(rows(*good), ["doc_id"], "run", "truth", 2).count() == 2
    raises(A.same_truth(rows(*good, (77, 0, "a"), (77, 1, "b")), ["doc_id"], "run", "truth", 2), "another truth", "77")
    raises(A.same_truth(rows(*good, (78, 0, "a")), ["doc_id"], "run", "truth", 2), "not once in each run", "78")
    raises(A.same_truth(rows(*good, (79, 0, "a"), (79, 0, "a")), ["doc_id"], "run", "truth", 2), "not once in each run", "79")


def test_missing_matches_and_unknown_values(spark):
    rows = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, kind string")
    known = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "id string, n int")
    assert {(r["id"], r["n"]) for r in A.require_match(rows, known, "id").collect()} == {("a", 1), ("b", 2)}
    raises(A.require_match(rows, known.filter("id <> 'b'"), "id"), "no id: b")
    assert A.require_known(rows, "kind", ["x", "y"]).count() == 2
    raises(A.require_known(rows, "kind", ["x"]), "unknown kind: y")
    raises(A.require_known(spark.createDataFrame([(None,)], "kind string"), "kind", ["x"]), "unknown kind: null")


def test_counts_against_a_protocol(spark):
    """The expectation is given, not counted from what is checked."""
    rows = spark.createDataFrame([("a",)] * 12 + [("b",)] * 11, "t string")
    got = A.expect_counts(rows, "t", {"a": 12, "b": 12, "c": 12})
    assert {(r["t"], r["n"], r["ok"]) for r in got.collect()} == {("a", 12, True), ("b", 11, False), ("c", 0, False)}
    raises(A.require(got, got["ok"], "other than the protocol", "t"), "other than the protocol")


@pytest.mark.parametrize(("rounds", "buckets"), [(0, 2), (1, 3), (2, 1024), (5, 2)])
def test_selection_of_exact_places(spark, rounds, buckets):
    pick = random.Random(rounds)
    groups = {"wide": [10 ** pick.uniform(-300, 300) * pick.choice((-1, 1)) for _ in range(301)], "ties": [1.5] * 40 + [2.5] * 41, "one": [7.0], "even": [float(i) for i in range(100)], "steep": [2.0**i for i in range(60)]}
    rows = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [("one", None), ("none", None)], "g string, v double")
    got = {r["g"]: r for r in exact_ranks(rows, "g", "v", {"median": 0.5, "p95": 0.95}, rounds, buckets).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        s, at = sorted(vs), (len(vs) - 1) * 0.95
        low, high = s[int(at)], s[-(-int(at * 1e9) // 10**9)]
        assert (got[g]["n"], got[g]["least"], got[g]["most"], got[g]["upper_median"]) == (len(vs), s[0], s[-1], s[len(vs) // 2])
        assert got[g]["median"] == pytest.approx(statistics.median(vs)) and got[g]["p95"] == pytest.approx(low + (at - int(at)) * (high - low))
