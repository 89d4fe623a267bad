"""Fuzzy search by an index of grams against all pairs."""

from __future__ import annotations

import random
from difflib import SequenceMatcher

import pytest

from ledgerlens.operators import lexicon as L
from ledgerlens.plans import catalogue


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


SIMILAR = {L.Edits: lambda a, b: 1 - distance(a, b) / max(len(a), len(b)), L.Characters: lambda a, b: SequenceMatcher(None, a, b).ratio()}


@pytest.mark.parametrize("measure", [L.Edits, L.Characters])
def test_same_rows_as_all_pairs(spark, measure):
    """Short and long texts, repeated grams, ties, texts with nothing in common with any entry, and a field of one entry."""
    pick = random.Random(4)
    word = lambda n, of="abcdefgh": "".join(pick.choice(of) for _ in range(n))
    entries = sorted({word(n) for n in (1, 2, 3, 5, 8, 12, 20) for _ in range(8)} | {"aaaaaaaa", "aaaaaaab", "abababab", "材料清单一号", "材料清单二号"})
    asked = {"zzzz", "z", "aaaaaaa", "ababababab", "材料清单三号", "材料清"}
    for e in entries:
        at = pick.randrange(len(e) + 1)
        asked |= {e[:at] + "x" + e[at:], e[:at] + e[at + 1 :], e[at:] + e[:at]}
    asked = sorted(asked - set(entries) - {""})
    lexicon = spark.createDataFrame([("f", e) for e in entries] + [("one", "abcd")], "field string, key string")
    values = spark.createDataFrame([("f", a) for a in asked] + [("one", "abxd"), ("one", "abxd")], "field string, key string")
    got = {(r["field"], r["asked"]): (r["best"], round(r["sim"], 5), round(r["margin"], 5)) for r in L.best_two(values, lexicon, measure).collect()}
    want = {}
    for field, a, of in [*(("f", a, entries) for a in asked), ("one", "abxd", ["abcd"])]:
        top = sorted(((SIMILAR[measure](a, e), e) for e in of), key=lambda x: (-x[0], x[1]))[:2]
        want[field, a] = (top[0][1], round(top[0][0], 5), round(top[0][0] - (top[1][0] if len(top) > 1 else 0), 5))
    assert got == want


def test_few_pairs_are_measured(spark):
    """Of a lexicon of some 2,000 labels, less than a twentieth of all pairs come to be measured, and no value needs them all."""
    asked, entries = catalogue.labels_asked(spark, "/root/testdata/sf0.01")
    pairs, rest, seeds = L.candidate_pairs(asked.withColumnRenamed("key", "asked"), entries.withColumnRenamed("key", "entry"), L.Edits)
    n, m = asked.count(), entries.count()
    assert n > 500 and m > 1500
    assert pairs.count() + seeds.count() + rest.count() * m < 0.05 * n * m


def test_no_value_meets_the_grams_of_the_lexicon(spark):
    """Values and entries are compared by two numbers a text: no gram is a row, and the search is spread over tasks whatever its bytes."""
    asked, entries = catalogue.labels_asked(spark, "/root/testdata/sf0.01")
    pairs, rest, _ = L.candidate_pairs(asked.withColumnRenamed("key", "asked"), entries.withColumnRenamed("key", "entry"), L.Edits)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "inline(grams" not in plan and "inline(slice(rare" not in plan
    assert pairs.rdd.getNumPartitions() >= int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert rest.count() < 0.01 * asked.count()
