"""Each transducer of the toxicity grammar by itself, and edge cases of scoring."""

from __future__ import annotations

import numpy as np
import pytest

from ledgerlens.llm.toxicity import FEATURES, Grammar, score_toxicity

GRAMMAR = Grammar({"zorg": 2.0}, {"blarg": 1.0}, phrases={("old", "boot"): 3.0, ("old", "boot", "head"): 1.0})


def found(text):
    return dict(zip(FEATURES, GRAMMAR.features(text, {}), strict=True))


@pytest.mark.parametrize(
    ("text", "feature", "value"),
    [
        ("the zorg is here", "asserted", 2.0),
        ("the blargish thing", "asserted", 1.0),
        ("an old boot is here", "asserted", 3.0),
        ("an old old boot is here", "asserted", 3.0),
        ("an old boot head is here", "asserted", 4.0),
        ("old. boot", "matches", 0.0),
        ("you zorg", "asserted", 3.0),
        ("you a b c d e zorg", "asserted", 2.0),
        ("you zorg", "targeted", 2.0),
        ("not a zorg", "negated", 2.0),
        ("not a zorg", "strongest", 0.5),
        ("not one two three four five zorg", "negated", 0.0),
        ("they said a zorg", "reported", 2.0),
        ("they said. a zorg", "reported", 0.0),
        ("kill you", "threats", 1.0),
        ("i will kill you", "threats", 1.5),
        ("you will die", "threats", 1.5),
        ("kill a b c d e f you", "threats", 0.0),
        ("never kill you", "threats", 0.25),
        ("kill the lights", "threats", 0.0),
        ("", "matches", 0.0),
        (None, "matches", 0.0),
    ],
)
def test_transducers(text, feature, value):
    assert found(text)[feature] == pytest.approx(value)


def test_scores_of_nulls_ties_long_texts_and_clashing_columns(spark):
    grammar = Grammar({"zorg": 2.0}, {})
    grammar.coefficients = np.array([-2.0, 9.0, 0, 0, 0, 0, 0, 0])
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, "zorg " * 50_000, "a"), (4, "a zorg", "a"), (4, "a zorg", "a"), (None, "a Zorg", "a")], "doc_id long, text string, score string")
    got = [(r["doc_id"], round(r["score"], 6), r["predicted"]) for r in score_toxicity(docs, grammar).collect()]
    by = {i: (s, p) for i, s, p in got}
    assert len(got) == 6 and by[1] == by[2] and by[1][1] == 0 and by[3][1] == 1 and by[4] == by[None]
    assert score_toxicity(docs.limit(0), grammar).count() == 0
