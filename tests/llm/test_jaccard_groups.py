"""Large groups of near copies, dealt out in blocks, against all pairs."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from test_results import jaccard_classes, table

from ledgerlens.llm import jaccard_join


@pytest.mark.parametrize("block", [4, 32])
def test_blocks_of_a_large_group_lose_no_link(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    pick = random.Random(block)
    words = [f"w{i}" for i in range(300)]
    base = [pick.choice(words) for _ in range(60)]
    made = []
    for i in range(400):
        x = list(base)
        # up to three changes: some copies stand alone, others link by a chain
        for _ in range(pick.randrange(4)):
            x[pick.randrange(len(x))] = pick.choice(words)
        made.append((i, " ".join(x)))
    made += [(1000 + i, made[0][1] if i % 2 else made[0][1].upper()) for i in range(100)]
    docs = table(spark, made)
    got = jaccard_join.jaccard_components(docs).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == jaccard_classes(made)
