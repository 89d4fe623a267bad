"""Targets of small sources among many."""

from __future__ import annotations

from collections import Counter

import pytest

from ledgerlens.llm import packing


def test_small_sources_get_their_targets(spark):
    rows = [(i, "word " * 59, f"big{i}") for i in range(70)] + [(100 + i, "word " * 49, "a" if i % 4 else None) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumnRenamed("source", "from")
    docs = docs.unionByName(docs.filter("doc_id < 70")).unionByName(docs.filter("doc_id < 70"))
    big = spark.createDataFrame([(1000 + i, "word " * 2500, f"big{i}") for i in range(70)], docs.schema)
    out = packing.pack(docs.unionByName(big), packing.default_tokenizer(), window=200, source_col="from", targets={"a": 3.0, None: 1.0})
    first = Counter()
    for r in out.filter("sequence_id < 5").collect():
        first["null" if (r["doc_id"] - 100) % 4 == 0 and 100 <= r["doc_id"] < 140 else "a" if 100 <= r["doc_id"] < 140 else "other"] += r["length"]
    assert not first["other"] and abs(first["a"] - 750) <= 5
    with pytest.raises(ValueError):
        packing.pack(docs, packing.default_tokenizer(), source_col="from", targets={f"big{i}": 1.0 for i in range(packing.MAX_QUEUES)})
