"""More sources than queues: each keeps its share in every stretch of windows."""

from __future__ import annotations

from collections import Counter, defaultdict

from ledgerlens.llm import packing


def test_sources_of_the_shared_queue_keep_their_shares(spark, monkeypatch):
    monkeypatch.setattr(packing, "MAX_QUEUES", 8)
    monkeypatch.setattr(packing, "BUCKET_TOKENS", 5_000)
    docs = spark.createDataFrame([(i, "word " * 19, None if i % 50 == 0 else f"s{i % 50}") for i in range(5000)], "doc_id long, text string, source string")
    where = {i: i % 50 for i in range(5000)}
    share, whole = defaultdict(Counter), Counter()
    for r in packing.pack(docs, packing.default_tokenizer(), window=2000).collect():
        share[r["sequence_id"] // 10][where[r["doc_id"]]] += r["length"]
        whole[r["doc_id"]] += r["length"]
    assert len(whole) == 5000 and set(whole.values()) == {20}
    for k in range(5):  # ten windows: 20,000 tokens, 400 of each source
        assert len(share[k]) == 50 and all(abs(n - 400) <= 40 for n in share[k].values())
