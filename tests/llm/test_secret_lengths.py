"""Secrets of any length, against a plain search."""

from __future__ import annotations

import re
from collections import Counter

from ledgerlens.llm import secret_scan

PLAIN = re.compile(r"(?:password|token)\s*[:=]\s*([^\s\"'<>]{6,})|(?<![\w+/=-])((?=\S*[0-9])[0-9A-Za-z+/_=-]{20,})(?![\w+/=-])")


def test_values_of_any_length(spark):
    texts = []
    for n in (20, 199, 200, 201, 1_000, 100_000):
        run = ("aB3dE5gH7jK9" * (n // 12 + 1))[:n]
        texts += [f"see {run} there", f"set password={run} then", f"token: {('banana' * n)[: n - 1]}7 end", f"password     :     {run}", f"{'x' * n} {run}"]
    texts.append("password      : short1")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    expected = Counter((i, m.start(), m.group(1) or m.group(2)) for i, t in enumerate(texts) for m in PLAIN.finditer(t))
    assert len(expected) == len(texts)
    words = spark.createDataFrame([("banana", 9), ("there", 5)], "word string, n long")
    rows = secret_scan.with_features(secret_scan.candidates(docs), words, secret_scan.letter_pairs(words))
    got = rows.select("_id", "start", "value", "length", "dictionary").collect()
    assert Counter((r["_id"], r["start"], r["value"]) for r in got) == expected
    assert all(r["length"] == len(r["value"]) and 0 <= r["dictionary"] <= 1 for r in got)
