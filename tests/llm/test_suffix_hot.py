"""Passages of all lengths in many surroundings: their grams are dealt out, and rows stay those of all windows."""

import hashlib
import random
from collections import Counter

import pytest

from ledgerlens.llm import suffix_dedup

from test_results import removed


@pytest.mark.parametrize("parts", [1, 5])
def test_hot_grams_against_all_windows(spark, parts):
    rnd = random.Random(7)

    def words(n):
        return "".join(rnd.choice("abcdefghijklmnop ") for _ in range(n))

    shared = [words(n) for n in (70, 150, 300, 399, 400, 401, 450, 900)]
    texts = [words(rnd.randrange(0, 500)) + rnd.choice(shared) + words(rnd.randrange(0, 500)) for _ in range(300)]
    # equal surroundings up to a window and beyond
    frame = words(500)
    texts += [words(rnd.randrange(1, 50)) + frame[k:] + shared[2] + frame[: 400 - k] for k in range(0, 300, 30)]
    texts += ["z" * 1200, "zy" * 900, texts[0], texts[0], None, ""]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(parts)
    data = [(t or "").encode() for t in texts]
    expected = {}
    for i, (t, runs) in enumerate(zip(data, removed(data, 400), strict=True)):
        kept = b"".join(t[a:b] for a, b in zip([0, *(r[1] for r in runs)], [*(r[0] for r in runs), len(t)], strict=True))
        expected[i] = (len(t), len(t) - len(kept), len(runs), hashlib.sha256(kept).hexdigest())
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got == expected
    assert Counter(v[1] > 0 for v in got.values())[True] > 100
