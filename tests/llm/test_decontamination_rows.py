"""Odd rows of documents and items, against a search of all windows."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

from ledgerlens.llm.decontamination import find_contamination


def found_in(text, items, n=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({65 + i: 97 + i for i in range(26)}))
    have, hit, names = words(text), set(), set()
    for name, item in items:
        want = words(item)
        if name is None or not want:
            continue
        width = min(n, len(want))
        for k in range(len(want) - width + 1):
            for at in range(len(have) - width + 1):
                if have[at : at + width] == want[k : k + width]:
                    hit |= set(range(at, at + width))
                    names.add(str(name))
    return len(have), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)


def test_odd_rows_against_all_windows(spark):
    pick = random.Random(4)
    text = lambda n: " ".join(pick.choice(["red", "Blue", "grün", "4", "x9"]) + pick.choice(["", ",", "!"]) for _ in range(n))
    long = text(12)
    items = [(10, long), (9, long), (9, long), (9, text(3)), (None, text(11)), (11, None), (12, ""), (13, "--"), (14, text(25)), (100, "x9 4 Blue")]
    docs = [(1, None), (1, ""), (2, long), (2, long), (2, text(30)), (None, f"so {long.upper()} end"), (3, text(40) + " " + items[8][1]), (4, "Red"), (5, " ".join(items[4][1].split()))]
    docs += [(6 + i, text(60)) for i in range(10)] + [(20, "pad " * 20_000 + long + " pad" * 5)]
    table = spark.createDataFrame([(i, t, "w", "k", 1, 2) for i, t in docs], "doc_id long, text string, items string, _key string, n_words int, _id int")
    got = find_contamination(table, spark.createDataFrame([(i, t, "d") for i, t in items], "item_id long, text string, doc_id string")).collect()
    fields = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert Counter((r["doc_id"], *(r[f] for f in fields)) for r in got) == Counter((i, *found_in(t, items)) for i, t in docs)
    none = find_contamination(table, spark.createDataFrame([], "item_id long, text string")).collect()
    assert len(none) == len(docs) and not any(r["contaminated"] or r["n_items"] for r in none)
