"""Codes against a search of all entries in plain Python."""

from __future__ import annotations

import hashlib
import math
import random
from collections import defaultdict

import numpy as np

from ledgerlens.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<float>, label int, q string, near int, error double"


def plain(rows, parts=16, entries=64, rounds=2, scale=256):
    """{(id, integers): (code, error)}, summed errors by label and the digest of the books."""
    kept = [(i, tuple(math.floor(scale * float(np.float32(x))) for x in v), label) for i, v, label in rows]
    step = len(kept[0][1]) // parts
    cut = lambda q, p: q[p * step : (p + 1) * step]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(q, p) for _, q, _ in first] for p in range(parts)]

    def choose(x, p):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), j) for j, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            met = defaultdict(list)
            for _, q, _ in kept:
                met[choose(cut(q, p), p)[1]].append(cut(q, p))
            for j, xs in met.items():
                books[p][j] = tuple(sum(c) // len(xs) for c in zip(*xs, strict=True))
    out, labels = [], defaultdict(int)
    for i, q, label in kept:
        best = [choose(cut(q, p), p) for p in range(parts)]
        error = sum(d for d, _ in best)
        labels[label] += error
        out.append((i, label, "".join(f"{j:02x}" for _, j in best), error))
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((i, code, error, labels[label], sha) for i, label, code, error in out), key=repr)


def result(df):
    return sorted(((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in df.collect()), key=repr)


def test_edges_and_ties(spark):
    pick = random.Random(5)
    good = [(i, [pick.choice([-1.0, -0.004, 0.0, 0.004, 0.5, 3.25]) for _ in range(32)], None if i % 3 == 0 else i % 2) for i in range(150)]
    good += [good[7], good[7], (None, good[9][1], 1), (3, good[50][1], 4)]
    bad = [(500, None, 1), (501, [None, *good[0][1][1:]], 1), (502, [float("nan"), *good[0][1][1:]], 1), (503, [float("inf"), *good[0][1][1:]], 1)]
    apart = [(600, [1.0] * 31, 1), (601, [1e30, *good[0][1][1:]], 0), (602, [], None)]
    df = spark.createDataFrame([(*r, "x", 1, 2.0) for r in good + bad + apart], SCHEMA)
    got = V.vector_codes(df).collect()
    assert sorted(r["vec_id"] for r in got if r["code"] is None) == [600, 601, 602]
    assert result(V.vector_codes(df.filter("vec_id is null or vec_id < 500"))) == plain(good)
    assert sorted(((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in got if r["code"]), key=repr) == plain(good)


def test_fewer_vectors_than_entries_and_none(spark):
    rows = [(i, [i / 7 + j for j in range(16)], 1) for i in range(5)]
    df = spark.createDataFrame([(*r, "x", 1, 2.0) for r in rows], SCHEMA)
    assert result(V.vector_codes(df)) == plain(rows)
    assert V.vector_codes(df.filter("vec_id < 0")).collect() == []


def test_bounds_prune_and_change_nothing():
    rng = np.random.default_rng(3)
    entries = rng.integers(-300, 300, (64, 4))
    x = np.concatenate([rng.integers(-300, 300, (3000, 4)), entries, entries + 1, rng.integers(-(2**26), 2**26, (500, 4))])
    pivots = V.choose_pivots(entries, 4)
    near = np.sqrt(V.squares(x[:, None], pivots[None]).astype(float)).astype(np.float32)
    at, best, tried = V.nearest(x, near, entries, pivots)
    full = V.squares(x[:, None], entries[None])
    assert (best == full.min(1)).all() and (at == full.argmin(1)).all()
    assert V.nearest(x[:3000], near[:3000], entries, pivots)[2] < 0.3 * 3000 * 64


def test_whole_table(spark, sf):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert result(V.op11_vector_codes(spark, sf)) == plain(rows)
