"""Near duplicates against all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import minhash as M
from ledgerlens.llm.linking import text_key

from test_results import edge, table  # noqa: F401


def shingle_set(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()


def plain(rows, k=4, percent=80):
    """{(id, size, component, kept): count} by all pairs."""
    sets = [shingle_set(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * min(len(sets[a]), len(sets[b])) >= percent * max(len(sets[a]), len(sets[b])) and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[top(a)] = top(b)
    least = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            least[top(a)] = min(least.get(top(a), i), i)
    out = []
    for a, (i, _) in enumerate(rows):
        c = least.get(top(a)) if sets[a] else i
        out.append((i, len(sets[a]), c, i == c))
    return sorted(out, key=repr)


def result(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()), key=repr)


def test_edge_cases(edge):  # noqa: F811
    rows = [(r["doc_id"], r["text"]) for r in edge.collect()]
    assert result(M.near_duplicates(edge, k=4)) == plain(rows)
    assert M.near_duplicates(edge.filter("doc_id < 0")).collect() == []


def test_documents(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert result(M.op12_minhash_near_dedup(spark, sf)) == plain(rows)


@pytest.mark.parametrize(("seed", "dense"), [(1, M.DENSE), (2, 0)])
def test_families_around_the_threshold(spark, seed, dense):
    """Families of short and long texts whose members lie on both sides of 0.8, also chains, and one template that many texts share below it."""
    pick, rows = random.Random(seed), []
    vocabulary = [f"w{i}" for i in range(3000)]
    template = pick.choices(vocabulary, k=60)
    for n in (5, 8, 12, 30, 90, 400):
        for _ in range(6):
            base = pick.choices(vocabulary, k=n)
            for _ in range(6):
                one = list(base)
                for _ in range(pick.randrange(1 + n // 25 + (n > 10))):
                    one[pick.randrange(n)] = pick.choice(vocabulary)
                rows.append((len(rows), " ".join(one[: n - pick.randrange(2)])))
                if pick.random() < 0.5:
                    base = one
    rows += [(len(rows) + j, " ".join([*template, *pick.choices(vocabulary, k=30)])) for j in range(700)]
    pick.shuffle(rows)
    # with no pair allowed a member, every unit is thinned out to its forest first
    assert result(M.near_duplicates(table(spark, rows).repartition(5), k=4, dense=dense)) == plain(rows)


def test_a_star_is_bounded(spark):
    """Of n near copies at most n - 1 edges a bucket are verified, not all pairs."""
    base = [f"b{i}" for i in range(300)]
    rows = [(i, " ".join([*base[:150], f"x{i}", *base[150:]])) for i in range(400)]
    docs = table(spark, rows)
    text = F.col("text")
    _, links, _ = M.minhash_links(docs.select(text_key(text).alias("_key"), text.alias("_text")), 4, 80)
    assert 399 <= links.count() <= 399 * M.BANDS / 4
    assert {r["component_id"] for r in M.near_duplicates(docs).collect()} == {0}


def test_densified_bins_agree_as_sets_do():
    """The share of equal bins is the similarity, on average, for small sets as well."""
    rng = np.random.default_rng(2)
    order = M.borrow_order(M.BANDS * M.WIDTH)
    for common, own in ((8, 1), (40, 10), (400, 50)):
        share = []
        for _ in range(300):
            x = rng.integers(0, 1 << 63, common + 2 * own, dtype=np.uint64) * np.uint64(2)
            a, b = (M.signature(np.sort(x[i]), order) for i in (np.r_[:common, common : common + own], np.r_[:common, common + own : common + 2 * own]))
            share.append((a == b).mean())
        assert abs(np.mean(share) - common / (common + 2 * own)) < 0.03


def test_overlap_bounds_hold_and_are_close():
    rng = np.random.default_rng(4)
    pool = rng.integers(0, 1 << 63, 400, dtype=np.uint64) * np.uint64(2)
    sets = [np.sort(rng.choice(pool, n, replace=False)) for n in (1, 5, 7, 8, 9, 30, 60, 64, 100, 120, 130, 250, 300) for _ in range(3)]
    maps = M.Bitmaps(np.array([len(s) for s in sets]), [M.bitmap(s) for s in sets])
    for i, s in enumerate(sets):
        for j, most in enumerate(maps.overlap(i, np.arange(len(sets))).tolist()):
            common = len(np.intersect1d(s, sets[j]))
            may_link = 100 * min(len(s), len(sets[j])) >= 80 * max(len(s), len(sets[j]))
            if may_link:
                assert common <= most <= common + 0.25 * len(s) + 3


def test_a_bucket_of_texts_below_the_threshold_gives_few_pairs(spark):
    """Texts that share three quarters of their shingles meet in buckets, but bounds on their overlap keep pairs from being made."""
    pick, rows = random.Random(9), []
    base = [f"b{i}" for i in range(160)]
    for i in range(300):
        rows.append((i, " ".join([*base[:80], *(f"x{i}y{j}" for j in range(18)), *base[80:]])))
    pick.shuffle(rows)
    docs = table(spark, rows)
    assert result(M.near_duplicates(docs, k=4)) == plain(rows)
