"""The lookup table and the placement of rows against slow versions of their own, and odd tables."""

from __future__ import annotations

import hashlib
import struct
from collections import Counter

import pytest
import xxhash

from ledgerlens.llm.sharding import shard
from ledgerlens.llm.shared import checkpoint_folder


def slow_table(shards, slots, weights):
    """Each shard's whole preference list; in each turn it takes the first slot of it that nobody has."""

    def number(what, name, bound):
        return int(hashlib.sha256(f"{what}:{name}".encode()).hexdigest()[:16], 16) % bound

    lists = {s: [(number("start", s, slots) + j * (1 + number("step", s, slots - 1))) % slots for j in range(slots)] for s in shards}
    assert all(sorted(order) == list(range(slots)) for order in lists.values())
    owner = {}
    while len(owner) < slots:
        for s in shards:
            for _ in range(weights.get(s, 1)):
                if len(owner) < slots:
                    owner[next(x for x in lists[s] if x not in owner)] = s
    return owner


def slot_of(value, slots, seed=42):
    """A null leaves the seed as it is."""
    if value is None:
        h = seed
    else:
        h = xxhash.xxh64_intdigest(struct.pack("<q", value) if isinstance(value, int) else value.encode(), seed=seed)
    return (h - (1 << 64) if h >> 63 else h) % slots


@pytest.mark.parametrize("weights", [{}, {"b": 3}])
def test_rows_against_a_slow_table(spark, weights):
    slots, names = 211, ["a", "b", "c", "d", "e"]
    keys = [*range(-40, 300), None, None, 7, 7, 1 << 40]
    owner = slow_table(names, slots, weights)
    got = shard(spark.createDataFrame([(k,) for k in keys], "k long"), ["k"], names, slots, weights).collect()
    assert Counter((r.k, r.slot, r.shard) for r in got) == Counter((k, slot_of(k, slots), owner[slot_of(k, slots)]) for k in keys)
    if weights:
        assert 3 * min(Counter(owner.values()).values()) - 3 <= Counter(owner.values())["b"]


def test_names_in_use_long_texts_and_ties(spark):
    texts = ["", "x" * 200_000, "y", "y", None]
    rows = spark.createDataFrame([(t, 5, "mine", i % 2) for i, t in enumerate(texts)], "Slot string, other int, SHARD string, _id int")
    owner = slow_table(["one", "two"], 13, {})
    got = shard(rows, ["Slot"], ["one", "two"], 13).collect()
    assert got[0].__fields__ == ["other", "_id", "slot", "shard"]
    assert Counter((r["_id"], r["slot"], r["shard"]) for r in got) == Counter((i % 2, slot_of(t, 13), owner[slot_of(t, 13)]) for i, t in enumerate(texts))
    assert shard(rows.limit(0), ["Slot"], ["one", "two"], 13).count() == 0


@pytest.mark.parametrize(("shards", "slots"), [([], 11), (["a", "a"], 11), (["a", "b", "c"], 2), (["a"], 1_000_033)])
def test_tables_that_cannot_be(spark, shards, slots):
    with pytest.raises(ValueError):
        shard(spark.range(1), ["id"], shards, slots)


def test_a_cluster_must_name_a_shared_folder():
    class Context:
        def __init__(self, master):
            self.master, self.folder = master, None

        def getCheckpointDir(self):
            return self.folder

        def setCheckpointDir(self, folder):
            self.folder = folder

    class Session:
        def __init__(self, master, **settings):
            self.sparkContext, self.conf = Context(master), {k.replace("_", "."): v for k, v in settings.items()}

    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            checkpoint_folder(Session(master))
        assert checkpoint_folder(Session(master, spark_checkpoint_dir="hdfs://x")) == "hdfs://x"
    assert checkpoint_folder(Session("local[4]")) and checkpoint_folder(Session("local"))
