"""Shard placement by a permutation-filled lookup table.

Each shard walks its own permutation of the slots of a prime-sized table; shards take turns, each claiming its next
free slot, until the table is full. A key is placed by hashing it to a slot. When a shard goes, almost only its own
slots change hands."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The table is broadcast; its size is a parameter that must not pass this bound (about 16 MB in memory).
MAX_SLOTS = 1_000_003


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def _seed(name: str, salt: str, bound: int) -> int:
    return int.from_bytes(hashlib.sha256(f"{salt}:{name}".encode()).digest()[:8], "big") % bound


def fill_table(shards: list[str], slots: int, weights: dict[str, int] | None = None) -> np.ndarray:
    """slot -> position in ``shards``. A shard of weight w takes w turns a round (1 if not given)."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct and at least one")
    if not is_prime(slots) or not len(shards) <= slots <= MAX_SLOTS:
        raise ValueError(f"slots must be a prime from the number of shards to {MAX_SLOTS}")
    start = [_seed(s, "start", slots) for s in shards]
    step = [1 + _seed(s, "step", slots - 1) if slots > 2 else 1 for s in shards]
    turns = [i for i, s in enumerate(shards) for _ in range(max(1, (weights or {}).get(s, 1)))]
    owner, tried, left = [-1] * slots, [0] * len(shards), slots
    while left:
        for i in turns:
            while owner[slot := (start[i] + tried[i] * step[i]) % slots] >= 0:
                tried[i] += 1
            owner[slot] = i
            tried[i] += 1
            left -= 1
            if not left:
                break
    return np.array(owner, np.int32)


def shard(rows: DataFrame, key_cols: list[str], shards: list[str], slots: int = 65_537, weights: dict[str, int] | None = None) -> DataFrame:
    """``rows`` with columns slot long and shard string added (replacing columns of these names, in any case of their letters).

    Key columns called slot or shard are hashed before they are replaced. An empty table gives no rows. A key is the hash of ``key_cols``;
    nulls hash too, so rows with null keys share one shard, and repeated rows go where their equals go. Texts are hashed whole. The table has ``slots`` rows, at most MAX_SLOTS, and is broadcast."""
    owner = fill_table(shards, slots, weights)
    spark = rows.sparkSession
    rest = [c for c in rows.columns if c.lower() not in ("slot", "shard")]
    table = spark.createDataFrame([(int(s), shards[int(o)]) for s, o in enumerate(owner)], "slot long, shard string")
    placed = rows.select(*rest, F.pmod(F.xxhash64(*key_cols), F.lit(slots)).alias("slot"))
    return placed.join(F.broadcast(table), "slot").select(*rest, "slot", "shard")


def op4_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "n_chars")
    return shard(docs, ["doc_id"], [f"shard-{i:03d}" for i in range(64)])
