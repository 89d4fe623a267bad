"""Splits, samples, deduplication by first or last, and preference pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seeded(key: list[str], seed: int) -> Column:
    """An order that depends on the key and the seed alone, the same in other engines."""
    return F.md5(F.concat_ws("|", *(F.col(k).cast("string") for k in key), F.lit(str(seed))))


def placed(groups: DataFrame, group: str, seed: int) -> tuple[DataFrame, int]:
    """Distinct ``groups`` with _place, from 1 in the order of their hashes, and their number.

    Places come from exact counts of hash buckets, so no task orders all groups."""
    groups = groups.withColumn("_h", seeded([group], seed)).withColumn("_b", F.substring("_h", 1, 3))
    buckets = groups.groupBy("_b").agg(F.count("*").alias("_n"))
    before = buckets.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # 4096 rows at most
    n = before.agg(F.sum("_n")).first()[0] or 0
    within = F.row_number().over(Window.partitionBy("_b").orderBy("_h", group))
    return groups.withColumn("_in", within).join(F.broadcast(before.select("_b", "_before")), "_b").select(group, (F.col("_before") + F.col("_in")).alias("_place")), n


def group_split(rows: DataFrame, group: str, seed: int = 42, train: float = 0.70, valid: float = 0.15) -> DataFrame:
    """``rows`` with split: whole groups go to train, valid or test; sizes are floor(n * share), the rest is test.

    Cut points come from the groups' order of hashes by exact counts of hash buckets, so no task orders all groups."""
    ranked, size = placed(rows.select(group).distinct(), group, seed)
    n, place = F.lit(size), F.col("_place")
    split = ranked.select(group, F.when(place <= F.floor(n * train), "train").when(place <= F.floor(n * train) + F.floor(n * valid), "valid").otherwise("test").alias("split"))
    return rows.join(split, group)


def stratified(rows: DataFrame, stratum: str, key: list[str], k: int, seed: int = 42) -> DataFrame:
    """At most k rows of each stratum, without replacement; a short one gives all it has."""
    w = Window.partitionBy(stratum).orderBy(seeded(key, seed), *key)
    return rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")


def sample_groups(rows: DataFrame, group: str, ratio: float, seed: int = 42) -> DataFrame:
    """Whole groups, max(1, round-half-even(n * ratio)) of them, the first in the order of their hashes."""
    ranked, n = placed(rows.select(group).distinct(), group, seed)
    return rows.join(ranked.filter(F.col("_place") <= max(1, round(n * ratio))), group, "left_semi")


def first_or_last(rows: DataFrame, by: list[str], seq: list[str], last: bool = False) -> DataFrame:
    """One row of each group: the first seen, or the last. Rows of a task are brought down to one a group before they are sent, so a
    group of any size costs a row a task. Nulls come first; null keys are a group."""
    return rows.groupBy(*by).agg(_end(rows, by, seq, last).alias("_e")).select(*by, "_e.*").select(*rows.columns)


def first_and_last(rows: DataFrame, by: list[str], seq: list[str]) -> DataFrame:
    """``by``, first and last (structs of the other columns): both ends of each group in one pass."""
    return rows.groupBy(*by).agg(_end(rows, by, seq, False).alias("first"), _end(rows, by, seq, True).alias("last"))


def _end(rows: DataFrame, by: list[str], seq: list[str], last: bool) -> Column:
    return (F.max_by if last else F.min_by)(F.struct(*(c for c in rows.columns if c not in by)), F.struct(*seq))


def suffix_repeats(rows: DataFrame, by: list[str], key: str, seq: list[str]) -> DataFrame:
    """``rows`` with named: k, k#2, k#3 ... in order of appearance within the group."""
    r = F.row_number().over(Window.partitionBy(*by, key).orderBy(*seq))
    return rows.withColumn("named", F.when(r == 1, F.col(key)).otherwise(F.concat(F.col(key), F.lit("#"), r.cast("string"))))


def preference_pairs(candidates: DataFrame, by: str, reward: str, seq: str, text: str, gap: float) -> DataFrame:
    """Best and worst candidate of each group: the earliest of the best, the latest of the worst; only if they lie ``gap`` apart."""
    best = F.max_by(F.col(text), F.struct(F.col(reward), -F.col(seq)))
    worst = F.min_by(F.col(text), F.struct(F.col(reward), -F.col(seq)))
    out = candidates.groupBy(by).agg(best.alias("chosen"), worst.alias("rejected"), F.max(reward).alias("reward_chosen"), F.min(reward).alias("reward_rejected"), F.count("*").alias("n_samples"))
    return out.filter(F.col("reward_chosen") - F.col("reward_rejected") >= gap)


def remaining(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that the journal of processed keys doesn't hold."""
    return rows.join(done.select(*keys).distinct(), keys, "left_anti")


def new_contents(rows: DataFrame, earlier: DataFrame, text: str) -> DataFrame:
    """Rows whose content no earlier row has, one of each content hash (the smallest of the other columns)."""
    digest = F.sha2(F.col(text), 256)
    seen = earlier.select(digest.alias("_sha")).distinct()
    return rows.withColumn("_sha", digest).join(seen, "_sha", "left_anti")
