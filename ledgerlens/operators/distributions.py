"""Exact medians and percentiles by selection, without ordering any group as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def exact_ranks(rows: DataFrame, by: str, value: str, shares: dict[str, float], rounds: int = 2, buckets: int = 1024) -> DataFrame:
    """by, n, mean, least, most, upper_median (element n div 2, from 0) and the interpolated percentiles named in ``shares``.

    Rows are counted by value. Each wanted place starts with the range of its group; in each round the range is cut into ``buckets`` of equal
    width, the counts say which of them holds the place, and the values found in it give the next range. What is ordered in one task is
    the buckets of a place, and in the end the few distinct values of its last range. Nulls are left out."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(by, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    stats = counts.groupBy(by).agg(F.sum("_c").alias("n"), (F.sum(F.col("_v") * F.col("_c")) / F.sum("_c")).alias("mean"), F.min("_v").alias("least"), F.max("_v").alias("most"))
    n = F.col("n")
    places = {"_upper": F.expr("n div 2"), **{f"_{end}_{name}": rounded((n - 1) * p) for name, p in shares.items() for end, rounded in (("lo", F.floor), ("hi", F.ceil))}}
    wanted = F.array(*(F.struct(F.lit(name).alias("_name"), place.cast("long").alias("_place")) for name, place in places.items()))
    targets = stats.select(by, F.col("least").alias("_lo"), F.col("most").alias("_hi"), F.inline(wanted))

    def inside() -> DataFrame:
        return counts.join(targets, by).filter((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))

    def holding(df: DataFrame, order: str) -> DataFrame:
        """The rows whose counts reach over the place, in an order of one target's rows; the place within them."""
        df = df.withColumn("_upto", F.sum("_c").over(Window.partitionBy(by, "_name").orderBy(order)))
        before = F.col("_upto") - F.col("_c")
        return df.filter((F.col("_upto") > F.col("_place")) & (before <= F.col("_place"))).withColumn("_place", F.col("_place") - before)

    for _ in range(rounds):
        at = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * buckets), F.lit(buckets - 1))).otherwise(0)
        cut = inside().withColumn("_b", at).groupBy(by, "_name", "_place", "_b").agg(F.sum("_c").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        targets = holding(cut, "_b").select(by, "_lo", "_hi", "_name", "_place")
    found = holding(inside(), "_v").groupBy(by).agg(*(F.max(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in places))
    part = lambda p: (n - 1) * p - F.floor((n - 1) * p)
    at = lambda name, p: F.col(f"_lo_{name}") + part(p) * (F.col(f"_hi_{name}") - F.col(f"_lo_{name}"))
    return stats.join(found, by).select(by, "n", "mean", "least", "most", F.col("_upper").alias("upper_median"), *(at(name, p).alias(name) for name, p in shares.items()))
