"""The test of candidate pairs on full shingle sets, and components of texts told per document."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import Filter, lean
from .jaccard_join import _filter_words, _hashes
from .shared import checkpointed


def verified(rows: DataFrame, names: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """``pairs`` (a, b) with ok: whether the full shingle sets reach ``percent`` similarity.

    ``rows``: _key, _text; ``names``: id, _key. Only the texts that stand in a pair are shingled again; a filter of bounded
    size finds them in one pass over the texts, and the join by key makes it exact."""
    spark = rows.sparkSession
    asked = checkpointed(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(names, "id"))
    bits = asked.select("_key").mapInArrow(_filter_words, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    wanted = spark.sparkContext.broadcast(Filter(bits.column("word").to_numpy(), bits.column("bit").to_numpy().view(np.uint64)))
    full = rows.mapInArrow(lean(_hashes(k, wanted)), "_key binary, hashes array<long>").join(asked, "_key").dropDuplicates(["id"]).select("id", "hashes")
    both = pairs.join(full.select(F.col("id").alias("a"), F.col("hashes").alias("ha")), "a").join(full.select(F.col("id").alias("b"), F.col("hashes").alias("hb")), "b")
    common = F.size(F.array_intersect("ha", "hb"))
    out = checkpointed(both.select("a", "b", (100 * common >= percent * (F.size("ha") + F.size("hb") - common)).alias("ok")))
    wanted.unpersist()
    return out


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(text))


def by_component(docs: DataFrame, sets: DataFrame, roots: DataFrame, id_col: str, text: Column) -> DataFrame:
    """id, n_shingles and component_id of each row of ``docs``. ``sets``: _key, id, n; ``roots``: node, root of the ids that have links.

    Null ids never become a component's id unless it has no other; a document without a shingle is alone."""
    ids = checkpointed(docs.select(F.col(id_col).alias("_id"), text_key(text).alias("_key")))
    least = ids.groupBy("_key").agg(F.min("_id").alias("_least"))
    texts = least.join(sets, "_key").join(roots.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    tops = texts.groupBy("root").agg(F.min("_least").alias("component_id"))
    out = ids.join(texts.join(tops, "root").select("_key", "n", "component_id"), "_key")
    return out.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("_id")).otherwise(F.col("component_id")).alias("component_id"))
