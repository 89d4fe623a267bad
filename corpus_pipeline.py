"""A training corpus from raw documents: STAGES in order, each of one operator over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.decontamination import find_contamination
from ledgerlens.llm.exact_dedup import keep_one
from ledgerlens.llm.jaccard_join import jaccard_components
from ledgerlens.llm.packing import default_tokenizer, pack
from ledgerlens.llm.shared import free_name, stored
from ledgerlens.llm.toxicity import learn_from, score_toxicity

#: Near copies share 80 % of their five-word shingles; op10's own contract (four words, 85 %) binds only that query.
NEAR_WORDS, NEAR_PERCENT = 5, 80
#: A text with a byte of a word in it: anything but the white space that the shingles are split at.
WORD = r"[^\x20\x09-\x0D]"


def _row_key() -> Column:
    """A digest of id and text together, never null: decisions on a row go back to rows of the same id and text only."""
    name = F.col("doc_id").cast("string")
    return F.unhex(F.md5(F.concat(F.coalesce(F.concat(F.length(name).cast("string"), F.lit(":"), name), F.lit("n:")), F.coalesce(F.col("text"), F.lit("")))))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar rejects go. It learns from the labelled ones among ``docs``."""
    own = [c for c in docs.columns if c.lower() in ("score", "predicted")]
    aside = {c: free_name(docs, f"_{c}_of_docs") for c in own}
    scored = score_toxicity(docs.withColumnsRenamed(aside), learn_from(spark, sf_dir, docs)).filter("predicted = 0").drop("score", "predicted")
    return scored.withColumnsRenamed({v: k for k, v in aside.items()})


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id stays."""
    return keep_one(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents (five-word shingles, 0.8) one row stays: that with the smallest id, null last, and
    of rows of one id that with the smallest digest. Documents without words stay."""
    key = free_name(docs, "_row")
    has_words = F.coalesce(F.col("text"), F.lit("")).rlike(WORD)
    worded = docs.filter(has_words)
    ranked = worded.select(F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), _row_key().alias("key")).alias("doc_id"), "text")
    found = jaccard_components(ranked, k=NEAR_WORDS, percent=NEAR_PERCENT)
    kept = found.filter("doc_id.key = component_id.key").select(F.col("doc_id.key").alias(key)).distinct()
    one = worded.withColumn(key, _row_key()).join(kept, key, "left_semi").dropDuplicates([key]).drop(key)
    return one.unionByName(docs.filter(~has_words))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    key = free_name(docs, "_row")
    found = find_contamination(docs.select(_row_key().alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = found.filter("contaminated").select(F.col("doc_id").alias(key)).distinct()
    return docs.withColumn(key, _row_key()).join(gone, key, "left_anti").drop(key)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rest as pieces of sequences of 2048 tokens."""
    return pack(docs, default_tokenizer())


STAGES = [("toxicity", toxicity), ("exact_duplicates", exact_duplicates), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("packing", packing)]
#: The toxicity model can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage keeps is written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = stored(docs)
    return docs
