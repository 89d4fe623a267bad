"""Exact deduplication by a tree-merge of sorted digest runs, in DataFrame operations only.

Each partition of the input is a run: its entries (digest, length, second digest, identifier, count) are sorted there, and
neighbours that agree merge before anything is sent. Runs then meet in binomial rounds: in each, the ``fan_in`` runs (a power of two) whose numbers
differ in their last bits become one, slice by slice of leading digest bits; a slice's entries are brought to one task and
merged in their order, and entries that agree in digest, length and second digest become one that retains the identifier to keep.
What is retained is a struct, which Spark aggregates over sorted input only: every level of the plan is a sort and a
sort aggregation. A group that holds a third of all rows sends one entry per partition into the first round and one per run
into each further one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import checkpointed, free_name

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column | str) -> Column:
    """Null as empty, A-Z in lower case; all else is kept as it is.

    ``lower`` gives the same where every character beyond ASCII is a small letter, and is much faster than ``translate``."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.when((F.octet_length(text) == F.char_length(text)) | ~text.rlike(r"[^\x00-\x7F\p{Ll}]"), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


#: What must agree for two texts to be taken for equal.
DIGESTS = ("text_sha256", "_len", "_check")
#: Groups with more than this share of all rows are joined back by broadcast: there are at most so many.
HOT_SHARE = 4096


def _retained(keep: str) -> Column:
    """The identifier that an entry retains, as a struct: the smallest or largest that isn't null, if there is any."""
    return F.min(F.struct(F.col("_id").isNull(), F.col("_id"))) if keep == "smallest" else F.max(F.struct(F.col("_id").isNotNull(), F.col("_id")))


def merge_round(runs: DataFrame, fan_in: int, parts: int, keep: str) -> DataFrame:
    """One round: runs (DIGESTS, _run, _slice, _id, _n) of which ``fan_in`` neighbours become one, each slice of them in one task.

    ``keep``: which identifier the merged entry retains, "smallest" or "largest". Null identifiers stay only if there is no other."""
    met = runs.withColumn("_run", F.expr(f"_run div {fan_in}")).repartition(parts, "_run", "_slice")
    merged = met.groupBy("_run", "_slice", *DIGESTS).agg(_retained(keep).alias("_best"), F.sum("_n").alias("_n"))
    return merged.select("_run", "_slice", *DIGESTS, F.col("_best._id").alias("_id"), "_n")


def merge_runs(entries: DataFrame, runs: int, fan_in: int = 4, keep: str = "largest", slices: int = 256) -> DataFrame:
    """Entries (DIGESTS, _id, _run with 0 <= _run < runs) as one row per distinct text: DIGESTS, _id, _n."""
    if fan_in < 2 or fan_in & (fan_in - 1):
        raise ValueError("fan_in is a power of two")
    parts = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    piece = F.pmod(F.conv(F.substring("text_sha256", 1, 4), 16, 10).cast("int"), F.lit(slices))
    # the first round's partial aggregation is the sorting of each partition's own run
    first = entries.select(F.expr(f"_run div {fan_in}").alias("_run"), piece.alias("_slice"), *DIGESTS, "_id")
    merged = first.groupBy("_run", "_slice", *DIGESTS).agg(_retained(keep).alias("_best"), F.count("*").alias("_n")).select("_run", "_slice", *DIGESTS, F.col("_best._id").alias("_id"), "_n")
    left = -(-runs // fan_in)
    while left > 1:
        merged, left = merge_round(merged, fan_in, parts, keep), -(-left // fan_in)
    return merged.select(*DIGESTS, "_id", "_n")


def _digested(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_id and DIGESTS of each row, and _run, its partition; texts are read and hashed once."""
    rows = docs.select(F.col(id_col).alias("_id"), normalised(F.col(text_col)).alias("_t"))
    return checkpointed(rows.select("_id", F.sha2("_t", 256).alias("text_sha256"), F.octet_length("_t").alias("_len"), F.xxhash64("_t").alias("_check"), F.spark_partition_id().alias("_run")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 4, keep: str = "largest") -> DataFrame:
    """One row per row of ``docs``: its id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their normalised forms have the same SHA-256, the same length in bytes and the same second,
    independent digest. Null text counts as empty, and empty texts are one group. Rows that
    repeat both id and text can't be told apart, so each of them gets the same values. Rows with a null id are kept only if their group has no
    other id (keep_id is then null). Other columns of ``docs`` are ignored, whatever their names. An empty table gives
    an empty result."""
    rows = _digested(docs, id_col, text_col)
    size = rows.agg(F.max("_run").alias("runs"), F.count("*").alias("n")).first()
    kept = checkpointed(merge_runs(rows, (size["runs"] or 0) + 1, fan_in, keep).select(*DIGESTS, F.col("_id").alias("keep_id"), F.col("_n").alias("group_size")))
    is_hot = F.col("group_size") * HOT_SHARE > size["n"]  # at most HOT_SHARE groups, whatever the table holds
    # their rows stay where they are; all others meet by digest, and no task gets more than one part in HOT_SHARE of one group
    hot = kept.filter(is_hot & (F.col("group_size") > 1))
    named = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), list(DIGESTS), "left")
    cold = rows.join(F.broadcast(hot.select(*DIGESTS)), list(DIGESTS), "left_anti").join(kept.filter(~(is_hot & (F.col("group_size") > 1))), list(DIGESTS))
    columns = [F.col("_id").alias(id_col), "keep_id", "group_size", F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"]
    return named.filter("_hot").select(*columns).unionByName(cold.select(*columns))


def _row_name(identifier: Column, sha: Column) -> Column:
    """Identifier and digest in one string, never null."""
    return F.concat(F.coalesce(F.concat(F.lit("="), identifier.cast("string")), F.lit("-")), F.lit("/"), sha)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one of each group of equal texts, as ``exact_dedup`` decides.

    Rows meet their decision by identifier and digest together, in one shuffle, and the rows of a large group are spread
    over all tasks; of rows that repeat both, one stays."""
    name = free_name(docs, "_row")
    stay = exact_dedup(docs, id_col, text_col, keep=keep).filter("kept").select(_row_name(F.col(id_col), F.col("text_sha256")).alias(name))
    rows = docs.withColumn(name, _row_name(F.col(id_col), F.sha2(normalised(F.col(text_col)), 256)))
    return rows.join(stay, name, "left_semi").dropDuplicates([name]).drop(name)


def op2_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""
