"""Sinks: predictions, summaries, error reports, tables for spreadsheets, logs and journals, written through Spark's file systems."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, path: str, text: str, mark: bool = False, overwrite: bool = False) -> None:
    """One small UTF-8 file from the driver; ``mark`` puts a byte-order mark first."""
    at, fs = _fs(spark, path)
    if fs.exists(at) and not overwrite:
        raise FileExistsError(path)
    out = fs.create(at, overwrite)
    try:
        out.write(bytearray((b"\xef\xbb\xbf" if mark else b"") + text.encode()))
    finally:
        out.close()


def write_predictions(rows: DataFrame, path: str) -> None:
    """All rows as JSON lines; nulls are written, characters stay as they are. An existing path raises an error."""
    rows.write.mode("errorifexists").option("ignoreNullFields", False).json(path)


def write_summary(summary: DataFrame, path: str) -> dict:
    """The one row of a summary as an indented JSON file."""
    rows = summary.limit(2).collect()
    if len(rows) != 1:
        raise ValueError("a summary has one row")
    found = rows[0].asDict(recursive=True)
    write_text(summary.sparkSession, path, json.dumps(found, ensure_ascii=False, indent=2, default=str))
    return found


def error_cases(scores: DataFrame, seq: str, most: int = 40, chars: int = 400, keys: int = 8) -> DataFrame:
    """The first ``most`` documents with errors: texts clipped, lists of paths cut."""
    wrong = scores.filter(~F.col("document_correct")).orderBy(seq).limit(most)
    return wrong.select(seq, S.clip("gt", chars).alias("gt"), S.clip("pred", chars).alias("pred"), F.slice("missing_paths", 1, keys).alias("missing_paths"), F.slice("extra_paths", 1, keys).alias("extra_paths"))


def write_error_cases(cases: DataFrame, path: str, seq: str) -> None:
    """The report of ``error_cases`` (a bounded number of rows) as one text file."""
    blocks = [f"[{r[seq]}]\ngt: {r['gt']}\npred: {r['pred']}\nmissing: {', '.join(r['missing_paths'])}\nextra: {', '.join(r['extra_paths'])}\n" for r in cases.orderBy(seq).collect()]
    write_text(cases.sparkSession, path, "\n".join(blocks))


def write_csv(rows: DataFrame, path: str, columns: tuple[str, ...] = ("section", "row", "field", "value")) -> None:
    """Rows as CSV files with a header; each file begins with a byte-order mark, for spreadsheets."""
    name = "\ufeff" + columns[0]
    rows.select(F.col(columns[0]).cast("string").alias(name), *(F.col(c).cast("string") for c in columns[1:])).write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)


#: Partition columns of a log, which its rows can't have.
VERSION, BUCKET = "log_version", "log_bucket"
#: Buckets of a log's keys; a batch reads those that its own keys fall into.
LOG_BUCKETS = 64


def _versions(spark: SparkSession, path: str) -> list[int]:
    at, fs = _fs(spark, f"{path}/{VERSION}=*")
    return sorted(int(f.getPath().getName().split("=")[1]) for f in fs.globStatus(at) or [])


def read_log(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """The rows of all committed batches of a log. Without ``schema`` there must be a row in it."""
    return (spark.read.schema(_logged(schema)) if schema else spark.read).parquet(path).drop(VERSION, BUCKET)


def _logged(schema: T.StructType) -> T.StructType:
    return T.StructType([*(f for f in schema.fields if f.name not in (VERSION, BUCKET)), T.StructField(VERSION, T.IntegerType()), T.StructField(BUCKET, T.IntegerType())])


def _commit(spark: SparkSession, staged: str, final: str) -> bool:
    """Renames a folder in one step; False if another writer has taken the name."""
    jvm = spark.sparkContext._jvm
    src, conf = jvm.org.apache.hadoop.fs.Path(staged), spark.sparkContext._jsc.hadoopConfiguration()
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(src.getFileSystem(conf).getUri(), conf)
    never_over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        files.rename(src, jvm.org.apache.hadoop.fs.Path(final), never_over)
    except Exception:
        if _fs(spark, final)[1].exists(_fs(spark, final)[0]):
            return False
        raise
    return True


def append_new(rows: DataFrame, path: str, key: list[str], batch: str | None = None, tries: int = 20) -> bool:
    """Commits the rows whose key the log doesn't hold as its next version; False if the batch was committed before.

    A batch is written aside and becomes visible by one rename to the next version's name, which fails if another writer was
    faster; then the rows are compared with what that one wrote, and written anew. Rows lie in buckets by key, so a batch reads
    the keys of its own buckets only. What a broken writer left aside is never read."""
    spark = rows.sparkSession
    if clash := {VERSION, BUCKET} & {c.lower() for c in rows.columns}:
        raise ValueError(f"columns of the log itself: {sorted(clash)}")
    bucketed = rows.dropDuplicates(key).withColumn(BUCKET, F.pmod(F.xxhash64(*key), F.lit(LOG_BUCKETS)).cast("int"))
    for _ in range(tries):
        done = _versions(spark, path)
        at, fs = _fs(spark, f"{path}/{VERSION}=*/_batch-{batch}")
        if batch is not None and fs.globStatus(at):
            return False
        fresh = bucketed
        if done:
            mine = [r[0] for r in bucketed.select(BUCKET).distinct().collect()]  # LOG_BUCKETS at most
            fresh = bucketed.join(spark.read.schema(_logged(rows.schema)).parquet(path).filter(F.col(BUCKET).isin(mine) & (F.col(VERSION) <= done[-1])).select(*key), key, "left_anti")
        staged = f"{path}/_staged-{uuid.uuid4().hex}"
        fresh.write.partitionBy(BUCKET).parquet(staged)
        write_text(spark, f"{staged}/_batch-{batch}", "")
        if _commit(spark, staged, f"{path}/{VERSION}={(done[-1] if done else 0) + 1:09d}"):
            return True
    raise OSError(f"{path}: other writers were faster {tries} times")


def write_pairs(pairs: DataFrame, processed: DataFrame, out: str, journal: str, key: list[str], batch: str | None = None) -> None:
    """Emitted pairs, then the journal of all processed keys, those without a pair too. Each is one commit; a batch that broke off in
    between and comes again finds its pairs committed and writes the journal alone."""
    append_new(pairs, out, key, batch)
    append_new(processed.select(*key), journal, key, batch)


def retire(spark: SparkSession, path: str) -> str | None:
    """Renames a stale output to the first free name .bak, .bak2, ...; nothing is deleted. None if there is nothing."""
    at, fs = _fs(spark, path)
    if not fs.exists(at):
        return None
    n = 1
    while fs.exists(_fs(spark, new := f"{path}.bak{n if n > 1 else ''}")[0]):
        n += 1
    if not fs.rename(at, _fs(spark, new)[0]):
        raise OSError(f"{path} can't be renamed")
    return new


def record_ids(rows: DataFrame, at: Column, content: Column) -> DataFrame:
    """``rows`` with record_id: time, eight digits of the content's digest, and a counter where both are the same."""
    base = F.concat(F.date_format(at, "yyyyMMdd-HHmmss"), F.lit("-"), F.substring(F.sha2(content, 256), 1, 8))
    tied = F.row_number().over(Window.partitionBy("_base").orderBy(*[F.col(c) for c in rows.columns]))
    return rows.withColumn("_base", base).withColumn("_n", tied).withColumn("record_id", F.when(F.col("_n") == 1, F.col("_base")).otherwise(F.concat("_base", F.lit("-"), F.col("_n").cast("string")))).drop("_base", "_n")
