"""Sources: manifests, prediction caches, annotation files, listings and digests, read by Spark from any file system."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of a known schema. Blank lines are skipped, a malformed line raises an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with seq, their order: by file, then by place in it.

    Spark's text source gives no line numbers, and a file's blocks are read in order, so the order is fixed once, here."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"), "value")
    return lines.select("file", F.struct("file", "_block", "_at").alias("seq"), "value")


def read_cache(spark: SparkSession, path: str, schema: str, key: str = "image", need_text: str | None = None) -> tuple[DataFrame, DataFrame, bool]:
    """A resumable cache of JSON lines: its rows, its meta rows as texts, and whether it can be used.

    Rows with a true ``_meta`` are no data. Of rows with one key the last counts. One corrupt line makes the whole cache
    unusable (no rows then). ``need_text``: a column that must not be blank for a row to be admitted; a blank one doesn't take the
    place of an earlier row."""
    lines = numbered_lines(spark, path).filter(F.trim("value") != "")
    read = lines.withColumn("_r", F.from_json("value", f"{schema}, _meta boolean, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}))
    usable = read.filter(F.col("_r._corrupt").isNotNull() | F.col("_r").isNull()).isEmpty()
    meta = read.filter("_r._meta").select("value")
    rows = read.filter(F.coalesce(~F.col("_r._meta"), F.lit(True)) & F.lit(usable)).select("seq", "_r.*").drop("_meta", "_corrupt")
    if need_text:
        rows = rows.filter(F.trim(need_text) != "")
    last = rows.groupBy(key).agg(*(F.max_by(c, "seq").alias(c) for c in rows.columns if c not in (key, "seq")))
    return last, meta, usable


def stale_keys(meta: DataFrame, fingerprint: Mapping[str, str], unless: Mapping[str, str] | None = None) -> list[str]:
    """Keys of the run's fingerprint that any meta row of the cache has with another value, or not at all; without meta rows none.

    ``unless``: keys that a meta row may lack if it has another one instead, which can't be compared."""
    value = lambda k: F.get_json_object("value", f"$.{k}")
    lacks = lambda k: value(k).isNull() & value(unless[k]).isNotNull() if unless and k in unless else F.lit(False)
    names = sorted(fingerprint)
    found = meta.agg(*(F.count_if(~value(k).eqNullSafe(F.lit(fingerprint[k])) & ~lacks(k)).alias(f"_{i}") for i, k in enumerate(names))).first() if names else ()
    return [k for k, n in zip(names, found, strict=True) if n]


def fresh_cache(spark: SparkSession, path: str, schema: str, fingerprint: Mapping[str, str], key: str = "image", need_text: str | None = None) -> tuple[DataFrame | None, str | None]:
    """The rows of a cache that a run of this fingerprint may go on from, and where the cache was put aside if it may not.

    A cache with a corrupt line or with meta rows of other settings is renamed, never deleted, and the run begins anew (no rows)."""
    from ..sinks import retire

    if not exists(spark, path):
        return None, None
    rows, meta, usable = read_cache(spark, path, schema, key, need_text)
    if usable and not stale_keys(meta, fingerprint):
        return rows, None
    return None, retire(spark, path)


def read_pairs(spark: SparkSession, path: str, payload: str, known: DataFrame | None = None) -> DataFrame:
    """Lines of a name, a tab and JSON of type ``payload``: seq, name, payload. Lines without a tab, bad JSON and names that
    ``known`` (column name) doesn't hold are skipped. Quotes are left alone, unlike in a CSV reader."""
    lines = numbered_lines(spark, path).withColumn("_s", F.split("value", "\t", 2)).filter(F.size("_s") == 2)
    read = lines.select("seq", F.trim(F.col("_s")[0]).alias("name"), F.from_json(F.col("_s")[1], payload).alias("payload"), F.try_parse_json(F.col("_s")[1]).isNotNull().alias("_ok")).filter("name <> '' AND payload IS NOT NULL AND _ok").drop("_ok")
    return read.join(known.select("name").distinct(), "name", "left_semi").select("seq", "name", "payload") if known is not None else read


def read_document(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One JSON value a file, over any number of lines."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def listing(spark: SparkSession, path: str, pattern: str = "*", newest_name_first: bool = False) -> DataFrame:
    """Files under a folder whose name fits: path, name, length, in the order of their names."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "length")
    return found.orderBy(F.desc("name") if newest_name_first else F.asc("name"))


def digests(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """name, length and SHA-256 of each file's bytes."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return found.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "length", F.sha2("content", 256).alias("sha256"))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path, or any file of a glob, is there, asked of the path's own file system."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
    return found is not None and len(found) > 0


def union_levels(spark: SparkSession, paths: Mapping[str, str], schema: str) -> tuple[DataFrame, list[str]]:
    """Manifests of several levels in one table with their level; levels whose file is missing are left out and named."""
    missing = [level for level, path in paths.items() if not exists(spark, path)]
    parts = [read_manifest(spark, path, schema).withColumn("level", F.lit(level)) for level, path in paths.items() if level not in missing]
    if not parts:
        raise FileNotFoundError(f"none of {sorted(paths.values())}")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out, missing


def with_files(rows: DataFrame, files: DataFrame, path_col: str) -> DataFrame:
    """Rows whose file (by name) is in a listing."""
    name = F.regexp_extract(F.col(path_col), r"([^/\\]+)$", 1)
    return rows.withColumn("_name", name).join(files.select(F.col("name").alias("_name")).distinct(), "_name", "left_semi").drop("_name")


def first_rows(rows: DataFrame, seq: str | Column, n: int) -> DataFrame:
    """The first n rows in an order that the rows carry."""
    return rows.orderBy(seq).limit(n)
