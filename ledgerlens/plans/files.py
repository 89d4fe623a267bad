"""Queries through files: tables written by the sinks and read back by the sources, against the tables themselves."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from .. import sinks, sources, streaming
from . import derived as V
from .catalogue import query


def scratch(spark) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share; a temporary one only in local mode."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if top is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = tempfile.mkdtemp(prefix="spark-")
    return f"{top}/files-{uuid.uuid4().hex}"


@query("SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE '项目 ' || o_orderkey END AS pred, o_totalprice AS total FROM orders")
def jsonl_round_trip(spark, sf):
    at = scratch(spark)
    k = F.col("o_orderkey")
    sinks.write_predictions(V.table(spark, sf, "orders").select(k.alias("doc_id"), F.when(k % 5 != 0, F.concat(F.lit("项目 "), k)).alias("pred"), F.col("o_totalprice").alias("total")), at)
    return sources.read_manifest(spark, at, "doc_id long, pred string, total double")


@query("SELECT 'user-' || user_id AS image, count(*) AS n, arg_max(event_type, event_id) FILTER (event_type <> 'view') AS pred FROM events GROUP BY 1 HAVING count(*) FILTER (event_type <> 'view') > 0")
def prediction_cache_last_wins(spark, sf):
    """A cache whose later lines overwrite earlier ones; blank answers aren't admitted and overwrite nothing."""
    at = scratch(spark)
    e = V.table(spark, sf, "events").select(F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("image"), F.when(F.col("event_type") == "view", " ").otherwise(F.col("event_type")).alias("pred"), "event_id")
    meta = spark.createDataFrame([(True, "m")], "_meta boolean, data string").select(F.to_json(F.struct("_meta", "data")).alias("value"))
    meta.write.mode("append").text(f"{at}/a")
    # files in the order of events, as a log that is cut now and then
    e.repartitionByRange("event_id").sortWithinPartitions("event_id").select(F.to_json(F.struct("image", "pred")).alias("value")).write.mode("append").text(f"{at}/b")
    rows, _, usable = sources.read_cache(spark, f"{at}/*", "image string, pred string, data string", need_text="pred")
    if not usable:
        raise ValueError("a corrupt line")
    n = e.groupBy("image").agg(F.count("*").alias("n"))
    return rows.join(n, "image").select("image", "n", "pred")


@query("SELECT 'r' || l_orderkey || '.jpg' AS name, CAST(sum(l_linenumber) AS BIGINT) AS labels, string_agg('x\"' || l_linenumber, '|' ORDER BY l_linenumber, l_partkey, l_suppkey) AS texts FROM lineitem WHERE l_orderkey % 7 <> 0 GROUP BY l_orderkey")
def annotation_pairs(spark, sf):
    """Name, tab, JSON: lines without a tab and broken JSON are skipped, quotes stay."""
    at = scratch(spark)
    boxes = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))), lambda b: F.struct(b.l_linenumber.alias("label"), F.concat(F.lit('x"'), b.l_linenumber.cast("string")).alias("transcription")))
    docs = V.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(boxes.alias("boxes"))
    k = F.col("l_orderkey")
    name = F.concat(F.lit("r"), k.cast("string"), F.lit(".jpg"))
    docs.select(F.when(k % 14 == 0, F.concat(name, F.lit("\t[{broken"))).when(k % 7 == 0, name).otherwise(F.concat(name, F.lit("\t"), F.to_json("boxes"))).alias("value")).write.text(at)
    read = sources.read_pairs(spark, at, "array<struct<label:long,transcription:string>>")
    return read.select("name", F.aggregate("payload", F.lit(0).cast("long"), lambda a, b: a + b.label).alias("labels"), F.array_join(F.transform("payload", lambda b: b.transcription), "|").alias("texts"))


@query("SELECT level, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM (SELECT CASE o_orderkey % 3 WHEN 0 THEN 'clean' WHEN 1 THEN 'medium' END AS level, o_orderkey AS doc_id FROM orders WHERE o_orderkey % 3 < 2) GROUP BY 1")
def union_of_levels(spark, sf):
    """Three manifests of which one is missing."""
    at = scratch(spark)
    o = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"))
    for i, level in enumerate(("clean", "medium")):
        sinks.write_predictions(o.filter(F.col("doc_id") % 3 == i), f"{at}/{level}")
    rows, missing = sources.union_levels(spark, {x: f"{at}/{x}" for x in ("clean", "medium", "heavy")}, "doc_id long")
    if missing != ["heavy"]:
        raise ValueError(f"missing: {missing}")
    return rows.groupBy("level").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


@query("SELECT o_orderkey AS doc_id FROM orders ORDER BY o_orderkey LIMIT 25")
def limit_by_order(spark, sf):
    return sources.first_rows(V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id")), "doc_id", 25)


@query("SELECT r_name AS name, r_name || '.txt' AS file, octet_length(encode(r_name || '!')) AS length, sha256(r_name || '!') AS sha256 FROM region WHERE r_regionkey <> 2")
def file_digests(spark, sf):
    """Files with their length and digest; rows without a file drop out."""
    at = scratch(spark)
    regions = V.table(spark, sf, "region").select(F.col("r_name").alias("name"), "r_regionkey")
    for r in regions.filter("r_regionkey <> 2").collect():  # five regions
        sinks.write_text(spark, f"{at}/{r['name']}.txt", f"{r['name']}!")
    named = regions.select("name", F.concat(F.lit("images/"), "name", F.lit(".txt")).alias("file"))
    there = sources.with_files(named, sources.listing(spark, at, "*.txt"), "file")
    found = sources.digests(spark, at, "*.txt").select(F.col("name").alias("file"), "length", "sha256")
    return there.select("name", F.regexp_extract("file", r"([^/]+)$", 1).alias("file")).join(found, "file").select("name", "file", "length", "sha256")


@query("SELECT count(*) AS n, CAST(sum(tp) AS BIGINT) AS tp FROM s".join((V.BASE, "")))
def summary_round_trip(spark, sf):
    at = scratch(spark)
    from .catalogue import _scores

    sinks.write_summary(_scores(spark, sf).agg(F.count("*").alias("n"), F.sum("tp").cast("long").alias("tp")), f"{at}/summary.json")
    return sources.read_document(spark, f"{at}/summary.json", "n long, tp long")


@query("SELECT 'rows' AS section, CAST(l_linenumber AS VARCHAR) AS row, 'qty, \"net\"' AS field, CAST(count(*) AS VARCHAR) AS value FROM lineitem GROUP BY l_linenumber")
def csv_round_trip(spark, sf):
    at = scratch(spark)
    rows = V.table(spark, sf, "lineitem").groupBy("l_linenumber").agg(F.count("*").alias("value")).select(F.lit("rows").alias("section"), F.col("l_linenumber").alias("row"), F.lit('qty, "net"').alias("field"), "value")
    sinks.write_csv(rows, at)
    return spark.read.option("header", True).option("escape", '"').csv(at).toDF("section", "row", "field", "value")


@query("SELECT user_id, min(event_id) AS event_id FROM events WHERE event_id % 3 < 2 GROUP BY 1")
def append_log_once(spark, sf):
    """Two batches of which the second repeats half of the first: each user is logged once, in the first batch that has them."""
    at = scratch(spark)
    e = V.table(spark, sf, "events").filter("event_id % 3 < 2").groupBy("user_id").agg(F.min("event_id").alias("event_id"))
    half = e.filter("user_id % 2 = 0")
    for _ in range(2):  # the second time the batch is known
        sinks.append_new(half, at, ["user_id"], "first")
    sinks.append_new(e.withColumn("event_id", F.when(F.col("user_id") % 2 == 0, F.lit(-1)).otherwise(F.col("event_id"))), at, ["user_id"])
    return sinks.read_log(spark, at)


@query("SELECT count(*) FILTER (hi - lo >= 40) AS emitted, count(*) AS processed, count(*) FILTER (k % 2 = 1) AS left_over FROM (SELECT user_id AS k, max(value) AS hi, min(value) AS lo FROM events GROUP BY 1)")
def pair_journal(spark, sf):
    """Pairs go to one table, all processed keys to another; what is left is told by the second."""
    at = scratch(spark)
    users = V.table(spark, sf, "events").groupBy("user_id").agg((F.max("value") - F.min("value")).alias("gap"))
    for part in (0, 1, 0):
        mine = users.filter(F.col("user_id") % 2 == part)
        left = users.filter(F.col("user_id") % 2 == 1).count() if part == 0 else left  # noqa: F821
        sinks.write_pairs(mine.filter("gap >= 40"), mine, f"{at}/pairs", f"{at}/journal", ["user_id"])
    emitted = sinks.read_log(spark, f"{at}/pairs").agg(F.count("*").alias("emitted"))
    return emitted.join(sinks.read_log(spark, f"{at}/journal").agg(F.count("*").alias("processed"))).withColumn("left_over", F.lit(left).cast("long"))


@query("SELECT strftime(ts, '%Y%m%d-%H%M%S') || '-' || substr(sha256(event_type), 1, 8) || CASE WHEN k > 1 THEN '-' || k ELSE '' END AS record_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY strftime(ts, '%Y%m%d-%H%M%S'), event_type ORDER BY event_id) AS k FROM events)")
def record_identifiers(spark, sf):
    e = V.table(spark, sf, "events").select("event_id", "ts", "event_type")
    return sinks.record_ids(e, F.col("ts"), F.col("event_type")).select("record_id", "event_id")


@query("SELECT 'user-' || user_id AS image, arg_max(event_type, event_id) FILTER (event_type <> 'view') AS pred, count(*) FILTER (event_type <> 'view') AS answers FROM events GROUP BY 1 HAVING count(*) FILTER (event_type <> 'view') > 0")
def streamed_latest_answers(spark, sf):
    """The last answer of each image, kept as state while files of answers arrive in batches; blank answers don't count."""
    at = scratch(spark)
    e = V.table(spark, sf, "events").select(F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("image"), F.when(F.col("event_type") == "view", " ").otherwise(F.col("event_type")).alias("pred"), F.col("event_id").alias("seq"))
    e.repartition(6, "image", "seq").write.json(f"{at}/in")
    streaming.latest_answers(spark, f"{at}/in", "image string, pred string, seq long", f"{at}/out", f"{at}/state", files=2).awaitTermination()
    return streaming.read_latest(spark, f"{at}/out").select("image", "pred", "answers")
