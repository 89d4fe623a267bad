"""Resumable logs as streams: the checkpoint remembers which files were read, the state what was seen, the sink what was committed."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sinks import append_new, read_log


def _committed(out: str, key: list[str]):
    """A batch as one commit of the log, named by the stream's own id and the batch's number, so that it counts once however often it is run."""

    def write(batch: DataFrame, number: int) -> None:
        stream = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        append_new(batch, out, key, f"{stream}-{number}")

    return write


def resume_predictions(spark: SparkSession, folder: str, schema: str, out: str, checkpoint: str, key: list[str]) -> StreamingQuery:
    """Appends new prediction files (JSON lines) to ``out`` once per key and stops when all files there are read; call it
    again for those that came since. A batch that is run twice after a failure writes nothing twice."""
    rows = spark.readStream.schema(schema).json(folder)
    return rows.writeStream.foreachBatch(_committed(out, key)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _keep_last(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """State of an image: its last answer, that answer's place, and how many answers it had. Blank answers leave it as it is."""
    pred, seq, answers = state.get if state.exists else (None, None, 0)
    changed = False
    for batch in batches:
        given = batch[batch["pred"].fillna("").str.strip() != ""]
        if len(given):
            last = given.loc[given["seq"].idxmax()]
            changed, answers = True, answers + len(given)
            if seq is None or last["seq"] > seq:
                pred, seq = last["pred"], int(last["seq"])
    if changed:
        state.update((pred, seq, answers))
        yield pd.DataFrame({"image": [key[0]], "pred": [pred], "seq": [seq], "answers": [answers]})


def latest_answers(spark: SparkSession, folder: str, schema: str, out: str, checkpoint: str, files: int = 1000) -> StreamingQuery:
    """Keeps the last answer of each image (columns image, pred, seq of ``schema``) as files arrive, in any order, and commits to the log ``out``
    a row for each image that a batch changed. Stops when all files there are read; call it again for those that came
    since: state and log go on from the checkpoint. ``files``: files of a batch."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(folder).select("image", "pred", "seq")
    kept = rows.groupBy("image").applyInPandasWithState(_keep_last, "image string, pred string, seq long, answers long", "pred string, seq long, answers long", "update", GroupStateTimeout.NoTimeout)
    return kept.writeStream.foreachBatch(_committed(out, ["image", "answers"])).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_latest(spark: SparkSession, out: str) -> DataFrame:
    """image, pred, seq, answers: the newest row of each image in the log of ``latest_answers``."""
    newest = F.max_by(F.struct("pred", "seq"), "answers")
    return read_log(spark, out).groupBy("image").agg(newest.alias("_n"), F.max("answers").alias("answers")).select("image", "_n.*", "answers")


def events_by_window(events: DataFrame, time: str, by: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts by tumbling window; events later than ``late`` after the newest are dropped when streamed. Batches count all."""
    marked = events.withWatermark(time, late) if events.isStreaming else events
    return marked.groupBy(F.window(time, width).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def closed_windows(spark: SparkSession, folder: str, schema: str, out: str, checkpoint: str, time: str, by: str, width: str = "1 day", late: str = "1 hour", files: int = 1000) -> StreamingQuery:
    """``events_by_window`` over files of JSON lines as they arrive: a window is committed to the log ``out`` once the newest event is ``late``
    past its end, and never changes after that."""
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(folder)
    counts = events_by_window(events, time, by, width, late)
    return counts.writeStream.foreachBatch(_committed(out, ["start", by])).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
