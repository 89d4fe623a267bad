"""What several operators need of the session."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Only used where the session names no folder, as in tests.
LOCAL_CHECKPOINTS = "/tmp/checkpoints"
#: The session's setting by which a query removes its shuffle files when it ends.
REMOVE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries planned inside remove their shuffle files at their end. What is read after that is a written table; an executor lost
    before it costs a retry of the stage, as ever."""
    before = spark.conf.get(REMOVE_SHUFFLES, "false")
    spark.conf.set(REMOVE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(REMOVE_SHUFFLES, before)


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that the session names, or else one of this machine; on a cluster, whose executors don't share that, an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or LOCAL_CHECKPOINTS)
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the folder that the cluster shares (spark.checkpoint.dir): it outlives lost executors.

    The shuffles that it took are removed, so that a job of many steps holds the disk of one."""
    checkpoint_folder(df.sparkSession)
    with shuffles_removed(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def with_fields(df: DataFrame, **types: str) -> StructType:
    """The schema of ``df`` and further fields."""
    more = StructType.fromDDL(", ".join(f"{k} {v}" for k, v in types.items()))
    return StructType([*(StructField(f.name, f.dataType) for f in df.schema.fields), *more.fields])


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def bounded(df: DataFrame, most: int = 400_000) -> DataFrame:
    """``df``, computed once, with a hint to broadcast it if it has at most ``most`` rows; beyond that the join shuffles."""
    df = checkpointed(df)
    return F.broadcast(df) if df.count() <= most else df


def text_bytes(df: DataFrame, text_col: str) -> int:
    """Bytes of text in the table: one aggregate over the scan, to size partitions by."""
    return int(df.agg(F.sum(F.octet_length(F.col(text_col)).cast("long"))).first()[0] or 0)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet under the shared checkpoint folder and read again."""
    path = f"{checkpoint_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    with shuffles_removed(df.sparkSession):
        df.select("*").write.parquet(path)
    return df.sparkSession.read.parquet(path)
