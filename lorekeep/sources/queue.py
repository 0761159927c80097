"""Session queues: append-only folders of JSON lines, one for each session.

Every append makes a new file, because a stream never reads a file again that it has listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas

#: Unprocessed rows that set off a curate in mid-session, and rows of a batch at a session's end.
TRIGGER, BATCH = 3, 20


def append(entries: DataFrame, path: str) -> None:
    """Add entries to the queues of their sessions (column session_id)."""
    entries.write.mode("append").partitionBy("session_id").json(path)


def read(spark: SparkSession, path: str, session_id: str | None = None) -> DataFrame:
    """All entries with their session_id; none if there is no queue. A broken line raises."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], f"{schemas.QUEUE}, session_id string")
    got = spark.read.schema(f"{schemas.QUEUE}, session_id string").json(path, mode="FAILFAST")
    return got if session_id is None else got.where(F.col("session_id") == session_id)


def unprocessed(entries: DataFrame) -> DataFrame:
    return entries.where(~F.coalesce("processed", F.lit(False)))


def marked(entries: DataFrame, timestamps: DataFrame) -> DataFrame:
    """With the entries of these timestamps marked as processed."""
    hit = timestamps.select("timestamp").distinct().withColumn("_hit", F.lit(True))
    return entries.join(hit, "timestamp", "left").withColumn("processed", F.coalesce("_hit", "processed")).select(*entries.columns)


def cleanup(spark: SparkSession, path: str, session_id: str) -> None:
    """Delete a session's queue."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/session_id={session_id}")
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def batches(entries: DataFrame, by: str = "session_id", order: Column | str = "timestamp", size: int = BATCH) -> DataFrame:
    """Entries with their place in the session's queue and the batch they fall into."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(order))
    return entries.withColumn("place", place).withColumn("batch", F.floor((F.col("place") - 1) / size).cast("long"))
