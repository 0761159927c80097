"""Tables in the folder that driver and executors share, and numbers of rows over all tasks."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or outside a cluster a temporary one."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        # One process, so there is nothing to share with; local-cluster has several.
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


_SCOPES: list[list[DataFrame]] = []


def written(df: DataFrame, name: str, keep: bool = False, compression: str = "snappy") -> DataFrame:
    """Write a table into the shared folder and read it again: cuts the lineage, and survives the loss of any executor.

    drop_written() deletes it; inside scratch() that happens at the end of the scope, unless keep is set.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    if _SCOPES and not keep:
        _SCOPES[-1].append(out)
    return out


def drop_written(df: DataFrame) -> None:
    """Delete a table made by written() that nothing will read again; once more is harmless."""
    path = getattr(df, "_written_path", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch() -> Iterator[None]:
    """A scope at whose end the tables written inside are deleted. What it gives to the outside must be written with keep."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for df in _SCOPES.pop():
            drop_written(df)


#: Bits for each id among those that tell rows apart, bits in all, and bits of a page of them.
ID_BITS, MOST_BITS, PAGE_BITS = 32, 1 << 28, 32768


def parted(rows: DataFrame, key: str, ids: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(rows whose key may be among the ids, rows whose key isn't), so that only the first need a join that moves them. ids: about n rows with a column of the key's name and type.

    The ids' hashed places are marked in bitmaps, which every task gets: 4 bytes for each id and 32 MB at most. About 1 of 32 rows whose key isn't among the ids is with the first, and more beyond 8 million ids.
    """
    bits = -(-max(1, min(MOST_BITS, n * ID_BITS)) // PAGE_BITS) * PAGE_BITS
    place = F.pmod(F.xxhash64(key), F.lit(bits))
    page = F.floor(place / PAGE_BITS).cast("int")
    marks = ids.select(page.alias("_page"), (place % PAGE_BITS).alias("_at")).groupBy("_page").agg(F.bitmap_construct_agg("_at").alias("_marks"))
    marks = F.broadcast(written(marks, "marks", keep=True))
    own = rows.withColumn("_page", page).withColumn("_at", (place % PAGE_BITS).cast("int")).join(marks, "_page", "left")
    byte = F.conv(F.hex(F.expr("substring(_marks, _at div 8 + 1, 1)")), 16, 10).cast("int")
    own = own.withColumn("_may", F.coalesce(byte.bitwiseAND(F.expr("shiftleft(1, _at % 8)")) != 0, F.lit(False)) & F.col(key).isNotNull())
    return own.where("_may").select(*rows.columns), own.where("not _may").select(*rows.columns)


#: monotonically_increasing_id() has a task's number above this bit and the row's below.
_ROW_BITS = 33


def numbered(df: DataFrame, *order: Column, name: str = "n") -> DataFrame:
    """The rows with a number from 0 in the order given, as long, without one task for all of them.

    The rows are dealt out by ranges of the order (equal rows too, by a number of their own), sorted within each task and written with
    their place there; each task's first number is the running sum of the tasks' counts, of which there are as many as tasks. Numbers of rows that
    are equal in the order are arbitrary but fixed once written.
    """
    tie = F.monotonically_increasing_id()
    placed = df.withColumn("_tie", tie).repartitionByRange(*order, F.col("_tie")).sortWithinPartitions(*order, F.col("_tie")).drop("_tie").withColumn("_at", F.monotonically_increasing_id())
    placed = written(placed, "numbered", keep=True)
    task = F.shiftright("_at", _ROW_BITS)
    first, runs = 0, []
    for r in placed.groupBy(task.alias("t")).count().orderBy("t").collect():
        runs.append((r["t"], first))
        first += r["count"]
    starts = df.sparkSession.createDataFrame(runs, "_task long, _first long")
    # One row for each task.
    return placed.withColumn("_task", task).join(F.broadcast(starts), "_task").withColumn(name, F.col("_first") + F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))).select(*df.columns, name)
