"""The session queue as a stream: detect, buffer per session, hand over when enough has gathered."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import schemas
from ..config import DEFAULTS
from ..operators.detect import detect
from ..ship import ship
from ..sources.queue import BATCH, TRIGGER

#: pattern_type of a row that ends its session and flushes what is left.
END = "session_end"
_FLAT = "timestamp string, tool_name string, pattern_type string, summary string, file string, language string, error_message string, command string"


def event_stream(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    """Tool events from JSON files; files bounds those of a micro-batch."""
    return spark.readStream.schema(f"{schemas.EVENTS}, timestamp string").option("maxFilesPerTrigger", files).json(path)


def to_queue(events: DataFrame) -> DataFrame:
    """Queue entries of a stream, or table, of tool events."""
    return detect(events).select("timestamp", "tool_name", "pattern_type", "summary", "context", F.lit(False).alias("processed"), "session_id")


def entry_stream(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    """Queue entries from the folder that sources.queue.append() writes."""
    return spark.readStream.schema(f"{schemas.QUEUE}, session_id string").option("maxFilesPerTrigger", files).json(path)


def sessions(events: DataFrame, gap: str = f"{DEFAULTS['sessions']['idle_minutes']} minutes", by: str = "session_id", at: str = "timestamp") -> DataFrame:
    """Runs of a key's events without a pause of `gap`: by, started, ended and n. The same for a table and, behind a watermark on `at`, for a stream."""
    found = events.groupBy(by, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n"), F.max(at).alias("ended"))
    return found.select(by, F.col("w.start").alias("started"), "ended", "n")


def _milliseconds(period: str) -> int:
    """A number of seconds, minutes, hours or days as milliseconds."""
    n, unit = period.split()
    return int(n) * {"second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}[unit.rstrip("s")]


def gathered(entries: DataFrame, trigger: int = TRIGGER, size: int = BATCH, idle: str | None = None, late: str = "0 seconds") -> DataFrame:
    """Entries in the batches in which a session hands them over, with session_id and batch_id.

    A session's entries wait until `trigger` of them are there, or its end row comes, or, with `idle`, the stream's time is that much
    beyond its newest entry; late: how much out of order entries may come. State holds fewer than `trigger`
    entries for each session, and with `idle` nothing of a session that went idle. batch_id is made of the session and a running number, or with `idle` of its first entry's time, so that a replay gives the same ids.
    Entries whose time can't be parsed hand over with the others of their session but set no timer.
    """
    ship(entries.sparkSession)
    names = [c.split(" ")[0] for c in _FLAT.split(", ")]
    wait = _milliseconds(idle) if idle else 0

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, newest, held = state.get if state.exists else (0, 0, [])
        held = [tuple(x) for x in held]
        ended = idle is not None and state.hasTimedOut
        for f in () if ended else frames:
            f = f.sort_values("timestamp", kind="stable")
            ended = ended or bool((f.pattern_type == END).any())
            held += [tuple(x) for x in f[f.pattern_type != END][names].itertuples(index=False, name=None)]
            if idle:
                newest = max([newest, *(int(x) for x in f["at_ms"].dropna())])
        out = []
        if len(held) >= trigger or ended and held:
            for i in range(0, len(held), size):
                name = f"{key[0]}-{held[i][0]}-{i // size}" if idle else f"{key[0]}-{done}"
                out += [(key[0], name, *x) for x in held[i : i + size]]
                done += 1
            held = []
        if ended or idle and not held:
            if state.exists:
                state.remove()
        else:
            state.update((done, newest, held))
            if idle:
                state.setTimeoutTimestamp(max(newest + wait, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["session_id", "batch_id", *names])

    flat = entries.select("session_id", "timestamp", "tool_name", "pattern_type", "summary", "context.*")
    if idle:
        at = F.try_to_timestamp("timestamp")
        flat = flat.withColumn("at", at).withColumn("at_ms", F.unix_millis("at")).withWatermark("at", late)
    item = "struct<" + ",".join(c.replace(" ", ":") for c in _FLAT.split(", ")) + ">"
    timer = GroupStateTimeout.EventTimeTimeout if idle else GroupStateTimeout.NoTimeout
    out = flat.groupBy("session_id").applyInPandasWithState(step, f"session_id string, batch_id string, {_FLAT}", f"done int, newest long, held array<{item}>", "append", timer)
    return out.select("session_id", "batch_id", "timestamp", "tool_name", "pattern_type", "summary", F.struct("file", "language", "error_message", "command").alias("context"))


def run_curate(batches: DataFrame, curate: Callable[[DataFrame, int], None], checkpoint: str, failed: Callable[[DataFrame, int, Exception], None] | None = None) -> StreamingQuery:
    """Hand every micro-batch to curate(entries, number). A batch that fails is tried again after a restart, or with `failed` is handed to that and passed over, and the rest goes on.

    A stream that is stopped between a batch's commit and its checkpoint hands the batch over once more. Engine.curate(stream=...) then knows it by its number, which it
    commits together with what the batch changed; other sinks see stable ids, so a replay changes nothing twice.
    """

    def each(entries: DataFrame, number: int) -> None:
        try:
            curate(entries, number)
        except Exception as e:
            if failed is None:
                raise
            failed(entries, number, e)

    return batches.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
