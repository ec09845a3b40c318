"""The job event log as a stream: current state, live frames, and expiry by event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from repovigil.operators import jobs

HOUR_MS = 60 * 60 * 1000


def state_stream(events: DataFrame) -> DataFrame:
    """The batch fold as a streaming aggregation; needs no order of arrival and no Python."""
    return events.groupBy("job_id").agg(*jobs.state_aggregates(), *jobs.time_aggregates())


def write_state(states: DataFrame, folder: str, checkpoint: str):
    """Append every changed job state with its batch number; a repeated batch rewrites itself."""
    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return (
        states.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(save)
        .trigger(availableNow=True)
        .start()
    )


def read_state(spark: SparkSession, folder: str) -> DataFrame:
    """The last written state of each job."""
    rows = spark.read.parquet(folder)
    columns = [c for c in rows.columns if c not in ("job_id", "batch")]
    newest = rows.groupBy("job_id").agg(F.max_by(F.struct(*columns), "batch").alias("last"))
    return jobs._flat(newest.select("job_id", "last.*"))


def frames_of(events: DataFrame) -> DataFrame:
    """``(job_id, seq, ts, type, frame)``: each event as a ``data:`` frame."""
    at = jobs._epoch_ms(F.col("ts"), dict(events.dtypes)["ts"] == "timestamp")
    data = (
        F.when(F.col("type").isin("status", "error"), F.to_json(F.struct("status", "error")))
        .when(F.col("type") == "progress", F.to_json(F.struct(F.col("progress").alias("current"), "total", "stage")))
        .when(F.col("type") == "log", F.to_json(F.struct(at.alias("timestamp"), "message", "level")))
        .otherwise(F.col("result"))
    )
    head = F.concat(F.lit('data: {"type":"'), F.col("type"), F.lit('","timestamp":'), at.cast("string"), F.lit(',"data":'))
    return events.select("job_id", "seq", "ts", "type", F.concat(head, data, F.lit("}\n\n")).alias("frame"))


def write_frames(events: DataFrame, folder: str, checkpoint: str):
    """The live tail as frames, in append mode."""
    return (
        frames_of(events).select("job_id", "seq", "frame").writeStream.outputMode("append")
        .format("parquet")
        .option("path", folder)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def expired_stream(events: DataFrame, delay: str) -> DataFrame:
    """``(job_id, completed_at)`` of each job one hour after it first finished, by event time.

    ``events`` needs ``ts`` as a zoned timestamp. Only final status events reach the state, so a
    chatty job costs nothing here. The state of a job goes with its timer. ``delay`` is how far events may
    be out of order: a final event that comes later still is dropped, so its job never expires.
    """
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (completed,) = state.get
            state.remove()
            yield pd.DataFrame({"job_id": [key[0]], "completed_ms": [completed]})
            return
        first = min(int(batch["at_ms"].min()) for batch in batches)
        if state.exists:
            first = min(first, state.get[0])
        state.update((first,))
        # strictly more than an hour; a timer may not lie behind the watermark
        state.setTimeoutTimestamp(max(first + HOUR_MS + 1, state.getCurrentWatermarkMs() + 1))

    finals = (
        events.withWatermark("ts", delay)
        .filter((F.col("type") == "status") & F.col("status").isin(jobs.FINAL))
        .select("job_id", "ts", F.unix_millis("ts").alias("at_ms"))
    )
    out = finals.groupBy("job_id").applyInPandasWithState(
        step, "job_id bigint, completed_ms bigint", "completed_ms bigint", "append", GroupStateTimeout.EventTimeTimeout
    )
    return out.select("job_id", F.timestamp_millis("completed_ms").alias("completed_at"))
