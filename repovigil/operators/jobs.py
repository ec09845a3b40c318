"""Job event log: the state of each job, its times, replay frames, expiry and progress.

``events(job_id, seq, ts, type, status, error, progress, total, stage, message, level, result)``
is append-only; ``(ts, seq)`` is the order. State is one map-side combined aggregate per job; log
lines stay rows of the event table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repovigil.session import materialize

# Job life cycle, retention, share of the progress bar per stage.
FINAL = ["completed", "failed", "cancelled"]
RETENTION = "INTERVAL 1 HOUR"
STAGE_SPANS = {
    "init": (0, 5),
    "discovery": (5, 35),
    "checklists": (35, 65),
    "inspection": (65, 95),
    "finalize": (95, 100),
}
DISCOVERY_STEPS = 10


def state_aggregates() -> list[Column]:
    """The fold of one job's events; also used as a streaming aggregation."""
    order = F.struct("ts", "seq")

    def latest(value: Column, when: Column) -> Column:
        return F.max_by(value, F.when(when, order))

    kind = F.col("type")
    progress = latest(F.struct("progress", "total", "stage"), kind == "progress")
    return [
        F.coalesce(latest(F.col("status"), kind == "status"), F.lit("pending")).alias("status"),
        latest(F.col("error"), F.coalesce(F.col("error") != "", F.lit(False))).alias("error"),
        F.coalesce(
            progress, F.struct(F.lit(0).cast("bigint").alias("progress"), F.lit(100).cast("bigint").alias("total"), F.lit("Queued").alias("stage"))
        ).alias("progress"),
        latest(F.col("result"), kind == "result").alias("result"),
        F.count_if(kind == "log").alias("n_logs"),
    ]


def time_aggregates() -> list[Column]:
    """First entry and first exit; later ones do not count."""
    return [
        F.min("ts").alias("created_at"),
        F.min(F.when(F.col("status") == "running", F.col("ts"))).alias("started_at"),
        F.min(F.when(F.col("status").isin(FINAL), F.col("ts"))).alias("completed_at"),
    ]


def _flat(jobs: DataFrame) -> DataFrame:
    return jobs.select(
        *[c for c in jobs.columns if c != "progress"],
        F.col("progress.progress").alias("progress_current"),
        F.col("progress.total").alias("progress_total"),
        F.col("progress.stage").alias("progress_stage"),
    )


def job_state(events: DataFrame) -> DataFrame:
    return _flat(events.groupBy("job_id").agg(*state_aggregates()))


def job_times(events: DataFrame) -> DataFrame:
    return events.groupBy("job_id").agg(*time_aggregates())


def job_view(events: DataFrame) -> DataFrame:
    """State and times of each job in one pass, without internal fields."""
    return _flat(events.groupBy("job_id").agg(*state_aggregates(), *time_aggregates()))


def _epoch_ms(ts: Column, zoned: bool) -> Column:
    """Milliseconds since 1970; a time without zone is read as UTC whatever the session zone is."""
    if zoned:
        return F.unix_millis(ts)
    return F.timestamp_diff("MILLISECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), ts)


def _frame(kind: str, at: Column, data: Column) -> Column:
    body = F.concat(F.lit(f'{{"type":"{kind}","timestamp":'), at.cast("string"), F.lit(',"data":'), data, F.lit("}"))
    return F.concat(F.lit("data: "), body, F.lit("\n\n"))


def job_replay(events: DataFrame, now: Column) -> DataFrame:
    """``(job_id, section, ts, seq, frame)``: what a new subscriber gets, ordered by section, ts, seq.

    Status, progress, every log line, then the result if there is one. Log lines are rows of the
    log itself and are never gathered per job.
    """
    ts_type = dict(events.dtypes)["ts"]
    at = _epoch_ms(now, ts_type == "timestamp")
    state = job_state(events)
    snapshot = state.select(
        "job_id",
        F.inline(
            F.array_compact(
                F.array(
                    F.struct(F.lit(0).alias("section"), _frame("status", at, F.to_json(F.struct("status", "error"))).alias("frame")),
                    F.struct(
                        F.lit(1).alias("section"),
                        _frame(
                            "progress",
                            at,
                            F.to_json(
                                F.struct(
                                    F.col("progress_current").alias("current"),
                                    F.col("progress_total").alias("total"),
                                    F.col("progress_stage").alias("stage"),
                                )
                            ),
                        ).alias("frame"),
                    ),
                    F.when(
                        F.col("result").isNotNull(),
                        F.struct(F.lit(3).alias("section"), _frame("result", at, F.col("result")).alias("frame")),
                    ),
                )
            )
        ),
    ).select("job_id", "section", F.lit(None).cast(ts_type).alias("ts"), F.lit(None).cast("bigint").alias("seq"), "frame")
    when = _epoch_ms(F.col("ts"), ts_type == "timestamp")
    entry = F.to_json(F.struct(when.alias("timestamp"), "message", "level"))
    logs = events.filter(F.col("type") == "log").select(
        "job_id", F.lit(2).alias("section"), "ts", "seq", _frame("log", when, entry).alias("frame")
    )
    return snapshot.unionAll(logs)


def cancelled_jobs(events: DataFrame) -> DataFrame:
    return job_state(events).filter(F.col("status") == "cancelled").select("job_id")


def cancel_filter(rows: DataFrame, events: DataFrame) -> DataFrame:
    """Rows of jobs that are not cancelled; used between rounds."""
    return rows.join(cancelled_jobs(events), "job_id", "left_anti")


def expire_jobs(events: DataFrame, now: Column) -> DataFrame:
    """Jobs that are kept: unfinished ones, and those finished at most one hour before ``now``."""
    late = now - F.col("completed_at") > F.expr(RETENTION)
    return job_times(events).filter(~F.coalesce(late, F.lit(False)))


def stage_percent(stage: Column, current: Column, total: Column) -> Column:
    """``round(start + current / total * (end - start))``; an empty stage is at its end."""
    out = None
    for name, (start, end) in STAGE_SPANS.items():
        part = F.floor(F.lit(float(start)) + current / total * F.lit(float(end - start)) + 0.5)
        value = F.when(total == 0, F.lit(end)).otherwise(part).cast("bigint")
        out = (F.when if out is None else out.when)(stage == name, value)
    return out


def progress_from_logs(logs: DataFrame) -> DataFrame:
    """``(job_id, stage, seq, done, total, percent)`` for each log line that moves the bar.

    ``logs(job_id, stage, seq, message)``. A ``[i/n]`` line sets the count to i-1, a success line
    adds one; in discovery every line about an endpoint or flow adds one. The running count is a
    segmented prefix scan: rows are range partitioned on job, stage and ``seq``, counted inside each
    part, and what earlier parts carry over is added. Parts follow the position of the lines, whatever
    numbers ``seq`` has, so the lines of one job never have to meet in one task.
    """
    stage, text = F.col("stage"), F.col("message")
    number = r"\[(\d+)/(\d+)\]"
    starts = ((stage == "checklists") & text.contains("Analyzing:")) | ((stage == "inspection") & text.contains("Inspecting:"))
    marker = starts & text.rlike(number)
    done = (
        ((stage == "checklists") & text.contains("✅ Generated"))
        | ((stage == "inspection") & text.contains("✅") & text.contains("implemented"))
        | ((stage == "discovery") & (text.contains("endpoint") | text.contains("flow")))
    )
    rows = logs.filter(marker | done).select(
        "job_id",
        "stage",
        "seq",
        F.when(marker, F.regexp_extract(text, number, 1).cast("bigint")).alias("i"),
        F.when(marker, F.regexp_extract(text, number, 2).cast("bigint")).alias("n"),
        done.cast("bigint").alias("is_done"),
    )
    group = ["job_id", "stage"]
    parts = int(logs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the part is stored with the rows: the sampled bounds must not be drawn twice
    rows = materialize(rows.repartitionByRange(parts, *group, "seq").withColumn("chunk", F.spark_partition_id()))
    inside = Window.partitionBy(*group, "chunk").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    mark = F.when(F.col("i").isNotNull(), F.struct("i", "n", (F.col("local") - F.col("is_done")).alias("at")))
    rows = rows.withColumn("local", F.sum("is_done").over(inside)).withColumn("mark", F.last(mark, True).over(inside))
    chunks = rows.groupBy(*group, "chunk").agg(F.sum("is_done").alias("n_done"), F.max_by("mark", "seq").alias("mark"))
    before = Window.partitionBy(*group).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    shifted = F.when(
        F.col("mark").isNotNull(),
        F.struct(F.col("mark.i").alias("i"), F.col("mark.n").alias("n"), (F.col("mark.at") + F.col("before")).alias("at")),
    )
    carried = (
        chunks.withColumn("before", F.coalesce(F.sum("n_done").over(before), F.lit(0)))
        .withColumn("carry", F.last(shifted, True).over(before))
        .select(*group, "chunk", "before", "carry")
    )
    total_done = F.col("local") + F.col("before")
    joined = rows.join(carried, [*group, "chunk"]).withColumn("mark", F.coalesce(shifted, F.col("carry")))
    count = F.coalesce(F.col("mark.i") - 1 + total_done - F.col("mark.at"), total_done)
    steps = F.when(stage == "discovery", F.lit(DISCOVERY_STEPS).cast("bigint")).otherwise(F.col("mark.n"))
    return joined.select("job_id", "stage", "seq", count.alias("done"), steps.alias("total")).withColumn(
        "percent",
        stage_percent(
            F.col("stage"),
            F.when(F.col("stage") == "discovery", F.least(F.col("done"), F.col("total"))).otherwise(F.col("done")),
            F.col("total"),
        ),
    )
