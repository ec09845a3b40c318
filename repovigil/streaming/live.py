"""Job state with a life span: versions of a small state table, expiry, late events, replay with a live tail.

Every micro-batch folds its events into the state of the version before and writes the next version, so a
repeated batch writes the same again. A job's state is the few events that decide its fold, so events may come
in any order; it goes when the job has been finished for an hour (plus the lateness allowed). What comes for a
job that is gone is kept apart. Frames carry the number of their batch: a subscriber who is given the state
of version n and then the frames of later batches gets each frame once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from repovigil.operators import jobs
from repovigil.streaming.jobs import frames_of

_FIELDS = ["seq", "ts", "type", "status", "error", "progress", "total", "stage", "message", "level", "result"]


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _deciding(events: DataFrame) -> DataFrame:
    """``(job_id, kept, n_logs)``: the events of each job that decide its state and its times.

    ``events`` have ``carried``, the log lines that a row stands for.
    """
    event, order = F.struct(*_FIELDS), F.struct("ts", "seq")
    kind, status = F.col("type"), F.col("status")

    def latest(when: Column) -> Column:
        return F.max_by(event, F.when(when, order))

    def first(when: Column) -> Column:
        return F.min_by(event, F.when(when, order))

    chosen = F.array(
        latest(kind == "status"), latest(F.coalesce(F.col("error") != "", F.lit(False))), latest(kind == "progress"),
        latest(kind == "result"), first(F.lit(True)), first(status == "running"), first(status.isin(jobs.FINAL)),
    )
    return events.groupBy("job_id").agg(
        F.array_distinct(F.array_compact(chosen)).alias("kept"), F.sum("carried").alias("n_logs")
    )


def _events_of(states: DataFrame) -> DataFrame:
    """The kept events as rows again; the first one stands for all log lines."""
    rows = states.select("job_id", "n_logs", F.posexplode("kept").alias("at", "e"))
    carried = F.when(F.col("at") == 0, F.col("n_logs")).otherwise(0).cast("bigint")
    return rows.select("job_id", "e.*", carried.alias("carried"))


def fold(states: DataFrame) -> DataFrame:
    """State and times of each job, as ``jobs.job_view`` has them."""
    rows = _events_of(states)
    out = rows.groupBy("job_id").agg(*jobs.state_aggregates(), *jobs.time_aggregates(), F.sum("carried").alias("_logs"))
    return jobs._flat(out.withColumn("n_logs", F.col("_logs")).drop("_logs"))


def _completed() -> Column:
    finals = F.filter("kept", lambda e: e["status"].isin(jobs.FINAL))
    return F.array_min(F.transform(finals, lambda e: e["ts"]))


def write_live(events: DataFrame, folder: str, checkpoint: str, lateness: str = "INTERVAL 0 SECONDS"):
    """Run ``events`` to their end below ``folder``; ``lateness`` is how far they may be out of order.

    ``state/v=n`` are the jobs alive after batch n (the last two versions stay), ``clock/v=n`` the latest time
    seen, ``expired/batch=n`` the jobs that went, ``late/batch=n`` what came for jobs that were gone, and
    ``frames/batch=n`` the live tail.
    """
    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        at = lambda name, n, key="v": f"{folder}/{name}/{key}={n}"
        rows = batch.select("job_id", *_FIELDS, F.when(F.col("type") == "log", 1).otherwise(0).cast("bigint").alias("carried"))
        clock = batch.agg(F.max("ts").alias("now"))
        if number and _exists(spark, at("state", number - 1)):
            before = spark.read.parquet(at("state", number - 1))
            clock = clock.unionAll(spark.read.parquet(at("clock", number - 1))).agg(F.max("now").alias("now"))
            # versions of this batch itself may exist if it is repeated
            gone = spark.read.parquet(f"{folder}/expired").filter(F.col("batch") < number).select("job_id")
            late = rows.join(gone, "job_id", "left_semi").drop("carried")
            rows = rows.join(gone, "job_id", "left_anti").unionByName(_events_of(before))
        else:
            late = rows.drop("carried").limit(0)
        late.write.mode("overwrite").parquet(at("late", number, "batch"))
        frames_of(batch).write.mode("overwrite").parquet(at("frames", number, "batch"))
        clock.write.mode("overwrite").parquet(at("clock", number))
        now = F.broadcast(spark.read.parquet(at("clock", number)))  # one row
        over = F.coalesce(F.col("now") - F.col("completed_at") > F.expr(f"{jobs.RETENTION} + {lateness}"), F.lit(False))
        judged = _deciding(rows).withColumn("completed_at", _completed()).crossJoin(now).withColumn("over", over)
        judged.drop("now").write.mode("overwrite").parquet(at("judged", number))
        judged = spark.read.parquet(at("judged", number))
        judged.filter("over").select("job_id", "completed_at").write.mode("overwrite").parquet(at("expired", number, "batch"))
        judged.filter("NOT over").drop("over").write.mode("overwrite").parquet(at("state", number))
        _delete(spark, at("judged", number))
        for name in ("state", "clock"):
            _delete(spark, at(name, number - 2))

    return (
        events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(step).trigger(availableNow=True).start()
    )


def newest(spark: SparkSession, folder: str) -> int:
    """The version that a new subscriber is given."""
    return spark.read.parquet(f"{folder}/clock").agg(F.max("v")).first()[0]


def live_jobs(spark: SparkSession, folder: str) -> DataFrame:
    """State and times of the jobs that are alive."""
    return fold(spark.read.parquet(f"{folder}/state/v={newest(spark, folder)}"))


def expired_jobs(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/expired").drop("batch")


def late_events(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/late").drop("batch")


def snapshot(spark: SparkSession, folder: str, version: int, now: Column) -> DataFrame:
    """``(job_id, section, ts, seq, frame)``: what a subscriber who joins at ``version`` gets first.

    Status, progress, every log line up to that version, then the result. ``version`` is one of the two
    newest.
    """
    states = spark.read.parquet(f"{folder}/state/v={version}")
    told = jobs.job_replay(_events_of(states).drop("carried").filter("type <> 'log'"), now)
    # a job that has only logged so far is there, too
    lines = spark.read.parquet(f"{folder}/frames").filter((F.col("batch") <= version) & (F.col("type") == "log"))
    alive = lines.join(states.select("job_id"), "job_id", "left_semi")
    return told.unionAll(alive.select("job_id", F.lit(2).alias("section"), "ts", "seq", "frame"))


def tail(spark: SparkSession, folder: str, after: int) -> DataFrame:
    """``(job_id, ts, seq, frame, nth)``: the frames of batches after version ``after``, numbered per job."""
    frames = spark.read.parquet(f"{folder}/frames").filter(F.col("batch") > after)
    order = Window.partitionBy("job_id").orderBy("batch", "ts", "seq")
    return frames.select("job_id", "ts", "seq", "frame", F.row_number().over(order).cast("bigint").alias("nth"))
