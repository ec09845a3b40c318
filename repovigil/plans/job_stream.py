"""Registered queries: the streaming forms, run to the end of the given events."""

from __future__ import annotations

from pyspark.sql import functions as F

from repovigil.plans.job_log import _LOG, JOB_LOG, job_log
from repovigil.session import fresh_dir
from repovigil.streaming import jobs as stream
from repovigil.streaming import live

EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def _log_stream(spark, sf):
    """The event table as a stream, through the same view text as the batch log."""
    source = spark.readStream.schema(EVENT_SCHEMA).parquet(f"{sf}/events*.parquet")
    source.createOrReplaceTempView("repovigil_event_stream")
    return spark.sql(JOB_LOG.replace("FROM events", "FROM repovigil_event_stream"))


def _split_log_stream(spark, sf):
    """The log rewritten as several files, one micro-batch each."""
    folder = fresh_dir(spark, "log")
    job_log(spark, sf).repartition(4).write.parquet(folder)
    return spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)


def _finish(query):
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def job_state_stream(spark, sf):
    out = fresh_dir(spark, "states")
    _finish(stream.write_state(stream.state_stream(_split_log_stream(spark, sf)), out, fresh_dir(spark, "cp")))
    return stream.read_state(spark, out)


def job_frames_stream(spark, sf):
    out = fresh_dir(spark, "frames")
    _finish(stream.write_frames(_log_stream(spark, sf), out, fresh_dir(spark, "cp")))
    return spark.read.parquet(out)


def expire_jobs_stream(spark, sf):
    out = fresh_dir(spark, "expired")
    events = _log_stream(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    query = (
        stream.expired_stream(events, "0 seconds")
        .writeStream.outputMode("append")
        .format("parquet")
        .option("path", out)
        .option("checkpointLocation", fresh_dir(spark, "cp"))
        .trigger(availableNow=True)
        .start()
    )
    _finish(query)
    rows = spark.read.schema("job_id bigint, completed_at timestamp").parquet(out)
    return rows.select("job_id", F.col("completed_at").cast("timestamp_ntz").alias("completed_at"))


def _live(spark, sf, lateness):
    """The log in time order, a quarter of its time at a time, with a version of the state after each."""
    log = job_log(spark, sf).withColumn("_at", F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"))
    low, high = log.agg(F.min("_at"), F.max("_at")).first()
    source, out, checkpoint = fresh_dir(spark, "log"), fresh_dir(spark, "live"), fresh_dir(spark, "cp")
    quarter = F.least(F.floor((F.col("_at") - low) * 4 / max(high - low, 1)), F.lit(3))
    for k in range(4):
        log.filter(quarter == k).drop("_at").write.mode("append").parquet(source)
        events = spark.readStream.schema(log.drop("_at").schema).parquet(source)
        _finish(live.write_live(events, out, checkpoint, lateness))
    return out


def job_state_live(spark, sf):
    """All jobs, as the lateness allowed is longer than the log."""
    return live.live_jobs(spark, _live(spark, sf, "INTERVAL 1000 DAYS"))


def expire_jobs_live(spark, sf):
    return live.expired_jobs(spark, _live(spark, sf, "INTERVAL 0 SECONDS"))


SQL = {
    "job_state_live": f"{_LOG} SELECT * FROM state JOIN times USING (job_id)",
    "expire_jobs_live": f"{_LOG} SELECT job_id, completed_at FROM times, clock WHERE now - completed_at > INTERVAL 1 HOUR",
    "job_state_stream": f"{_LOG} SELECT * FROM state JOIN times USING (job_id)",
    "job_frames_stream": f"""{_LOG} SELECT job_id, seq, 'data: {{"type":"' || type || '","timestamp":' || (epoch_us(ts) // 1000) || ',"data":' || CASE type
          WHEN 'status' THEN '{{"status":"' || status || '"}}' WHEN 'error' THEN '{{' || coalesce('"error":"' || error || '"', '') || '}}'
          WHEN 'progress' THEN '{{"current":' || progress || ',"total":' || total || ',"stage":"' || stage || '"}}'
          WHEN 'log' THEN '{{"timestamp":' || (epoch_us(ts) // 1000) || ',"message":"' || message || '","level":"info"}}' ELSE result END || '}}' || chr(10) || chr(10) AS frame FROM log""",
    "expire_jobs_stream": f"""{_LOG} SELECT job_id, make_timestamp(epoch_us(completed_at) // 1000 * 1000) AS completed_at FROM times, clock
        WHERE now - completed_at > INTERVAL 1 HOUR""",
}
QUERIES = {
    "job_state_live": job_state_live,
    "expire_jobs_live": expire_jobs_live,
    "job_state_stream": job_state_stream,
    "job_frames_stream": job_frames_stream,
    "expire_jobs_stream": expire_jobs_stream,
}
