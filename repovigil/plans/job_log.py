"""Registered queries: the job event log, batch and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from repovigil.operators import jobs
from repovigil.plans.corpus import JOB_EVENTS, from_sql

JOB_LOG = f"""
SELECT job_id, seq, ts, type, status,
  CASE WHEN type = 'error' THEN CASE seq % 3 WHEN 0 THEN '' ELSE 'E' || CAST(seq AS STRING) END END AS error,
  progress, CASE WHEN type = 'progress' THEN CAST(100 AS BIGINT) END AS total,
  CASE WHEN type = 'progress' THEN 'Stage ' || CAST(seq % 5 AS STRING)
       WHEN type = 'log' THEN CASE seq % 3 WHEN 0 THEN 'discovery' WHEN 1 THEN 'checklists' ELSE 'inspection' END END AS stage,
  CASE WHEN type = 'log' THEN CASE (seq % 3) * 4 + CAST(floor(seq / 3) AS BIGINT) % 4
       WHEN 0 THEN 'Endpoint recorded' WHEN 1 THEN '   endpoint analysis complete' WHEN 2 THEN 'next flow' WHEN 3 THEN 'noise'
       WHEN 4 THEN '   [' || CAST(seq % 7 + 1 AS STRING) || '/9] Analyzing: F' WHEN 5 THEN '   ✅ Generated 3 required'
       WHEN 6 THEN '   ✅ Generated 1 required' WHEN 7 THEN 'Analyzing: no number'
       WHEN 8 THEN '   [' || CAST(seq % 5 + 1 AS STRING) || '/8] Inspecting: F' WHEN 9 THEN '   ✅ 2 implemented, 1 missing'
       WHEN 10 THEN '   ✅ done' ELSE '   ✅ 0 implemented' END END AS message,
  CASE WHEN type = 'log' THEN 'info' END AS level,
  CASE WHEN type = 'result' THEN '{{"v":' || CAST(seq AS STRING) || '}}' END AS result
FROM ({JOB_EVENTS}) e
"""


def job_log(spark, sf):
    return from_sql(spark, sf, JOB_LOG)


def _now(spark, sf):
    """A fixed clock: the last event's time."""
    return _at(from_sql(spark, sf, "SELECT max(ts) AS now FROM events").first()["now"])


def _at(moment):
    """A time without zone, through its text: no zone of the session or of Python comes in."""
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def job_state(spark, sf):
    return jobs.job_state(job_log(spark, sf))


def job_times(spark, sf):
    return jobs.job_times(job_log(spark, sf))


def job_view(spark, sf):
    return jobs.job_view(job_log(spark, sf))


def job_replay(spark, sf):
    out = jobs.job_replay(job_log(spark, sf), _now(spark, sf))
    return out.withColumn("section", F.col("section").cast("bigint"))


def cancel_filter(spark, sf):
    log = job_log(spark, sf)
    return jobs.cancel_filter(log.select("job_id", "seq"), log)


def expire_jobs(spark, sf):
    """The clock stands at the last first completion, so some jobs are old and some are not."""
    log = job_log(spark, sf)
    last = jobs.job_times(log).agg(F.max("completed_at")).first()[0]
    return jobs.expire_jobs(log, _at(last))


def stage_progress(spark, sf):
    rows = from_sql(
        spark,
        sf,
        """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'init' WHEN 1 THEN 'discovery' WHEN 2 THEN 'checklists'
             WHEN 3 THEN 'inspection' ELSE 'finalize' END AS stage, event_id % 40 AS total,
             CAST(floor(value) AS BIGINT) % 41 AS current FROM events""",
    )
    # an empty stage has no quotient; the expression must not divide by it
    percent = jobs.stage_percent(F.col("stage"), F.col("current"), F.col("total"))
    return rows.select("event_id", "stage", "current", "total", percent.alias("percent"))


def progress_from_logs(spark, sf):
    logs = job_log(spark, sf).filter("type = 'log'").select("job_id", "stage", "seq", "message")
    return jobs.progress_from_logs(logs)


# ------------------------------------------------------------------------------------------ SQL

_LOG = f"""WITH log AS ({JOB_LOG}),
state AS (SELECT job_id,
  coalesce(arg_max(status, seq) FILTER (type = 'status'), 'pending') AS status,
  arg_max(error, seq) FILTER (error <> '') AS error,
  coalesce(arg_max(progress, seq) FILTER (type = 'progress'), 0) AS progress_current,
  coalesce(arg_max(total, seq) FILTER (type = 'progress'), 100) AS progress_total,
  coalesce(arg_max(stage, seq) FILTER (type = 'progress'), 'Queued') AS progress_stage,
  arg_max(result, seq) FILTER (type = 'result') AS result, count(*) FILTER (type = 'log') AS n_logs FROM log GROUP BY job_id),
times AS (SELECT job_id, min(ts) AS created_at, min(ts) FILTER (status = 'running') AS started_at,
  min(ts) FILTER (status IN ('completed', 'failed', 'cancelled')) AS completed_at FROM log GROUP BY job_id),
clock AS (SELECT max(ts) AS now FROM events)"""
_SPANS = "(VALUES ('init', 0, 5), ('discovery', 5, 35), ('checklists', 35, 65), ('inspection', 65, 95), ('finalize', 95, 100)) v(stage, s, e)"

SQL = {
    "job_state": f"{_LOG} SELECT * FROM state",
    "job_times": f"{_LOG} SELECT * FROM times",
    "job_view": f"{_LOG} SELECT * FROM state JOIN times USING (job_id)",
    "job_replay": f"""{_LOG}, nowms AS (SELECT epoch_us(now) // 1000 AS ms FROM clock)
        SELECT job_id, CAST(0 AS BIGINT) AS section, CAST(NULL AS TIMESTAMP) AS ts, CAST(NULL AS BIGINT) AS seq,
          'data: {{"type":"status","timestamp":' || ms || ',"data":{{"status":"' || status || '"' || coalesce(',"error":"' || error || '"', '') || '}}}}' || chr(10) || chr(10) AS frame FROM state, nowms
        UNION ALL SELECT job_id, 1, NULL, NULL, 'data: {{"type":"progress","timestamp":' || ms || ',"data":{{"current":' || progress_current || ',"total":' || progress_total
          || ',"stage":"' || progress_stage || '"}}}}' || chr(10) || chr(10) FROM state, nowms
        UNION ALL SELECT job_id, 2, ts, seq, 'data: {{"type":"log","timestamp":' || (epoch_us(ts) // 1000) || ',"data":{{"timestamp":' || (epoch_us(ts) // 1000)
          || ',"message":"' || message || '","level":"info"}}}}' || chr(10) || chr(10) FROM log WHERE type = 'log'
        UNION ALL SELECT job_id, 3, NULL, NULL, 'data: {{"type":"result","timestamp":' || ms || ',"data":' || result || '}}' || chr(10) || chr(10) FROM state, nowms WHERE result IS NOT NULL""",
    "cancel_filter": f"{_LOG} SELECT job_id, seq FROM log WHERE job_id NOT IN (SELECT job_id FROM state WHERE status = 'cancelled')",
    "expire_jobs": f"{_LOG} SELECT t.* FROM times t, (SELECT max(completed_at) AS now FROM times) c WHERE completed_at IS NULL OR NOT (now - completed_at > INTERVAL 1 HOUR)",
    "stage_progress": f"""SELECT event_id, stage, current, total, CAST(CASE WHEN total = 0 THEN e ELSE floor(s + current / total * (e - s) + 0.5) END AS BIGINT) AS percent
        FROM (SELECT event_id, ['init', 'discovery', 'checklists', 'inspection', 'finalize'][event_id % 5 + 1] AS stage, event_id % 40 AS total,
          CAST(floor(value) AS BIGINT) % 41 AS current FROM events) JOIN {_SPANS} USING (stage)""",
    "progress_from_logs": f"""{_LOG}, lines AS (SELECT job_id, stage, seq, message,
          CASE WHEN (stage = 'checklists' AND contains(message, 'Analyzing:')) OR (stage = 'inspection' AND contains(message, 'Inspecting:'))
            THEN TRY_CAST(NULLIF(regexp_extract(message, '[[]([0-9]+)/([0-9]+)', 1), '') AS BIGINT) END AS i,
          TRY_CAST(NULLIF(regexp_extract(message, '[[]([0-9]+)/([0-9]+)', 2), '') AS BIGINT) AS n,
          CASE stage WHEN 'discovery' THEN contains(message, 'endpoint') OR contains(message, 'flow')
            WHEN 'checklists' THEN contains(message, '✅ Generated') ELSE contains(message, '✅') AND contains(message, 'implemented') END AS ok
          FROM log WHERE type = 'log'),
        runs AS (SELECT *, count(i) OVER w AS island FROM lines WHERE i IS NOT NULL OR ok WINDOW w AS (PARTITION BY job_id, stage ORDER BY seq)),
        counted AS (SELECT job_id, stage, seq, coalesce(first(i) OVER v - 1, 0) + count(*) FILTER (ok) OVER v AS done,
          CASE stage WHEN 'discovery' THEN 10 ELSE first(n) OVER v END AS total FROM runs WINDOW v AS (PARTITION BY job_id, stage, island ORDER BY seq))
        SELECT job_id, stage, seq, CAST(done AS BIGINT) AS done, CAST(total AS BIGINT) AS total,
          CAST(floor(s + CASE stage WHEN 'discovery' THEN least(done, 10) ELSE done END / total * (e - s) + 0.5) AS BIGINT) AS percent
        FROM counted JOIN {_SPANS} USING (stage)""",
}
QUERIES = {
    name: globals()[name]
    for name in "job_state job_times job_view job_replay cancel_filter expire_jobs stage_progress progress_from_logs".split()
}
