"""Job log traps, chunked counts, and the streaming forms across several micro-batches."""

import datetime as dt
import random

from pyspark.sql import functions as F

from repovigil.operators import jobs
from repovigil.session import fresh_dir
from repovigil.streaming import jobs as stream
from repovigil.streaming import live

SCHEMA = (
    "job_id bigint, seq bigint, ts timestamp, type string, status string, error string, progress bigint, total bigint, "
    "stage string, message string, level string, result string"
)
START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def event(job, seq, minutes, kind, **values):
    names = ["status", "error", "progress", "total", "stage", "message", "level", "result"]
    return (job, seq, START + dt.timedelta(minutes=minutes), kind, *[values.get(n) for n in names])


def test_cancel_after_finish(spark):
    rows = [
        event(1, 1, 0, "status", status="pending"), event(1, 2, 1, "status", status="running"), event(1, 3, 2, "status", status="completed"),
        event(1, 4, 3, "status", status="cancelled"), event(1, 5, 4, "status", status="running"), event(2, 6, 0, "log", message="m"),
    ]
    got = {r.job_id: r for r in jobs.job_view(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1].status == "running" and got[1].started_at.minute == 1 and got[1].completed_at.minute == 2
    assert (got[2].status, got[2].progress_current, got[2].progress_total, got[2].progress_stage, got[2].n_logs) == ("pending", 0, 100, "Queued", 1)


def test_empty_error_keeps_the_old_one(spark):
    rows = [event(1, 1, 0, "status", status="failed", error="E"), event(1, 2, 1, "status", status="failed", error="")]
    assert jobs.job_state(spark.createDataFrame(rows, SCHEMA)).first().error == "E"


def test_expiry_is_strict(spark):
    rows = [event(j, j, m, "status", status=s) for j, m, s in ((1, 0, "completed"), (2, 1, "failed"), (3, 0, "running"))]
    now = F.lit(START + dt.timedelta(minutes=60))
    assert {r.job_id for r in jobs.expire_jobs(spark.createDataFrame(rows, SCHEMA), now).collect()} == {1, 2, 3}
    now = F.lit(START + dt.timedelta(minutes=60, seconds=1))
    assert {r.job_id for r in jobs.expire_jobs(spark.createDataFrame(rows, SCHEMA), now).collect()} == {2, 3}


def counted(lines):
    """Running counts of one stage, line by line."""
    done = None
    for seq, i, ok in lines:
        done = i - 1 if i else (done or 0)
        done += ok
        yield seq, done


def test_counts_carry_over_parts(spark):
    """Lines of one job lie in several range partitions, whatever gaps their numbers have."""
    rng = random.Random(5)
    rows, expect = [], {}
    for job in (1, 2):
        lines = []
        for seq in sorted(rng.sample(range(10**12), 60)):
            kind = rng.choice(["mark", "ok", "ok", "noise"])
            if not lines or kind == "mark":
                i = rng.randint(1, 9)
                rows.append((job, "checklists", seq, f"  [{i}/9] Analyzing: x"))
                lines.append((seq, i, 0))
            elif kind == "ok":
                rows.append((job, "checklists", seq, "✅ Generated 1 required"))
                lines.append((seq, None, 1))
            else:
                rows.append((job, "checklists", seq, "noise"))
        expect.update({(job, s): d for s, d in counted(lines)})
    logs = spark.createDataFrame(rows, "job_id bigint, stage string, seq bigint, message string")
    assert {(r.job_id, r.seq): r.done for r in jobs.progress_from_logs(logs).collect()} == expect


def test_percent_of_an_empty_stage(spark):
    row = spark.range(1).select(jobs.stage_percent(F.lit("checklists"), F.lit(0), F.lit(0)).alias("a"), jobs.stage_percent(F.lit("discovery"), F.lit(1), F.lit(4)).alias("b")).first()
    assert (row.a, row.b) == (65, 13)


def random_log(rng, n):
    rows = []
    for seq in range(n):
        kind = rng.choice(["status", "progress", "log", "result"])
        values = {"status": {"status": rng.choice(["pending", "running", "completed", "failed"])}, "progress": {"progress": seq, "total": 100, "stage": "s"},
                  "log": {"message": "m", "level": "info"}, "result": {"result": "{}"}}[kind]
        rows.append(event(rng.randint(1, 12), seq, seq * 2, kind, **values))
    return rows


def test_streamed_state_equals_the_fold(spark):
    events = spark.createDataFrame(random_log(random.Random(2), 300), SCHEMA)
    source = fresh_dir(spark, "in")
    events.repartition(5).write.parquet(source)
    live = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    out = fresh_dir(spark, "out")
    query = stream.write_state(stream.state_stream(live), out, fresh_dir(spark, "cp"))
    query.awaitTermination()
    assert len([p for p in query.recentProgress if p["numInputRows"]]) >= 4
    batch = jobs.job_view(events)
    assert sorted(map(str, stream.read_state(spark, out).select(batch.columns).collect())) == sorted(map(str, batch.collect()))


def test_expiry_timers_fire_across_batches(spark):
    source, out, cp = fresh_dir(spark, "in"), fresh_dir(spark, "out"), fresh_dir(spark, "cp")
    batches = [
        [event(1, 1, 0, "status", status="completed"), event(2, 2, 5, "status", status="running")],
        [event(1, 3, 30, "status", status="failed"), event(3, 4, 40, "status", status="cancelled")],
        [event(2, 5, 61, "log", message="tick")],
        [event(2, 6, 90, "status", status="completed")],
    ]
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        live = spark.readStream.schema(SCHEMA).parquet(source)
        query = (
            stream.expired_stream(live, "0 seconds").writeStream.outputMode("append").format("parquet")
            .option("path", out).option("checkpointLocation", cp).trigger(availableNow=True).start()
        )
        query.awaitTermination()
    got = spark.read.schema("job_id bigint, completed_at timestamp").parquet(out).collect()
    assert [(r.job_id, r.completed_at.minute) for r in got] == [(1, 0)]


def run_live(spark, batches, lateness="INTERVAL 0 SECONDS"):
    """One version per batch; yields the folder after each."""
    source, out, cp = fresh_dir(spark, "in"), fresh_dir(spark, "live"), fresh_dir(spark, "cp")
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        query = live.write_live(spark.readStream.schema(SCHEMA).parquet(source), out, cp, lateness)
        query.awaitTermination()
        assert query.exception() is None
        yield out


def test_live_state_in_any_order_equals_the_fold(spark):
    rows = random_log(random.Random(4), 200)
    mixed = random.Random(1).sample(rows, len(rows))
    *_, out = run_live(spark, [mixed[k::4] for k in range(4)], "INTERVAL 9 HOURS")
    batch = jobs.job_view(spark.createDataFrame(rows, SCHEMA))
    assert sorted(map(str, live.live_jobs(spark, out).select(batch.columns).collect())) == sorted(map(str, batch.collect()))
    assert live.late_events(spark, out).count() == 0 and live.expired_jobs(spark, out).count() == 0


def test_live_state_ends_and_late_events_are_kept(spark):
    batches = [
        [event(1, 1, 10, "status", status="completed"), event(2, 2, 5, "status", status="running"), event(3, 3, 6, "log", message="a")],
        [event(1, 4, 9, "status", status="failed"), event(2, 5, 60, "log", message="b")],  # an earlier end, out of order
        [event(2, 6, 70, "log", message="c")],
        [event(1, 7, 8, "log", message="too late"), event(3, 8, 71, "status", status="completed")],
        [event(3, 9, 140, "log", message="still here")],
    ]
    alive, gone, size = [], [], []
    for out in run_live(spark, batches):
        alive.append({r.job_id for r in live.live_jobs(spark, out).collect()})
        gone.append({(r.job_id, r.completed_at.minute) for r in live.expired_jobs(spark, out).collect()})
        size.append(spark.read.parquet(f"{out}/state").select("v").distinct().count())
    assert alive == [{1, 2, 3}, {1, 2, 3}, {2, 3}, {2, 3}, {2}]
    assert gone == [set(), set(), {(1, 9)}, {(1, 9)}, {(1, 9), (3, 11)}]
    assert [r.message for r in live.late_events(spark, out).collect()] == ["too late"]
    assert max(size) <= 2


def test_subscriber_between_batches_gets_each_frame_once(spark):
    rows = [event(1, i, i, "log", message=f"m{i}") for i in range(30)] + [event(1, 30, 30, "status", status="running"), event(2, 31, 31, "log", message="other")]
    rows += [event(1, 32 + i, 32 + i, "progress", progress=i, total=9, stage="s") for i in range(4)]
    now = F.lit(START)
    seen = []
    for k, out in enumerate(run_live(spark, [rows[:12], rows[12:33], rows[33:]])):
        if k == 1:
            joined = live.newest(spark, out)
            seen = live.snapshot(spark, out, joined, now).filter("job_id = 1").orderBy("section", "ts", "seq").collect()
    assert [r.section for r in seen] == [0, 1] + [2] * 30
    assert '"status":"running"' in seen[0].frame and '"current":0' in seen[1].frame
    assert [f"m{i}" in r.frame for i, r in enumerate(seen[2:])] == [True] * 30
    more = live.tail(spark, out, joined).filter("job_id = 1").orderBy("nth").collect()
    assert [r.seq for r in more] == [33, 34, 35] and [r.nth for r in more] == [1, 2, 3]
    assert live.snapshot(spark, out, live.newest(spark, out), now).filter("section = 2").count() == 31
