"""Multi-turn endpoint tracing: every repository's conversation is one row of a state table.

One round asks the model for every active repository, reads the requested files, and applies the
transition to all rows at once. Wall time is rounds, not repositories times calls.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repovigil.operators import lookup
from repovigil.operators.model import MESSAGES, Responder, message, user_prompt
from repovigil.operators.parse import parse_trace
from repovigil.operators.prompts import trace_prompt
from repovigil.operators.turns import TREE, Turns, extended, new_turns
from repovigil.session import fresh_dir, written

# Answered calls per endpoint, and the last-call warning.
MAX_DEPTH = 10
LAST_CALL = (
    "⚠️ You have reached the maximum analysis depth of {depth}. Please complete the endpoint analysis in the next response."
)

STATE = [
    "repo_id", "model", "system", "tree", "status", "endpoint_no", "depth", "call_no", "chain", "files_read",
    "queue", "processed",
]


def _no_strings() -> Column:
    return F.array().cast("array<string>")


def _no_turns() -> Column:
    return F.array().cast("array<struct<turn:string,role:string,content:string>>")


def start_state(trees: DataFrame, model: str, system: str) -> DataFrame:
    """One active row per repository, with the first turn of its conversation in ``said``.

    ``trees`` has a ``tree`` per repository, or ``(part_no, text)`` rows that stay a table: messages then hold
    ``turns.TREE``, and the responder puts the tree in.
    """
    whole = "tree" in trees.columns
    repos = trees.select("repo_id", "tree") if whole else trees.select("repo_id").distinct().withColumn("tree", F.lit(TREE))
    said = user_prompt(trace_prompt(F.col("tree"), _no_strings()))
    return repos.select(
        "repo_id",
        F.lit(model).alias("model"),
        F.lit(system).alias("system"),
        "tree",
        F.lit("active").alias("status"),
        F.lit(1).alias("endpoint_no"),
        F.lit(0).alias("depth"),
        F.lit(1).alias("call_no"),
        extended(_no_strings(), said, F.col("repo_id")).alias("chain"),
        _no_strings().alias("files_read"),
        _no_strings().alias("queue"),
        _no_strings().alias("processed"),
        said.alias("said"),
    )


def _read_requests(parsed: DataFrame, files: DataFrame | lookup.TextStore) -> DataFrame:
    """Replies to the next file (1) and, for tracing, to the head of the queue (2) per repository."""
    wanted = F.array_compact(
        F.array(
            F.when(F.col("file_to_read_next").isNotNull(), F.struct(F.lit(1).alias("request_id"), F.col("file_to_read_next").alias("file"))),
            F.when(
                (F.col("status_now") == "tracing_endpoint") & (F.size("queue_now") > 0),
                F.struct(F.lit(2).alias("request_id"), F.get("queue_now", F.lit(0)).alias("file")),
            ),
        )
    )
    requests = parsed.select("repo_id", "files_read", F.inline(wanted)).select(
        "repo_id", "request_id", "file", F.array_contains("files_read", F.col("file")).alias("already_read")
    )
    replies = lookup.file_messages(requests, files)

    def reply(number: int) -> Column:
        return F.max(F.when(F.col("request_id") == number, F.struct("found", "file", "message"))).alias(f"reply{number}")

    return replies.groupBy("repo_id").agg(reply(1), reply(2))  # at most two rows per repository


def trace_step(
    state: DataFrame, files: DataFrame | lookup.TextStore, responder: Responder, turns: Turns, max_depth: int = MAX_DEPTH
) -> tuple[DataFrame, DataFrame]:
    """One round: ``(next state, log)``. ``log`` has the parsed answer of every active row.

    What is said in the round is added to ``turns``; states and logs hold chains of hashes only.
    """
    active = state.filter(F.col("status") == "active")
    reads = getattr(responder, "reads_messages", True)
    asked = responder(turns.told(active, ["repo_id"]) if reads else active)
    # a round's tables are written and not checkpointed: a checkpoint keeps its plan's size estimate, and
    # estimates that are multiplied in every round soon have millions of digits
    answered = written(asked.select(*STATE, "text", "call_error"), "trace-answers")
    parsed = parse_trace(answered.withColumnRenamed("status", "_state")).withColumnRenamed("status", "status_now")
    fresh = F.filter(F.coalesce("files_to_read_later", _no_strings()), lambda f: ~F.array_contains("files_read", f))
    parsed = parsed.withColumn("queue_now", F.concat("queue", fresh))
    rows = parsed.join(_read_requests(parsed, files), "repo_id", "left")

    broke, bad = F.col("call_error").isNotNull(), F.col("call_error").isNull() & F.col("error").isNotNull()
    pick, tracing = F.col("status_now") == "pick_endpoint", F.col("status_now") == "tracing_endpoint"
    done, none = F.col("status_now") == "completed", F.col("status_now") == "not_found"
    got = F.coalesce("reply1.found", F.lit(False))
    second = tracing & ~got & F.col("reply2").isNotNull()
    got_second = second & F.col("reply2.found")
    depth = F.col("depth") + 1

    def maybe(when: Column, role: str, content: Column) -> Column:
        return F.coalesce(F.when(when, F.array(message(role, content))), F.array().cast(MESSAGES))

    talk = F.concat(
        maybe(F.lit(True), "assistant", F.col("json")),
        maybe(pick | tracing, "user", F.col("reply1.message")),
        maybe(second, "user", F.col("reply2.message")),
        maybe(tracing & (depth + 1 >= max_depth), "user", F.lit(LAST_CALL.format(depth=max_depth))),
    )
    known = F.array_union(
        F.array_union("files_read", F.when((pick | tracing) & got, F.array("reply1.file")).otherwise(_no_strings())),
        F.when(got_second, F.array("reply2.file")).otherwise(_no_strings()),
    )
    queue = F.when(second, F.slice("queue_now", F.lit(2), F.size("queue_now"))).otherwise(F.col("queue_now"))
    listed = F.array_append("processed", F.col("profile.entry_point"))
    root = F.col("repo_id")
    anew = user_prompt(trace_prompt(F.col("tree"), listed))
    nothing = F.array().cast(MESSAGES)
    # a completed endpoint is logged with all that was said, and a new conversation begins
    rows = rows.withColumns({"talk": F.when(broke | bad, nothing).otherwise(talk), "anew": F.when(done, anew).otherwise(nothing)})
    rows = rows.withColumns(
        {"_talked": extended(F.col("chain"), F.col("talk"), root), "_begun": extended(_no_strings(), F.col("anew"), root)}
    )
    said = F.concat(*[F.coalesce(new_turns(F.col(c), F.col(t)), _no_turns()) for c, t in (("_talked", "talk"), ("_begun", "anew"))])
    rows = written(rows.withColumn("_said", said).drop("talk", "anew"), "trace-rows")
    turns.append(rows, "_said")
    log = rows.select(
        "repo_id", "endpoint_no", "call_no", F.coalesce("call_error", "error").alias("error"), "status_now", "profile",
        "endpoint_being_traced", "file_to_read_next", known.alias("files_read"),
        F.col("_talked").alias("chain"),
    )
    status = (
        F.when(broke, "failed")
        .when(bad & (F.size("chain") <= 1), "no_messages")
        .when(bad, "active")
        .when(none, "finished")
        .when(pick & ~got, "finished")
        .when(~done & (depth >= max_depth), "depth_reached")
        .otherwise("active")
    )
    updates = {
        "status": status,
        "endpoint_no": F.when(done, F.col("endpoint_no") + 1).otherwise(F.col("endpoint_no")),
        "depth": F.when(broke | bad, F.col("depth")).when(done, F.lit(0)).otherwise(depth),
        "call_no": F.col("call_no") + 1,
        "chain": F.when(broke, F.col("chain"))
        .when(bad, F.slice("chain", F.lit(1), F.greatest(F.size("chain") - 1, F.lit(0))))
        .when(done, F.col("_begun"))
        .otherwise(F.col("_talked")),
        "files_read": F.when(broke | bad, F.col("files_read")).when(done, _no_strings()).otherwise(known),
        "queue": F.when(broke | bad, F.col("queue")).when(done, _no_strings()).otherwise(queue),
        "processed": F.when(done, listed).otherwise(F.col("processed")),
    }
    return rows.select(*[updates.get(c, F.col(c)).alias(c) for c in STATE]), log


@dataclass
class Traced:
    """``profiles``, the final ``states`` and the ``log`` of all rounds, with ``turns`` for their chains."""

    profiles: DataFrame
    states: DataFrame
    log: DataFrame
    turns: Turns

    def __iter__(self) -> Iterator[DataFrame]:
        return iter((self.profiles, self.states, self.log))


def trace_rounds(
    files: DataFrame, trees: DataFrame, responder: Responder, model: str, system: str,
    max_depth: int = MAX_DEPTH, cancelled: Callable[[], DataFrame] | None = None,
) -> Traced:
    """Profiles, final states with their ``messages``, and the log with its ``chain`` of turns.

    A repository goes on until its model has found no more endpoints. An unreadable answer costs no
    depth but takes the last message away; a repository without messages left makes no progress and ends as
    ``no_messages``. A failed call ends its repository and discards the endpoints found in it.
    ``cancelled()`` gives the repositories whose job is cancelled by now; it is asked before every round, and
    they end as ``cancelled`` without another call, with the endpoints found so far.

    Every round appends its turns, its log and the states that ended to folders, so neither a round's plan nor
    what it writes grows with the number of rounds.
    """
    spark = files.sparkSession
    # written, so that the trees are made once for the first turns and the first round
    state, turns = written(start_state(trees, model, system), "trace-start"), Turns.start(spark)
    first = new_turns(F.col("chain"), F.col("said")).alias("said")
    turns.append(state.select(first), "said")
    state = state.select(*STATE)
    ends, logs = fresh_dir(spark, "trace-ends"), fresh_dir(spark, "trace-log")
    log_schema = None
    # texts are clustered once; a round moves requests, not texts
    store = lookup.TextStore.of(files)
    while True:
        active = written(state.filter(F.col("status") == "active"), "trace-state")
        if cancelled is not None:
            stopped = written(cancelled().select("repo_id").distinct(), "trace-cancelled")
            gone = active.join(stopped, "repo_id", "left_semi").withColumn("status", F.lit("cancelled"))
            gone.select(*STATE).write.mode("append").parquet(ends)
            active = written(active.join(stopped, "repo_id", "left_anti"), "trace-state")
        if active.isEmpty():
            break
        state, log = trace_step(active, store, responder, turns, max_depth)
        log_schema = log.schema
        log.write.mode("append").parquet(logs)
        state.filter(F.col("status") != "active").write.mode("append").parquet(ends)
    if log_schema is None:  # nobody was asked
        empty, log = trace_step(active, store, responder, turns, max_depth)
        empty.write.mode("append").parquet(ends)
        log.write.parquet(logs)
        log_schema = log.schema
    store.forget()
    final = spark.read.schema(active.select(*STATE).schema).parquet(ends)
    logs = spark.read.schema(log_schema).parquet(logs)
    profiles = (
        logs.filter(F.col("status_now") == "completed")
        .join(final.filter(F.col("status") == "failed").select("repo_id"), "repo_id", "left_anti")
        .select("repo_id", F.col("endpoint_no").alias("pos"), "profile.*")
    )
    return Traced(profiles, turns.told(final, ["repo_id"]), logs, turns)


def flow_profiles(profiles: DataFrame) -> DataFrame:
    """Profiles without their long documentation."""
    return profiles.drop("mark_down")


def trace_transcripts(traced: Traced) -> DataFrame:
    """Conversation and files read of each traced endpoint: the last call's state."""
    last = traced.log.groupBy("repo_id", "endpoint_no").agg(
        F.max_by(F.struct("chain", "files_read", "profile"), "call_no").alias("last"),
        F.max_by(
            F.coalesce("endpoint_being_traced", "file_to_read_next"),
            F.when(F.coalesce("endpoint_being_traced", "file_to_read_next").isNotNull(), F.col("call_no")),
        ).alias("named"),
    )
    rows = last.select(
        "repo_id",
        "endpoint_no",
        F.coalesce("last.profile.entry_point", "named", F.lit("unknown")).alias("endpoint"),
        F.col("last.chain").alias("chain"),
        F.col("last.files_read").alias("files_read"),
    )
    return traced.turns.told(rows, ["repo_id", "endpoint_no"], name="conversation").select(
        "repo_id", "endpoint_no", "endpoint", "conversation", "files_read"
    )
