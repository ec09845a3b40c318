"""Model calls with retries: every pending flow is asked once per round, for a few rounds."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repovigil.operators.model import Responder, message
from repovigil.operators.parse import parse_checklist, parse_report, restore_flow_name
from repovigil.session import materialize


@dataclass(frozen=True)
class Task:
    """How to read an answer, and what to say to a failed one."""

    parse: Callable[[DataFrame], DataFrame]
    after_error_answer: str
    after_bad_answer: Callable[[Column], Column] | None


# Attempts and feedback texts.
MAX_ATTEMPTS = 3
CHECKLIST = Task(
    parse_checklist,
    "Please try again and provide a valid security checklist in the required JSON format.",
    lambda error: F.concat(
        F.lit("Your response could not be parsed. Error: "),
        error,
        F.lit("\n\nPlease respond with valid JSON in the exact format specified."),
    ),
)
INSPECTION = Task(parse_report, "Please try again and provide a valid security report.", None)


def retry_rounds(flows: DataFrame, responder: Responder, task: Task, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """``flows(keys..., flow_name, model, system, messages)`` with the outcome of up to 3 attempts.

    Adds ``success``, ``retries``, ``error`` (of the last attempt) and the parsed fields;
    ``messages`` is the conversation. Only flows still without a valid answer enter the next
    round. A round is written once, with its answers, before anything reads it: no call happens
    twice.
    """
    pending = flows.withColumn("attempt", F.lit(0))
    finished: list[DataFrame] = []
    for attempt in range(max_attempts):
        parsed = task.parse(responder(pending))
        error = F.coalesce(F.col("call_error"), F.col("error"))
        parsed = parsed.withColumn("error", error)
        good = F.coalesce(F.col("error").isNull() & (F.col("status") == "completed"), F.lit(False))
        refused = F.col("error").isNull() & (F.col("status") == "error")
        said = F.when(F.col("error").isNull(), F.array(message("assistant", F.col("json"))))
        reply = F.when(refused, F.array(message("user", F.lit(task.after_error_answer))))
        if task.after_bad_answer is not None:
            reply = reply.when(F.col("error").isNotNull(), F.array(message("user", task.after_bad_answer(F.col("error")))))
        empty = F.array().cast(dict(flows.dtypes)["messages"])
        parsed = parsed.withColumns(
            {
                "success": good,
                "messages": F.concat("messages", F.coalesce(said, empty), F.coalesce(reply, empty)),
                "retries": F.when(good, F.lit(attempt)).otherwise(F.lit(attempt + 1)),
            }
        ).drop("text", "call_error", "json", "attempt")
        parsed = materialize(parsed)
        finished.append(parsed if attempt + 1 == max_attempts else parsed.filter("success"))
        if attempt + 1 < max_attempts:
            pending = parsed.filter(~F.col("success")).select(*flows.columns).withColumn("attempt", F.lit(attempt + 1))
            if pending.isEmpty():
                break
    return restore_flow_name(reduce(DataFrame.unionByName, finished))


def transcripts(outcomes: DataFrame, agent: str, keys: list[str]) -> DataFrame:
    """Conversation, retries and success per flow."""
    return outcomes.select(
        *keys, F.lit(agent).alias("agent"), "flow_name", F.col("messages").alias("conversation"), "retries", "success"
    )
