"""Batch model calls as a table job: prompts in, one text per prompt out.

The model itself is outside. A *responder* is a function DataFrame -> DataFrame that adds
``text`` and ``call_error``; ``replay`` joins a table of known answers, ``live`` runs a
caller's function on partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repovigil.operators.turns import SLICE, TREE, with_trees
from repovigil.session import written

#: A responder that sets ``reads_messages`` to False is asked without the conversation.
Responder = Callable[[DataFrame], DataFrame]
MESSAGES = "array<struct<role:string,content:string>>"

# Provider by model name prefix.
PROVIDER_PREFIXES = [("claude-", "anthropic"), ("gemini-", "google"), ("models/gemini-", "google")]
DEFAULT_PROVIDER = "openai"
NO_ANSWER = "Unknown error"


def provider(model: Column) -> Column:
    name = F.lit(DEFAULT_PROVIDER)
    for prefix, value in reversed(PROVIDER_PREFIXES):
        name = F.when(model.startswith(prefix), value).otherwise(name)
    return name


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def user_prompt(prompt: Column) -> Column:
    return F.array(message("user", prompt))


def prompt_hash() -> Column:
    """Identity of a call: model, system text and messages."""
    return F.sha2(F.to_json(F.struct("model", "system", "messages")), 256)


def _answered(df: DataFrame) -> DataFrame:
    return df.withColumn("call_error", F.when(F.col("text").isNull(), F.lit(NO_ANSWER)))


def replay(responses: DataFrame, keys: list[str] | None = None) -> Responder:
    """Known answers ``responses(keys..., text)``, by default keyed by ``prompt_hash``.

    Of several answers for one key the smallest text counts, so a call never gives two rows.
    """
    by = keys or ["prompt_hash"]
    known = responses.groupBy(*by).agg(F.min("text").alias("text"))
    if keys:
        known = written(known, "known-answers")  # every round of a loop reads them

        def by_keys(prompts: DataFrame) -> DataFrame:
            return _answered(prompts.join(known, keys, "left"))

        by_keys.reads_messages = False
        return by_keys

    def by_hash(prompts: DataFrame) -> DataFrame:
        return _answered(
            prompts.withColumn("prompt_hash", prompt_hash())
            .join(known, "prompt_hash", "left")
            .drop("prompt_hash")
        )

    return by_hash


def live(
    call: Callable[[str, str, list[dict]], str], parallelism: int, trees: DataFrame | None = None, per_slice: int = SLICE
) -> Responder:
    """Call ``call(model, system, messages)`` once per row on ``parallelism`` partitions.

    A raised error becomes ``call_error``; callers materialize the result before they use it
    twice, so that a retried plan does not ask the model again. With ``trees(repo_id, part_no, text)``
    messages that name their repository's tree get it in the task that makes the call, ``per_slice`` rows of one
    repository at a time.
    """
    def answers(batch: pd.DataFrame, tree: str | None = None) -> pd.DataFrame:
        texts, errors = [], []
        for model, system, messages in zip(batch["model"], batch["system"], batch["messages"]):
            said = [dict(m) for m in messages]
            if tree is not None:
                said = [{**m, "content": m["content"].replace(TREE, tree)} for m in said]
            try:
                texts.append(call(model, system, said))
                errors.append(None)
            except Exception as error:  # a failed call is data, not a failed task
                texts.append(None)
                errors.append(str(error) or NO_ANSWER)
        return batch.assign(text=pd.Series(texts, batch.index, object), call_error=pd.Series(errors, batch.index, object))

    def respond(prompts: DataFrame) -> DataFrame:
        schema = f"{_ddl(prompts)}, text string, call_error string"

        def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield answers(batch)

        if trees is not None:
            return with_trees(prompts, trees, answers, schema, per_slice)
        return prompts.repartition(parallelism).mapInPandas(ask, schema)

    return respond


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def call_model(prompts: DataFrame, responder: Responder) -> DataFrame:
    """``prompts(model, system, messages, ...)`` with ``provider``, ``text``, ``call_error``."""
    return responder(prompts).withColumn("provider", provider(F.col("model")))
