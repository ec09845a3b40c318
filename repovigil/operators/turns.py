"""Conversations as chains of turns, and trees as parts: what long texts are while nobody reads them.

A conversation is the list of its turns' hashes, each the hash of the turn before it, the role and the text. The
texts stand once in an append-only table, so a round writes what was said in it and nothing that was said
before; taking a turn back is dropping a hash. A prompt holds ``TREE`` where its repository's tree belongs; the
tree is a table of parts that meet in the task that calls the model.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repovigil.functions.skew import salted_lookup
from repovigil.session import fresh_dir

#: Stands for the tree of a prompt's repository; private-use characters, so no path holds it.
TREE = "\ue000tree\ue000"
#: Prompts of one repository that share one copy of its tree in a task.
SLICE = 1000
_TURN = "turn string, role string, content string"


def _link(parent: Column, said: Column) -> Column:
    return F.sha2(F.concat_ws("\x00", parent, said["role"], said["content"]), 256)


def extended(chain: Column, said: Column, root: Column) -> Column:
    """The chain after the messages ``said``; ``root`` tells conversations apart."""
    return F.aggregate(
        said, chain, lambda acc, m: F.array_append(acc, _link(F.coalesce(F.try_element_at(acc, F.lit(-1)), root), m))
    )


def new_turns(chain: Column, said: Column) -> Column:
    """``(turn, role, content)`` of the messages ``said``, which end ``chain``."""
    hashes = F.slice(chain, F.size(chain) - F.size(said) + 1, F.size(said))
    zipped = F.zip_with(
        hashes, said, lambda h, m: F.struct(h.alias("turn"), m["role"].alias("role"), m["content"].alias("content"))
    )
    return F.when(F.size(said) > 0, zipped)


@dataclass
class Turns:
    """The append-only table of all turns."""

    spark: SparkSession
    folder: str

    @classmethod
    def start(cls, spark: SparkSession) -> Turns:
        return cls(spark, fresh_dir(spark, "turns"))

    def append(self, rows: DataFrame, turns: str) -> None:
        """Write the turns in the array column ``turns`` of ``rows``."""
        rows.select(F.inline(turns)).write.mode("append").parquet(self.folder)

    def table(self) -> DataFrame:
        return self.spark.read.schema(_TURN).parquet(self.folder).dropDuplicates(["turn"])

    def told(self, rows: DataFrame, keys: list[str], chain: str = "chain", name: str = "messages") -> DataFrame:
        """``rows`` with the messages of their chains; ``keys`` tell rows apart."""
        links = rows.select(*keys, F.posexplode(chain).alias("at", "turn"))
        message = F.struct("at", "role", "content")
        lists = links.join(self.table(), "turn").groupBy(*keys).agg(F.array_sort(F.collect_list(message)).alias(name))
        plain = F.transform(name, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
        nothing = F.array().cast("array<struct<role:string,content:string>>")
        return rows.join(lists, keys, "left").withColumn(name, F.coalesce(plain, nothing))


def with_trees(
    rows: DataFrame, parts: DataFrame, use: Callable[[pd.DataFrame, str], pd.DataFrame], schema: str, per_slice: int = SLICE
) -> DataFrame:
    """``use(rows of one repository, its tree)`` on partitions.

    ``parts(repo_id, part_no, text)`` are joined in the task that needs them. A repository's rows are dealt into
    slices of about ``per_slice``, and its parts go to each slice once, however many rows it has. A
    repository without parts has an empty tree.
    """
    slices = F.ceil(F.count("*") / per_slice).cast("int").alias("_slices")
    counted = salted_lookup(rows, rows.groupBy("repo_id").agg(slices), "repo_id", [c for c in rows.columns if c != "repo_id"])
    dealt = counted.withColumn("_slice", F.pmod(F.xxhash64(*rows.columns), F.col("_slices")).cast("int")).drop("_slices")
    # names of their own keep the two sides apart
    dealt_to = dealt.select(F.col("repo_id").alias("_repo"), F.col("_slice").alias("_copy")).distinct()
    own = parts.select(F.col("repo_id").alias("_repo"), "part_no", "text")
    copies = dealt_to.join(own, "_repo")

    def step(key, some: pd.DataFrame, tree: pd.DataFrame) -> pd.DataFrame:
        text = "".join(tree.sort_values("part_no")["text"])
        return use(some.drop(columns="_slice"), text)

    return dealt.groupBy("repo_id", "_slice").cogroup(copies.groupBy("_repo", "_copy")).applyInPandas(step, schema)
