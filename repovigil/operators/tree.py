"""Project trees: the nodes of every repository's directory tree, and its rendered lines.

A rendered tree is a table of lines, not one string per repository, so that a repository with a
third of all files is spread over tasks like any other rows. ``tree_text`` folds the lines of
each tree into one string for prompts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repovigil.operators.order import ordered_positions

# Depth limit and line art of the rendered tree.
TREE_DEPTH = 10
BRANCH, LAST_BRANCH, BAR, GAP = "├── ", "└── ", "│   ", "    "
TRUNCATED = "/..."
# Names that are whole numbers below this come first among siblings, in numeric order.
NUMERIC_NAME_LIMIT = 4294967295
CHUNK_LINES = 5000


def _path_nodes(files: DataFrame, max_depth: int) -> DataFrame:
    """One row per file and level; a path below ``max_depth`` ends in a ``part/...`` leaf."""
    parts = F.split("path", "/")
    cut = (
        files.select("repo_id", "ord", parts.alias("parts"))
        .withColumn(
            "parts",
            F.when(F.size("parts") <= max_depth, F.col("parts")).otherwise(
                F.concat(
                    F.slice("parts", 1, max_depth - 1),
                    F.array(F.concat(F.element_at("parts", max_depth), F.lit(TRUNCATED))),
                )
            ),
        )
    )
    return cut.select(
        "repo_id", "ord", "parts", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("level")
    ).select(
        "repo_id",
        "ord",
        "level",
        F.array_join(F.slice(F.col("parts"), F.lit(1), F.col("level")), "/").alias("node"),
        F.array_join(F.slice(F.col("parts"), F.lit(1), F.col("level") - 1), "/").alias("parent"),
        F.element_at(F.col("parts"), F.col("level")).alias("name"),
        (F.col("level") == F.size("parts")).alias("leaf"),
    )


def _drop_overwritten(rows: DataFrame) -> DataFrame:
    """Where a path is a file and a directory, a later file entry removes what was below it."""
    clashes = (
        rows.groupBy("repo_id", "node")
        .agg(F.max(F.when(F.col("leaf"), F.col("ord"))).alias("written"), F.bool_or(~F.col("leaf")).alias("has_dir"))
        .filter(F.col("has_dir") & F.col("written").isNotNull())
        .select("repo_id", "node", "written")
    )
    cuts = (
        rows.filter(~F.col("leaf"))
        .join(clashes, ["repo_id", "node"])
        .filter(F.col("ord") < F.col("written"))
        .groupBy("repo_id", "ord")
        .agg(F.min("level").alias("cut"))
    )
    return rows.join(cuts, ["repo_id", "ord"], "left").filter(F.col("cut").isNull() | (F.col("level") <= F.col("cut")))


def project_tree_nodes(files: DataFrame, max_depth: int = TREE_DEPTH) -> DataFrame:
    """``(repo_id, node, parent, name, level, ord, leaf)``; ``ord`` is where the node first appears."""
    rows = _drop_overwritten(_path_nodes(files, max_depth))
    return rows.groupBy("repo_id", "node").agg(
        F.first("parent").alias("parent"),
        F.first("name").alias("name"),
        F.first("level").alias("level"),
        F.min("ord").alias("ord"),
        F.bool_and("leaf").alias("leaf"),
    )


def _sibling_key():
    # try_cast keeps over-long digit strings out instead of failing
    number = F.expr("try_cast(name AS BIGINT)")
    numeric = F.col("name").rlike("^(0|[1-9][0-9]*)$") & (number < NUMERIC_NAME_LIMIT)
    rank = F.coalesce(numeric, F.lit(False))
    return F.struct(
        F.when(rank, 0).otherwise(1).alias("kind"), F.when(rank, number).otherwise(F.col("ord")).alias("at")
    )


def render_tree(files: DataFrame, max_depth: int = TREE_DEPTH) -> DataFrame:
    """``(repo_id, line_no, line)``: the tree of each repository, one row per line.

    Siblings need no ranking: the last child of each parent is an aggregate, and lines are
    ordered by the sibling keys along their path.
    """
    nodes = project_tree_nodes(files, max_depth).withColumn("key", _sibling_key())
    last = nodes.groupBy("repo_id", "parent").agg(F.max_by("node", "key").alias("node")).select(
        "repo_id", "node", F.lit(True).alias("is_last")
    )
    marked = nodes.join(last, ["repo_id", "node"], "left").withColumn("is_last", F.col("is_last").isNotNull())
    step = F.struct("level", "key", "is_last")
    above = marked.filter(F.col("level") < max_depth).select("repo_id", F.col("node").alias("above"), step.alias("step"))
    parts = F.split("node", "/")
    climbed = marked.filter(F.col("level") > 1).select(
        "repo_id",
        "node",
        F.explode(
            F.transform(F.sequence(F.lit(1), F.col("level") - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
        ).alias("above"),
    )
    ancestors = (
        climbed.join(above, ["repo_id", "above"])
        .groupBy("repo_id", "node")
        .agg(F.array_sort(F.collect_list("step")).alias("steps"))  # at most max_depth - 1 entries
    )
    own = F.struct(F.col("level"), F.col("key"), F.col("is_last"))
    lines = marked.join(ancestors, ["repo_id", "node"], "left").select(
        "repo_id",
        F.concat(
            F.transform(F.coalesce("steps", F.array().cast("array<struct<level:int,key:struct<kind:int,at:bigint>,is_last:boolean>>")), lambda s: s["key"]),
            F.array(own["key"]),
        ).alias("keys"),
        F.concat(
            F.coalesce(
                F.array_join(F.transform("steps", lambda s: F.when(s["is_last"], GAP).otherwise(BAR)), ""), F.lit("")
            ),
            F.when(F.col("is_last"), LAST_BRANCH).otherwise(BRANCH),
            F.col("name"),
        ).alias("line"),
    )
    return ordered_positions(lines, ["repo_id"], [F.col("keys")], "line_no").select("repo_id", "line_no", "line")


def _joined(column: str, order: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, column))), lambda x: x[column]), "")


def tree_parts(lines: DataFrame) -> DataFrame:
    """``(repo_id, part_no, text)``: the text of each tree in parts of ``CHUNK_LINES`` lines.

    The form that prompts are made from: no row holds a whole tree (``operators/turns.py``).
    """
    chunk = F.floor(F.col("line_no") / CHUNK_LINES).alias("part_no")
    ended = lines.select("repo_id", "line_no", chunk, F.concat("line", F.lit("\n")).alias("line"))
    return ended.groupBy("repo_id", "part_no").agg(_joined("line", "line_no").alias("text"))


def tree_text(lines: DataFrame) -> DataFrame:
    """``(repo_id, tree, tree_chars)``: the lines of each tree as one text, for trees that fit a row."""
    tree = tree_parts(lines).groupBy("repo_id").agg(_joined("text", "part_no").alias("tree"))
    return tree.withColumn("tree_chars", F.length("tree").cast("bigint"))
