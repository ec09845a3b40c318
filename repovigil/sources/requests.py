"""Admission of analysis requests, and archive addresses for repository links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Messages, address format, default branches.
NO_FILES = "No files provided for analysis"
NO_FRAMEWORK = "Framework detection result is required"
NO_URL = "GitHub URL is required"
BAD_URL = "Invalid GitHub URL format"
ARCHIVE_URL = "https://github.com/%s/%s/archive/refs/heads/%s.zip"
DEFAULT_BRANCHES = ["main", "master"]


def admit_requests(requests: DataFrame, files: DataFrame) -> DataFrame:
    """``requests(repo_id, framework)`` with ``file_count`` and ``error``; paths only are counted."""
    counts = files.groupBy("repo_id").agg(F.count("*").alias("file_count"))
    joined = requests.join(counts, "repo_id", "left").withColumn("file_count", F.coalesce("file_count", F.lit(0)))
    return joined.withColumn(
        "error",
        F.when(F.col("file_count") == 0, NO_FILES).when(F.coalesce("framework", F.lit("")) == "", NO_FRAMEWORK),
    )


def archive_requests(urls: DataFrame) -> DataFrame:
    """``urls(url, branch, ...)`` -> one row per address to try, or one with ``error``.

    The last two segments are owner and repository. The second default branch is tried only where
    no branch was given.
    """
    parts = F.split(F.regexp_replace("url", r"\.git$", ""), "/")
    owner, repo = F.get(parts, F.size(parts) - 2), F.get(parts, F.size(parts) - 1)
    blank = F.coalesce("url", F.lit("")) == ""
    bad = F.coalesce(owner, F.lit("")).eqNullSafe("") | F.coalesce(repo, F.lit("")).eqNullSafe("")
    error = F.when(blank, NO_URL).when(bad, BAD_URL)
    given = F.coalesce("branch", F.lit("")) != ""
    branches = (
        F.when(error.isNotNull(), F.array(F.lit(None).cast("string")))
        .when(given, F.array("branch"))
        .otherwise(F.array(*[F.lit(b) for b in DEFAULT_BRANCHES]))
    )
    ok = error.isNull()
    return urls.select(
        *urls.columns,
        F.when(ok, owner).alias("owner"),
        F.when(ok, repo).alias("repo"),
        error.alias("error"),
        F.posexplode(branches).alias("_at", "try_branch"),
    ).select(
        *urls.columns,
        "owner",
        "repo",
        F.when(F.col("error").isNull(), F.col("_at") + 1).cast("bigint").alias("try_no"),
        F.when(F.col("error").isNull(), F.format_string(ARCHIVE_URL, "owner", "repo", "try_branch")).alias("archive_url"),
        "error",
    )
