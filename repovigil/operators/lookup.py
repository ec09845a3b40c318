"""Answering file requests: exact lookup, similar paths, and the message sent back.

Requests are ``(repo_id, request_id, file)``, files are ``(repo_id, ord, path, content)``.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repovigil.functions.text import strip_leading
from repovigil.session import fresh_dir, materialize, written

# Number of suggestions and the three reply formats.
SIMILAR_FILES = 5
AGAIN_HEAD = "You've already read this file. Here it is again:\n\n**File: "
AGAIN_TAIL = "\n```\n\nPlease continue tracing or complete the analysis."
FOUND_HEAD = "**File: "
FOUND_TAIL = (
    "\n```\n\nContinue tracing this endpoint. Request the next file you need, or complete the analysis if you "
    "have enough information."
)
MISSING_HEAD = "File not found: "
MISSING_MIDDLE = "\n\nAvailable files matching pattern:\n"
MISSING_TAIL = (
    '\n\nPlease request a valid file path or respond with {"status": "not_found"} if no more endpoints exist.'
)
# Hash buckets of the rows that were hit, for each of them, and the most there are.
BUCKETS_A_HIT, MOST_BUCKETS = 32, 1 << 20
#: Length of the pieces by which path components are indexed.
GRAM = 3
#: Hash buckets of the pieces that are asked for.
GRAM_BUCKETS = 1 << 18


def first_k(df: DataFrame, group: list[str], k: int, order: str = "ord") -> DataFrame:
    """The first ``k`` rows per group; Spark keeps at most ``k`` per group and task before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= k).drop("_rank")


def lookup_files(requests: DataFrame, files: DataFrame) -> DataFrame:
    """Requests with ``path``, ``content`` and ``found``; an empty file counts as not found.

    The match runs on paths alone. Before texts are shuffled to the rows that were hit, a broadcast of the
    hit rows' hash buckets, ``MOST_BUCKETS`` numbers at most, keeps other texts where they are: with
    ``BUCKETS_A_HIT`` buckets a hit, all but a thirtieth of them up to 32,768 hits, half of them at 700,000. For
    more requests, or for several rounds of them, use a ``TextStore``.
    """
    wanted = requests.withColumn("_key", strip_leading(F.col("file")))
    hits = materialize(
        files.select("repo_id", "ord", strip_leading(F.col("path")).alias("_key"))
        .join(wanted.select("repo_id", "_key"), ["repo_id", "_key"], "left_semi")
        .groupBy("repo_id", "_key")
        .agg(F.min("ord").alias("ord"))
    )
    buckets = min(MOST_BUCKETS, max(1, BUCKETS_A_HIT * hits.count()))
    bucket = F.pmod(F.xxhash64("repo_id", "ord"), F.lit(buckets)).alias("_bucket")
    few = F.broadcast(hits.select(bucket).distinct())
    texts = files.select("repo_id", "ord", "path", "content", bucket).join(few, "_bucket", "left_semi")
    texts = texts.drop("_bucket").join(hits, ["repo_id", "ord"])
    return _answered(wanted, texts)


def _answered(wanted: DataFrame, texts: DataFrame) -> DataFrame:
    return (
        wanted.join(texts.select("repo_id", "_key", "path", "content"), ["repo_id", "_key"], "left")
        .withColumn("found", F.coalesce(F.col("content") != "", F.lit(False)))
        .drop("_key")
    )


@dataclass
class TextStore:
    """Texts in files clustered by repository and path, for any number of lookups.

    ``texts`` is a table bucketed and sorted by ``(repo_id, key)``, the first file of each path; its files take
    part in a join as they lie, so a lookup moves the requests to the texts and never the other way.
    ``paths`` is the narrow index ``(repo_id, ord, path)`` of all files, ``parts`` that of their path components.
    """

    texts: DataFrame
    paths: DataFrame
    parts: DataFrame
    name: str

    @classmethod
    def of(cls, files: DataFrame, buckets: int | None = None) -> TextStore:
        """Write the store in the shared folder: one shuffle of the texts, once.

        A bucket should fit a task; there are as many as shuffle partitions unless told otherwise.
        """
        spark = files.sparkSession
        buckets = max(buckets or 0, int(spark.conf.get("spark.sql.shuffle.partitions")))
        name = f"repovigil_texts_{uuid.uuid4().hex}"
        first = F.row_number().over(Window.partitionBy("repo_id", "_key").orderBy("ord"))
        keyed = files.select("repo_id", "ord", strip_leading(F.col("path")).alias("_key"), "path", "content")
        (
            keyed.repartition(buckets, "repo_id", "_key")
            .withColumn("_nth", first)
            .filter("_nth = 1")
            .drop("_nth")
            .write.bucketBy(buckets, "repo_id", "_key")
            .sortBy("repo_id", "_key")
            .option("path", fresh_dir(spark, "texts"))
            .saveAsTable(name)
        )
        paths = written(files.select("repo_id", "ord", "path"), "paths")
        return cls(spark.table(name), paths, written(path_parts(paths, SIMILAR_FILES), "path-parts"), name)

    def lookup(self, requests: DataFrame) -> DataFrame:
        """As ``lookup_files``."""
        return _answered(requests.withColumn("_key", strip_leading(F.col("file"))), self.texts.hint("merge"))

    def forget(self) -> None:
        """Take the table out of the session's catalog; its files go with the other intermediate data."""
        self.texts.sparkSession.sql(f"DROP TABLE IF EXISTS {self.name}")


def _grams(text: Column, size: int) -> Column:
    """The distinct pieces of ``size`` characters; none of a shorter text."""
    starts = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1))
    return F.coalesce(F.array_distinct(F.transform(starts, lambda at: F.substr(text, at, F.lit(size)))), F.array())


def path_parts(files: DataFrame, k: int) -> DataFrame:
    """``(repo_id, ord, path, part)``: the first ``k`` files of each distinct path component, in lower case."""
    named = files.select("repo_id", "ord", "path", F.explode(F.array_distinct(F.split(F.lower("path"), "/"))).alias("part"))
    return first_k(named, ["repo_id", "part"], k)


def similar_files(
    requests: DataFrame, files: DataFrame, k: int = SIMILAR_FILES, components: DataFrame | None = None
) -> DataFrame:
    """``(repo_id, request_id, ord, path)``: first ``k`` files whose path contains a request segment.

    A segment has no slash, so it lies inside one path component. Distinct components are indexed by
    their pieces of ``GRAM`` characters and fewer, as far as segments ask for them: a row per character, however
    long they are. A segment is met with the components of its rarest piece, which are then searched for the
    whole of it; a segment that is no longer than a piece needs no search. Components stand for their first
    ``k`` files, and no request is ever paired with a whole repository. ``components`` are the ``path_parts`` of
    ``files``, if they are known already.

    Pieces that nobody asks for are dropped where they are made, by a broadcast of the asked ones' hash buckets,
    ``GRAM_BUCKETS`` numbers at most; the few that pass are written once, for counts and matches alike.
    """
    segments = requests.select(
        "repo_id", "request_id", F.explode(F.array_distinct(F.split(F.lower("file"), "/"))).alias("segment")
    )
    asked = segments.select("repo_id", "segment").distinct()
    short = F.length("segment") <= GRAM
    pieces = F.when(short, F.array("segment")).otherwise(_grams(F.col("segment"), GRAM))
    wanted = asked.filter(F.col("segment") != "").select("repo_id", "segment", F.explode(pieces).alias("gram"))

    wanted = materialize(wanted)
    if components is None:
        components = materialize(path_parts(files, k))
    parts = components.select("repo_id", "part").distinct()
    every = F.concat(*[_grams(F.col("part"), size) for size in range(1, GRAM + 1)])
    bucket = F.pmod(F.xxhash64("repo_id", "gram"), F.lit(GRAM_BUCKETS)).alias("_bucket")
    few = F.broadcast(wanted.select(bucket).distinct())
    pieces = parts.select("repo_id", "part", F.explode(every).alias("gram"))
    near = pieces.select("*", bucket).join(few, "_bucket", "left_semi").drop("_bucket")
    postings = written(near.join(wanted.select("repo_id", "gram").distinct(), ["repo_id", "gram"], "left_semi"), "postings")
    counts = postings.groupBy("repo_id", "gram").agg(F.count("*").alias("n"))
    rarest = (
        wanted.join(counts, ["repo_id", "gram"], "left")
        .groupBy("repo_id", "segment")
        .agg(F.min(F.struct("n", "gram"))["gram"].alias("gram"), F.count_if(F.col("n").isNull()).alias("absent"))
        .filter("absent = 0")
        .drop("absent")
    )
    holding = rarest.join(postings, ["repo_id", "gram"]).filter(F.contains("part", "segment"))
    pairs = holding.select("repo_id", "segment", "part").join(components, ["repo_id", "part"])
    # an empty segment is contained in every path
    everywhere = first_k(files.select("repo_id", "ord", "path"), ["repo_id"], k).withColumn("segment", F.lit(""))
    everywhere = everywhere.join(asked, ["repo_id", "segment"], "left_semi")
    # a file may hold a segment in several components
    matched = (
        pairs.select("repo_id", "segment", "ord", "path")
        .unionByName(everywhere)
        .groupBy("repo_id", "segment", "ord")
        .agg(F.first("path").alias("path"))
    )
    by_segment = first_k(matched, ["repo_id", "segment"], k)
    by_request = (
        segments.join(by_segment, ["repo_id", "segment"])
        .groupBy("repo_id", "request_id", "ord")
        .agg(F.first("path").alias("path"))
    )
    return first_k(by_request, ["repo_id", "request_id"], k)


def file_messages(requests: DataFrame, files: DataFrame | TextStore) -> DataFrame:
    """Requests with the reply ``message``: text again, text, or a not-found list.

    ``requests`` also has ``already_read``. With a ``TextStore`` for ``files`` the texts stay where they are.
    """
    stored = isinstance(files, TextStore)
    looked = files.lookup(requests) if stored else lookup_files(requests, files)
    missing = looked.filter(~F.col("found")).select("repo_id", "request_id", "file")
    suggestions = (
        (similar_files(missing, files.paths, components=files.parts) if stored else similar_files(missing, files))
        .groupBy("repo_id", "request_id")
        .agg(F.array_sort(F.collect_list(F.struct("ord", "path"))).alias("similar"))  # at most k entries
    )
    listed = F.coalesce(
        F.array_join(F.transform("similar", lambda s: F.concat(F.lit("- "), s["path"])), "\n"), F.lit("")
    )
    shown = F.concat(F.col("file"), F.lit("**\n```\n"), F.col("content"))
    message = (
        F.when(F.col("found") & F.col("already_read"), F.concat(F.lit(AGAIN_HEAD), shown, F.lit(AGAIN_TAIL)))
        .when(F.col("found"), F.concat(F.lit(FOUND_HEAD), shown, F.lit(FOUND_TAIL)))
        .otherwise(F.concat(F.lit(MISSING_HEAD), F.col("file"), F.lit(MISSING_MIDDLE), listed, F.lit(MISSING_TAIL)))
    )
    return looked.join(suggestions, ["repo_id", "request_id"], "left").select(
        *requests.columns, "path", "content", "found", message.alias("message")
    )
