"""Reading code archives: one binary row per archive in, one row per entry out."""

from __future__ import annotations

import io
import os
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repovigil.operators import configs

# Archive limit and accepted upload types.
MAX_ARCHIVE_BYTES = 50 * 1024 * 1024
ZIP_TYPES = ["application/zip", "application/x-zip-compressed"]
TOO_LARGE = "Repository is too large (max 50MB)"
NOT_ZIP = "Only .zip files are allowed"

ENTRY_SCHEMA = "repo_id string, ord bigint, path string, content string"
ENTRY_COLUMNS = ["repo_id", "ord", "path", "content"]
MAX_FILE_UNITS = 1024 * 1024
OUTPUT_CHARS = 4 * 1024 * 1024
#: Archives of one turn: the driver holds a few kilobytes for each file of a scan.
LISTED = 20_000


def gate_errors(length: Column, name: Column | None = None, mimetype: Column | None = None) -> Column:
    """Why an archive is refused, or null. The limit itself is allowed."""
    error = F.when(length > MAX_ARCHIVE_BYTES, TOO_LARGE)
    if name is not None:
        kind = F.coalesce(mimetype.isin(ZIP_TYPES), F.lit(False)) if mimetype is not None else F.lit(False)
        error = F.when(~kind & ~name.endswith(".zip"), NOT_ZIP).otherwise(error)
    return error


def archive_gate(archives: DataFrame) -> DataFrame:
    """``archives(name, mimetype, length)`` with ``error``; refused rows stay in the table."""
    return archives.withColumn("error", gate_errors(F.col("length"), F.col("name"), F.col("mimetype")))


def _hidden(name: str) -> bool:
    """Files and folders that Spark's own listing passes over."""
    odd = name.startswith(".") or name.endswith("._COPYING_") or name.startswith("_") and "=" not in name
    return odd and not name.startswith(("_common_metadata", "_metadata"))


def _entries_of(fs, jvm, folder: str) -> Iterator[tuple[str, bool]]:
    """(name, whether it is a folder) of what lies in a folder, as it is read."""
    if fs.getUri().getScheme() == "file":  # Hadoop lists a local folder whole
        with os.scandir(jvm.org.apache.hadoop.fs.Path(folder).toUri().getPath()) as found:
            for entry in found:
                yield entry.name, entry.is_dir()
        return
    found = fs.listStatusIterator(jvm.org.apache.hadoop.fs.Path(folder))
    while found.hasNext():
        status = found.next()
        yield status.getPath().getName(), status.isDirectory()


def listed(spark: SparkSession, folder: str, most: int) -> Iterator[list[str]]:
    """Paths of all files below a folder, at most ``most`` at a time."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    waiting, paths = [fs.makeQualified(path).toString()], []
    while waiting:
        where = waiting.pop()
        for name, is_dir in _entries_of(fs, jvm, where):
            if _hidden(name):
                continue
            if is_dir:
                waiting.append(f"{where}/{name}")
                continue
            paths.append(f"{where}/{name}")
            if len(paths) == most:
                yield paths
                paths = []
    if paths:
        yield paths


def _binary_files(spark: SparkSession, folder: str, paths: list[str] | None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if paths is None:
        return reader.load(folder)
    parallel = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    settings = {
        # else there is a task for each file
        parallel: str(min(int(spark.conf.get(parallel)), 4 * spark.sparkContext.defaultParallelism)),
        # no listing is asked for twice, and the session would keep them all
        "spark.sql.hive.filesourcePartitionFileCacheSize": "0",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        return reader.option("__globPaths__", "false").load(paths)  # names are no patterns
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def scan_archives(spark: SparkSession, folder: str, paths: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """``(accepted, refused)`` files of a folder as ``(repo_id, length, content)`` and ``(repo_id, length, error)``.

    ``repo_id`` is the path below ``folder`` without ``.zip``, so equal names in different folders stay
    apart. Name and size tests are predicates of the scan: bytes of refused files are not read. Of ``paths`` only
    these files of the folder are scanned.
    """
    found = _binary_files(spark, folder, paths)
    below = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", folder).rstrip("/") + "/"
    inside = F.expr("substring(path, instr(path, {0}) + length({0}))".format("'" + below.replace("'", "\\'") + "'"))
    error = gate_errors(F.col("length"), F.col("path"))
    rows = found.withColumns({"repo_id": F.regexp_replace(inside, r"\.zip$", ""), "error": error})
    accepted = rows.filter(F.col("error").isNull()).select("repo_id", "length", "content")
    return accepted, rows.filter(F.col("error").isNotNull()).select("repo_id", "length", "error")


def _skip(path: str, strip: bool) -> bool:
    shown = path.split("/", 1)[1] if strip and "/" in path else path
    low = shown.lower()
    return not shown or any(part in low for part in configs.QUICK_IGNORE)


def unpack_archives(archives: DataFrame, strip: bool = False, max_units: int = MAX_FILE_UNITS) -> DataFrame:
    """``(repo_id, content)`` zip rows -> ``(repo_id, ord, path, content)`` text entries.

    Entries come in directory order. Ignored directories are skipped by name before anything is
    inflated, because no filter reaches into a Python reader; so are entries whose header says
    that they exceed the size cap: a text needs at most three bytes per UTF-16 unit. Unreadable
    entries and archives are skipped. Bytes that are not UTF-8 become replacement characters.
    """
    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, size = [], 0  # of many small archives together
            for repo_id, content in zip(batch["repo_id"], batch["content"]):
                try:
                    archive = zipfile.ZipFile(io.BytesIO(content))
                except zipfile.BadZipFile:
                    continue
                for ord_, entry in enumerate(archive.infolist()):
                    if entry.is_dir() or entry.file_size > 3 * max_units or _skip(entry.filename, strip):
                        continue
                    try:
                        text = archive.read(entry).decode("utf-8", errors="replace")
                    except Exception:  # one broken entry does not end the archive
                        continue
                    rows.append((repo_id, ord_, entry.filename, text))
                    size += len(text)
                    if size > OUTPUT_CHARS:  # hand on what is inflated; a large archive never sits in memory whole
                        yield pd.DataFrame(rows, columns=ENTRY_COLUMNS)
                        rows, size = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=ENTRY_COLUMNS)

    return archives.select("repo_id", "content").mapInPandas(unpack, ENTRY_SCHEMA)


def read_archives(
    spark: SparkSession, folder: str, strip: bool = False, max_units: int = MAX_FILE_UNITS
) -> DataFrame:
    """All entries of the accepted archives below ``folder``; pass a cleaning's own ``max_units`` on.

    One table, so the driver knows all files at once; ``archive_turns`` is for folders of more than it can hold.
    """
    accepted, _ = scan_archives(spark, folder)
    return unpack_archives(accepted, strip, max_units)


def archive_turns(
    spark: SparkSession, folder: str, strip: bool = False, max_units: int = MAX_FILE_UNITS
) -> Iterator[DataFrame]:
    """``read_archives`` of a folder of any size, in tables of ``LISTED`` archives: the driver lists and plans one at a time."""
    none = True
    for paths in listed(spark, folder, LISTED):
        none = False
        accepted, _ = scan_archives(spark, folder, paths)
        # few files a turn: what reads the tables later lists them again
        yield unpack_archives(accepted, strip, max_units).coalesce(spark.sparkContext.defaultParallelism)
    if none:
        yield read_archives(spark, folder, strip, max_units)
