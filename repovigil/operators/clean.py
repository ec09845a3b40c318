"""Corpus cleaning: path, size and framework filters over ``files(repo_id, ord, path, content)``.

The filters are literal expressions, not a join with the settings: the shared part of every
framework's rules runs in the scan, before the repository's framework is known, so that rows no
framework keeps never reach a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repovigil.functions.skew import salted_lookup
from repovigil.functions.text import contains_any, utf16_length, within_utf16
from repovigil.operators import configs as cfg
from repovigil.operators.detect import detect_frameworks
from repovigil.operators.order import ordered_positions
from repovigil.session import written

MAX_FILE_UNITS = 1024 * 1024


def strip_first_dir(files: DataFrame) -> DataFrame:
    """Drop the first path segment; a path of one segment stays as it is."""
    slash = F.instr("path", "/")
    return files.withColumn("path", F.when(slash > 0, F.expr("substring(path, instr(path, '/') + 1)")).otherwise(F.col("path")))


def drop_empty_path(files: DataFrame) -> DataFrame:
    return files.filter(F.col("path") != "")


def quick_ignore(files: DataFrame) -> DataFrame:
    """Drop dependency and build output directories by path alone."""
    return files.filter(~contains_any(F.lower("path"), cfg.QUICK_IGNORE))


def size_cap(files: DataFrame, max_units: int = MAX_FILE_UNITS) -> DataFrame:
    return files.filter(within_utf16(F.col("content"), max_units))


def with_size(files: DataFrame) -> DataFrame:
    return files.withColumn("size", utf16_length(F.col("content")))


def _alternatives(entries: list[str]) -> str:
    return "(?:" + "|".join(re.escape(e) for e in dict.fromkeys(entries)) + ")"


def _dir_pattern(dirs: list[str]) -> str:
    # "/d" anywhere covers "/d/"; the root has no leading slash and needs "d/".
    return f"^{_alternatives(dirs)}/|/{_alternatives(dirs)}"


def _name_pattern(names: list[str]) -> str:
    return f"(?:^|/){_alternatives(names)}$"


def _file_pattern(patterns: list[str]) -> str:
    suffixes = [p[1:] for p in patterns if p.startswith("*")]
    names = [p for p in patterns if not p.startswith("*")]
    return f"{_alternatives(suffixes)}$|{_name_pattern(names)}"


def _extension_pattern(extensions: list[str]) -> str:
    # Only the part from the last dot counts: an entry with two dots never matches.
    return _alternatives([e for e in extensions if e.count(".") == 1]) + "$"


_CONFIGS = {
    fw: {
        "dirs": _dir_pattern(dirs),
        "files": _file_pattern(files),
        "special": _name_pattern(special),
        "extensions": _extension_pattern(extensions),
    }
    for fw, extensions, special, dirs, files, _ in cfg.config_rows()
}


def _matches(path: Column, framework: Column, *parts: str) -> Column:
    """Does the path match any of the framework's patterns? Unlisted names are ``unknown``.

    One compiled pattern per framework keeps the generated code small; a chain of comparisons
    over the same lists outgrows a JVM method.
    """
    low = F.lower(path)
    pattern = {fw: "|".join(rules[p] for p in parts) for fw, rules in _CONFIGS.items()}
    chosen = F.when(framework == cfg.FRAMEWORKS[0], low.rlike(pattern[cfg.FRAMEWORKS[0]]))
    for fw in cfg.FRAMEWORKS[1:-1]:
        chosen = chosen.when(framework == fw, low.rlike(pattern[fw]))
    return chosen.otherwise(low.rlike(pattern["unknown"]))


def dropped_by_dir(path: Column, framework: Column) -> Column:
    return _matches(path, framework, "dirs")


def dropped_by_file(path: Column, framework: Column) -> Column:
    return _matches(path, framework, "files")


def is_special(path: Column, framework: Column) -> Column:
    return _matches(path, framework, "special")


def has_extension(path: Column, framework: Column) -> Column:
    return _matches(path, framework, "extensions")


def kept(path: Column, framework: Column) -> Column:
    """The whole framework filter for one file."""
    return ~_matches(path, framework, "dirs", "files") & _matches(path, framework, "special", "extensions")


def kept_by_some(path: Column) -> Column:
    """False only if every framework drops the path; needs no framework."""
    low = F.lower(path)
    drop = f"{_dir_pattern(cfg.BASE_IGNORE_DIRS)}|{_file_pattern(cfg.BASE_IGNORE_FILES)}"
    names = cfg.BASE_SPECIAL_FILES + [n for extra in cfg.EXTRA_SPECIAL_FILES.values() for n in extra]
    extensions = cfg.BASE_EXTENSIONS + [e for extra in cfg.EXTRA_EXTENSIONS.values() for e in extra]
    return ~low.rlike(drop) & low.rlike(f"{_name_pattern(names)}|{_extension_pattern(extensions)}")


def resolve_framework(detected: DataFrame, forced: DataFrame | None, keep_unknown: bool) -> DataFrame:
    """Let a caller's choice ``forced(repo_id, framework)`` replace the detected framework.

    ``keep_unknown`` is the rule for pre-extracted files, where even ``unknown`` is a choice; for
    archives ``unknown`` means "detect".
    """
    if forced is None:
        return detected
    choice = forced.select("repo_id", F.col("framework").alias("_forced"))
    usable = F.col("_forced").isNotNull() & (F.col("_forced") != "")
    if not keep_unknown:
        usable = usable & (F.col("_forced") != "unknown")
    return detected.join(choice, "repo_id", "left").select(
        "repo_id",
        F.when(usable, F.col("_forced")).otherwise(F.col("framework")).alias("framework"),
        F.when(usable, F.lit("high")).otherwise(F.col("confidence")).alias("confidence"),
        F.when(usable, F.array(F.lit("Manually specified"))).otherwise(F.col("indicators")).alias("indicators"),
    )


def filter_files(files: DataFrame, frameworks: DataFrame) -> DataFrame:
    """Files kept under their repository's framework.

    Rows that no framework keeps are dropped in the scan. The others meet one row per repository:
    by broadcast while that table is small, in salted slices beyond that, so that a repository
    with most of the files is spread like any other rows.
    """
    some = files.filter(kept_by_some(F.col("path")))
    judged = salted_lookup(some, frameworks.select("repo_id", "framework"), "repo_id", ["ord", "path"])
    return judged.filter(kept(F.col("path"), F.col("framework")))


def cleaning_stats(files: DataFrame, frameworks: DataFrame) -> DataFrame:
    """Per repository: rows entering detection, rows kept, and the difference.

    Files are counted under every framework in the scan, and the one that applies is picked per
    repository: the count combines map-side, and no file row is shuffled to learn its framework.
    """
    path = F.col("path")
    counted = files.groupBy("repo_id").agg(
        F.count("*").alias("total"),
        *[F.count_if(kept_by_some(path) & kept(path, F.lit(fw))).alias(fw) for fw in cfg.FRAMEWORKS],
    )
    known = F.when(F.col("framework").isin(cfg.FRAMEWORKS), F.col("framework")).otherwise(F.lit("unknown"))
    by_name = F.create_map(*[x for fw in cfg.FRAMEWORKS for x in (F.lit(fw), F.col(fw))])
    return (
        counted.join(frameworks.select("repo_id", "framework"), "repo_id", "left")
        .withColumn("included", F.element_at(by_name, known))
        .select("repo_id", "total", "included", (F.col("total") - F.col("included")).alias("ignored"))
    )


def clean_files(files: DataFrame, forced: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pre-extracted files -> (kept files, frameworks, stats)."""
    frameworks = resolve_framework(detect_frameworks(files), forced, keep_unknown=True)
    return filter_files(files, frameworks), frameworks, cleaning_stats(files, frameworks)


def in_path_order(kept: DataFrame) -> DataFrame:
    """``(repo_id, ord, path, entry)``: kept files with ``ord`` their place in path order, ``entry`` their old one.

    Trees and lookups that take this table follow the cleaned list's order; texts are not moved for it.
    """
    rows = kept.select("repo_id", F.col("ord").alias("entry"), "path")
    return ordered_positions(rows, ["repo_id"], [F.collate("path", "UNICODE"), F.col("entry")], "ord").select(
        "repo_id", "ord", "path", "entry"
    )


def admit_entries(entries: DataFrame, strip: bool = False, max_units: int = MAX_FILE_UNITS) -> DataFrame:
    """Archive entries that enter detection: path rules first, content size last."""
    rows = strip_first_dir(entries) if strip else entries
    return rows.transform(drop_empty_path).transform(quick_ignore).transform(size_cap, max_units)


def clean_archives(
    entries: DataFrame | Iterable[DataFrame],
    forced: DataFrame | None = None,
    strip: bool = False,
    max_units: int = MAX_FILE_UNITS,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Archive entries -> (kept files, frameworks, stats).

    Admitted entries are written once, so that detection, filter and counts do not inflate archives again; of entries
    that come in several tables, one after the other.
    """
    tables = [entries] if isinstance(entries, DataFrame) else entries
    files = written((admit_entries(table, strip, max_units) for table in tables), "entries")
    frameworks = resolve_framework(detect_frameworks(files), forced, keep_unknown=False)
    return filter_files(files, frameworks), frameworks, cleaning_stats(files, frameworks)
