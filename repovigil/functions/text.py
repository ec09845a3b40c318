"""String expressions: paths, sizes, templates. All JVM-side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 code units; ``length`` counts an astral character once, this twice."""
    return (F.length(F.encode(text, "UTF-16BE")) / 2).cast("bigint")


def within_utf16(text: Column, limit: int) -> Column:
    """``utf16_length(text) <= limit``; text is re-encoded only when its bytes leave it open."""
    return (F.octet_length(text) <= limit) | (utf16_length(text) <= limit)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def last_suffix(name: Column) -> Column:
    """From the last dot on; empty if there is no dot."""
    return F.regexp_extract(name, r"(\.[^.]*)$", 1)


def strip_leading(path: Column) -> Column:
    """Drop one leading ``./`` or ``/``."""
    return F.regexp_replace(path, r"^\.?/", "")


def joined(texts: Column, sep: str) -> Column:
    return F.array_join(texts, sep)


def ends_with_any(text: Column, suffixes: list[str]) -> Column:
    return any_of([text.endswith(s) for s in suffixes])


def contains_any(text: Column, needles: list[str]) -> Column:
    return any_of([text.contains(n) for n in needles])
