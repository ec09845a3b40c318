"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 16


def salted_lookup(rows: DataFrame, lookup: DataFrame, key: str, spread: list[str], how: str = "inner") -> DataFrame:
    """Join ``rows`` with a narrow table of one row per ``key``, in ``SALTS`` slices per key.

    ``spread`` names columns that differ between the rows of one key. The slice is a hash of
    them and not a random number, so a repeated task puts a row where it was before. ``lookup``
    is repeated per slice, so it should be small against ``rows``; below the broadcast threshold
    the join is a broadcast as ever.
    """
    sliced = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int"))
    copies = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return sliced.join(copies, [key, "_salt"], how).drop("_salt")
