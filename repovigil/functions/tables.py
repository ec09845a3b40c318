"""Constant tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (int, float)):
        return str(value)
    if isinstance(value, (list, tuple)):
        return "array(" + ", ".join(map(_literal, value)) + ")" if value else "CAST(array() AS array<string>)"
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def constant_table(spark: SparkSession, columns: list[str], rows: list[tuple]) -> DataFrame:
    """A short constant list as a table that lives in the plan, of known size and without a job."""
    values = ", ".join("(" + ", ".join(map(_literal, row)) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(columns)})")
