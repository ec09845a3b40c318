"""Tables of already extracted files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FILE_SCHEMA = "repo_id string, ord bigint, path string, content string"


def read_files(spark: SparkSession, location: str, form: str = "parquet") -> DataFrame:
    """``files(repo_id, ord, path, content)``; the schema is given, so JSON is not scanned twice."""
    return spark.read.schema(FILE_SCHEMA).format(form).load(location)
