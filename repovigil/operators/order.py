"""Positions in an ordered group, without pulling a group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repovigil.session import materialize


def ordered_positions(df: DataFrame, group: list[str], order: list[Column], name: str = "pos") -> DataFrame:
    """Add ``name``: 0-based rank of each row inside ``group`` under a total ``order``.

    A plain ``row_number`` sorts a whole group in one task. Here the rows are range partitioned
    on (group, order), so a large group spreads over many partitions; the partition number is
    stored with the rows (the sampled bounds must not be drawn twice), rows are ranked inside
    (group, partition), and the counts of the earlier partitions are added. Pass narrow rows.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) for c in group]
    placed = materialize(
        df.repartitionByRange(parts, *keys, *order).withColumn("_part", F.spark_partition_id())
    )
    counts = placed.groupBy(*group, "_part").agg(F.count("*").alias("_rows"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, "_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy(*group, "_part").orderBy(*order)) - 1
    return (
        placed.withColumn("_local", local)
        .join(offsets, [*group, "_part"])
        .withColumn(name, (F.col("_before") + F.col("_local")).cast("bigint"))
        .drop("_part", "_local", "_before")
    )
