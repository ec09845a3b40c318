"""Writing transcripts and results as partitioned tables."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

log = logging.getLogger(__name__)


RUN_BUCKETS = 64


def write_transcripts(transcripts: DataFrame, folder: str, batch: str) -> bool:
    """JSON rows below ``folder/batch=...`` by agent and a bucket of ``run_id``.

    Writing a batch again replaces it, so a repeated call doubles nothing; the number of folders does not
    grow with the number of runs. A failed write is reported, never raised.
    """
    try:
        bucket = F.pmod(F.xxhash64("run_id"), F.lit(RUN_BUCKETS)).cast("int")
        rows = transcripts.withColumn("run_bucket", bucket)
        rows.write.mode("overwrite").partitionBy("agent", "run_bucket").json(f"{folder}/batch={batch}")
        return True
    except Exception as error:
        log.warning("transcripts not saved: %s", error)
        return False


def write_results(tables: dict[str, DataFrame], folder: str) -> None:
    """One table per part of the result (runs, findings, profiles, checklists, reports).

    The parts share ``run_id`` and carry their order as columns. They are not folded into one
    nested row per run: a run may hold a third of all rows, and a row must fit in one task.
    """
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{folder}/{name}")
