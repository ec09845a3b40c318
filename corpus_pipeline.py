"""From raw documents to token ids: the five stages of the corpus pipeline.

Every stage takes (spark, docs, sf_dir) with the columns of ``documents`` and returns them, but for the
last, which returns token ids. ``run`` writes each result as Parquet and reads it for the next stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repovigil.llm import bpe, cotrain, decontaminate, jaccard, lines
from repovigil.llm.common import table
from repovigil.llm.queries import WORD_BPE
from repovigil.session import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Rows of text that a Python worker gets at once. Workers live through all stages and keep the memory of
#: their largest batches.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier holds for good; junk and toxic texts go."""
    small_batches(spark)
    model = cotrain.fit(docs, table(spark, sf_dir, "labels"))
    return cotrain.keep_good(docs, model, COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the lines that ten or more different texts share.

    Equal texts count once here: the next stage leaves one of them, with its lines.
    """
    small_batches(spark)
    kept = lines.drop_frequent_lines(docs, keep=("lang", "source"), count_copies=False)
    return kept.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of similarity 0.8 over five-word shingles make."""
    small_batches(spark)
    return jaccard.keep_one(docs, COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of ten words of a benchmark item (or a whole shorter item)."""
    small_batches(spark)
    found = decontaminate.find_benchmark(
        docs, table(spark, sf_dir, "benchmark"), keep=("lang", "source", "n_chars")
    )
    return found.where(F.size("starts") == 0).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, decoded) of all documents left."""
    small_batches(spark)
    return bpe.encode(docs, WORD_BPE)


STAGES = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

#: A trained classifier decides in the first stage, so SQL cannot say what stays.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
