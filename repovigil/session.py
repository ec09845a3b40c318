"""Session helpers: a local session for tests and bench, and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str | int = "*", app: str = "repovigil", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    partitions = str(cpus) if str(cpus).isdigit() else "8"
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # no call site per column expression: it costs more than building the plan
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, for sessions whose executors do not have it installed."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    # the driver serves the file to the executors; nothing is read from this folder elsewhere
    archive = os.path.join(tempfile.mkdtemp(prefix="repovigil-"), "repovigil_package.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in sorted(os.walk(package)):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(package)))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    A scratch folder is made only where the setting is absent and the session is local: a
    machine-local folder would be lost with its executor on a cluster.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="repovigil-")
    spark.sparkContext.setCheckpointDir(made)  # found again by the next call
    return spark.sparkContext.getCheckpointDir()


def fresh_dir(spark: SparkSession, purpose: str) -> str:
    """A new, not yet existing path below the shared folder."""
    _MADE.append(f"{shared_dir(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}")
    return _MADE[-1]


_MADE: list[str] = []


def remove_intermediate(spark: SparkSession) -> int:
    """Delete the folders that this process has written intermediate tables to; returns their number.

    For the end of a run, when results are written: DataFrames that read such tables no longer work.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    removed = 0
    while _MADE:
        path = hadoop(_MADE.pop())
        removed += path.getFileSystem(conf).delete(path, True)
    return removed


def materialize(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` in the shared folder and cut its lineage.

    Used between rounds of an iteration and wherever a value must not be computed twice (model
    answers, sampled partition bounds). A lost executor costs its running tasks only.
    """
    spark = df.sparkSession
    folder = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def written(df: DataFrame | Iterable[DataFrame], purpose: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it from there.

    For wide tables that several later steps read in part: they scan only their columns, and the
    table's size is known to the join planner. Several tables of one schema are written into one, in turns.
    """
    folder = None
    for part in [df] if isinstance(df, DataFrame) else df:
        spark, schema = part.sparkSession, part.schema
        folder = folder or fresh_dir(spark, purpose)
        part.write.mode("append").parquet(folder)
    return spark.read.schema(schema).parquet(folder)
