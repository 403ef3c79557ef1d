"""Session helpers shared by jobs, bench and tests."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "faultline", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings this package relies on. On a cluster the master, memory and
    shuffle settings come from spark-submit; only result-relevant ones are set here."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Gives the tasks this package, for sessions that were not started with it on their path. On a
    cluster, `spark-submit --py-files` does the same."""
    sc = spark.sparkContext
    if getattr(sc, "_faultline_shipped", False):
        return
    root = Path(__file__).resolve().parent.parent
    archive = shutil.make_archive(str(Path(tempfile.mkdtemp(prefix="faultline-code-")) / "faultline"), "zip", root, "faultline")
    sc.addPyFile(archive)
    sc._faultline_shipped = True


def spread(df: DataFrame) -> DataFrame:
    """Evens out a scan that has fewer partitions than the session has cores, before CPU-heavy text
    work. A large table has more files than that and is left alone, so no shuffle is added there."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def side_by_side(*calls: Callable[[], object]) -> list:
    """Results of calls that each run many short jobs, in order. Their jobs share the executors, so none waits for the driver's
    work between the jobs of another."""
    with ThreadPoolExecutor(max(1, len(calls))) as pool:
        running = [pool.submit(inheritable_thread_target(call)) for call in calls]
        return [one.result() for one in running]


def _shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="faultline-checkpoint-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a Parquet table in the folder that the cluster names in
    spark.checkpoint.dir. It survives lost executors and, being columnar, later passes read only the
    columns they need. A folder of our own is used only for a local master with none set."""
    path = f"{_shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
