"""Session helpers: a local session for tests and benches, and the shared folder used to cut lineage."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(name: str = "skein", cores: str = "8", partitions: int = 8) -> SparkSession:
    """A local session with the settings that the tests and ``bench.py`` use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """A new place below the folder that the cluster shares, ``spark.checkpoint.dir``.

    Where that is unset and everything runs in one process, as in tests, it is a temporary one that goes with the process.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="skein-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return f"{folder}/skein-{uuid.uuid4().hex}"


def checkpointed(frame: DataFrame) -> DataFrame:
    """Cut the lineage of ``frame`` with a reliable checkpoint.

    The folder is the cluster's ``spark.checkpoint.dir``; only where that is unset (tests on one machine) is a
    temporary one made. ``localCheckpoint`` is never used: it does not survive the loss of an executor.
    """
    spark = frame.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or shared_folder(spark))
    return frame.checkpoint()
