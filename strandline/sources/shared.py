"""Cutting lineage in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; one of our own only where none is set and Spark runs in one process."""
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="checkpoint-")
    context.setCheckpointDir(named)
    return passing(spark, context._jsc.sc().getCheckpointDir().get())


def passing(spark: SparkSession, path: str) -> str:
    """``path``, which is deleted when the driver's Python ends."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def delete() -> None:
        with contextlib.suppress(Exception):  # the JVM may be gone already, and its files with the cluster
            files.delete(where, True)

    atexit.register(delete)
    return path


def shared_checkpoint(frame: DataFrame) -> DataFrame:
    """``frame``, written once to the shared folder and read from there afterwards."""
    ensure_checkpoint_dir(frame.sparkSession)
    return frame.checkpoint()


#: Bytes of an Arrow batch that goes to a Python worker; a longer row is a batch by itself.
BATCH = 4 << 20


def bounded_batches(spark: SparkSession) -> SparkSession:
    """Bounds Arrow batches by bytes, unless the session has a bound: by default 10,000 rows of any length are held at once."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark._jsparkSession.sessionState().conf().contains(key):
        spark.conf.set(key, str(BATCH))
    return spark


def importable(spark: SparkSession) -> SparkSession:
    """Lets Python workers started from now on import this package from where the driver has it, in batches of bounded bytes.

    A cluster gets the package with --py-files or from its image; this is for workers that see the driver's path.
    """
    bounded_batches(spark)
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    held = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in held.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, held) if x)
    return spark
