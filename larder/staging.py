"""Intermediate results as Parquet in the folder that the driver and all executors share.

A staged frame is read back pruned and with statistics, its lineage ends at the files, and a lost executor costs
nothing but the tasks it had. ``spark.checkpoint.dir`` names the folder; ``clear`` removes what an application staged.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session. One is made only for a local master, where driver and executors are one."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="larder-")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/staged-{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{_own_folder(spark)}/{uuid.uuid4().hex}"


def stage(df: DataFrame, codec: str | None = None) -> DataFrame:
    """Write ``df`` once and return it as a scan of what was written. ``codec`` is for frames of long texts, of which Spark's own leaves much."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path, compression=codec)
    staged = df.sparkSession.read.schema(df.schema).parquet(path)
    staged._staged_path = path
    return staged


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(staged: DataFrame) -> None:
    """Delete what ``stage`` wrote for this very frame, once nothing will read it any more: rounds leave one result on disk.

    Spark deletes the shuffle files of a finished job when the driver collects its plan as garbage; a large heap may not do so
    before the disks are full, so it is asked to.
    """
    _delete(staged.sparkSession, staged._staged_path)
    staged.sparkSession._jvm.System.gc()


def clear(spark: SparkSession) -> None:
    """Delete all that this application staged; frames that read it can't be used any more."""
    _delete(spark, _own_folder(spark))
