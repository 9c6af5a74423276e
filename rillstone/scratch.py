"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of applications that name none; only for one machine, as in tests.
OWN_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, one of our own
    serves sessions on one machine; any other cluster's tasks would not find each other's files there."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in OWN_DIRS:
        folder = tempfile.mkdtemp(prefix="rillstone-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        OWN_DIRS[app] = f"file://{folder}"
    return OWN_DIRS[app]


def new_folder(spark: SparkSession, label: str) -> str:
    """A name in the shared folder, whose files go when the application ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return a reader of it.

    Cuts the lineage and saves expensive work from being done once for each consumer; a lost
    executor costs only the tasks that were running, as the files are in shared storage. The files
    go when they are released, or else when the application ends.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Delete the files of a materialized frame that nothing will read any more."""
    spark = df.sparkSession
    root = shared_dir(spark)
    jvm = spark._jvm
    for folder in {name.rpartition("/")[0] for name in df.inputFiles()}:
        if "/" + root.rpartition("/")[2] + "/" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
