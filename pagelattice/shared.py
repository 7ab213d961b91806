"""Tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or the session's own
    checkpoint folder. Only on a purely local master, and only where neither is set, a folder
    of this machine is made and set instead."""
    sc = spark.sparkContext
    own = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    found = spark.conf.get("spark.checkpoint.dir", None) or own
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="pagelattice-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession) -> str:
    """A path in the shared folder that nothing else has."""
    return f"{shared_dir(spark)}/pagelattice-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """``df`` written as a table to the shared folder and read again: a cut lineage that
    survives the loss of executors. ``clear`` removes the tables."""
    path = new_path(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> int:
    """Removes the tables written by this package to the shared folder, when no result that
    reads them is needed any more; how many there were."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(path, "pagelattice-*")) or []
    for f in found:
        fs.delete(f.getPath(), True)
    return len(found)
