"""Where derived tables go: one folder that the driver and all executors share."""

from __future__ import annotations

import getpass
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Only where that is unset and master and executors are one process a folder
    under /tmp is set and used; on several machines its absence is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
        found = f"file:///tmp/symsift-{getpass.getuser()}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the driver ends."""
    folder = f"{shared_dir(spark)}/symsift/{uuid.uuid4().hex}"
    fs, p = _fs(spark, folder)
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return f"{folder}/{name}"


def discard(spark: SparkSession, path: str) -> None:
    """Remove what ``scratch`` gave, now."""
    fs, p = _fs(spark, path.rpartition("/")[0])
    fs.delete(p, True)
