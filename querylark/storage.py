"""A folder for tables between steps that every executor reaches."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, prefix: str = "querylark-index") -> str:
    """A new folder under spark.checkpoint.dir; a path without scheme is one of Hadoop's default file system. Where it is unset, a local
    master gets a local folder that goes when Python ends, and a cluster is refused."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="querylark-")
        atexit.register(shutil.rmtree, root[7:], True)
        spark.conf.set("spark.checkpoint.dir", root)
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return f"{path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()}/{prefix}-{uuid.uuid4().hex}"
