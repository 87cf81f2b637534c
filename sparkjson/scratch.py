"""Scratch tables on the folder that all executors share; they go when the application ends."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_roots: dict[str, str] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder in ``spark.checkpoint.dir``.

    Only a local session may leave that unset, and gets a temporary folder; on a cluster it is an error.
    """
    app = spark.sparkContext.applicationId
    if app not in _roots:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        root = f"{shared.rstrip('/')}/scratch-{app}-{uuid.uuid4().hex}" if shared else "file://" + tempfile.mkdtemp(prefix="scratch-")
        folder = spark._jvm.org.apache.hadoop.fs.Path(root)
        files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(folder)
        files.deleteOnExit(folder)
        _roots[app] = root
    return f"{_roots[app]}/{name}-{uuid.uuid4().hex}"
