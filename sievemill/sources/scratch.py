"""A folder for files on the way, which the whole cluster sees."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names; where it is unset and all tasks run on this machine, in a temporary one."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = "file://" + tempfile.mkdtemp(prefix="sievemill-")
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"
