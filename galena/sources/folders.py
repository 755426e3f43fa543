"""Folders that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def work_folder(spark: SparkSession, name: str, base: str | None = None) -> str:
    """A new folder below the one given, else below spark.checkpoint.dir.

    Where neither is there, a session in one process (master local) gets a temporary folder; any other is refused, as a
    folder of one machine would lose rows.
    """
    base = base or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-work-", dir="/tmp")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
