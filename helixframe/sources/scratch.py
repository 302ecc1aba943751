"""Folders for files that a job writes and reads back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def new_folder(spark: SparkSession, label: str) -> str:
    """A new path in the session's checkpoint folder, which all executors share; a local one only where none is set and the master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="helixframe-")
    return f"{base.rstrip('/')}/helixframe/{label}-{uuid.uuid4().hex}"
