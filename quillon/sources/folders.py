"""Where temporary databases lie: the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession

from quillon.errors import SessionError


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset a local folder if all runs in one process, as in tests, else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise SessionError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"file://{tempfile.mkdtemp(prefix='quillon-')}"
