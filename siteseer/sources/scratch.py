"""Places for intermediate tables that all executors can read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the session's checkpoint folder, else in the warehouse; in local mode a temporary folder."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if spark.sparkContext.master.startswith("local"):
            where = "file://" + tempfile.mkdtemp(prefix="siteseer-")
        else:
            where = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/siteseer-scratch"
        spark.sparkContext.setCheckpointDir(where)
    return f"{where}/siteseer-{name}-{uuid.uuid4().hex}"
