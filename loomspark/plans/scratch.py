"""Folders for what queries write: under spark.checkpoint.dir, which all machines of a cluster share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_STORED: dict[tuple, str] = {}


def fresh(spark: SparkSession, label: str) -> str:
    """A new path. Only where the setting is absent and all runs on one machine is a local folder made and set."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(spark: SparkSession, d: str, label: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A derived table, written once in a session for each input folder and read back: what a store holds between jobs."""
    key = (spark.sparkContext.applicationId, d, label)
    if key not in _STORED:
        path = fresh(spark, label)
        make().write.parquet(path)
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])
