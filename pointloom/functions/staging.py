"""Cutting long lineages: tables written once and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def scratch(spark: SparkSession) -> str:
    """A new path in the session's shared folder (spark.checkpoint.dir), removed when the application ends.

    Only where the session names no folder and runs on this machine alone, as in local tests, it is one of this machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("on a cluster spark.checkpoint.dir must name a folder that all executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="pointloom-"))
        base = _LOCAL[0]
    path = f"{base.rstrip('/')}/pointloom-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def staged(df: DataFrame) -> DataFrame:
    """df computed once, as a written table: lost executors cost nothing, and no cache is held."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
