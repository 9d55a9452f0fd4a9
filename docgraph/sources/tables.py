"""Intermediate tables: Parquet in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def table_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a temporary folder if all runs in this process, as in tests; else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="spark-tables-")
    return _OWN[app]


def materialized(df: DataFrame, compression: str | None = None) -> DataFrame:
    """df written and read again. Later plans hold a scan in its place: short plans, known sizes, nothing computed twice.

    compression is a codec of Parquet, that of the session if none is given.
    """
    spark = df.sparkSession
    path = f"{table_root(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)
