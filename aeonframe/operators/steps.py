"""Steps of iterative plans, kept in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame

_local: dict[str, str] = {}


def written(df: DataFrame) -> DataFrame:
    """df, written as Parquet under spark.checkpoint.dir and read again; a local session without that setting uses a folder of its own."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = _local.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="steps-"))
    path = f"{folder.rstrip('/')}/steps/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
