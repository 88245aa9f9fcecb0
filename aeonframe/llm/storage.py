"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import itertools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_serial = itertools.count()
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir.

    Only where that setting is missing in a local session (tests) a folder of
    this machine is set, once for the session; on a cluster its lack is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        found = _own[app] = _own.get(app) or "file://" + tempfile.mkdtemp(prefix="aeonframe-")
    return found.rstrip("/")


def persisted(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again.

    The result has no lineage to what made it, so a lost executor costs one
    read and not the work before it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/aeonframe/{label}-{next(_serial)}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, column: str, buckets: int, label: str) -> DataFrame:
    """As persisted, cut by column into so many buckets, so that groups by it need no shuffle.

    Spark keeps buckets of tables only, so the rows become one, outside the
    warehouse in the shared folder. More buckets than Spark allows are not made.
    """
    spark = df.sparkSession
    most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000"))
    name = f"aeonframe_{label.replace('-', '_')}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/aeonframe/{name}"
    df.write.format("parquet").bucketBy(min(buckets, most), column).option("path", path).saveAsTable(name)
    return spark.table(name)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until df has no column of that name in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
        taken.add(name.lower())
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
