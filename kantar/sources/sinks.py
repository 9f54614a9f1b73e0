"""Writing results: versioned tables and append-only logs in Parquet."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_version(df: DataFrame, root: str, version: int, partition_by: list[str] | None = None) -> str:
    """A table's next version in a directory of its own; readers keep the one they have."""
    path = f"{root.rstrip('/')}/version={version:010d}"
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return path


def read_version(spark: SparkSession, root: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/version={version:010d}")


def staging_dir(spark: SparkSession) -> str:
    """The folder of this application's staged rows, in the one that driver and executors share.

    That is the cluster's ``spark.checkpoint.dir``; where that is unset, one in the warehouse.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_staged"
    return f"{root.rstrip('/')}/kantar-{spark.sparkContext.applicationId}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the folder that driver and executors share, and read back.

    What follows starts from a file: it is worked out once however often it is
    read, and its plan does not carry what led to it. ``release`` deletes what was staged.
    """
    path = f"{staging_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> bool:
    """Delete all that this application has staged, once no result is read any more; whether there was anything."""
    path = spark._jvm.org.apache.hadoop.fs.Path(staging_dir(spark))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def append_log(df: DataFrame, path: str) -> None:
    """Decisions, feedback and audit rows are only ever added."""
    df.write.mode("append").parquet(path)


def soft_delete(lists: DataFrame, list_id: int, now) -> DataFrame:
    """``lists`` with one of them inactive."""
    hit = F.col("id") == list_id
    return lists.withColumns({"active": F.when(hit, False).otherwise(F.col("active")), "updated_at": F.when(hit, now).otherwise(F.col("updated_at"))})


def delete_items(items: DataFrame, ids: list[int]) -> DataFrame:
    return items.where(~F.col("id").isin(ids))
